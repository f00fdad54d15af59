"""Findings as rows of text, JSON and SARIF, and the files made of them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import ship_package

from codequarry.plans.scan import FINDING, ordered, signatures

BASELINE_HEAD = "# baseline v1"


def human_rows(findings: DataFrame, width: int = 100) -> DataFrame:
    """(file, line, column, rule_id, message, text): a few lines of text for each finding, on one line where it fits the width."""
    path = F.regexp_replace("file", r"\\", "/")
    place = F.concat(path, F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"))
    told = F.concat(F.col("rule_id"), F.lit("  "), F.col("message"), F.lit(" ["), F.col("rule_name"), F.lit("]\n"))
    one = F.concat(place, F.lit("  "), F.rpad("severity", 8, " "), F.lit(" "), told)
    two = F.concat(place, F.lit("\n  "), F.col("severity"), F.lit(" "), told)
    example = F.concat(F.lit("      = example:\n"), F.regexp_replace("suggestion_example", r"(?m)^(.*)$", "          $1"), F.lit("\n"))
    text = F.concat(
        F.when(F.length(path) + F.length("message") > width, two).otherwise(one), F.lit("      | "), F.col("snippet"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("      = help: "), F.col("suggestion"), F.lit("\n")), F.lit("")), F.coalesce(example, F.lit("")),
    )
    return findings.select("file", "line", "column", "rule_id", "message", text.alias("text"))


def summary_line(findings: int, files: int, rules: int) -> str:
    return f"{findings} finding(s) in {files} file(s) scanned ({rules} rule(s) enabled)\n"


def json_row() -> Column:
    """A finding as a JSON object with its eleven keys in order, nulls included."""
    return F.to_json(F.struct(*FINDING), {"ignoreNullFields": "false"})


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "warning", "warning").otherwise("note")


def sarif_row() -> Column:
    """A finding as a SARIF 2.1.0 result object; the help key is there if there is a suggestion."""
    place = F.struct(
        F.struct(
            F.struct(F.regexp_replace("file", r"\\", "/").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region"),
        ).alias("physicalLocation")
    )
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.col("suggestion").alias("help")))


def write_findings(findings: DataFrame, path: str, form: str = "json") -> None:
    """One row a line, in report order, as text files of a folder: form is human, json or sarif. Sorting and writing are distributed; nothing is collected."""
    rows = ordered(findings)
    text = {"human": lambda: human_rows(rows).select("text"), "json": lambda: rows.select(json_row().alias("text")), "sarif": lambda: rows.select(sarif_row().alias("text"))}[form]()
    text.write.text(path)


SARIF_HEAD = '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{driver}}},"results":['
SARIF_TAIL = "]}]}"


def _separated(rows: DataFrame) -> DataFrame:
    """The one column of rows, with a comma behind each row of a partition but its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            if batch.num_rows:
                texts = held + batch.column(0).to_pylist()
                held = texts[-1:]
                yield pa.record_batch([pa.array([t + "," for t in texts[:-1]], pa.string())], names=["text"])
        yield pa.record_batch([pa.array(held, pa.string())], names=["text"])

    return rows.mapInArrow(run, "text string")


def _indented(rows: DataFrame, levels: int) -> DataFrame:
    """The JSON objects of the one column of rows over several lines, so many levels deep."""
    pad = "  " * levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([pad + pretty_json(t).rstrip("\n").replace("\n", "\n" + pad) for t in batch.column(0).to_pylist()], pa.string())], names=["text"])

    return rows.mapInArrow(run, "text string")


def write_document(findings: DataFrame, path: str, form: str = "json", tool: str = "codequarry", version: str = "0", pretty: bool = False, n_files: int = 0, n_rules: int = 0) -> None:
    """The findings in report order as one file: a JSON array, a SARIF log or the human report; fails where the path exists.

    The executors sort the rows and write them in ordered parts, with what stands between rows already in place; Spark's committer makes the parts complete before any is looked at. They are then
    joined in the store, by its own concatenation where it has one, else by copying with a small buffer, under another name that becomes path at the end. No row passes through the driver's
    memory, and what breaks off leaves no document.
    """
    spark = ship_package(findings.sparkSession)
    rows = ordered(findings)
    if form == "human":
        texts, head, tail = human_rows(rows).select(F.regexp_replace("text", r"\n\z", "").alias("text")), "", None
    else:
        texts = rows.select((json_row() if form == "json" else sarif_row()).alias("text"))
        driver = json.dumps({"name": tool, "version": version}, separators=(",", ":"))
        head, tail = ("[", "]") if form == "json" else (SARIF_HEAD.format(driver=driver), SARIF_TAIL)
        texts = _separated(_indented(texts, 1 if form == "json" else 4) if pretty else texts)
    fs = spark._jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    work = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        texts.write.text(f"{work}/rows")
        listed = [s for s in system.listStatus(fs.Path(f"{work}/rows")) if s.getPath().getName().startswith("part-") and s.getLen()]
        parts = [s.getPath() for s in sorted(listed, key=lambda s: s.getPath().getName())]
        if tail is None:
            n = findings.count()
            tail = ("\n" if n else "") + summary_line(n, n_files, n_rules).removesuffix("\n")
        if pretty and form != "human":
            # what a pretty printer makes of the document without rows, cut where they belong; parts end with a newline
            head, tail = pretty_json(head + "\0" + tail).removesuffix("\n").split("\0") if parts else (pretty_json(head + tail).removesuffix("\n"), "")
            head, tail = (head.rstrip() + "\n", tail.removeprefix("\n")) if parts else (head, tail)
        pieces = [_small(system, fs.Path(f"{work}/head"), head)]
        for n, part in enumerate(parts):
            if n and form != "human":
                pieces.append(_small(system, fs.Path(f"{work}/between-{n}"), ",\n"))
            pieces.append(part)
        pieces.append(_small(system, fs.Path(f"{work}/tail"), tail + "\n"))
        whole = _joined(spark, system, pieces, fs.Path(f"{work}/whole"))
        if not system.rename(whole, target):
            raise OSError(f"cannot name the report {path}")
    finally:
        system.delete(fs.Path(work), True)


def _small(system, at, text: str):
    stream = system.create(at, True)
    stream.write(text.encode())
    stream.close()
    return at


def _joined(spark, system, pieces: list, whole):
    """One file of the pieces in order, none of which need stay."""
    gateway = spark.sparkContext._gateway
    try:
        rest = gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(pieces) - 1)
        for n, p in enumerate(pieces[1:]):
            rest[n] = p
        system.concat(pieces[0], rest)
        return pieces[0]
    except Exception:  # a store without concatenation
        out = system.create(whole, True)
        for p in pieces:
            stream = system.open(p)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
        out.close()
        return whole


def document_rows(findings: DataFrame, form: str, tool: str = "codequarry", version: str = "0") -> Iterator[str]:
    """The JSON or SARIF document piece by piece, for a terminal: the driver holds one partition at a time."""
    driver = json.dumps({"name": tool, "version": version}, separators=(",", ":"))
    yield "[" if form == "json" else SARIF_HEAD.format(driver=driver)
    rows = ordered(findings).select((json_row() if form == "json" else sarif_row()).alias("j"))
    for n, r in enumerate(rows.toLocalIterator()):
        yield ("," if n else "") + r["j"]
    yield "]" if form == "json" else SARIF_TAIL


def json_document(findings: DataFrame) -> str:
    """The findings as one JSON array: a report that someone reads, made on the driver."""
    return "".join(document_rows(findings, "json"))


def sarif_document(findings: DataFrame, tool: str, version: str) -> str:
    """The findings as one SARIF log."""
    return "".join(document_rows(findings, "sarif", tool, version))


def human_document(findings: DataFrame, files: int, rules: int, width: int = 100) -> str:
    text = [r["text"] for r in human_rows(ordered(findings), width).select("text").toLocalIterator()]
    return "".join(text) + ("\n" if text else "") + summary_line(len(text), files, rules)


def pretty_json(text: str) -> str:
    """JSON text with a line for each element, indented by two spaces; an empty list or object is broken over lines too."""
    out, depth, quoted, escaped = [], 0, False, False
    for c in text:
        if quoted:
            out.append(c)
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            continue
        if c in "{[":
            depth += 1
            out.append(f"{c}\n{'  ' * depth}")
        elif c in "}]":
            depth -= 1
            out.append(f"\n{'  ' * depth}{c}")
        else:
            out.append(f",\n{'  ' * depth}" if c == "," else ": " if c == ":" else c)
            quoted = c == '"'
    return "".join(out) + "\n"


def write_baseline(findings: DataFrame, path: str) -> None:
    """A heading, then the findings' signatures as text, one a line, in files of a folder; fails where the path exists."""
    head = findings.sparkSession.createDataFrame([(BASELINE_HEAD,)], "value string").coalesce(1)
    head.union(signatures(findings).select("signature").distinct()).write.mode("error").text(path)


def read_baseline(spark, path: str) -> DataFrame:
    """baseline(signature): trimmed lines that are not empty and do not begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("signature")).where("signature <> '' and not startswith(signature, '#')").distinct()
