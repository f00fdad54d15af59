"""The scan: candidates of all rules, minus what is suppressed, with rule texts, as ordered findings."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators import suppress
from codequarry.operators.lexer import lines_of
from codequarry.operators.prefilter import only_allowed
from codequarry.operators.rule_table import Rule, all_rules, enabled_rules, rule_frame
from codequarry.operators.rules import CANDIDATE, Views, candidates
from codequarry.operators.settings import Settings
from codequarry.storage import keep

FINDING = ["rule_id", "rule_name", "category", "severity", "file", "line", "column", "message", "snippet", "suggestion", "suggestion_example"]
ORDER = ["file", "line", "column", "rule_id", "message"]


def numbers_of(rules: list[Rule], settings: Settings) -> set[int]:
    return {int(r.rule_id[len(settings.rule_prefix) :]) for r in rules}


def shown(parts: list[tuple[DataFrame, str]], views: Views) -> DataFrame:
    """The candidates of all parts with the snippets of their anchor lines, without code_only candidates on comment lines. Only where a line's text is not known is it looked for."""
    by_knowledge: dict[str, DataFrame] = {}
    for part, known in parts:
        part = part.select(*CANDIDATE, "text" if "text" in part.columns else F.lit(None).cast("string").alias("text"))
        by_knowledge[known] = by_knowledge[known].unionByName(part) if known in by_knowledge else part
    at = F.col("line").alias("anchor_line")
    if "large" in by_knowledge and views.has_large:
        lines = lines_of(views.stored.where("large")).select("path", at, F.col("text").alias("looked_up"))
        by_knowledge["large"] = by_knowledge["large"].join(lines, ["path", "anchor_line"], "left").withColumn("text", F.coalesce("text", "looked_up")).drop("looked_up")
    if "none" in by_knowledge:
        by_knowledge["none"] = by_knowledge["none"].drop("text").join(views.loose_lines.select("path", at, "text"), ["path", "anchor_line"])
    columns = [*CANDIDATE, "text"]
    whole = views.loose_lines.select(F.lit(None).cast("string").alias("path"), *(F.lit(None).cast(t).alias(c) for c, t in zip(columns[1:], ("string", "int", "int", "string", "int", "string", "boolean", "string")))).where("false") if not by_knowledge else None
    for found in by_knowledge.values():
        whole = found.select(*columns) if whole is None else whole.unionByName(found.select(*columns))
    kept = whole.where(~F.col("code_only") | ~T.is_comment_line(F.col("text")))
    return kept.withColumn("snippet", F.coalesce("snippet", T.trim(F.col("text")))).select(*CANDIDATE)


def scan(files: DataFrame, settings: Settings = Settings(), extra: list[Rule] | None = None, views: Views | None = None) -> DataFrame:
    """Findings of files(path, content), not ordered; null contents are skipped. extra: rows of registered rules.

    views: relations of the same files and settings to use, for a caller that releases them once the findings are written (see scanning()).
    """
    rules = enabled_rules(settings) + list(extra or [])
    spark, views = files.sparkSession, views or Views(files, settings, share=True)
    dimension = rule_frame(spark, rules)
    numbers = numbers_of(rules, settings)
    dead = views.id_of(66)
    found = views.shared(shown(candidates(views, numbers - {66}), views), "candidates")
    if settings.prefilter and not settings.maximum:
        found = only_allowed(found, views.sources, rules)
    directed = suppress.directives(views.loose_lines, settings)
    suppressed = suppress.suppressed_rules(directed, dimension)
    kept = suppress.without_suppressed(found, suppressed)
    if 66 in numbers:
        active = kept if settings.dead_suppressions == "pipeline" else shown(candidates(views, numbers_of(all_rules(settings), settings) - {66}), views)
        stale = suppress.stale_directives(directed, active, settings).select(
            "path", F.lit(dead).alias("rule_id"), F.col("line"), F.lit(1).alias("column"), F.concat(F.lit("suppression for `"), F.col("rule_id"), F.lit("` does not match any finding in this file")).alias("message"),
            F.col("line").alias("anchor_line"), T.trim(F.col("text")).alias("snippet"), F.lit(False).alias("code_only"),
        )
        kept = kept.select(*CANDIDATE).unionByName(suppress.without_suppressed(stale, suppressed).select(*CANDIDATE))
    named = kept.join(F.broadcast(dimension.drop("description", "signatures", "ordinal")), "rule_id").withColumnRenamed("path", "file")
    return with_severity(named, settings.severity).select(*FINDING)


def with_severity(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """findings with severities from the overrides by rule id, where there is one."""
    if not overrides:
        return findings
    table = findings.sparkSession.createDataFrame(sorted(overrides.items()), "rule_id string, override string")
    joined = findings.join(F.broadcast(table), "rule_id", "left")
    return joined.withColumn("severity", F.coalesce("override", "severity")).drop("override")


@contextmanager
def scanning(files: DataFrame, settings: Settings = Settings(), extra: list[Rule] | None = None):
    """scan() for a with block: the relations that it keeps in the shared folder are removed when the block ends, so the findings are to be written or counted inside."""
    views = Views(files, settings, share=True)
    try:
        yield scan(files, settings, extra, views)
    finally:
        views.release()


def ordered(findings: DataFrame) -> DataFrame:
    """One global order: file, line, column, rule id, message."""
    return findings.orderBy(*ORDER)


def file_ordinals(files: DataFrame) -> DataFrame:
    """(path, ordinal long): the place, from 0, of each path in the order of a walk through sorted folders, that is, by path components. A kept table.

    Paths are dealt by range and sorted in their partitions; a partition's number of rows, of which the driver adds up one for each partition, gives where the next begins.
    """
    split = F.split("path", "/")
    sorted_ = files.select("path").distinct().repartitionByRange(split).sortWithinPartitions(split)
    placed = keep(sorted_.select("path", F.monotonically_increasing_id().alias("id")), "ordinals")
    part = F.shiftright("id", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg((F.max(F.col("id").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("n")).collect()}
    begins, total = [], 0
    for n in range(max(sizes, default=-1) + 1):
        begins.append(total)
        total += sizes.get(n, 0)
    base = F.get(F.from_json(F.lit(json.dumps(begins)), "array<bigint>"), part)
    return placed.select("path", (base + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("ordinal"))


def with_chunks(findings: DataFrame, files: DataFrame, chunk: int = 256) -> DataFrame:
    """findings with `chunk`: the number of the batch of so many files, in walking order, that their file is in."""
    chunks = file_ordinals(files).select(F.col("path").alias("file"), F.floor(F.col("ordinal") / chunk).alias("chunk"))
    return findings.join(chunks, "file").select(*findings.columns, "chunk")


def ordered_by_chunks(findings: DataFrame, files: DataFrame, chunk: int = 256) -> DataFrame:
    """The order of reports that are made batch by batch: batches of so many files as they are walked, each with its findings by file, line, column, rule id and message."""
    return with_chunks(findings, files, chunk).orderBy("chunk", F.split("file", "/"), *ORDER[1:])


def signatures(findings: DataFrame) -> DataFrame:
    """findings with the text that identifies each in a baseline: rule, path, line, column, message; newlines in messages are escaped."""
    path = F.regexp_replace("file", r"\\", "/")
    message = F.replace(F.col("message"), F.lit("\n"), F.lit("\\n"))
    return findings.withColumn("signature", F.concat_ws("|", "rule_id", path, F.col("line").cast("string"), F.col("column").cast("string"), message))


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """findings whose signature is not a row of baseline(signature)."""
    return signatures(findings).join(baseline.select("signature").distinct(), "signature", "left_anti").drop("signature")
