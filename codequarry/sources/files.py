"""Source files as DataFrames: directory trees, single files, path patterns, workspace members."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import ship_package

#: bytes of a piece of a file that is read in splits, at least, but for its last
PIECE_BYTES = 8 << 20


def compile_pattern(pattern: str) -> str | None:
    """The pattern without surrounding white space, leading ./ and trailing /; None if nothing is left."""
    text = pattern.strip().replace("\\", "/")
    text = re.sub(r"^(\./)+", "", text).rstrip("/")
    return text or None


def _segment(glob: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob)


def _path_glob(glob: str) -> str:
    """* and ? stay inside a path segment, ** stands for any number of whole segments."""
    out = []
    parts = glob.split("/")
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out.append("(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*")
        else:
            out.append(_segment(part) + ("" if last else "/"))
    return "".join(out)


def matches_pattern(path: Column, patterns: list[str] | tuple[str, ...], root: str) -> Column:
    """Whether a path below root matches one of the patterns.

    A bare name matches any component of the whole path; a name with wildcards matches the last component; a pattern with slashes matches the path relative to root, the
    end of it, or the whole path. An empty list matches nothing.
    """
    whole = F.regexp_replace(path, r"\\", "/")
    relative = F.regexp_replace(whole, "^" + re.escape(root.rstrip("/")) + "/", "") if root else whole
    out = F.lit(False)
    for pattern in filter(None, map(compile_pattern, patterns)):
        if "/" not in pattern and not re.search(r"[*?]", pattern):
            out = out | whole.rlike(f"(^|/){re.escape(pattern)}(/|$)")
        elif "/" not in pattern:
            out = out | whole.rlike(f"(^|/){_segment(pattern)}$")
        else:
            glob = f"^(?:{_path_glob(pattern)})$"
            suffix = whole.endswith(f"/{pattern}") if not re.search(r"[*?]", pattern) else F.lit(False)
            out = out | relative.rlike(glob) | suffix | whole.rlike(glob)
    return out


def _is_folder(spark: SparkSession, root: str) -> bool:
    """Whether the file system that root is in says that it is a folder; an error where there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("target", ".git"), include: tuple[str, ...] = ()) -> DataFrame:
    """files(path, content) of the .rs files below root and of those that include names, without excluded paths; content is null where it is not UTF-8.

    A single file is read whatever its name; whether root is one is asked of the file system. Only matching files are read: the patterns are asked of the file names
    (_metadata), by which Spark leaves files out before it opens any.
    """
    if not _is_folder(spark, root):
        return _decoded(spark.read.format("binaryFile").load(root))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _decoded(found.where(_wanted(root, exclude, include)))


def _wanted(root: str, exclude: tuple[str, ...], include: tuple[str, ...]) -> Column:
    base = re.sub(r"^file:(//)?", "", root).rstrip("/")
    path = _plain_url(F.col("_metadata.file_path"))
    return (path.endswith(".rs") | matches_pattern(path, include, base)) & ~matches_pattern(path, exclude, base)


def read_checked(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("target", ".git"), include: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(files(path, content), skipped(path, reason)): read_tree() for a tree that may hold files that cannot be scanned; they are told and do not end the job.

    The tree is listed first. A file is skipped because it is `too large` for Spark's limit (spark.sql.sources.binaryFile.maxLength), because it was `unreadable` (what the listing has and the reading
    has not), or as `not UTF-8`. Contents of skipped files are not in files.
    """
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    listed = list_tree(spark, root, exclude, include)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    found = found.where(_wanted(root, exclude, include)) if _is_folder(spark, root) else found
    # the length is asked before a file is opened
    read = _decoded(found.where(F.col("length") <= most))
    lost = listed.join(read.select("path"), "path", "left_anti").select("path", F.when(F.col("length") > most, "too large").otherwise("unreadable").alias("reason"))
    return read.where("content is not null"), lost.unionByName(read.where("content is null").select("path", F.lit("not UTF-8").alias("reason")))


def list_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("target", ".git"), include: tuple[str, ...] = ()) -> DataFrame:
    """(path, modified, length) of the files that read_tree() reads; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = found.where(_wanted(root, exclude, include)) if _is_folder(spark, root) else found
    return found.select(_plain("path").alias("path"), F.col("modificationTime").alias("modified"), "length")


def _plain_url(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:(//)?", "")


def _plain(column: str) -> Column:
    return F.regexp_replace(column, "^file:(//)?", "")


def _decoded(found: DataFrame) -> DataFrame:
    text = F.col("content").cast("string")
    return found.select(_plain("path").alias("path"), F.when(F.is_valid_utf8(text), text).alias("content"))


def _lines_as_pieces(most_bytes: int):
    """A mapInArrow function from lines (path, block, size, value) of splits to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (path, block, size), lines in groupby(rows, key=lambda r: r[:3]):
            held, n_bytes, piece = [], 0, 0
            for *_, line in lines:
                held.append(line)
                n_bytes += len(line) + 1
                if n_bytes >= most_bytes:
                    yield _piece(path, block, piece, size, held)
                    held, n_bytes, piece = [], 0, piece + 1
            if held:
                yield _piece(path, block, piece, size, held)

    return run


def _piece(path: str, block: int, piece: int, size: int, lines: list[str]) -> pa.RecordBatch:
    one = {"path": path, "block": block, "piece": piece, "content": "\n".join(lines) + "\n", "size": size}
    return pa.record_batch([pa.array([v], t) for v, t in zip(one.values(), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()))], names=list(one))


def read_pieces(spark: SparkSession, root: str, piece_bytes: int = PIECE_BYTES, pattern: str = "*") -> DataFrame:
    """pieces(path, block, piece, content, size) of the text files below root whose names match a pattern: for files too large for one task.

    Spark cuts files into splits; a split's lines become pieces of at least piece_bytes that end with a newline, the last of a file too. size is the file's bytes, from which
    lexer.tokens_of_pieces() knows whether its last line had one. A line is never cut.
    """
    ship_package(spark)
    found = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_size")]
    path = _plain_url(meta[0])
    lines = found.select(path.alias("path"), meta[1].alias("block"), meta[2].alias("size"), "value")
    return lines.mapInArrow(_lines_as_pieces(piece_bytes), "path string, block bigint, piece int, content string, size bigint")


def workspace_members(manifest: str) -> list[str]:
    """The members of a [workspace] table of a manifest text, on one line or several; patterns are not expanded."""
    section = re.search(r"(?ms)^\s*\[workspace\]\s*$(.*?)(?=^\s*\[|\Z)", manifest)
    listed = re.search(r"(?s)^\s*members\s*=\s*\[(.*?)\]", section[1], re.M) if section else None
    return re.findall(r'"([^"]*)"', listed[1]) if listed else []


def _place(path: str) -> tuple[str, PurePosixPath]:
    """(scheme and authority, path below them)."""
    store, rest = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)", path, re.S).groups()
    return store or "", PurePosixPath(rest)


def manifest_of(target: str) -> str:
    """Where the manifest of a target is: the target itself, or in its folder."""
    store, at = _place(target)
    return store + str(at if target.endswith("Cargo.toml") else at / "Cargo.toml")


def expand_targets(targets: list[str], manifests: dict[str, str]) -> list[str]:
    """Targets with the folders of manifests and their workspace members, each path once; manifests: texts by path of the manifest file."""
    out: list[str] = []
    for target in targets:
        store, at = _place(target)
        home = at.parent if target.endswith("Cargo.toml") else at
        text = manifests.get(manifest_of(target))
        out += [store + str(p) for p in (home, *(home / m for m in workspace_members(text or "")))]
    return list(dict.fromkeys(out))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file in any store that Spark reads; None where there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at) or system.getFileStatus(at).isDirectory():
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def gitignore_entries(text: str) -> list[str]:
    """The patterns of a .gitignore without comments and negations."""
    lines = (line.strip() for line in text.splitlines())
    return [e for e in (compile_pattern(x.lstrip("/")) for x in lines if x and x[0] not in "#!") if e]
