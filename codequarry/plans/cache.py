"""Incremental scans: findings of unchanged files come from a cache in a shared folder.

The cache is a row of segments, each a Parquet table of files (path, content key, time and size where known) and one of their findings, and a manifest that names the live segments in order. A run
writes one more segment and then puts a new manifest in the place of the old one by an atomic rename, so a run that breaks off leaves nothing that is read. The latest
segment that knows a path decides about it; a path without a content key is gone. When there are many segments they are made one, and those no longer named are removed.

Findings are kept narrow, (file, rule_id, line, column, message, snippet), and meet the rules' texts and severities when they are read: what a rule says may change, and findings of rules that
are no longer there are dropped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.rule_table import Rule, enabled_rules, rule_frame
from codequarry.operators.settings import Settings
from codequarry.plans.scan import FINDING, scanning, with_severity

MANIFEST = "manifest.json"
MOST_SEGMENTS = 8
FILES = "path string, content_key string, modified timestamp, length bigint"
FOUND = "file string, rule_id string, line int, column int, message string, snippet string"
#: settings that decide what a rule finds in a file; the others choose rules and files, or name severities
DECISIVE = ("directive", "product", "rule_prefix", "prefilter", "maximum", "dead_suppressions")


def fingerprint(settings: Settings) -> str:
    """A digest of the settings that decide what rules find."""
    said = asdict(settings)
    return hashlib.sha256(repr([said[k] for k in DECISIVE]).encode()).hexdigest()


def content_keys(files: DataFrame) -> DataFrame:
    """(path, content_key): SHA-256 of the content."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_key"))


def split_by_cache(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unchanged, changed) of files against known(path, content_key)."""
    keyed = files.withColumn("content_key", F.sha2(F.col("content").cast("binary"), 256))
    on = ["path", "content_key"]
    return keyed.join(known, on, "left_semi").select("path", "content"), keyed.join(known, on, "left_anti").select("path", "content")


class Cache:
    """The cache in a folder, for a scan with given settings and rules."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings(), extra: list[Rule] | None = None, most_segments: int = MOST_SEGMENTS):
        self.spark, self.folder, self.settings, self.extra, self.most_segments = spark, folder.rstrip("/"), settings, extra, most_segments
        self.rules = enabled_rules(settings) + list(extra or [])
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.system = self.hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}")

    def _identity(self) -> dict[str, list]:
        return {r.rule_id: [r.rule_name, r.category, list(r.signatures)] for r in self.rules}

    def manifest(self) -> dict:
        """What the cache holds for these settings: nothing where others wrote it, or where a rule is missing from it."""
        none = {"fingerprint": fingerprint(self.settings), "rules": self._identity(), "segments": []}
        if not self.system.exists(self._path(MANIFEST)):
            return none
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.folder}/{MANIFEST}", wholetext=True).collect())
        held = json.loads(text)
        ours = self._identity()
        same = held["fingerprint"] == none["fingerprint"] and all(held["rules"].get(k) == v for k, v in ours.items())
        # whether a directive is dead depends on all rules that run
        judged = f"{self.settings.rule_prefix}066" in ours and set(held["rules"]) != set(ours)
        return held if same and not judged else none

    def _publish(self, manifest: dict) -> None:
        """The manifest in place of the old one, at once."""
        new = self._path(f"{MANIFEST}.{uuid.uuid4().hex}")
        stream = self.system.create(new, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        gateway = self.spark.sparkContext._gateway
        over = gateway.new_array(self.hadoop.Options.Rename, 1)
        over[0] = self.hadoop.Options.Rename.OVERWRITE
        self.hadoop.FileContext.getFileContext(self.system.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self.system.makeQualified(new), self.system.makeQualified(self._path(MANIFEST)), over)

    def _tables(self, segments: list[str], kind: str, schema: str) -> DataFrame:
        """The rows of segments with their order as `segment`."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{s}/{kind}").withColumn("segment", F.lit(n)) for n, s in enumerate(segments)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment int")

    def _latest(self, manifest: dict) -> DataFrame:
        """(path, segment, content_key, modified, length) of the live state of each path."""
        rows = self._tables(manifest["segments"], "files", FILES)
        last = rows.groupBy("path").agg(F.max(F.struct("segment", "content_key", "modified", "length")).alias("s")).select("path", "s.*")
        return last.where("content_key is not null")

    def known(self) -> DataFrame:
        """(path, content_key, modified, length) of the files whose findings are here."""
        return self._latest(self.manifest()).drop("segment")

    def _live(self, manifest: dict) -> DataFrame:
        found = self._tables(manifest["segments"], "findings", FOUND)
        return found.join(self._latest(manifest).select(F.col("path").alias("file"), "segment"), ["file", "segment"], "left_semi").drop("segment")

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Scans changed(path, content, and modified and length if known) into a new segment; gone(path) are forgotten. Null contents are kept as files without findings."""
        before = self.manifest()
        name = f"segment-{uuid.uuid4().hex}"
        extras = [F.col(c) if c in changed.columns else F.lit(None).cast(t).alias(c) for c, t in (("modified", "timestamp"), ("length", "bigint"))]
        key = F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("unreadable")).alias("content_key")
        with scanning(changed.select("path", "content"), self.settings, self.extra) as found:
            found.select("file", "rule_id", "line", "column", "message", "snippet").write.parquet(f"{self.folder}/{name}/findings")
        files = changed.select("path", key, *extras)
        if gone is not None:
            files = files.unionByName(gone.select("path"), allowMissingColumns=True)
        files.write.parquet(f"{self.folder}/{name}/files")
        after = before | {"segments": [*before["segments"], name]}
        if len(after["segments"]) > self.most_segments:
            after = self._compacted(after)
        self._publish(after)
        self._sweep(after["segments"])

    def _compacted(self, manifest: dict) -> dict:
        """The manifest of one segment with all that is live."""
        name = f"segment-{uuid.uuid4().hex}"
        self._live(manifest).write.parquet(f"{self.folder}/{name}/findings")
        self._latest(manifest).drop("segment").write.parquet(f"{self.folder}/{name}/files")
        return manifest | {"segments": [name]}

    def _sweep(self, live: list[str]) -> None:
        for status in self.system.listStatus(self._path("")) if self.folder else []:
            name = status.getPath().getName()
            if name.startswith("segment-") and name not in live:
                self.system.delete(status.getPath(), True)

    def findings(self) -> DataFrame:
        """The findings of all known files, with the texts and severities that their rules have now. They are read from segments that a later update may remove."""
        dimension = rule_frame(self.spark, self.rules).drop("description", "signatures", "ordinal")
        return with_severity(self._live(self.manifest()).join(F.broadcast(dimension), "rule_id"), self.settings.severity).select(*FINDING)


def scan_with_cache(files: DataFrame, cache: str, settings: Settings = Settings(), extra: list[Rule] | None = None, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """The findings of files(path, content); those of unchanged files are read from the cache folder, the others are scanned into it. What the cache knows of other files stays there."""
    held = Cache(files.sparkSession, cache, settings, extra, most_segments)
    changed = split_by_cache(files.where("content is not null"), held.known().select("path", "content_key"))[1]
    if not changed.isEmpty():
        held.update(changed)
    return held.findings().join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select(*FINDING)
