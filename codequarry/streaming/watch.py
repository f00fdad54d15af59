"""Scanning source files as they arrive and as they change, with Structured Streaming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators.settings import Settings
from codequarry.plans.cache import Cache
from codequarry.plans.scan import scanning
from codequarry.sources.files import _decoded, list_tree, read_tree

#: changed files that are read by name; of more the tree is read as a whole
MOST_NAMED = 10_000


def new_files(spark: SparkSession, root: str, most_files: int = 256) -> DataFrame:
    """files(path, content) of the files below root as a stream, so many a batch at most. A file is taken once, when its name is first seen; see watch_changes()."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _decoded(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).load(root))


def watch(files: DataFrame, findings: str, checkpoint: str, settings: Settings = Settings(), once: bool = False) -> StreamingQuery:
    """Scan each batch of a stream of files and append its findings to a Parquet folder, a sub-folder for each batch.

    A batch that is run again after a failure overwrites its own sub-folder, so every file's findings are there once; what a scan keeps in the shared folder goes with its batch. once: work off what is there and stop.
    """

    def batch(rows: DataFrame, number: int) -> None:
        with scanning(rows, settings) as found:
            found.write.mode("overwrite").parquet(f"{findings}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def scan_changes(spark: SparkSession, root: str, cache: str, settings: Settings = Settings()) -> tuple[int, int]:
    """(files scanned, files gone): brings the cache in a folder up to the tree below root.

    Files are listed without being read; those whose time and size the cache knows are left alone, the others are read and scanned, and their findings replace what was there. Paths below root that
    are no longer there are forgotten.
    """
    held = Cache(spark, cache, settings)
    known = held.known()
    listed = list_tree(spark, root, settings.exclude, settings.include)
    same = ["path", "modified", "length"]
    fresh = listed.join(known.select(*same), same, "left_anti")
    gone = known.select("path").join(listed.select("path"), "path", "left_anti").persist()
    named = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in fresh.select("path").limit(MOST_NAMED + 1).collect()]
    if len(named) > MOST_NAMED:
        contents = read_tree(spark, root, settings.exclude, settings.include)
    else:
        contents = _decoded(spark.read.format("binaryFile").load(named)) if named else spark.createDataFrame([], "path string, content string")
    changed = contents.join(fresh, "path").persist()
    try:
        counts = changed.count(), gone.count()
        if any(counts):
            held.update(changed, gone)
        return counts
    finally:
        changed.unpersist()
        gone.unpersist()


def watch_changes(spark: SparkSession, root: str, cache: str, checkpoint: str, settings: Settings = Settings(), every: str = "10 seconds") -> StreamingQuery:
    """A streaming query that runs scan_changes() again and again; Cache.findings() has the findings of the tree as it was last seen.

    The state, which file was scanned with which time and size, is the cache's own, so a stopped query goes on where it was, and a tick that is run again finds nothing to do.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(rows: DataFrame, number: int) -> None:
        scan_changes(spark, root, cache, settings)

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def findings_of(spark: SparkSession, cache: str, settings: Settings = Settings()) -> DataFrame:
    """The findings that a cache holds."""
    return Cache(spark, cache, settings).findings()


