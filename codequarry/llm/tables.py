"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model may learn from: crc32 of the id's digits mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(column: pa.Array) -> list:
    """The values of a string column as bytes, None for null."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most most_bytes of text, or a single longer row. What a batch's work held is given back before the next."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        start, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        for row, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)


def by_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, most_bytes: int = 8 << 20):
    """A mapInArrow function that gives work() slices of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(work, slices(batches, column, most_bytes))

    return run


def next_rows(df: DataFrame, id_col: str, tie_col: str, carried: list[str], rows_per_bucket: int = 1000, most_buckets: int = 1 << 16) -> DataFrame:
    """df with next_<c> for each carried column c: its value in the next row by descending id, then a hash of tie_col, then tie_col; the first row follows the last.

    Ids are integers; null ids come last, with the least integer. Rows are dealt to buckets of neighbouring ids and hashes, so that neither null ids nor many rows of one id share
    a bucket; the first row of a bucket is also dealt to the bucket before, so each row finds its successor in its own bucket and no task sorts the whole table. The driver
    holds the first key of each bucket only. Only rows that are the same in both columns stay in one bucket.
    """
    own_key = {"__hi": F.coalesce(F.bitwise_not(F.col(id_col).cast("bigint")), F.lit(2**63 - 1)), "__lo": F.xxhash64(tie_col)}
    keyed = df.withColumns(own_key)
    keys = keyed.select(*own_key)
    n = keys.count()
    if not n:
        return df.withColumns({f"next_{c}": F.col(c) for c in carried})
    ranged = keys.repartitionByRange(min(most_buckets, -(-n // rows_per_bucket)), *own_key)
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*own_key)).alias("k")).select("k.*").collect()
    firsts = sorted((r["__hi"], r["__lo"]) for r in firsts)
    hi, lo = (F.from_json(F.lit(json.dumps([k[i] for k in firsts])), "array<bigint>") for i in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in range(len(firsts).bit_length() - 1, -1, -1)])

    def begun(i):
        """Whether bucket i begins at or before the row's key."""
        return (F.get(hi, i) < F.col("__hi")) | ((F.get(hi, i) == F.col("__hi")) & (F.get(lo, i) <= F.col("__lo")))

    # the last bucket that has begun, by bisection
    bucket = F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s < len(firsts)) & begun(i + s), i + s).otherwise(i))
    opens = (F.get(hi, F.col("__b")) == F.col("__hi")) & (F.get(lo, F.col("__b")) == F.col("__lo"))
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("turn"))
    guest = F.when(opens, F.struct(F.pmod(F.col("__b") - 1, F.lit(len(firsts))).alias("b"), F.lit(1).alias("turn")))
    dealt = keyed.withColumn("__b", bucket).withColumn("__to", F.explode(F.array_compact(F.array(own, guest))))
    window = Window.partitionBy("__to.b").orderBy("__to.turn", "__hi", "__lo", F.col(tie_col).asc_nulls_last())
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in carried})
    return led.where("__to.turn = 0").drop("__b", "__to", *own_key)


#: a key is hot if it has more than one in HOT_SHARE of all rows: fewer than HOT_SHARE keys can
HOT_SHARE = 1000


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """rows with the columns of keyed (one row for each key) but n_col, by an inner join in which no key brings more than a HOT_SHARE-th of the rows to one task.

    n_col is how many rows have the key, and total at least their sum over all keys. Hot keys are therefore fewer than HOT_SHARE, whatever the data: these are broadcast, and their
    rows stay where they are read. Null keys join nothing.
    """
    hot = F.col(n_col) * HOT_SHARE > F.lit(total)
    few, others = F.broadcast(keyed.where(hot).drop(n_col)), keyed.where(~hot).drop(n_col)
    cold = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(others, key))


def bitmap_filter(df: DataFrame, column: str, wanted: DataFrame, log_bits: int = 22) -> DataFrame:
    """The rows of df whose value is perhaps in the one column of wanted: no wanted row is lost, most others are, and nothing is shuffled.

    What is broadcast is a bitmap of 2 ** log_bits bits, however many values there are. An exact join must follow.
    """
    (name,) = wanted.columns

    def place(c: str):
        return F.pmod(F.xxhash64(c), F.lit(1 << log_bits)) + 1

    bits = wanted.select(place(name).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    at = F.bitmap_bit_position(F.col("__at"))
    octet = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", octet, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    marked = df.withColumn("__at", place(column)).withColumn("__bucket", F.bitmap_bucket_number("__at"))
    return marked.join(F.broadcast(bits), "__bucket").where(hit).select(*df.columns)
