"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

The test strings are the item windows: each run of WINDOW words of an item, or all words of a shorter item.
Strings of one length are searched together. A block is the last two words under the search position (one for strings of a single word). The shift
table gives, for each block of a test string, how far the position may move; a block in no test string moves it
past itself entirely, so most positions are never looked at. Where the shift is zero, the block's suffix bucket
selects the test strings that end in it, narrowed by their first block, and direct comparison confirms an occurrence.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tables import by_slices, utf8
from codequarry.storage import keep

WINDOW = 13
#: test strings that the driver and a worker hold at once, in bytes; more are searched shard by shard
SHARD_BYTES = 16 << 20
#: bytes outside [0-9a-z] and UTF-8 beyond ASCII part words; A-Z are lower-cased
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def fold_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in a row, as a dictionary array of bytes, and their number for each text."""
    plain = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = plain.buffers()
    folded = pa.LargeStringArray.from_buffers(len(plain), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD)), offset=plain.offset)
    parts = pa.compute.ascii_split_whitespace(folded)
    flat = parts.flatten()
    real = pa.compute.greater(pa.compute.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts)) if len(flat) else np.zeros(len(texts), np.int64)
    return flat.filter(real).cast(pa.large_binary()).dictionary_encode(), counts


class WuManber:
    """Search tables for test strings (sequences of words) of one length."""

    def __init__(self, length: int, strings: dict[bytes, set[str]]):
        self.length, self.block = length, min(2, length)
        self.shift: dict[bytes, int] = {}
        self.suffix: dict[bytes, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for joined, items in strings.items():
            tokens = joined.split(b" ")
            for end in range(self.block, length + 1):
                block = b" ".join(tokens[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, length), length - end)
            self.suffix[block][b" ".join(tokens[: self.block])].append((joined, items))
        self.suffix = {k: dict(v) for k, v in self.suffix.items()}

    def search(self, tokens: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        """Mark the words inside occurrences in hit and add their items to found."""
        length, block, shift, n = self.length, self.block, self.shift, len(tokens)
        past = length - block + 1
        end = length
        pair = block == 2
        while end <= n:
            last = tokens[end - 2] + b" " + tokens[end - 1] if pair else tokens[end - 1]
            step = shift.get(last, past)
            if not step:
                start = end - length
                for joined, items in self.suffix[last].get(b" ".join(tokens[start : start + block]), ()):
                    if joined == b" ".join(tokens[start:end]):
                        hit[start:end] = True
                        found |= items
                step = 1
            end += step


def windows_of(items: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(window binary, n_words int, item string): the test strings of the items, each with its words joined by spaces; a null id is named "null"."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {}
        for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            tokens = words(text)
            length = min(WINDOW, len(tokens))
            for start in range(len(tokens) - length + 1 if length else 0):
                found[b" ".join(tokens[start : start + length]), item] = length
        return pa.record_batch([pa.array([w for w, _ in found], pa.binary()), pa.array(list(found.values()), pa.int32()), pa.array([i for _, i in found], pa.string())], names=["window", "n_words", "item"])

    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    return named.mapInArrow(by_slices(work, "text"), "window binary, n_words int, item string")


def test_strings(rows: list[tuple[bytes, int, str]]) -> list[WuManber]:
    """Search tables for (window, number of words, item) rows, one for each length."""
    by_length: dict[int, dict[bytes, set[str]]] = defaultdict(dict)
    for window, length, item in rows:
        by_length[length].setdefault(window, set()).add(item)
    return [WuManber(n, by_length[n]) for n in sorted(by_length)]


#: the tables that this worker used last: a worker builds those of a shard once, not for each task
_built: dict[str, list[WuManber]] = {}


def _tables(token: str, shipped) -> list[WuManber]:
    if token not in _built:
        _built.clear()
        _built[token] = test_strings(shipped.value)
    return _built[token]


def _search(tables: list[WuManber], text: bytes | None) -> tuple[int, bytes, list[str]]:
    """(number of words, their hits as bits or nothing, items found) of a text."""
    tokens = words(text)
    marks, found = np.zeros(len(tokens), bool), set()
    for t in tables:
        t.search(tokens, marks, found)
    return len(tokens), np.packbits(marks).tobytes() if found else b"", sorted(found)


def _hits(docs: DataFrame, text_col: str, token: str, shipped) -> DataFrame:
    """(key, bits, items) of the distinct texts of docs that hold test strings of one shard; key is 128 bits of the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables = _tables(token, shipped)
        found = [(k, *_search(tables, t)) for k, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)))]
        found = [(k, bits, items) for k, _, bits, items in found if items]
        return pa.record_batch([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.list_(pa.string()))], names=["key", "bits", "items"])

    given = docs.select(_text_key(text_col).alias("key"), F.col(text_col).alias("__text")).where("__text is not null")
    return given.mapInArrow(by_slices(work, "__text"), "key string, bits binary, items array<string>").groupBy("key").agg(F.first("bits").alias("bits"), F.first("items").alias("items"))


def _text_key(text_col: str):
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), F.col(text_col))) for seed in (5, 6)])


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_words bigint, n_hit bigint and items array<string>: words, words inside an occurrence of an item window, and the items that occur.

    Null and empty texts have no words and hold nothing; items without words have no window; a null item id is named "null"; repeated
    items count once; an empty benchmark finds nothing. Names of docs that clash with the new ones are replaced.

    The windows are written to the shared folder and measured. Up to shard_bytes of them go to the workers as they are, and nothing is shuffled. More are dealt by their hash to
    shards of that size: one shard at a time is on the driver and in the workers, which read the texts once for each and write down what they hold of it. What the shards found
    of a text is put together and joined to docs by the text. All items of a window are in one shard.
    """
    spark = docs.sparkSession
    windows = keep(windows_of(items, item_col, item_text), "windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item") + 16), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // shard_bytes))
    out = docs.drop("n_words", "n_hit", "items")
    names = [*out.columns, "n_words", "n_hit", "items"]
    at = out.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), "n_words bigint, n_hit bigint, items array<string>"])

    def ship(shard: int):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == shard).collect()
        return uuid.uuid4().hex, spark.sparkContext.broadcast([(bytes(r["window"]), r["n_words"], r["item"]) for r in rows])

    def with_found(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        counts = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for _, b, _ in found]
        new = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(counts, pa.int64()), pa.array([i for _, _, i in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 3], *new], names=names)

    if shards == 1:
        token, shipped = ship(0)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            tables = _tables(token, shipped)
            return with_found(batch, [_search(tables, t) for t in utf8(batch.column(at))])

        return out.mapInArrow(by_slices(work, text_col), schema)

    parts = []
    for shard in range(shards):
        token, shipped = ship(shard)
        parts.append(keep(_hits(out, text_col, token, shipped), "hits"))
        shipped.destroy()
    hits = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.collect_list(F.struct("bits", "items")).alias("__hits"))
    joined = out.withColumn("__key", _text_key(text_col)).join(hits.withColumnRenamed("key", "__key"), "__key", "left").select(*out.columns, "__hits")

    def combine(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text, hits in zip(utf8(batch.column(at)), batch.column(len(names) - 3).to_pylist()):
            bits = np.bitwise_or.reduce([np.frombuffer(h["bits"], np.uint8) for h in hits or ()]).tobytes() if hits else b""
            found.append((len(words(text)), bits, sorted({i for h in hits or () for i in h["items"]})))
        return with_found(batch, found)

    return joined.mapInArrow(by_slices(combine, text_col), schema)


def contaminated():
    """The contract's rule: some word is hit, and the hit words are a twentieth of all or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def items_digest():
    return F.sha2(F.array_join("items", ",").cast("binary"), 256)
