"""SimHash near-duplicate groups by an inverted index over the byte positions of 64-bit fingerprints.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 3 of their 8 bytes, so they share
at least 5 positional bytes. Every 5 of the 8 positions hold 3 positions that lie in the same half of the fingerprint, hence
posting lists keyed by the 8 triples within a half see each such pair, and pairs that share fewer than 3 bytes of a half are never formed.
Lists of single positions would each hold a 256th of all fingerprints. Within a posting list
the shared positional bytes of each pair are tallied over all 8 positions; pairs below 5 are dropped, and only those that reach it are
verified by their differing bits.

Posting lists over BLOCK fingerprints are split into blocks and compared block by block in separate tasks. A
task returns the links of its lists as a spanning forest (a row per linked fingerprint), not as all pairs: no link is lost for
connectivity, and output stays linear in dense groups. Equal fingerprints are merged before anything is paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.components import connected_components
from codequarry.llm.tables import by_slices, join_spread, utf8
from codequarry.storage import discard, keep

SHINGLE_WORDS = 3
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
BLOCK = 1024
_LANES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def shingle_hashes(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each run of words; of the whole sequence if it is shorter; none for no words."""
    tokens = (text or b"").lower().split()  # A-Z only; splits at the six ASCII white-space bytes
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 for none. Counts 255 hashes at a time in byte lanes."""
    n = len(hashes)
    if not n:
        return 0
    full = np.zeros(-(-n // 255) * 255, np.uint64)
    full[:n] = hashes
    full = full.reshape(-1, 255)
    value = 0
    for bit in range(8):
        lanes = ((full >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n).tolist():
            value |= 1 << (8 * byte + bit)
    return value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, others, fp long) for every row: the signed value of the 64-bit SimHash of the whole text; null and blank texts have 0."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(shingle_hashes(t)) for t in utf8(batch.column(batch.num_columns - 1))], np.uint64)
        return pa.record_batch([*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*kept, "fp"])

    kept = [id_col, *others]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(by_slices(work, "__text"), f"{schema}, fp bigint")


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the links a-b, roots left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of each pair: at how many of the 8 positions the bytes are equal."""
    differ = (a ^ b).view(np.uint64)
    # the high bit of a byte ends up set if any bit of the byte is
    unlike = ((differ & _LOW) + _LOW | differ) & ~_LOW
    return 8 - np.bitwise_count(unlike)


def _linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Indices of the linked pairs of a and b (of one shape, or broadcast): the count filter on positional bytes, then the differing bits of those that pass it."""
    at = np.nonzero(shared_bytes(a, b) >= LEAST_BYTES)
    a, b = (np.broadcast_to(x, np.broadcast_shapes(a.shape, b.shape))[at] for x in (a, b))
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= MOST_BITS
    return tuple(i[near] for i in at)


def _links_of_runs(fp: np.ndarray, block: np.ndarray, starts: np.ndarray) -> tuple[list, list]:
    """Links within the runs that begin at starts: within a run of one block, or between its two blocks."""
    left, right = [], []
    sizes = np.diff(np.append(starts, len(fp)))
    run = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= 32, sizes)
    one = np.repeat(np.minimum.reduceat(block, starts) == np.maximum.reduceat(block, starts), sizes)
    at = np.flatnonzero(small)
    for step in range(1, int(sizes[sizes <= 32].max(initial=0))):
        i, j = at[:-step], at[step:]
        near = (run[i] == run[j]) & (one[i] | (block[i] != block[j]))
        i, j = i[near], j[near]
        (linked,) = _linked(fp[i], fp[j])
        left.append(fp[i[linked]])
        right.append(fp[j[linked]])
    for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        values, blocks = fp[start : start + size], block[start : start + size]
        first = blocks == blocks.min()
        rows, columns = (values, values) if first.all() else (values[first], values[~first])
        found: list = []
        for cut in range(0, len(rows), 256):
            part = rows[cut : cut + 256]
            i, j = _linked(part[:, None], columns[None, :])
            found.append(np.stack([part[i], columns[j]]))
        a, b = np.concatenate(found, axis=1)
        a, b = spanning_forest(a, b)
        left.append(a)
        right.append(b)
    return left, right


def _forest_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, pair, block, fp) to links (a, b). A posting list that straddles batches is carried over."""
    held = [np.empty(0, np.int64)] * 4

    def links(columns: list) -> Iterator[pa.RecordBatch]:
        key, pair, block, fp = columns
        if len(fp):
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])))
            left, right = _links_of_runs(fp, block, starts)
            if left and sum(map(len, left)):
                a, b = spanning_forest(np.concatenate(left), np.concatenate(right))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns)]
        new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(new):
            cut = int(new[-1]) + 1
            yield from links([h[:cut] for h in held])
            held = [h[cut:] for h in held]
    yield from links(held)


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs of the distinct values fp within MOST_BITS bits."""

    def octet(i: int):
        return F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255))

    keys = F.array(*[F.lit(n << 24) + octet(t[0]) * 65536 + octet(t[1]) * 256 + octet(t[2]) for n, t in enumerate(TRIPLES)])
    listed = fps.select("fp", F.explode(keys).alias("key"))
    shared = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = (
        join_spread(listed, shared.withColumn("size", F.col("n")), "key", "n", len(TRIPLES) * fps.count())
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", (F.least("block", "other") * F.lit(1 << 20).cast("bigint") + F.greatest("block", "other")).alias("pair"), F.col("block").cast("bigint").alias("block"), "fp")
    )
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "fp").mapInArrow(_forest_of_lists, "a bigint, b bigint")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id_col, fp, root, component_id) for every row; root is the smallest fingerprint of the row's group. Also the kept tables that this reads.

    Copies, blank texts and the fingerprints of one group may be a third of all rows: they never meet, but take what is known of their key by broadcast (join_spread).
    """
    rows = keep(fingerprints(docs, id_col, text_col), "simhash")
    # one row for each distinct fingerprint from here on
    distinct = keep(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = connected_components(near_links(distinct.select("fp")), "a", "b")
    rooted = keep(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    totals = distinct.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    classes = keep(join_spread(rooted.select("fp", "root", "n"), groups, "root", "members", totals["fps"]).select("fp", "root", "component_id", "n"), "classes")
    for table in (distinct, roots, rooted):
        discard(table)
    return join_spread(rows, classes, "fp", "n", totals["rows"]).select(id_col, "fp", "root", "component_id"), [rows, classes]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    fingerprint: 16 hex digits. component_id: the smallest id that links of at most MOST_BITS differing bits reach; equal
    fingerprints are linked. Rows with a null id get the smallest id of their group, null if none of it has one; repeated rows stay repeated; an
    empty table gives an empty result; other columns are ignored.
    """
    return _grouped(docs, id_col, text_col)[0].select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each near-duplicate group: the row with the group's smallest id.

    A row without an id stays only for a group without any id. Of several rows with that id in the group, that with the smallest fingerprint, then
    the smallest values in column order, stays. An empty table gives an empty result.
    """
    grouped, read = _grouped(docs, id_col, text_col)
    grouped = keep(grouped, "groups")
    for table in read:
        discard(table)
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "fp"))
    chosen = keep(grouped.groupBy("root").agg(best.alias("best")).select(F.col("best.id").alias("chosen_id"), F.col("best.fp").alias("chosen_fp")), "chosen")
    odd = keep(grouped.groupBy(F.col(id_col).alias("odd_id")).count().where("count > 1 or odd_id is null").select("odd_id"), "odd")
    ids = chosen.where("chosen_id is not null").select(F.col("chosen_id").alias(id_col)).distinct()
    if odd.isEmpty():
        return docs.join(ids, id_col, "left_semi").select(*docs.columns)
    single = docs.join(ids.join(odd.withColumnRenamed("odd_id", id_col), id_col, "left_anti"), id_col, "left_semi").select(*docs.columns)
    several = docs.join(odd, docs[id_col].eqNullSafe(odd["odd_id"]), "left_semi").select(*[F.col(c).alias(f"__{n}") for n, c in enumerate(docs.columns)])
    own = [f"__{n}" for n in range(len(docs.columns))]
    id_at, text_at = (f"__{docs.columns.index(c)}" for c in (id_col, text_col))
    marked = fingerprints(several, id_at, text_at, tuple(c for c in own if c != id_at))
    among = marked.join(chosen, marked[id_at].eqNullSafe(chosen["chosen_id"]) & (marked["fp"] == chosen["chosen_fp"]), "left_semi")
    first = among.groupBy(id_at, "fp").agg(F.min(F.struct(*own)).alias("row"))
    return single.unionByName(first.select(*[F.col(f"row.__{n}").alias(c) for n, c in enumerate(docs.columns)]))
