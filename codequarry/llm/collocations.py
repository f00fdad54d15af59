"""Phrases whose words stand together more often than their parts would.

A shard of texts becomes a generalised suffix automaton over its pieces, bounded at a number of words. Its states are the classes of substrings with the same ends (endpos); they are
found by sorting the ends by what stands before them, word by word: the trie of these reversed contexts is the tree of suffix links, and a chain of nodes with equal counts is
one state. Each state gives its substrings with the count of its ends.

Shard counts are added up by phrase. Phrases of one and two words are counted first; of longer ones only those are sent whose suffix link and prefix, one word
shorter, may have reached the least count themselves, as a bitmap of fixed size tells: with false hits only, so no candidate is lost. The same links give subsumption: of a phrase's longer
candidates those with one word more decide, since a still longer one holds one of them that is at least as frequent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.tables import utf8
from codequarry.storage import keep

#: bytes of text in a shard's automaton
SHARD_BYTES = 8 << 20
#: bits of the bitmap of frequent phrases
LOG_BITS = 26
SHIFT = 11
#: groups in which a language's best phrases are found before they meet
GROUPS = 256

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of texts with A-Z in lower case; "." stands between pieces and between texts."""
    # of white space only spaces and tabs are left when pieces are cut
    return b".".join(texts).translate(_FOLD).replace(b".", b" . ").split()


class Automaton:
    """Suffix automaton of the pieces of a shard, for substrings of at most depth words.

    Nodes of depth k are numbered from 0: `count[k]` has the ends of each, `link[k]` its suffix of k - 1 words, `prefix[k]` its first k - 1 words and `end[k]` one of its ends.
    A state is a chain of links with equal counts. hopeful: given the automaton, says of each node of one word less than depth whether the substrings of depth words that begin or end
    with it are wanted; the others get no nodes.
    """

    def __init__(self, texts: list[bytes], depth: int, hopeful=None):
        known: dict[bytes, int] = defaultdict(count(1).__next__)
        known[b"."] = 0
        words = words_of(texts)
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        # the words are many small objects: they go before anything is sorted
        del words
        self.words = pa.array(known, pa.binary())
        base = len(known)
        del known
        self.ids, self.depth = ids, depth
        n = len(ids)
        self.count, self.link, self.prefix, self.end = {}, {}, {}, {}
        #: node of the k words that end at a position, -1 where a piece has fewer before it
        at = np.full(n, -1, np.int64)
        ends = np.flatnonzero(ids)
        self.total = len(ends)
        for k in range(1, depth + 1):
            if k > 1:
                ends = ends[(ends >= k - 1)]
                ends = ends[(at[ends] >= 0) & (at[ends - 1] >= 0)]
                if hopeful and k == depth:
                    wanted = hopeful(self)
                    ends = ends[wanted[at[ends]] & wanted[at[ends - 1]]]
            key = ids[ends - k + 1] if k == 1 else at[ends] * base + ids[ends - k + 1]
            nodes, first, which, self.count[k] = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            self.end[k] = ends[first]
            self.link[k] = at[self.end[k]]
            self.prefix[k] = at[self.end[k] - 1] if k > 1 else self.link[k]
            at = np.full(n, -1, np.int64)
            at[ends] = which

    def states(self) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(nodes, longest, shortest, count) of the states whose longest substrings are these nodes of depth longest."""
        for k in range(self.depth, 0, -1):
            alone = np.ones(len(self.count[k]), bool)
            if k < self.depth:
                # the link of a node with as many ends belongs to that node's state
                same = self.count[k + 1] == self.count[k][self.link[k + 1]]
                alone[self.link[k + 1][same]] = False
            nodes = np.flatnonzero(alone)
            shortest, node, depth = np.full(len(nodes), k), nodes, k
            open_ = np.arange(len(nodes))
            while depth > 1 and len(open_):
                up = self.link[depth][node]
                same = self.count[depth - 1][up] == self.count[depth][node]
                open_, node, depth = open_[same], up[same], depth - 1
                shortest[open_] = depth
            yield nodes, k, shortest, self.count[k][nodes]

    def phrases(self, k: int, nodes: np.ndarray | None = None) -> pa.Array:
        """The substrings of nodes of depth k, words joined by spaces."""
        end = self.end[k] if nodes is None else self.end[k][nodes]
        parts = [self.words.take(pa.array(self.ids[end - d])) for d in range(k - 1, -1, -1)]
        return pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]

    def substrings(self, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, nodes, counts) of the substrings of least to most words, state by state: each has its state's count."""
        for nodes, longest, shortest, counts in self.states():
            k = longest
            while k >= least and len(nodes):
                if k <= most:
                    yield k, nodes, counts
                # one word shorter within the state: along the link
                inside = shortest < k
                if k > 1:
                    nodes, counts, shortest = self.link[k][nodes[inside]], counts[inside], shortest[inside]
                k -= 1


def _places(automaton: Automaton, k: int, lang: bytes) -> np.ndarray:
    """The bit of each node of depth k, as _place() gives it."""
    words = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in automaton.words.to_pylist()), np.uint64, len(automaton.words))
    out = np.full(len(automaton.count[k]), xxhash.xxh64_intdigest(lang, 42), np.uint64)
    for n in range(k):
        out ^= words[automaton.ids[automaton.end[k] - (k - 1 - n)]] >> np.uint64(SHIFT * n)
    return (out & np.uint64((1 << LOG_BITS) - 1)).astype(np.int64)


def _place() -> Column:
    """The bit of a phrase: the XXH64 of its language and words, each word's shifted by its place."""
    return F.expr(f"(xxhash64(lang) ^ aggregate(transform(split(phrase, ' '), (w, i) -> shiftrightunsigned(xxhash64(w), {SHIFT} * i)), 0L, (a, x) -> a ^ x)) & {(1 << LOG_BITS) - 1}L")


def _shard_rows(by_lang: dict[bytes, list[bytes]], least: int, most: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, a) of a shard; with least 1 also the number of words, as size 0."""
    for lang, texts in by_lang.items():

        def hopeful(automaton: Automaton) -> np.ndarray:
            places = _places(automaton, most - 1, lang)
            return (bits[places >> 3] >> (places & 7)) & 1 == 1

        automaton = Automaton(texts, most, hopeful if bits is not None else None)
        texts.clear()
        if least == 1 and automaton.total:
            yield _batch(lang, pa.array([b""], pa.binary()), 0, np.array([automaton.total]))
        for k, nodes, counts in automaton.substrings(least, most):
            for start in range(0, len(nodes), 1 << 15):
                some = slice(start, start + (1 << 15))
                yield _batch(lang, automaton.phrases(k, nodes[some]), k, counts[some])


def _batch(lang: bytes, phrases: pa.Array, size: int, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.record_batch([pa.repeat(pa.scalar(lang.decode()), n), phrases.cast(pa.string()), pa.array(np.full(n, size, np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "size", "a"])


def shard_counts(docs: DataFrame, text_col: str, lang_col: str, least: int, most: int, bits=None) -> DataFrame:
    """(lang, phrase, size, a) for each shard; bits: broadcast bitmap of the phrases of most - 1 words that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hopeful = None if bits is None else np.frombuffer(bits.value, np.uint8)
        by_lang: dict[bytes, list[bytes]] = defaultdict(list)
        held = 0
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for lang, text in zip(utf8(batch.column(0)), utf8(batch.column(1))):
                by_lang[lang].append(text)
                held += len(text)
                if held >= SHARD_BYTES:
                    yield from _shard_rows(by_lang, least, most, hopeful)
                    by_lang.clear()
                    held = 0
        yield from _shard_rows(by_lang, least, most, hopeful)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "lang string, phrase string, size int, a bigint")


def _frequent(docs: DataFrame, text_col: str, lang_col: str, least: int, most: int, least_count: int, bits=None) -> DataFrame:
    rows = shard_counts(docs, text_col, lang_col, least, most, bits)
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where((F.col("size") == 0) | (F.col("a") >= least_count))


def _bitmap(phrases: DataFrame) -> bytes:
    """Bitmap of (lang, phrase), 2 ** LOG_BITS bits whatever the number of phrases."""
    at = phrases.select((_place() + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(1 << LOG_BITS - 3)
    for r in rows:
        start = (r["bucket"] - 1) * len(r["bits"])
        out[start : start + len(r["bits"])] = r["bits"]
    return bytes(out)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, least_count: int = 10) -> DataFrame:
    """(lang, phrase, size int, a long): phrases of 1 to most_words words with at least least_count occurrences, and as size 0 the number of all words of each language. A kept table."""
    found = keep(_frequent(docs, text_col, lang_col, 1, min(2, most_words), least_count), "phrases")
    for size in range(3, most_words + 1):
        bits = docs.sparkSession.sparkContext.broadcast(_bitmap(found.where(F.col("size") == size - 1)))
        found = found.unionByName(keep(_frequent(docs, text_col, lang_col, size, size, least_count, bits), "phrases"))
    return found


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, least_count: int = 10, subsumed_percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases of 2 to most_words words by score, a descending, phrase ascending.

    Texts have A-Z in lower case and are cut at `[.,;:!?\\x0A-\\x0D]` into pieces, these at spaces and tabs into words. a counts all occurrences of the phrase within pieces, n all words of the language. Cutting a phrase
    after its first words gives l and r, the counts of its two parts, and the score floor(1000000 * a * a / (l * r)); the lowest-scoring cut counts, of equal ones
    the shortest first part. A phrase goes if a longer candidate that holds it has subsumed_percent of its count or more. Null texts are empty, a null language is `und`; an empty
    table gives an empty result; repeated rows count as often as they stand there; other columns are not read. Texts are taken whole; a row is the least that one shard holds.
    """
    found = frequent_phrases(docs, text_col, lang_col, most_words, least_count)
    counts = found.where("size > 0").select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    longer = (
        found.where("size > 2").select("lang", "a", F.explode(F.array(
            F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)"),
        )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    )
    candidates = found.where("size > 1").join(longer, ["lang", "phrase"], "left")
    candidates = candidates.where(F.col("longest").isNull() | (100 * F.col("longest") < subsumed_percent * F.col("a"))).drop("longest")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    whole = "cast({} as decimal(38, 0))".format
    score = F.expr(f"cast((1000000 * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')}) as bigint)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*").drop("k")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # a language may hold most phrases: first the best of each group of its phrases, then of these
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    best = scored.withColumn("g", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = found.where("size = 0").select("lang", F.col("a").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
