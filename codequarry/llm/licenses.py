"""Licence scans: MinHash bands over overlapping windows of text retrieve templates, exact shingle containment verifies.

A template of n shingles is looked for in windows that start every s shingles, s at most n / 4, and span enough of them for some window to
hold any run of n shingles. If that run holds LEAST of the template's shingles, the window's Jaccard similarity with the template is at least
J = LEAST * n / (window + (1 - LEAST) * n). The number of bands of two MinHash values is the smallest for which a window of similarity J shares a band
with the template with a probability of RECALL. Templates of up to four shingles must occur whole (0.8 of them is all of them), are looked for in windows of n
shingles at every position, and share their band with certainty. A retrieved pair counts if the window really holds LEAST of
the template's distinct shingles, compared as strings of words.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.decontaminate import fold_words, words
from codequarry.llm.license_texts import TEMPLATES
from codequarry.llm.tables import by_slices

SHINGLE_WORDS = 5
LEAST = 0.8
RECALL = 0.999
_NONE = np.uint32(0xFFFFFFFF)


def bands_needed(jaccard: float, recall: float = RECALL) -> int:
    """Bands of two values with which sets of the given similarity collide with probability recall."""
    return 1 if jaccard >= 1 else ceil(log(1 - recall) / log(1 - jaccard**2))


@dataclass(frozen=True)
class Plan:
    """How templates of one size are looked for: words of a shingle, shingles between window starts, blocks of a window, bands."""

    width: int
    stride: int
    blocks: int
    bands: int


def plan(n_words: int, shingle_words: int = SHINGLE_WORDS) -> Plan:
    width = min(shingle_words, n_words)
    n = n_words - width + 1
    if n <= 4:
        return Plan(width, 1, n, 1)
    stride = 1 << ((n // 4).bit_length() - 1)
    blocks = ceil(n / stride) + 1
    return Plan(width, stride, blocks, bands_needed(LEAST * n / (blocks * stride + (1 - LEAST) * n)))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words."""
    n = max(0, len(word_hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ word_hashes[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _minhash(shingles: np.ndarray, function: int) -> np.ndarray:
    """A linear function modulo 2 ** 32 of both halves of the hash; the multipliers are drawn from the function's number."""
    a, b = np.random.default_rng(function).integers(1 << 31, size=2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    halves = shingles.view(np.uint32)
    return halves[0::2] * a + halves[1::2] * b


class Scanner:
    """Templates by plan: their shingles and the two values of each band of their signatures."""

    def __init__(self, templates: dict[str, list[str]], shingle_words: int = SHINGLE_WORDS):
        self.groups: dict[Plan, list[tuple[str, set[bytes]]]] = defaultdict(list)
        self.signatures: dict[Plan, np.ndarray] = {}
        for name in sorted(templates):
            for text in templates[name]:
                own = words(text.encode())
                if own:
                    p = plan(len(own), shingle_words)
                    self.groups[p].append((name, {b" ".join(own[i : i + p.width]) for i in range(len(own) - p.width + 1)}))
        for p, members in self.groups.items():
            signatures = np.zeros((len(members), p.bands, 2), np.uint32)
            for at, (_, shingles) in enumerate(members):
                hashes = np.concatenate([shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in s.split(b" ")], np.uint64), p.width) for s in sorted(shingles)])
                for band in range(p.bands):
                    signatures[at, band] = [_minhash(hashes, 2 * band + i).min() for i in (0, 1)]
            self.signatures[p] = signatures

    def candidates(self, width: int, shingles: np.ndarray, text: np.ndarray) -> dict[Plan, set[tuple[int, int]]]:
        """For each plan of the width, (first shingle of a window, template) of the pairs that share a band; text is the number of each shingle's text.

        A band's first value is computed for all windows, its second for those that agree in the first.
        """
        plans = [p for p in self.groups if p.width == width]
        found: dict[Plan, set[tuple[int, int]]] = {p: set() for p in plans}
        if not len(shingles):
            return found
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        sizes = np.diff(np.append(starts, len(text)))
        levels = {}
        for stride in sorted({1} | {p.stride for p in plans}):
            counts, pad = -(-sizes // stride), max([p.blocks for p in plans if p.stride == stride], default=1)
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            # the blocks of each text, then blocks that hold nothing, so that no window reaches into the next text
            levels[stride] = (np.repeat(starts, counts) + nth * stride, np.arange(counts.sum()) + np.repeat(np.arange(len(counts)) * pad, counts), int(counts.sum()) + pad * len(counts), counts)
        for band in range(max(p.bands for p in plans)):
            at_work = [p for p in plans if band < p.bands]
            values, before = _minhash(shingles, 2 * band), 1
            for stride, (block_start, place, room, _) in levels.items():
                if stride > 1:
                    # minima of the finer blocks that each of these blocks consists of
                    fine = levels[before][3]
                    offset = np.repeat(np.cumsum(fine) - fine, levels[stride][3])
                    first = (block_start - np.repeat(starts, levels[stride][3])) // before
                    values, before = np.minimum.reduceat(values, offset + first), stride
                own = sorted((p for p in at_work if p.stride == stride), key=lambda p: p.blocks)
                if not own:
                    continue
                held, reach = np.full(room, _NONE), 1
                held[place] = values
                for p in own:
                    while 2 * reach <= p.blocks:
                        held[:-reach] = np.minimum(held[:-reach], held[reach:])
                        reach *= 2
                    rest = p.blocks - reach
                    windows = np.minimum(held[: room - rest], held[rest:]) if rest else held
                    for template, (one, two) in enumerate(self.signatures[p][:, band]):
                        for slot in np.flatnonzero(windows == one).tolist():
                            block = int(np.searchsorted(place, slot))
                            if block == len(place) or place[block] != slot:
                                continue
                            at = int(block_start[block])
                            span = shingles[at : at + p.stride * p.blocks][text[at : at + p.stride * p.blocks] == text[at]]
                            if _minhash(span, 2 * band + 1).min() == two:
                                found[p].add((at, template))
        return found

    def matches(self, texts: pa.Array) -> list[set[tuple[int, float, int, int, str]]]:
        """For each text, (template's shingles held, containment, first word, words, licence) of every window and template that agree."""
        coded, counts = fold_words(texts)
        vocabulary = coded.dictionary.to_pylist()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)[which] if len(which) else np.empty(0, np.uint64)
        text_of = np.repeat(np.arange(len(counts)), counts)
        starts = np.cumsum(counts) - counts
        out: list[set[tuple[int, float, int, int, str]]] = [set() for _ in range(len(counts))]
        for width in {p.width for p in self.groups}:
            n = max(0, len(which) - width + 1)
            inside = text_of[:n] == text_of[width - 1 :]  # shingles of one text
            place = np.flatnonzero(inside)
            shingles = shingle_hashes(hashes, width)[inside]
            of = text_of[place]
            for p, pairs in self.candidates(width, shingles, of).items():
                for at, template in sorted(pairs):
                    name, wanted = self.groups[p][template]
                    span = place[at : at + p.stride * p.blocks]
                    span = span[text_of[span] == of[at]]
                    held = [b" ".join([vocabulary[i] for i in which[k : k + width]]) for k in span.tolist()]
                    there = [k for k, s in zip(span.tolist(), held) if s in wanted]
                    shared = len(wanted & set(held))
                    if shared / len(wanted) >= LEAST:
                        row = int(of[at])
                        out[row].add((shared, shared / len(wanted), there[0] - int(starts[row]), there[-1] + width - there[0], name))
        return out

    def scan(self, texts: pa.Array) -> list[dict[str, tuple[float, int, int]]]:
        """For each text, licence -> (containment, first word, words) of its best window, the first of equals."""
        return [best(found) for found in self.matches(texts)]


def best(found) -> dict[str, tuple[float, int, int]]:
    """licence -> (containment, first word, words) of its match of highest containment, the first of equals."""
    out: dict[str, tuple[float, int, int]] = {}
    for _, share, first, size, name in found:
        old = out.get(name)
        if old is None or (-share, first, size) < (-old[0], old[1], old[2]):
            out[name] = (share, first, size)
    return out


def settled(found) -> list[tuple[int, float, int, int, str]]:
    """The matches that stand where those of several licences overlap: the one with most of its template's shingles in the text, of equals the one of higher containment.

    A match gives way if one of another licence that stands covers half of its words or more.
    """
    stand: list[tuple[int, float, int, int, str]] = []
    for m in sorted(found, key=lambda m: (-m[0], -m[1], *m[2:])):
        _, _, first, size, name = m
        if not any(other != name and 2 * (min(first + size, at + n) - max(first, at)) >= size for _, _, at, n, other in stand):
            stand.append(m)
    return stand


def find_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, containment double, first_word bigint, n_words bigint): a row for each licence that a text holds; of variants that claim the same words only the closest, see settled().

    containment: the share of the distinct shingles of one of the licence's templates in the best window, LEAST or more; the span runs from the first to the last of
    them there, counted in words. Words are as in decontamination. Null and empty texts hold none; templates without words are ignored; rows are independent, so
    repeated rows give repeated results and an empty table an empty one; other columns are ignored. The templates are shipped with the task: a list that someone wrote.
    """
    texts = TEMPLATES if templates is None else templates
    cache: list[Scanner] = []
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "license", "containment", "first_word", "n_words"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(Scanner(texts))
        found = [best(settled(m)) for m in cache[0].matches(batch.column(1))]
        rows = [(n, name, *found[n][name]) for n in range(len(found)) for name in sorted(found[n])]
        at, license_, share, first, size = zip(*rows) if rows else [()] * 5
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(license_, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(size, pa.int64())], names=names
        )

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(
        by_slices(work, "__text", 4 << 20), f"`{id_col}` {kind}, license string, containment double, first_word bigint, n_words bigint"
    )
