"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Cyclic boosting visits one feature after the other and fits a
shallow tree to the gradients of the log-loss, by histograms over the feature's bins; the tree's leaves are added, shrunk, to the feature's
lookup table. Then pairs of features are ranked by how much of the remaining gradient a split of both explains, and the best are
boosted the same way into two-way tables. A score is the sigmoid of the sum of the table entries of a text's
bins: pure vectorised additions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tables import by_slices, utf8

FEATURES = (
    "log_bytes", "log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "stop_share", "bar_share", "bang_share",
    "distinct_share", "same_as_last", "top_word_share", "short_share", "non_ascii_share", "lines_per_word", "repeated_lines", "odd_word_ends", "capital_words",
)
BINS = 32
PAIR_BINS = 8
#: labelled rows that a model is fitted on, at most: the documented bound of the learning sample
MOST_ROWS = 20_000
THRESHOLD = 0.3
_KIND = np.full(256, 5)  # 0 lower, 1 upper, 2 digit, 3 white space, 4 ordinary punctuation, 5 symbol, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 6
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:'\"-?!()"]] = 4


def measure(text: bytes | None) -> list[float]:
    """The features of a text; all 0 for null, empty and blank ones."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(text), len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, minlength=7)
    solid = size - kinds[3]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    ends = b"".join([w[-1:] for w in words])
    end_kinds = np.bincount(_KIND[np.frombuffer(ends, np.uint8)], minlength=7)
    heads = np.bincount(_KIND[np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)], minlength=7)
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(sizes.mean()), kinds[5] / solid, kinds[1] / max(1, kinds[0] + kinds[1]), kinds[2] / solid, counts[46] / n, counts[124] / n, counts[33] / n,
        len(tally) / n ** 0.8, same / n, max(tally.values()) / n, float((sizes <= 3).mean()), kinds[6] / solid, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), end_kinds[5] / n, heads[1] / n,
    ]


@dataclass
class Additive:
    """Sum of lookup tables over binned features."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def coarse(self, bins: np.ndarray, f: int) -> np.ndarray:
        return bins[:, f] * PAIR_BINS // (len(self.edges[f]) + 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            total += table[self.coarse(bins, f), self.coarse(bins, g)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins left of the cut) of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin: cuts of greatest gain, to the given depth."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_shallow_tree(g[:at], h[:at], depth - 1), _shallow_tree(g[at:], h[at:], depth - 1)])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, most_pairs: int = 8, rate: float = 0.1) -> Additive:
    """Fit to rows x and 0/1 labels y. With one class only (or no rows) the model is its smoothed share."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], quantiles)) if len(x) else np.empty(0) for f in range(x.shape[1])]
    model = Additive(edges)
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(bins[:, f], g, len(table)), np.bincount(bins[:, f], h, len(table)))
            table += step
            margin += step[bins[:, f]]
    g, h = slopes()
    coarse = [model.coarse(bins, f) for f in range(x.shape[1])]

    def explained(f: int, k: int) -> float:
        cell = coarse[f] * PAIR_BINS + coarse[k]
        return float((np.bincount(cell, g, PAIR_BINS**2) ** 2 / (np.bincount(cell, h, PAIR_BINS**2) + 1)).sum())

    model.pairs = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -explained(*p))[:most_pairs]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (f, k), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            cell = coarse[f] * PAIR_BINS + coarse[k]
            cell_g, cell_h = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
            # a cut of one feature, then one of the other on either side
            _, at = _best_cut(cell_g.sum(axis=1), cell_h.sum(axis=1))
            step = np.zeros_like(table)
            for side in (slice(0, at), slice(at, PAIR_BINS)):
                step[side] = _shallow_tree(cell_g[side].sum(axis=0), cell_h[side].sum(axis=0), 1)[None, :] if at else 0
            table += rate * step
            margin += rate * step.ravel()[cell]
    return model


def features(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.array([measure(t) for t in utf8(batch.column(len(keep)))], np.float64).ravel()
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*keep, "features"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "features array<double>"])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(by_slices(work, "__text"), schema)


def learn(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", most: int = MOST_ROWS) -> Additive:
    """Fit on at most `most` labelled rows for which allowed holds, picked by a hash of the id.

    Rows with a null id, label or text teach nothing; of repeated labels of an id the smallest counts. Documents that share an id share its label; repeated ones count once, and
    of over 2 * most that remain a hash of id and features picks. Only ids, labels and feature vectors of that sample reach
    the driver; its ids are broadcast, a size that `most` bounds.
    """
    key = F.xxhash64(id_col)
    usable = labels.where(allowed & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__label"))
    sample = docs.sparkSession.createDataFrame(usable.orderBy(key, id_col).limit(most).collect(), usable.schema)
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col)
    found = features(rows, (id_col, "__label"), "__text").distinct().orderBy(F.xxhash64(id_col, "features"), id_col, "features").limit(2 * most).collect()
    x = np.array([r["features"] for r in found], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r["__label"]) for r in found]))


def classify(docs: DataFrame, model: Additive, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score double (0 to 1, higher is better) and predicted int (1 if score >= threshold) of each whole text.

    Null, empty and blank texts are scored as texts whose features are all 0. Rows are independent; clashing columns of docs are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("score", "predicted")
    at, names = out.columns.index(text_col), [*out.columns, "score", "predicted"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([measure(t) for t in utf8(batch.column(at))], np.float64).reshape(-1, len(FEATURES))
        score = shipped.value.score(x)
        new = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), "score double, predicted int"])
    return out.mapInArrow(by_slices(work, text_col), schema)
