"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's subwords are the runs of 2 to 4 bytes of its lower-cased letters, word borders included. Each is hashed to a row of an
embedding matrix; the mean of the rows goes through a linear layer and a softmax. Since mean and layer are
linear, a trained model is scored from the product of embeddings and layer: one table row per bucket.

Rejection is calibrated on a fifth of the sample, which SGD has not seen: a temperature is fitted on stretches of those texts of many lengths, so that the confidence is
the chance of being right for short and long texts alike, and the least confidence is the one that REJECT_RATE of the whole texts fall below, but never over MOST_DOUBT.
That is so at every size; a sample of under five texts has no such fifth and keeps temperature 1. Texts without a letter are always rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.tables import by_slices

UNKNOWN = "und"
BUCKETS = 1 << 15
WIDTH = 16
ORDERS = (2, 3, 4)
#: distinct texts that a model is fitted on, at most, in equal parts for the languages: the documented bound of the learning sample
MOST_ROWS = 4000
#: characters of each of those texts that reach the driver, from a place that its hash decides, and bytes that a step of SGD looks at (training only; scoring reads whole texts)
MOST_CHARS = 16_384
STEP_BYTES = 1500
#: share of labelled texts that may be rejected for doubt, and the confidence that is always enough
REJECT_RATE = 0.005
MOST_DOUBT = 0.4
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
#: ASCII other than letters becomes a border
_LETTERS = np.array([c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def letters(text: str) -> np.ndarray:
    """The text's bytes: lower case, other ASCII than letters as one border each, a border at both ends."""
    low = text if text.isascii() else text.lower()
    return _LETTERS[np.frombuffer(b" " + low.encode("utf-8", "replace") + b" ", np.uint8)]


def subwords(data: np.ndarray) -> np.ndarray:
    """Buckets of all runs of ORDERS bytes that hold more than borders in their inside."""
    wide = data.astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(wide) < n:
            continue
        mixed = np.full(len(wide) - n + 1, n * 0x01000193, np.uint32)
        for i in range(n):
            mixed = (mixed ^ wide[i : len(wide) - n + 1 + i]) * _MULTIPLIERS[i]
        inner = np.ones(len(mixed), bool)
        for i in range(1, n - 1):
            inner &= data[i : len(data) - n + 1 + i] != 32
        if n == 2:
            inner = (data[:-1] != 32) | (data[1:] != 32)
        out.append((mixed >> np.uint32(17))[inner])
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times layer
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        """None where nothing can be said: null, or no letter."""
        if not text or not any(c.isalpha() for c in text[:64]) and not any(c.isalpha() for c in text):
            return None
        found = subwords(letters(text))
        if not len(found):
            return self.bias.astype(np.float64)
        counts = np.bincount(found, minlength=BUCKETS)
        return counts @ self.table / len(found) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated confidence); UNKNOWN with 0 where nothing can be said."""
        z = self.logits(text)
        if z is None or not self.languages:
            return UNKNOWN, 0.0
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 4, rate: float = 0.5) -> LanguageModel:
    """rows: (text, language). A fifth, at any size, is kept from SGD for calibration; under five texts there is none. Languages are balanced by weighting the steps."""
    rows = [(t, y) for t, y in rows if t and y is not None and any(c.isalpha() for c in t)]
    languages = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((BUCKETS, max(1, len(languages)))), np.zeros(max(1, len(languages))))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    kept = rows[: len(rows) // 5]
    learn = rows[len(kept) :]
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    of = {y: n for n, y in enumerate(languages)}
    share = np.bincount([of[y] for _, y in learn], minlength=len(languages)) / len(learn)
    weight = np.minimum(1 / np.maximum(share * len(languages), 1e-9), 5)
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            text, y = learn[i]
            data = letters(text)
            # texts are seen at many lengths, so that short ones are learnt as well
            size = int(min(len(data), STEP_BYTES, 2 ** rng.uniform(4, 11)))
            at = int(rng.integers(0, len(data) - size + 1))
            found, counts = np.unique(subwords(data[at : at + size]), return_counts=True)
            if not len(found):
                continue
            share_of = counts / counts.sum()
            mean = share_of @ embed[found]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[of[y]] -= 1
            step = rate * (1 - done / steps) * weight[of[y]]
            done += 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= 0.01 * step * p
            embed[found] -= step * len(found) ** 0.5 * share_of[:, None] * back
    model = LanguageModel(languages, embed @ layer, bias)
    if kept:
        calibrate(model, kept, rng)
    return model


def calibrate(model: LanguageModel, kept: list[tuple[str, str]], rng: np.random.Generator) -> None:
    """Set the model's temperature and least confidence from texts that it has not learnt from."""
    of = {y: n for n, y in enumerate(model.languages)}
    whole = [(z, of[y]) for t, y in kept if y in of and (z := model.logits(t)) is not None]
    parts = []
    for text, y in kept:
        for _ in range(4):
            size = int(2 ** rng.uniform(3, 11))
            at = int(rng.integers(0, max(1, len(text) - size + 1)))
            if y in of and (z := model.logits(text[at : at + size])) is not None:
                parts.append((z, of[y]))
    if not whole:
        return
    z, y = np.array([s[0] for s in whole + parts]), np.array([s[1] for s in whole + parts])

    def loss(temperature: float) -> float:
        q = z / temperature
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(q)), y]).mean())

    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    q = z[: len(whole)] / model.temperature
    top = np.exp(q - q.max(axis=1, keepdims=True))
    model.least = float(min(np.quantile(top.max(axis=1) / top.sum(axis=1), REJECT_RATE), MOST_DOUBT))


def quotas(counts: dict[str, int], most: int = MOST_ROWS) -> dict[str, int]:
    """Texts of each language in the sample: an equal share of `most`; what rarer languages leave over goes to the others. At least one for each."""
    out, left = {}, most
    for n, y in enumerate(sorted(counts, key=lambda y: (counts[y], y))):
        out[y] = max(1, min(counts[y], left // (len(counts) - n)))
        left -= out[y]
    return out


def learning_rows(docs: DataFrame, allowed, text_col: str, label_col: str, order: list, most: int = MOST_ROWS) -> list[tuple[str, str]]:
    """Distinct labelled texts, by quotas() for each label, picked by a hash of `order`, so that copies, partitioning and row order do not matter.

    Of a text of over MOST_CHARS characters a stretch of that many is taken, from a place that its hash decides. At most `most`, or one for each label if there are more labels. Distinct texts are counted by a sketch, which only sets how many rows are thinned out before the exact pick.
    """
    labelled = docs.where(allowed & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(label_col).alias("y"), F.xxhash64(*order).alias("k"))
    counts = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.approx_count_distinct("k", 0.02).alias("n")).collect()}
    if not counts:
        return []
    # the sketch may be short of the true number; a language whose texts all fit is not thinned
    room = {y: int(1.1 * n) + 1 for y, n in counts.items()}
    quota = quotas(room, most)
    # a hash threshold for each language thins the rows before copies go; the margin is beyond six deviations of what it lets through
    bound = {y: (1 << 20) * (1.5 * q + 6 * q**0.5 + 40) / counts[y] for y, q in quota.items()}
    thinned = [(y, int(b) + 1) for y, b in bound.items() if b < 1 << 20]
    ends = docs.sparkSession.createDataFrame([(y, quota[y], dict(thinned).get(y, 1 << 20)) for y in quota], "y string, quota int, bound int")
    thin = labelled.join(F.broadcast(ends), "y").where(F.pmod("k", F.lit(1 << 20)) < F.col("bound"))
    distinct = thin.groupBy("y", "k", "quota").agg(F.min("t").alias("t"))
    picked = distinct.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("k", "t"))).where("n <= quota")
    stretch = F.substring(F.col("t"), (F.pmod("k", F.greatest(F.length("t") - F.lit(MOST_CHARS - 1), F.lit(1))) + 1).cast("int"), F.lit(MOST_CHARS))
    return [(r["t"], r["y"]) for r in sorted(picked.select(stretch.alias("t"), "y", "k").collect(), key=lambda r: (r["k"], r["t"], r["y"]))]


def learn(docs: DataFrame, allowed, text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """A model of at most MOST_ROWS distinct texts of docs (see learning_rows), of rows for which `allowed` holds and text and label are not null."""
    return train(learning_rows(docs, allowed, text_col, label_col, [text_col, label_col]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred string, score double (calibrated, 0 to 1) and rejected boolean from each whole text.

    Null, empty and letterless texts: UNKNOWN, 0 and rejected. Rows are independent; columns of docs with clashing names are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("lang_pred", "score", "rejected")
    names = [*out.columns, "lang_pred", "score", "rejected"]
    at = out.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shipped.value
        found = [model.predict(t) for t in batch.column(at).to_pylist()]
        new = [pa.array([y for y, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([y == UNKNOWN or s < model.least for y, s in found], pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), "lang_pred string, score double, rejected boolean"])
    return out.mapInArrow(by_slices(work, text_col), schema)
