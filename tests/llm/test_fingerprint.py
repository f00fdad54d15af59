import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from codequarry.llm import fingerprint
from codequarry.llm.tables import next_rows


def canon(text):
    n = unicodedata.normalize
    return re.sub(r"\s+", " ", n("NFKC", n("NFKC", text or "").casefold())).strip()


def edit(text, following):
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


TEXTS = ["", None, "a", "A", "  a ", "Straße", "STRASSE", "ｆｕｌｌ Width", "full width", "é", "é", "x" * 5000, "one two\tthree", "One  two\nTHREE", "ab", "ab", "ab", "no-break", "😀😀😀😀", "ﬁne"]


@pytest.mark.parametrize("digits", [32, 1])
def test_against_brute_force(spark, digits):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aAé \n") for _ in range(rng.randrange(6))) for _ in range(300)]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    found = {r["doc_id"]: r for r in fingerprint.edit_fingerprints(docs, digits=digits).collect()}
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    prints, edited_prints = {}, {}
    for k, (i, text, _) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        edited, row = edit(text, other), found[i]
        assert row["n_chars"] == len(text or "")
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == float(canon(text) == canon(edited))
        assert row["near_next"] == float(canon(text) == canon(other))
        prints.setdefault(canon(text), set()).add(row["fingerprint"])
        prints.setdefault(canon(edited), set()).add(row["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "b"), (None, "Q"), (None, None)], "doc_id bigint, text string")
    assert len(fingerprint.edit_fingerprints(docs).collect()) == 4
    assert fingerprint.edit_fingerprints(docs.where("false")).collect() == []
    one = fingerprint.edit_fingerprints(docs.where("text = 'Q'")).first()
    assert (one["near_next"], one["near_edited"]) == (1.0, 1.0)


def test_fingerprint_column(spark):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "doc_id bigint, text string")
    for digits in (32, 1):
        rows = fingerprint.fingerprints(docs, digits=digits).collect()
        for a in rows:
            for b in rows:
                assert (a["fingerprint"] == b["fingerprint"]) == (canon(a["text"]) == canon(b["text"]))


def test_many_rows_of_one_id(spark):
    """Rows of one id, or of none, neither meet as pairs nor lose a bucket's border: each follows another one, in a single ring."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(3000)]
    rows = [(rng.choice([None, None, 7, 7, n]), t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    ring = next_rows(docs.withColumn("key", F.monotonically_increasing_id()), "doc_id", "text", ["doc_id", "text", "key"], rows_per_bucket=50).collect()
    follows = {r["key"]: r["next_key"] for r in ring}
    assert len(ring) == len(follows) == len(set(follows.values())) == len(rows)
    at, seen = ring[0]["key"], set()
    while at not in seen:
        seen.add(at)
        at = follows[at]
    assert len(seen) == len(rows)
    ids = lambda x: (x is None, -(x or 0))
    assert sum(ids(r["doc_id"]) > ids(r["next_doc_id"]) for r in ring) == 1
    for digits in (32, 2):
        found = fingerprint.edit_fingerprints(docs, digits=digits).collect()
        assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in found) == sorted((i or -1, len(t)) for i, t in rows)


def test_forms_do_not_grow_with_the_square_of_an_id(spark):
    sizes = []
    for n in (200, 400):
        docs = spark.createDataFrame([(None, f"same {i // 2}") for i in range(n)], "doc_id bigint, text string")
        given = docs.select(F.col("doc_id").alias("id"), "text").withColumn("key", fingerprint._row_key("id", "text")).withColumn("digest", fingerprint.digest(fingerprint.canonical(F.col("text"))))
        slim = next_rows(given, "id", "text", ["key", "text", "digest"]).withColumn("edited_digest", fingerprint.digest(fingerprint.canonical(fingerprint._edited("text", "next_text"))))
        sizes.append(fingerprint._repeated_forms(given, slim, 32).count())
    assert sizes[1] <= 2 * sizes[0] + 2
