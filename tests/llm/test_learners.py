"""Language ID and quality: held-out accuracy on the tables, and defined results for odd rows."""

import zlib

from codequarry.llm import catalog, langid, quality
from codequarry.llm.tables import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_split(spark):
    ids = spark.createDataFrame([(i,) for i in [0, 1, 17, 10**12, None]], "doc_id bigint")
    found = {r["doc_id"]: r["h"] for r in ids.select("doc_id", held_out().alias("h")).collect()}
    assert found == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in found}


def test_language_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in catalog.op6_language_id(spark, SF).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert len(rows) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_language(model, text):
    """Mean over the text's subwords of their table rows, one subword at a time, then the softmax."""
    import math

    data = " " + "".join(c if c.isalpha() and c.isascii() or ord(c) >= 128 else " " for c in (text or "").lower()) + " "
    raw = data.encode()
    total, n = [0.0] * len(model.languages), 0
    for size in (2, 3, 4):
        for at in range(len(raw) - size + 1):
            run = raw[at : at + size]
            if 32 in run[1:-1] or run.strip() == b"" and size == 2:
                continue
            mixed = size * 0x01000193
            for byte, by in zip(run, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)):
                mixed = (mixed ^ byte) * by % 2**32
            total = [a + float(b) for a, b in zip(total, model.table[mixed >> 17])]
            n += 1
    z = [(a / n + float(b)) / model.temperature for a, b in zip(total, model.bias)]
    p = [math.exp(v - max(z)) for v in z]
    return model.languages[z.index(max(z))], max(p) / sum(p)


def test_language_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.learn(docs, ~held_out())
    rows = catalog.op6_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows[:150]:
        if any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            lang, score = brute_language(model, texts[r["doc_id"]])
            assert (r["lang_pred"], r["rejected"]) == (lang, r["score"] < model.least) and abs(r["score"] - score) < 1e-9
        else:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)


def test_confidence_is_the_chance_of_being_right(spark):
    """On texts that the model has not learnt from, cut to a few words and whole."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.learn(docs, ~held_out())
    assert 0 < model.least <= langid.MOST_DOUBT
    rows = docs.where(held_out() & docs["lang"].isNotNull() & docs["text"].isNotNull()).collect()
    found = [(model.predict(t), r["lang"]) for r in rows for t in (r["text"][:12], r["text"][:40], r["text"])]
    found = [(p, c) for p, c in found if p[0] != "und"]
    assert len(found) > 3000
    wrong = sum(abs(sum(p[1] - (p[0] == y) for p, y in part)) for lo in range(0, 10) if (part := [f for f in found if lo / 10 <= f[0][1] < (lo + 1) / 10 + (lo == 9)]))
    assert wrong / len(found) < 0.05
    whole = [p[1] for p, _ in found[2::3]]
    assert sum(s < model.least for s in whole) <= 0.02 * len(whole)


def test_small_samples_are_calibrated_as_well(spark):
    model = langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)
    assert model.temperature != 1.0 and 0 < model.least <= langid.MOST_DOUBT
    tiny = langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")])
    assert (tiny.temperature, tiny.least) == (1.0, 0.0)
    # at the smallest scale a clean text stays and the languages of texts not learnt from are found
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs, ~held_out())
    unseen = langid.identify(docs.where(held_out() & docs["lang"].isNotNull() & docs["text"].isNotNull()), model).collect()
    assert model.temperature != 1.0 and sum(r["rejected"] for r in unseen) <= 0.05 * len(unseen)
    assert sum(r["lang_pred"] == r["lang"] for r in unseen) >= 0.9 * len(unseen)


def test_long_texts_teach_with_a_stretch(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("a" * 50_000, "x"), ("b", "y"), ("b", "y"), (None, "y")], "t string, y string")
    rows = langid.learning_rows(docs, F.lit(True), "t", "y", ["t", "y"])
    assert sorted((len(t), y) for t, y in rows) == [(1, "y"), (langid.MOST_CHARS, "x")]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", "old", 5.0, True, 9)], "doc_id bigint, text string, lang_pred string, score double, rejected boolean, predicted int")
    spoken = langid.identify(docs, langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)).first()
    assert spoken["lang_pred"] == "en" and 0 <= spoken["score"] <= 1 and not spoken["rejected"] and spoken["predicted"] == 9
    judged = quality.classify(docs, quality.learn(docs.where("false"), docs.selectExpr("doc_id", "predicted quality").where("false"), ~held_out())).first()
    assert (judged["score"], judged["predicted"], judged["lang_pred"]) == (0.5, 1, "old")


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs, ~held_out())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !"), (4, "the " * 100_000), (4, "the " * 100_000), (5, "你好")], "doc_id bigint, text string")
    rows = langid.identify(odd.withColumnRenamed("doc_id", "score").withColumnRenamed("score", "id"), model).collect()
    found = {r["id"]: (r["lang_pred"], r["rejected"]) for r in rows}
    assert len(rows) == 6 and [found[i] for i in (1, 2, 3)] == [("und", True)] * 3
    assert found[4][0] == "en" and not found[4][1]
    assert langid.identify(odd.where("false"), model).collect() == []
    nobody = langid.learn(docs.where("false"), ~held_out())
    assert {r["lang_pred"] for r in langid.identify(odd, nobody).collect()} == {"und"}


def test_copies_do_not_fill_the_learning_sample(spark):
    import pyspark.sql.functions as F

    once = spark.range(3000).selectExpr("concat('text ', id) t", "if(id % 3 = 0, 'de', 'en') y")
    copies = spark.range(20_000).selectExpr("concat('copy ', id % 2) t", "'en' y")
    rare = spark.createDataFrame([("selten", "xx")], "t string, y string")
    rows = langid.learning_rows(once.union(copies).union(rare).repartition(5), F.lit(True), "t", "y", ["t", "y"], most=400)
    assert len(set(rows)) == len(rows) and 380 <= len(rows) <= 400
    held = {y: sum(r[1] == y for r in rows) for y in ("de", "en", "xx")}
    assert held["xx"] == 1 and min(held["de"], held["en"]) >= 180
    assert rows == langid.learning_rows(rare.union(copies).union(once), F.lit(True), "t", "y", ["t", "y"], most=400)


def test_quotas_of_languages():
    assert langid.quotas({"a": 10, "b": 5000, "c": 5000}, 1010) == {"a": 10, "b": 500, "c": 500}
    assert langid.quotas({"a": 9, "b": 9}, 1) == {"a": 1, "b": 1}


def test_quality_accuracy(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in catalog.op1_quality(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_query_against_brute_force(spark):
    """Scores are sums of the tables' entries, looked up one feature and one pair at a time."""
    import bisect
    import math

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, ~held_out())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = catalog.op1_quality(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows[:200]:
        x = quality.measure(None if texts[r["doc_id"]] is None else texts[r["doc_id"]].encode())
        bins = [bisect.bisect_right(list(e), v) for e, v in zip(model.edges, x)]
        total = model.intercept + sum(float(t[b]) for t, b in zip(model.tables, bins))
        for (f, g), table in zip(model.pairs, model.pair_tables):
            total += float(table[bins[f] * 8 // (len(model.edges[f]) + 1)][bins[g] * 8 // (len(model.edges[g]) + 1)])
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)
    assert 0 < len(model.pairs) and any(abs(t).max() > 0 for t in model.pair_tables)


def test_repeated_documents_teach_once(spark):
    docs = spark.createDataFrame([(1, "good words here.")] * 50 + [(2, "bad @@@ ###")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    assert abs(quality.learn(docs, labels, F.lit(True), most=2).intercept) < 1e-9


def test_quality_of_odd_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels.unionByName(labels), ~held_out())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a" * 500_000), (4, "a" * 500_000)], "doc_id bigint, text string")
    rows = quality.classify(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] <= 3}) == 1
    assert quality.classify(odd.where("false"), model).collect() == []
    nobody = quality.learn(docs, labels.where("false"), ~held_out())
    assert {r["score"] for r in quality.classify(odd, nobody).collect()} == {0.5}


def test_additive_model_finds_a_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000], rounds=20, pair_rounds=60, most_pairs=3)
    assert (0, 2) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
