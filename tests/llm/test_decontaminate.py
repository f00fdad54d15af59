import random
import re

from pyspark.sql import functions as F

from codequarry.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item) if item is not None else "null")
    return len(own), len(hit), sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["a", "b", "c", "É", "1x"]
    items = [(n, " ".join(rng.choices(pool, k=rng.choice([1, 2, 5, 13, 14, 30])))) for n in range(40)] + [(90, ""), (91, None), (92, "--"), (None, "null item words")]
    texts = []
    for _ in range(150):
        t = rng.choices(pool + ["zz", "yy"], k=rng.randrange(40))
        if rng.random() < 0.6:
            t[rng.randrange(len(t) + 1) : 0] = words(rng.choice(items)[1])
        texts.append(rng.choice([" ", "-", ". "]).join(t))
    texts += ["", None, "NULL Item, words", "x" * 10000, "null item words " * 2000]
    rows = [(n, t, 7) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_hit int")
    bench = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    for shard in (1 << 20, 3000):
        out = decontaminate.find_items(docs, bench, shard_bytes=shard)
        found = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in out.collect()}
        assert found == {i: brute(t, items) for i, t, _ in rows}
    marked = out.select("n_words", "n_hit", decontaminate.contaminated().alias("c")).collect()
    assert all(r["c"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in marked)
    assert decontaminate.find_items(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.find_items(docs.where("false"), bench).count() == 0
    assert out.select(F.sum("n_words")).first()[0] == sum(len(words(t)) for t in texts)


def test_one_item_with_many_rows_is_dealt_to_several_shards(spark):
    rows = [(1, " ".join(f"w{n}x{i}" for i in range(20))) for n in range(50)]
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(n, t, "x") for n, (_, t) in enumerate(rows)] + [(None, rows[0][1], "x")], "doc_id bigint, text string, items string")
    out = decontaminate.find_items(docs, bench, shard_bytes=20_000)
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in out.collect()] == [(20, 20, ["1"])] * 51
