"""Phrases against counts by plain loops, and the shard's automaton against all substrings."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from codequarry.llm import catalog, collocations as co

SF = "/root/testdata/sf0.001"
FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute(rows, most, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, most + 1):
                f[lang].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {q[i : i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 50 * counts[q[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in dropped:
                s, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(rng, n):
    words = ["the", "The", "of", "new", "york", "york", "é", "ÉT", "a\x01", "x-y", "日本", "in", "time"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "? ", "\r\n"]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(co, "SHARD_BYTES", 3000)
    rng = random.Random(3)
    rows = [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts(rng, 400)] + [(None, "en"), ("", None), ("...", "xx"), ("word " * 60_000, "long")]
    docs = spark.createDataFrame([(t, g, "clash", 1) for t, g in rows], "text string, lang string, phrase string, a int")
    for most, top in ((3, 2000), (2, 5), (4, 2000)):
        found = co.collocations(docs, most_words=most, least_count=4, top=top).select(*FIELDS)
        assert sorted(map(tuple, found.collect())) == brute(rows, most, 4, top)
        assert dict(found.dtypes) == dict.fromkeys(FIELDS, "bigint") | {"lang": "string", "phrase": "string"}
    assert co.collocations(docs.where("false")).count() == 0


def test_automaton_has_all_substrings_and_their_ends():
    rng = random.Random(4)
    for depth in (1, 2, 3, 5):
        shard = [t.encode() for t in texts(rng, 20)]
        auto = co.Automaton(shard, depth)
        want, ends = Counter(), defaultdict(set)
        at = 0
        for t in shard:
            for p in pieces(t.decode()):
                for k in range(1, depth + 1):
                    for i in range(len(p) - k + 1):
                        want[" ".join(p[i : i + k])] += 1
                        ends[" ".join(p[i : i + k])].add(at + i + k)
                at += len(p) + 1
        got = Counter()
        for k, nodes, counts in auto.substrings(1, depth):
            for phrase, a in zip(auto.phrases(k, nodes).to_pylist(), counts.tolist()):
                assert phrase.decode() not in got
                got[phrase.decode()] = a
        assert got == want
        # states are the classes of equal ends among bounded substrings, links lead to the class of the longest shorter suffix
        classes = {frozenset(e) for e in ends.values()}
        assert sum(len(n) for n, *_ in auto.states()) == len(classes)
        for k in range(2, depth + 1):
            for phrase, link, prefix in zip(auto.phrases(k).to_pylist(), auto.phrases(k - 1, auto.link[k]).to_pylist(), auto.phrases(k - 1, auto.prefix[k]).to_pylist()):
                assert phrase.split(b" ")[1:] == link.split(b" ") and phrase.split(b" ")[:-1] == prefix.split(b" ")


def test_bits_of_phrases_are_the_same_on_both_sides(spark):
    auto = co.Automaton(["New york in time. the X-y é".encode()], 3)
    for k in (1, 2, 3):
        phrases = [p.decode() for p in auto.phrases(k).to_pylist()]
        rows = spark.createDataFrame([("en", p, n) for n, p in enumerate(phrases)], "lang string, phrase string, n int")
        assert [r["at"] for r in rows.select(co._place().alias("at"), "n").orderBy("n").collect()] == co._places(auto, k, b"en").tolist()


def test_scores_beyond_64_bits(spark):
    # a * a * 1000000 and l * r pass 64 bits
    counts = [("en", "x y", 2, 3 * 10**9), ("en", "x", 1, 4 * 10**9), ("en", "y", 1, 5 * 10**9), ("en", "", 0, 10**10)]
    found = spark.createDataFrame(counts, "lang string, phrase string, size int, a bigint")
    original = co.frequent_phrases
    co.frequent_phrases = lambda *a: found
    try:
        (row,) = co.collocations(found.withColumn("text", found["lang"])).collect()
    finally:
        co.frequent_phrases = original
    assert row["score"] == 10**6 * 9 * 10**18 // (20 * 10**18)


def test_query_and_its_twin(spark):
    found = sorted(map(tuple, catalog.queries()["op12_collocations"](spark, SF).select(*FIELDS).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = con.execute(f"select {', '.join(FIELDS)} from ({catalog.oracle_sql()['op12_collocations']})").fetchall()
    assert found == sorted(rows) and found
    assert found == brute(con.execute("select text, lang from documents").fetchall(), 3, 10, 2000)
