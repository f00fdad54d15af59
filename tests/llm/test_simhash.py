import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from codequarry.llm import simhash
from codequarry.llm.components import connected_components
from codequarry.llm.tables import join_spread


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_roots(values, most=3):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= most:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def texts(rng, n):
    words = [f"w{i}" for i in range(60)]
    bases = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 120]))) for _ in range(12)]
    out = ["", None, "  \t", "A b", "a  B", "one", "Ünï É", "x\x1cy z"]
    for _ in range(n):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_groups_against_all_pairs(spark):
    rows = [(n * 7, t, "clash") for n, t in enumerate(texts(random.Random(1), 250))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(5)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
    values = [brute_print(t) for _, t, _ in rows]
    roots = brute_roots(values)
    assert found == {i: (f"{v:016x}", rows[r][0]) for (i, _, _), v, r in zip(rows, values, roots)}
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({rows[r][0] for r in roots})


def test_links_of_dense_values_in_blocks(spark):
    """Far more values in a posting list than a block holds."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    values = {int(v) for v in base}
    for v in base.tolist():
        for _ in range(700):
            values.add(v ^ (1 << int(rng.integers(0, 20))) ^ (1 << int(rng.integers(0, 20))) ^ (1 << int(rng.integers(0, 63))))
    values = sorted(values)
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = {r["node"]: r["root"] for r in connected_components(simhash.near_links(fps), "a", "b").collect()}
    a = np.array(values)
    label = np.arange(len(a))
    near = [np.flatnonzero(np.bitwise_count((a[i] ^ a).view(np.uint64)) <= 3) for i in range(len(a))]
    while True:
        new = np.array([label[n].min() for n in near])
        new = new[new]
        if (new == label).all():
            break
        label = new
    assert all(found.get(v, v) == values[label[i]] for i, v in enumerate(values))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "x y z"), (None, "x y z"), (5, "x y z"), (5, "other words here now"), (2, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_groups(docs).collect()), key=str)
    assert found == sorted([(None, None), (None, None), (5, 2), (None, 2), (5, 2), (5, 5), (2, 2)], key=str)
    kept = sorted((tuple(r) for r in simhash.one_of_each_group(docs).collect()), key=str)
    assert kept == sorted([(None, "a b c d"), (5, "other words here now"), (2, "x y z")], key=str)
    assert simhash.near_groups(docs.where("false")).collect() == [] == simhash.one_of_each_group(docs.where("false")).collect()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (1, 1), (None, 2), (10, 9)], "a int, b int")
    found = {r["node"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
    assert found == {3: 3, 4: 3, 5: 3, 9: 3, 10: 3, 7: 7, 8: 7}
    assert connected_components(edges.where("false"), "a", "b").collect() == []


def test_tallies_prune_before_bits_are_compared():
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63, 4000)
    flips = np.array([sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 9)))) for _ in a], np.uint64).view(np.int64)
    b = a ^ flips
    tally = simhash.shared_bytes(a, b)
    octets = lambda v: v.astype("<i8").tobytes()
    assert tally.tolist() == [sum(x == y for x, y in zip(octets(p), octets(q))) for p, q in zip(a, b)]
    (linked,) = simhash._linked(a, b)
    bits = np.array([int(f).bit_count() for f in flips.view(np.uint64)])
    assert linked.tolist() == np.flatnonzero(bits <= 3).tolist()
    # the tally loses no link, and drops pairs that are none
    assert (tally[bits <= 3] >= simhash.LEAST_BYTES).all() and (tally < simhash.LEAST_BYTES).any() and ((tally >= simhash.LEAST_BYTES) & (bits > 3)).any()
    i, j = simhash._linked(a[:50, None], b[None, :50])
    assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(50) for y in range(50) if (int(a[x]) ^ int(b[y])).bit_count() <= 3]


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 977}q{i}" for i in range(150_000))
    rows = [(1, long, "x"), (2, long + " tail", "y"), (3, "other words here", "z")]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string, fp string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_join_spread_equals_a_join_and_moves_no_hot_key(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 4000), n) for n in range(5000)] + [(None, -1)]
    rows = spark.createDataFrame(rows, "k int, x int")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("most")).where("k <> 7")
    found = join_spread(rows, keyed, "k", "n", 5001)
    assert found.columns == ["k", "x", "most"]
    assert sorted(found.collect()) == sorted(rows.join(keyed.drop("n"), "k").collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.count("BroadcastHashJoin") >= 2


def test_hubs_and_a_third_of_blank_texts(spark):
    hub = spark.createDataFrame([(0, n) for n in range(1, 3000)] + [(n, n + 1) for n in range(5000, 5200)] + [(5000, 2999)], "a bigint, b bigint")
    roots = dict(map(tuple, connected_components(hub, "a", "b").collect()))
    assert set(roots) == set(range(3000)) | set(range(5000, 5201)) and set(roots.values()) == {0}
    texts = ["" if n % 3 == 0 else f"some words number {n} {n * 7} and more" for n in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
    assert len(groups) == 300 and all(groups[n]["component_id"] == 0 and groups[n]["fingerprint"] == "0" * 16 for n in range(0, 300, 3))
