"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from codequarry.llm import conversation as cv

COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SF = "/root/testdata/sf0.001"


def damaged(rows):
    """Rows by conversation after damage, in order; every conversation has an entry."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        out[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def brute(rows):
    """Every column of a conversation's result, by a table over (rows done, roles so far) that keeps all texts of edits' outcomes."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    # for each last initial: least (cost, audit, repaired rows)
    now = {"": (0, "", [])}

    def with_inserts(table):
        for _ in range(3):
            for last, (cost, audit, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[last]:
                        new = (cost + 5, audit + "I", out + [f"{role}:"])
                        if role[0] not in table or new[:2] < table[role[0]][:2]:
                            table[role[0]] = new
        return table

    now = with_inserts(now)
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(last, entry):
            if last not in new or entry[:2] < new[last][:2]:
                new[last] = entry

        extra = 5 if fault == "truncated" else 0
        for last, (cost, audit, out) in now.items():
            offer(last, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] and role[0] in follows[last]:
                offer(role[0], (cost + extra, audit + "K", out + [f"{role}:{text}"]))
            for given in ("user", "assistant"):
                if given[0] in follows[last]:
                    offer(given[0], (cost + 1 + extra, audit + "R", out + [f"{given}:{text}"]))
        now = with_inserts(new)
    cost, audit, out = min((v for k, v in now.items() if k in ("", "a")), key=lambda v: v[:2])
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def check(spark, rows, kind="conv_id bigint, turn bigint, role string, text string", clash=False):
    table = spark.createDataFrame(rows, kind)
    if clash:
        for c in ("block", "copies", "seen", "__long", "cost", "audit"):
            table = table.withColumn(c, table["role"])
    found = cv.repair(cv.damage(table), copies_col="copies").collect()
    want = {c: brute(r) for c, r in damaged(rows).items()}
    assert len(found) == len(want)
    for r in found:
        assert tuple(r[c] for c in COLS) == want[r["conv_id"]], r["conv_id"]
    return want


def rows_of(rng, conv, turns):
    words = ["yes.", "no", "why?", "", " ", "so it is.", "go on!", "\t\n", "a. b", "ok. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(conv, t, rng.choice(roles), rng.choice([*words, None, f"w{rng.randrange(99)}.", f"v{rng.randrange(99)}."])) for t in turns]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(300), None]:
        turns = [rng.choice([None, rng.randrange(12), rng.randrange(12)]) for _ in range(rng.randrange(1, 12))]
        rows += rows_of(rng, conv, turns)
    rows += [(1000, 3, "user", "same.")] * 5 + [(1001, None, None, None)] * 3
    # one whose only row is dropped
    alone = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(alone, 0, "user", "gone.")]
    want = check(spark, rows, clash=True)
    assert want[alone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {len(v[6]) > 0 for v in want.values()} == {True, False}
    assert any("R" in v[6] for v in want.values())


def test_long_conversations_are_composed_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", 4)
    rng = random.Random(6)
    rows = []
    for conv in [*range(40), None]:
        turns = [*(rng.randrange(-20, 60) for _ in range(rng.randrange(1, 60))), *[None] * rng.randrange(3)]
        rows += rows_of(rng, conv, turns)
    rows += rows_of(rng, 77, range(400)) + [(78, 1, "user", "x.")]
    check(spark, rows)


def test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_odd_tables(spark):
    kind = "conv_id string, turn int, role string, text string"
    assert cv.repair(cv.damage(spark.createDataFrame([], kind)), copies_col="copies").count() == 0
    check(spark, [("a", 1, "user", "x" * 300_000 + "."), ("a", 2, "assistant", "y " * 200_000), ("", 1, "user", "é?")], kind)
    # without damage and without copies
    plain = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes.")], kind)
    (row,) = cv.repair(plain).collect()
    assert (row["cost"], row["audit"]) == (0, "KK")


def test_first_popped_end_is_the_cheapest(monkeypatch):
    # two users in a row: delete one (2) or give it a role and insert (1 + 5); of equal costs the ASCII-least audit
    assert cv.paths([("u", 0), ("u", 0), ("a", 0)], cv.BEGIN, True) == {cv.ASSISTANT: (2, "DKK")}
    assert cv.paths([], cv.BEGIN, True) == {cv.BEGIN: (0, "")}
    # a row with a million copies is one step
    assert cv.paths([("u", 0), (None, 10**6), ("a", 0)], cv.BEGIN, True)[cv.ASSISTANT] == (2 * 10**6, "K" + "D" * 10**6 + "K")
    # at the contract's costs a delete is always cheaper than an insert
    monkeypatch.setattr(cv, "INSERT", 1)
    assert cv.paths([("u", 0)], cv.BEGIN, True) == {cv.ASSISTANT: (1, "KI")}
    assert list(cv.replay(iter([("user", "x")]), "KI", cv.BEGIN)) == [("user", "x"), ("assistant", "")]
