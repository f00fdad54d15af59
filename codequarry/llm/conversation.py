"""Repair of conversations: the cheapest edits that make the roles of a conversation follow a grammar.

A row is kept, given another role or deleted, and empty rows may be inserted, until the roles' initials read `(s?(ua)+)?`. The edits form a lattice of nodes (row, grammar
state); Dijkstra's algorithm walks it without building it, ordered by (cost, audit), and ends at the first accepting end node that it takes. Of two ways to one node
with equal cost neither's audit begins with the other's (inserts cost something), so what is least at a node stays least after any further edits.

Conversations are cut into blocks of turns, and identical rows are counted before they are shuffled, so neither a long conversation nor a row repeated without end meets in one
task. A block that is a whole conversation is solved at once. Blocks of longer ones give a map, the cheapest (cost, audit) from each grammar state before to each after;
the maps of a conversation are composed in order, and its rows are then read in order once more for the digest of the repaired text, which no two tasks could make together.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: turns in a block
BLOCK = 1024
WHITE = " \t\n\x0b\x0c\r"
NO_TURN = -(2**63)

#: grammar states: nothing said, after the system's row, after a user's, after an assistant's. The first and the last are accepting.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (BEGIN, ASSISTANT)
NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the row that may be inserted, and the role that a row may be given, in each state
WANTED = {BEGIN: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, turn, role, text, copies): the rows with faults put in by crc32 of "id:turn" modulo 20.

    0 drops the row (copies 0), 1 empties its text, 2 removes its `[.!?]`, 3 repeats it (copies 2), 4 makes its role user. Null roles and texts, and nulls in the key, read as one space.
    """

    def shown(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown(text_col), ".!?", "")).otherwise(shown(text_col))
    role = F.when(kind == 4, "user").otherwise(shown(role_col))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint")
    return rows.select(id_col, F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


# ---- the lattice


def row_steps(blank: bool, duplicate: bool, truncated: bool, role: str, copies: int) -> list[tuple]:
    """Steps of a row and its copies: (None, n) for n rows that must go, (initial, surcharge) for one that may stay."""
    if blank or duplicate:
        return [(None, copies)]
    own = (role[:1], TRUNCATED if truncated else 0)
    return [own, (None, copies - 1)] if copies > 1 else [own]


def paths(steps: list[tuple], start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) from start to each state after all steps; if whole, to the first accepting one alone."""
    found: dict[int, tuple[int, str]] = {}
    done = set()
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(steps):
            found[state] = cost, audit
            if whole and state in ACCEPTING:
                return {state: found[state]}
        wanted = WANTED[state][1]
        heapq.heappush(heap, (cost + INSERT, audit + "I", at, wanted))
        if at == len(steps):
            continue
        initial, extra = steps[at]
        if initial is None:
            heapq.heappush(heap, (cost + DELETE * extra, audit + "D" * extra, at + 1, state))
            continue
        heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
        heapq.heappush(heap, (cost + REROLE + extra, audit + "R", at + 1, wanted))
        kept = NEXT.get((state, initial))
        if kept is not None:
            heapq.heappush(heap, (cost + KEEP + extra, audit + "K", at + 1, kept))
    return found


def replay(rows: Iterator[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows that the edits make of rows, from a grammar state on."""
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "K":
            state = NEXT[state, role[:1]]
        else:
            role, state = WANTED[state]
        yield role, text


class Digest:
    """SHA-256 of `role:text` lines joined by newlines, fed row by row."""

    def __init__(self):
        self.hash, self.rows = hashlib.sha256(), 0

    def add(self, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            self.hash.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
            self.rows += 1


def solve(rows: list[tuple], whole: bool) -> dict:
    """A block's counts and either its repair or its maps. rows: (turn, role, text, copies, seen_before) in order."""
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    steps, turns, seen, initials = [], set(), set(), []
    for turn, role, text, copies, seen_before in rows:
        if not copies:
            continue
        turns.add(turn)
        said = text.strip(WHITE)
        blank = not said
        duplicate = not blank and (seen_before or (role, text) in seen)
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        seen.add((role, text))
        counts["blank"] += copies * blank
        counts["truncated"] += truncated
        counts["duplicate"] += 0 if blank else copies if duplicate else copies - 1
        steps += row_steps(blank, duplicate, truncated, role, copies)
        if initials and initials[-1] + role[:1] not in LEGAL:
            counts["illegal"] += 1
        # two of a kind are never legal
        counts["illegal"] += copies - 1
        initials.append(role[:1])
    turns.discard(None)
    out = counts | {"first": initials[0] if initials else None, "last": initials[-1] if initials else None, "turns": len(turns), "low": min(turns, default=None), "high": max(turns, default=None)}
    if not whole:
        maps = [(start, end, cost, audit) for start in range(4) for end, (cost, audit) in paths(steps, start, False).items()]
        return out | {"maps": maps}
    (cost, audit), *_ = paths(steps, BEGIN, True).values()
    digest = Digest()
    digest.add(replay(spread(rows), audit, BEGIN))
    return out | {"gaps": gaps(out["low"], out["high"], len(turns)), "cost": cost, "audit": audit, "repaired_sha256": digest.hash.hexdigest()}


def spread(rows: list[tuple]) -> Iterator[tuple[str, str]]:
    """(role, text) of each row as often as it stands there."""
    return ((role, text) for _, role, text, copies, _ in rows for _ in range(copies))


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


# ---- the work on Spark

FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PART = "block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, turns bigint, low bigint, high bigint, maps array<struct<start:int,end:int,cost:bigint,audit:string>>"


def in_groups(df: DataFrame, keys: list[str], order: list[str], work, schema: str, by: list[str] | None = None) -> DataFrame:
    """df dealt by keys and sorted by them and order; work(key values, iterator of row tuples) gives the rows of schema for each group, one group at a time.

    Rows stream through: a group is never held by this function. by: the keys to deal by, if not all.
    """
    columns = df.columns
    n_keys = len(keys)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out, held = [], 0
        for key, group in groupby(rows, key=itemgetter(*range(n_keys)) if n_keys > 1 else lambda r: (r[0],)):
            for row in work(key, group):
                out.append(row)
                held += 200 + sum(len(v) for v in row if isinstance(v, str))
                if held > 1 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in out], target)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in out], target)

    assert columns[:n_keys] == keys
    return df.repartition(*(by or keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """(id_col, gaps, blank, duplicate, truncated, illegal, cost longs, audit, repaired_sha256 strings), one row for each conversation.

    Rows of a conversation are taken by turn, nulls first, then role and text. copies_col says how often a row stands in its place, one after the other (1 if not given); a conversation whose
    rows all have 0 copies has zeros, an empty audit and the digest of the empty text. A row's first fault counts: blank, duplicate (role and text seen
    earlier), truncated (last visible character not `[.!?]`). Blank rows and duplicates must be deleted. Null roles and texts read as one space; rows with a null id are a
    conversation of their own; an empty table gives an empty result; further columns are not read. Texts of any length are taken whole. Rows of one conversation and one turn
    with different contents are the least that one task must hold.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    given = rows.select(
        F.col(id_col).alias("__id"), F.coalesce(F.floor(F.col(turn_col) / BLOCK).cast("bigint"), F.lit(NO_TURN)).alias("block"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), (F.col(copies_col) if copies_col else F.lit(1)).cast("bigint").alias("copies"),
    )
    counted = given.groupBy("__id", "block", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    spans = given.groupBy("__id").agg(F.min("block").alias("from"), F.max("block").alias("to")).where("from <> to").select("__id")
    order = ["turn", "role", "text"]

    def finish(key, group):
        found = solve([r[2:] for r in group], True)
        yield (key[0], *(found[c] for c in FOUND))

    short = counted.withColumn("seen", F.lit(False))
    has_long = not spans.isEmpty()
    if has_long:
        marked = counted.join(spans.select(F.col("__id").alias("__long"), F.lit(True).alias("__is")), F.col("__id").eqNullSafe(F.col("__long")), "left").drop("__long")
        short = marked.where("__is is null").drop("__is").withColumn("seen", F.lit(False))
        long = _with_seen(marked.where("__is").drop("__is"))
    out = in_groups(short, ["__id", "block"], order, finish, f"__id {kind}, {_FOUND}")
    if has_long:
        out = out.unionByName(_repair_long(long, kind, order))
    return out.withColumnRenamed("__id", id_col)


def _with_seen(rows: DataFrame) -> DataFrame:
    """rows with seen: role and text stand in an earlier block of the conversation too. Only digests are compared across blocks; joins are split by Spark where one digest is frequent."""
    keyed = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    first = keyed.where("copies > 0").groupBy(F.col("__id").alias("__i"), F.col("digest").alias("__d")).agg(F.min("block").alias("__first"))
    joined = keyed.join(first, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("digest") == F.col("__d")), "left")
    return joined.select(*rows.columns, F.coalesce(F.col("block") > F.col("__first"), F.lit(False)).alias("seen"))


def _repair_long(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """The result for conversations of several blocks."""
    fields = ["blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high", "maps"]

    def part(key, group):
        found = solve([r[2:] for r in group], False)
        yield (*key, *(found[c] if c != "maps" else [dict(zip(("start", "end", "cost", "audit"), m)) for m in found[c]] for c in fields))

    def compose(key, group):
        total = dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "turns"], 0)
        # state: (cost, audits of the blocks so far, states before them)
        best: dict[int, tuple[int, list[str], list[int]]] = {BEGIN: (0, [], [])}
        last, low, high, blocks = None, None, None, []
        for r in group:
            p = dict(zip(["block", *fields], r[1:]))
            blocks.append(p["block"])
            for c in total:
                total[c] += p[c]
            if last is not None and p["first"] is not None and last + p["first"] not in LEGAL:
                total["illegal"] += 1
            last = p["last"] if p["last"] is not None else last
            low = min((x for x in (low, p["low"]) if x is not None), default=None)
            high = max((x for x in (high, p["high"]) if x is not None), default=None)
            new: dict[int, tuple[int, list[str], list[int]]] = {}
            for m in p["maps"]:
                if m["start"] not in best:
                    continue
                cost, audits, states = best[m["start"]]
                made = cost + m["cost"], [*audits, m["audit"]], [*states, m["start"]]
                now = new.get(m["end"])
                # lists of block audits are compared as the strings that they join to
                if now is None or made[0] < now[0] or (made[0] == now[0] and "".join(made[1]) < "".join(now[1])):
                    new[m["end"]] = made
            best = new
        cost, audits, states = min((v for s, v in best.items() if s in ACCEPTING), key=lambda v: (v[0], "".join(v[1])))
        yield (key[0], None, gaps(low, high, total["turns"]), *(total[c] for c in FOUND[1:5]), cost, "".join(audits), None)
        for block, audit, state in zip(blocks, audits, states):
            yield (key[0], block, None, None, None, None, None, state, audit, None)

    def digest(key, group):
        whole, made = None, Digest()
        for _, rows_of in groupby(group, key=itemgetter(1)):
            first = next(rows_of)
            if first[1] is None:
                whole = first[7]
                continue
            made.add(replay(spread(r[3:7] + (None,) for r in rows_of), first[7]["audit"], first[7]["cost"]))
        yield (key[0], *(whole[c] for c in FOUND[:-1]), made.hash.hexdigest())

    parts = in_groups(rows, ["__id", "block"], order, part, f"__id {kind}, {_PART}")
    chosen = in_groups(parts, ["__id"], ["block"], compose, f"__id {kind}, block bigint, {_FOUND}")
    # a conversation's own row first, then each block's choice before the block's rows
    struct = F.struct(*FOUND)
    heads = chosen.select("__id", "block", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("copies"), struct.alias("found"))
    body = rows.select("__id", "block", F.lit(1).alias("rank"), "turn", "role", "text", "copies", F.lit(None).cast(f"struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>").alias("found"))
    return in_groups(heads.unionByName(body), ["__id"], ["block", "rank", *order], digest, f"__id {kind}, {_FOUND}")
