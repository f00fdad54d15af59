"""Syntax of files told where they are read: invocations, method chains, test functions and declarations of whole contents, from arrays over a batch's tokens.

The relations are those of operators.syntax, whose windows over tokens deal every token by path; here neighbours are shifts, partners are sorts by level, and what holds so far is a
running maximum, all over the tokens of a batch of files, so only facts leave a worker and no token is shuffled or stored. Contents that are large (see LARGE) are left to the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codequarry.operators.lexer import BATCH_BYTES, Base, Placed, Run, heads, tokens_in
from codequarry.operators.syntax import TEST_MARKERS
from codequarry.session import ship_package

#: bytes of a line beyond which its file counts as large: facts carry the text of their line
WIDE_LINE = 4096
#: bytes of texts that leave a worker in one record batch
OUT_BYTES = 8 << 20
FAR = 2**31 - 1
#: pairs of a use and a depth at which its name is declared that are looked at together
MOST_PAIRS = 1 << 20

#: relations and their columns; text is that of the fact's line, null unless asked for
KINDS = {
    "calls": "idx int, line int, col int, name string, gap string, kind string, open_idx int, close_idx int, open_start bigint, close_start bigint, body int, body_end int, args string, text string",
    "chains": "root_idx int, root string, line int, col int, args_open int, args_close int, args_from bigint, args_to bigint, end_idx int, n_calls bigint, args string, previous string, next string, text string",
    "chained": "root_idx int, idx int, name string, line int, col int, open_idx int, close_idx int, open_start bigint, close_start bigint, args string, text string",
    "tests": "line int, end_line int, open_idx int, close_idx int, text string",
    "declared": "binding string, name string, idx int, line int, col int, after int, scope_end int, parens bigint, brackets bigint, braces bigint, used boolean, text string",
}


def large(content: Column) -> Column:
    """Whether a content is one for the windows: longer than a batch, or with a line whose text is no small thing to carry."""
    return (F.octet_length(content) > BATCH_BYTES) | ((F.octet_length(content) > WIDE_LINE) & F.exists(F.split(content, "\n", -1), lambda line: F.octet_length(line) > WIDE_LINE))


class Only:
    """What rules ask for: calls in test functions or by some names, and the arguments of some; chains by a pattern of their roots, calls of chains by name, unused declarations. Each has the text of its line."""

    def __init__(self, calls: tuple[str, ...], args_of: tuple[str, ...], roots: str, chained: tuple[str, ...]):
        self.calls, self.args_of, self.roots, self.chained = calls, args_of, roots, chained


class Batch:
    """The tokens of whole files without white space, as arrays; places count them over all files of the batch, -1 is none."""

    def __init__(self, runs: list[Run], contents: list[bytes]):
        self.placed, self.runs, self.contents = Placed(runs), runs, contents
        at = self.at = np.flatnonzero(self.placed.kind != 4)
        self.n, self.file = len(at), self.placed.run[at]
        self.kind, self.idx, self.start, self.line, self.col = (getattr(self.placed, k)[at] for k in ("kind", "idx", "start", "line", "col"))
        self.depth = {k: v[at] for k, v in self.placed.depths.items()}
        self.text = self.placed.text.take(pa.array(at))
        coded = self.text.dictionary_encode()
        self.code, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.place = np.arange(self.n)
        self._partners: dict[str, np.ndarray] = {}
        self._tests: dict[str, np.ndarray] | None = None

    def is_(self, *texts: str) -> np.ndarray:
        """Whether each token is one of the texts."""
        return np.isin(self.code, [c for c in (self.words.index(pa.scalar(t.encode(), self.words.type)).as_py() for t in texts) if c >= 0])

    def near(self, step: int, among: np.ndarray | None = None) -> np.ndarray:
        """For each token, or each of a selection by places, the place of the one so many further in its file."""
        places = self.place if among is None else among
        out = np.full(len(places), -1)
        if len(places) > abs(step):
            a, b = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
            out[a] = np.where(self.file[places[a]] == self.file[places[b]], places[b], -1)
        return out

    def partners(self, opening: str, closing: str, depth: str) -> np.ndarray:
        """For each token the place of the closer that it opens: the next delimiter of its level, if that is a closer."""
        if depth not in self._partners:
            is_closing = self.is_(closing)
            at = np.flatnonzero(self.is_(opening) | is_closing)
            level = self.depth[depth][at] - is_closing[at]
            order = np.lexsort((at, level, self.file[at]))
            a, level, closes = at[order], level[order], is_closing[at[order]]
            pair = (self.file[a[:-1]] == self.file[a[1:]]) & (level[:-1] == level[1:]) & ~closes[:-1] & closes[1:]
            out = np.full(self.n, -1)
            out[a[:-1][pair]] = a[1:][pair]
            self._partners[depth] = out
        return self._partners[depth]

    def joined(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The texts of the tokens from each first place to each last one, put together."""
        sizes = last - first + 1
        offsets = np.append(0, np.cumsum(sizes))
        each = np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.text.take(pa.array(each))), b"").view(pa.string())

    def texts(self, place: np.ndarray) -> pa.Array:
        return self.text.take(pa.array(place, mask=place < 0)).view(pa.string())

    def numbers(self, values: np.ndarray, place: np.ndarray, kind: pa.DataType) -> pa.Array:
        """values at places, null where there is none."""
        there = place >= 0
        return pa.array(np.where(there, values[np.where(there, place, 0)], 0), kind, mask=~there) if self.n else pa.nulls(len(place), kind)

    # ---- the relations: columns by name, and the places whose lines they are told with

    def tests(self) -> dict[str, np.ndarray]:
        """syntax.test_functions(): places of attribute, fn, opening and closing brace."""
        if self._tests is not None:
            return self._tests
        begin = np.searchsorted(self.file, self.file)
        closing = self.partners("[", "]", "brackets")
        before, after = self.near(-1), self.near(1)
        hash_ = self.is_("#")
        opens = self.is_("[") & (before >= 0) & hash_[before] & (self.idx[before] == self.idx - 1)
        # within a file: places of other files are below its first one
        end = np.maximum.accumulate(np.where(opens, np.where(closing >= 0, closing, self._last()), -1)) if self.n else begin
        in_attribute = (self.place <= end) | (hash_ & (after >= 0) & opens[after])
        is_test = np.zeros(self.n, bool)
        for marker in TEST_MARKERS:
            words = _pieces(marker[2:])
            hit = opens.copy()
            for k, word in enumerate(words, 1):
                there = self.near(k)
                hit &= (there >= 0) & self.is_(word)[there] & (self.idx[there] == self.idx + k if k in (2, 4) and k == len(words) else True)
            is_test |= hit
        marker = np.maximum.accumulate(np.where(is_test, self.place, -1)) if self.n else begin
        core = np.flatnonzero(~in_attribute & (self.kind != 1) & (self.kind != 2))
        prior, following = self.near(-1, core), self.near(1, core)
        braces = np.flatnonzero(self.is_("{")[core])
        gap = self.gaps()
        is_fn = self.is_("fn")[core] & (following >= 0) & (gap[following] | self.is_("(")[following])
        marked = marker[core]
        found = np.flatnonzero(is_fn & (marked >= begin[core]) & (marked > prior))
        nth = np.searchsorted(braces, found, "right")
        has = nth < len(braces)
        found, nth = found[has], nth[has]
        fn, opened = core[found], core[braces[nth]]
        closed = self.partners("{", "}", "braces")[opened]
        keep = (self.file[fn] == self.file[opened]) & (closed >= 0)
        fn, opened, closed, marked = fn[keep], opened[keep], closed[keep], marked[found][keep]
        # files before end before this one's first place
        reach = np.append(-1, np.maximum.accumulate(closed)[:-1]) if len(closed) else closed
        keep = fn > reach
        self._tests = {"marker": marked[keep], "open": opened[keep], "close": closed[keep]}
        return self._tests

    def _last(self) -> np.ndarray:
        """The place of the last token of each token's file."""
        return np.searchsorted(self.file, self.file, "right") - 1

    def gaps(self) -> np.ndarray:
        """Whether white space stands before each token."""
        prior = self.at - 1
        return (self.placed.within[self.at] > 0) & (self.placed.kind[np.maximum(prior, 0)] == 4)

    def calls(self, only: Only | None) -> tuple[dict, np.ndarray]:
        """syntax.invocations(), with the test function around each if rules ask."""
        p1, p2, n1, n2 = (self.near(k) for k in (-1, -2, 1, 2))
        ident, paren = self.kind == 3, self.is_("(")
        linked = ident & (p1 >= 0) & (p2 >= 0) & self.is_(".", "::")[p1] & (self.kind[p2] == 3)
        head = np.maximum.accumulate(np.where(ident & ~linked, self.place, 0)) if self.n else self.place
        called, macro = (n1 >= 0) & paren[n1], (n1 >= 0) & self.is_("!")[n1]
        keep = ident & (called | macro)
        body = np.full(self.n, -1)
        if only:
            tests = self.tests()
            if len(tests["open"]):
                held = np.searchsorted(tests["open"], self.place) - 1
                inside = (held >= 0) & (self.place < tests["close"][np.maximum(held, 0)])
                body = np.where(inside, np.maximum(held, 0), -1)
            keep &= (body >= 0) | self.is_(*only.calls)
        at = np.flatnonzero(keep)
        n1, n2, called, first, body = n1[at], n2[at], called[at], head[at], body[at]
        touching = ~called & (n2 >= 0) & paren[n2] & (self.idx[n2] == self.idx[n1] + 1)
        opened = np.where(called, n1, np.where(touching, n2, -1))
        closed = np.where(opened >= 0, self.partners("(", ")", "parens")[opened], -1) if self.n else opened
        both = np.where(closed >= 0, opened, -1)
        dotted = linked[at] & self.is_(".")[p1[at]] & self.gaps()[at]
        space = self.placed.text.take(pa.array(np.where(dotted, self.at[at] - 1, 0), mask=~dotted)).fill_null(b"").view(pa.string())
        held = {k: np.where(body >= 0, self.tests()[k][np.maximum(body, 0)], -1) if only and len(self.tests()[k]) else np.full(len(at), -1) for k in ("open", "close")}
        return {
            "idx": self.idx[first], "line": self.line[first], "col": self.col[first], "name": self.joined(first, at), "gap": space, "kind": pa.array(np.where(called, "call", "macro").tolist(), pa.string()),
            "open_idx": self.numbers(self.idx, opened, pa.int32()), "close_idx": self.numbers(self.idx, closed, pa.int32()), "open_start": self.numbers(self.start, both, pa.int64()), "close_start": self.numbers(self.start, closed, pa.int64()),
            "body": self.numbers(self.idx, held["open"], pa.int32()), "body_end": self.numbers(self.idx, held["close"], pa.int32()),
            "args": (both, np.where(self.is_(*only.args_of)[at], closed, -1)) if only else pa.nulls(len(at), pa.string()),
        }, first

    def chain_calls(self, only: Only | None) -> tuple[tuple[dict, np.ndarray], tuple[dict, np.ndarray]]:
        """syntax.chain_calls(): chains and their calls."""
        code = np.flatnonzero(self.kind != 1)
        ident, paren, end_paren = self.kind == 3, self.is_("("), self.is_(")")
        l1, l2 = self.near(-1, code), self.near(-2, code)
        inner = np.zeros(self.n, bool)
        inner[code] = ident[code] & (l1 >= 0) & (l2 >= 0) & self.is_("::")[l1] & ident[l2] & (self.idx[l2] == self.idx[code] - 2)
        head = np.maximum.accumulate(np.where(ident & ~inner, self.place, 0)) if self.n else self.place
        partner = self.partners("(", ")", "parens")
        # each level of parentheses is a stream of its own, cut where a parenthesis of that level opens
        parens = self.depth["parens"]
        cut = code[paren[code]]
        place, level = np.concatenate([code, cut]), np.concatenate([parens[code] - end_paren[code], parens[cut] + 1])
        is_cut = np.concatenate([np.zeros(len(code), bool), np.ones(len(cut), bool)])
        order = np.lexsort((place, level, self.file[place]))
        place, level, is_cut = place[order], level[order], is_cut[order]
        group = np.cumsum(np.append(0, (level[1:] != level[:-1]) | (self.file[place[1:]] != self.file[place[:-1]]))) if len(place) else place
        k = np.arange(len(place))

        def entry(step: int) -> tuple[np.ndarray, np.ndarray]:
            """(place, whether it is there and no cut) of the entry so many further in the stream."""
            to = np.clip(k + step, 0, len(k) - 1) if len(k) else k
            return place[to], (k + step >= 0) & (k + step < len(k)) & (group[to] == group) & ~is_cut[to]

        (p1, h1), (p2, h2), (p3, h3), (p4, h4), (n1, g1) = (entry(s) for s in (-1, -2, -3, -4, 1))
        attached = (h2 & ident[p2]) | (h2 & end_paren[p2] & h3 & paren[p3] & h4 & ident[p4])
        has_args = g1 & paren[n1] & (partner[n1] >= 0)
        call = ~is_cut & ident[place] & h1 & self.is_(".")[p1] & has_args & attached
        other = np.maximum.accumulate(np.where(~is_cut & ident[place] & ~call, k, -1)) if len(k) else k
        same = (other >= 0) & (group[np.maximum(other, 0)] == group)
        args = np.full(self.n, -1)
        args[place[~is_cut & has_args]] = n1[~is_cut & has_args]
        calls = place[call & same]
        of = head[place[other[call & same]]]
        sorted_ = np.argsort(calls)
        calls, of = calls[sorted_], of[sorted_]
        is_call = np.zeros(self.n, bool)
        is_call[place[call]] = True
        roots = np.flatnonzero(ident & ~is_call)
        roots = roots[np.append(head[roots][1:] != head[roots][:-1], True)] if len(roots) else roots
        first = head[roots]
        closer = np.where(args >= 0, partner[args], -1) if self.n else args
        n_calls, last_close = np.bincount(of, minlength=self.n), np.full(self.n, -1)
        np.maximum.at(last_close, of, closer[calls])
        keep = (n_calls[first] > 0) | (closer[roots] >= 0)
        roots, first = roots[keep], first[keep]
        end = np.maximum(np.maximum(roots, closer[roots]), last_close[first])
        # files before end before this one's first place
        reach = np.append(-1, np.maximum.accumulate(np.where(n_calls[first] > 0, end, -1))[:-1]) if len(first) else first
        keep = first > reach
        roots, first, end = roots[keep], first[keep], end[keep]
        in_chain = np.zeros(self.n, bool)
        in_chain[first] = True
        kept = in_chain[of]
        calls, of = calls[kept], of[kept]
        root = self.joined(first, roots)
        if only:
            wanted = pc.match_substring_regex(root, only.roots).to_numpy(zero_copy_only=False).astype(bool)
            roots, first, end, root = roots[wanted], first[wanted], end[wanted], root.filter(pa.array(wanted))
            wanted = self.is_(*only.chained)[calls]
            calls, of = calls[wanted], of[wanted]
        opened, closed = args[roots], closer[roots]
        opened = np.where(closed >= 0, opened, -1)
        around = [self.near(-1)[first], self.near(1)[end]]
        chains = {
            "root_idx": self.idx[first], "root": root, "line": self.line[first], "col": self.col[first], "args_open": self.numbers(self.idx, opened, pa.int32()), "args_close": self.numbers(self.idx, closed, pa.int32()),
            "args_from": self.numbers(self.start, opened, pa.int64()), "args_to": self.numbers(self.start, closed, pa.int64()), "end_idx": self.idx[end], "n_calls": n_calls[first], "args": (opened, closed),
            "previous": self.texts(around[0]), "next": self.texts(around[1]),
        }
        if not only:
            chains["args"] = pa.nulls(len(roots), pa.string())
        opened, closed = args[calls], closer[calls]
        chained = {
            "root_idx": self.idx[of], "idx": self.idx[calls], "name": self.texts(calls), "line": self.line[calls], "col": self.col[calls], "open_idx": self.idx[opened], "close_idx": self.idx[closed],
            "open_start": self.start[opened], "close_start": self.start[closed], "args": (opened, closed),
        }
        return (chains, first), (chained, calls)

    def declared(self, only: Only | None) -> tuple[dict, np.ndarray]:
        """syntax.declarations(), with whether each is used by the measure of syntax.unused()."""
        h = heads(self.placed, self.runs, {})
        at = self.at
        begins, in_head = h["begins"][at], h["in_head"][at]
        depths = list(self.depth.values())
        statements = np.flatnonzero(begins)
        after = self._following(statements, self.is_(";"), depths)
        scope = self._following(statements, self.is_("}"), depths[2:])
        latest = np.searchsorted(statements, self.place, "right") - 1
        head = np.flatnonzero(in_head)
        head = head[self.idx[head] < after[latest[head]]] if len(statements) else head[:0]
        of = latest[head]
        n = np.arange(len(head)) - np.searchsorted(of, of) + 1
        starts = lambda places, pattern: pc.match_substring_regex(self.texts(places), pattern).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        gap = pc.starts_with(h["gap_after"].take(pa.array(at[head])).view(pa.string()), " ").to_numpy(zero_copy_only=False).astype(bool)
        mut = (n == 1) & self.is_("mut")[head] & gap
        is_let, is_pub = self.is_("let")[statements][of], self.is_("pub")[statements][of]
        mut_first, several = np.zeros(len(statements), bool), np.zeros(len(statements), bool)
        mut_first[of[mut]] = True
        several[of[starts(head, r"[(\[{,]")]] = True
        keep = ~(is_let & mut)
        head, of, n, is_let, is_pub = (x[keep] for x in (head, of, n, is_let, is_pub))
        mut_first, several = mut_first[of], several[of]
        following, prior = self.near(1)[head], self.near(-1)[head]
        prior = np.where((n == 1) | (mut_first & (n == 2)), -1, prior)
        plain = ~several & (n == np.where(mut_first, 2, 1))
        constructor = (following >= 0) & self.is_("(", "{", "[")[following] & starts(head, "^[A-Z]")
        # as $ is in Java: at the end or before a last line break
        worded = starts(prior, r"[A-Za-z0-9_](?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z")
        in_pattern = several & ~self.is_("mut", "ref", "pub")[head] & ~constructor & ~starts(following, "^:") & ~worded
        const_name = (n == np.where(is_pub, 2, 1)) & starts(following, "^[:=]")
        named = (self.kind[head] == 3) & ~starts(head, "^_") & np.where(is_let, plain | in_pattern, const_name)
        head, of, is_let = head[named], of[named], is_let[named]
        first = np.unique(of * (len(self.words) + 1) + self.code[head], return_index=True)[1]
        first.sort()
        head, of, is_let = head[first], of[first], is_let[first]
        own = statements[of]
        used = np.zeros(len(head), bool)
        for binding in (is_let, ~is_let):
            chosen = np.flatnonzero(binding)
            used[chosen] = self._used(head[chosen], after[of[chosen]], scope[of[chosen]], [d[own[chosen]] for d in depths])
        columns = {
            "binding": np.where(is_let, "let", "const"), "idx": self.idx[head], "line": self.line[head], "col": self.col[head], "after": after[of] if len(statements) else of, "scope_end": scope[of] if len(statements) else of,
            **{k: d[own] for k, d in self.depth.items()}, "used": used,
        }
        if only:
            head, columns = head[~used], {k: v[~used] for k, v in columns.items()}
        return columns | {"binding": pa.array(columns["binding"].tolist(), pa.string()), "name": self.texts(head)}, head

    def _following(self, statements: np.ndarray, target: np.ndarray, depths: list[np.ndarray]) -> np.ndarray:
        """For each statement the number of the next token of a kind at its depths, FAR without one."""
        at = np.union1d(statements, np.flatnonzero(target))
        order = np.lexsort((at, *(d[at] for d in depths), self.file[at]))
        at = at[order]
        keys = [self.file[at], *(d[at] for d in depths)]
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        group, k = np.cumsum(new), np.arange(len(at))
        later = np.minimum.accumulate(np.where(target[at], k, len(at))[::-1])[::-1] if len(at) else k
        there = later < len(at)
        there &= group[np.where(there, later, 0)] == group if len(at) else there
        out = np.full(self.n, FAR, np.int64)
        out[at[there]] = self.idx[at[later[there]]]
        return out[statements]

    def _used(self, names: np.ndarray, after: np.ndarray, scope: np.ndarray, depths: list[np.ndarray]) -> np.ndarray:
        """Which of the declarations at places are used: see syntax.unused()."""
        used = np.zeros(len(names), bool)
        if not len(names):
            return used
        width = len(self.words) + 1
        key = self.file * width + self.code
        _, name = np.unique(key[names], return_inverse=True)
        levels, level = np.unique(np.stack([name, *depths]), axis=1, return_inverse=True)
        level = np.asarray(level).reshape(-1)
        # levels stand in the order of their names
        first_level = np.searchsorted(levels[0], np.arange(name.max() + 2))
        is_use = (self.kind == 3) & np.isin(key, key[names])
        is_use[names] = False
        uses = np.flatnonzero(is_use)
        use_name = np.searchsorted(np.unique(key[names]), key[uses])
        begun = np.lexsort((names, level))
        begun_key = level[begun] * (1 << 32) + self.idx[names[begun]]
        ended = np.lexsort((after, level))
        ended_key = level[ended] * (1 << 32) + after[ended]
        rank = np.empty(len(names), np.int64)
        by_scope = np.lexsort((self.idx[names], scope))
        rank[by_scope] = np.arange(len(names))
        best = np.maximum.accumulate(level[ended] * len(names) + rank[ended]) - level[ended] * len(names)
        counts = np.diff(first_level)[use_name]
        total = np.cumsum(counts)
        at = 0
        while at < len(uses):
            # whole uses, as many as have about MOST_PAIRS
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MOST_PAIRS, "right")))
            n = counts[at:to]
            use = np.repeat(np.arange(at, to), n)
            lv = np.repeat(first_level[use_name[at:to]], n) + np.arange(len(use)) - np.repeat(np.cumsum(n) - n, n)
            number = self.idx[uses[use]]
            i = np.searchsorted(ended_key, lv * (1 << 32) + number, "right") - 1
            there = (i >= 0) & (level[ended[np.maximum(i, 0)]] == lv)
            over = by_scope[np.where(there, best[np.maximum(i, 0)], 0)]
            there &= scope[over] > number
            latest = np.full(to - at, -1)
            np.maximum.at(latest, use[there] - at, over[there])
            i = np.searchsorted(begun_key, lv * (1 << 32) + number, "right") - 1
            inside = begun[np.maximum(i, 0)]
            there = (i >= 0) & (level[inside] == lv) & (after[inside] > number) & (scope[inside] > number) & (inside > latest[use - at])
            used[inside[there]] = True
            used[latest[latest >= 0]] = True
            at = to
        return used


def _pieces(marker: str) -> list[str]:
    """The tokens of a test marker behind its #[."""
    return [t.decode() for t in tokens_in(marker.encode())]


def facts_of(files: DataFrame, kinds: tuple[str, ...], only: Only | None = None) -> DataFrame:
    """(path, a struct for each of the kinds): facts of files(path, content) that are not large, in each row one of a kind and null structs else. Null and empty contents have none."""
    ship_package(files.sparkSession)
    schema = "path string, " + ", ".join(f"{k} struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in KINDS[k].split(', '))}>" for k in kinds)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batch: Batch, kind: str, columns: dict, at: np.ndarray, paths: pa.Array, line_texts) -> Iterator[pa.RecordBatch]:
        """The facts of one kind, cut so that their texts stay below OUT_BYTES."""
        fields = arrow.field(kind).type
        row_of = np.array([r.row for r in batch.runs], np.int64)[batch.file[at]]
        size = np.full(len(at), 64)
        if only:
            lines, line_base = line_texts()
            line_at = line_base[batch.file[at]] + batch.line[at] - 1
            size = size + pc.binary_length(lines).to_numpy(zero_copy_only=False)[line_at]
        if isinstance(columns.get("args"), tuple):
            opened, closed = columns["args"]
            size = size + np.where(closed >= 0, batch.start[closed] - batch.start[opened], 0)
        total, begin = np.cumsum(size), 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + OUT_BYTES, "right")))
            part, arrays = slice(begin, end), []
            for field in fields:
                values = columns.get(field.name)
                if field.name == "text":
                    array = lines.take(pa.array(line_at[part])).view(pa.string()) if only else pa.nulls(end - begin, field.type)
                elif isinstance(values, tuple):
                    spans = zip(batch.file[at[part]], batch.start[opened[part]], batch.start[closed[part]], closed[part])
                    array = pa.array([batch.contents[f][a + 1 : b] if there >= 0 else None for f, a, b, there in spans], pa.binary()).view(pa.string())
                else:
                    array = values[part] if isinstance(values, pa.Array) else pa.array(values[part])
                arrays.append(array.cast(field.type))
            struct = pa.StructArray.from_arrays(arrays, fields=list(fields))
            yield pa.record_batch([paths.take(pa.array(row_of[part])), *(struct if k == kind else pa.nulls(end - begin, arrow.field(k).type) for k in kinds)], schema=arrow)
            begin = end

    def told(runs: list[Run], contents: list[bytes], paths: pa.Array) -> Iterator[pa.RecordBatch]:
        batch, held = Batch(runs, contents), []

        def line_texts() -> tuple[pa.Array, np.ndarray]:
            """Lines as lexer.lines_of() has them, and where each file's begin."""
            if not held:
                parts = [c.split(b"\n") for c in contents]
                for p in parts:
                    if len(p) > 1 and not p[-1]:
                        p.pop()
                        p[-1] += b"\n"
                held.extend((pa.array([x for p in parts for x in p], pa.binary()), np.cumsum([0, *map(len, parts)])))
            return held[0], held[1]

        if "calls" in kinds:
            yield from rows(batch, "calls", *batch.calls(only), paths, line_texts)
        if "chains" in kinds or "chained" in kinds:
            for kind, found in zip(("chains", "chained"), batch.chain_calls(only)):
                if kind in kinds:
                    yield from rows(batch, kind, *found, paths, line_texts)
        if "tests" in kinds:
            t = batch.tests()
            yield from rows(batch, "tests", {"line": batch.line[t["marker"]], "end_line": batch.line[t["close"]], "open_idx": batch.idx[t["open"]], "close_idx": batch.idx[t["close"]]}, t["marker"], paths, line_texts)
        if "declared" in kinds:
            yield from rows(batch, "declared", *batch.declared(only), paths, line_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, runs, contents, size = batch.column(0), [], [], 0
            for row, content in enumerate(batch.column(1).cast(pa.binary())):
                content = content.as_py()
                if content:
                    runs.append(Run(row, Base(), [], tokens_in(content), []))
                    contents.append(content)
                    size += len(content)
                if size >= BATCH_BYTES:
                    yield from told(runs, contents, paths)
                    runs, contents, size = [], [], 0
            if runs:
                yield from told(runs, contents, paths)

    return files.select("path", "content").mapInArrow(run, schema)
