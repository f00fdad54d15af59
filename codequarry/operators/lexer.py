"""A lexer over files: to lines and to tokens.

Tokens tile a content. They are cut where the contents are read: a worker lexes its rows in batches, and places, depths and neighbours are sums and shifts over a
batch's tokens, so contents are not dealt by path and no window runs over tokens. Long contents are lexed in pieces. Block comments nest to any depth: a counter
over their delimiters finds the end of a nested one, as no pattern can.

Files that are read in splits (sources.files.read_pieces) are lexed split by split: see tokens_of_pieces().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codequarry.session import ship_package

#: bytes of contents whose tokens are placed together; a longer content is lexed in pieces of so many
BATCH_BYTES = 1 << 20

#: comments, raw strings, strings, character literals (a lifetime's quote opens one), identifiers, white space, path separators, single characters. A comment that holds
#: another or is not closed, and a raw string with many hashes, are found by what they open with alone.
_LEX = re.compile(
    rb"//[^\n]*+|/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/|/\*"
    rb'|r"[^"]*+(?:"|\Z)|r#"(?:[^"]++|"(?!#))*+(?:"#|"?\Z)|r##+"'
    rb"|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+(?:\"|\\?\Z)|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\Z)"
    rb"|[A-Za-z_][A-Za-z0-9_]*+|[ \t\r\n\f]++|::|[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*+|[\x80-\xbf]++",
    re.S,
)
_FENCE = re.compile(rb"/\*|\*/")
_REST = {b'"': re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S), b"'": re.compile(rb"[^'\\]*+(?:\\.[^'\\]*+)*+'", re.S)}
_BLANK = re.compile(rb"[ \t\r\n\f]*")
_OPENER = re.compile(rb'r(##+)"')


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text) of files(path, content).

    A newline at the end of the content starts no line; the last line then keeps it. Empty content has one empty line, null content none.
    """
    parts = F.split("content", "\n", -1)
    ended = F.col("content").endswith("\n")
    whole = F.when(ended, F.concat(F.slice(parts, 1, F.size(parts) - 2), F.array(F.concat(F.element_at(parts, -2), F.lit("\n"))))).otherwise(parts)
    return files.select("path", F.posexplode(whole).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def with_neighbours(lines: DataFrame, before: int, after: int) -> DataFrame:
    """lines with arrays `before` and `after` of the texts of up to so many lines around each, in line order; none beyond the file's ends."""
    window = Window.partitionBy("path").orderBy("line")
    earlier = [F.lag("text", n).over(window) for n in range(before, 0, -1)]
    later = [F.lead("text", n).over(window) for n in range(1, after + 1)]
    return lines.withColumn("before", F.array_compact(F.array(*earlier))).withColumn("after", F.array_compact(F.array(*later)))


def token_index(content: Column) -> Column:
    """The distinct identifiers of a content, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0), F.lower))


# ---- cutting


def comment_end(data: bytes, at: int, depth: int) -> tuple[int, int]:
    """(where a block comment ends that is depth deep at a place, 0), or (end of the data, depth there)."""
    for fence in _FENCE.finditer(data, at):
        depth += 1 if fence.group() == b"/*" else -1
        if not depth:
            return fence.end(), 0
    return len(data), depth


def _opened(data: bytes, at: int, opener: bytes) -> int:
    """Where the token ends that begins with a `/*` or with a raw string's opener."""
    if opener == b"/*":
        return comment_end(data, at + 2, 1)[0]
    closing = b'"' + b"#" * (len(opener) - 2)
    found = data.find(closing, at + len(opener))
    return len(data) if found < 0 else found + len(closing)


def each_token(data: bytes, at: int = 0) -> Iterator[bytes]:
    """The tokens from a place on, one by one."""
    while at < len(data):
        for match in _LEX.finditer(data, at):
            token = match.group()
            if token == b"/*" or _OPENER.fullmatch(token):
                at = _opened(data, match.start(), token)
                yield data[match.start() : at]
                break
            yield token
        else:
            return


def tokens_in(data: bytes) -> list[bytes]:
    found = _LEX.findall(data)
    if b"/*" in found or (b"r##" in data and any(map(_OPENER.fullmatch, found))):
        return list(each_token(data))
    return found


def token_runs(content: bytes, most_bytes: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """The tokens of a content, lexed in pieces of about most_bytes; a token that goes on beyond a piece is lexed again with a longer one."""
    at, size = 0, most_bytes
    while at < len(content):
        tokens = tokens_in(content[at : at + size])
        if at + size < len(content):
            # what the piece's end may have cut: its last token, and the beginning of a raw string
            n = len(tokens) - 1
            while n > 0 and tokens[n - 1] == b"#":
                n -= 1
            n -= n > 0 and tokens[n - 1] == b"r"
            tokens = tokens[:n]
            if not tokens:
                size *= 2
                continue
        yield tokens
        at += sum(map(len, tokens))
        size = most_bytes


# ---- placing


class Base(NamedTuple):
    """What stands before a run of tokens: their number, bytes and newlines, the byte at which the line began, the depths of (), [] and {}, and the last statement's beginning."""

    idx: int = 0
    start: int = 0
    newlines: int = 0
    line_start: int = 0
    parens: int = 0
    brackets: int = 0
    braces: int = 0
    statement: int = -1
    word: bytes = b"="


class Run(NamedTuple):
    """Tokens of one file that follow each other, with up to two neighbours on either side."""

    row: int
    base: Base
    left: list[bytes]
    tokens: list[bytes]
    right: list[bytes]


_KINDS = np.array(["mark", "comment", "literal", "ident", "space"])
_FIRST = np.zeros(256, np.uint8)
_FIRST[[ord(c) for c in "\"'"]] = 2
_FIRST[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"]] = 3
_FIRST[[9, 10, 12, 13, 32]] = 4
TOKEN_SCHEMA = "path string, idx int, text string, kind string, start bigint, end bigint, line int, col int, gap string, parens bigint, brackets bigint, braces bigint"


class Placed:
    """The columns of runs of tokens, as arrays over all of them; `real` marks those that are no neighbours."""

    def __init__(self, runs: list[Run]):
        sizes_of = [len(r.left) + len(r.tokens) + len(r.right) for r in runs]
        self.text = pa.array([t for r in runs for part in (r.left, r.tokens, r.right) for t in part], pa.binary())
        self.run = np.repeat(np.arange(len(runs)), sizes_of)
        within = np.arange(len(self.run)) - np.repeat(np.cumsum(sizes_of) - sizes_of, sizes_of)
        left = np.array([len(r.left) for r in runs], np.int64)[self.run]
        many = np.array([len(r.tokens) for r in runs], np.int64)[self.run]
        self.real = (within >= left) & (within < left + many)
        self.within, self.last = within, np.array(sizes_of, np.int64)[self.run] - 1
        self.base = {f: np.array([getattr(r.base, f) for r in runs], np.int64) for f in Base._fields[:-1]}
        offsets = np.frombuffer(self.text.buffers()[1], np.int32)[: len(self.text) + 1].astype(np.int64)
        buffer = np.frombuffer(self.text.buffers()[2] or b"", np.uint8)[: offsets[-1] if len(offsets) else 0]
        at, end = offsets[:-1], offsets[1:]
        self.size = end - at
        self.first = buffer[at]
        second = np.where(self.size > 1, buffer[np.minimum(at + 1, max(len(buffer) - 1, 0))], 0)
        kind = _FIRST[self.first]
        kind[(self.first == 47) & (self.size > 1)] = 1
        kind[(self.first == 114) & ((second == 34) | (second == 35))] = 2
        self.kind = kind
        self.idx = within - left + self.base["idx"][self.run]
        self.start = self.sums(self.size, "start")
        newline = buffer == 10
        breaks = np.append(0, np.cumsum(newline))
        self.newlines = breaks[end] - breaks[at]
        self.line = 1 + self.sums(self.newlines, "newlines")
        # the last newline before a token, if it stands in this run
        last_break = np.append(0, np.maximum.accumulate(np.where(newline, np.arange(1, len(buffer) + 1), 0)))[at]
        run_at = at - (self.start - self.base["start"][self.run])
        line_start = np.where(last_break > run_at, self.base["start"][self.run] + last_break - run_at, self.base["line_start"][self.run])
        self.col = self.start - line_start + 1
        one = self.size == 1
        self.depths = {name: self.sums(np.where(one & (self.first == a), 1, 0) - np.where(one & (self.first == b), 1, 0), name) for name, a, b in (("parens", 40, 41), ("brackets", 91, 93), ("braces", 123, 125))}
        equals = np.append(0, np.cumsum(buffer == 61))
        self.has_equals = equals[end] > equals[at]

    def sums(self, values: np.ndarray, base: str) -> np.ndarray:
        """The sum of the values of the run's real tokens before each token, on top of the base."""
        values = np.where(self.real, values, 0)
        before = np.cumsum(values) - values
        starts = np.flatnonzero(self.within == 0)
        return before - np.repeat(before[starts], np.diff(np.append(starts, len(values)))) + self.base[base][self.run]

    def neighbour(self, step: int, over_space: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether there is one) of the token next to each, or with over_space of the next that is not white space."""
        place = np.arange(len(self.run)) + step
        there = (self.within + step >= 0) & (self.within + step <= self.last)
        if over_space:
            jump = there & (self.kind[np.where(there, place, 0)] == 4)
            place = np.where(jump, place + step, place)
            there &= ~jump | ((self.within + 2 * step >= 0) & (self.within + 2 * step <= self.last))
        return place, there

    def texts(self, place: np.ndarray, there: np.ndarray) -> pa.Array:
        return self.text.take(pa.array(np.where(there, place, 0), mask=~there))

    def space(self, step: int) -> pa.Array:
        """The white space next to each token, "" if there is none."""
        place, there = self.neighbour(step, False)
        there = there & (self.kind[np.where(there, place, 0)] == 4)
        return self.texts(place, there).fill_null(b"")

    def columns(self, runs: list[Run], paths: pa.Array) -> dict[str, pa.Array]:
        rows = np.array([r.row for r in runs], np.int64)[self.run]
        return {
            "path": paths.take(pa.array(rows)), "idx": pa.array(self.idx.astype(np.int32)), "text": self.text.view(pa.string()), "kind": pa.DictionaryArray.from_arrays(pa.array(self.kind.astype(np.int8)), pa.array(_KINDS.tolist())).cast(pa.string()),
            "start": pa.array(self.start), "end": pa.array(self.start + self.size), "line": pa.array(self.line.astype(np.int32)), "col": pa.array(self.col.astype(np.int32)),
            "gap": self.space(-1).view(pa.string()), **{k: pa.array(v) for k, v in self.depths.items()},
        }

    def after(self, runs: list[Run]) -> list[Base]:
        """The base of what follows each run; statement and word as they were."""
        out = []
        for n, r in enumerate(runs):
            if not r.tokens:
                out.append(r.base)
                continue
            i = int(np.flatnonzero((self.run == n) & self.real)[-1]) if len(runs) > 1 else len(self.run) - 1 - len(r.right)
            token = r.tokens[-1]
            end = int(self.start[i]) + len(token)
            tail = token.rfind(b"\n")
            step = {k: int(v[i]) for k, v in self.depths.items()}
            for name, pair in (("parens", b"()"), ("brackets", b"[]"), ("braces", b"{}")):
                step[name] += (token == pair[:1]) - (token == pair[1:])
            out.append(r.base._replace(idx=int(self.idx[i]) + 1, start=end, newlines=int(self.line[i]) - 1 + token.count(b"\n"), line_start=end - len(token) + tail + 1 if tail >= 0 else int(self.start[i] - self.col[i] + 1), **step))
        return out


def _over_runs(files: DataFrame, work, schema: str) -> DataFrame:
    """work(placed, runs, paths, carried) over the tokens of files(path, content), in batches; it gives a record batch. carried: a dict that lives as long as one content."""
    ship_package(files.sparkSession)

    def one(run: Run, paths: pa.Array, carried: dict) -> tuple[pa.RecordBatch, Base]:
        placed = Placed([run])
        out = work(placed, [run], paths, carried)
        (base,) = placed.after([run])
        return out, base._replace(**{k: carried[k] for k in ("statement", "word") if k in carried})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0)
            held, size = [], 0
            for row, content in enumerate(batch.column(1).cast(pa.binary())):
                content = content.as_py()
                if not content:
                    continue
                if len(content) <= BATCH_BYTES:
                    held.append(Run(row, Base(), [], tokens_in(content), []))
                    size += len(content)
                else:
                    # one run behind, for the neighbours on the right
                    base, left, tokens, carried = Base(), [], None, {}
                    for following in [*_lookahead(content), []]:
                        if tokens is not None:
                            out, base = one(Run(row, base, left, tokens, following[:2]), paths, carried)
                            yield out
                            left = [*left, *tokens][-2:]
                        tokens = following
                if size >= BATCH_BYTES:
                    yield work(Placed(held), held, paths, {})
                    held, size = [], 0
            if held:
                yield work(Placed(held), held, paths, {})

    return files.select("path", "content").mapInArrow(run, schema)


def _lookahead(content: bytes) -> Iterator[list[bytes]]:
    """Runs of at least two tokens, but for the last."""
    held: list[bytes] = []
    for tokens in token_runs(content):
        held += tokens
        if len(held) > 1:
            yield held
            held = []
    if held:
        yield held


def tokens_of(files: DataFrame) -> DataFrame:
    """Tokens of files(path, content) without white space: path, idx, text, kind, start and end (byte offsets), line, col, gap and the depths of (), [] and {} before the token.

    kind is comment, literal, ident or mark; line and col count from 1, col in bytes. gap is the white space before the token, "" if there is none. idx also counts white space, so neighbours
    that touch have consecutive numbers. Nothing is shuffled. Null and empty contents have no tokens; rows are independent.
    """

    def work(placed: Placed, runs: list[Run], paths: pa.Array, carried: dict) -> pa.RecordBatch:
        return pa.record_batch(placed.columns(runs, paths)).filter(pa.array(placed.real & (placed.kind != 4)))

    return _over_runs(files, work, TOKEN_SCHEMA)


def heads(placed: Placed, runs: list[Run], carried: dict) -> dict:
    """What statements_of() tells of each token, white space included, as arrays by name."""
    text, real, kind = placed.text, placed.real, placed.kind
    coded = text.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def code_of(word: bytes) -> int:
        return words.index(word).as_py()

    before, after = placed.neighbour(-1, True), placed.neighbour(1, True)
    gap_place, gap_there = placed.neighbour(1, False)
    gap_after = placed.space(1)
    spaced = gap_there & (kind[np.where(gap_there, gap_place, 0)] == 4) & (placed.first[np.where(gap_there, gap_place, 0)] == 32)
    prior, prior_there = placed.neighbour(-1, False)
    prior = np.where(prior_there, prior, 0)
    broken = prior_there & (kind[prior] == 4) & (placed.newlines[prior] > 0)
    next_code = np.where(after[1], code[np.where(after[1], after[0], 0)], -1)
    starts = (code == code_of(b"let")) | (code == code_of(b"const")) | ((code == code_of(b"pub")) & (next_code == code_of(b"const")) & (code_of(b"const") >= 0))
    begins = real & starts & spaced & (broken | ~before[1])
    marked = begins | (real & placed.has_equals & (kind != 1))
    # the last mark so far, of this run or of what was before it
    place = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
    first = np.arange(len(marked)) - placed.within
    own = place >= first
    at = np.where(own, place, 0)
    statement = np.where(own, np.where(begins[at], placed.idx[at], -1), placed.base["statement"][placed.run])
    in_head = real & ~begins & (statement >= 0)
    base_words = pa.array([r.base.word for r in runs], pa.binary()).take(pa.array(placed.run))
    word = pa.compute.if_else(pa.array(own), text.take(pa.array(at)), base_words)
    rows = np.array([r.row for r in runs], np.int64)[placed.run]
    ident = real & (kind == 3)
    key = rows * (len(words) + 1) + code
    is_use = ident & np.isin(key, key[ident & in_head])
    if len(runs) == 1 and runs[0].base.idx + len(runs[0].right):
        # a long content: names of earlier pieces too
        names = carried.setdefault("names", set())
        names.update(text.filter(pa.array(ident & in_head)).to_pylist())
        is_use |= ident & pa.compute.is_in(text, pa.array(list(names), pa.binary())).to_numpy(zero_copy_only=False)
        last = np.flatnonzero(real)[-1]
        carried["statement"], carried["word"] = int(statement[last]), word[last].as_py()
    return {
        "before": placed.texts(*before), "after": placed.texts(*after), "gap_after": gap_after, "begins": begins, "statement": statement, "word": word, "in_head": in_head, "is_use": is_use,
        "ends": (code == code_of(b";")) | (code == code_of(b"}")),
    }


def statements_of(files: DataFrame) -> DataFrame:
    """What declarations and their uses are made of, from one pass over the tokens: path, idx, text, kind, line, col, depths, before, after, gap_after, begins, statement_idx, word, in_head, is_use.

    begins: the token begins a line with let, const or pub const. in_head: it stands after such a beginning (statement_idx, and word, its text) and before the first token
    with =. Besides these, every ; and } is there. is_use: an identifier that stands in some head of the file, wherever it stands. before, gap_after and
    after: the tokens around, null if there are none, and the white space behind.
    """

    def work(placed: Placed, runs: list[Run], paths: pa.Array, carried: dict) -> pa.RecordBatch:
        h = heads(placed, runs, carried)
        columns = placed.columns(runs, paths)
        kept = placed.real & (placed.kind != 4) & (h["begins"] | h["in_head"] | h["is_use"] | h["ends"])
        columns |= {
            "before": h["before"].view(pa.string()), "after": h["after"].view(pa.string()), "gap_after": h["gap_after"].view(pa.string()), "begins": pa.array(h["begins"]),
            "statement_idx": pa.array(h["statement"].astype(np.int32)), "word": h["word"].view(pa.string()), "in_head": pa.array(h["in_head"]), "is_use": pa.array(h["is_use"]),
        }
        return pa.record_batch({k: v for k, v in columns.items() if k not in ("start", "end", "gap")}).filter(pa.array(kept))

    schema = "path string, idx int, text string, kind string, line int, col int, parens bigint, brackets bigint, braces bigint, before string, after string, gap_after string, begins boolean, statement_idx int, word string, in_head boolean, is_use boolean"
    return _over_runs(files, work, schema)


# ---- files in pieces

#: between pieces: code that nothing goes on from, code after white space, and open tokens: strings by their quote, comments with their depth, raw strings with their hashes
CODE, SPACED = "", "s"
MAP_SCHEMA = "path string, block bigint, piece int, size bigint, n_bytes bigint, newlines bigint, line_start bigint, depth bigint, maps array<struct<before:string,after:string,tokens:bigint,parens:bigint,brackets:bigint,braces:bigint,tail:string>>"
ENTRY_SCHEMA = "path string, block bigint, piece int, ordinal bigint, state string, idx bigint, start bigint, newlines bigint, line_start bigint, parens bigint, brackets bigint, braces bigint, gap string, parts boolean, cut_last boolean"


def resume(data: bytes, state: str) -> tuple[int, str]:
    """(where the token ends that is open before data, CODE), or (end of data, its state there)."""
    if state in (CODE, SPACED):
        return 0, state
    if state.encode() in _REST:
        found = _REST[state.encode()].match(data)
        return (found.end(), CODE) if found else (len(data), state)
    if state[0] == "b":
        end, depth = comment_end(data, 0, int(state[1:]))
        return end, f"b{depth}" if depth else CODE
    closing = b'"' + b"#" * int(state[1:])
    found = data.find(closing)
    return (len(data), state) if found < 0 else (found + len(closing), CODE)


def state_after(token: bytes) -> str:
    """The state behind a token that ends a piece."""
    if token[:1] in _REST:
        closed = len(token) > 1 and _REST[token[:1]].fullmatch(token, 1)
        return CODE if closed else token[:1].decode()
    if token[:2] == b"/*":
        depth = comment_end(token, 2, 1)[1]
        return f"b{depth}" if depth else CODE
    if token[:2] in (b'r"', b"r#"):
        hashes = token.index(b'"') - 1
        return CODE if len(token) >= 2 * hashes + 3 and token.endswith(b'"' + b"#" * hashes) else f"r{hashes}"
    return SPACED if _BLANK.fullmatch(token) else CODE


def _steps(tokens: list[bytes]) -> np.ndarray:
    """The change of (), [] and {} depth over tokens."""
    n = {c: 0 for c in (b"(", b")", b"[", b"]", b"{", b"}")}
    for t in tokens:
        if t in n:
            n[t] += 1
    return np.array([n[b"("] - n[b")"], n[b"["] - n[b"]"], n[b"{"] - n[b"}"]])


def piece_maps(data: bytes) -> list[tuple]:
    """(state before, state after, tokens begun, depth changes, last white space if the piece ends in it) for every state that data can end or change.

    A comment deeper than data's unmatched */ and a raw string with more hashes than any quote of data has go on through it and are left out.
    """
    depth = least = 0
    for fence in _FENCE.findall(data):
        depth += 1 if fence == b"/*" else -1
        least = min(least, depth)
    quotes = re.findall(rb'"(#*)', data)
    states = [CODE, SPACED, '"', "'", *(f"b{n}" for n in range(1, 1 - least)), *(f"r{n}" for n in range(max(map(len, quotes)) + 1 if quotes else 0))]
    base = tokens_in(data)
    starts = np.cumsum([0, *map(len, base)])
    lexed = {0: base}

    def tokens_from(at: int) -> list[bytes]:
        """The tokens from a place on; where they meet those from the beginning they are the same."""
        if at not in lexed:
            own, place = [], at
            for token in each_token(data, at):
                own.append(token)
                place += len(token)
                n = int(np.searchsorted(starts, place))
                if starts[n] == place:
                    own += base[n:]
                    break
            lexed[at] = own
        return lexed[at]

    out = []
    for state in states:
        at, after = resume(data, state)
        if after not in (CODE, SPACED):
            out.append((state, after, 0, 0, 0, 0, None))
            continue
        tokens = tokens_from(at)
        begun = tokens[1:] if state == SPACED and tokens and _BLANK.fullmatch(tokens[0]) else tokens
        after = state_after(begun[-1]) if begun else state if tokens else after
        tail = begun[-1].decode() if begun and after == SPACED else None
        out.append((state, after, len(begun), *_steps(begun).tolist(), tail))
    return out


def _entries(maps: DataFrame) -> DataFrame:
    """What stands before each piece: the maps of a file's pieces composed in order. Only these small rows are shuffled, by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in ENTRY_SCHEMA.split(", ")]
        rows = (r for b in batches for r in b.to_pylist())
        for path, pieces in groupby(rows, key=itemgetter("path")):
            state, base, gap, out, total, size = CODE, Base(), "", [], 0, None
            for ordinal, p in enumerate(pieces):
                total, size = total + p["n_bytes"], p["size"]
                known = next((m for m in p["maps"] if m["before"] == state), None)
                if known is None:
                    after = f"b{int(state[1:]) + p['depth']}" if state[0] == "b" else state
                    known = {"after": after, "tokens": 0, "parens": 0, "brackets": 0, "braces": 0, "tail": None}
                opened = [s not in (CODE, SPACED) for s in (state, known["after"])]
                out.append((path, p["block"], p["piece"], ordinal, state, base.idx, base.start, base.newlines, base.line_start, base.parens, base.brackets, base.braces, gap, any(opened), False))
                if known["after"] != SPACED:
                    gap = ""
                else:
                    # white space alone goes on
                    gap = known["tail"] if known["tail"] is not None else gap + p["maps"][0]["tail"]
                base = Base(
                    base.idx + known["tokens"], base.start + p["n_bytes"], base.newlines + p["newlines"], base.start + p["line_start"] if p["newlines"] else base.line_start,
                    *(getattr(base, k) + known[k] for k in ("parens", "brackets", "braces")),
                )
                state = known["after"]
            if size is not None and total > size:
                # lines were read with a newline each; the file's last line has none
                out[-1] = (*out[-1][:-1], True)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], entry_arrow)

    entry_arrow = to_arrow_schema(StructType.fromDDL(ENTRY_SCHEMA))
    return maps.repartition("path").sortWithinPartitions("path", "block", "piece").mapInArrow(run, ENTRY_SCHEMA)


def _tokens_after(entered: DataFrame, parts: bool) -> DataFrame:
    """Tokens of pieces with their entries: those that lie whole in a piece, or the parts of the others, with part, the piece's number in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0)
            for row, r in enumerate(batch.to_pylist()):
                data = r["content"].encode()
                data = data[:-1] if r["cut_last"] else data
                at, state = resume(data, r["state"])
                base = Base(*(r[k] for k in Base._fields[:-2]))
                continued = data[:at] if at else b""
                tokens = tokens_in(data[at:]) if state in (CODE, SPACED) else []
                left = [r["gap"].encode()] if r["gap"] else []
                if r["state"] == SPACED and tokens and _BLANK.fullmatch(tokens[0]):
                    at += len(tokens[0])
                    left = [left[0] + tokens[0]]
                    tokens = tokens[1:]
                passed = data[:at]
                tail = passed.rfind(b"\n")
                base = base._replace(start=base.start + at, newlines=base.newlines + passed.count(b"\n"), line_start=base.start + tail + 1 if tail >= 0 else base.line_start)
                if parts and continued:
                    yield pa.RecordBatch.from_pylist([{"path": r["path"], "idx": base.idx - 1, "text": continued.decode(), "part": r["ordinal"]}], part_arrow)
                if not tokens:
                    continue
                run_ = [Run(row, base, left, tokens, [])]
                placed = Placed(run_)
                open_ = np.zeros(len(placed.run), bool)
                open_[-1] = state_after(tokens[-1]) not in (CODE, SPACED)
                columns = placed.columns(run_, paths) | {"part": pa.array(np.full(len(open_), r["ordinal"]), mask=~open_)}
                yield pa.record_batch(columns).filter(pa.array(placed.real & (placed.kind != 4) & (open_ if parts else ~open_)))

    schema = f"{TOKEN_SCHEMA}, part bigint"
    part_arrow = to_arrow_schema(StructType.fromDDL(schema))
    return entered.mapInArrow(run, schema)


def tokens_of_pieces(pieces: DataFrame) -> DataFrame:
    """tokens_of() the files that are cut into pieces(path, block, piece, content, size): lexed apart, wherever they are.

    A file's pieces follow each other by block and piece and end with a newline, but for its last one. size is the file's bytes, or null if contents are exact: where the pieces have
    a byte more, the last newline is not the file's. Each piece gives a small map from lexer states before it to states and counts behind it; a prefix scan over a file's maps
    gives what stands before each piece, and the piece is lexed from there. Tokens that lie in several pieces are put together; their parts and the maps are all that is dealt by path.
    Contents meet their entries in a join, which moves neither side as long as Spark's limit for broadcasts holds all entries.
    """
    ship_package(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("before", "after", "tokens", "parens", "brackets", "braces", "tail")
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = r["content"].encode()
                fences = _FENCE.findall(data)
                out.append(
                    {k: r[k] for k in ("path", "block", "piece", "size")} | {"n_bytes": len(data), "newlines": data.count(b"\n"), "line_start": data.rfind(b"\n") + 1, "depth": sum(1 if f == b"/*" else -1 for f in fences)}
                    | {"maps": [dict(zip(keys, m)) for m in piece_maps(data)]}
                )
            yield pa.RecordBatch.from_pylist(out, map_arrow)

    map_arrow = to_arrow_schema(StructType.fromDDL(MAP_SCHEMA))
    contents = pieces.select("path", "block", "piece", "content", "size").where("content is not null and content <> ''")
    entries = _entries(contents.mapInArrow(run, MAP_SCHEMA))
    whole = _tokens_after(contents.drop("size").join(entries, ["path", "block", "piece"]), False).drop("part")
    parts = _tokens_after(contents.drop("size").join(entries.where("parts"), ["path", "block", "piece"]), True)
    others = [c for c in whole.columns if c not in ("path", "idx", "text")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "")
    joined = parts.groupBy("path", "idx").agg(text.alias("text"), *(F.max(c).alias(c) for c in others))
    joined = joined.withColumn("end", F.col("start") + F.octet_length("text"))
    return whole.unionByName(joined.select(*whole.columns))
