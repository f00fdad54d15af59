"""Token counts of a byte-level BPE tokenizer, by deterministic transducers.

The tokenizer is compiled into two machines.

* The cutter reads characters and emits where words begin. It has nine states, so the whole of what a chunk of text does is one small map from the state
  before it to the state after it. All chunks of a slice are run side by side from every state; their maps are composed by a parallel prefix scan, which
  gives the state before each chunk, and a second pass emits.
* The merger reads the bytes of one word; each transition is annotated with the number of tokens by which the word's encoding grows. Its states are made when
  they are first met. An encoding is the chain of tokens in which every two neighbours are encoded as themselves when put together, and the last token of a prefix
  follows the whole encoding of what is before it; so a state is the set of beginnings of tokens that end here, each with the token before it and
  the number of tokens since.

No list of tokens is made.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from codequarry.llm.tables import by_slices

#: bytes of text that are counted together, characters in a chunk
SLICE_BYTES = 1 << 20
CHUNK = 128
#: transitions and words that a worker holds at most; they are made anew when there are more
MOST_STEPS = 400_000
MOST_WORDS = 200_000

# ---- the cutter

#: classes of characters; END stands after each text. ONE, PAIR, E and ELL are the letters of 's 't 'm 'd, 're 've and 'll
END, LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, ONE, PAIR, E, ELL = range(11)
LETTERS = (LETTER, ONE, PAIR, E, ELL)
#: states: nothing before that belongs to a word; inside a word of letters, of numbers, of others; after white space that ends with a space, with another;
#: after a quote that begins a word; after such a quote and r or v, and l
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, AT_QUOTE, AT_PAIR, AT_ELL = range(9)
STATES = 9
#: what a transition emits: a word begins at this character, at the one before
HERE, BEFORE = 1, 2


def _kind(c: int) -> int:
    """The state after a word of c's kind has begun with c and nothing else."""
    return IN_LETTERS if c in LETTERS else {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, QUOTE: AT_QUOTE, END: FRESH}[c]


def _transition(state: int, c: int) -> tuple[int, int]:
    """(next state, emission)."""
    if c == END:
        return FRESH, HERE | (BEFORE if state in (AT_PAIR, AT_ELL) else 0)
    white = c in (SPACE, BLANK)
    if state == FRESH:
        return _kind(c), HERE
    if state in (IN_LETTERS, IN_NUMBERS, IN_OTHERS):
        same = {IN_LETTERS: c in LETTERS, IN_NUMBERS: c == NUMBER, IN_OTHERS: c in (OTHER, QUOTE)}[state]
        return (state, 0) if same else (_kind(c), HERE)
    if state in (AFTER_SPACE, AFTER_BLANK):
        if white:
            return _kind(c), 0
        # the last white character leaves the run; a space leads the word, another stands alone
        return (IN_OTHERS if c == QUOTE else _kind(c), BEFORE) if state == AFTER_SPACE else (_kind(c), BEFORE | HERE)
    if state == AT_QUOTE:
        if c == ONE:
            return FRESH, 0
        if c in (PAIR, ELL):
            return (AT_PAIR if c == PAIR else AT_ELL), 0
        return (IN_OTHERS, 0) if c in (OTHER, QUOTE) else (_kind(c), HERE)
    if (state, c) in ((AT_PAIR, E), (AT_ELL, ELL)):
        return FRESH, 0
    after, emitted = _transition(IN_LETTERS, c)
    return after, emitted | BEFORE


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state and emission by class * STATES + state, class of each code point)."""
    table = [_transition(s, c) for c in range(11) for s in range(STATES)]
    step, emits = (np.array(x, np.uint8) for x in zip(*table))
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    every = "".join(map(chr, points))
    classes = np.full(0x110000, OTHER, np.uint8)
    # classes change with versions of Unicode: the library's own patterns tell which characters match
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        matched = np.ones(len(points), bool)
        for _, (start, end) in Split(Regex(pattern), "removed").pre_tokenize_str(every):
            matched[start:end] = False
        classes[np.array(points)[matched]] = c
    for letters, c in ((" ", SPACE), ("'", QUOTE), ("stmd", ONE), ("rv", PAIR), ("e", E), ("l", ELL)):
        classes[[ord(x) for x in letters]] = c
    return step, emits, classes


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """The composition of each row of state maps with all rows before it, the first applied first: a parallel prefix scan in log2(rows) rounds."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach], axis=1)
        reach *= 2
    return out


def word_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where words begin in a stream of character classes, as bits; the END after a text is a word of its own."""
    step, emits, _ = _machine()
    lanes = -(-len(classes) // chunk)
    padded = np.full(lanes * chunk, END, np.uint8)
    padded[: len(classes)] = classes
    # one row for each place in a chunk, so that a step reads neighbouring bytes
    rows = np.ascontiguousarray(padded.reshape(lanes, chunk).T) * np.uint8(STATES)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, lanes))
    for row in rows:
        maps = step[row + maps]
    state = np.full(lanes, FRESH, np.uint8)
    state[1:] = prefix_maps(maps.T)[:-1, FRESH]
    emitted = np.empty_like(rows)
    for n, row in enumerate(rows):
        at = row + state
        emitted[n] = emits[at]
        state = step[at]
    emitted = emitted.T.reshape(-1)[: len(classes)]
    starts = emitted & HERE != 0
    starts[:-1] |= emitted[1:] & BEFORE != 0
    return starts


# ---- the merger


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a vocabulary file stands for: visible Latin-1 characters stand for themselves, letters from U+0100 on for the others in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted({*range(0x100)} - {*visible})
    return {chr(b): b for b in visible} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


class Merger:
    """The transducer over the bytes of a word.

    Symbols 0 to 255 are bytes, 256 + k is the result of merge k. Merges must come after those that make their parts, and no two may make the same bytes.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        symbols = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.rank: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(merges):
            if a not in symbols or b not in symbols or a + b in symbols:
                raise ValueError(f"merge {n} is not of a regular byte-pair vocabulary")
            self.parts.append((symbols[a], symbols[b]))
            self.rank[symbols[a], symbols[b]] = symbols[a + b] = 256 + n
        self.left = [self._edge(s, 0) for s in range(len(self.parts))]
        self.right = [self._edge(s, 1) for s in range(len(self.parts))]
        self.children: dict[int, int] = {}
        self.token: list[int | None] = [None]
        self.inner = {0}
        for text, symbol in symbols.items():
            if len(text) > 500:
                raise ValueError("tokens of over 500 bytes are not supported")
            # merges that other merges always forestall give no token
            if self.parts[symbol] is None or not self._meet(*self.parts[symbol], symbol):
                self._add(text, symbol)
        self._clear()

    def _edge(self, symbol: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at one edge of a symbol while it is made, each with the merge that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((symbol, ends))
            if self.parts[symbol] is None:
                return out
            ends, symbol = symbol, self.parts[symbol][side]

    def _meet(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether a merge across the seam of a and b, earlier than the given one, forestalls what makes them."""
        rank = self.rank
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                made = rank.get((x, y))
                # of equal merges the left one is done first
                if made is not None and made < before and made < x_ends and made <= y_ends:
                    return True
        return False

    def _add(self, text: bytes, symbol: int) -> None:
        node, children = 0, self.children
        for b in text:
            self.inner.add(node)
            child = children.get(node << 8 | b)
            if child is None:
                child = children[node << 8 | b] = len(self.token)
                self.token.append(None)
            node = child
        self.token[node] = symbol

    def _clear(self) -> None:
        #: (node, token before, tokens since) of each beginning that ends here; before the first byte there is only the root
        self.states: list[tuple] = [((0, -1, 0),)]
        self.known = {self.states[0]: 0}
        #: state << 8 | byte to next state << 10 | growth + 512
        self.steps: dict[int, int] = {}

    def _make(self, state: int, byte: int) -> int:
        """Makes the transition."""
        found, begun = None, []
        for node, before, since in self.states[state]:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token[child]
            if token is not None and found is None and (before < 0 or not self._meet(before, token)):
                found = token, since
            if child in self.inner:
                begun.append((child, before, since))
        token, since = found
        growth = 1 - since
        after = (*((n, before, s + growth) for n, before, s in begun), (0, token, 0))
        place = self.known.get(after)
        if place is None:
            place = self.known[after] = len(self.states)
            self.states.append(after)
        made = self.steps[state << 8 | byte] = place << 10 | growth + 512
        return made

    def count(self, word: bytes) -> int:
        """Number of tokens of a word."""
        if len(self.steps) > MOST_STEPS:
            self._clear()
        get, state, total = self.steps.get, 0, 0
        for b in word:
            made = get(state << 8 | b)
            if made is None:
                made = self._make(state, b)
            state = made >> 10
            total += (made & 1023) - 512
        return total


class Counter(dict):
    """A compiled tokenizer; as a mapping, the number of tokens of the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        byte = _byte_letters()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merger = Merger([tuple(bytes(byte[c] for c in part) for part in pair) for pair in pairs])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def __missing__(self, word: bytes) -> int:
        made = self[word] = self.merger.count(word)
        return made

    def count_all(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text; a string of an added token is one."""
        if not texts:
            return np.zeros(0, np.int64)
        if len(self) > MOST_WORDS:
            self.clear()
        parts = [self.added.split(t) for t in texts] if self.added else [[t] for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        stream = "\0".join(p for x in parts for p in x) + "\0"
        points = np.frombuffer(stream.encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter((len(p) + 1 for x in parts for p in x), np.int64, int(sizes.sum()))) - 1
        classes = _machine()[2][points]
        classes[ends] = END
        first = np.flatnonzero(word_starts(classes))
        data = stream.encode()
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        places = (np.cumsum(width) - width)[first].tolist() + [len(data)]
        counts = np.fromiter(map(self.__getitem__, map(data.__getitem__, map(slice, places, places[1:]))), np.int64, len(first))
        last = np.searchsorted(first, ends)
        counts[last] = 0
        totals = np.cumsum(counts)[last]
        totals = totals[np.cumsum(sizes) - 1]
        return np.diff(totals, prepend=0) + sizes - 1


@lru_cache(maxsize=2)
def compiled(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """The kept columns with n_bytes long, n_tokens long and over_limit boolean (more tokens than limit) of each whole text.

    Counts are those of the tokenizers library for a byte-level BPE file, without tokens that it would add at the ends; the strings of added tokens inside a text count as
    one token each, as is its default. Null and empty texts have no bytes and no tokens. Rows are independent: repeated rows give repeated results, an empty table an
    empty one; columns that are not kept are not read, whatever their names. One row is counted in one task, in memory that follows the longest text.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.num_columns - 1)
        octets = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).cast(pa.int64())
        values = [(t or b"").decode("utf-8", "replace") for t in text.cast(pa.binary()).to_pylist()]
        counts = compiled(tokenizer_path).count_all(values)
        return pa.record_batch([*batch.columns[:-1], octets, pa.array(counts), pa.array(counts > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes bigint, n_tokens bigint, over_limit boolean"])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(by_slices(work, "__text", SLICE_BYTES), schema)
