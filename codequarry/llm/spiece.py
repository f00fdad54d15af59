"""SentencePiece BPE encoding that keeps source offsets, and decoding.

A text is normalised by the longest prefix that the model's compiled character map holds, recording for each
normalised byte the source byte it came from; pieces are then found on the normalised text and each piece's
byte range is projected through that record to a span of the source's UTF-8 bytes.

Pieces never run across the borders at which chunks are cut (checked against the vocabulary when the model is
loaded), so chunks are encoded apart: a batch's distinct chunks are merged together with numpy, one best merge
for each chunk a round, and the result is dealt back to the texts.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tables import by_slices

SPACE = "▁"
#: a symbol or rank is less than 2 ** BITS
BITS = 22
#: stands behind the last symbol of a chunk, and is in no pair
_NOTHING = np.int32((1 << BITS) - 1)
#: the score of what is no pair of a piece, well over all others
_NONE = np.int64(1 << 62)
#: chunks of more symbols are merged one at a time with a heap
LONG_CHUNK = 192
#: of a pair's score, what one row counts
_ROW = np.int64(1 << BITS)
#: symbols that are merged together: their scores stay in a core's cache
BLOCK_SYMBOLS = 1 << 16
#: bytes of text that are encoded together
SLICE_BYTES = 1 << 20


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes, then the NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if size else []
        self.replacements = blob[4 + size :]
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes taken) of the longest prefix of data[at:] in the map."""
        units = self.units
        if not units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node, found = offset(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (self.replacements[start : self.replacements.index(0, start)], i + 1 - at)
        return found

    def longest_all(self, data: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """longest() from all heads of data at once, none beyond its end: (start of the replacement, bytes taken), 0 taken where there is none."""
        start, taken = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        if not self.units:
            return start, taken
        units = np.array(self.units, np.int64)
        node = np.full(len(heads), self.units[0] >> 10 << ((self.units[0] & 512) >> 6))
        open_, step = np.flatnonzero(heads < ends), 0
        while len(open_):
            byte = data[heads[open_] + step].astype(np.int64)
            at = node[open_] ^ byte
            unit = units[at]
            hit = unit & 0x800000FF == byte
            open_, unit, at = open_[hit], unit[hit], at[hit]
            node[open_] = at ^ (unit >> 10 << ((unit & 512) >> 6))
            step += 1
            whole = open_[unit >> 8 & 1 == 1]
            start[whole], taken[whole] = units[node[whole]] & 0x7FFFFFFF, step
            open_ = open_[heads[open_] + step < ends[open_]]
        return start, taken


class Model:
    """A BPE model file: pieces, scores, normaliser. The file is only read; nothing is trained."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is expected")
        spec = proto.normalizer_spec
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        pieces = list(proto.pieces)
        self.size = len(pieces)
        self.end_id = next(i for i, p in enumerate(pieces) if p.type == kind.CONTROL and p.piece == proto.trainer_spec.eos_piece)
        self.unknown_id = next(i for i, p in enumerate(pieces) if p.type == kind.UNKNOWN)
        self.unknown_text = proto.trainer_spec.unk_surface.encode()
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == kind.NORMAL}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.byte_ids = np.zeros(256, np.int64)
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(self.size, bool)
        for i, p in enumerate(pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)], self.is_byte[i] = i, True
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.surface.append(b"" if p.type == kind.CONTROL else self.unknown_text if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ").encode())
        self.normal_bytes = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in pieces], np.int64)
        self._symbols(normal)
        self._merges(normal, pieces)
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+") if not any(inner.search(p) or ("\n" in p and len(p) > 1) for p in normal) else re.compile(r"(?s).+")
        self.plain = not self.charmap.units and not self.squeeze and self.escape and self.dummy_prefix and len(self.cut.pattern) > 8

    def _symbols(self, normal: dict[str, int]) -> None:
        """Characters that are pieces have the piece's id as symbol, others size + code point."""
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i

    def _merges(self, normal: dict[str, int], pieces: list) -> None:
        """Each split of a piece into two symbols, with the piece's rank by score, in open hash tables."""

        def symbol(text: str) -> int | None:
            return int(self.symbol_of[ord(text)]) if len(text) == 1 else normal.get(text)

        order = {s: r for r, s in enumerate(sorted({pieces[i].score for i in normal.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << BITS | right] = (order[pieces[i].score], i)
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter((rank << BITS + 8 | i for rank, i in pairs.values()), np.int64, len(pairs))
        self.tables: list = []
        while len(keys):
            bits = max(8, int(np.ceil(np.log2(len(keys)))) + 2)
            slots = self._slot(keys, bits)
            _, first = np.unique(slots, return_index=True)
            held, scores = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
            held[slots[first]], scores[slots[first]] = keys[first], values[first]
            self.tables.append((bits, held, scores))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def _scores(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << BITS + 8 | merged id of each pair of symbols; _NONE where the pair is no piece."""
        keys = left.astype(np.int64) << BITS | right
        out, at = np.full(len(keys), _NONE), None
        for bits, held, scores in self.tables:
            asked = keys if at is None else keys[at]
            slots = self._slot(asked, bits)
            there = held[slots]
            if at is None:
                out = np.where(there == asked, scores[slots], _NONE)
                at = np.flatnonzero((there != asked) & (there >= 0))
            else:
                hit = there == asked
                out[at[hit]] = scores[slots[hit]]
                at = at[~hit & (there >= 0)]
            if not len(at):
                break
        return out

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """Merges of one long chunk: best score first, leftmost of equals, with a heap over a linked list."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (pair := self.pairs.get(symbols[i] << BITS | symbols[j])):
                heapq.heappush(heap, (pair[0], i, symbols[i], symbols[j], pair[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], alive[j] = merged, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, a in zip(symbols, alive) if a]

    def encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, their number for each chunk)."""
        chunks = chunks.cast(pa.string())
        _, offsets, data = chunks.buffers()
        borders = np.frombuffer(offsets, np.int32, len(chunks) + 1, 4 * chunks.offset) if len(chunks) else np.zeros(1, np.int32)
        text = data[int(borders[0]) : int(borders[-1])].to_pybytes().decode() if borders[-1] else ""
        symbols = self.symbol_of[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        sizes = pa.compute.utf8_length(chunks).to_numpy().astype(np.int64)
        starts, left = np.cumsum(sizes) - sizes, sizes.copy()
        for c in np.flatnonzero(sizes > LONG_CHUNK).tolist():
            own = symbols[starts[c] : starts[c] + sizes[c]]
            out = self._merge_long(own.tolist())
            left[c] = len(out)
            own[: len(out)], own[len(out) :] = out, _NOTHING
        # chunks of about one size are merged together
        order = np.argsort(sizes, kind="stable")
        order = order[np.searchsorted(sizes[order], 2) : np.searchsorted(sizes[order], LONG_CHUNK, "right")]
        while len(order):
            some = order[-max(1, BLOCK_SYMBOLS // int(sizes[order[-1]])) :]
            self._merge_all(symbols, starts[some], left, some)
            order = order[: -len(some)]
        return self._bytes_of_others(symbols[symbols != _NOTHING], left)

    def _merge_all(self, symbols: np.ndarray, starts: np.ndarray, left: np.ndarray, own: np.ndarray) -> None:
        """Merges of the chunks own, a chunk a column, one best merge for each a round; symbols and left get what they come to.

        Only the two pairs beside a merge are looked up again. A score is the pair's rank, row and merged id, so that the least is the leftmost of the best.
        """
        height = int(left[own].max())
        row = np.arange(height)[:, None]
        there = row < left[own]
        place = np.where(there, starts + row, starts)
        grid = np.where(there, symbols[place], _NOTHING)
        symbols[place[there]] = _NOTHING
        scores = np.full(grid.shape, _NONE)
        pair = np.nonzero(there[1:])
        scores[pair] = self._scores(grid[:-1][pair], grid[1:][pair]) + pair[0] * _ROW
        while True:
            best = scores.min(axis=0)
            open_ = best < _NONE >> 1
            if not open_.all():
                closed = grid[:, ~open_]
                there = closed != _NOTHING
                symbols[(starts[~open_] + row[: len(grid)])[there]] = closed[there]
                left[own[~open_]] = np.count_nonzero(there, axis=0)
                if not open_.any():
                    return
                keep = np.flatnonzero(open_)
                own, starts, best, grid, scores = own[keep], starts[keep], best[keep], grid[:, keep], scores[:, keep]
            at = best >> BITS & 255
            column = np.arange(len(own))
            after = row[: len(grid) - 1] > at
            grid = np.where(after, grid[1:], grid[:-1])
            scores = np.where(after, scores[1:] - _ROW, scores[:-1])
            merged = (best & _ROW - 1).astype(np.int32)
            grid[at, column] = merged
            # the pairs that the new symbol begins and ends
            begins, ends = np.flatnonzero(at < len(grid) - 1), np.flatnonzero(at > 0)
            first = np.concatenate([at[begins], at[ends] - 1])
            where = np.concatenate([begins, ends])
            scores[at, column] = _NONE
            scores[first, where] = self._scores(grid[first, where], grid[first + 1, where]) + first * _ROW

    def _bytes_of_others(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_chunks()'s result from symbols: those of characters outside the vocabulary become the ids of their UTF-8 bytes."""
        others = np.flatnonzero(symbols >= self.size)
        if not len(others):
            return symbols, sizes
        kinds, which = np.unique(symbols[others], return_inverse=True)
        data = [np.frombuffer(chr(k - self.size).encode("utf-8", "surrogatepass"), np.uint8) for k in kinds.tolist()]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        width = np.ones(len(symbols), np.int64)
        width[others] = lengths[which]
        ends = np.cumsum(width)
        out = np.repeat(symbols, width)
        for k in range(4):
            ids = np.array([self.byte_ids[d[k]] if k < len(d) else 0 for d in data])
            has = lengths[which] > k
            out[(ends - width)[others[has]] + k] = ids[which[has]]
        more = np.bincount(np.searchsorted(np.cumsum(sizes), others, "right"), lengths[which] - 1, len(sizes))
        return out, sizes + more.astype(np.int64)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the offset of the source byte it came from."""
        data = text.encode("utf-8", "surrogatepass")
        out, origin, at = bytearray(), [], 0
        space = SPACE.encode() if self.escape else b" "

        def prefix(i: int) -> tuple[bytes, int]:
            found = self.charmap.longest(data, i)
            if found:
                return found
            n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            return data[i : i + n], n

        if self.squeeze:
            while at < len(data) and (p := prefix(at))[0] == b" ":
                at += p[1]
        if at == len(data):
            return "", np.array([at])
        if self.dummy_prefix:
            out += space
            origin += [at] * len(space)
        was_space = self.squeeze
        while at < len(data):
            piece, taken = prefix(at)
            while was_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                new = piece.replace(b" ", space)
                out += new
                origin += [at] * len(new)
                was_space = self.squeeze and piece.endswith(b" ")
            at += taken
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = origin[len(out)]
                del origin[len(out) :]
        return out.decode("utf-8", "surrogatepass"), np.array([*origin, at])

    def normalise_all(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """normalise() of all texts at once: the normalised texts, and their offsets in a row, one more for each text than it has normalised bytes."""
        if self.squeeze:
            pairs = [self.normalise(t) for t in texts.to_pylist()]
            return pa.array([t for t, _ in pairs], pa.string()), np.concatenate([o for _, o in pairs]) if pairs else np.empty(0, np.int64)
        borders = np.append(0, np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
        data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
        space = np.frombuffer(SPACE.encode() if self.escape else b" ", np.uint8)
        head = data & 0xC0 != 0x80
        heads = np.flatnonzero(head)
        first = np.repeat(borders[:-1], np.diff(borders))
        start, taken = self.charmap.longest_all(data, heads, np.repeat(borders[1:], np.diff(borders))[heads])
        # of prefixes that overlap the first one counts
        reach = 0
        for k in np.flatnonzero(taken).tolist():
            if heads[k] < reach:
                taken[k] = 0
            else:
                reach = int(heads[k] + taken[k])
        width = np.where(data == 32, len(space), 1)
        swaps = []
        mapped = np.flatnonzero(taken)
        if len(mapped):
            inside = np.zeros(len(data) + 1, np.int64)
            inside[heads[mapped]] += 1
            np.subtract.at(inside, heads[mapped] + taken[mapped], 1)
            inside = np.cumsum(inside[:-1]) > 0
            width[inside] = 0
            head = head & ~inside
            head[heads[mapped]] = True
            for at in np.unique(start[mapped]).tolist():
                new = self.charmap.replacements[at : self.charmap.replacements.index(0, at)].replace(b" ", space.tobytes())
                own = heads[mapped[start[mapped] == at]]
                width[own] = len(new)
                swaps.append((own, np.frombuffer(new, np.uint8)))
        lead = np.zeros(len(data), np.int64)
        filled = borders[:-1][np.diff(borders) > 0]
        lead[filled] = len(space) if self.dummy_prefix else 0
        after = np.append(0, np.cumsum(width + lead))
        place = after[1:] - width
        out = np.empty(after[-1], np.uint8)
        plain = np.flatnonzero(width == 1)
        out[place[plain]] = data[plain]
        swaps.append((np.flatnonzero((data == 32) & ~inside) if len(mapped) else np.flatnonzero(data == 32), space))
        for own, new in swaps:
            for i, byte in enumerate(new.tolist()):
                out[place[own] + i] = byte
        for i, byte in enumerate(space.tolist() if self.dummy_prefix else []):
            out[place[filled] - len(space) + i] = byte
        # a normalised byte comes from the first byte of the prefix it stands for
        source = np.maximum.accumulate(np.where(head, np.arange(len(data)), 0)) - first
        ends = after[borders]
        origin = np.insert(np.repeat(source, width + lead), ends[1:], np.diff(borders))
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)), origin

    def encode(self, texts: list[str] | pa.Array, spans: bool = True) -> tuple[np.ndarray, ...]:
        """(ids of all texts in a row, number of ids for each text, and if spans begin and end byte of each id's source span), with an end id last.

        A text's spans follow each other; the end id has an empty span at the end. Of the byte ids of one character the last has its span, as in the library.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.fill_null("")
        plain = self.plain and not pa.compute.any(pa.compute.match_substring_regex(texts, f"  |^ | $|{SPACE}")).as_py()
        if spans or not plain:
            new, origin = self.normalise_all(texts)
        if plain:
            # one chunk for each word between single spaces: cut and numbered in Arrow; nothing stands before the dummy prefix
            parts = pa.compute.split_pattern(new, SPACE) if spans else pa.compute.split_pattern(texts, " ")
            offsets = parts.offsets.to_numpy()
            chunks = np.diff(offsets) - 1 if spans else np.where(pa.compute.binary_length(texts).to_numpy() == 0, 0, np.diff(offsets))
            stays = np.repeat(chunks > 0, np.diff(offsets))
            if spans:
                stays[offsets[:-1]] = False
            coded = parts.flatten().filter(pa.array(stays)).dictionary_encode()
            ids, sizes = self.encode_chunks(pa.compute.binary_join_element_wise(SPACE, coded.dictionary, ""))
        else:
            cut = [self.cut.findall(t) for t in new.to_pylist()]
            chunks = np.fromiter(map(len, cut), np.int64, len(cut))
            coded = pa.array([c for x in cut for c in x], pa.string()).dictionary_encode()
            ids, sizes = self.encode_chunks(coded.dictionary)
        # the end id is a chunk of its own, which each text has last
        which = np.insert(coded.indices.to_numpy(), np.cumsum(chunks), len(sizes))
        ids, sizes = np.append(ids, np.int32(self.end_id)), np.append(sizes, 1).astype(np.int32)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        count = sizes[which]
        ends = np.cumsum(count, dtype=np.int32)
        flat = ids[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(starts[which] - (ends - count), count)]
        totals = np.diff(np.append(0, ends[np.cumsum(chunks + 1) - 1]).astype(np.int64))
        if not spans:
            return flat, totals
        first = np.cumsum(totals) - totals
        width = self.normal_bytes[flat]
        width[first + totals - 1] = 0
        # each text has one offset more than normalised bytes
        to = np.cumsum(width) + np.repeat(np.arange(len(totals)), totals)
        begin, end = origin[to - width], origin[to]
        return flat, totals, begin, end

    def encode_all(self, texts: pa.Array, spans: bool = True) -> tuple[np.ndarray, ...]:
        """encode(), with the texts that need no second look (single inner spaces only) apart from the rest."""
        odd = pa.compute.match_substring_regex(texts.fill_null(""), f"  |^ | $|{SPACE}").to_numpy(zero_copy_only=False)
        if not self.plain or odd.all() or not odd.any():
            return self.encode(texts, spans)
        order = np.argsort(odd, kind="stable")
        first, second = (self.encode(texts.filter(pa.array(x)), spans) for x in (~odd, odd))
        totals = np.empty(len(texts), np.int64)
        totals[order] = np.concatenate([first[1], second[1]])
        starts = np.empty(len(texts), np.int64)
        starts[order] = np.cumsum(totals[order]) - totals[order]
        ends = np.cumsum(totals)
        at = np.arange(ends[-1]) + np.repeat(starts - (ends - totals), totals)
        flat, *both = (np.concatenate([first[i], second[i]])[at] for i in ((0, 2, 3) if spans else (0,)))
        return flat, totals, *both

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, one leading space of the first piece dropped if it is the dummy prefix, bytes as UTF-8."""
        surface = self.surface
        start = next((n for n, i in enumerate(ids) if surface[i] or self.is_byte[i]), len(ids))
        data = b"".join([surface[i] for i in ids])
        if self.dummy_prefix and start < len(ids) and not self.is_byte[ids[start]] and data.startswith(b" "):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_broken(data)

    @staticmethod
    def _decode_broken(data: bytes) -> str:
        """Each byte that is part of no valid UTF-8 sequence becomes U+FFFD of its own."""
        out, at = [], 0
        while at < len(data):
            n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            try:
                out.append(data[at : at + n].decode())
                at += n
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load_model(path: str) -> Model:
    return Model(path)


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """The kept columns with ids array<int> and, if spans, begin and end array<int>: each id's span of the text's UTF-8 bytes.

    Ids are those of the model's library with an end id only and no sampling. Null and empty texts have the end
    id alone, with the span 0 to 0. Rows are independent: repeated rows give repeated results, an empty table an empty one.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load_model(model_path)
        flat, totals, *both = model.encode_all(batch.column(batch.num_columns - 1), spans)
        offsets = pa.array(np.append(0, np.cumsum(totals)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (flat, *both)]
        return pa.record_batch([*batch.columns[:-1], *lists], names=[*keep, *names])

    names = ["ids", "begin", "end"] if spans else ["ids"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`{n}` array<int>" for n in names)])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(by_slices(work, "__text", SLICE_BYTES), schema)


def decode_ids(encoded: DataFrame, model_path: str, into: str = "decoded") -> DataFrame:
    """encoded with a string column for its ids; null ids decode to the empty text."""

    def run(batches):
        model = load_model(model_path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            lists = batch.column(at)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            texts = [model.decode(flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{into}` string"])
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode_pieces() and decode_ids() in one pass: the kept columns, ids array<int>, decoded string and spans_sha256 string.

    spans_sha256 is the digest of begin and end of each id in turn, as little-endian 32-bit numbers. Ids do not leave the worker between the two.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load_model(model_path)
        flat, totals, begin, end = model.encode_all(batch.column(batch.num_columns - 1))
        offsets = np.append(0, np.cumsum(totals)).astype(np.int32)
        both = np.column_stack((begin, end)).astype("<i4")
        digests = [sha256(both[a:b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        ids = flat.astype(np.int32)
        texts = [model.decode(ids[a:b].tolist()) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return pa.record_batch([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(texts, pa.string()), pa.array(digests, pa.string())], names=[*keep, "ids", "decoded", "spans_sha256"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>", "decoded string", "spans_sha256 string"])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(by_slices(work, "__text", SLICE_BYTES), schema)
