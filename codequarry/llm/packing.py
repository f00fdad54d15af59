"""Packing token ids into fixed rows: best-fit-decreasing, with a segment tree over free capacities.

Each document is encoded and cut, without loss, into pieces of at most `length` ids. Full pieces are rows as they are. The others are packed by falling
length, each into the row with the least free room that still holds it; a segment tree over the capacities 0..length counts the open rows of each, so
the search is one walk up and down the tree. A row of the result is a row of the id matrix with its segments: cumulative lengths, positions that restart with
each segment, and the document and offset that each segment came from, from which every document can be put together again.

A task packs the documents that it reads, WINDOW_IDS at a time; rows that a window leaves emptier than FULL_SHARE hand their pieces to the next one. Nothing is
shuffled, and memory is bounded by the window whatever the documents.

write_matrices() writes the rows as binary files with a manifest, and read_matrices() reads them back, file by file and block by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import spiece
from codequarry.llm.tables import slices
from codequarry.storage import remove_at_exit, shared_dir

ROW_IDS = 2048
WINDOW_IDS = 1 << 20
FULL_SHARE = 0.97
PAD_ID = 0
#: rows that are written, and read back, together
BLOCK_ROWS = 256
#: bytes of text that are encoded together; a word that they repeat is encoded once
ENCODE_BYTES = 8 << 20


class Capacities:
    """Counts of open rows by free capacity, in a segment tree."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of an open row with the smallest capacity that is not under least; the row is taken out."""
        count, at = self.count, least + self.leaves
        if not count[at]:
            while at > 1 and not (at % 2 == 0 and count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers, each of at most length ids in all; pieces of equal size in their given order."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_rows.take(sizes[piece])
        if found is None:
            rows.append([])
            found = (length, len(rows) - 1)
        capacity, row = found
        rows[row].append(piece)
        open_rows.add(capacity - sizes[piece], row)
    return rows


#: a piece: document, offset of its first id in the document, ids
Piece = tuple[object, int, np.ndarray]


def pack(pieces: Iterator[list[Piece]], length: int, window: int = WINDOW_IDS) -> Iterator[list[Piece]]:
    """Rows of pieces from lists of them; no piece is longer than length or empty."""
    held: list[Piece] = []
    size = 0

    def settle(last: bool) -> Iterator[list[Piece]]:
        nonlocal held, size
        rows = best_fit_decreasing([len(p[2]) for p in held], length)
        left: list[Piece] = []
        for row in rows:
            own = [held[i] for i in row]
            if last or sum(len(p[2]) for p in own) >= FULL_SHARE * length:
                yield own
            else:
                left += own
        held, size = left, sum(len(p[2]) for p in left)

    for some in pieces:
        for piece in some:
            if len(piece[2]) == length:
                yield [piece]
            else:
                held.append(piece)
                size += len(piece[2])
        if size >= window:
            yield from settle(False)
            if size >= window // 2:  # pieces that do not fill rows together: they wait for nothing better
                yield from settle(True)
    yield from settle(True)


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches put together while they have at most most_bytes, or a single larger batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pack_documents(docs: DataFrame, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], vocabulary: int, id_col: str = "doc_id", text_col: str = "text", length: int = ROW_IDS, pad_id: int = PAD_ID) -> DataFrame:
    """A row for each row of the id matrix.

    ids, positions binary: `length` little-endian numbers of 2 bytes (4 for a vocabulary over 65536), padded with pad_id and 0; positions count from 0 in each segment.
    cu_seqlens array<int>: 0 and the end of each segment. doc_ids, offsets: each segment's document and where in its ids it begins. n_tokens bigint: ids without padding.

    encode gives the ids of all texts in a row and their number for each text; a document without ids is in no row, and what null and empty texts have is
    encode's affair. Ids are of any type and keep it; null ids stay null; repeated rows are packed as often; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    wide = np.dtype("<u2" if vocabulary <= 1 << 16 and length <= 1 << 16 else "<u4")
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Piece]]:
        for batch in slices(gathered(batches, ENCODE_BYTES), "__text", ENCODE_BYTES):
            flat, counts = encode(batch.column(1))
            flat, at, out = flat.astype(wide), 0, []
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                out += [(doc, start, flat[at + start : at + min(start + length, n)].copy()) for start in range(0, n, length)]
                at += n
            yield out

    def row_batch(rows: list[list[Piece]], id_type: pa.DataType) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(6)]
        for row in rows:
            ids, positions = np.full(length, pad_id, wide), np.zeros(length, wide)
            ends = np.cumsum([len(p[2]) for p in row])
            used = int(ends[-1])
            ids[:used] = np.concatenate([p[2] for p in row])
            starts = np.append(0, ends[:-1])
            positions[:used] = np.arange(used) - np.repeat(starts, ends - starts)
            for column, value in zip(columns, (ids.tobytes(), positions.tobytes(), [0, *ends.tolist()], [p[0] for p in row], [p[1] for p in row], used)):
                column.append(value)
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int32()), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["ids", "positions", "cu_seqlens", "doc_ids", "offsets", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[Piece]] = []
        head = next(batches, None)
        if head is None:
            return
        id_type = head.schema.field(0).type
        for row in pack(pieces_of(chain([head], batches)), length):
            rows.append(row)
            if len(rows) == BLOCK_ROWS:
                yield row_batch(rows, id_type)
                rows = []
        if rows:
            yield row_batch(rows, id_type)

    schema = f"ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, offsets array<int>, n_tokens bigint"
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def pack_pieces(docs: DataFrame, model_path: str, **options) -> DataFrame:
    """pack_documents() with the ids of a SentencePiece model; each document ends with the end id, so that null and empty texts are a segment of one id."""

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return spiece.load_model(model_path).encode_all(texts, spans=False)

    return pack_documents(docs, encode, spiece.load_model(model_path).size, **options)


def matrix_folder(docs: DataFrame) -> str:
    """A new folder for matrices in the shared folder, as a URI; it is removed when the application ends."""
    folder = f"{shared_dir(docs.sparkSession)}/matrices-{uuid.uuid4().hex}"
    return folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:]


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Write each task's rows as four files; the manifest (path, rows, segments, row_bytes), which is the Parquet table folder/manifest.

    path.ids.bin and path.positions.bin are matrices, row by row, of row_bytes a row. path.segments.bin holds, for each row, the number of cumulative lengths and then these, as
    4-byte little-endian numbers. path.documents.arrow is an Arrow stream of each row's doc_ids and offsets. Names are unique to the attempt, and only files in the manifest count:
    those of lost executors are never read. A task without rows writes nothing; folder must not hold a manifest yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name, rows, segments, row_bytes = uuid.uuid4().hex, 0, 0, len(batch.column(0)[0].as_py())
        ids, positions, lengths, documents = (store.open_output_stream(f"{at}/{name}.{x}") for x in ("ids.bin", "positions.bin", "segments.bin", "documents.arrow"))
        of_documents = pa.schema([batch.schema.field(3), batch.schema.field(4)])
        with pa.ipc.new_stream(documents, of_documents) as stream:
            for batch in chain([batch], batches):
                ids.write(b"".join(batch.column(0).to_pylist()))
                positions.write(b"".join(batch.column(1).to_pylist()))
                ends = batch.column(2).to_pylist()
                lengths.write(b"".join(np.array([len(e), *e], "<i4").tobytes() for e in ends))
                stream.write_batch(pa.record_batch(batch.columns[3:], schema=of_documents))
                rows, segments = rows + batch.num_rows, segments + sum(len(e) - 1 for e in ends)
        for file in (ids, positions, lengths, documents):
            file.close()
        yield pa.record_batch([pa.array([f"{folder}/{name}"]), *(pa.array([n], pa.int64()) for n in (rows, segments, row_bytes))], names=["path", "rows", "segments", "row_bytes"])

    schema = "path string, rows bigint, segments bigint, row_bytes bigint"
    packed.select("ids", "positions", "cu_seqlens", "doc_ids", "offsets").mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return packed.sparkSession.read.schema(schema).parquet(f"{folder}/manifest")


def read_matrices(manifest: DataFrame, id_kind: str = "bigint") -> DataFrame:
    """The rows of pack_documents() from the files of a manifest; id_kind is the Spark type of the documents' ids. A task reads whole files, a block of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, row_bytes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from rows_of(path, row_bytes)

    def rows_of(path: str, row_bytes: int) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(f"{at}.ids.bin") as ids, store.open_input_stream(f"{at}.positions.bin") as positions, store.open_input_stream(f"{at}.segments.bin", buffer_size=1 << 16) as lengths, store.open_input_stream(f"{at}.documents.arrow") as documents:
            for block in pa.ipc.open_stream(documents):
                n = block.num_rows
                matrices = []
                for file in (ids, positions):
                    data = file.read(n * row_bytes)
                    if len(data) < n * row_bytes:
                        raise ValueError(f"{path} is cut off")
                    matrices.append(pa.array([data[i : i + row_bytes] for i in range(0, len(data), row_bytes)], pa.binary()))
                ends = [np.frombuffer(lengths.read(4 * int.from_bytes(lengths.read(4), "little")), "<i4").tolist() for _ in range(n)]
                columns = [*matrices, pa.array(ends, pa.list_(pa.int32())), *block.columns, pa.array([e[-1] for e in ends], pa.int64())]
                yield pa.record_batch(columns, names=["ids", "positions", "cu_seqlens", "doc_ids", "offsets", "n_tokens"])

    files = manifest.count()
    schema = f"ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{id_kind}>, offsets array<int>, n_tokens bigint"
    return manifest.select("path", "row_bytes").repartition(max(1, files)).mapInArrow(run, schema)


def packed_files(docs: DataFrame, model_path: str, **options) -> DataFrame:
    """What pack_pieces() packs, written as matrices in the shared folder and read back from them; the files go when the application ends."""
    folder = matrix_folder(docs)
    manifest = write_matrices(pack_pieces(docs, model_path, **options), folder)
    remove_at_exit(docs.sparkSession, folder)
    return read_matrices(manifest, docs.schema[options.get("id_col", "doc_id")].dataType.simpleString())
