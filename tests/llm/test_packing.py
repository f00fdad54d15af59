import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece

from codequarry.llm import packing

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


def plain_best_fit(sizes, length):
    free, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [f for f in free if f >= sizes[i]]
        if fits:
            row = max(k for k, f in enumerate(free) if f == min(fits))
        else:
            free.append(length)
            rows.append([])
            row = len(rows) - 1
        rows[row].append(i)
        free[row] -= sizes[i]
    return sorted(f for f in free), rows


def test_best_fit_against_plain_search():
    rng = random.Random(2)
    for length in (1, 7, 64, 100):
        for _ in range(30):
            sizes = [rng.randrange(1, length + 1) for _ in range(rng.randrange(60))]
            rows = packing.best_fit_decreasing(sizes, length)
            assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
            assert sorted(length - sum(sizes[i] for i in r) for r in rows) == plain_best_fit(sizes, length)[0]


def joined(rows, length, width=2):
    docs = defaultdict(list)
    for r in rows:
        ids, positions = (np.frombuffer(r[c], f"<u{width}") for c in ("ids", "positions"))
        assert len(ids) == len(positions) == length and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert not ids[r["n_tokens"] :].any() and not positions[r["n_tokens"] :].any()
        for doc, offset, a, b in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            docs[doc].append((offset, ids[a:b].tolist()))
    out = {}
    for doc, parts in docs.items():
        parts.sort()
        out[doc] = [i for _, p in parts for i in p]
        assert [o for o, _ in parts] == np.cumsum([0, *[len(p) for _, p in parts]])[:-1].tolist()
    return out


def test_documents_come_back_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    expected = {r["doc_id"]: sp.encode(r["text"] or "", add_eos=True) for r in docs.collect()}
    for length in (16, 2048):
        rows = packing.pack_pieces(docs, PATH, length=length).collect()
        assert joined(rows, length) == expected
        assert sum(r["n_tokens"] for r in rows) >= 0.9 * length * (len(rows) - 3)


def test_empty_null_and_repeated(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (None, "a b"), (3, "x " * 500), (4, "same"), (4, "same")], "doc_id bigint, text string").coalesce(1)
    rows = packing.pack_pieces(docs, PATH, length=32).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert sum(r["n_tokens"] for r in rows) == sum(len(sp.encode(r["text"] or "", add_eos=True)) for r in docs.collect())
    assert sorted((d for r in rows for d in r["doc_ids"] if d != 3), key=str) == sorted([1, 2, None, 4, 4], key=str)
    assert packing.pack_pieces(docs.where("false"), PATH).collect() == []


def test_no_ids_and_wide_ids(spark):
    def encode(texts):
        counts = np.array([len(t or "") for t in texts.to_pylist()])
        return np.full(counts.sum(), 70_000), counts

    docs = spark.createDataFrame([(1, ""), (2, "abc")], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, encode, 100_000, length=4).collect()
    assert [(r["doc_ids"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows] == [([2], [70_000] * 3 + [0])]


def test_windows_keep_every_piece():
    rng = random.Random(9)
    pieces = [[(n, 0, np.ones(rng.randrange(1, 101), int)) for n in range(k * 50, k * 50 + 50)] for k in range(30)]
    rows = list(packing.pack(iter(pieces), 100, window=3000))
    assert sorted(p[0] for r in rows for p in r) == list(range(1500))
    assert all(sum(len(p[2]) for p in r) <= 100 for r in rows)


def test_matrix_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    packed = packing.pack_pieces(docs, PATH, length=64).checkpoint()
    rows = packed.collect()
    written = packing.write_matrices(packed, f"file://{tmp_path}/m")
    manifest = written.collect()
    assert sum(r["rows"] for r in manifest) == len(rows) and {r["row_bytes"] for r in manifest} == {128}
    ids = b"".join(open(r["path"][7:] + ".ids.bin", "rb").read() for r in manifest)
    assert sorted(ids[i : i + 128] for i in range(0, len(ids), 128)) == sorted(bytes(r["ids"]) for r in rows)
    numbers = np.concatenate([np.fromfile(r["path"][7:] + ".segments.bin", "<i4") for r in manifest]).tolist()
    lists = []
    while numbers:
        lists.append(numbers[1 : 1 + numbers[0]])
        numbers = numbers[1 + numbers[0] :]
    assert sorted(lists) == sorted(r["cu_seqlens"] for r in rows)
    assert sorted(packing.read_matrices(written).collect()) == sorted(rows)
    # a file that is not in the manifest is nobody's
    open(f"{tmp_path}/m/lost.ids.bin", "wb").write(b"x")
    assert packing.read_matrices(spark.read.parquet(f"file://{tmp_path}/m/manifest")).count() == len(rows)


def test_query_returns_what_the_files_hold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(2)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert joined(packing.packed_files(docs, PATH).collect(), 2048) == {r["doc_id"]: sp.encode(r["text"] or "", add_eos=True) for r in docs.collect()}
    assert packing.packed_files(docs.where("false"), PATH).collect() == []


def test_ids_of_any_type_clashing_names_and_very_long_texts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "long words " * 200_000, "y"), (None, "c", None)], "doc_id int, text string, ids string").coalesce(1)
    docs = docs.selectExpr("doc_id", "text", "ids", "ids as positions", "ids as __text", "ids as path")
    for kind in ("smallint", "decimal(20,2)", "string", "timestamp"):
        given = docs.withColumn("doc_id", docs["doc_id"].cast("long").cast(kind))
        rows = packing.packed_files(given, PATH).collect()
        ids = {r["doc_id"]: sp.encode(r["text"], add_eos=True) for r in given.collect()}
        assert joined(rows, 2048) == ids
