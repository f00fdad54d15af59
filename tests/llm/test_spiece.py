import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import sentencepiece

from codequarry.llm import spiece

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", None, " ", "  a  b ", "▁x ▁", "a\nb\r\n\tc", "é è ß 你好 😀", "�\x00\x01", "x" * 3000, "word " * 500, " lead", "trail ", "ﬁ １２３", "a b", "<s></s><unk>", "<0x41>"]


def test_against_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(4)
    alphabet = "ab cé▁\n😀 ,.Z9 "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    for rows in (spiece.round_trip(docs, PATH).collect(), spiece.decode_ids(spiece.encode_pieces(docs, PATH), PATH).collect()):
        assert len(rows) == len(texts)
        for r in rows:
            ids = sp.encode(texts[r["doc_id"]] or "", add_eos=True)
            assert r["ids"] == ids
            assert r["decoded"] == sp.decode(ids)


def test_spans_cover_the_source(spark):
    texts = [t for t in TEXTS if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in spiece.encode_pieces(docs, PATH).collect():
        data = texts[r["doc_id"]].encode()
        assert r["begin"][0] == 0 and r["end"][-1] == len(data)
        assert all(a <= b for a, b in zip(r["begin"], r["end"])) and all(b == c for b, c in zip(r["end"], r["begin"][1:]))


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id bigint, text string")
    assert len({tuple(r["ids"]) for r in spiece.round_trip(docs, PATH).collect()}) == 1
    assert spiece.round_trip(docs.where("false"), PATH).collect() == []


def library_spans(sp, text):
    """(id, begin, end) of the library's pieces, in bytes of the text."""
    return [(p.id, p.begin, p.end) for p in sp.encode(text, return_type="proto").pieces]


def own_spans(r):
    return list(zip(r["ids"], r["begin"], r["end"]))[:-1]


def test_spans_are_those_of_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*TEXTS, "rare 𓀀𓀁 one", "𓀀"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    digests = {r["doc_id"]: r["spans_sha256"] for r in spiece.round_trip(docs, PATH).collect()}
    for r in spiece.encode_pieces(docs, PATH).collect():
        text = texts[r["doc_id"]] or ""
        assert own_spans(r) == library_spans(sp, text), text
        pairs = [x for p in zip(r["begin"], r["end"]) for x in p]
        assert digests[r["doc_id"]] == hashlib.sha256(struct.pack(f"<{len(pairs)}i", *pairs)).hexdigest()


def test_spans_through_a_character_map(tmp_path):
    text = tmp_path / "text"
    text.write_text("the cat sat on the mat\nfi 123 the end of the file\n" * 50)
    for squeeze in (False, True):
        sentencepiece.SentencePieceTrainer.train(
            input=str(text), model_prefix=str(tmp_path / "m"), model_type="bpe", vocab_size=300, byte_fallback=True, hard_vocab_limit=False,
            normalization_rule_name="nmt_nfkc", remove_extra_whitespaces=squeeze, minloglevel=2,
        )
        path = str(tmp_path / "m.model")
        sp, model = sentencepiece.SentencePieceProcessor(model_file=path), spiece.Model(path)
        assert model.charmap.units
        texts = [t for t in TEXTS if t is not None] + ["ﬁ １２３", "the　ｃat e\u0301 \u200bﬁle", "①②㌔ the"]
        flat, totals, begin, end = model.encode(texts)
        at = 0
        for t, n in zip(texts, totals.tolist()):
            own = list(zip(flat[at : at + n].tolist(), begin[at : at + n].tolist(), end[at : at + n].tolist()))[:-1]
            assert own == library_spans(sp, t), t
            at += n


def test_merges_look_up_only_the_pairs_beside_them(monkeypatch):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 60))) for _ in range(2000)})
    model, slot, asked = spiece.Model(PATH), spiece.Model._slot, []

    def counted(keys, bits):
        asked.append(len(keys) if bits == model.tables[0][0] else 0)
        return slot(keys, bits)

    monkeypatch.setattr(spiece.Model, "_slot", staticmethod(counted))
    flat, totals = model.encode([" ".join(words)], spans=False)
    symbols = sum(len(w) + 1 for w in words)
    assert sum(asked) <= symbols + 2 * (symbols - len(flat) + 1)
    assert flat.tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(" ".join(words), add_eos=True)


def test_words_of_every_length_are_merged_as_by_the_library(monkeypatch):
    rng = random.Random(7)
    sp, model = sentencepiece.SentencePieceProcessor(model_file=PATH), spiece.Model(PATH)
    lengths = [*range(1, spiece.LONG_CHUNK + 10), *(rng.randrange(1, 12) for _ in range(500))]
    texts = [f(n) for n in lengths for f in ("a".__mul__, "𓀀é".__mul__, lambda n: "".join(rng.choice("theingé😀好𓀀Z9.") for _ in range(n)))]
    rng.shuffle(texts)
    texts = [*texts, "", " ".join(texts), "\n".join(texts), *(" ".join(rng.sample(texts, 3)) + end for end in ("", "  ▁x", "\n") for _ in range(20))]
    expected = [sp.encode(t, add_eos=True) for t in texts]
    for block in (1, 300, 1 << 16):
        monkeypatch.setattr(spiece, "BLOCK_SYMBOLS", block)
        flat, totals = model.encode_all(pa.array(texts, pa.string()), spans=False)
        assert totals.tolist() == [len(e) for e in expected] and flat.tolist() == [i for e in expected for i in e]
    assert [len(x) for x in model.encode_all(pa.array([], pa.string()))] == [0, 0, 0, 0]
