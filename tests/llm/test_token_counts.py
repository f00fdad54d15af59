"""Token counts against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from codequarry.llm import token_counts as tc

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", None, " ", "  a  b ", "it's we're I'll 'tis 'rx 'l 'le ''s 's's", "a\nb\r\n\tc", "é è ß 你好 😀", "�\x00\x01", "x" * 5000, "word " * 500, "  \n\n  x", "end   ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "١٢ Ⅷ²", "a b　c", "'" * 99, " '" * 9, "=" * 700, " " * 3000 + "x"]


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_against_the_library(spark):
    rng = random.Random(7)
    bits = ["a", "b", "'", "'s", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "1", "é", "你", "😀", "!", "<|endoftext|>", "the", "ing", "r", "l", "e", "\x00", "　", "ſ", "E", "=", "aaaa"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(90))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(rng.randrange(300))) for _ in range(300)]
    docs = spark.createDataFrame([(n, t, "clash", 1) for n, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string, n_bytes int")
    want = library(texts)
    found = {r["doc_id"]: r for r in tc.count_tokens(docs, PATH).collect()}
    assert len(found) == len(texts)
    for n, t in enumerate(texts):
        assert (found[n]["n_bytes"], found[n]["n_tokens"], found[n]["over_limit"]) == (len((t or "").encode()), want[n], want[n] > 512), t


def test_classes_are_those_of_the_library():
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    classes = tc._machine()[2]
    for probe, kind in (("a", tc.LETTERS), ("1", (tc.NUMBER,)), ("!", (tc.OTHER, tc.QUOTE))):
        # a character of the kind joins two of them; lines keep the probes apart
        text = "".join(f"{probe}{chr(p)}{probe}\n" for p in points)
        starts = {a for _, (a, _) in cut.pre_tokenize_str(text)}
        joined = [p for n, p in enumerate(points) if 4 * n in starts and 4 * n + 1 not in starts and 4 * n + 2 not in starts]
        assert joined == [p for p in points if classes[p] in kind]


def test_chunks_of_any_size_and_the_scan_of_their_maps():
    rng = np.random.default_rng(1)
    stream = rng.integers(0, 11, 5000).astype(np.uint8)
    step, emits, _ = tc._machine()
    state, want = tc.FRESH, np.zeros(5001, bool)
    for n, c in enumerate(stream):
        e = emits[c * tc.STATES + state]
        want[n] |= bool(e & tc.HERE)
        want[n - 1] |= bool(e & tc.BEFORE)
        state = step[c * tc.STATES + state]
    for chunk in (1, 2, 7, 128, 5000, 9999):
        assert (tc.word_starts(stream, chunk) == want[:5000]).all()
    maps = rng.integers(0, 9, (13, 9)).astype(np.uint8)
    scanned, so_far = tc.prefix_maps(maps), np.arange(9)
    for n in range(13):
        so_far = maps[n][so_far]
        assert (scanned[n] == so_far).all()


def test_states_are_made_anew_when_there_are_many(monkeypatch):
    monkeypatch.setattr(tc, "MOST_STEPS", 50)
    monkeypatch.setattr(tc, "MOST_WORDS", 3)
    counter = tc.Counter(PATH)
    texts = ["several different words follow each other", "and others", "once more"] * 3
    for t, n in zip(texts, library(texts)):
        assert counter.count_all([t]).tolist() == [n]
    assert counter.count_all([]).tolist() == []


def test_irregular_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tc.Merger([(b"ab", b"c")])
    # a merge that an earlier one always forestalls gives no token: a (bc) never happens in "abc"
    merger = tc.Merger([(b"a", b"b"), (b"b", b"c"), (b"a", b"bc")])
    assert [merger.count(w) for w in (b"abc", b"bc", b"ab", b"aabcc")] == [2, 1, 1, 4]


def test_repeated_rows_empty_tables_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([("p", "a b"), ("p", "a b"), (None, "a b")], "doc_id string, text string")
    assert [r["n_tokens"] for r in tc.count_tokens(docs, PATH).collect()] == [2, 2, 2]
    assert tc.count_tokens(docs.where("false"), PATH).collect() == []
