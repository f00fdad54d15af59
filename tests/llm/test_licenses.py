import random

import pyarrow as pa
import pytest

from codequarry.llm import licenses
from codequarry.llm.decontaminate import words
from codequarry.llm.license_texts import TEMPLATES


def brute(text, templates):
    """Best containment of each licence over all windows, without MinHash."""
    own, out = words(text.encode() if text else None), {}
    for name, texts in templates.items():
        for t in texts:
            w = words(t.encode())
            if not w:
                continue
            p = licenses.plan(len(w))
            wanted = {tuple(w[i : i + p.width]) for i in range(len(w) - p.width + 1)}
            shingles = [tuple(own[i : i + p.width]) for i in range(len(own) - p.width + 1)]
            for at in range(0, len(shingles), p.stride):
                share = len(wanted & set(shingles[at : at + p.stride * p.blocks])) / len(wanted)
                if share >= licenses.LEAST:
                    out[name] = max(share, out.get(name, 0))
    return out


def made(rng, templates):
    filler = [f"word{i}" for i in range(300)]
    parts = []
    for _ in range(rng.randrange(4)):
        parts += rng.choices(filler, k=rng.randrange(40))
        w = rng.choice([t for x in templates.values() for t in x]).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(filler)
        parts += w
    return " ".join(parts + rng.choices(filler, k=rng.randrange(40)))


def test_against_all_windows():
    rng = random.Random(11)
    templates = TEMPLATES | {"tiny": ["two words"], "blank": ["--"]}
    texts = [made(rng, templates) for _ in range(400)] + ["", None, "two words", "Two-Words!", "released under the mit"]
    found = licenses.Scanner(templates).scan(pa.array(texts, pa.string()))
    pairs = missed = 0
    for text, got in zip(texts, found):
        expected = brute(text, templates)
        assert {k: v[0] for k, v in got.items() if k in expected}.keys() == got.keys()  # nothing that the windows do not hold
        pairs += len(expected)
        missed += len(expected.keys() - got.keys())
    assert pairs > 300 and missed <= 0.005 * pairs


def test_band_settings():
    for n in range(1, 400):
        p = licenses.plan(n)
        size = n - p.width + 1
        assert p.stride == 1 or p.stride <= size / 4
        assert p.blocks == size if size <= 4 else p.blocks * p.stride >= size + p.stride
        if size > 4:
            j = licenses.LEAST * size / (p.blocks * p.stride + (1 - licenses.LEAST) * size)
            assert 1 - (1 - j * j) ** p.bands >= licenses.RECALL


@pytest.mark.parametrize("copies", [1, 3])
def test_rows(spark, copies):
    rows = [(1, "Intro. Released under the MIT License. End", "x"), (2, None, "x"), (3, "", "x"), (None, "x Licensed under CC BY-NC 4.0.", "x")] * copies
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license string")
    found = [tuple(r) for r in licenses.find_licenses(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, "MIT", 1.0, 1, 5), (None, "CC-BY-NC-4.0", 1.0, 1, 7)] * copies, key=str)
    assert licenses.find_licenses(docs.where("false")).collect() == []


def test_lines_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "GPL-3.0": "licensed under the GNU General Public License, version 3", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0"}
    expected = {(r["doc_id"], k) for r in docs.collect() for k, v in lines.items() if v in (r["text"] or "")}
    found = {(r["doc_id"], r["license"]) for r in licenses.find_licenses(docs).collect()}
    assert expected and expected <= found


def test_variants_of_the_same_words(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd2, bsd3 = TEMPLATES["BSD"][0], TEMPLATES["BSD-3-Clause"][0]
    texts = {
        "GPL-3.0": ["x licensed under the GNU General Public License, version 3 y", gnu.format(""), TEMPLATES["GPL-3.0"][-1]],
        "GPL-2.0": ["x licensed under the GNU General Public License, version 2 y", TEMPLATES["GPL-2.0"][-1]],
        "LGPL-3.0": [gnu.format("Lesser "), TEMPLATES["LGPL-3.0"][-1]], "AGPL-3.0": [gnu.format("Affero "), TEMPLATES["AGPL-3.0"][-1]],
        "LGPL-2.1": [TEMPLATES["LGPL-2.1"][-1]], "BSD": [bsd2], "BSD-3-Clause": [bsd3, bsd3.replace("endorse", "support")],
    }
    rows = [(n, text, name) for n, (name, text) in enumerate((k, t) for k, v in texts.items() for t in v)]
    rows.append((100, f"{gnu.format('Lesser ')} and then, for the other half, {gnu.format('')}", None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, name string")
    found = {}
    for r in licenses.find_licenses(docs).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert found.pop(100) == {"LGPL-3.0", "GPL-3.0"}
    assert found == {n: {name} for n, _, name in rows if name}


def test_against_all_positions():
    rng = random.Random(12)
    notices = {k: [t for t in v if len(t.split()) < 200] for k, v in TEMPLATES.items()}
    texts = [made(rng, notices) for _ in range(150)]
    pairs = missed = 0
    for text, got in zip(texts, licenses.Scanner(notices).scan(pa.array(texts))):
        own = words(text.encode())
        for name, t in ((name, words(t.encode())) for name, x in notices.items() for t in x):
            width = min(licenses.SHINGLE_WORDS, len(t))
            wanted = {tuple(t[i : i + width]) for i in range(len(t) - width + 1)}
            inside = [tuple(own[i : i + width]) for i in range(len(own) - width + 1)]
            n = len(t) - width + 1
            if any(len(wanted & set(inside[i : i + n])) >= licenses.LEAST * len(wanted) for i in range(max(1, len(inside) - n + 1))):
                pairs += 1
                missed += name not in got
    assert pairs > 100 and missed <= 0.005 * pairs
