"""Lexing: nesting without a limit, long contents, files in pieces."""

import random

import pytest

from codequarry.operators import lexer
from codequarry.operators.settings import Settings
from codequarry.plans.scan import scan
from codequarry.sources.files import read_pieces

COLUMNS = ["path", "idx", "text", "kind", "start", "end", "line", "col", "gap", "parens", "brackets", "braces"]
BITS = ["let ", "x", "y1", "=", ";", "\n", "\n", "\n    ", "{", "}", "(", ")", "[", "]", '"a=b"', '"', '\\"', "'c'", "'", "// c = 1\n", "/* c */", "/*", "*/", 'r"raw"', 'r#"r"x"#', 'r##"a"#b"##', 'r###"', '"###', '"##', '"#', "r#", "r", "#", "::", "é", "\t", "\\\n", "\r\n", "*/\n", "'\n", '"\n', " \n "]


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def plain(content):
    """The tokens by a walk from character to character."""
    out, at = [], 0
    while at < len(content):
        end, c = at + 1, content[at]
        if content.startswith("//", at):
            end = content.find("\n", at)
            end = len(content) if end < 0 else end
        elif content.startswith("/*", at):
            depth, end = 1, at + 2
            while depth and end < len(content):
                step = {"/*": 1, "*/": -1}.get(content[end : end + 2], 0)
                depth, end = depth + step, end + (2 if step else 1)
        elif c == "r" and content[at + 1 :].lstrip("#").startswith('"'):
            hashes = len(content[at + 1 :]) - len(content[at + 1 :].lstrip("#"))
            found = content.find('"' + "#" * hashes, at + hashes + 2)
            end = len(content) if found < 0 else found + hashes + 1
        elif c in "\"'":
            while end < len(content) and content[end] != c:
                end += 2 if content[end] == "\\" else 1
            end = min(end + 1, len(content))
        elif c.isascii() and (c.isalpha() or c == "_"):
            while end < len(content) and content[end].isascii() and (content[end].isalnum() or content[end] == "_"):
                end += 1
        elif c in " \t\r\n\f":
            while end < len(content) and content[end] in " \t\r\n\f":
                end += 1
        elif content.startswith("::", at):
            end = at + 2
        out.append(content[at:end])
        at = end
    return out


def placed(path, content):
    """The rows that tokens_of() is to give, token by token."""
    out, start, depth = [], 0, [0, 0, 0]
    for idx, t in enumerate(tokens := plain(content)):
        before = content.encode()[:start].decode()
        blank = not t.strip(" \t\r\n\f")
        kind = "comment" if t[:2] in ("//", "/*") else "literal" if t[0] in "\"'" or t[:2] in ('r"', "r#") else "ident" if t[0].isascii() and (t[0].isalpha() or t[0] == "_") else "mark"
        gap = tokens[idx - 1] if idx and not tokens[idx - 1].strip(" \t\r\n\f") else ""
        if not blank:
            out.append((path, idx, t, kind, start, start + len(t.encode()), 1 + before.count("\n"), start - len(before[: before.rfind("\n") + 1].encode()) + 1, gap, *depth))
        for n, pair in enumerate(("()", "[]", "{}")):
            depth[n] += (t == pair[0]) - (t == pair[1])
        start += len(t.encode())
    return out


@pytest.fixture(scope="module")
def files():
    rng = random.Random(8)
    return [(f"f{i:04d}", "".join(rng.choice(BITS) for _ in range(rng.randrange(60)))) for i in range(600)]


def test_tokens_against_a_plain_walk(spark, files):
    df = spark.createDataFrame([*files, ("none", None), ("empty", "")], "path string, content string").withColumn("text", lexer.F.lit("clash"))
    assert rows(lexer.tokens_of(df)) == sorted(r for p, c in files for r in placed(p, c))


def test_long_contents_in_pieces(files):
    for most in (16, 100):
        for _, content in files:
            runs = list(lexer.token_runs(content.encode(), most))
            assert [t.decode() for run in runs for t in run] == plain(content)


def test_pieces_of_one_file_are_lexed_apart(spark, files):
    rng, pieces = random.Random(9), []
    for path, content in files:
        lines = content.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        at = n = 0
        while at < len(lines):
            step = rng.randrange(1, 4)
            pieces.append((path, n // 3, n, "".join(lines[at : at + step]), None))
            at, n = at + step, n + 1
    df = spark.createDataFrame(pieces, "path string, block bigint, piece int, content string, size bigint").repartition(7)
    assert rows(lexer.tokens_of_pieces(df)) == sorted(r for p, c in files for r in placed(p, c))


def test_maps_tell_what_a_piece_does_from_every_state(files):
    for _, content in files[:200]:
        data = content.encode() + b"\n"
        for state, after, tokens, *_ in lexer.piece_maps(data):
            at, rest = lexer.resume(data, state)
            left = [t for t in plain(data[at:].decode())] if rest in (lexer.CODE, lexer.SPACED) else []
            if state == lexer.SPACED and left and not left[0].strip():
                left = left[1:]
            assert tokens == len(left)
            assert after == (rest if rest not in (lexer.CODE, lexer.SPACED) else lexer.state_after(left[-1].encode()) if left else after)


@pytest.mark.parametrize("last", ["\n", ""])
def test_files_read_in_splits(spark, tmp_path, last):
    rng = random.Random(10)
    contents = {f"big{n}.rs": "".join(rng.choice(BITS) for _ in range(40_000)).rstrip("\n") + "x" + last for n in range(3)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = read_pieces(spark, str(tmp_path), piece_bytes=3000)
        assert pieces.select("path", "block").distinct().count() > 9 and pieces.count() > 60
        found = rows(lexer.tokens_of_pieces(pieces))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = spark.createDataFrame([(f"{tmp_path}/{n}", c) for n, c in contents.items()], "path string, content string")
    assert found == rows(lexer.tokens_of(want))


@pytest.mark.parametrize("depth", [1, 33, 64, 1000])
def test_comments_nested_to_any_depth(spark, depth):
    inside = "fn f() { " + "/* " * depth + "x.unwrap(); " + "*/ " * depth + "}\nfn g() { y.unwrap(); }\n"
    files = spark.createDataFrame([("src/a.rs", inside), ("src/open.rs", "/* " * depth + "x.unwrap();" + "*/" * (depth - 1))], "path string, content string")
    found = scan(files, Settings(only_rules=("FE076",))).select("file", "line").collect()
    assert [tuple(r) for r in found] == [("src/a.rs", 2)]


def test_tokens_do_not_move_contents(spark, files):
    df = spark.createDataFrame(files, "path string, content string")
    plan = lexer.tokens_of(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
