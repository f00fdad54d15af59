"""Cache, streams of changing files, one-file reports and medians: what lasts from run to run and what is too large for one task."""

import json
import os
import random
import re
import statistics
import time

import pytest

from codequarry import cli
from codequarry.operators import rule_table
from codequarry.operators import rules as R
from codequarry.operators.rule_table import Rule
from codequarry.operators.settings import Settings
from codequarry.plans import stats
from codequarry.plans.cache import Cache, scan_with_cache
from codequarry.plans.scan import file_ordinals, ordered_by_chunks, scan
from codequarry.sinks import report
from codequarry.sources.files import read_checked
from codequarry.streaming.watch import findings_of, scan_changes, watch_changes

ONE = Settings(only_rules=("FE001",))


def files(spark, contents):
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def places(df):
    return sorted((r["file"], r["rule_id"], r["line"], r["message"], r["snippet"], r["severity"], r["suggestion"]) for r in df.collect())


def test_ten_runs_leave_one_live_copy(spark, tmp_path):
    rng, cache = random.Random(1), f"file://{tmp_path}/cache"
    contents = {f"f{i}.rs": "todo!();" for i in range(6)}
    for run in range(10):
        contents |= {f"f{rng.randrange(6)}.rs": "x();\n" * rng.randrange(4) + "todo!();\n" * rng.randrange(3) for _ in range(2)}
        found = scan_with_cache(files(spark, contents), cache, ONE, most_segments=2)
        assert places(found) == places(scan(files(spark, contents), ONE)), run
        segments = [n for n in os.listdir(tmp_path / "cache") if n.startswith("segment-")]
        assert len(segments) <= 2
    Cache(spark, cache, ONE, most_segments=0).update(files(spark, {"f0.rs": "todo!();"}))
    (segment,) = [n for n in os.listdir(tmp_path / "cache") if n.startswith("segment-")]
    assert spark.read.parquet(f"{cache}/{segment}/files").count() == 6
    assert [n for n in os.listdir(tmp_path / "cache") if n.startswith("manifest.json.")] == []


def test_findings_meet_the_rules_as_they_are_now(spark, tmp_path, monkeypatch):
    cache, contents = f"file://{tmp_path}/cache", {"a.rs": "todo!();\ndbg!(1);"}
    both = Settings(only_rules=("FE001", "FE003"))
    assert len(places(scan_with_cache(files(spark, contents), cache, both))) == 2
    segments = sorted(os.listdir(tmp_path / "cache"))
    # another severity and another text, and a rule less: nothing is scanned again
    loud = Settings(only_rules=("FE001", "FE003"), severity={"FE001": "critical"})
    rows = [(i, n, c, s, d, "Write it.", e, sig) for i, n, c, s, d, h, e, sig in rule_table._ROWS if i != "FE003"]
    monkeypatch.setattr(rule_table, "_ROWS", rows)
    (row,) = scan_with_cache(files(spark, contents), cache, loud).collect()
    assert (row["rule_id"], row["severity"], row["suggestion"]) == ("FE001", "critical", "Write it.")
    assert sorted(os.listdir(tmp_path / "cache")) == segments
    # a rule that the cache does not know: everything is scanned
    monkeypatch.undo()
    more = Settings(only_rules=("FE001", "FE003", "FE004"))
    assert len(places(scan_with_cache(files(spark, contents | {"b.rs": "panic!()"}), cache, more))) == 3


def test_a_run_that_breaks_off_is_never_seen(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    scan_with_cache(files(spark, {"a.rs": "todo!();"}), cache, ONE)
    monkeypatch.setattr(Cache, "_publish", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        scan_with_cache(files(spark, {"a.rs": "no();"}), cache, ONE)
    monkeypatch.undo()
    assert [r["line"] for r in findings_of(spark, cache, ONE).collect()] == [1]
    assert scan_with_cache(files(spark, {"a.rs": "no();"}), cache, ONE).collect() == []
    assert len([n for n in os.listdir(tmp_path / "cache") if n.startswith("segment-")]) == 2


def write(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_changed_and_removed_files(spark, tmp_path):
    root, cache = tmp_path / "tree", f"file://{tmp_path}/cache"
    write(root / "a.rs", "todo!();", 1000)
    write(root / "src/b [1].rs", "todo!();", 1000)
    seen = lambda: sorted((os.path.basename(r["file"]), r["line"]) for r in findings_of(spark, cache, ONE).collect())
    assert scan_changes(spark, f"file://{root}", cache, ONE) == (2, 0) and seen() == [("a.rs", 1), ("b [1].rs", 1)]
    assert scan_changes(spark, f"file://{root}", cache, ONE) == (0, 0)
    write(root / "a.rs", "\ntodo!();", 2000)
    assert scan_changes(spark, f"file://{root}", cache, ONE) == (1, 0) and seen() == [("a.rs", 2), ("b [1].rs", 1)]
    write(root / "a.rs", "\n\ntodo!();", 3000)
    (root / "src/b [1].rs").unlink()
    assert scan_changes(spark, f"file://{root}", cache, ONE) == (1, 1) and seen() == [("a.rs", 3)]


def test_a_stream_of_changes_goes_on_after_a_restart(spark, tmp_path):
    root, cache = tmp_path / "tree", f"file://{tmp_path}/cache"

    def until(expected):
        for _ in range(120):
            try:
                now = sorted((os.path.basename(r["file"]), r["line"]) for r in findings_of(spark, cache, ONE).collect())
            except Exception:  # a segment went while it was read
                now = None
            if now == expected:
                return
            time.sleep(0.5)
        raise AssertionError(now)

    write(root / "a.rs", "todo!();", 1000)
    start = lambda: watch_changes(spark, f"file://{root}", cache, f"file://{tmp_path}/check", ONE, every="1 second")
    query = start()
    try:
        until([("a.rs", 1)])
        write(root / "a.rs", "\ntodo!();", 2000)
        until([("a.rs", 2)])
        query.stop()
        write(root / "a.rs", "\n\ntodo!();", 3000)
        write(root / "b.rs", "todo!();", 3000)
        query = start()
        until([("a.rs", 3), ("b.rs", 1)])
    finally:
        query.stop()


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_reports_as_one_file(spark, tmp_path, rows):
    found = scan(files(spark, {f"f{i:03d}.rs": 'todo!("é\\t");' for i in range(rows)} or {"none.rs": ""}), ONE).repartition(5).persist()
    want = json.loads(report.json_document(found))
    assert len(want) == rows
    for pretty in (False, True):
        report.write_document(found, f"file://{tmp_path}/r{pretty}.json", "json", pretty=pretty)
        assert json.loads((tmp_path / f"r{pretty}.json").read_text()) == want
        report.write_document(found, f"file://{tmp_path}/r{pretty}.sarif", "sarif", "tool", "1", pretty=pretty)
        assert json.loads((tmp_path / f"r{pretty}.sarif").read_text()) == json.loads(report.sarif_document(found, "tool", "1"))
    report.write_document(found, f"file://{tmp_path}/r.txt", "human", n_files=rows, n_rules=1)
    assert (tmp_path / "r.txt").read_text() == report.human_document(found, rows, 1)
    if rows < 2:
        assert (tmp_path / "rTrue.json").read_text() == report.pretty_json(report.json_document(found))
    with pytest.raises(FileExistsError):
        report.write_document(found, f"file://{tmp_path}/r.txt", "human")
    assert sorted(n for n in os.listdir(tmp_path) if "parts" in n) == []


def test_command_line_writes_documents(spark, tmp_path):
    write(tmp_path / "src/a.rs", "todo!();", 1000)
    assert cli.main([str(tmp_path / "src"), "--rules", "FE001", "--json", "--pretty", "--document", f"file://{tmp_path}/out.json"]) == 1
    assert len(json.loads((tmp_path / "out.json").read_text())) == 1


def test_medians_without_sorting_a_group(spark):
    rng = random.Random(2)
    odd = [float("inf"), float("-inf"), 0.0, 5e-324, -1.7e308, 1.7e308, 1e-300, 3.0]
    groups = {
        "same": [4.0] * 50, "two": [1.0, 2.0], "one": [7.0], "wide": [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(400)], "odd": odd, "ties": [float(rng.randrange(3)) for _ in range(301)],
        "near": [1.0 + k * 2**-52 for k in range(300)], "plain": [rng.gauss(0, 1) for _ in range(1000)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("plain", None), ("empty", None), (None, 1.0)]
    found = {r["k"]: r["median_value"] for r in stats.timing_stats(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert found == {k: statistics.median_high(v) for k, v in groups.items()}
    whole = spark.createDataFrame([("a", 2**62 + k) for k in range(9)], "k string, v bigint")
    assert stats.timing_stats(whole, "k", "v").first()["median_value"] == 2**62 + 4
    nan = spark.createDataFrame([("a", v) for v in (float("nan"), 1.0, 2.0, 3.0)], "k string, v double")
    assert stats.timing_stats(nan, "k", "v").first()["median_value"] == 3.0


def test_registered_rules_are_cached(spark, tmp_path):
    @R.register_rule(901)
    def long_lines(views):
        return R._candidates(views.lines.where("length(text) > 5"), views.id_of(901), "line", R.F.lit(1), R.F.lit("long line"))

    try:
        extra = [Rule("FE901", "long-line", "lint", "info", "long lines", None, None, ())]
        found = scan_with_cache(files(spark, {"a.rs": "short\nlonger line"}), f"file://{tmp_path}/cache", ONE, extra=extra)
        assert [(r["rule_id"], r["line"]) for r in found.collect()] == [("FE901", 2)]
    finally:
        R.EXTRA_RULES.pop(901)


def test_files_that_cannot_be_scanned_are_told(spark, tmp_path, capsys):
    write(tmp_path / "src/a.rs", "todo!();", 1000)
    write(tmp_path / "src/big.rs", "todo!();" * 1000, 1000)
    (tmp_path / "src/bad.rs").write_bytes(b"todo!(); \xff")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        kept, skipped = read_checked(spark, str(tmp_path / "src"))
        assert [os.path.basename(r["path"]) for r in kept.collect()] == ["a.rs"]
        assert {(os.path.basename(r["path"]), r["reason"]) for r in skipped.collect()} == {("big.rs", "too large"), ("bad.rs", "not UTF-8")}
        assert cli.main([str(tmp_path / "src"), "--rules", "FE001"]) == 1
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    said = capsys.readouterr()
    assert said.err.count("warning: skipped") == 2 and "big.rs: too large" in said.err
    assert "1 finding(s) in 3 file(s) scanned" in said.out


def test_progress_is_told_while_a_scan_runs(spark):
    said = []
    with cli.Progress(spark.sparkContext, 1000, said.append, seconds=0.05):
        spark.range(0, 400, 1, 8).selectExpr("sum(length(repeat(cast(id as string), 20000)))").collect()
        time.sleep(0.2)
    assert said and said[-1].startswith("info: ") and "files/s" in said[-1] and " of 1000 files" in said[-1]
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_chunks_follow_the_walk_through_sorted_folders(spark):
    paths = ["a.rs", "a/z.rs", "a-b/c.rs", "a/b/c.rs", "b.rs", "a/b.rs"] + [f"m/{n:04d}.rs" for n in range(600)]
    df = files(spark, {p: "todo!();" for p in paths}).repartition(3)
    want = sorted(paths, key=lambda p: p.split("/"))
    assert [r["path"] for r in file_ordinals(df).orderBy("ordinal").collect()] == want
    assert file_ordinals(df.where("false")).count() == 0
    rows = ordered_by_chunks(scan(df, ONE), df).collect()
    assert [r["file"] for r in rows] == want and [r["chunk"] for r in rows] == [n // 256 for n in range(len(want))]


def test_row_rules_as_table_functions(spark):
    @R.register_row_rule(902)
    def tabs(path, content):
        for n, text in enumerate(content.split("\n"), 1):
            if "\t" in text:
                yield n, text.index("\t") + 1, f"tab in {path}"

    try:
        extra = [Rule("FE902", "tabs", "lint", "info", "tabs", "Use spaces.", None, ("let",))]
        text = "let a;\n\tb();\n// scan-ignore tabs\n\tc();\nd\te"
        rows = scan(files(spark, {"a.rs": text, "none.rs": "\tno signature", "empty.rs": ""}), ONE, extra=extra).orderBy("line").collect()
        assert [(r["rule_id"], r["line"], r["column"], r["message"], r["suggestion"]) for r in rows] == [("FE902", 2, 1, "tab in a.rs", "Use spaces."), ("FE902", 5, 2, "tab in a.rs", "Use spaces.")]
    finally:
        R.EXTRA_RULES.pop(902)


def test_prefilter_by_inverted_table(spark):
    from codequarry.operators.prefilter import allowed_rules

    rules = [Rule(f"R{n}", "", "", "", "", None, None, s) for n, s in enumerate([("//", "/*"), ("///", "//!"), (".max(",), ("let", "CONST"), (), ("scan-ignore",), ("::", "x::y")])]
    rng = random.Random(3)
    bits = ["/", "/", "*", "!", ".max(", "let", "lets", "Const", " ", ":", "x", "y", "scan-ignore", "scan"]
    contents = {f"f{i}": "".join(rng.choice(bits) for _ in range(rng.randrange(9))) for i in range(400)}
    found = {(r["path"], r["rule_id"]) for r in allowed_rules(files(spark, contents), rules).collect()}
    want = set()
    for path, text in contents.items():
        words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", text, re.ASCII)}
        for r in rules:
            if not r.signatures or any((s.lower() in words) if re.fullmatch(r"\w+", s, re.ASCII) else s in text for s in r.signatures):
                want.add((path, r.rule_id))
    assert found == want
