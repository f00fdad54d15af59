"""Sources, configuration, reports, baseline, cache, streaming and command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codequarry import cli
from codequarry.operators.rule_table import all_rules, enabled_rules
from codequarry.operators.settings import Settings
from codequarry.plans.cache import scan_with_cache
from codequarry.plans.scan import scan, scanning, signatures, without_baseline
from codequarry.plans.stats import timing_stats
from codequarry.sinks import report
from codequarry.sources.config import ConfigError, config_template, read_config
from codequarry.sources.files import expand_targets, gitignore_entries, matches_pattern, read_tree, workspace_members
from codequarry.streaming.watch import new_files, watch

ONE = Settings(only_rules=("FE001",))


@pytest.fixture
def tree(tmp_path):
    for path, text in {"a.rs": "todo!();\n", "src/b.rs": "x();\ntodo!();", "target/c.rs": "todo!();", "n.txt": "todo!();", "src/mytarget/d.rs": "// todo!()"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.rs").write_bytes(b"todo!(); \xff")
    return tmp_path


def test_trees(spark, tree):
    rows = read_tree(spark, str(tree), include=("*.txt",)).collect()
    assert sorted(r["path"].removeprefix(f"{tree}/") for r in rows) == ["a.rs", "bad.rs", "n.txt", "src/b.rs", "src/mytarget/d.rs"]
    assert [r["content"] for r in rows if r["path"].endswith("bad.rs")] == [None]
    assert read_tree(spark, f"{tree}/n.txt").count() == 1


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [("target", "/r/target/x.rs", True), ("target", "/r/mytarget/x.rs", False), ("./target/", "/r/a/target", True), ("*.pdb", "/r/x/y.pdb", True), ("*.pdb", "/r/y.pdb/x", False), ("**/*.rs.bk", "/r/a/b/c.rs.bk", True), ("**/*.rs.bk", "/r/c.rs.bk", True),
     ("src/*.rs", "/r/src/a.rs", True), ("src/*.rs", "/r/src/b/a.rs", False), ("src/**", "/r/src/b/a.rs", True), ("a/b.rs", "/x/y/a/b.rs", True), ("?.rs", "/r/ab.rs", False), (" ", "/r/a", False)],
)
def test_patterns(spark, pattern, path, expected):
    assert spark.range(1).select(matches_pattern(F.lit(path), [pattern], "/r").alias("m")).first()["m"] is expected


def test_manifests():
    text = '[package]\nname = "x"\n[workspace]\nmembers = [\n  "a",\n  "b/c",\n]\n[x]\nmembers = ["no"]\n'
    assert workspace_members(text) == ["a", "b/c"]
    assert expand_targets(["r/Cargo.toml", "r"], {"r/Cargo.toml": text}) == ["r", "r/a", "r/b/c"]
    assert expand_targets(["store://host/r/Cargo.toml"], {"store://host/r/Cargo.toml": text}) == ["store://host/r", "store://host/r/a", "store://host/r/b/c"]
    assert gitignore_entries("# c\n!keep\n/dist/\n./x\n\n") == ["dist", "x"]


def test_config():
    settings = read_config('[rulesets]\nDebug = false # off\n[rules]\nfe001 = true\n[severity]\nFE040 = "Critical"\n[paths]\nexclude = ["a", "b"]\n')
    assert settings.severity == {"FE040": "critical"} and settings.exclude == ("a", "b")
    assert [r.rule_id for r in enabled_rules(settings) if r.category == "debug"] == ["FE001"]
    for text, line in (("x = 1", 1), ("\n[what]\na = true", 3), ("[rules]\nFE001 = maybe", 2), ("[paths]\nother = []", 2), ("[rules", 1), ("[rules]\nFE001", 2), ('[severity]\nFE001 = "loud"', 2)):
        with pytest.raises(ConfigError, match=f"line {line}:"):
            read_config(text)
    assert read_config(config_template("/out/\n")).exclude == (".git", "build", "dist", "node_modules", "out", "target")


def files(spark, **contents):
    return spark.createDataFrame([(f"{k}.rs", v) for k, v in contents.items()], "path string, content string")


def test_reports(spark, tmp_path):
    found = scan(files(spark, a='todo!("x\\ty"); // "é"'), ONE).persist()
    (row,) = json.loads(report.json_document(found))
    assert list(row) == ["rule_id", "rule_name", "category", "severity", "file", "line", "column", "message", "snippet", "suggestion", "suggestion_example"]
    assert (row["snippet"], row["line"]) == ('todo!("x\\ty"); // "é"', 1)
    log = json.loads(report.sarif_document(found, "tool", "1"))
    (result,) = log["runs"][0]["results"]
    assert (result["level"], result["help"]) == ("warning", row["suggestion"])
    assert result["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 1}
    text = report.human_document(found, 1, 1)
    assert text.startswith("a.rs:1:1  warning  FE001  `todo!` macro found [todo-macro]\n      | todo!") and text.endswith("1 finding(s) in 1 file(s) scanned (1 rule(s) enabled)\n")
    assert json.loads(report.pretty_json(report.json_document(found))) == [row]
    assert report.pretty_json("[]") == "[\n  \n]\n"
    report.write_findings(found, f"file://{tmp_path}/out", "json")
    assert [json.loads(r["value"]) for r in spark.read.text(f"file://{tmp_path}/out").collect()] == [row]


def test_baseline(spark, tmp_path):
    found = scan(files(spark, a="todo!();\ntodo!();"), ONE).persist()
    report.write_baseline(found.where("line = 1"), f"file://{tmp_path}/base")
    written = [r["value"] for r in spark.read.text(f"file://{tmp_path}/base").collect()]
    assert sorted(written) == ["# baseline v1", "FE001|a.rs|1|1|`todo!` macro found"]
    left = without_baseline(found, report.read_baseline(spark, f"file://{tmp_path}/base")).collect()
    assert [r["line"] for r in left] == [2]
    assert signatures(found).orderBy("line").first()["signature"] == "FE001|a.rs|1|1|`todo!` macro found"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        report.write_baseline(found, f"file://{tmp_path}/base")


def test_cache_gives_the_same_findings(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    places = lambda df: sorted((r["file"], r["line"], r["severity"]) for r in df.collect())
    first = files(spark, a="todo!();", b="x();\ntodo!();")
    assert places(scan_with_cache(first, cache, ONE)) == places(scan(first, ONE))
    second = files(spark, a="todo!();", b="todo!();", c="")
    assert places(scan_with_cache(second, cache, ONE)) == places(scan(second, ONE))
    assert places(scan_with_cache(second, cache, ONE)) == places(scan(second, ONE))


def test_stream(spark, tree, tmp_path):
    query = watch(new_files(spark, f"file://{tree}/src"), f"{tmp_path}/found", f"file://{tmp_path}/check", ONE, once=True)
    query.awaitTermination(120)
    assert [r["line"] for r in spark.read.parquet(f"{tmp_path}/found").collect()] == [2]


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", 5.0), ("b", None), ("c", 1.0), ("c", 1.0)], "k string, v double")
    found = {r["k"]: (r["min_value"], r["max_value"], r["mean_value"], r["median_value"], r["n"]) for r in timing_stats(rows, "k", "v").collect()}
    assert found == {"a": (1.0, 4.0, 2.5, 3.0, 4), "b": (5.0, 5.0, 5.0, 5.0, 1), "c": (1.0, 1.0, 1.0, 1.0, 2)}


def test_only_matching_files_are_read(spark, tmp_path):
    root = tmp_path / "my.crate"
    for path in ("src/b c+d.rs", "src/é.rs", "x.txt", "notes/n.md"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("todo!();")
    for path in ("target/big.rs", "data.bin"):
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text("x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        rows = read_tree(spark, f"{root}/", include=("notes",)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert sorted(r["path"].removeprefix(f"{root}/") for r in rows) == ["notes/n.md", "src/b c+d.rs", "src/é.rs"]
    with pytest.raises(Exception, match="(?i)not ?(exist|found)|FileNotFound"):
        read_tree(spark, f"{root}/nothing").collect()


def test_partitions_follow_the_size_of_the_sources(spark, monkeypatch):
    from codequarry.operators import rules as R

    least = R.Views.spread(files(spark, a="x"))
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").groupBy("l_orderkey").count()
    assert R.Views.spread(lineitem) == least == 8
    monkeypatch.setattr(R, "PARTITION_BYTES", 1000)
    assert R.Views.spread(lineitem) == -(-os.path.getsize("/root/testdata/sf0.001/lineitem.parquet") // 1000) > 8
    assert R.Views.spread(files(spark, a="x")) == 8


def test_scans_leave_nothing_in_the_shared_folder(spark, tmp_path):
    from codequarry.storage import shared_dir

    def kept():
        folder = shared_dir(spark).removeprefix("file://")
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before = kept()
    with scanning(files(spark, a="todo!();"), Settings(only_rules=("FE001", "FE063"))) as found:
        assert found.count() == 1 and kept() - before
    assert kept() == before


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    from codequarry.storage import shared_dir

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_registered_rules(spark):
    from codequarry.operators import rules as R
    from codequarry.operators.rule_table import Rule

    @R.register_rule(900)
    def long_lines(views):
        return R._candidates(views.lines.where("length(text) > 20"), views.id_of(900), "line", F.lit(1), F.lit("long line"))

    try:
        extra = [Rule("FE900", "long-line", "lint", "info", "lines over 20 characters", None, None, ())]
        rows = scan(files(spark, a="short\n" + "x" * 30 + "\n// scan-ignore long-line\n" + "y" * 30), ONE, extra=extra).collect()
        assert [(r["rule_id"], r["line"], r["message"]) for r in rows] == [("FE900", 2, "long line")]
    finally:
        R.EXTRA_RULES.pop(900)


def test_default_config_manifests_and_benchmark(spark, tmp_path, monkeypatch, capsys):
    for path in ("one/src/a.rs", "two/src/b.rs", "two/src/c.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("todo!();")
    (tmp_path / "two/Cargo.toml").write_text('[workspace]\nmembers = ["../one", "gone"]\n')
    monkeypatch.chdir(tmp_path)
    assert cli.main(["two/Cargo.toml", "--rules", "FE001", "--json", "--quiet"]) == 1
    assert sorted(r["file"].removeprefix(f"{tmp_path}/") for r in json.loads(capsys.readouterr().out)) == ["one/src/a.rs", "two/src/b.rs"]
    assert cli.main([f"file://{tmp_path}/two", "--rules", "FE001", "--json", "--quiet"]) == 1
    assert sorted(r["file"].removeprefix(f"{tmp_path}/") for r in json.loads(capsys.readouterr().out)) == ["one/src/a.rs", "two/src/b.rs"]
    (tmp_path / "codequarry.toml").write_text("[rules]\nFE001 = false\n")
    assert cli.main(["one", "--rules", "FE001"]) == 0 and "no rule is enabled" in capsys.readouterr().err
    (tmp_path / "codequarry.toml").write_text("nonsense")
    assert cli.main(["one"]) == 2 and "codequarry.toml: line 1" in capsys.readouterr().err
    (tmp_path / "codequarry.toml").unlink()
    assert cli.main(["one", "--rules", "FE001", "--benchmark", "2"]) == 0
    text = capsys.readouterr().out
    assert text.count("run ") == 2 and [line.split(":")[0] for line in text.splitlines()[-4:]] == ["min", "max", "mean", "median"]
    assert cli.main(["one", "--benchmark=0"]) == 2 and cli.main(["--version"]) == 0
    capsys.readouterr()
    assert cli.main(["one", "--rules", "FE001", "--sarif", "--output", f"file://{tmp_path}/report"]) == 1
    (line,) = [r["value"] for r in spark.read.text(f"file://{tmp_path}/report").collect()]
    assert isinstance(json.loads(line)["help"], str)
    assert cli.main(["one", "--rules", "FE001"]) == 1
    assert "files/s" in capsys.readouterr().err


def test_command_line(spark, tree, capsys):
    assert cli.main([str(tree), "--rules", "fe001,FE999", "--json"]) == 1
    assert sorted(r["line"] for r in json.loads(capsys.readouterr().out)) == [1, 2]
    assert cli.main([str(tree), "--rules", "FE999"]) == 0
    assert cli.main(["--explain", "fe063"]) == 0 and "unused-variable" in capsys.readouterr().out
    assert cli.main(["--explain", "FE999"]) == 2 and cli.main(["--json", "--sarif", "x"]) == 2 and cli.main(["--nonsense"]) == 2
    assert cli.main(["--list-rules"]) == 0 and len(capsys.readouterr().out.splitlines()) >= len(all_rules())


def test_repartitioning_does_not_matter(spark):
    from codequarry.sources.corpus import synthetic_code

    corpus = synthetic_code(spark, "/root/testdata/sf0.001").where("path like 'src/f1%'")
    some = Settings(only_rules=("FE001", "FE076", "FE121"))
    rows = lambda df: sorted(map(str, scan(df, some).collect()))
    assert rows(corpus) == rows(corpus.repartition(3)) != []


def test_tokens_stand_where_they_say(spark):
    from codequarry.operators.lexer import tokens_of
    from codequarry.sources.corpus import synthetic_code

    corpus = synthetic_code(spark, "/root/testdata/sf0.001").unionByName(files(spark, odd='"open \\', raw='r##"x"# ', life="fn f<'a>(x: &'a str) {}", block="/* a /* b"))
    at = F.substring(F.col("content").cast("binary"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).cast("string")
    placed = tokens_of(corpus).join(corpus, "path")
    assert placed.where(at != F.col("text")).count() == 0 and placed.count() > 1000
