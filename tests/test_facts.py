"""Facts told where contents are read against the windows over tokens, and what queries keep and deal out for them."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import facts, rules
from codequarry.operators.rules import Views
from codequarry.plans.scan import ORDER, scan

SMALL = "/root/testdata/sf0.001"
TOKENS = (
    "let const pub mut ref x y x y A B fn fn main test unwrap join arg Command new crate expect map_err env ( ( ) ) [ ] { } { } ; ; = = , . . :: :: ! # : | ' \" //c\n /*a*/ r\"s\" \"q\" 7 + \n \n \n \r ä _z".split(" ")
    + ["\n", "\n", " ", " ", "#[test]\nfn a() { ", "#[test]\nfn ", "#[tokio::test]", "\nlet ", "\nlet mut ", "\nlet (", "\npub const ", "\nconst ", "x.f(y).g()", "crate::a::b(x)", "// e\r\n", '"..\\""', "a . b (", "x :: y", " = 1;"]
)


def programs(n: int) -> list[tuple[str, str]]:
    rng = random.Random(7)
    odd = ["", " \n", "x", "let", "\nlet x = 1;", "((((", "))", "#[test] fn f() { a::b(1); }", "fn f() {}\n", "a.b(c.d(e).f()).g();", "#[test]fn a(){}#[test]fn b(){x()}", "let ä = 1;\n", "env!(\"A\")", "let x = 1;\nlet x = x;\n{\nlet x = x; }\nx"]
    return [(f"src/{k}.rs", t) for k, t in enumerate(odd + ["".join(rng.choice(TOKENS) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 90))) for _ in range(n)])]


@pytest.fixture(scope="module")
def both(spark):
    files = spark.createDataFrame(programs(400), "path string, content string")
    by_facts = Views(files, share=True)
    kept = facts.large
    facts.large = lambda content: F.lit(True)
    try:
        by_windows = Views(files, share=True)
    finally:
        facts.large = kept
    assert not by_facts.has_large and by_windows.has_large
    return by_facts, by_windows


@pytest.mark.parametrize("kind", list(facts.KINDS))
def test_facts_are_those_of_the_windows(both, kind):
    told, windowed = (v.every(kind) for v in both)
    columns = [c for c in windowed.columns if c not in ("text", "gap", "body", "body_end") and not (kind in ("calls", "chains") and c == "args")]
    rows = [sorted(map(repr, df.select(*columns).collect())) for df in (told, windowed)]
    assert rows[0] == rows[1] and len(rows[0]) > 10


def test_findings_of_large_contents_are_those_of_others(spark, monkeypatch):
    files = spark.createDataFrame(programs(120), "path string, content string")
    small = sorted(map(repr, scan(files).orderBy(*ORDER).collect()))
    monkeypatch.setattr(facts, "large", lambda content: F.crc32(content.cast("binary")) % 2 == 0)
    assert sorted(map(repr, scan(files).orderBy(*ORDER).collect())) == small and len(small) > 100


def test_texts_leave_workers_in_small_batches(spark, monkeypatch):
    files = spark.createDataFrame([("a.rs", "f(g(" * 300 + "))" * 300 + ";"), ("b.rs", "a.b(c.d(e.f(1)));\n")], "path string, content string")
    whole = sorted(Views(files).call_arguments.collect())
    monkeypatch.setattr(facts, "OUT_BYTES", 100)
    assert sorted(Views(files).call_arguments.collect()) == whole and whole


def test_wide_lines_are_large(spark):
    texts = ["x" * (facts.WIDE_LINE + 1), "x\n" * facts.WIDE_LINE, "", "ä" * facts.WIDE_LINE]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, content string").select("n", facts.large(F.col("content")).alias("large")).collect()
    assert [r["large"] for r in sorted(rows)] == [True, False, False, True]


def built(spark, monkeypatch, name):
    """(relations that a query keeps, plan of its result); nothing is run for them."""
    from codequarry.plans import catalog, scan as scan_

    names = []
    for module in (rules, scan_, catalog):
        monkeypatch.setattr(module, "keep", lambda df, tag: (names.append(tag), df)[1])
    monkeypatch.setattr(Views, "has_large", False)
    df = catalog.queries()[name](spark, SMALL)
    return set(names), df._jdf.queryExecution().executedPlan().toString()


RELATIONS = ["q_method_chains", "q_test_functions", "q_chain_calls", "q_invocations", "q_declarations"]


@pytest.mark.parametrize("name", RELATIONS)
def test_relations_over_tokens_deal_no_token(spark, monkeypatch, name):
    names, plan = built(spark, monkeypatch, name)
    assert names <= {"sources"} and "Window" not in plan and plan.count("Exchange") == 1


#: queries of findings, and scans: of what they keep nothing is a row for each token
FINDINGS = ["q_rule_fe063", "q_rule_fe122", "q_rule_fe075", "q_rule_fe076", "q_rule_fe079", "q_rule_fe101", "q_rule_fe121", "q_rule_fe065", "q_rule_fe077", "q_rule_fe078", "q_rule_fe064", "q_chunk_order", "q_scan", "q_baseline_apply", "q_baseline_signatures", "q_dead_suppressions", "q_json_rows", "q_rules_enabled", "q_rules_maximum", "q_sarif_levels", "q_prefilter_losses"]


@pytest.mark.parametrize("name", FINDINGS)
def test_findings_keep_no_tokens(spark, monkeypatch, name):
    names, _ = built(spark, monkeypatch, name)
    assert names <= {"sources", "facts", "candidates", "findings", "ordinals", "sites"} and "facts" in names


def test_texts_of_the_corpus_are_made_after_their_keys_are_dealt(spark):
    from codequarry.sources.corpus import synthetic_code

    plan = synthetic_code(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "harbour" not in plan[plan.index("Exchange") :]
