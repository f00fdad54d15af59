"""Named queries over the driver's tables, each with its SQL twin where one can be written.

All of them read the synthetic code corpus whole: one file for each order of lineitem.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import lexer, prefilter, suppress, syntax
from codequarry.operators.rule_table import Rule, all_rules, rule_frame
from codequarry.operators.rules import EXTRA_RULES, TOKEN_RULES, Views, candidates, env_bound, register_row_rule
from codequarry.operators.settings import Settings
from codequarry.plans import oracle
from codequarry.plans.scan import numbers_of, ordered, scan, shown, signatures, with_chunks, without_baseline
from codequarry.sources.corpus import synthetic_code
from codequarry.storage import keep

Query = Callable[[SparkSession, str], DataFrame]
RULE_COLUMNS = ["rule_id", "file", "line", "column", "message", "snippet", "severity"]


def views(spark: SparkSession, sf_dir: str, share: bool = False) -> Views:
    return Views(synthetic_code(spark, sf_dir), share=share)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over the synthetic corpus, in report order."""
    return ordered(scan(synthetic_code(spark, sf_dir)))


def rule_query(number: int) -> Query:
    """The findings of one rule, with prefilter and suppressions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files, settings = synthetic_code(spark, sf_dir), Settings(only_rules=(f"FE{number:03d}",))
        return scan(files, settings, views=Views(files, settings, share=number in TOKEN_RULES)).select(*RULE_COLUMNS)

    return run


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).lines


def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).files.select("path", F.explode(lexer.token_index(F.col("content"))).alias("token"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).tokens.select("path", "idx", "text", "kind", "line", "col", "parens", "brackets", "braces")


def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens again, of files cut into pieces of three lines that are lexed apart."""
    lines = F.split("content", r"(?<=\n)", -1)
    n = F.col("n")
    cut = views(spark, sf_dir).sources.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 3).cast("int")), lambda i: F.array_join(F.slice(lines, 3 * i + 1, 3), ""))).alias("n", "content"))
    pieces = cut.select("path", (n / 2).cast("bigint").alias("block"), (n % 2).alias("piece"), "content", F.lit(None).cast("bigint").alias("size"))
    return lexer.tokens_of_pieces(pieces).select("path", "idx", "text", "kind", "line", "col", "parens", "brackets", "braces")


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, share=True).invocations.select("path", "idx", "line", "col", "name", "method", "kind")


def method_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, share=True).chains[0].select("path", "root_idx", "root", "line", "col", F.col("n_calls").cast("bigint").alias("n_calls"), "end_idx")


def chain_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, share=True).call_arguments.select("path", "root_idx", "idx", "name", "line", "col", "args")


def test_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, share=True).test_functions


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, share=True).declarations.drop("parens", "brackets", "braces")


def regex_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).regex_sites.drop("text").withColumnRenamed("column", "col")


def env_bound_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return env_bound(views(spark, sf_dir).lines).select("path", F.explode("names").alias("name"))


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.directives(views(spark, sf_dir).lines).select("path", "line", "form", "token")


def suppressed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.suppressed_rules(suppress.directives(views(spark, sf_dir).lines), rule_frame(spark, all_rules()))


def prefilter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefilter.allowed_rules(views(spark, sf_dir).files, all_rules())
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_files"))


def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(synthetic_code(spark, sf_dir), Settings(severity={"FE001": "critical", "FE063": "info"}))
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def baseline_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(scan(synthetic_code(spark, sf_dir))).select("signature")


def baseline_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a baseline of the findings in even lines."""
    found = keep(scan(synthetic_code(spark, sf_dir)), "findings")
    return without_baseline(found, signatures(found.where("line % 2 = 0"))).select("rule_id", "file", "line", "column")


def dead_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives that no finding of any rule answers."""
    return scan(synthetic_code(spark, sf_dir)).where("rule_id = 'FE066'").select(*RULE_COLUMNS)


ALIVE = Settings(rules={"FE066": False})
PLACE = ["rule_id", "file", "line", "column"]


def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What directives keep from the report, of all rules."""
    seen = Views(synthetic_code(spark, sf_dir), ALIVE, share=True)
    rules = rule_frame(spark, all_rules())
    found = prefilter.only_allowed(shown(candidates(seen, numbers_of(all_rules(), ALIVE) - {66}), seen), seen.sources, all_rules()).withColumnRenamed("path", "file")
    return found.select(*PLACE).exceptAll(scan(seen.sources, ALIVE, views=seen).select(*PLACE))


def prefilter_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules in files that the prefilter skips."""
    files = synthetic_code(spark, sf_dir)
    seen = Views(files, ALIVE, share=True)
    loose, tight = (scan(files, replace(ALIVE, prefilter=on), views=seen).select(*PLACE) for on in (False, True))
    return loose.exceptAll(tight)


def _by_rule(spark: SparkSession, sf_dir: str, settings: Settings) -> DataFrame:
    found = scan(synthetic_code(spark, sf_dir), settings)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"))


def rules_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules that toggles leave on: one of its own wins over its category's."""
    return _by_rule(spark, sf_dir, Settings(rulesets={"debug": False, "shell": False}, rules={"FE003": True, "FE063": False, "FE066": False}))


def rules_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules that lists of ids and categories leave on."""
    return _by_rule(spark, sf_dir, Settings(only_rules=("fe001", "FE063", "FE120"), only_categories=("debug", "path")))


def rules_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every rule whatever the toggles, without the prefilter; dead directives aside."""
    return _by_rule(spark, sf_dir, Settings(rulesets={"debug": False}, rules={"FE100": False}, maximum=True)).where("rule_id <> 'FE066'")


def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by level in SARIF."""
    from codequarry.sinks.report import sarif_level

    return scan(synthetic_code(spark, sf_dir)).groupBy("rule_id", "severity", sarif_level(F.col("severity")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the debug and path rules with the batch of 256 files that reports them."""
    files = synthetic_code(spark, sf_dir)
    return with_chunks(scan(files, Settings(only_categories=("debug", "path"))), files).select("chunk", "rule_id", "file", "line", "column")


def row_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's rule as a table function over files: lines of over 60 characters, told with the length; prefilter and suppressions apply."""

    @register_row_rule(950)
    def long_lines(path: str, content: str):
        for n, text in enumerate(content.split("\n"), 1):
            if len(text) > 60:
                yield n, 61, f"line of {len(text)} characters"

    try:
        rule = Rule("FE950", "long-line", "lint", "info", "lines of over 60 characters", None, None, ("let",))
        return scan(synthetic_code(spark, sf_dir), Settings(only_rules=("FE001",)), extra=[rule]).where("rule_id = 'FE950'").select("rule_id", "file", "line", "column", "message")
    finally:
        EXTRA_RULES.pop(950)


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.sinks.report import json_row

    return scan(synthetic_code(spark, sf_dir)).select("rule_id", "file", "line", "column", "message", json_row().alias("json"))


def path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.sources.files import matches_pattern

    path = F.col("path")
    return views(spark, sf_dir).files.where(matches_pattern(path, ["tests", "*1?.rs", "src/**/f2*.rs"], "")).select("path")


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule over the whole corpus, every rule on."""
    return scan(synthetic_code(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min, max, mean and upper median of event values by type."""
    from codequarry.plans.stats import timing_stats

    return timing_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths to scan again when only files of even order keys are in the cache as they are now."""
    from codequarry.plans.cache import content_keys, split_by_cache

    files = views(spark, sf_dir).files
    known = content_keys(files).where(F.regexp_extract("path", r"(\d+)\.rs$", 1).cast("bigint") % 2 == 0)
    return split_by_cache(files, known)[1].select("path")


PLAIN: dict[str, Query] = {
    f"q_{f.__name__}": f
    for f in (
        lines, token_index, tokens, split_tokens, invocations, method_chains, chain_calls, test_functions, declarations, regex_sites, env_bound_vars, directives, suppressed_rules, prefilter_files,
        severity_override, baseline_signatures, baseline_apply, dead_suppressions, suppressed_findings, prefilter_losses, rules_enabled, rules_chosen, rules_maximum, sarif_levels, chunk_order, row_rule, json_rows, path_globs, scan_summary, bench_stats, cache_misses,
    )
}


def queries() -> dict[str, Query]:
    by_rule = {f"q_rule_{r.rule_id.lower()}": rule_query(int(r.rule_id[2:])) for r in all_rules()}
    return {"q_scan": entry} | PLAIN | by_rule


def oracle_sql() -> dict[str, str]:
    return oracle.plain_sql() | {f"q_rule_fe{n:03d}": oracle.rule_sql(n) for n in oracle.RULE_SQL}
