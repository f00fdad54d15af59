"""Directives in comments that suppress rules, and the anti-joins that apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import comment_text
from codequarry.operators.settings import Settings


def directives(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(path, line, form, token, text): a row for each token after a directive; form is file for `<directive>-file`, else line.

    Tokens are cut at commas and white space and keep their case.
    """
    comment = comment_text(F.col("text"))
    word = settings.directive
    held = lines.where(F.col("text").contains(word)).withColumn("comment", comment).where(F.col("comment").contains(word))
    first = F.expr(f"substring(comment, locate('{word}', comment) + {len(word)})")
    by_file = F.expr(f"substring(comment, locate('{word}-file', comment) + {len(word) + 5})")
    forms = held.select(
        "path", "line", "text", F.when(F.col("comment").contains(f"{word}-file"), by_file).alias("file_rest"), F.when(~first.startswith("-file"), first).alias("line_rest")
    )
    each = F.array_compact(F.array(F.when(F.col("file_rest").isNotNull(), F.struct(F.lit("file").alias("form"), F.col("file_rest").alias("rest"))), F.when(F.col("line_rest").isNotNull(), F.struct(F.lit("line").alias("form"), F.col("line_rest").alias("rest")))))
    named = forms.select("path", "line", "text", F.explode(each).alias("d"))
    return named.select("path", "line", F.col("d.form").alias("form"), F.explode(F.split("d.rest", r"(?U)[,\s]+")).alias("token"), "text").where("token <> ''")


def suppressed_rules(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, line, form, rule_id): the rules that each directive token names, by `all`, id, name or category in any case."""
    token = F.lower("token")
    named = (token == "all") | (token == F.lower("rule_id")) | (token == F.lower("rule_name")) | (token == F.lower("category"))
    return found.join(F.broadcast(rules.select("rule_id", "rule_name", "category")), named).select("path", "line", "form", "rule_id").distinct()


def without_suppressed(candidates: DataFrame, suppressed: DataFrame) -> DataFrame:
    """candidates whose anchor line, the line above it and whose file hold no directive for their rule."""
    by_file = suppressed.where("form = 'file'").select("path", "rule_id")
    reach = suppressed.where("form = 'line'").select("path", "rule_id", F.explode(F.array("line", F.col("line") + 1)).alias("anchor_line"))
    return candidates.join(by_file, ["path", "rule_id"], "left_anti").join(reach, ["path", "rule_id", "anchor_line"], "left_anti")


def stale_directives(found: DataFrame, active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(path, line, rule_id of the token, text) of directive tokens that look like a rule id and match no (path, rule_id) of active.

    A line with the file form counts with that form only.
    """
    has_file = found.where("form = 'file'").select("path", "line").distinct()
    own = found.where("form = 'file'").unionByName(found.where("form = 'line'").join(has_file, ["path", "line"], "left_anti").select(*found.columns))
    ids = own.withColumn("rule_id", F.upper("token")).where(F.col("rule_id").rlike(rf"^{settings.rule_prefix}[0-9]{{3}}$"))
    return ids.join(active.select("path", "rule_id").distinct(), ["path", "rule_id"], "left_anti").select("path", "line", "rule_id", "text")
