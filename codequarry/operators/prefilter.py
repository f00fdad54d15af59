"""The prefilter: which rules can find anything in a file, from its identifiers and substrings.

It is not lossless by design of the rules: a file that only has RegexBuilder has no identifier `regex`, and the regex rules skip it.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.rule_table import Rule


def _ids(ids: list[str]) -> Column:
    return F.array(*map(F.lit, ids))


def _rules_of(found: Column, table: dict[str, list[str]]) -> Column:
    """The rules that an inverted table has for an array of signatures."""
    if not table:
        return F.array().cast("array<string>")
    lookup = F.create_map(*(c for k, ids in sorted(table.items()) for c in (F.lit(k), _ids(ids))))
    # few of a file's words are signatures: the map is asked for those alone
    return F.flatten(F.transform(F.array_distinct(F.filter(found, lambda s: s.isin(*table))), lambda s: F.try_element_at(lookup, s)))


def rules_for(content: Column, rules: list[Rule]) -> Column:
    """The ids of the rules one of whose signatures is in a content: words as whole identifiers in any case, others as substrings; a rule without signatures is always there.

    The signatures' table is turned around, from signature to rules, and a content is gone through once for its identifiers and once for all substrings together.
    """
    always, words, parts = [], defaultdict(list), defaultdict(list)
    for rule in rules:
        if not rule.signatures:
            always.append(rule.rule_id)
        for s in dict.fromkeys(rule.signatures):
            if re.fullmatch(r"\w+", s, re.ASCII):
                words[s.lower()].append(rule.rule_id)
            else:
                parts[s].append(rule.rule_id)
    idents = F.transform(F.regexp_extract_all(content, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0), F.lower)
    found = [_ids(always) if always else F.array().cast("array<string>"), _rules_of(idents, words)]
    if parts:
        # looked for from every place, the longest first; a part that begins another is there wherever the other is
        longest = sorted(parts, key=len, reverse=True)
        implied = {s: sorted({r for t in parts if s.startswith(t) for r in parts[t]}) for s in longest}
        pattern = "(?=(" + "|".join(map(re.escape, longest)) + "))"
        found.append(_rules_of(F.regexp_extract_all(content, F.lit(pattern), 1), implied))
    return F.array_distinct(F.concat(*found))


def allowed_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, rule_id) of the rules that the prefilter lets through for each file."""
    return files.select("path", F.explode(rules_for(F.col("content"), rules)).alias("rule_id"))


def only_allowed(found: DataFrame, files: DataFrame, rules: list[Rule]) -> DataFrame:
    """found(path, rule_id, ...) of the rules that the prefilter lets through for its file. Each file's rules stay one row."""
    allowed = files.select(F.col("path").alias("__path"), rules_for(F.col("content"), rules).alias("__rules")).where(F.size("__rules") > 0)
    return found.join(allowed, (F.col("path") == F.col("__path")) & F.array_contains("__rules", F.col("rule_id")), "left_semi")
