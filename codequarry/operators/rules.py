"""The rules as queries over the views of a corpus.

A rule builder takes Views and gives candidates: (path, rule_id, line, column, message, anchor_line, snippet, code_only). anchor_line is the line whose text is shown and at
which suppressions apply; snippet is null where that text is meant; code_only candidates do not count on comment lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators import facts, lexer, syntax
from codequarry.operators.settings import Settings
from codequarry.session import PARTITION_BYTES, partitions_for
from codequarry.storage import discard, keep

#: rules that read tokens: their views are worth sharing even for one rule
TOKEN_RULES = frozenset({63, 64, 65, 75, 76, 77, 78, 79, 101, 121, 122})
CANDIDATE = ["path", "rule_id", "line", "column", "message", "anchor_line", "snippet", "code_only"]

# fixed values: the markers that the rules look for
SHELLS = ("sh", "bash", "cmd", "cmd.exe", "powershell", "pwsh")
SHELL_FLAGS = ("-c", "/c", "/C", "-Command")
DYNAMIC_MARKERS = ("format!(", "concat!(", ".to_string()", "push_str(", " + ")
ENV_MARKERS = ("env::var(", "env::args(")
VALIDATION_MARKERS = ("valid", "validate", "invalid", "check", "allowed", "email", "username", "slug", "password", "token", "field", "match_ok")
SEARCH_MARKERS = ("search", "find", "lookup", "grep", "scan for", "contains")
UNTRUSTED_WORDS = ("user", "input", "param", "arg", "request", "req", "untrusted", "external", "query")
ARCHIVE_WORDS = ("archive", "extract", "unpack", "zip", "tar")
ENTRY_WORDS = ("archive_entry", "entry_path", "entry_name", "file_name", "entry", "header")
SAFE_ENTRY_CALLS = ("enclosed_name(", "mangled_name(")
ASSERT_MACROS = ("assert", "assert_eq", "assert_ne", "debug_assert", "debug_assert_eq", "debug_assert_ne")
UNWRAP_CALLS = ("unwrap", "expect", "unwrap_err", "expect_err")


#: the facts that token rules are made of
KINDS_OF = {**dict.fromkeys((63, 64), ("declared",)), **dict.fromkeys((65, 75, 76, 77, 78), ("calls", "tests")), 79: ("chains",), 101: ("chains", "chained"), **dict.fromkeys((121, 122), ("chained",))}


class Views:
    """The relations of a corpus files(path, content), each built when a rule first asks for it.

    What syntax asks of tokens is told where contents are read (operators.facts), but for large contents, whose tokens go through windows. With share, relations that several queries
    read are written to the shared folder and read back rather than derived again for each: that also keeps plans short, and survives lost executors. release() removes them.
    """

    def __init__(self, files: DataFrame, settings: Settings = Settings(), share: bool = False):
        self.settings, self.share, self.held = settings, share, []
        #: as they are stored: tokens are cut where contents are read
        whole = files.select("path", "content").where("content is not null")
        self.stored = self.shared(whole.withColumn("large", facts.large(F.col("content"))), "sources")
        self.sources = self.stored.select("path", "content")
        self._told: tuple[frozenset[str], DataFrame | None] = (frozenset(), None)

    @cached_property
    def files(self) -> DataFrame:
        """Dealt by path; windows and joins over lines are on path too. The number is given, for lines are larger than the contents by which partitions would be merged."""
        return self.sources.repartition(self.spread(self.sources), "path")

    @cached_property
    def has_large(self) -> bool:
        """Whether some contents are large; taken for granted where they would have to be derived for that."""
        return not self.share or not self.stored.where("large").isEmpty()

    @cached_property
    def only(self) -> facts.Only:
        product = rf"^(crate|super|self|{re.escape(self.settings.product)})::"
        return facts.Only((*UNWRAP_CALLS, "map_err", "or_else"), ("map_err", "or_else", "env", "new"), rf"{product}|Command::new\z", ("arg", "args", "join", "push"))

    def gather(self, numbers: set[int]) -> None:
        """Have the facts that rules of these numbers ask for told in one pass, where relations are shared."""
        kinds = frozenset(k for n in numbers for k in KINDS_OF.get(n, ()))
        if self.share and not kinds <= self._told[0]:
            self._told = kinds, self.shared(facts.facts_of(self.stored.where("not large"), tuple(k for k in facts.KINDS if k in kinds), self.only), "facts")

    def told(self, kind: str) -> DataFrame:
        """(path, columns of facts.KINDS) of the facts that rules ask for; text is null for large contents."""
        known = self._told[1] if kind in self._told[0] else facts.facts_of(self.stored.where("not large"), (kind,), self.only)
        return self._with_windowed(kind, known)

    def every(self, kind: str) -> DataFrame:
        """(path, columns of facts.KINDS) of all facts of a kind, without texts."""
        return self._with_windowed(kind, facts.facts_of(self.stored.where("not large"), (kind,)))

    def _with_windowed(self, kind: str, known: DataFrame) -> DataFrame:
        found = known.where(F.col(kind).isNotNull()).select("path", f"{kind}.*")
        if kind == "calls":
            found = found.withColumn("method", F.concat("gap", F.element_at(F.split("name", r"\."), -1)))
        return found.unionByName(self._windowed[kind](), allowMissingColumns=True) if self.has_large else found

    @cached_property
    def _windowed(self) -> dict[str, Callable[[], DataFrame]]:
        """The facts of large contents, by windows over their tokens."""
        contents = self.stored.where("large").select("path", "content")
        tokens, window = self.shared(lexer.tokens_of(contents), "tokens") if self.share else lexer.tokens_of(contents), Window.partitionBy("path").orderBy("idx")

        def calls() -> DataFrame:
            tests = syntax.test_functions(tokens).select("path", F.col("open_idx").alias("body"), F.col("close_idx").alias("body_end"))
            held = syntax.within(syntax.invocations(tokens), tests, "idx", "body", "body_end")
            inside = (F.col("idx") > F.col("body")) & (F.col("idx") < F.col("body_end"))
            held = held.withColumns({"body": F.when(inside, F.col("body")), "body_end": F.when(inside, F.col("body_end"))})
            asked = held.where(F.col("name").rlike(rf"({'|'.join(self.only.args_of)})\z"))
            args = syntax.inner_text(asked, contents, "open_start", "close_start", "args").select("path", "idx", "args")
            return held.join(args, ["path", "idx"], "left")

        def chains() -> DataFrame:
            around = tokens.select("path", "idx", F.lag("text").over(window).alias("previous"), F.lead("text").over(window).alias("next"))
            found = syntax.inner_text(syntax.chain_calls(syntax.chain_parts(tokens))[0], contents, "args_from", "args_to", "args")
            found = found.join(around.select("path", F.col("idx").alias("root_idx"), "previous"), ["path", "root_idx"])
            return found.join(around.select("path", F.col("idx").alias("end_idx"), "next"), ["path", "end_idx"])

        def declared() -> DataFrame:
            statements = lexer.statements_of(contents)
            found = syntax.declarations(statements)
            by_binding = [found.where(F.col("binding") == b) for b in ("let", "const")]
            left = [syntax.unused(syntax.uses_of(statements, d), d) for d in by_binding]
            return found.join(left[0].unionByName(left[1]).select("path", "idx", F.lit(False).alias("used")), ["path", "idx"], "left").withColumn("used", F.coalesce("used", F.lit(True)))

        return {
            "calls": calls, "chains": chains, "declared": declared, "tests": lambda: syntax.test_functions(tokens),
            "chained": lambda: syntax.inner_text(syntax.chain_calls(syntax.chain_parts(tokens))[1], contents, "open_start", "close_start", "args"),
        }

    @staticmethod
    def spread(files: DataFrame) -> int:
        """Partitions for what looks at lines."""
        return partitions_for(files, PARTITION_BYTES)

    def shared(self, df: DataFrame, name: str) -> DataFrame:
        if not self.share:
            return df
        self.held.append(keep(df, name))
        return self.held[-1]

    def release(self) -> None:
        for df in self.held:
            discard(df)
        self.held.clear()

    @cached_property
    def lines(self) -> DataFrame:
        return lexer.lines_of(self.files)

    @cached_property
    def loose_lines(self) -> DataFrame:
        """lines as they are stored, for what looks at one line at a time."""
        return lexer.lines_of(self.sources)

    @cached_property
    def tokens(self) -> DataFrame:
        return self.shared(lexer.tokens_of(self.sources), "tokens")

    @cached_property
    def invocations(self) -> DataFrame:
        return self.every("calls").drop("gap", "body", "body_end", "args", "text")

    @cached_property
    def chains(self) -> tuple[DataFrame, DataFrame]:
        return self.every("chains").drop("args", "previous", "next", "text"), self.every("chained").drop("args", "text")

    @cached_property
    def call_arguments(self) -> DataFrame:
        return self.every("chained").drop("text")

    @cached_property
    def test_functions(self) -> DataFrame:
        return self.every("tests").drop("text")

    @cached_property
    def statements(self) -> DataFrame:
        return self.shared(lexer.statements_of(self.sources), "statements")

    @cached_property
    def declarations(self) -> DataFrame:
        return self.every("declared").select("binding", "path", "name", "idx", "line", "col", "after", "scope_end", "parens", "brackets", "braces")

    @cached_property
    def regex_sites(self) -> DataFrame:
        return self.shared(regex_sites(lexer.lines_of(self.files_with(r"Regex(Builder)?::new\("))), "sites")

    def files_with(self, pattern: str) -> DataFrame:
        """files in which a pattern is found, dealt by path: what looks at lines around such a line needs no others."""
        return self.sources.where(F.col("content").rlike(pattern)).repartition(self.spread(self.sources), "path")

    def id_of(self, number: int) -> str:
        return f"{self.settings.rule_prefix}{number:03d}"


def _candidates(df: DataFrame, rule_id: str, line: str, column: Column | str, message: Column, anchor: str | None = None, snippet: Column | None = None, code_only: bool = False, text: Column | None = None) -> DataFrame:
    """text: that of the anchor line, where it is known; the result has such a column then."""
    return df.select(
        "path", F.lit(rule_id).alias("rule_id"), F.col(line).cast("int").alias("line"), (F.col(column) if isinstance(column, str) else column).cast("int").alias("column"), message.alias("message"),
        F.col(anchor or line).cast("int").alias("anchor_line"), (F.lit(None).cast("string") if snippet is None else snippet).alias("snippet"), F.lit(code_only).alias("code_only"),
        *([] if text is None else [text.alias("text")]),
    )


def _secret(word: str) -> Callable[[Column], Column]:
    pattern = rf'(?<!{T.WORD})(?i:[A-Za-z0-9_]*(?:{word})[A-Za-z0-9_]*)\s*(?::[^="]*)?=\s*&?r?#*"[^"]+"'
    return lambda line: T.starts_of(line, pattern)


def _token_literal(line: Column) -> Column:
    named = rf'(?<!{T.WORD})(?i:[A-Za-z0-9_]*token[A-Za-z0-9_]*)\s*(?::[^="]*)?=\s*&?r?#*"[^"]+"'
    known = r'"(?:gh[pousr]_[A-Za-z0-9]{10,}|xox[abp]-[A-Za-z0-9-]{10,})"'
    return F.when(line.rlike(named), T.starts_of(line, named)).otherwise(T.starts_of(line, known))


def _empty_doc(line: Column) -> Column:
    trimmed = T.trim_start(line)
    adjacent = T.trim_start(F.coalesce("above", F.lit(""))).startswith(trimmed) | T.trim_start(F.coalesce("below", F.lit(""))).startswith(trimmed)
    return F.when(trimmed.isin("///", "//!") & ~adjacent, F.array(_indent(line))).otherwise(F.array().cast("array<int>"))


def _empty_comment(line: Column) -> Column:
    empty = (T.trim_start(line) == "//") | (F.regexp_replace(line, r"(?U)\s+", "") == "/**/")
    return F.when(empty, F.array(_indent(line))).otherwise(F.array().cast("array<int>"))


def _indent(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(T.trim_start(line)) + 1


def _traversal(line: Column) -> Column:
    """array<struct<column, what>> of literal .. segments given to join, push and PathBuf::from."""

    def calls(call: str) -> Column:
        risky = F.filter(T.calls_of(line, call), lambda m: m["arg"].contains("..") & m["arg"].rlike("[\"']"))
        return F.when(line.contains(call + "("), F.transform(risky, lambda m: F.struct(m["column"].alias("column"), F.lit(call).alias("what"))))

    found = [calls(".join"), calls(".push")]
    at = F.octet_length(F.substring_index(line, "PathBuf::from(", 1)) + 1
    arg = F.regexp_extract(line, r"PathBuf::from\(([^)]*)\)", 1)
    whole = F.when(line.contains("PathBuf::from(") & arg.contains("..") & arg.contains('"'), F.array(F.struct(at.alias("column"), F.lit("PathBuf::from").alias("what"))))
    none = F.array().cast("array<struct<column:int,what:string>>")
    return F.concat(*[F.coalesce(x, none) for x in (*found, whole)])


#: rules that look at one line: number, columns of hits, message, whether comment lines are left out
LINE_RULES: dict[int, tuple[Callable[[Column], Column], str, bool]] = {
    1: (lambda x: T.words_at(x, "todo", r"(?U:\s*)!"), "`todo!` macro found", True),
    2: (lambda x: T.words_at(x, "unimplemented", r"(?U:\s*)!"), "`unimplemented!` macro found", True),
    3: (lambda x: T.words_at(x, "dbg", r"(?U:\s*)!"), "`dbg!` macro found", True),
    4: (lambda x: T.words_at(x, "panic", r"(?U:\s*)!"), "`panic!` macro found", True),
    20: (lambda x: T.starts_of(x, rf"(?<!{T.WORD})unsafe(?!{T.WORD})(?!(?U:\s*)fn(?:\z|[ (]))"), "`unsafe` usage found", True),
    21: (lambda x: T.starts_of(x, rf"(?<!{T.WORD})unsafe(?!{T.WORD})(?=(?U:\s*)fn(?:\z|[ (]))"), "`unsafe fn` declaration found", True),
    40: (_secret("password|passwd|pwd"), "hardcoded password found", True),
    41: (_secret("api_?key"), "hardcoded API key found", True),
    42: (_secret("secret"), "hardcoded secret found", True),
    43: (_token_literal, "hardcoded token found", True),
    44: (lambda x: T.starts_of(x, r'"[a-z][a-z0-9+.-]*://[^\s:/@"]+:[^\s/@"]+@'), "URL with credentials found", True),
    61: (_empty_doc, "empty doc comment found", False),
    62: (_empty_comment, "empty comment found", False),
    100: (lambda x: T.words_at(x, "Command", r"(?U:\s*)::new\("), "`Command::new` usage found", False),
}
#: what a line must hold for a line rule to look at it: keeps the patterns off most lines
_NEEDLES: dict[int, str] = {1: "todo", 2: "unimplemented", 3: "dbg", 4: "panic", 20: "unsafe", 21: "unsafe", 40: '"', 41: '"', 42: '"', 43: '"', 44: "://", 61: "//", 62: "/", 100: "Command"}


def _hits(rule_id: str, line: Column, columns: Callable[[Column], Column], message: str, code_only: bool) -> Column:
    return F.transform(columns(line), lambda c: F.struct(F.lit(rule_id).alias("rule_id"), c.alias("column"), F.lit(message).alias("message"), F.lit(code_only).alias("code_only")))


def line_rules(views: Views, numbers: list[int]) -> DataFrame:
    """All rules that look at one line, in one pass over the lines."""
    lines = views.lines if 61 in numbers else views.loose_lines
    if 61 in numbers:
        window = Window.partitionBy("path").orderBy("line")
        lines = lines.withColumns({"above": F.lag("text").over(window), "below": F.lead("text").over(window)})
    hit = "array<struct<rule_id:string,column:int,message:string,code_only:boolean>>"
    none = F.array().cast(hit)
    line = F.col("text")
    found = []
    for n in numbers:
        if n == 120:
            hits = F.transform(_traversal(line), lambda t: F.struct(F.lit(views.id_of(120)).alias("rule_id"), t["column"].alias("column"), F.concat(F.lit("literal `..` path segment passed to `"), t["what"], F.lit("`")).alias("message"), F.lit(False).alias("code_only")))
            found.append(F.when(line.contains(".."), hits).otherwise(none))
            continue
        found.append(F.when(line.contains(_NEEDLES[n]), _hits(views.id_of(n), line, *LINE_RULES[n])).otherwise(none))
    each = lines.select("path", "line", "text", F.explode(F.concat(*found)).alias("hit"))
    return each.select("path", "hit.rule_id", "line", "hit.column", "hit.message", F.col("line").alias("anchor_line"), F.lit(None).cast("string").alias("snippet"), "hit.code_only", "text")


def manual_clamp(views: Views) -> DataFrame:
    """min after max, or max after min, that begins at most 235 bytes later; columns count characters. The snippet has 20 characters more on either side."""
    pieces = F.split("content", r"(?=\.max\(|\.min\()", -1)
    at = views.files.where(F.col("content").contains(".max(") & F.col("content").contains(".min(")).select("path", F.posexplode(pieces).alias("n", "text"))
    past = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    text = F.col("text")
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    placed = at.withColumns({"start": F.coalesce(F.sum(F.octet_length(text)).over(past), F.lit(0)), "chars": F.coalesce(F.sum(F.length(text)).over(past), F.lit(0)), "line": 1 + F.coalesce(F.sum(newlines).over(past), F.lit(0))})
    line_start = F.col("chars") + F.length(text) - F.length(F.regexp_extract(text, r"[^\n]*\z", 0))
    placed = placed.withColumn("column", F.col("chars") - F.coalesce(F.max(F.when(newlines > 0, line_start)).over(past), F.lit(0)) + 1).withColumn("what", F.substring("text", 1, 5))
    calls = placed.where(F.col("what").isin(".max(", ".min("))
    later = Window.partitionBy("path").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("what") == ".max(", F.last(F.when(F.col("what") == ".min(", F.struct("start", "chars")), True).over(later)).otherwise(F.last(F.when(F.col("what") == ".max(", F.struct("start", "chars")), True).over(later))
    near = calls.withColumn("other", other).where(F.col("other.start") - F.col("start") <= 235)
    begin = F.greatest(F.col("chars") - 20, F.lit(0))
    cut = F.substring(F.col("content"), begin.cast("int") + 1, (F.col("other.chars") + 25 - begin).cast("int"))
    return _candidates(near.join(views.files, "path"), views.id_of(60), "line", "column", F.lit("manual clamp-like min/max chain found"), snippet=F.replace(T.trim(cut), F.lit("\n"), F.lit(" ")))


def unused_bindings(views: Views, binding: str) -> DataFrame:
    left = views.told("declared").where((F.col("binding") == binding) & ~F.col("used"))
    number, word = (63, "variable") if binding == "let" else (64, "constant")
    return _candidates(left, views.id_of(number), "line", "col", F.concat(F.lit(f"unused {word} `"), F.col("name"), F.lit("`")), text=F.col("text"))


def _product_path(views: Views) -> Column:
    return F.col("name").rlike(rf"^(crate|super|self|{re.escape(views.settings.product)})::")


def _test_facts(views: Views) -> DataFrame:
    """Test functions with what their bodies call: product reference, direct product call, assert macro, nothing but asserts."""
    called = views.told("calls").where("body is not null")
    product = views.settings.product
    asks = (F.col("kind") == "macro") & (F.col("name") == "env") | (F.col("kind") == "call") & F.col("name").isin("Command::new", "std::process::Command::new")
    binary = F.when(F.col("kind") == "macro", F.col("args").contains(f'"CARGO_BIN_EXE_{product}"')).otherwise(T.trim_start(F.col("args")).startswith(f'"{product}"'))
    is_assert = (F.col("kind") == "macro") & F.col("name").isin(*ASSERT_MACROS)
    facts_ = called.groupBy("path", "body").agg(
        F.bool_or(_product_path(views)).alias("referenced"), F.bool_or(_product_path(views) & (F.col("kind") == "call")).alias("called"), F.bool_or(is_assert).alias("asserts"), F.bool_and(is_assert).alias("only_asserts"),
        F.bool_or(asks & binary).alias("indirect"),
    )
    whole = views.told("tests").withColumn("body", F.col("open_idx")).join(facts_, ["path", "body"], "left")
    no = F.lit(False)
    return whole.select("path", "line", "end_line", "text", (F.coalesce("referenced", no) | F.coalesce("indirect", no)).alias("referenced"), F.coalesce("called", no).alias("called"), F.coalesce("asserts", no).alias("asserts"), F.coalesce("only_asserts", F.lit(True)).alias("only_asserts"))


def test_rules(views: Views) -> dict[int, DataFrame]:
    facts_, text = _test_facts(views), F.col("text")
    one, whole = F.lit(1), facts_.groupBy("path").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("text"), F.bool_or("referenced").alias("referenced")).where("not referenced")
    return {
        65: _candidates(whole, views.id_of(65), "line", one, F.lit("test code found without any product-code reference"), text=text),
        75: _candidates(facts_.where("not referenced and asserts and only_asserts"), views.id_of(75), "line", one, F.lit("test function uses assertions but does not call product code"), text=text),
        78: _candidates(facts_.where("called and not asserts"), views.id_of(78), "line", one, F.lit("test function calls product code without any assertion"), text=text),
    }


def fallible_rules(views: Views) -> dict[int, DataFrame]:
    tests, text = views.told("tests").select("path", F.col("line").alias("test_line"), F.col("end_line").alias("test_end")), F.col("text")
    calls = views.told("calls").where(F.col("kind") == "call").where(~F.col("path").rlike("(^|/)tests/")).where(F.col("method").isin(*UNWRAP_CALLS, "map_err", "or_else"))
    outside = syntax.within(calls, tests, "line", "test_line", "test_end").where("test_line is null")
    erased = outside.where(F.col("method").isin("map_err", "or_else") & T.trim_start(F.col("args")).startswith("|_|"))
    return {
        76: _candidates(outside.where(F.col("method").isin(*UNWRAP_CALLS)), views.id_of(76), "line", "col", F.concat(F.lit("non-test code uses `"), F.col("method"), F.lit("`")), code_only=True, text=text),
        77: _candidates(erased, views.id_of(77), "line", "col", F.lit("error mapping erases the original error value"), code_only=True, text=text),
    }


def ignored_results(views: Views) -> DataFrame:
    product = rf"^(crate|super|self|{re.escape(views.settings.product)})::"
    chains = views.told("chains").where(F.col("root").rlike(product))
    bare = chains.where((F.col("previous").isNull() | F.col("previous").rlike(r"[{};]\z")) & (F.col("next") == ";"))
    return _candidates(bare, views.id_of(79), "line", "col", F.concat(F.lit("result of product call `"), F.col("root"), F.lit("` is silently dropped")), text=F.col("text"))


def regex_sites(lines: DataFrame) -> DataFrame:
    """(path, line, column, arg, pattern, text): arguments of regex constructors and their line; pattern is the value of a literal argument, else null.

    A statement is the line and up to five more, as far as the first that holds a semicolon. Raw text is matched, comments included.
    """
    marker = r"(?<=Regex::new\(|RegexBuilder::new\()"
    near = lexer.with_neighbours(lines, 0, 5).where(F.col("text").rlike(r"Regex(Builder)?::new\("))
    pieces = F.split("text", marker, -1)
    later = F.aggregate(
        "after", F.struct(F.col("text").contains(";").alias("done"), F.lit("").alias("text")),
        lambda acc, x: F.struct((acc["done"] | x.contains(";")).alias("done"), F.when(acc["done"], acc["text"]).otherwise(F.concat(acc["text"], F.lit("\n"), x)).alias("text")),
    )["text"]
    each = near.withColumn("pieces", pieces).withColumn("later", later).select("path", "line", "text", "later", "pieces", F.explode(F.sequence(F.lit(1), F.size("pieces") - 1)).alias("n"))
    column = F.octet_length(F.array_join(F.slice("pieces", F.lit(1), F.col("n")), "")) + 1
    rest = F.concat(F.array_join(F.slice("pieces", F.col("n") + 1, F.size("pieces")), ""), F.col("later"))
    sited = each.withColumn("column", column).withColumn("arg", T.trim(T.argument_at(rest))).where("arg is not null")
    return sited.select("path", "line", "column", "arg", T.literal_value(F.col("arg")).alias("pattern"), "text").distinct()


def nested_quantifier(pattern: Column) -> Column:
    """Whether the regex repeats a group that repeats something itself, however deep; escaped characters and character classes do not count.

    One pass over the characters: the state has a digit for each open group, 1 once something in it is repeated.
    """
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("within"), F.lit(False).alias("closed"), F.lit(False).alias("hit"))

    def step(state: Column, x: Column) -> Column:
        plain, held = ~state["within"], state["open"]
        opens, closes = plain & (x == "("), plain & (x == ")") & (held != "")
        repeats = x.isin("*", "+", "{")
        inner = F.when(opens, F.concat(held, F.lit("0"))).when(closes, F.substring(held, F.lit(1), F.length(held) - 1)).when(plain & repeats, F.replace(held, F.lit("0"), F.lit("1"))).otherwise(held)
        within = F.when(x == "[", True).when(x == "]", False).otherwise(state["within"])
        return F.struct(inner.alias("open"), within.alias("within"), (closes & held.endswith("1")).alias("closed"), (state["hit"] | (state["closed"] & repeats)).alias("hit"))

    return F.aggregate(F.regexp_extract_all(pattern, F.lit(r"\\?(?s:.)"), 0), start, step, lambda state: state["hit"])


def suspicious(pattern: Column) -> Column:
    wild = lambda w: F.size(F.split(pattern, re.escape(w), -1)) - 1
    broad = pattern.startswith(".*") & pattern.endswith(".*") & ((wild(".*") >= 2) | (wild(".+") >= 2))
    empty = pattern.startswith("|") | pattern.endswith("|") | T.contains_any(pattern, ("||", "(|", "|)"))
    return T.contains_any(pattern, (".*.*", ".+.+")) | broad | empty


def dynamic(arg: Column) -> Column:
    """Neither a whole string literal nor concat! of such; the parts of concat! are cut at its commas."""
    static = arg.rlike(rf"^concat!\(\s*(?:{T.literal(1)}\s*(?:,\s*{T.literal(2)}\s*)*,?\s*)?\)\z")
    return (arg != "") & T.literal_value(arg).isNull() & ~static


def anchored(pattern: Column) -> Column:
    return pattern.startswith("^") & pattern.endswith("$")


def validation_context(before: Column, text: Column, after: Column) -> Column:
    context = F.lower(F.array_join(F.concat(before, F.array(text), after), " "))
    return T.contains_any(context, VALIDATION_MARKERS) | ~T.contains_any(context, SEARCH_MARKERS)


def regex_rules(views: Views) -> dict[int, DataFrame]:
    sites, text = views.regex_sites, F.col("text")
    quoted = F.concat(F.lit("unanchored validation regex `"), F.col("value"), F.lit("`"))
    found = r"is_match\(|captures\("
    matches = lexer.with_neighbours(lexer.lines_of(views.files_with(found)), 2, 2).where(F.col("text").rlike(found))
    matches = matches.where(validation_context(F.col("before"), F.col("text"), F.col("after"))).select("path", F.col("line").alias("at"), "text")
    literals = matches.select("path", "at", "text", F.explode(T.literals_of(F.col("text"))).alias("l")).select("path", "at", F.col("at").alias("line"), "l.column", "l.value", "text")
    own = literals.where(F.col("value").rlike(r"[\[\]()+*?^$|{}.\\]") & ~anchored(F.col("value")))
    reach = sites.where(F.col("pattern").isNotNull() & ~anchored(F.col("pattern"))).select("path", "line", "column", F.col("pattern").alias("value"), F.explode(F.sequence(F.col("line") - 1, F.col("line") + 2)).alias("at"))
    without = matches.select("path", "at", "text").join(own.select("path", "at").distinct(), ["path", "at"], "left_anti")
    first = Window.partitionBy("path", "at").orderBy("line", "column", "value")
    nearby = reach.join(without, ["path", "at"]).withColumn("n", F.row_number().over(first)).where("n = 1").select(*own.columns)
    return {
        80: _candidates(sites.where(nested_quantifier(F.col("pattern"))), views.id_of(80), "line", "column", F.concat(F.lit("suspicious nested regex quantifier in pattern `"), F.col("pattern"), F.lit("`")), text=text),
        81: _candidates(sites.where(suspicious(F.col("pattern"))), views.id_of(81), "line", "column", F.concat(F.lit("suspicious regex pattern `"), F.col("pattern"), F.lit("`")), text=text),
        82: _candidates(sites.where(dynamic(F.col("arg"))), views.id_of(82), "line", "column", F.lit("dynamic regex pattern construction found"), text=text),
        83: _candidates(own.unionByName(nearby), views.id_of(83), "line", "column", quoted, anchor="at", text=text),
    }


def env_bound(lines: DataFrame) -> DataFrame:
    """(path, names): variables bound on a line that reads the environment."""
    name = F.regexp_extract("text", rf"(?U)^\s*let \s*(?:mut \s*)?({T.WORD}+)", 1)
    return lines.where(T.contains_any(F.col("text"), ENV_MARKERS)).select("path", name.alias("name")).where("name <> ''").groupBy("path").agg(F.collect_set("name").alias("names"))


def _literal_of(arg: Column, allowed: tuple[str, ...]) -> Column:
    return T.trim(arg).isin(*[f'"{a}"' for a in allowed])


def shell_injection(views: Views) -> DataFrame:
    chains = views.told("chains").where(F.col("root").endswith("Command::new") & F.col("args_close").isNotNull())
    shells = chains.where(_literal_of(F.col("args"), SHELLS)).select("path", "root_idx", F.col("line").alias("chain_line"), "text")
    calls = views.told("chained").drop("text").where(F.col("name").isin("arg", "args")).join(shells, ["path", "root_idx"]).join(env_bound(views.loose_lines), "path", "left")
    words = F.regexp_extract_all("args", F.lit(f"{T.WORD}+"), 0)
    risky = T.contains_any(F.col("args"), DYNAMIC_MARKERS + ENV_MARKERS) | F.coalesce(F.arrays_overlap(words, "names"), F.lit(False))
    order = Window.partitionBy("path", "root_idx").orderBy("idx")
    flag = _literal_of(F.col("args"), SHELL_FLAGS)
    flagged = calls.withColumn("flag", flag).withColumn("armed", F.max("flag").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    hits = flagged.where(F.col("armed") & ~F.col("flag") & risky).withColumn("n", F.row_number().over(order)).where("n = 1")
    return _candidates(hits, views.id_of(101), "line", "col", F.lit("shell command built from dynamic input found"), anchor="chain_line", text=F.col("text"))


def path_rules(views: Views) -> dict[int, DataFrame]:
    joins = views.told("chained").where(F.col("name").isin("join", "push")).withColumn("arg", T.trim(F.col("args"))).where(~F.col("arg").startswith('"'))
    untrusted = joins.where((F.col("arg") != "") & T.contains_any(F.lower("arg"), UNTRUSTED_WORDS))
    message = F.concat(F.lit("`."), F.col("name"), F.lit("` call joins a path with untrusted-looking input `"), F.col("arg"), F.lit("`"))
    entries = joins.where(T.contains_any(F.lower("arg"), ENTRY_WORDS) & ~T.contains_any(F.lower("arg"), SAFE_ENTRY_CALLS))
    # lines of files that hold what the argument and the lines around it must
    content = F.lower("content")
    held = views.sources.where(T.contains_any(content, ENTRY_WORDS) & T.contains_any(content, ARCHIVE_WORDS) & T.contains_any(content, ("join", "push")))
    around = lexer.with_neighbours(lexer.lines_of(held.repartition(views.spread(views.sources), "path")), 4, 4)
    near = entries.drop("text").join(around, ["path", "line"])
    context = F.lower(F.array_join(F.concat(F.slice("before", F.greatest(F.size("before") - 1, F.lit(1)), 2), F.array("text"), F.slice("after", 1, 1)), " "))
    near = near.where(T.contains_any(context, ARCHIVE_WORDS))
    derived = F.col("arg").rlike("^[A-Za-z0-9_]+$") & F.exists("before", lambda x: x.contains(F.col("arg")) & T.contains_any(F.lower(x), SAFE_ENTRY_CALLS))
    joined = T.assigned_name(F.col("text"))
    resolved = F.filter("after", lambda x: x.contains(F.concat(joined, F.lit(".canonicalize("))))
    canonical = F.when(F.size(resolved) > 0, T.assigned_name(F.element_at(resolved, -1)))
    guarded = F.coalesce(F.exists("after", lambda x: x.contains(F.concat(canonical, F.lit(".starts_with(")))), F.lit(False))
    unsafe = near.where(~derived & ~guarded)
    return {
        121: _candidates(untrusted, views.id_of(121), "line", "col", message, text=F.col("text")),
        122: _candidates(unsafe, views.id_of(122), "line", "col", F.concat(F.lit("archive extraction joins destination path with entry-derived input `"), F.col("arg"), F.lit("`")), text=F.col("text")),
    }


#: builders of further rules that users register: rule number -> candidates
EXTRA_RULES: dict[int, Callable[[Views], DataFrame]] = {}


def register_rule(number: int):
    """Decorator: a function of Views that gives candidates (see CANDIDATE) becomes the rule of that number; its row joins the rule dimension with scan(extra=...)."""

    def add(builder: Callable[[Views], DataFrame]):
        EXTRA_RULES[number] = builder
        return builder

    return add


def register_row_rule(number: int):
    """Decorator: a function of (path, content) that yields (line, column, message) becomes the rule of that number, as a table function joined laterally to the files.

    For rules that no query over the views expresses: they see one file at a time. Prefilter, suppressions and severities apply as to any rule; its row joins the rule dimension with scan(extra=...).
    """

    def add(function: Callable[[str, str], Iterable[tuple[int, int, str]]]):
        class Rows:
            def eval(self, path: str, content: str):
                yield from function(path, content)

        def build(views: Views) -> DataFrame:
            table = F.udtf(Rows, returnType="line int, column int, message string", useArrow=True)
            found = views.sources.lateralJoin(table(F.col("path").outer(), F.col("content").outer()))
            return _candidates(found, views.id_of(number), "line", "column", F.col("message"))

        EXTRA_RULES[number] = build
        return function

    return add


def candidates(views: Views, numbers: set[int]) -> list[tuple[DataFrame, str]]:
    """The candidates of the rules with the given numbers, in parts, each with what is known of its anchor lines' text: `all` of it or none is needed, of contents that are not `large`, or
    `none`. Only the views that they need are planned.
    """
    parts: list[tuple[DataFrame, str]] = []
    views.gather(numbers)
    by_line = [n for n in [*LINE_RULES, 120] if n in numbers]
    if 61 in by_line and len(by_line) > 1:
        # the one that looks at neighbours alone deals contents by path
        by_line.remove(61)
        parts.append((line_rules(views, [61]), "all"))
    if by_line:
        parts.append((line_rules(views, by_line), "all"))
    single = {60: (manual_clamp, "all"), 63: (lambda v: unused_bindings(v, "let"), "large"), 64: (lambda v: unused_bindings(v, "const"), "large"), 79: (ignored_results, "large"), 101: (shell_injection, "large"), **{n: (build, "none") for n, build in EXTRA_RULES.items()}}
    parts += [(build(views), known) for n, (build, known) in single.items() if n in numbers]
    for family, build, known in (({65, 75, 78}, test_rules, "large"), ({76, 77}, fallible_rules, "large"), ({80, 81, 82, 83}, regex_rules, "all"), ({121, 122}, path_rules, "large")):
        if wanted := family & numbers:
            made = build(views)
            parts += [(made[n], known) for n in sorted(wanted)]
    return parts
