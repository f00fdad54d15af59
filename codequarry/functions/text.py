"""Column functions over source text. Columns count bytes of UTF-8, as findings do."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: letters, digits and underscore, as they bound a word
WORD = r"[\p{IsAlphabetic}\p{N}_]"
#: an ordinary string literal
QUOTED = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"'


def literal(group: int) -> str:
    """A pattern for one string literal, ordinary or raw with any number of hashes; these are the capturing group of the given number."""
    return rf'(?:{QUOTED}|r(#*+)"(?:(?!"\{group})(?s:.))*+"\{group})'


#: what is before, in and after a literal, as the tiles of group 1
_TILES = rf'({literal(2)}|[^"r]+|(?s:.))'
#: the same where parentheses are tiles of their own
_ARGUMENT_TILES = rf'({literal(2)}|[^"r()]+|(?s:.))'


def size_in_bytes(text: Column) -> Column:
    return F.octet_length(text)


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_comment_line(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*(//|\*|/\*)")


def comment_text(line: Column) -> Column:
    """What follows the first // of a line, else the first /* up to its end; null where there is neither. Strings are not looked at."""
    block = F.regexp_extract(line, r"(?s)/\*(.*?)(\*/|$)", 1)
    return F.when(line.contains("//"), F.regexp_extract(line, r"(?s)^.*?//(.*)$", 1)).when(line.contains("/*"), block)


def starts_of(line: Column, pattern: str) -> Column:
    """Byte columns, from 1, where the pattern begins; matches do not overlap. The pattern must not match the empty string or hold groups that capture."""
    # cut before each match: the pieces before the n-th cut add up to its offset
    pieces = F.split(line, f"(?={pattern})", -1)
    begin = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.octet_length(F.array_join(F.slice(pieces, 1, i), "")) + 1)
    first = F.when(F.element_at(pieces, 1).rlike(f"^(?:{pattern})"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(pieces) > 1, F.concat(first, begin)).otherwise(first)


def words_at(line: Column, word: str, then: str = "") -> Column:
    """Byte columns of whole-word occurrences of word, followed by the pattern `then`."""
    return starts_of(line, f"(?<!{WORD}){re.escape(word)}(?!{WORD}){f'(?={then})' if then else ''}")


def literals_of(line: Column) -> Column:
    """array<struct<column int, value string>>: the string literals of a line, escapes dropped."""
    tiles = F.regexp_extract_all(line, F.lit(_TILES), 1)
    at = F.transform(F.sequence(F.lit(1), F.size(tiles)), lambda i: F.struct((F.octet_length(F.array_join(F.slice(tiles, 1, i - 1), "")) + 1).alias("column"), literal_value(F.element_at(tiles, i)).alias("value")))
    return F.filter(F.when(F.size(tiles) > 0, at), lambda t: t["value"].isNotNull())


def literal_value(text: Column) -> Column:
    """The value of text if it is one whole string literal, else null."""
    plain = F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r"(?s)\\(.)", "$1")
    raw = F.regexp_extract(text, r'(?s)^r#*"(.*)"#*$', 1)
    return F.when(text.rlike(f"^{literal(1)}\\z"), F.when(text.startswith("r"), raw).otherwise(plain))


def closing_at(tiles: Column) -> Column:
    """How many characters of the text that tiles make up come before the parenthesis that closes one opened before it; null if none does."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(state: Column, tile: Column) -> Column:
        depth = state["depth"] + F.when(tile == "(", 1).when(tile == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (state["at"] + F.length(tile)).alias("at"), F.when((state["end"] < 0) & (depth == 0), state["at"]).otherwise(state["end"]).alias("end"))

    return F.aggregate(tiles, start, step, lambda state: F.when(state["end"] >= 0, state["end"]))


def argument_at(rest: Column) -> Column:
    """The text of rest up to the parenthesis that closes an argument list, at any depth; parentheses in string literals do not count. Null if none does."""
    return F.substring(rest, F.lit(1), closing_at(F.regexp_extract_all(rest, F.lit(_ARGUMENT_TILES), 1)))


def calls_of(line: Column, call: str) -> Column:
    """array<struct<column int, arg string>>: closed calls `call(...)` of a line that are in no other such call, with their byte columns; every parenthesis counts."""
    pieces = F.split(line, rf"(?<={re.escape(call)}\()", -1)
    tiles = lambda rest: F.regexp_extract_all(rest, F.lit(r"[()]|[^()]+"), 0)

    def made(i: Column) -> Column:
        head, rest = F.array_join(F.slice(pieces, F.lit(1), i), ""), F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "")
        arg = F.substring(rest, F.lit(1), closing_at(tiles(rest)))
        begin = F.length(head)
        return F.struct((F.octet_length(head) - len(call)).alias("column"), arg.alias("arg"), begin.alias("begin"), (begin + F.length(arg)).alias("end"))

    closed = F.filter(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), made), lambda c: c["arg"].isNotNull())
    outer = F.filter(closed, lambda c: ~F.exists(closed, lambda o: (o["begin"] < c["begin"]) & (o["end"] > c["begin"])))
    return F.when(F.size(pieces) > 1, F.transform(outer, lambda c: F.struct(c["column"].alias("column"), c["arg"].alias("arg"))))


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(m) for m in markers))


def assigned_name(line: Column) -> Column:
    """The simple identifier left of the first = of a line; null where there is none."""
    left = trim(F.element_at(F.split(line, "=", 2), 1))
    left = trim(F.regexp_replace(trim(F.regexp_replace(left, "^let ", "")), "^mut ", ""))
    name = trim(F.element_at(F.split(left, ":"), 1))
    return F.when(line.contains("=") & name.rlike("^[A-Za-z0-9_]+$"), name)
