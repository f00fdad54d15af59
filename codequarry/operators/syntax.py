"""Syntax as relations over tokens: invocations, method chains, test functions, declarations.

All of it is lead and lag, running sums and last values over tokens in order, and equi-joins on path and a position; nothing is parsed by recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEST_MARKERS = ("#[test]", "#[tokio::test]", "#[actix_rt::test]", "#[actix_web::test]", "#[async_std::test]")  # fixed values


def _order(*partition: str):
    return Window.partitionBy("path", *partition).orderBy("idx")


def partners(tokens: DataFrame, opening: str, closing: str, depth: str) -> DataFrame:
    """(path, open_idx, open_start, close_idx, close_start, close_line) of matching delimiters; starts are byte offsets.

    Opener and closer of one pair follow each other among the delimiters of their level.
    """
    pairs = tokens.where(F.col("text").isin(opening, closing)).withColumn("level", F.col(depth) - F.when(F.col("text") == closing, 1).otherwise(0))
    window = _order("level")
    led = pairs.select("path", F.col("idx").alias("open_idx"), F.col("start").alias("open_start"), "text", *[F.lead(c).over(window).alias(f"close_{c}") for c in ("idx", "start", "line", "text")])
    return led.where((F.col("text") == opening) & (F.col("close_text") == closing)).drop("text", "close_text")


def inner_text(spans: DataFrame, files: DataFrame, first: str, last: str, into: str) -> DataFrame:
    """spans with the content strictly between two delimiters of one byte, given by columns of their byte offsets; null where last is."""
    whole = files.select("path", F.col("content").cast("binary").alias("__bytes"))
    inside = F.substring("__bytes", (F.col(first) + 2).cast("int"), (F.col(last) - F.col(first) - 1).cast("int")).cast("string")
    return spans.join(whole, "path").withColumn(into, F.when(F.col(last).isNotNull(), inside)).drop("__bytes")


def invocations(tokens: DataFrame) -> DataFrame:
    """(path, idx, line, col, name, method, kind, open_idx, close_idx, open_start, close_start): paths of identifiers followed by ( or !.

    An identifier continues a path if . or :: and an identifier precede it, white space allowed, comments not. name is the path without white space, method what follows its
    last dot. open_idx is the parenthesis, for a macro only one that touches the !; close_idx is null where it is never closed.
    """
    window = _order()
    near = tokens.select("path", "idx", "line", "col", "text", "kind", "gap", *[F.lag("text", n).over(window).alias(f"p{n}") for n in (1,)], *[F.lag("kind", n).over(window).alias(f"k{n}") for n in (2,)], F.lead("text").over(window).alias("n1"), F.lead("idx").over(window).alias("n1_idx"), F.lead("text", 2).over(window).alias("n2"), F.lead("idx", 2).over(window).alias("n2_idx"))
    idents = near.where("kind = 'ident'").withColumn("linked", F.coalesce(F.col("p1").isin(".", "::") & (F.col("k2") == "ident"), F.lit(False)))
    island = idents.withColumn("path_no", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(_order()))
    whole = Window.partitionBy("path", "path_no").orderBy("idx")
    piece = F.concat(F.when(F.col("linked"), F.col("p1")).otherwise(""), F.col("text"))
    named = (
        island.withColumn("name", F.array_join(F.collect_list(piece).over(whole), ""))
        .withColumns({"first_idx": F.first("idx").over(whole), "first_line": F.first("line").over(whole), "first_col": F.first("col").over(whole)})
        # white space after the last dot is part of the method's text and makes it another one
        .withColumn("method", F.concat(F.when(F.col("linked") & (F.col("p1") == "."), F.col("gap")).otherwise(""), F.element_at(F.split("name", r"\."), -1)))
    )
    ends = named.where(F.col("n1").isin("(", "!"))
    opened = F.when(F.col("n1") == "(", F.col("n1_idx")).when((F.col("n2") == "(") & (F.col("n2_idx") == F.col("n1_idx") + 1), F.col("n2_idx"))
    called = ends.select("path", F.col("first_idx").alias("idx"), F.col("first_line").alias("line"), F.col("first_col").alias("col"), "name", "method", F.when(F.col("n1") == "(", "call").otherwise("macro").alias("kind"), opened.alias("open_idx"))
    closed = partners(tokens, "(", ")", "parens").drop("close_line")
    return called.join(closed, ["path", "open_idx"], "left")


def chain_parts(tokens: DataFrame) -> DataFrame:
    """Identifiers that may take part in method chains: path, idx, text, line, col, call, head (idx, line, col of the root's first segment), root, args_open, args_close, their byte offsets args_from and args_to, and `of`, the root (idx, line, col) they belong to.

    White space and comments may stand between the parts of a chain, not inside a root.
    """
    closed = partners(tokens, "(", ")", "parens").select("path", F.col("open_idx").alias("idx"), "close_idx", "close_start")
    stream = tokens.where("kind <> 'comment'").join(closed, ["path", "idx"], "left")
    touching = _order()
    segment = stream.withColumn("inner", (F.col("kind") == "ident") & (F.lag("text").over(touching) == "::") & (F.lag("kind", 2).over(touching) == "ident") & (F.lag("idx", 2).over(touching) == F.col("idx") - 2))
    heads = F.when((F.col("kind") == "ident") & ~F.coalesce("inner", F.lit(False)), F.struct("idx", "line", "col"))
    rooted = segment.withColumn("head", F.last(heads, True).over(touching.rowsBetween(Window.unboundedPreceding, 0)))
    root_text = F.array_join(F.collect_list(F.when(F.coalesce("inner", F.lit(False)), F.concat(F.lit("::"), F.col("text"))).otherwise(F.when(F.col("kind") == "ident", F.col("text")))).over(Window.partitionBy("path", "head.idx").orderBy("idx")), "")
    rooted = rooted.withColumn("root", root_text)
    # each level of parentheses is a stream of its own, cut where a parenthesis of that level opens
    level = F.when(F.col("text") == ")", F.col("parens") - 1).otherwise(F.col("parens"))
    own = F.struct(level.alias("level"), F.col("text").alias("mark"))
    cut = F.when(F.col("text") == "(", F.struct((F.col("parens") + 1).alias("level"), F.lit("cut").alias("mark")))
    levels = rooted.withColumn("at", F.explode(F.array_compact(F.array(own, cut)))).withColumns({"level": F.col("at.level"), "mark": F.col("at.mark")}).withColumn("kind", F.when(F.col("mark") == "cut", "cut").otherwise(F.col("kind")))
    window = _order("level")
    seen = levels.withColumns(
        {"p1": F.lag("mark").over(window), "p2": F.lag("mark", 2).over(window), "k2": F.lag("kind", 2).over(window), "k4": F.lag("kind", 4).over(window), "p3": F.lag("mark", 3).over(window), "n1": F.lead("mark").over(window), "n1_idx": F.lead("idx").over(window), "n1_close": F.lead("close_idx").over(window), "n1_from": F.lead("start").over(window), "n1_to": F.lead("close_start").over(window)}
    ).where("kind <> 'cut'")
    attached = (F.col("k2") == "ident") | ((F.col("p2") == ")") & (F.col("p3") == "(") & (F.col("k4") == "ident"))
    has_args = (F.col("n1") == "(") & F.col("n1_close").isNotNull()
    seen = seen.withColumn("call", F.coalesce((F.col("kind") == "ident") & (F.col("p1") == ".") & has_args & attached, F.lit(False)))
    seen = seen.withColumn("of", F.last(F.when((F.col("kind") == "ident") & ~F.col("call"), F.col("head")), True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where("kind = 'ident'").select("path", "idx", "text", "line", "col", "call", "head", "root", F.when(has_args, F.col("n1_idx")).alias("args_open"), F.when(has_args, F.col("n1_close")).alias("args_close"), F.when(has_args, F.col("n1_from")).alias("args_from"), F.when(has_args, F.col("n1_to")).alias("args_to"), "of")


def chain_calls(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, calls) of method chains `root::path(args).name(args).name(args)`, from chain_parts().

    chains: path, root_idx, root, line, col, args_open, args_close, args_from, args_to (null without root arguments), end_idx, n_calls. calls: path, root_idx, idx, name, line,
    col, open_idx, close_idx, open_start, close_start. A chain inside the arguments of a chain with calls is left out.
    """
    roots = parts.where("not call").select("path", F.col("head.idx").alias("root_idx"), "root", F.col("head.line").alias("line"), F.col("head.col").alias("col"), F.col("idx").alias("root_end"), "args_open", "args_close", "args_from", "args_to")
    calls = parts.where("call").select("path", F.col("of.idx").alias("root_idx"), "idx", F.col("text").alias("name"), "line", "col", F.col("args_open").alias("open_idx"), F.col("args_close").alias("close_idx"), F.col("args_from").alias("open_start"), F.col("args_to").alias("close_start"))
    tally = calls.groupBy("path", "root_idx").agg(F.count(F.lit(1)).alias("n_calls"), F.max("close_idx").alias("last_close"))
    # a root's last segment stands for the root; earlier segments are not ends of it
    last = Window.partitionBy("path", "root_idx").orderBy(F.col("root_end").desc())
    ends = roots.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    whole = ends.join(tally, ["path", "root_idx"], "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0))).where("n_calls > 0 or args_close is not null")
    whole = whole.withColumn("end_idx", F.greatest("root_end", F.coalesce("args_close", "root_end"), F.coalesce("last_close", "root_end")))
    reach = F.max(F.when(F.col("n_calls") > 0, F.col("end_idx"))).over(Window.partitionBy("path").orderBy("root_idx").rowsBetween(Window.unboundedPreceding, -1))
    chains = whole.withColumn("reach", reach).where("reach is null or root_idx > reach").drop("reach", "last_close", "root_end")
    return chains, calls.join(chains.select("path", "root_idx"), ["path", "root_idx"], "left_semi")


def test_functions(tokens: DataFrame) -> DataFrame:
    """(path, line, end_line, open_idx, close_idx) of functions right after a test attribute; line is the attribute's.

    Between attribute and fn only comments, literals and other attributes may stand, so `pub fn` and `async fn` are not recognised. Functions inside a recognised one are not looked at.
    """
    window = _order()
    brackets = partners(tokens, "[", "]", "brackets").select("path", F.col("open_idx").alias("idx"), "close_idx")
    marked = tokens.join(brackets, ["path", "idx"], "left").withColumn("opens", (F.col("text") == "[") & (F.lag("text").over(window) == "#") & (F.lag("idx").over(window) == F.col("idx") - 1))
    attribute_end = F.max(F.when(F.col("opens"), F.coalesce("close_idx", F.lit(2**31 - 1)))).over(window.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("in_attribute", F.coalesce((F.col("idx") <= attribute_end), F.lit(False)) | ((F.col("text") == "#") & F.coalesce(F.lead("opens").over(window), F.lit(False))))
    touching = F.lead("idx", 2).over(window) == F.col("idx") + 2
    texts = [m[2:] for m in TEST_MARKERS]
    five = F.concat(F.lead("text", 1).over(window), F.lead("text", 2).over(window), F.lead("text", 3).over(window), F.lead("text", 4).over(window))
    is_test = F.col("opens") & ((F.concat(F.lead("text", 1).over(window), F.lead("text", 2).over(window)).isin(*texts) & touching) | (five.isin(*texts) & (F.lead("idx", 4).over(window) == F.col("idx") + 4)))
    noted = marked.withColumn("marker", F.last(F.when(is_test, F.struct("idx", "line")), True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    core = noted.where("not in_attribute and kind not in ('comment', 'literal')")
    core = core.withColumn("before_idx", F.coalesce(F.lag("idx").over(window), F.lit(-1))).withColumn("n_open", F.sum(F.when(F.col("text") == "{", 1).otherwise(0)).over(window))
    core = core.withColumn("follows", F.lead("text").over(window)).withColumn("follow_gap", F.lead("gap").over(window))
    is_fn = (F.col("text") == "fn") & ((F.col("follow_gap") != "") | (F.col("follows") == "("))
    found = core.where(is_fn & (F.col("marker.idx") > F.col("before_idx"))).select("path", F.col("idx").alias("fn_idx"), F.col("marker.line").alias("line"), (F.col("n_open") + 1).alias("n_open"))
    opens = core.where("text = '{'").select("path", "n_open", F.col("idx").alias("open_idx"))
    braces = partners(tokens, "{", "}", "braces").select("path", "open_idx", "close_idx", F.col("close_line").alias("end_line"))
    whole = found.join(opens, ["path", "n_open"]).join(braces, ["path", "open_idx"])
    reach = F.max("close_idx").over(Window.partitionBy("path").orderBy("fn_idx").rowsBetween(Window.unboundedPreceding, -1))
    return whole.withColumn("reach", reach).where("reach is null or fn_idx > reach").select("path", "line", "end_line", "open_idx", "close_idx")


def within(points: DataFrame, intervals: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """points with first and last of the interval of their path that holds them; null outside. Intervals of one path do not overlap.

    Both sides are put in one order and each point takes the latest interval begun, so no pairs are formed.
    """
    both = points.withColumn("__turn", F.lit(1)).withColumn("__at", F.col(at)).unionByName(
        intervals.select("path", F.struct(F.col(first).alias("first"), F.col(last).alias("last")).alias("__held"), F.lit(0).alias("__turn"), F.col(first).alias("__at")), allowMissingColumns=True
    )
    held = F.last("__held", True).over(Window.partitionBy("path").orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__held", held).where("__turn = 1")
    return found.withColumn("held", F.when(F.col("__held.last") >= F.col(at), F.col("__held"))).select(*points.columns, F.col("held.first").alias(first), F.col("held.last").alias(last))


def declarations(found: DataFrame) -> DataFrame:
    """(path, binding, name, idx, line, col, after, scope_end, parens, brackets, braces): names bound by statements that begin a line with let, const or pub const, from lexer.statements_of().

    binding is let or const. after: the token that ends the statement, its ; at the depth of its beginning. scope_end: the brace that closes the block around it; both far
    beyond the file's tokens where there is none. The depths are those of the statement. A let with one of ( { [ , before its = binds the identifiers of the pattern, but path
    segments, field names, constructor names, names after mut or another word, and names that begin with an underscore; repeated names count once.
    """
    far, begun, depths = F.lit(2**31 - 1), F.col("begins"), ["parens", "brackets", "braces"]

    def following(text: str, *partition: str):
        """The next token of that text among those of the same depth; in falling order, so that it is a last value so far."""
        later = Window.partitionBy("path", *partition).orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.last(F.when(F.col("text") == text, F.col("idx")), True).over(later), far)

    found = found.where(F.col("begins") | F.col("in_head") | F.col("text").isin(";", "}"))
    ended = found.withColumnRenamed("after", "next").withColumns({"after": following(";", *depths), "scope_end": following("}", "braces")})
    # the tokens of a head stand between its beginning and the next one, so the latest beginning is theirs
    span = F.last(F.when(begun, F.struct("after", "scope_end", *depths)), True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    head = ended.withColumn("span", span).where("in_head").drop("after", "scope_end", *depths).select("*", "span.*").where("idx < after")
    whole = Window.partitionBy("path", "statement_idx")
    mut = (F.col("n") == 1) & (F.col("text") == "mut") & F.col("gap_after").startswith(" ")
    head = head.withColumn("n", F.row_number().over(whole.orderBy("idx"))).withColumns({"mut": mut, "is_let": F.col("word") == "let"})
    head = head.withColumns({"mut_first": F.max("mut").over(whole), "several": F.max(F.col("text").rlike(r"[(\[{,]")).over(whole)}).where("not (is_let and mut)")
    plain = ~F.col("several") & (F.col("n") == F.when(F.col("mut_first"), 2).otherwise(1))
    previous = F.when((F.col("n") == 1) | (F.col("mut_first") & (F.col("n") == 2)), F.lit(None)).otherwise(F.col("before"))
    constructor = F.coalesce(F.col("next").isin("(", "{", "["), F.lit(False)) & F.col("text").rlike("^[A-Z]")
    in_pattern = F.col("several") & ~F.col("text").isin("mut", "ref", "pub") & ~constructor & ~F.coalesce(F.col("next").startswith(":"), F.lit(False)) & ~F.coalesce(previous.rlike("[A-Za-z0-9_]$"), F.lit(False))
    const_name = (F.col("n") == F.when(F.col("word") == "pub", 2).otherwise(1)) & F.coalesce(F.col("next").rlike("^[:=]"), F.lit(False))
    named = head.where((F.col("kind") == "ident") & ~F.col("text").startswith("_") & F.when(F.col("is_let"), plain | in_pattern).otherwise(const_name))
    first = named.withColumn("n_name", F.row_number().over(Window.partitionBy("path", "statement_idx", "text").orderBy("idx"))).where("n_name = 1")
    return first.select(F.when(F.col("is_let"), "let").otherwise("const").alias("binding"), "path", F.col("text").alias("name"), "idx", "line", "col", "after", "scope_end", *depths)


def uses_of(found: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, name, use): the identifiers that are a declared name of their file, by their token's number, from lexer.statements_of()."""
    names = declared.select("path", "name").distinct()
    return found.where("is_use").select("path", F.col("text").alias("name"), F.col("idx").alias("use")).join(names, ["path", "name"])


def unused(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """The declarations of declared, all of one binding, whose name is not used after them in their scope; uses are uses_of() them.

    A use does not count for a declaration once a later one of the same name has taken over: from the end of that one's statement to the end of its scope. So it counts for the
    latest that has taken over there, and for later ones in whose own statement it stands. Statements of one depth follow each other, so both are maxima so far among the
    declarations of a name and depth: no declaration is paired with all uses of its name.
    """
    depths = ["parens", "brackets", "braces"]
    levels = declared.select("path", "name", *depths).distinct()
    own = declared.select("path", "name", F.col("idx").alias("use"))
    uses = uses.join(levels, ["path", "name"]).join(own, ["path", "name", "use"], "left_anti").select("path", "name", *depths, F.col("use").alias("at"), F.lit(1).alias("turn"), "use")
    begun = F.struct("idx", "after", "scope_end")
    over = F.struct("scope_end", "idx")
    marks = declared.select("path", "name", *depths, F.explode(F.array(F.struct(F.col("idx").alias("at"), begun.alias("begun"), F.lit(None).cast("struct<scope_end:int,idx:int>").alias("over")), F.struct(F.col("after").alias("at"), F.lit(None).cast("struct<idx:int,after:int,scope_end:int>").alias("begun"), over.alias("over")))).alias("m"))
    marks = marks.select("path", "name", *depths, "m.at", F.lit(0).alias("turn"), "m.begun", "m.over")
    so_far = Window.partitionBy("path", "name", *depths).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = uses.unionByName(marks, allowMissingColumns=True).withColumns({"begun": F.max("begun").over(so_far), "over": F.max("over").over(so_far)}).where("turn = 1")
    latest = F.when(F.col("over.scope_end") > F.col("use"), F.col("over.idx"))
    inside = F.when((F.col("begun.after") > F.col("use")) & (F.col("begun.scope_end") > F.col("use")), F.col("begun.idx"))
    each = seen.groupBy("path", "name", "use").agg(F.max(latest).alias("latest"), F.collect_set(inside).alias("inside"))
    counted = F.concat(F.array_compact(F.array("latest")), F.filter("inside", lambda i: F.col("latest").isNull() | (i > F.col("latest"))))
    used = each.select("path", F.explode(counted).alias("idx")).distinct()
    return declared.join(used, ["path", "idx"], "left_anti")
