"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

A text's canonical form is its NFKC form, case-folded, NFKC again, with each run of white space as one space and none at the
ends. The digest is 128 bits: two xxHash64 values of the canonical form. Rows of one digest form a bucket, and inside a bucket
canonical forms are compared byte for byte: should two differ, each gets its rank among the bucket's forms as a suffix, so
fingerprints are equal exactly where canonical forms are. Likeness of two fingerprints is therefore 1 or 0.

Buckets are compared through the smallest and greatest form in them, which every task finds for its own rows before anything moves:
a bucket that holds a third of the corpus sends one row a task. Only rows of buckets with more than one row take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.tables import bitmap_filter, next_rows
from codequarry.storage import keep

#: hex digits of a digest; tests shorten it to make buckets collide
DIGITS = 32


def _folded(text: Column) -> Column:
    """NFKC, full case folding, NFKC: by the ICU methods that Spark itself ships."""

    def compose(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(compose(folded))


def canonical(text: Column) -> Column:
    """The canonical form; that of null is the empty text's."""
    given = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(_folded(given), r"[\p{Z}\s\x1c-\x1f\x85]+", " "))


def digest(form: Column, digits: int = DIGITS) -> Column:
    """Lower-case hex of two xxHash64 values of a canonical form."""
    wide = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), form)), 16, "0") for seed in (1, 2)])
    return F.substring(F.lower(wide), 1, digits)


def _suffixes(forms: DataFrame) -> DataFrame | None:
    """(digest, form, suffix) of the buckets among forms(digest, form) that hold more than one form; None if there is none, as without a hash collision."""
    mixed = keep(forms.groupBy("digest").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("digest"), "mixed")
    if mixed.isEmpty():
        return None
    each = forms.join(mixed, "digest", "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("form"))
    return keep(each.withColumn("suffix", F.concat(F.lit("-"), rank.cast("string"))), "suffixes")


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fingerprint", digits: int = DIGITS) -> DataFrame:
    """docs with a string column `into`, equal for two rows exactly if their canonical forms are equal bytes.

    Null counts as the empty text. Repeated rows have equal fingerprints; an empty table gives an empty one; other columns stay, a clashing `into` is replaced.
    """
    keyed = docs.drop(into).withColumn("__digest", digest(canonical(F.col(text_col)), digits))
    repeated = keyed.groupBy("__digest").count().where("count > 1").select("__digest")
    forms = keyed.select("__digest", text_col).join(repeated, "__digest", "left_semi").select(F.col("__digest").alias("digest"), canonical(F.col(text_col)).alias("form"))
    suffixes = _suffixes(forms)
    if suffixes is None:
        return keyed.withColumnRenamed("__digest", into)
    ranked = suffixes.select(F.col("digest").alias("__digest"), F.col("form").alias("__form"), "suffix")
    out = keyed.withColumn("__form", canonical(F.col(text_col))).join(ranked, ["__digest", "__form"], "left")
    return out.withColumn(into, F.concat("__digest", F.coalesce("suffix", F.lit("")))).drop("__digest", "__form", "suffix")


def _edited(text: str, following: str) -> Column:
    """The text with its last floor(n/2) code points replaced by as many, or all, of the first of the following text."""
    kept = F.length(text) - F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), kept), F.substring(F.col(following), F.lit(1), F.length(text) - kept))


def _row_key(id_col: str, text: str) -> Column:
    """128 bits that tell rows apart: rows of one key are the same row, whatever else has their id."""
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))) for seed in (3, 4)])


def _repeated_forms(given: DataFrame, slim: DataFrame, digits: int) -> DataFrame:
    """(digest, form) of the texts and edited texts whose digest occurs more than once in slim(key, next_key, digest, edited_digest)."""
    both = slim.select(F.explode(F.array("digest", "edited_digest")).alias("digest"))
    repeated = keep(both.groupBy("digest").count().where("count > 1").select("digest"), "repeated")
    own = slim.join(repeated, "digest", "left_semi").select("key")
    changed = slim.join(repeated.withColumnRenamed("digest", "edited_digest"), "edited_digest", "left_semi").select("key", "next_key").distinct()
    wanted = keep(own.union(changed.select("key")).union(changed.select("next_key")).distinct(), "wanted")
    near = bitmap_filter(given.select("key", "text"), "key", wanted)
    # wanted keys are distinct: a semi join would be pushed below the bitmap and move every text
    texts = keep(near.join(wanted, "key").groupBy("key").agg(F.min("text").alias("text")), "texts")
    other = texts.select(F.col("key").alias("next_key"), F.col("text").alias("other"))
    pairs = changed.join(texts, "key").join(other, "next_key")
    forms = texts.select(canonical(F.col("text")).alias("form")).union(pairs.select(canonical(_edited("text", "other")).alias("form")))
    return forms.select(digest(F.col("form"), digits).alias("digest"), "form")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text is the text with its last floor(n/2) code points replaced by as many, or all, of the first of the next document's: the next by
    descending id, the first after the last. Result: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (1.0 where
    the canonical forms are equal, else 0.0).

    Null texts are empty. Null ids come last and rows of one id follow each other by a hash of their text, then the text; an only row is its own next; an empty table gives an empty
    result; other columns are ignored. Whole texts move once, to the rows before them; the comparison inside buckets reads and moves those of repeated digests.
    """
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", _row_key("id", "text"))
    rows = next_rows(given.withColumn("digest", digest(canonical(F.col("text")), digits)), "id", "text", ["key", "text", "digest"])
    full = rows.withColumn("edited", _edited("text", "next_text")).withColumn("form", canonical(F.col("text"))).withColumn("edited_form", canonical(F.col("edited")))
    result = full.select(
        "id", "key", "next_key", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "digest", digest(F.col("edited_form"), digits).alias("edited_digest"), "form", "edited_form",
        (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"),
        F.when(F.col("digest") == F.col("next_digest"), F.col("form") == canonical(F.col("next_text"))).otherwise(False).cast("double").alias("near_next"),
    )
    slim = keep(result.drop("form", "edited_form"), "fingerprints")
    suffixes = _suffixes(_repeated_forms(given, slim, digits))
    if suffixes is None:
        named = slim.withColumnsRenamed({"digest": "fingerprint", "edited_digest": "edited_fingerprint"})
    else:
        named = result
        for of, form, into in (("digest", "form", "fingerprint"), ("edited_digest", "edited_form", "edited_fingerprint")):
            ranked = suffixes.select(F.col("digest").alias(of), F.col("form").alias(form), "suffix")
            named = named.join(ranked, [of, form], "left").withColumn(into, F.concat(of, F.coalesce("suffix", F.lit("")))).drop("suffix")
    return named.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
