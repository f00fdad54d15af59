"""From raw documents to token ids: five stages over whole tables, each the work of one operator.

run() writes every stage's rows to the shared folder and reads them again before the next; what the stage before wrote is then removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import decontaminate, langid, quality, simhash, spiece
from codequarry.llm.tables import held_out, table
from codequarry.session import ship_package
from codequarry.storage import discard, keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, have no letter or are rejected by the calibrated confidence go."""
    ship_package(spark)
    model = langid.learn(docs, ~held_out())
    return langid.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not reject; it learns from the labelled documents that are still there.

    Null and empty texts are scored like any other; repeated rows are judged alike; without labels the score is the same for all; an empty table gives an empty result.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id (simhash.one_of_each_group tells what null and repeated ids do).

    Null and empty texts are one group; an empty table gives an empty result.
    """
    ship_package(spark)
    return simhash.one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages that make up a twentieth of them or more.

    Null and empty texts hold no passage and stay; repeated rows are judged alike; an empty benchmark takes nothing away; an empty table gives an empty result.
    """
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256, spans_sha256) of each document; ids end with the end id.

    Null and empty texts have the end id alone; repeated rows stay repeated; an empty table gives an empty result.
    """
    import public_tokenizers

    ship_package(spark)
    return spiece.round_trip(docs, str(public_tokenizers.path("piece_bpe_32k.model"))).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "spans_sha256",
    )


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: trained models and 64-bit XXH64 votes are beyond SQL; the tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
