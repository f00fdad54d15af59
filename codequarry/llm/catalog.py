"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import collocations, conversation, decontaminate, extract, fingerprint, langid, licenses, packing, quality, simhash, spiece, token_counts, warc
from codequarry.llm.tables import held_out, table

TOKENIZER = "piece_bpe_32k.model"
COUNTED_TOKENIZER = "byte_bpe_50k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels, ~held_out())
    return quality.classify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_items(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_fingerprints(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, ~held_out())
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "spans_sha256",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.archive(table(spark, sf_dir, "pages")))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(COUNTED_TOKENIZER))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(conversation.damage(table(spark, sf_dir, "conversations")), copies_col="copies")


def queries() -> dict:
    named = {f.__name__: f for f in (op1_quality, op2_packing, op3_decontamination, op4_fingerprint, op5_html_extraction, op6_language_id, op7_sentencepiece, op8_warc, op9_simhash_near_dedup, op10_licenses, op11_token_counts, op12_collocations, op13_conversation_repair)}
    return named | {"pipeline": corpus_pipeline.run}


OP8_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
     d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
     f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, d.payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type,
       case when page_id <> first then first end as refers_to
from d left join f on f.payload_digest = d.payload_digest
"""


OP12_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
     pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
     w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as words from pieces),
     grams as (select lang, k.k, unnest(list_transform(range(1, len(words) - k.k + 2), lambda i: array_to_string(words[i:i + k.k - 1], ' '))) as phrase from w, (values (1), (2), (3)) as k(k) where len(words) >= k.k),
     f as materialized (select lang, k, phrase, count(*)::bigint as a from grams group by all),
     n as (select lang, sum(a)::bigint as n from f where k = 1 group by 1),
     c as (select *, string_split(phrase, ' ') as words from f where k > 1 and a >= 10),
     longer as (select lang, unnest([array_to_string(words[1:k - 1], ' '), array_to_string(words[2:k], ' ')]) as phrase, a from c where k > 2),
     most as (select lang, phrase, max(a) as longest from longer group by all),
     cuts as (select c.lang, c.phrase, c.a, t.t as k, array_to_string(words[1:t.t], ' ') as lp, array_to_string(words[t.t + 1:], ' ') as rp
              from c left join most on most.lang = c.lang and most.phrase = c.phrase, (values (1), (2)) as t(t) where t.t < c.k and (longest is null or 100 * longest < 50 * c.a)),
     scored as (select cuts.lang, cuts.phrase, cuts.a, x.a as l, y.a as r, cuts.k, ((1000000::hugeint * cuts.a * cuts.a) // (x.a::hugeint * y.a))::bigint as score
                from cuts join f as x on x.lang = cuts.lang and x.phrase = lp join f as y on y.lang = cuts.lang and y.phrase = rp),
     least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
     ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from least)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join n on n.lang = ranked.lang where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op12_collocations": OP12_SQL}
