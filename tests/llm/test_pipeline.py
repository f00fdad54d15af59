"""The pipeline against its stages' rules applied by brute force to the same models' decisions."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
from codequarry.llm import langid, quality
from codequarry.llm.tables import held_out
from test_decontaminate import brute
from test_simhash import brute_print, brute_roots

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    speak = langid.learn(docs, ~held_out())
    left = {i for i, t in rows.items() if (p := speak.predict(t))[0] != "und" and p[1] >= speak.least}
    kept = docs.where(docs["doc_id"].isin(list(left)))
    model = quality.learn(kept, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out())
    left = {r["doc_id"] for r in quality.classify(kept, model).collect() if r["score"] >= 0.3}
    ids = sorted(left)
    roots = brute_roots([brute_print(rows[i]) for i in ids])
    left = {ids[r] for r in roots}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    counted = {i: brute(rows[i], items) for i in left}
    left = {i for i, (n, hit, _) in counted.items() if not (hit and 20 * hit >= n)}
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    found = {r["doc_id"]: r for r in cp.run(spark, SF).collect()}
    assert set(found) == left and 0 < len(left) < len(rows)
    for i, r in found.items():
        ids = sp.encode(rows[i] or "", add_eos=True)
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_stages_keep_the_columns_and_take_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.where("doc_id < 40").selectExpr("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(None, None, None, None, None), (1000, "", "en", "x", 0), (1000, "", "en", "x", 0)], docs.schema))
    for table in (odd, docs.where("false")):
        for name, stage in cp.STAGES:
            out = stage(spark, table, SF)
            assert name == cp.STAGES[-1][0] or out.columns == docs.columns
            assert out.count() <= table.count()
