"""The stages one after another against plain versions of each one's decision."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import language
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


def test_each_stage_does_what_it_says(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, docs, SF_DIR)
    model = language.fit(docs.where(~language.held_out("doc_id", 5, 0)))
    und = {r["doc_id"] for r in language.predict(docs, model).where("lang_pred = 'und'").collect()}
    kept = [(r["doc_id"], r["text"]) for r in told.collect()]
    assert {i for i, _ in kept} == {r["doc_id"] for r in docs.collect()} - und and told.columns == docs.columns

    once = stages["near_dedup"](spark, told, SF_DIR)
    assert once.columns == docs.columns
    found = brute.components(kept, 5, 0.8)
    kept = [(i, t) for i, t in kept if found[i] == i]
    assert sorted((r["doc_id"], r["text"]) for r in once.collect()) == sorted(kept)

    clean = stages["decontaminate"](spark, once, SF_DIR)
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contamination(kept, items)
    kept = [(i, t) for i, t in kept if not hits[i][4]]
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect()) == sorted(kept)

    masked = stages["secrets"](spark, clean, SF_DIR)
    assert masked.columns == docs.columns and masked.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert texts.keys() == {i for i, _ in kept}
    assert all(n == len(t) and not brute.secrets(t) for t, n in texts.values())
    assert all(texts[i][0] == t for i, t in kept if not brute.secrets(t) and "[secret]" not in texts[i][0])

    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in kept}


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_documents_without_learnable_labels_stay(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    lettered = docs.where(r"text RLIKE '\\p{L}'").select("doc_id")
    clean = sorted(r["doc_id"] for r in lettered.collect())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(-1, None), (-2, "12 ..."), (-3, "")], "doc_id long, text string")
    got = corpus_pipeline.identify_language(spark, unlabelled.unionByName(odd, allowMissingColumns=True), SF_DIR)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == clean
    only_held_out = docs.withColumn("lang", F.when(language.held_out("doc_id", 5, 0), F.col("lang")))
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, only_held_out, SF_DIR).collect()) == clean
