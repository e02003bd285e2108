from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from vacantia.llm import langid


def test_without_labels_all_texts_with_a_letter_stay(spark, documents):
    plain = documents.withColumn("lang", F.lit(None).cast("string"))
    want = sorted(r.doc_id for r in documents.collect() if any(map(str.isalpha, r.text or "")))
    assert want and sorted(r.doc_id for r in pipeline.language(spark, plain, "").collect()) == want


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "Model", lambda languages, rows: set(languages))
    rows = [(i, f"text {i}", f"l{i % 230}") for i in range(2300)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")) == {f"l{i}" for i in range(230)}
