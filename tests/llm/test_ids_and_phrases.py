"""doc_ids of other types in the quality classifier; phrases of one word in the licence scan."""

import re

from pyspark.sql import functions as F

from ledgerlens.llm import licenses, quality


def test_quality_of_string_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "quality")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_a_doc_id_is_learned_from_once(spark):
    docs = spark.createDataFrame([(i, f"good plain words {i % 3}" if i % 2 else f"*** ### {i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality.fit_quality(docs, labels) == quality.fit_quality(docs.union(docs), labels)
    other = docs.union(docs.withColumn("text", F.concat(F.lit("~"), "text")))
    assert quality.fit_quality(other, labels) == quality.fit_quality(other.repartition(3), labels)


def test_phrases_of_one_word(spark):
    texts = ["some mit here", "MIT", "mit mit license", "", None, "x " * 50 + "mit", "license", "the mit", "mits"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    phrases = {"mit": "one", "mit license": "two"}
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs, phrases, {}).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", (text or "").lower())
        places = [(k, name) for phrase, name in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert got[i] == (len(places), min(at, default=None), max(at, default=None), ",".join(sorted({name for _, name in places})))
