"""Rows without doc_id link documents, and one doc_id may stand on two texts."""

from ledgerlens.llm import simhash


def test_rows_without_doc_id_link(spark, monkeypatch):
    fps = spark.createDataFrame([(2, 0), (None, 0b111), (5, 0b111111), (9, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *more: fps)
    got = {r.fp: r.component_id for r in simhash.near_duplicates(fps).collect()}
    assert got == {0: 2, 0b111: 2, 0b111111: 2, -1: 9}


def test_a_doc_id_on_two_texts_loses_only_the_copy(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()) == [(1, one), (2, two)]
