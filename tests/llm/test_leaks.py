"""Leaks that are altered or lack their answer, and scores that don't depend on the index's parts."""

from ledgerlens.llm import decontaminate

BENCH = "/root/testdata/sf0.01/benchmark.parquet"


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_altered_items_are_found(spark):
    benchmark = spark.read.parquet(BENCH)
    rows, want = [], set()
    for r in benchmark.collect():
        w = [x.decode() for x in decontaminate.words_of(r.text)]
        for at in range(len(w)):
            other = [*w[:at], "altered", *w[at + 1 :]]
            if len(shingles(w) & shingles(other)) >= 0.8 * len(shingles(w)):
                want.add((len(rows), r.item_id))
            rows.append((len(rows), "before it " + " ".join(other) + " after it"))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert want and want <= {(r.doc_id, r.item_id) for r in found.collect()}


def test_questions_without_answers_are_found(spark):
    long = " ".join(f"rare{i}" for i in range(60))
    items = [(1, f"What is the name of the tallest hill there? {long}."), (2, "Who goes? Nobody.")]
    docs = [(1, "so: what is the name of the tallest hill there, one asks"), (2, "who goes now"), (3, "who goes nobody")]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (3, 2)]
    assert [(r.question_overlap, r.answer_overlap) for r in found if r.doc_id == 1] == [(1.0, 0.0)]


def test_scores_do_not_depend_on_parts(spark, monkeypatch):
    docs, benchmark = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet(BENCH)
    whole = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.find_leaks(docs, benchmark).collect())
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1000)
    assert whole and whole == sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.find_leaks(docs, benchmark).collect())


def test_parts_of_the_index_change_nothing(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in decontaminate.find_leaks(docs, benchmark).collect())
    size = sum(len(r.text.encode()) for r in benchmark.collect())
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", -(-size // 5))
    parts = list(decontaminate.indexes(benchmark))
    assert len(parts) == 5
    assert whole and sorted(tuple(r) for r in decontaminate.find_leaks(docs, benchmark).collect()) == whole
