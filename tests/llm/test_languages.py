"""Language ID: held-out accuracy, the mixture's likelihood against plain code, mixed texts and cases at the edge."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import languages

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return languages.fit_languages(spark.read.parquet(DOCUMENTS).where(~languages.held_out()))


def mixtures(model, texts):
    column = pa.array(texts, pa.large_string())
    return languages.Mixtures(model, *languages.grams(column), len(texts))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCUMENTS)
    got = languages.identify_languages(docs).withColumnRenamed("doc_id", "id").join(docs.withColumnRenamed("doc_id", "id"), "id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 and r.lang_pred == r.languages[0] and abs(sum(r.shares) - 1) < 1e-6 for r in got)


def test_counts_equal_plain_ones(spark):
    texts = ["Ab, cd!", "été", None, "", "1 2", "a-b"]
    column = pa.array([t or "" for t in texts], pa.large_string())
    bins, row = languages.grams(column)
    for i, text in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        grams = Counter(g for w in words for n in range(1, languages.ORDER + 1) for k in range(len(w) + 3 - n) if (g := f" {w} "[k : k + n]) != " ")
        assert np.count_nonzero(row == i) == sum(grams.values())
    # equal n-grams share a bin wherever they stand
    one, two = (languages.grams(pa.array([t], pa.large_string()))[0] for t in ("ab cd", "x cd; AB"))
    assert not Counter(one.tolist()) - Counter(two.tolist())


def test_selection_equals_search_over_all_sets(model, spark):
    docs = {r.lang: r.text for r in spark.read.parquet(DOCUMENTS).where("length(text) > 800").collect()}
    names = sorted(docs)
    texts = [docs[names[0]][:300], *(docs[a][:n] + " " + docs[b][:m] for a, b in itertools.combinations(names, 2) for n, m in ((300, 40), (300, 150), (400, 400))), " ".join(docs[a][:400] for a in names[:3])]
    found = mixtures(model, texts)
    got, single = found.selected(), found.single()
    for i in range(len(texts)):
        best, chosen = -np.inf, None
        for size in range(1, len(names) + 1):
            for some in itertools.combinations(range(len(names)), size):
                allowed = np.zeros((len(names), 1))
                allowed[list(some)] = 1
                likelihood = single[some[0], i] if size == 1 else found.of(np.array([i]), allowed)[1][0]
                value = likelihood - (size - 1) * languages.PENALTY * np.log(max(found.total[i], 1) + 1)
                if value > best:
                    best, chosen = value, set(some)
        assert set(got[i][0]) == chosen


def test_no_mixture_exceeds_the_bound(model, spark):
    texts = [r.text for r in spark.read.parquet(DOCUMENTS).limit(200).collect()]
    found = mixtures(model, texts)
    single = found.single()
    rows = np.arange(len(texts))
    likelihood = found.of(rows, np.ones((len(model.names), len(rows))))[1]
    assert np.all(found.bound(single.argmax(axis=0), single.max(axis=0)) > likelihood - 1e-2)


def test_mixed_texts_name_both(model, spark):
    docs = {r.lang: r.text for r in spark.read.parquet(DOCUMENTS).where("length(text) > 2000").collect()}
    a, b = sorted(docs)[:2]
    [(some, shares, score)] = mixtures(model, [docs[a][:700] + " " + docs[b][:700]]).selected()
    assert {model.names[i] for i in some} == {a, b} and min(shares) > 0.3 and score == shares[0]


def test_cases_at_the_edge(spark):
    long = "the quick brown fox and the lazy dog " * 40_000
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, " 123 !? ", None), (None, "the dog", None), (6, long, None), (7, long, "en"), (2, "le chat et le chien", "fr"), (8, "日本", None), (9, "x", "zz")]
    docs = spark.createDataFrame([(*r, "en", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = languages.identify_languages(docs)
    assert got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].languages == [] for i in (3, 4, 5)) and by[6].lang_pred == "en" and by[2].lang_pred == "fr"
    none = languages.identify_languages(docs.withColumn("lang", F.lit(None).cast("int")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert languages.identify_languages(docs.limit(0)).count() == 0
