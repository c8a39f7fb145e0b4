"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import copies


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b if not a or not b else len(a & b) >= 0.8 * len(a | b) - 1e-9


def brute(rows):
    """The doc_ids that stay, by all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(min(x) for x in least.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_copies_match_brute_force(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == brute(rows)


@pytest.mark.parametrize("together", [copies.TOGETHER, 2])
def test_altered_copies_are_found(spark, monkeypatch, together):
    import corpus_pipeline as pipeline

    monkeypatch.setattr(copies, "TOGETHER", together)
    random = np.random.default_rng(11)
    rows = []
    for i in range(60):
        words = [f"w{x}" for x in random.integers(0, 5000, int(random.integers(60, 400)))]
        rows.append((4 * i, " ".join(words)))
        for k in range(1, 4):
            other = list(words)
            for at in random.integers(0, len(words), max(1, len(words) // 60) * k):
                other[at] = "altered"
            rows.append((4 * i + k, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(want) < len(rows)
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == want


def test_a_doc_id_on_two_texts_loses_only_the_copy(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two), (None, one)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in copies.one_of_each(docs).collect()) == [(0, one), (1, one), (2, two)]


@pytest.mark.parametrize("together", [copies.TOGETHER, 1])
def test_operator_4_gives_candidates(spark, monkeypatch, together):
    """Operator 4's links are among the candidates, and documents that only they join stay apart below the similarity."""
    import corpus_pipeline as pipeline
    from ledgerlens.llm.simhash import chunk_fingerprints

    def fingerprint(text):
        data = text.encode()
        return int(chunk_fingerprints(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])

    def altered(words, at):
        return " ".join(w if i not in at else f"other{i}" for i, w in enumerate(words))

    random = np.random.default_rng(3)
    rows, phrase = [], "always the same few words stand here ".split() * 40
    for i in range(8):
        words = [f"w{x}" for x in random.integers(0, 5000, 600)]
        near = next(t for t in (altered(words, {k}) for k in range(600)) if 0 < (fingerprint(t) ^ fingerprint(" ".join(words))).bit_count() <= 3)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, near)]
    unlike = [" ".join(phrase + [f"{c}{k}" for k in range(20)]) for c in "ab"]
    assert (fingerprint(unlike[0]) ^ fingerprint(unlike[1])).bit_count() <= 3 and not similar(*map(shingles, unlike))
    rows += [(16, unlike[0]), (17, unlike[1])]
    found, links = [], copies.fingerprint_links
    monkeypatch.setattr(copies, "TOGETHER", together)
    monkeypatch.setattr(copies, "fingerprint_links", lambda classes: found.append(links(classes)) or found[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == brute(rows) == [0, 2, 4, 6, 8, 10, 12, 14, 16, 17]
    assert len(found) == 1 and len({frozenset((r.u, r.v)) for r in found[0].collect()}) == 8
