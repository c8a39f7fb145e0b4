"""Substring operators and helpers against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import components as component_rounds
from ledgerlens.llm import suffixes
from ledgerlens.llm.common import hash_bytes
from ledgerlens.llm.components import components, least_reachable
from ledgerlens.llm.repeats import sliding_least
from ledgerlens.llm.suffixes import ByteStrings, repeated_starts
from ledgerlens.llm.windows import WordWindows

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, h long, id string, th int, row int, pieces string"


def edge_docs(spark):
    """Null, empty, wordless, short, long, repeated and self-repeating texts, a null doc_id, columns of clashing names."""
    long = " ".join(f"w{i * 7919 % 1009}" for i in range(6000))
    texts = [None, "", " \t\n ", "one two", long, "x y " * 300, "a" * 2000, "tail " + long[3000:9000] + " end", "naïve Ünï " * 90]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[7]), (51, "same words here"), (51, "same words here"), (None, texts[7]), (None, None)]
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "p") for r in rows], SCHEMA)


def brute_windows(rows, width):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_bytes(rows, width):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for (doc, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize(("make", "brute", "width"), [(WordWindows, brute_windows, 35), (ByteStrings, brute_bytes, 200), (lambda w: WordWindows(w, 4), brute_windows, 5)])
def test_removal_matches_brute_force(spark, make, brute, width):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(map(tuple, make(width).remove(docs).collect()), brute(rows, width))


@pytest.mark.parametrize(("make", "brute", "width"), [(WordWindows, brute_windows, 35), (ByteStrings, brute_bytes, 200)])
def test_documents_match_brute_force(spark, make, brute, width):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(map(tuple, make(width).remove(docs).collect()), brute(rows, width))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert WordWindows().remove(docs).count() == 0
    assert ByteStrings().remove(docs).count() == 0


@pytest.mark.parametrize(("block", "memory"), [(1 << 20, 1 << 22), (7, 0), (50, 0)])
def test_collections_match_brute_force(monkeypatch, block, memory):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "IN_MEMORY", memory)
    random = np.random.default_rng(3)
    for _ in range(40):
        width = int(random.choice([1, 2, 3, 4, 8, 16]))
        pieces = [bytes(random.integers(97, 97 + random.integers(1, 5), random.integers(0, 40)).astype(np.uint8)) for _ in range(random.integers(1, 12))]
        count = Counter(p[i : i + width] for p in pieces for i in range(len(p) - width + 1))
        assert [x.tolist() for x in repeated_starts(pieces, width)] == [[i for i in range(len(p) - width + 1) if count[p[i : i + width]] > 1] for p in pieces]


def test_sliding_least():
    random = np.random.default_rng(5)
    for n in (1, 5, 30):
        for width in (1, 3, 7):
            x = random.integers(0, 9, n)
            assert sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(n - width + 1)]


def test_equal_words_have_equal_hashes():
    assert hash_bytes(b"word") == hash_bytes(b"word") != hash_bytes(b"wore")


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 3), (2, 1), *[(100, 100 + i) for i in range(1, 200)], *[(1000 + i, 1001 + i) for i in range(60)]]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    expected = {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(200)} | {1000 + i: 1000 for i in range(61)}
    assert got == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_by_rounds_alone(spark, monkeypatch):
    """The driver's CHUNK of 0 never ends by one chunk; each link stands in a partition of its own, so no task contracts."""
    monkeypatch.setattr(component_rounds, "CHUNK", 0)
    edges = [*[(100, 100 + i) for i in range(1, 20)], *[(1000 + i, 1001 + i) for i in range(30)], (5, 4), (4, 4), (5, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long").repartition(len(edges))).collect()))
    assert got == {4: 4, 5: 4} | {100 + i: 100 for i in range(20)} | {1000 + i: 1000 for i in range(31)}


@pytest.mark.parametrize("seed", range(20))
def test_least_reachable(seed):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(0, 60, (2, rng.integers(0, 60)))
    root = list(range(60))
    for _ in range(60):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            root[a] = root[b] = min(root[a], root[b])
    node, least = least_reachable(u, v)
    assert dict(zip(node.tolist(), least.tolist(), strict=True)) == {i: r for i, r in enumerate(root) if r != i}
