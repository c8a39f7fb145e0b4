"""Token alignment against a version that goes through each text token by token."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ledgerlens.llm import alignment
from ledgerlens.llm.bpe import rank_file

A, B = rank_file(public_tokenizers.path("byte_bpe_50k.json")), rank_file(public_tokenizers.path("piece_bpe_32k.model"))
LONG = ("Some words, and a number 1234; " * 9000).strip()
EDGE = ["", None, " ", "short", "  two  spaces\n\n\ttabs", "é naïve Zürich", "日本語のテキスト 한국어", "🙂🙂 emoji 👩‍👩‍👧", "<|endoftext|> </s> <s> <unk> <0x41>", "\x00 nul", "x" * 3000, " " * 700, "=" * 5000, LONG, "short", "a▁b", "ﬁ ﬀ ①"]


def brute(texts):
    """The contract, token by token."""
    codec = alignment.Codec.of(A, B)
    entries_a, entries_b = codec.bytes_a.to_pylist(), codec.bytes_b.to_pylist()
    rows, holders = [], Counter()
    for text in texts:
        groups, a, b = {}, [], []
        if text:
            a, b, raw = codec.a.encode(" " + text, add_special_tokens=False).ids, codec.b.encode(text), (" " + text).encode()
            if b"".join(entries_a[i] for i in a) != raw or b"".join(entries_b[i] for i in b) != raw:
                a, b = [], []
            ends_a, ends_b = np.cumsum([len(entries_a[i]) for i in a]).tolist(), np.cumsum([len(entries_b[i]) for i in b]).tolist()
            both = sorted(set(ends_a) & set(ends_b))
            for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
                for i, e in zip(ids, ends, strict=True):
                    groups.setdefault(bisect.bisect_left(both, e), ([], []))[side].append(i)
        links = Counter()
        for p, q in groups.values():
            for i, x in Counter(p).items():
                for j, y in Counter(q).items():
                    links[i, j] += x * y
        holders.update(links.keys())
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for _, (p, q) in sorted(groups.items()))
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    highest = Counter()
    for (i, _), n in holders.items():
        highest[i] = max(highest[i], n)
    return [(n_a, n_b, n_g, sum(ls.values()), sum(t for k, t in ls.items() if holders[k] == highest[k[0]]), sum(t * holders[k] for k, t in ls.items()), sha) for n_a, n_b, n_g, ls, sha in rows]


def rows_of(df):
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()]


@pytest.mark.parametrize("block_bytes", [1 << 23, 1])
def test_edge_texts(spark, block_bytes):
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, "b", 2.0) for i, t in enumerate(EDGE)], "doc_id long, text string, block int, pairs string, n double").repartition(3)
    got = rows_of(alignment.align_tokens(docs, A, B, block_bytes))
    assert sorted(got, key=repr) == sorted(zip([i if i != 3 else None for i in range(len(EDGE))], brute(EDGE), strict=True), key=repr)


def test_large_groups_expand_by_distinct_ids(monkeypatch):
    generator = np.random.default_rng(1)
    ids_a, ids_b = generator.integers(0, 9, 400), generator.integers(0, 7, 300)
    group_a, group_b = np.sort(generator.integers(0, 5, 400)), np.sort(generator.integers(0, 5, 300))
    base = np.zeros(400, np.int64)
    want = Counter((a << alignment.ID_BITS | b) for a, g in zip(ids_a.tolist(), group_a.tolist(), strict=True) for b, h in zip(ids_b.tolist(), group_b.tolist(), strict=True) if g == h)
    for large, size in ((1, 1 << 20), (1, 10), (1 << 30, 50)):
        monkeypatch.setattr(alignment, "LARGE", large)
        monkeypatch.setattr(alignment, "SLICE", size)
        key, times = alignment.linked(base, ids_a, ids_b, group_a, group_b, 5)
        assert dict(zip(key.tolist(), times.tolist(), strict=True)) == want


def test_fast_merges_equal_the_file_for_common_characters():
    codec = alignment.Codec.of(A, B)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}", f"{c}a", f" {c}", f"{c} ", c + c, f"1{c}", f"{c}1", f"!{c}", f"{c}!", f"  {c}", f"{c}'s", f"\n{c}"):
            assert codec.encode_a(text).tolist() == codec.a.encode(text, add_special_tokens=False).ids


def test_long_texts_in_pieces_equal_whole_texts():
    codec = alignment.Codec.of(A, B)
    (a, n_a), (b, n_b) = codec.encode([LONG, "short"])
    assert a[: n_a[0]].tolist() == codec.a.encode(" " + LONG, add_special_tokens=False).ids and b[: n_b[0]].tolist() == codec.b.encode(LONG)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = rows_of(alignment.align_tokens(docs, A, B, 50_000))
    assert sorted(got) == sorted(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))
    assert alignment.align_tokens(docs.limit(0), A, B).count() == 0
