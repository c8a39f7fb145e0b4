"""Operator 11: alignment of the tokens of two tokenizers, A (byte-level BPE) and B (pieces with byte fallback).

Both sides' tokens are byte intervals of one space and the text. Sorted by start, with the running maximum of their
ends, they fall into groups that begin where a start reaches that maximum: places where A and B tokens both end.
Every A token of a group is linked to every B token of it. A pair's count is the number of rows that hold it linked.

Texts are tokenized once. A task's rows are dealt into blocks of BLOCK_BYTES of text; a block's distinct pairs, with the
number of its rows that hold each, are one row, and its documents name pairs by their place there. Spark adds the
blocks' numbers pair by pair, so that a pair which stands in every document is as many rows as there are blocks; the
sums go back to the blocks, not to the documents. The highest count of each A id is broadcast: at most a row for each
entry of A's vocabulary.

Defined results: a text that is null, empty, or whose joined token bytes of A or B differ from space + text has no tokens:
zeros and an empty groups_sha256. Rows aren't merged: repeated rows count each, and null doc_ids stay null. An empty
table gives an empty table; further columns, whatever their names, are ignored. A doc_id that is no integer number gives
null under a cast, as Spark's try_cast does. A text is handled whole, alone in its chunk where it is longer than a
megabyte, with some 100 bytes of arrays a byte; groups of very many tokens are expanded by their distinct ids, in slices.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LONG, pieces, rank_file
from .common import chunks, only, table, written

#: Bytes of text whose documents share one list of distinct pairs.
BLOCK_BYTES = 8 << 20
#: Pairs that are expanded at a time, and from how many links on a group is expanded by its distinct ids.
SLICE, LARGE = 1 << 21, 1 << 10
#: Bits of a token id within a pair.
ID_BITS = 20
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
#: Characters beyond the Latin blocks, whose classes may depend on a library's version of Unicode.
_RARE = re.compile("[^\x00-\u024f]")
_CODECS: dict[bytes, Codec] = {}


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write the printable bytes of Latin-1 as they are and the others from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def fast_codec(found: dict, entries: dict[int, bytes]) -> tiktoken.Encoding | None:
    """The same merges in the tiktoken library, several times as fast; None where A isn't of that kind.

    Ids that rise in the order of the merges are ranks. The two libraries split texts by one pattern but by their own
    tables of letters, so this is for texts without rare characters, for which a test compares both.
    """
    vocabulary = found["model"]["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in found["model"]["merges"]]
    ranks = {entries[i]: i for i in sorted(entries) if entries[i]}
    split = found.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not found.get("normalizer")
    if not plain or made != sorted(set(made)) or len(made) + 256 != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Codec:
    """Both tokenizers with the bytes of their entries, and decimal forms of ids before each separator."""

    def __init__(self, vocabulary: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary.decode())
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        symbol = byte_of_symbol()
        found = json.loads(vocabulary)
        entries = {i: bytes(symbol[c] for c in word) for word, i in found["model"]["vocab"].items() if all(c in symbol for c in word)}
        self.bytes_a = pa.array([entries.get(i, b"") for i in range(self.a.get_vocab_size())], pa.large_binary())
        self.fast = fast_codec(found, entries)
        size = self.b.get_piece_size()
        self.bytes_b = pa.array([bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(size)], pa.large_binary())
        self.size = max(len(self.bytes_a), size)
        if self.size > 1 << ID_BITS:
            raise ValueError(f"a vocabulary of {self.size} entries: pairs hold {ID_BITS} bits an id")
        self.decimal = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(self.size)], pa.large_string())
        # a text may be cut before a space only where no piece of B goes across
        self.cuts = not any(b" " in piece.lstrip(b" ") for piece in self.bytes_b.to_pylist())

    @classmethod
    def of(cls, vocabulary: bytes, model: bytes) -> Codec:
        key = hashlib.sha256(vocabulary + model).digest()
        if key not in _CODECS:
            _CODECS[key] = cls(vocabulary, model)
        return _CODECS[key]

    def encode_a(self, text: str) -> np.ndarray:
        if self.fast and not _RARE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """For A and B: the ids of all texts, and how many each has. Long texts are encoded piece by piece; each piece begins with a space."""
        parts = [list(pieces(f" {t}")) if self.cuts and len(t) > LONG else [f" {t}"] for t in texts]
        flat = list(chain.from_iterable(parts))
        first = np.cumsum([0, *(len(p) for p in parts[:-1])])
        out = []
        for ids in ([self.encode_a(t) for t in flat], self.b.encode([t[1:] for t in flat], num_threads=1)):
            n = np.array([len(x) for x in ids], np.int64)
            every = np.concatenate(ids) if isinstance(ids[0], np.ndarray) else np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            out.append((every.astype(np.int64), np.add.reduceat(n, first)))
        return tuple(out)


def joined(entries: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of the entries one after the other, and each one's length."""
    found = entries.take(pa.array(ids))
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    data = found.buffers()[2]
    return memoryview(data).cast("B")[offsets[0] : offsets[-1]] if data is not None else memoryview(b""), np.diff(offsets)


def coalesced(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token; both sides' tokens lie end to end over the same bytes."""
    length = np.concatenate([length_a, length_b])
    end = np.concatenate([np.cumsum(length_a), np.cumsum(length_b)])
    start = end - length
    side = np.repeat(np.array([0, 1], np.int8), [len(length_a), len(length_b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), bool)
    begins[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    return group[: len(length_a)], group[len(length_a) :]


def merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's times."""
    key, time = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(time[order], first) if len(first) else np.zeros(0, np.int64)


def linked(base: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, pair) keys with the number of links of each. base: the bits of the row, for each A token."""
    a, b, ga, gb = base | ids_a << ID_BITS, ids_b, group_a, group_b
    time_a, time_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    large = np.bincount(ga, minlength=n_groups) * np.bincount(gb, minlength=n_groups) > LARGE
    if large.any():
        sides = []
        for x, g in ((a, ga), (b, gb)):
            many = np.flatnonzero(large[g])
            few = np.flatnonzero(~large[g])
            by = np.lexsort((x[many], g[many]))
            xs, gs = x[many][by], g[many][by]
            new = np.flatnonzero(np.concatenate([[True], (xs[1:] != xs[:-1]) | (gs[1:] != gs[:-1])]))
            time = np.diff(np.append(new, len(xs)))
            xs, gs, time = np.concatenate([x[few], xs[new]]), np.concatenate([g[few], gs[new]]), np.concatenate([np.ones(len(few), np.int64), time])
            by = np.argsort(gs, kind="stable")
            sides.append((xs[by], gs[by], time[by]))
        (a, ga, time_a), (b, gb, time_b) = sides
    partners = np.bincount(gb, minlength=n_groups)
    first = np.cumsum(partners) - partners
    n = partners[ga]
    so_far = np.concatenate([[0], np.cumsum(n)])
    keys, times, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(so_far, so_far[at] + SLICE, "right")) - 1)
        i = np.repeat(np.arange(at, to), n[at:to])
        j = first[ga[i]] + np.arange(len(i)) - (so_far[i] - so_far[at])
        key, time = merged([a[i] | b[j]], [time_a[i] * time_b[j]])
        keys.append(key)
        times.append(time)
        if sum(map(len, keys)) > 4 * SLICE:
            key, time = merged(keys, times)
            keys, times = [key], [time]
        at = to
    return merged(keys, times)


class Aligned:
    """The alignment of a chunk's texts: counts and digest of each row, and its distinct pairs with their numbers of links."""

    def __init__(self, codec: Codec, texts: list[str]):
        whole = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int64)
        (a, n_a), (b, n_b) = codec.encode([texts[i] for i in whole]) if whole else ((none, none), (none, none))
        bytes_a, length_a = joined(codec.bytes_a, a)
        bytes_b, length_b = joined(codec.bytes_b, b)
        sums_a, sums_b = np.concatenate([[0], np.cumsum(length_a)]), np.concatenate([[0], np.cumsum(length_b)])
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        same = np.zeros(len(whole), bool)
        for k, i in enumerate(whole):
            raw = f" {texts[i]}".encode()
            same[k] = raw == bytes_a[sums_a[last_a[k] - n_a[k]] : sums_a[last_a[k]]] and raw == bytes_b[sums_b[last_b[k] - n_b[k]] : sums_b[last_b[k]]]
        keep_a, keep_b = np.repeat(same, n_a), np.repeat(same, n_b)
        a, b, length_a, length_b = a[keep_a], b[keep_b], length_a[keep_a], length_b[keep_b]
        row = np.array(whole, np.int64)[same]
        n_a, n_b = n_a[same], n_b[same]
        group_a, group_b = coalesced(length_a, length_b)
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        of_a, of_b = np.repeat(row, n_a), np.repeat(row, n_b)
        size_a, size_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        of_group = np.zeros(n_groups, np.int64)
        of_group[group_a] = of_a
        rows = len(texts)
        self.n_a, self.n_b = np.bincount(of_a, minlength=rows), np.bincount(of_b, minlength=rows)
        self.n_groups = np.bincount(of_group, minlength=rows)
        self.n_links = np.zeros(rows, np.int64)
        np.add.at(self.n_links, of_group, size_a * size_b)
        self.digests = [""] * rows
        place_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
        token = np.empty(len(a) + len(b), np.int64)
        token[place_a], token[place_b] = a, b
        ends = np.cumsum(size_a + size_b)
        token[ends - size_b - 1] += codec.size  # the last A token of a group
        token[ends - 1] += 2 * codec.size  # the last B token of a group
        text, length = joined(codec.decimal, token)
        at = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        for k, i in enumerate(row.tolist()):
            self.digests[i] = hashlib.sha256(text[at[k] : at[k + 1] - 1]).hexdigest()
        key, self.times = linked(of_a << 2 * ID_BITS, a, b, group_a, group_b, n_groups)
        self.pairs = key & ((1 << 2 * ID_BITS) - 1)
        self.held = np.bincount(key >> 2 * ID_BITS, minlength=rows)


def lists(values: np.ndarray, sizes: np.ndarray, of: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, of))


def aligned_blocks(docs: DataFrame, vocabulary: bytes, model: bytes, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents, which name their pairs by places in ``pairs`` of their block's one row (doc_id null, docs not null)."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))  # two files of a megabyte or so, whatever the documents
    schema = f"block long, {COUNTED}, groups_sha256 string, place array<int>, times array<long>, pairs array<long>, docs array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def block(k: int, held: list[tuple[pa.Array, Aligned]]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32 | k
        pairs, place, counts = np.unique(np.concatenate([x.pairs for _, x in held]), return_inverse=True, return_counts=True)
        at = 0
        for ids, x in held:
            n, here = len(ids), place[at : at + len(x.pairs)]
            at += len(x.pairs)
            columns = [pa.array(np.full(n, number)), ids, *(pa.array(c, pa.int64()) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.digests, pa.string()), lists(here, x.held, pa.int32()), lists(x.times, x.held, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        columns = [pa.array([number]), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), lists(pairs, np.array([len(pairs)]), pa.int64()), lists(counts, np.array([len(counts)]), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*sent.value)
        held, size, k = [], 0, 0
        for part in chunks(batches):
            texts = part.column("text").to_pylist()
            held.append((part.column("doc_id"), Aligned(codec, texts)))
            size += sum(map(len, texts))
            if size >= block_bytes:
                yield from block(k, held)
                held, size, k = [], 0, k + 1
        if held:
            yield from block(k, held)

    return only(docs, "doc_id", "text").withColumn("doc_id", F.expr("try_cast(doc_id AS long)")).mapInArrow(align, schema)


def align_tokens(docs: DataFrame, vocabulary: bytes, model: bytes, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs."""
    blocks = written(aligned_blocks(docs, vocabulary, model, block_bytes))
    of_block = blocks.where("docs is not null")
    held = of_block.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.pairs", "x.docs")
    counts = written(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")))
    best = counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n").alias("highest"))
    known = counts.withColumn("a", F.shiftright("pair", ID_BITS)).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    places = of_block.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair")).join(known, "pair").select("of_block", "place", "n", "best")
    documents = blocks.where("docs is null").drop("pairs", "docs")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def summed(rows: pa.Table, found: pa.Table) -> pa.Table:
        n, best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        at = found.column("place").to_numpy()
        n[at], best[at] = found.column("n").to_numpy(), found.column("best").to_numpy()
        place, times = (rows.column(c).combine_chunks() for c in ("place", "times"))
        ends = np.concatenate([[0], np.cumsum(place.value_lengths().to_numpy())])
        place, times = place.flatten().to_numpy(), times.flatten().to_numpy()
        sums = {"n_best": best, "count_sum": n}
        sums = {c: np.diff(np.concatenate([[0], np.cumsum(x[place] * times)])[ends]) for c, x in sums.items()}
        return pa.table([pa.array(sums[c]) if c in sums else rows.column(c) for c in names], names=names)

    return documents.groupBy("block").cogroup(places.groupBy("of_block")).applyInArrow(summed, f"{COUNTED}, n_best long, count_sum long, groups_sha256 string")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), rank_file(public_tokenizers.path("byte_bpe_50k.json")), rank_file(public_tokenizers.path("piece_bpe_32k.model")))
