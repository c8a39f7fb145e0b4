"""Operator 4: SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint's 64 bits form three segments of 22, 21 and 21 bits. Each segment is a word of the perfect (23, 12)
Golay code: it decodes to the codeword within three bits, and lies at four bits from five more codewords if it is at
exactly three from that one. Segments that differ in one bit share a key if one side gives its codeword and the other
all of its codewords within four bits. With three differing bits over three segments, two segments differ in one bit
at most (pigeonhole), so a key made of the codewords of two segments meets every link; each meeting is verified.

Links are looked for between different fingerprints, so copies cost one row; within a key only the links of a
spanning forest are given, so a large group of near copies doesn't give all its pairs.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text of one or two words is one
shingle; shingles repeat; a null doc_id is never a component's name; repeated rows get a row each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lowered, only, table, utf8, written
from .components import components
from .words import joined_words

SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENTS = (22, 21, 21)
#: The (23, 12) code's generator polynomial: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Groups of a key that are larger are first cut by exact blocks.
LARGE = 2048


def chunk_fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprints of the rows of a chunk."""
    text, starts, ends, first = joined_words(lowered(data), offsets)
    words = np.diff(first)
    count = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    row = np.repeat(np.arange(len(words)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    last = np.minimum(at + size, first[1:][row]) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(text[a:b], seed) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)])
    out = np.zeros(len(words), np.uint64)
    have = np.flatnonzero(count)
    if len(have):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[have], axis=0, dtype=np.int32)
        out[have] = np.packbits(2 * ones > count[have, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) of each row, and further columns of longs; fp holds the 64 bits as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            fp = chunk_fingerprints(*utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), *(part.column(c) for c in more)], names=["doc_id", "fp", *more])

    return only(docs, "doc_id", "text", *more).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(make, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


class Golay:
    """Tables of the code, all by rule: a word's syndrome gives its error patterns of weight four at most."""

    def __init__(self):
        def remainder(x: int) -> int:
            for i in range(22, 10, -1):
                if x >> i & 1:
                    x ^= GENERATOR << (i - 11)
            return x

        by_bit = np.array([remainder(1 << i) for i in range(23)], np.int32)
        self.by_byte = np.zeros((3, 256), np.int32)
        for k in range(3):
            for b in range(min(8, 23 - 8 * k)):
                self.by_byte[k] ^= np.where(np.arange(256) >> b & 1, by_bit[8 * k + b], 0).astype(np.int32)
        self.errors = np.zeros((2048, 6), np.int32)
        self.count = np.ones(2048, np.int8)
        near = np.zeros(2048, bool)
        near[0] = True
        for weight in (1, 2, 3, 4):
            for where in combinations(range(23), weight):
                s = int(np.bitwise_xor.reduce(by_bit[list(where)]))
                e = sum(1 << i for i in where)
                if weight < 4:
                    self.errors[s, 0], near[s] = e, True
                elif int(self.errors[s, 0]).bit_count() == 3:
                    self.errors[s, self.count[s]] = e
                    self.count[s] += 1

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, how many): codes[:, 0] is each word's own codeword, by its 12 leading bits; the rest are at distance four."""
        s = self.by_byte[0][words & 255] ^ self.by_byte[1][words >> 8 & 255] ^ self.by_byte[2][words >> 16]
        return (words[:, None] ^ self.errors[s]) >> 11, self.count[s]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every key of every fingerprint, each once. Fingerprints at three bits at most share a key."""
    found, low = [], 64
    for width in SEGMENTS:
        low -= width
        found.append(golay().keys((fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int32)))
    rows, keys = [], []
    for pair, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (one, n_one), (two, n_two) = found[a], found[b]
        for x, y in [(0, 0), *((0, k) for k in range(1, 6)), *((k, 0) for k in range(1, 6))]:
            r = np.flatnonzero((n_one > x) & (n_two > y))
            rows.append(r)
            keys.append(np.int64(pair) << 24 | one[r, x].astype(np.int64) << 12 | two[r, y].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def forest(fp: np.ndarray, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of a spanning forest of the fingerprints at ``most`` differing bits or fewer."""
    left, right, rest = [], [], np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[i]) <= most
            if near.any():
                got = rest[near]
                left.append(np.full(len(got), i))
                right.append(got)
                queue += got.tolist()
                rest = rest[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def with_partner(fp: np.ndarray, most: int = DISTANCE, block: int = 256) -> np.ndarray:
    """The rows that have another at ``most`` differing bits or fewer."""
    return np.concatenate([np.flatnonzero((np.bitwise_count(fp[a : a + block, None] ^ fp[None, :]) <= most).sum(axis=1) > 1) + a for a in range(0, len(fp), block)])


def group_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As forest(), for rows of which few have a partner; a large group goes by four exact blocks of 16 bits, one of which any linked two share."""
    if len(fp) <= LARGE:
        some = with_partner(fp)
        i, j = forest(fp[some])
        return some[i], some[j]
    left, right = [], []
    for k in range(4):
        block = fp >> np.uint64(16 * k) & np.uint64(0xFFFF)
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            i, j = forest(fp[part]) if len(part) <= 16 else (lambda s: tuple(s[x] for x in forest(fp[part][s])))(with_partner(fp[part]))
            left.append(part[i])
            right.append(part[j])
    return np.concatenate(left), np.concatenate(right)


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int | None = None, shift: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows that come sorted by the first of them, so cut that no group's rows are parted.

    A group is what is equal without the ``shift`` lowest bits. most: a group of many more rows is parted into
    overlapping runs, each of more than ``most`` rows.
    """
    kept: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        if kept and kept[-1][0][-1] >> shift == columns[0][-1] >> shift:
            kept.append(columns)
            if most and sum(len(k[0]) for k in kept) > 8 * most:
                run = tuple(np.concatenate([k[c] for k in kept]) for c in range(len(names)))
                yield run
                kept = [tuple(x[-most - 1 :] for x in run)]
            continue
        whole = [np.concatenate([k[c] for k in kept] + [columns[c]]) for c in range(len(names))]
        last = int(np.searchsorted(whole[0] >> shift, whole[0][-1] >> shift))
        if last:
            yield tuple(x[:last] for x in whole)
        kept = [tuple(x[last:] for x in whole)]
    if kept:
        yield tuple(np.concatenate([k[c] for k in kept]) for c in range(len(names)))


def sorted_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from rows (key, fp, node) that come sorted by key. Holds the rows of a batch and of one key."""

    def links(keys: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        size = ends - starts
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.repeat(np.where(size <= 16, size, 0), size)
        for lag in range(1, 16):
            i = np.flatnonzero(small > lag)
            i = i[i + lag < len(keys)]
            i = i[(keys[i] == keys[i + lag])]
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= DISTANCE]
            left.append(i)
            right.append(i + lag)
        for g in np.flatnonzero(size > 16):
            i, j = group_links(fp[starts[g] : ends[g]])
            left.append(i + starts[g])
            right.append(j + starts[g])
        return pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(left)]), pa.array(node[np.concatenate(right)])], names=["u", "v"])

    for keys, fp, node in whole_groups(batches, ("key", "fp", "node")):
        yield links(keys, fp.view(np.uint64), node)


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes of classes (fp, node), one row a fingerprint: all that connects, not every pair."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
            for a in range(0, len(fp), 1 << 14):
                rows, keys = fuzzy_keys(fp[a : a + (1 << 14)].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[a:][rows]), pa.array(node[a:][rows])], names=["key", "fp", "node"])

    rows = only(classes, "fp", "node").mapInArrow(make, "key long, fp long, node long")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sorted_links, "u long, v long")


def near_duplicates(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp, component_id) of each row, and further columns of longs: component_id is the least doc_id reachable by links of three bits or fewer."""
    fps = written(fingerprints(docs, *more))
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    found = components(fingerprint_links(classes))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.select("fp", "root").join(least, "root"), "fp").select("doc_id", "fp", "component_id", *more)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are their group's least doc_id, with all columns. Rows of that same doc_id, and rows without one, stay.

    Rows go by (doc_id, text), so that a doc_id on two texts loses only the one that is a copy.
    """
    th = f"th_{uuid.uuid4().hex}"
    rows = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = near_duplicates(rows, th).where("doc_id <> component_id").select("doc_id", th).distinct()
    return rows.join(gone, ["doc_id", th], "left_anti").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
