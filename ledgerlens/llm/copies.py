"""Near copies by operator 4's SimHash and MinHash, checked by the Jaccard similarity of five-word shingles.

Words are runs of bytes other than spaces, A-Z in lower case; a text of fewer than five words is one shingle. Texts of
equal words are one class. Candidates come from operator 4: fingerprints that differ in three bits at most, found by its
Golay-code keys. Most near copies at similarity 0.8 lie farther apart than that; these come from MinHash: 24 bands of 5 least values, so that two texts at similarity s
share no band with probability (1 - s ** 5) ** 24, which is 7e-5 at 0.8 and 1e-9 at 0.9. All candidates are verified by the
similarity itself, and only a spanning forest of the verified links is given.

Shingles travel only for classes that share a band with another: once where the candidates connect few classes, else
once for each band.

Defined results: null and wordless texts are one class; of each connected group the rows of the least doc_id stay, and
rows without one; rows go by (doc_id, text), so one doc_id may stand on different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, is_word, lowered, mixed, only, prefix_hash, span_hash, spans, utf8, written
from .components import components
from .lines import fresh
from .simhash import chunk_fingerprints, fingerprint_links, whole_groups

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Classes linked by their bands are verified in one group up to this number, else under their bands.
TOGETHER = 1024
_WORD = is_word()
_NO_ID = -(2**63)
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """The shingles of a chunk of texts, repeats included: row i has hashes[first[i]:first[i + 1]]."""

    def __init__(self, part: pa.RecordBatch, size: int = SHINGLE):
        data, offsets = utf8(part.column("text"))
        data = lowered(data)
        starts, ends, word = spans(_WORD[data], offsets)
        words = span_hash(prefix_hash(byte_values(data)), starts, ends)
        n = np.diff(word)
        count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
        self.first = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(row)) - self.first[:-1][row] + word[:-1][row]
        prefix = prefix_hash(words)
        self.hashes = span_hash(prefix, at, np.minimum(at + size, word[1:][row]))
        self.k1 = span_hash(prefix, word[:-1], word[1:])
        self.k2 = span_hash(prefix_hash(mixed(words ^ np.uint64(0x5851F42D4C957F2D)), 0xAEF17502108EF2D9), word[:-1], word[1:], 0xAEF17502108EF2D9)

    def bands(self) -> np.ndarray:
        """A row of BANDS keys for each text that has shingles."""
        have = self.first[:-1][np.diff(self.first) > 0]
        out = np.zeros((len(have), BANDS), np.uint64)
        for b in range(BANDS if len(have) else 0):
            key = np.full(len(have), b + 1, np.uint64)
            for a in _FACTORS[b]:
                key = mixed(key + np.minimum.reduceat(mixed(self.hashes * a), have))
            out[:, b] = key
        return out


def similar_forest(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets of distinct hashes at Jaccard similarity ``least`` or more."""
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum(size) - size
    mark = np.zeros(len(values), bool)
    found, rest = [], np.arange(1, len(sets))
    kept = flat[size[0] :]
    queue = [0]
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            kept, rest = kept[size[rest[0]] :], rest[1:]
            continue
        i = queue.pop()
        mine = flat[cut[i] : cut[i] + size[i]]
        mark[mine] = True
        common = np.add.reduceat(mark[kept], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
        mark[mine] = False
        near = common >= least * (size[rest] + size[i] - common) - 1e-9
        if near.any():
            got = rest[near].tolist()
            found += [(i, j) for j in got]
            queue += got
            kept, rest = kept[np.repeat(~near, size[rest])], rest[~near]
    return found


def copy_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, th, least) of each row: least is the smallest id but _NO_ID of its group. docs: id, th, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = Shingles(part)
            offsets = np.concatenate([[0], np.cumsum(np.diff(found.first) > 0)]) * BANDS
            keys = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.bands().view(np.int64).ravel()))
            fp = chunk_fingerprints(*utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(found.k1.view(np.int64)), pa.array(found.k2.view(np.int64)), keys, pa.array(fp.view(np.int64))], names=["id", "th", "k1", "k2", "bands", "fp"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A link from each row of (key, node) to the one before it, of rows that come sorted by key."""
        last = np.zeros((2, 0), np.int64)
        for batch in batches:
            key, node = (np.concatenate([last[k], batch.column(c).to_numpy()]) for k, c in enumerate(("key", "node")))
            i = np.flatnonzero(key[1:] == key[:-1])
            last = np.stack([key[-1:], node[-1:]])
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[i + 1])], names=["u", "v"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = Shingles(part)
            bands, large = found.bands(), part.column("large").to_pylist()
            # a group that is verified whole has the key of its root, others those of the bands and of what fingerprints connect
            roots = mixed(part.column("root").to_numpy().view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            known = part.column("print").is_valid().to_numpy(zero_copy_only=False)
            prints = mixed(part.column("print").fill_null(0).to_numpy().view(np.uint64) + np.uint64(0xD1B54A32D192ED03))
            own_keys = [np.append(bands[r], prints[r : r + 1][known[r : r + 1]]) if large[r] else roots[r : r + 1] for r in range(len(large))]
            n = np.array([len(x) for x in own_keys], np.int64)
            key = np.concatenate(own_keys)
            own = pa.array([np.unique(found.hashes[a:b]).tobytes() for a, b in zip(found.first[:-1], found.first[1:], strict=True)], pa.binary())
            pick = pa.array(np.repeat(np.arange(len(large)), n))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("node").take(pick), own.take(pick)], names=["key", "node", "own"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, own in whole_groups(batches, ("key", "node", "own")):
            cut = np.flatnonzero(np.diff(key)) + 1
            links = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                if b - a > 1:
                    links += [(node[a + i], node[a + j]) for i, j in similar_forest([np.frombuffer(x, np.uint64) for x in own[a:b]], similarity)]
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(only(docs, "id", "th", "text").mapInArrow(scan, "id long, th long, k1 long, k2 long, bands array<long>, fp long"))
    classes = rows.groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("first"), F.min(F.when(F.col("id") != _NO_ID, F.col("id"))).alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))  # equal words have equal bands and fingerprints
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    keys = classes.select(F.explode("bands").alias("key"), "node").repartition(parts, "key").sortWithinPartitions("key")
    prints = written(classes.groupBy("fp").agg(F.min("node").alias("node")))  # a row a fingerprint
    equal = classes.select("fp", F.col("node").alias("u")).join(prints.withColumnRenamed("node", "v"), "fp").where("u <> v").select("u", "v")
    prints = written(components(fingerprint_links(prints).unionByName(equal)).withColumnRenamed("root", "print"))
    near = components(keys.mapInArrow(candidates, "u long, v long").unionByName(prints.where("node <> print").select(F.col("node").alias("u"), F.col("print").alias("v"))))
    sizes = near.groupBy("root").agg((F.count(F.lit(1)) > TOGETHER).cast("int").alias("large"))
    wanted = classes.join(near.join(sizes, "root"), "node").join(prints, "node", "left").select("first.id", "first.th", "node", "root", "large", "print")
    texts = only(docs, "id", "th", "text").join(wanted, ["id", "th"]).select("text", "node", "root", "large", "print")
    links = texts.mapInArrow(sets, "key long, node long, own binary").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(verify, "u long, v long")
    named = classes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")).select("k1", "k2", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    return rows.select("id", "th", "k1", "k2").join(named.select("k1", "k2", "root").join(least, "root"), ["k1", "k2"]).select("id", "th", "least")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that are their group's least doc_id, with all columns. Rows of that same doc_id, and rows without one, stay."""
    of, th = fresh(docs, "id"), fresh(docs, "th")
    rows = docs.withColumns({of: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    found = copy_groups(rows.select(F.col(of).alias("id"), F.col(th).alias("th"), "text"), similarity)
    gone = found.where((F.col("id") != _NO_ID) & (F.col("id") != F.col("least"))).select(F.col("id").alias(of), F.col("th").alias(th)).distinct()
    return rows.join(gone, [of, th], "left_anti").select(*docs.columns)
