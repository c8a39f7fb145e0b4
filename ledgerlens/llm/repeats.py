"""What the exact substring operators (6 and 8) share: which documents can hold a repeat at all, and intervals.

A window of ``width`` items holds width - core + 1 cores of ``core`` items; the one of least hash is its anchor's core.
Equal windows have equal least hashes. So a window whose least hash comes from a single place of the corpus can't
repeat, and only windows around repeated anchors need to be compared. This is exact: it drops no repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mixed, only, prefix_hash, span_hash, utf8, written

BASE, BASE_TWO = 0xD1342543DE82EF95, 0xAEF17502108EF2D9
_TYPES = {"long": pa.int64(), "string": pa.string()}


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """least[i] = min(values[i : i + width]), by the block method (two running minima)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    down = np.minimum.accumulate(blocks, axis=1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[width - 1 : width - 1 + n])


def runs(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of equal values that don't cross rows: their starts and ends."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    cut = offsets[1:-1]
    new[cut[cut < len(values)]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(values))


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """True for each of n items within ``width`` items from one of starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def anchors(hashes: np.ndarray, offsets: np.ndarray, width: int, core: int) -> tuple[np.ndarray, ...]:
    """Pieces of a chunk: runs of windows whose anchors have one hash, of ``width - core + 1`` windows at most.

    hashes[i] is the hash of the core at item i; offsets: first item of each row. Returns (row, first item, windows,
    anchor's hash, twice) of each piece; twice: its windows have more than one anchor, so they may repeat each other.
    A window's anchor is its first core of least hash, so equal windows have anchors of one hash at one distance.
    """
    none = np.zeros(0, np.int64)
    span = width - core + 1
    packed = hashes >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_least(packed, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    start = np.flatnonzero(offsets[1:][row] >= np.arange(len(at)) + width)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    at, row = at[start], row[start]
    h = hashes[at]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    moved = np.zeros(len(h), np.int64)
    moved[1:] = (at[1:] != at[:-1]) & ~new[1:]
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(h)))
    twice = np.add.reduceat(moved, first) > 0
    # text that repeats itself gives runs of any length: cut them to what one anchor can give
    cuts = -(-windows // span)
    of = np.repeat(np.arange(len(first)), cuts)
    skip = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * span
    first = first[of]
    return row[first], start[first] + skip, np.minimum(windows[of] - skip, span), h[first], twice[of]


class Substrings:
    """How a kind of item (words, bytes) is read; subclasses say how windows of it are compared.

    Documents are told apart by ``id`` and ``th``, a hash of the row, so rows needn't be numbered before they are
    written; equal rows have equal results. Identical pieces are counted, and one of each stands for all of them.
    """

    width: int
    core: int

    def items(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit value of each item, first item of each row)."""
        raise NotImplementedError

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """Result columns of each row if nothing is removed."""
        raise NotImplementedError

    def kept(self, data: np.ndarray, gone: np.ndarray) -> tuple:
        """Result columns of one text, given which of its items are removed."""
        raise NotImplementedError

    #: Names and types of the result columns.
    columns: dict[str, str]

    def repeated(self, wanted: DataFrame) -> DataFrame:
        """(h, c1, c2, places): the windows, by number in the piece, that occur in more than one place.

        wanted: row, text, pieces (array of start, n, h, c1, c2, copies), one row for each text.
        """
        raise NotImplementedError

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        values, first = self.items(data, offsets)
        prefix = prefix_hash(values, BASE)
        at = np.arange(max(0, len(prefix) - self.core))
        return values, prefix, first, anchors(span_hash(prefix, at, at + self.core, BASE), first, self.width, self.core)

    def first_pass(self, docs: DataFrame) -> DataFrame:
        """Rows (id, th, h, twice) of pieces, and rows (doc_id, id, th, result columns) of documents."""
        names = ["doc_id", "id", "th", "h", "twice", *self.columns]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                data, offsets = utf8(part.column("text"))
                row, _, _, h, twice = self._pieces(data, offsets)[3]
                pick, n = pa.array(row), len(row)
                none = [pa.nulls(n, _TYPES[t]) for t in self.columns.values()]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), part.column("id").take(pick), part.column("th").take(pick), pa.array(h.view(np.int64)), pa.array(twice), *none], names=names)
                n, whole = len(part), zip(*self.whole(data, offsets), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), part.column("th"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), *(pa.array(c, _TYPES[t]) for c, t in zip(whole, self.columns.values(), strict=True))], names=names)

        return docs.mapInArrow(scan, "doc_id long, id long, th long, h long, twice boolean, " + self.schema)

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self.columns.items())

    def pieces(self, held: DataFrame) -> DataFrame:
        """(row, start, n, h, c1, c2, twice): the pieces whose anchors repeat. held: row, text, hs."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                values, prefix, first, found = self._pieces(*utf8(part.column("text")))
                lists = part.column("hs")
                of, hs = np.repeat(np.arange(len(part)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten()).view(np.uint64)
                row, h = found[0], found[3]
                keep = np.isin(own(row, h), own(of, hs))
                row, start, n, h, twice = (x[keep] for x in found)
                end = start + n + self.width - 1
                two = prefix_hash(mixed(values ^ np.uint64(BASE_TWO)), BASE_TWO)
                both = span_hash(prefix, start, end, BASE), span_hash(two, start, end, BASE_TWO)
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(row)), pa.array((start - first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (h, *both)), pa.array(twice)], names=["row", "start", "n", "h", "c1", "c2", "twice"])

        def own(row: np.ndarray, h: np.ndarray) -> np.ndarray:
            return mixed(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        return only(held, "row", "text", "hs").mapInArrow(cut, "row long, start int, n int, h long, c1 long, c2 long, twice boolean")

    def finish(self, found: DataFrame) -> DataFrame:
        """(id, th, result columns) from rows (id, th, text, parts): parts are (start, n, places), null places for all."""
        names = ["id", "th", *self.columns]

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                data, offsets = utf8(part.column("text"))
                _, first = self.items(data, offsets)
                lists = part.column("parts")
                at, flat = np.asarray(lists.offsets), lists.flatten()
                at = at - at[0]
                start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                places = flat.field(2)
                out = []
                for i in range(len(part)):
                    windows = [np.arange(start[k], start[k] + n[k]) if not places[k].is_valid else start[k] + np.asarray(places[k].values) for k in range(at[i], at[i + 1])]
                    gone = covered(int(first[i + 1] - first[i]), np.concatenate(windows), self.width)
                    out.append(self.kept(data[offsets[i] : offsets[i + 1]], gone))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), *(pa.array(c, _TYPES[t]) for c, t in zip(columns, self.columns.values(), strict=True))], names=names)

        return only(found, "id", "th", "text", "parts").mapInArrow(make, "id long, th long, " + self.schema)

    def remove(self, docs: DataFrame) -> DataFrame:
        """(doc_id, result columns) of each row of docs."""
        docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text")
        base = written(self.first_pass(docs))
        marks = base.where("h is not null").select("id", "th", "h", "twice")
        again = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("h")
        hs = marks.join(again, "h").groupBy("id", "th").agg(F.collect_set("h").alias("hs"))  # one document's own
        held = written(docs.select("id", "th", "text").join(hs, ["id", "th"]).withColumn("row", F.monotonically_increasing_id()))
        pieces = written(self.pieces(held))
        of = ["h", "c1", "c2"]
        distinct = written(pieces.groupBy(*of).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start")).alias("at"), F.first("n").alias("n"), F.max("twice").alias("twice")))
        several = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("contents"), F.max("twice").alias("t")).where("contents > 1 or t").select("h")
        wanted = distinct.join(several, "h").groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct(F.col("at.start").alias("start"), "n", *of, "copies")).alias("pieces"))
        places = self.repeated(held.select("row", "text").join(wanted, "row"))
        state = distinct.join(places, of, "left").where("copies > 1 or places is not null").select(*of, F.when(F.col("copies") == 1, F.col("places")).alias("places"))
        parts = pieces.join(state, of).groupBy("row").agg(F.collect_list(F.struct("start", "n", "places")).alias("parts"))  # one document's own
        new = self.finish(held.join(parts, "row")).dropDuplicates(["id", "th"])
        new = new.select("id", "th", *[F.col(c).alias(f"new_{c}") for c in self.columns], F.lit(True).alias("changed"))
        rows = base.where("h is null").join(new, ["id", "th"], "left")
        return rows.select("doc_id", *[F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in self.columns])
