"""Operator 8: suffix-array dedup with a column-wise construction over many documents.

Pieces of documents whose anchors repeat (see repeats.py) are sorted into collections by their anchor's hash, so equal
windows are always in one collection. A collection's Burrows-Wheeler transform and common-prefix array are built in
rounds: each round inserts one symbol of every piece, from the last to the first (Bauer, Cox, Rosone 2013; Cox et al.
2016). A round reads both arrays once in order and writes them anew in order, block by block, from and to files as
soon as a collection is larger than ``IN_MEMORY``; beside the blocks it holds a few numbers for each piece and symbol.
Collections that fit in memory take symbols of ``UNIT`` bytes, which needs that many rounds fewer.
At the end, neighbouring suffixes with a common prefix of a whole window are repeats.

Defined results: a null text counts as empty; a text shorter than a window keeps all; matches don't cross documents;
strings are judged on the input; repeated rows make each other's strings repeated.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, chunks, table, utf8
from .repeats import Substrings

WIDTH, CORE = 200, 64
#: Symbols of a collection above which its arrays are files, and those of a block of them.
IN_MEMORY, BLOCK = 4 << 20, 1 << 20
#: Bytes to a symbol in memory, as far as it divides the width.
UNIT = 8
#: Small groups share a collection of about this many bytes.
TOGETHER = 256 << 10


class Blocks:
    """Transform and common prefixes in blocks: in memory, or in a pair of files that each round writes anew."""

    def __init__(self, folder: str | None):
        self.folder, self.turn, self.sizes, self.held = folder, 0, [], []
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._out = None

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.folder:
            yield from self.held
            return
        with open(f"{self.folder}/{self.turn % 2}", "rb") as f:
            for n in self.sizes:
                yield np.fromfile(f, np.uint8, n), np.fromfile(f, np.uint8, n)

    def write(self, symbols: np.ndarray, common: np.ndarray) -> None:
        for a in range(0, len(symbols), 2 * BLOCK):
            part = symbols[a : a + 2 * BLOCK], common[a : a + 2 * BLOCK]
            if not self.folder:
                self._new.append(part)
                continue
            if self._out is None:
                self._out, self._sizes = open(f"{self.folder}/{(self.turn + 1) % 2}", "wb"), []  # noqa: SIM115
            part[0].tofile(self._out)
            part[1].tofile(self._out)
            self._sizes.append(len(part[0]))

    def swap(self) -> None:
        if self.folder:
            self._out.close()
            self._out, self.sizes = None, self._sizes
            self.turn += 1
        else:
            self.held, self._new = self._new, []


class RangeLeast:
    """Least of values[a:b + 1] for many ranges: a sparse table over short ranges, and one over blocks for long ones."""

    LEVELS = 7

    def __init__(self, values: np.ndarray):
        self.n, self.size = len(values), 1 << self.LEVELS
        self.short = [values]
        for k in range(self.LEVELS):
            last, half = self.short[-1], 1 << k
            self.short.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
        self.long = [self.short[-1][:: self.size]]
        while len(self.long[-1]) > 1:
            last, half = self.long[-1], 1 << (len(self.long) - 1)
            if len(last) <= half:
                break
            self.long.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = b - a + 1
        level = np.minimum(np.frexp(length)[1] - 1, self.LEVELS)
        out = np.empty(len(a), np.uint8)
        for k in range(self.LEVELS + 1):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(self.short[k][a[at]], self.short[k][b[at] - (1 << k) + 1])
        # whole blocks between the two ends of a long range
        at = np.flatnonzero(length > 2 * self.size)
        first, last = -(-a[at] // self.size), (b[at] + 1) // self.size - 1
        some = first <= last
        at, first, last = at[some], first[some], last[some]
        level = np.frexp(last - first + 1)[1] - 1
        for k in np.unique(level):
            i = level == k
            table = self.long[k]
            out[at[i]] = np.minimum(out[at[i]], np.minimum(table[first[i]], table[last[i] - (1 << int(k)) + 1]))
        return out


class Collection:
    """The rounds over pieces given as one byte array and their offsets. Symbols are bytes plus one; zero ends a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, most: int, folder: str | None = None):
        self.data, self.begin, self.most = data, offsets[:-1], most
        self.length = np.diff(offsets)
        self.pieces = len(self.length)
        self.blocks = Blocks(folder)
        self._build()

    def _symbol(self, pieces: np.ndarray, done: int) -> np.ndarray:
        """The symbol before the last ``done`` of each piece, zero if there is none."""
        have = self.length[pieces] > done
        at = self.begin[pieces] + self.length[pieces] - done - 1
        return np.where(have, self.data[np.where(have, at, 0)] + np.uint8(1), np.uint8(0)) if len(self.data) else np.zeros(len(pieces), np.uint8)

    def _build(self) -> None:
        active = np.arange(self.pieces)
        symbols = self._symbol(active, 0)
        self.blocks.write(symbols, np.zeros(len(symbols), np.uint8))
        self.blocks.swap()
        at = np.flatnonzero(symbols)
        active = active[at]
        done = 0
        while len(active):
            done += 1
            at, active = self._round(at, active, done)

    def _read(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """First reading of a round: symbol and rank of what changes, its common prefix, and whether it is new.

        Carried from block to block, for each symbol: how often it came, the least common prefix since, and whether its
        last place was a new one.
        """
        count, least, was_new = np.zeros(256, np.int64), np.zeros(256, np.uint8), np.zeros(256, bool)
        found: list[list[np.ndarray]] = [[], [], [], []]
        base = 0
        for symbols, common in self.blocks:
            lo, hi = np.searchsorted(at, (base, base + len(symbols)))
            new = np.zeros(len(symbols), bool)
            new[at[lo:hi] - base] = True
            order = np.argsort(symbols, kind="stable")
            sorted_ = symbols[order]
            here = np.bincount(symbols, minlength=256)
            start = np.cumsum(here) - here
            is_new = new[order]
            before = np.empty(len(order), bool)
            before[1:] = is_new[:-1]
            present = np.flatnonzero(here)
            before[start[present]] = was_new[present]
            k = np.flatnonzero(is_new | before)
            k = k[sorted_[k] > 0]
            c, q = sorted_[k], order[k]
            head = k == start[c]
            value = np.empty(len(k), np.uint8)
            in_block = np.flatnonzero(~head)
            minimum = RangeLeast(common)
            value[in_block] = minimum(order[k[in_block] - 1] + 1, q[in_block])
            first = np.flatnonzero(head)
            if len(first):
                value[first] = np.minimum(least[c[first]], minimum(np.zeros(len(first), np.int64), q[first]))
                value[first[count[c[first]] == 0]] = 255  # no symbol before: the common prefix is zero, set below
            rank = count[c] + k - start[c]
            for out, x in zip(found, (c.astype(np.int64), rank, np.where(rank == 0, 0, np.minimum(value.astype(np.int64) + 1, self.most)), is_new[k]), strict=True):
                out.append(x)
            whole = common.min() if len(common) else 255
            least = np.minimum(least, whole)
            last = order[start[present] + here[present] - 1]
            after = np.full(len(present), 255, np.uint8)
            some = last + 1 < len(symbols)
            after[some] = minimum(last[some] + 1, np.full(int(some.sum()), len(symbols) - 1))
            least[present], was_new[present] = after, is_new[start[present] + here[present] - 1]
            count += here
            base += len(symbols)
        self.total = base
        self.count = count
        return tuple(np.concatenate(x) for x in found)

    def _round(self, at: np.ndarray, active: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """Insert the suffix of length ``done`` of each active piece; at: places of their last ones, ascending."""
        symbol, rank, common, new = self._read(at)
        ends = np.cumsum(self.count[1:])
        less = np.concatenate([[0, 0], ends[:-1]]) + self.pieces  # place of a symbol's first suffix, by symbol
        place = less[symbol] + rank
        # the new ones come by block, then symbol, then place: the pieces they belong to, in that order
        piece_of = self._pieces_in_order(at, active, symbol[new], done - 1)
        order = np.argsort(place[new])
        into, piece, value = place[new][order], active[piece_of][order], common[new][order].astype(np.uint8)
        fresh = self._symbol(piece, done)
        change = np.argsort(place[~new])
        moved, update = place[~new][change], common[~new][change].astype(np.uint8)
        gap = into - np.arange(len(into))  # old place before which each comes
        base = shift = 0
        sizes_left = self.total
        for symbols, prefix in self.blocks:
            sizes_left -= len(symbols)
            lo, hi = np.searchsorted(gap, (base, base + len(symbols)))
            if not sizes_left:
                hi = len(gap)
            mask = np.ones(len(symbols) + hi - lo, bool)
            mine = into[lo:hi] - base - shift
            mask[mine] = False
            out_symbols, out_prefix = np.empty(len(mask), np.uint8), np.empty(len(mask), np.uint8)
            out_symbols[mask], out_prefix[mask] = symbols, prefix
            out_symbols[mine], out_prefix[mine] = fresh[lo:hi], value[lo:hi]
            a, b = np.searchsorted(moved, (base + shift, base + shift + len(mask)))
            out_prefix[moved[a:b] - base - shift] = update[a:b]
            self.blocks.write(out_symbols, out_prefix)
            base, shift = base + len(symbols), shift + hi - lo
        self.blocks.swap()
        going = fresh > 0
        return into[going], piece[going]

    def _pieces_in_order(self, at: np.ndarray, active: np.ndarray, symbol: np.ndarray, done: int) -> np.ndarray:
        """Positions in active of the new suffixes as _read gives them: by block, symbol, place."""
        mine = self._symbol(active, done).astype(np.int64)
        block, base = np.zeros(len(at), np.int64), 0
        for i, n in enumerate(self.blocks.sizes if self.blocks.folder else [len(b) for b, _ in self.blocks.held]):
            lo, hi = np.searchsorted(at, (base, base + n))
            block[lo:hi] = i
            base += n
        return np.lexsort((at, mine, block))

    def repeated(self) -> list[np.ndarray]:
        """Of each piece, the starts of suffixes whose first ``most`` symbols another suffix shares, ascending."""
        symbols, common = (np.concatenate(x) for x in zip(*self.blocks, strict=True))
        same = common >= self.most
        same[:-1] |= same[1:].copy()
        order = np.argsort(symbols, kind="stable")
        order = order[self.pieces :]  # the ends of pieces have no suffix before them
        next_ = np.empty(len(symbols), np.int64)
        next_[order] = np.arange(len(order)) + self.pieces
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pieces, at = np.arange(self.pieces), np.arange(self.pieces)
        for done in range(1, int(self.length.max(initial=0)) + 1):
            going = self.length[pieces] >= done
            pieces, at = pieces[going], next_[at[going]]
            hit = np.flatnonzero(same[at])
            found.append((pieces[hit], self.length[pieces[hit]] - done))
        return by_piece(found, self.pieces)


def repeated_starts(pieces: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    if len(data) <= IN_MEMORY:
        return HeldCollection(data, offsets, width, math.gcd(width, UNIT)).repeated()
    with tempfile.TemporaryDirectory() as folder:
        return Collection(data, offsets, width, str(Path(folder))).repeated()


class HeldCollection:
    """The same rounds in memory, with symbols of ``unit`` bytes.

    Each piece gives ``unit`` strings, one from each of its first bytes on, so every window starts at a symbol of one
    of them; a round inserts one symbol of every string. ``order`` keeps the transform's symbols with their places,
    sorted, so a round needs no sorting of what is there: a symbol's index in it is where its suffix goes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, most: int, unit: int):
        self.unit, self.most, self.count = unit, most // unit, len(offsets) - 1
        padded = np.concatenate([data, np.zeros(unit, np.uint8)]).astype(np.uint64)
        value = np.zeros(len(data), np.uint64)
        for k in range(unit):
            value = value << np.uint64(8) | padded[k : k + len(data)]
        self.numbers = np.unique(value, return_inverse=True)[1].astype(np.int32) + np.int32(1)  # zero ends a string
        shift = np.tile(np.arange(unit), self.count)
        self.begin = np.repeat(offsets[:-1], unit) + shift
        self.length = np.maximum(np.repeat(np.diff(offsets), unit) - shift, 0) // unit
        self.shift = shift
        self._build()

    def _symbol(self, strings: np.ndarray, done: int) -> np.ndarray:
        """The symbol before the last ``done`` of each string, zero if there is none."""
        out = np.zeros(len(strings), np.int32)
        have = np.flatnonzero(self.length[strings] > done)
        some = strings[have]
        out[have] = self.numbers[self.begin[some] + (self.length[some] - done - 1) * self.unit]
        return out

    def _build(self) -> None:
        n = len(self.length)
        self.symbols, self.common = self._symbol(np.arange(n), 0), np.zeros(n, np.uint8)
        keys = self.symbols.astype(np.int64) << 32 | np.arange(n)
        by = np.argsort(keys)
        self.order = keys[by]
        index = np.empty(n, np.int64)
        index[by] = np.arange(n)
        at = np.flatnonzero(self.symbols)
        strings, index, done = at, index[at], 0
        while len(strings):
            done += 1
            at, strings, index = self._round(at, strings, index, done)

    def _round(self, at: np.ndarray, strings: np.ndarray, index: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Insert the suffix of ``done`` symbols of each string; at: places of their last ones, index: theirs in order."""
        n, order, minimum = len(self.symbols), self.order, RangeLeast(self.common)
        by = np.argsort(index)
        index, strings, at = index[by], strings[by], at[by]
        symbol = order[index] >> 32
        # common prefix with the suffix before: one more than the least since the symbol's last place
        value = np.zeros(len(at), np.int64)
        before = order[np.maximum(index - 1, 0)]
        some = np.flatnonzero((index > 0) & (before >> 32 == symbol))
        value[some] = minimum((before[some] & _PLACE) + 1, at[some]).astype(np.int64) + 1
        # and of the suffix after, unless that is new too
        after = order[np.minimum(index + 1, n - 1)]
        is_next = (index + 1 < n) & (after >> 32 == symbol)
        is_next[:-1] &= index[1:] != index[:-1] + 1
        some = np.flatnonzero(is_next)
        update = minimum(at[some] + 1, after[some] & _PLACE).astype(np.int64) + 1
        into = len(self.length) + index - int(np.searchsorted(order, 1 << 32))
        fresh = self._symbol(strings, done)
        old = np.ones(n + len(into), bool)
        old[into] = False
        symbols, common = np.empty(len(old), np.int32), np.empty(len(old), np.uint8)
        symbols[old], common[old] = self.symbols, self.common
        symbols[into], common[into] = fresh, np.minimum(value, self.most)
        common[into[some] + 1] = np.minimum(update, self.most)
        # order: old places move by the new ones before them, and the new symbols' places come in
        order = (order & ~_PLACE) | np.flatnonzero(old)[order & _PLACE]
        keys = fresh.astype(np.int64) << 32 | into
        by = np.argsort(keys)
        where = np.searchsorted(order, keys[by]) + np.arange(len(keys))
        old = np.ones(len(symbols), bool)
        old[where] = False
        self.order = np.empty(len(symbols), np.int64)
        self.order[old], self.order[where] = order, keys[by]
        self.symbols, self.common = symbols, common
        index = np.empty(len(into), np.int64)
        index[by] = where
        going = fresh > 0
        return into[going], strings[going], index[going]

    def repeated(self) -> list[np.ndarray]:
        same = self.common >= self.most
        same[:-1] |= same[1:].copy()
        n, ended = len(self.length), int(np.searchsorted(self.order, 1 << 32))
        next_ = np.empty(len(self.symbols), np.int64)
        next_[self.order[ended:] & _PLACE] = np.arange(len(self.symbols) - ended) + n
        found: list[tuple[np.ndarray, np.ndarray]] = []
        strings, at = np.arange(n), np.arange(n)
        for done in range(1, int(self.length.max(initial=0)) + 1):
            going = self.length[strings] >= done
            strings, at = strings[going], next_[at[going]]
            hit = strings[same[at]]
            found.append((hit // self.unit, (self.length[hit] - done) * self.unit + self.shift[hit]))
        return by_piece(found, self.count)


def by_piece(found: list[tuple[np.ndarray, np.ndarray]], pieces: int) -> list[np.ndarray]:
    piece, start = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((start, piece))
    return np.split(start[order], np.searchsorted(piece[order], np.arange(1, pieces)))


_PLACE = np.int64(0xFFFFFFFF)


class ByteStrings(Substrings):
    columns = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}

    def __init__(self, width: int = WIDTH, core: int = CORE):
        if width > 254:
            raise ValueError("common prefixes are kept in a byte: width is 254 at most")
        self.width, self.core = width, min(core, width)

    def items(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return byte_values(data), offsets

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        text = data.tobytes()
        return [(int(b - a), 0, 0, hashlib.sha256(text[a:b]).hexdigest()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def kept(self, data: np.ndarray, gone: np.ndarray) -> tuple:
        spans_ = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        return len(data), int(gone.sum()), spans_, hashlib.sha256(data[~gone].tobytes()).hexdigest()

    def repeated(self, wanted: DataFrame) -> DataFrame:
        width = self.width

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                data, offsets = utf8(part.column("text"))
                text, lists = data.tobytes(), part.column("pieces")
                flat = lists.flatten()
                start, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                start = start + np.repeat(offsets[:-1], np.diff(np.asarray(lists.offsets)))
                found = [text[a : a + m + width - 1] for a, m in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(flat.field(i) for i in range(2, 5)), pa.array(found, pa.binary())], names=["h", "c1", "c2", "piece"])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by h; a collection is made of whole groups."""
            rows: list[tuple] = []
            size = 0

            def flush(last: int) -> pa.RecordBatch:
                """The first ``last`` rows, whole groups."""
                nonlocal rows, size
                now, rows = rows[:last], rows[last:]
                size = sum(len(r[3]) for r in rows)
                places = repeated_starts([r[3] for r in now], width)
                some = [i for i, p in enumerate(places) if len(p)]
                return pa.RecordBatch.from_arrays([*(pa.array([now[i][c] for i in some], pa.int64()) for c in range(3)), pa.array([places[i].astype(np.int32) for i in some], pa.list_(pa.int32()))], names=["h", "c1", "c2", "places"])

            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if size >= TOGETHER and row[0] != rows[-1][0]:
                        yield flush(len(rows))
                    rows.append(row)
                    size += len(row[3])
            if rows:
                yield flush(len(rows))

        parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = wanted.select("row", "text", "pieces").mapInArrow(cut, "h long, c1 long, c2 long, piece binary")
        return rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(build, "h long, c1 long, c2 long, places array<int>")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ByteStrings().remove(table(spark, sf_dir, "documents"))
