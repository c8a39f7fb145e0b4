"""Operator 5: fuzzy line dedup.

A line's words (runs of letters, digits and bytes beyond ASCII, A-Z in lower case) joined by one space are its normal
form. Lines of one normal form are one class, whatever their length. A class's SimHash has pigeonhole blocks of 24 bits:
each block is the majority of the hashes of those PER_BLOCK features of the line that the block's own hash puts first, so
an edit leaves the blocks whole whose features it doesn't touch. Features are the distinct words; lines of few
characters, in which one edit touches a large share of the words, have most blocks from their runs of GRAM bytes. 128
check bits are the majority of the hashes of all words, each counted twice at most. Classes that agree in a block,
differ in few check bits and aren't too unlike in length are candidates; the edit similarity of their normal forms (0.8
or more) decides. Of each connected group one occurrence stays: the one of the least (doc_id, text's hash, place).

Texts travel only for classes that have a candidate. The classes that candidates connect are verified together. Where
they are more than TOGETHER, which in large corpora are mostly unlike lines in chains, only those are verified together
that candidates connect within one block value: each pair of candidates is in one of those groups, a class is in one for
each of its blocks at most, and groups of the same classes count once. A group of more than TOGETHER is dealt into parts,
and every two parts are verified together, so no task holds more than two parts. Within them only a spanning forest of
verified links is given. A block value of more than MANY classes is not searched for candidates: it is one group.

Defined results: lines end at \\n; a line without words isn't compared and stays; a null text stays null; a text whose
lines all go becomes empty; of rows that are equal in doc_id and text one keeps what is left, and all lines of the
others that have words go; a null doc_id comes before others; ties don't occur otherwise; other columns, whatever their
names, stay as they are; an empty table gives an empty table. Texts are handled about a megabyte at a time; a longer
text or line comes alone, with some 30 bytes of arrays a byte.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import byte_values, chunks, deleted, is_word, lowered, mixed, only, prefix_hash, span_hash, spans, table, utf8, written
from .components import components, least_reachable
from .simhash import whole_groups

SIMILARITY = 0.8
#: 64-bit words of a SimHash's check bits; bits of a block; features of a block; bytes of a feature of short lines.
WORDS, BLOCK_BITS, PER_BLOCK, GRAM = 2, 24, 5, 3
#: Blocks of words in a line; of a short line, and its blocks of runs of bytes. A block's bits are 3 bytes of SLOTS.
LONG, OF_WORDS, OF_BYTES = 10, 4, 10
SLOTS = OF_WORDS + OF_BYTES
BLOCK_BYTES = SLOTS * BLOCK_BITS // 8
#: Lines whose length is at most this many steps of a quarter (108 characters) are short.
SHORT = 20
#: Bits in which candidates may differ, of the 88 check bits beside a block, and linked lines, of 128; each for long lines, and where one is short.
CHECKED, RADIUS = (18, 20), (34, 48)
#: Classes that are verified together at most; those of a block value that are compared with each other; and rows of two numbers to broadcast.
TOGETHER, MANY, FEW = 2048, 1 << 16, 1_000_000
#: Text whose lines are fingerprinted at a time: a byte takes some hundred bytes of numbers.
SCAN_BYTES = 1 << 18
#: Bytes of an Arrow batch, which stands in the executor's memory and in its Python process's.
BATCH_BYTES = 1 << 21
#: Characters of the texts whose edit distances to one text are found together.
COLUMNS = 1 << 16
#: Words whose bits are counted together, and the binary digits of their number.
RUN, PLANES = 255, 8
_LETTER = is_word((*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


def steps(length: np.ndarray) -> np.ndarray:
    """Lengths in steps of a quarter: lines of 0.8 of each other's length are one step apart at most."""
    return np.floor(np.log(np.maximum(length, 1)) / np.log(1.25)).astype(np.int64)


def once(line: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (line, 40 bits of the feature's hash), in order."""
    x = np.sort(line.astype(np.uint64) << np.uint64(40) | feature >> np.uint64(24))
    x = x[np.append(True, x[1:] != x[:-1])] if len(x) else x
    return (x >> np.uint64(40)).astype(np.int64), x & np.uint64((1 << 40) - 1)


def dealt(line: np.ndarray, feature: np.ndarray, n: int, blocks: range) -> np.ndarray:
    """(n, blocks): for each of n lines the majority of the hashes of the PER_BLOCK features that each block's hash puts first. In order, as once() gives them."""
    out = np.zeros((n, len(blocks)), np.uint64)
    if not n:
        return out
    start = np.searchsorted(line, np.arange(n))
    held = np.minimum(np.diff(np.append(start, len(line))), PER_BLOCK)
    at, kept = start + np.minimum(np.arange(PER_BLOCK)[:, None], held - 1), np.arange(PER_BLOCK)[:, None] < held
    base = line.astype(np.uint64) << np.uint64(40)
    for k, block in enumerate(blocks):
        order = base | mixed(feature + np.uint64((block + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(24)
        order.sort()
        planes = np.zeros((3, n, 1), np.uint64)
        # the 24 lowest bits, which the order hardly depends on
        for carry in np.where(kept, order[at], np.uint64(0))[:, :, None]:
            for plane in planes:
                over = plane & carry
                plane ^= carry
                carry = over
        out[:, k] = more_than(planes, held // 2)[:, 0] & np.uint64((1 << BLOCK_BITS) - 1)
    return out


class Lines:
    """The lines of a chunk of texts that have words: row, place, first and last + 1 word; and the chunk's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = lowered(data)
        inside = _LETTER[self.data]
        self.starts, self.ends, _ = spans(inside, offsets)
        breaks = np.flatnonzero(data == 10) + 1
        begin = np.sort(np.concatenate([offsets[:-1], breaks]), kind="stable")
        row = np.searchsorted(offsets, begin, "right") - 1
        # a break at a text's end begins an empty line of that text, which has no words
        first = np.searchsorted(self.starts, begin)
        last = np.append(first[1:], len(self.starts))
        use = np.flatnonzero(last > first)
        self.row, self.first, self.last = row[use], first[use], last[use]
        self.place = np.searchsorted(breaks, begin[use], "right") - np.searchsorted(breaks, offsets[:-1][self.row], "right")

    @cached_property
    def words(self) -> np.ndarray:
        return span_hash(prefix_hash(byte_values(self.data)), self.starts, self.ends)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line's normal form."""
        words = self.words
        k1 = span_hash(prefix_hash(words), self.first, self.last)
        return k1, span_hash(prefix_hash(mixed(words ^ np.uint64(0x5851F42D4C957F2D)), 0xAEF17502108EF2D9), self.first, self.last, 0xAEF17502108EF2D9)

    def normal(self, i: int) -> str:
        raw = self.data[self.starts[self.first[i]] : self.ends[self.last[i] - 1]].tobytes()
        a = self.starts[self.first[i]]
        return b" ".join([raw[s - a : e - a] for s, e in zip(self.starts[self.first[i] : self.last[i]], self.ends[self.first[i] : self.last[i]], strict=True)]).decode()

    def lengths(self) -> np.ndarray:
        """The normal forms' numbers of characters."""
        letters = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        so_far = np.concatenate([[0], np.cumsum(letters[self.ends] - letters[self.starts] + 1)])
        return (so_far[self.last] - so_far[self.first] - 1).astype(np.int32)

    def _runs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``of``, hash) of each run of GRAM bytes in the normal forms, a space after each, of the lines ``of``."""
        n = (self.last - self.first)[of]
        line = np.repeat(np.arange(len(of)), n)
        word = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[of], n)
        size = self.ends[word] - self.starts[word] + 1
        end = np.cumsum(size)
        at = np.arange(size.sum()) - np.repeat(end - size, size) + np.repeat(self.starts[word], size)
        data = np.append(self.data, np.uint8(32))[at].astype(np.uint64)
        data[end - 1] = 32
        line = np.repeat(line, size)
        first = np.searchsorted(line, np.arange(len(of)))
        data, after = np.append(data, np.full(GRAM, 32, np.uint64)), np.append(line, np.full(GRAM, -1))
        value = np.zeros(len(line), np.uint64)
        for j in range(GRAM):
            value |= data[j : len(line) + j] << np.uint64(8 * j)
        whole = after[GRAM - 1 : len(line) + GRAM - 1] == line
        whole[first] = True  # the run of a line that is shorter
        return line[whole], mixed(value[whole])

    def blocks(self) -> np.ndarray:
        """(lines, SLOTS): the lines' blocks; of long lines the first LONG."""
        n = self.last - self.first
        line = np.repeat(np.arange(len(n)), n)
        line, word = once(line, self.words[np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first, n)])
        short = steps(self.lengths()) <= SHORT
        out = np.zeros((len(n), SLOTS), np.uint64)
        for some, blocks in ((np.flatnonzero(short), OF_WORDS), (np.flatnonzero(~short), LONG)):
            place = np.full(len(n), -1)
            place[some] = np.arange(len(some))
            use = place[line] >= 0
            out[some, :blocks] = dealt(place[line[use]], word[use], len(some), range(blocks))
        some = np.flatnonzero(short)
        out[some, OF_WORDS:] = dealt(*once(*self._runs(some)), len(some), range(LONG, LONG + OF_BYTES))
        return out

    def simhashes(self, words: int = WORDS, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(lines, words): the majorities of the words' hashes of the lines ``of``, each word of a line counted twice at most."""
        n = self.last[of] - self.first[of]
        out = np.zeros((len(n), words), np.uint64)
        if not len(n):
            return out
        line = np.repeat(np.arange(len(n)), n)
        found = self.words[np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[of], n)]
        # the line's number before 40 bits of the word's hash: in order, equal words of a line are neighbours
        found = np.sort(line.astype(np.uint64) << np.uint64(40) | found >> np.uint64(24))
        third = np.zeros(len(found), bool)
        third[2:] = found[2:] == found[:-2]
        found = found[~third]
        line = (found >> np.uint64(40)).astype(np.int64)
        found &= np.uint64((1 << 40) - 1)
        start = np.searchsorted(line, np.arange(len(n)))
        held = np.diff(np.append(start, len(line)))
        # runs of RUN words at most, the longest first; PLANES numbers hold the binary digits of a run's 64 * words counts
        run = np.unique(np.concatenate([start, *([np.arange(s, s + h, RUN) for s, h in zip(start[held > RUN], held[held > RUN], strict=True)])]))
        size = np.diff(np.append(run, len(found)))
        order = np.argsort(-size, kind="stable")
        begin, left_of, left = run[order], size[order], np.searchsorted(-size[order], -np.arange(RUN))
        planes = np.zeros((PLANES, len(run), words), np.uint64)
        seeds = np.array([(k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(words)], np.uint64)
        # no bits after the last word, where a run has fewer than eight left
        bits = np.append(mixed(found[:, None] + seeds), np.zeros((1, words), np.uint64), axis=0)
        for j in range(0, int(size.max()), 8):
            n = left[j]
            x = [bits[np.where(left_of[:n] > i, begin[:n] + i, len(found))] for i in range(j, j + 8)]
            some = planes[:, :n]
            twos = [added(some[0], x[i], x[i + 1]) for i in range(0, 8, 2)]
            fours = [added(some[1], twos[i], twos[i + 1]) for i in (0, 2)]
            carry = added(some[2], *fours)
            for plane in some[3 : max(4, (j + 8).bit_length())]:
                over = plane & carry
                plane ^= carry
                carry = over
        planes[:, order] = planes.copy()
        first = np.searchsorted(run, start)
        one = held <= RUN
        out[one] = more_than(planes[:, first[one]], held[one] // 2)
        many = np.flatnonzero(~one)
        for i, a, b in zip(many.tolist(), first[many].tolist(), np.append(first, len(run))[many + 1].tolist(), strict=True):
            ones = sum(np.unpackbits(plane[a:b].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) << p for p, plane in enumerate(planes))
            out[i] = np.packbits(2 * ones > held[i]).view(np.uint64)
        return out


def added(plane: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Adds both to the plane, bit by bit; gives what is carried."""
    unlike = plane ^ one
    carry = plane & one | unlike & two
    np.bitwise_xor(unlike, two, out=plane)
    return carry


def more_than(planes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Bits that are 1 where the count, whose binary digits the planes (digits, lines, words) hold, is over the line's ``least``."""
    more, same = np.zeros(planes.shape[1:], np.uint64), np.full(planes.shape[1:], 2**64 - 1, np.uint64)
    for p in range(len(planes) - 1, -1, -1):
        digit = -(least >> p & 1).astype(np.int64).view(np.uint64)[:, None]
        more |= same & planes[p] & ~digit
        same &= ~(planes[p] ^ digit)
    return more


def fingerprints(lines: Lines) -> np.ndarray:
    """(lines, bytes): the bits of the blocks, then the check bits."""
    blocks = lines.blocks().astype("<u8").view(np.uint8).reshape(-1, SLOTS, 8)[:, :, : BLOCK_BITS // 8]
    return np.concatenate([blocks.reshape(-1, BLOCK_BYTES), lines.simhashes().view(np.uint8).reshape(-1, 8 * WORDS)], axis=1)


def check_bits(fp: np.ndarray) -> np.ndarray:
    """The check bits of fingerprints, in WORDS numbers."""
    return np.ascontiguousarray(fp[:, -8 * WORDS :]).view(np.uint64)


def block_keys(fp: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the number and value of each block of each row, before 32 check bits."""
    parts = fp[:, :BLOCK_BYTES].reshape(-1, SLOTS, BLOCK_BITS // 8).astype(np.int64)
    value = parts[:, :, 0] | parts[:, :, 1] << 8 | parts[:, :, 2] << 16
    slot, short = np.arange(SLOTS), (steps(length) <= SHORT)[:, None]
    number = np.where(short & (slot >= OF_WORDS), slot - OF_WORDS + LONG, slot)
    row, used = np.nonzero(short | (slot < LONG))
    check = (check_bits(fp)[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return (number[row, used] << BLOCK_BITS | value[row, used]) << 32 | check[row], row


def more_bits(fp: np.ndarray, length: np.ndarray) -> np.ndarray:
    """56 check bits, before the length in steps."""
    return (check_bits(fp)[:, -1] & ~np.uint64(0xFF) | steps(length).astype(np.uint64)).view(np.int64)


def quickly_similar(a: str, b: str, least: float = SIMILARITY) -> bool | None:
    """What edit_similar() says, where no table is needed to tell; else None."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    a, b = unlike_parts(a, b)
    if max(len(a), len(b)) <= most:
        return True
    # words that stand at the same places cost nothing
    one, two = a.split(" "), b.split(" ")
    if len(one) == len(two) and sum(max(len(x), len(y)) for x, y in zip(one, two, strict=True) if x != y) <= most:
        return True
    return True if anchored_edits(one, two) <= most else None


def anchored_edits(one: list[str], two: list[str]) -> int:
    """Edits that turn one list's words into the other's, not always the fewest: words that each list has once and that
    stand in one order cost nothing, and what lies between two of them as much as the longer of both parts."""
    place: dict[str, int] = {}
    at = 0
    for word in two:
        place[word] = -1 if word in place else at
        at += len(word) + 1
    size, times = at, Counter(one)
    edits = at = first = second = 0
    for word in one:
        if place.get(word, -1) >= second and times[word] == 1:
            edits += max(at - first, place[word] - second)
            first, second = at + len(word) + 1, place[word] + len(word) + 1
        at += len(word) + 1
    return edits + max(at - first, size - second)


def unlike_parts(a: str, b: str) -> tuple[str, str]:
    """What is left of both without their common beginning, then without their common end."""
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    return a[: len(a) - tail], b[: len(b) - tail]


def edit_similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length is at least ``least``."""
    found = quickly_similar(a, b, least)
    if found is None:
        found = edit_distance_within(*unlike_parts(a, b), int((1 - least) * max(len(a), len(b)) + 1e-9))
    return found


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Myers' bit-parallel edit distance (in Hyyro's form): a column of the table is two long integers."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= most
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = where.get(c, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = down | full ^ (diagonal | up), up & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        if distance - left > most:
            return False
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = right_down | full ^ (diagonal | right_up), right_up & diagonal
    return distance <= most


def edit_distances(a: str, others: list[str]) -> np.ndarray:
    """The edit distances of a to each of the others, whose columns stand side by side in the two integers, a free bit after each."""

    def packed(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    data = np.frombuffer("".join([f"{b}\n" for b in others]).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(b) + 1 for b in others])
    start = np.append(0, end[:-1])
    inside, first = np.ones(len(data), bool), np.zeros(len(data), bool)
    inside[end - 1] = False
    first[start] = True
    full, low = packed(inside), packed(first & inside)
    where = {c: packed((data == ord(c)) & inside) for c in set(a)}
    up, down = full, 0
    for c in a:
        same = where[c]
        # a carry out of a column ends in the free bit
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = (down | full ^ (diagonal | up)) << 1, (up & diagonal) << 1
        right_up, right_down = (right_up | low) & full, right_down & full
        up, down = right_down | full ^ (diagonal | right_up), right_up & diagonal
    more, less = (np.add.reduceat(np.unpackbits(np.frombuffer(x.to_bytes(-(-len(data) // 8), "little"), np.uint8), count=len(data), bitorder="little"), start, dtype=np.int64) for x in (up, down))
    return len(a) + more - less


def similar_to(a: str, others: list[str], least: float = SIMILARITY) -> list[bool]:
    """edit_similar() of a and each of the others; those that need a table share it, COLUMNS characters at a time."""
    if len(others) == 1:
        return [edit_similar(a, others[0], least)]
    found = [quickly_similar(a, b, least) for b in others]
    left = [k for k, x in enumerate(found) if x is None]
    size = np.cumsum([len(others[k]) + 1 for k in left])
    for some in np.split(np.array(left, np.int64), np.flatnonzero(np.diff(size // COLUMNS)) + 1):
        if len(some) < 4:
            for k in some.tolist():
                found[k] = edit_distance_within(*unlike_parts(a, others[k]), int((1 - least) * max(len(a), len(others[k])) + 1e-9))
            continue
        for k, d in zip(some.tolist(), edit_distances(a, [others[k] for k in some.tolist()]).tolist(), strict=True):
            found[k] = d <= int((1 - least) * max(len(a), len(others[k])) + 1e-9)
    return found


def sketch(text: str, letters: int = 256, pairs: int = 512) -> np.ndarray:
    """Counts of the text's characters and of its pairs of characters, in bins."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.concatenate([np.bincount((x % np.uint64(letters)).astype(np.int64), minlength=letters), np.bincount((mixed(x[:-1] * np.uint64(1_000_003) + x[1:]) % np.uint64(pairs)).astype(np.int64), minlength=pairs)]).astype(np.int32)


def maybe_similar(one: np.ndarray, others: np.ndarray, most: np.ndarray, letters: int = 256) -> np.ndarray:
    """False where counts alone show more than ``most`` edits: an edit takes away at most one character and two pairs."""
    more = others - one
    less = np.maximum(-more, 0)
    more = np.maximum(more, 0)
    by_letter = np.maximum(more[:, :letters].sum(axis=1), less[:, :letters].sum(axis=1))
    by_pair = np.maximum(more[:, letters:].sum(axis=1), less[:, letters:].sum(axis=1))
    return (by_letter <= most) & (by_pair <= 2 * most)


def verified_forest(fp: np.ndarray, texts: list[str], least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the rows at RADIUS check bits or fewer whose texts are similar."""
    found, rest = [], np.arange(len(fp))
    length = np.array([len(t) for t in texts])
    joined = np.zeros(len(fp), bool)
    counts: dict[int, np.ndarray] = {}

    def counted(i: int) -> np.ndarray:
        if i not in counts:
            counts[i] = sketch(texts[i])
        return counts[i]

    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            longer = np.maximum(length[rest], length[i])
            most = np.where(steps(np.minimum(length[rest], length[i])) <= SHORT, RADIUS[1], RADIUS[0])
            near = rest[(np.bitwise_count(fp[rest] ^ fp[i]).sum(axis=1) <= most) & (np.minimum(length[rest], length[i]) >= least * longer - 1e-9)]
            got = []
            for some in np.split(near, range(256, len(near), 256)):
                if len(some) > 4:
                    most = ((1 - least) * np.maximum(length[some], length[i]) + 1e-9).astype(np.int64)
                    some = some[maybe_similar(counted(i), np.stack([counted(j) for j in some.tolist()]), most)]
                got += [j for j, alike in zip(some.tolist(), similar_to(texts[i], [texts[j] for j in some.tolist()], least), strict=True) if alike]
            if got:
                found += [(i, j) for j in got]
                queue += got
                joined[got] = True
                rest = rest[~joined[rest]]
    return found


def agreeing(key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the places of rows, sorted by key: what connects each block value's candidates; of more than MANY rows of a value all."""
    check, bits, step = (key & 0xFFFFFFFF).astype(np.uint32), more.view(np.uint64) >> np.uint64(8), more & 0xFF

    def near(i, j):
        most = np.where(np.minimum(step[i], step[j]) <= SHORT, CHECKED[1], CHECKED[0])
        return (np.bitwise_count(check[i] ^ check[j]) + np.bitwise_count(bits[i] ^ bits[j]) <= most) & (np.abs(step[i] - step[j]) <= 1)

    starts = np.concatenate([[0], np.flatnonzero(np.diff(key >> 32)) + 1])
    size = np.diff(np.append(starts, len(key)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(np.where(size <= 16, starts + size, 0), size)
    for lag in range(1, 16):
        i = np.flatnonzero(small > np.arange(lag, len(key) + lag))
        if not len(i):
            break
        i = i[near(i, i + lag)]
        left.append(i)
        right.append(i + lag)
    for a, n in zip(starts[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        if n > MANY:
            left.append(np.arange(a, a + n - 1))
            right.append(np.arange(a + 1, a + n))
            continue
        # by length: rows that may be near one stand together
        rest = a + np.argsort(step[a : a + n], kind="stable")
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                low, high = np.searchsorted(step[rest], [step[i] - 1, step[i] + 2]) if n > 256 else (0, len(rest))
                found = near(i, rest[low:high])
                if found.any():
                    got, rest = rest[low:high][found], np.concatenate([rest[:low], rest[low:high][~found], rest[high:]])
                    left.append(np.full(len(got), i))
                    right.append(got)
                    queue += got.tolist()
    return np.concatenate(left), np.concatenate(right)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from rows (key of block_keys(), more_bits(), node) that come sorted by key: what connects each block value's candidates.

    Holds a batch and the rows of a block value; of more than 8 * MANY rows only the last, as all of them are linked.
    """
    for key, more, node in whole_groups(batches, ("key", "more", "node"), MANY, 32):
        i, j = agreeing(key, more)
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, together) from the rows that candidates() gets: those that it connects within one block value have one number, which
    the same nodes have in every value (in a value of more than MANY rows, which comes in several runs, it is the value's)."""
    for key, more, node in whole_groups(batches, ("key", "more", "node"), MANY, 32):
        i, j = agreeing(key, more)
        label = np.arange(len(key))
        moved, root = least_reachable(i, j)
        label[moved] = root
        at = np.unique(np.concatenate([i, j]))
        number = np.zeros(len(key), np.uint64)
        np.add.at(number, label[at], mixed(node[at].view(np.uint64)))
        value, place, size = np.unique(key >> 32, return_inverse=True, return_counts=True)
        number = np.where(size[place[at]] > MANY, mixed(value[place[at]].view(np.uint64)), number[label[at]])
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(number.view(np.int64))], names=["node", "together"])


def in_groups(near: DataFrame) -> DataFrame:
    """(node, groups): the groups in which each node is verified. near: rows (node, together), each once; more than TOGETHER nodes go by two parts."""
    sizes = near.groupBy("together").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("together", F.least(own, other), F.greatest(own, other)))
    return near.join(sizes, "together").withColumn("groups", groups).groupBy("node").agg(F.flatten(F.collect_list("groups")).alias("groups"))  # for each block a few


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, th, gone): the places of the lines to remove from each document that has any. docs: id, th, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=SCAN_BYTES):
            lines = Lines(*utf8(part.column("text")))
            row, fp = pa.array(lines.row), fingerprints(lines)
            ends = np.arange(len(fp) + 1, dtype=np.int32) * fp.shape[1]
            columns = [part.column("id").take(row), part.column("th").take(row), pa.array(lines.place.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in lines.keys()), pa.array(lines.lengths())]
            yield pa.RecordBatch.from_arrays([*columns, pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(ends), pa.py_buffer(fp)])], names=["id", "th", "place", "k1", "k2", "length", "fp"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, length = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, BLOCK_BYTES + 8 * WORDS), batch.column("length").to_numpy()
            (key, pick), more = block_keys(fp, length), more_bits(fp, length)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(more[pick]), batch.column("node").take(pa.array(pick))], names=["key", "more", "node"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The normal forms, each with its check bits and the groups in which it is verified."""
        for part in chunks(batches, most=SCAN_BYTES):
            lines = Lines(*utf8(part.column("text")))
            at = {k: i for i, k in enumerate(zip(lines.row.tolist(), lines.place.tolist(), strict=True))}
            wanted = [(at[r, x["place"]], x["node"], x["groups"]) for r, found in enumerate(part.column("wanted").to_pylist()) for x in found]
            fp = lines.simhashes(of=np.array([i for i, _, _ in wanted], np.int64))
            pick = pa.array([k for k, (_, _, groups) in enumerate(wanted) for _ in groups], pa.int64())
            columns = [pa.array([x.tobytes() for x in fp], pa.binary()), pa.array([node for _, node, _ in wanted], pa.int64()), pa.array([lines.normal(i) for i, _, _ in wanted], pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([g for _, _, groups in wanted for g in groups], pa.int64()), *(c.take(pick) for c in columns)], names=["key", "fp", "node", "line"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, fp, node, line in whole_groups(batches, ("key", "fp", "node", "line")):
            cut = np.flatnonzero(np.diff(found)) + 1
            links = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(found)], strict=True):
                if b - a > 1:
                    links += [(node[a + i], node[a + j]) for i, j in verified_forest(np.frombuffer(b"".join(fp[a:b]), np.uint64).reshape(b - a, WORDS), line[a:b].tolist(), similarity)]
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    occurrences = written(only(docs, "id", "th", "text").mapInArrow(scan, "id long, th long, place int, k1 long, k2 long, length int, fp binary"), BATCH_BYTES)
    classes = occurrences.groupBy("k1", "k2").agg(F.min(F.struct("id", "th", "place")).alias("first"), F.min("length").alias("length"), F.min("fp").alias("fp"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))

    def by_block(some: DataFrame) -> DataFrame:
        rows = some.select("fp", "length", "node").mapInArrow(keys, "key long, more long, node long")
        return rows.repartition(parts, F.shiftright("key", 32)).sortWithinPartitions("key")

    near = components(by_block(classes).mapInArrow(candidates, "u long, v long")).withColumnRenamed("root", "together")
    large = written(near.groupBy("together").count().where(F.col("count") > TOGETHER).select("together"))
    if not large.isEmpty():
        chained = classes.join(near.join(large, "together", "left_semi"), "node", "left_semi")
        closer = written(by_block(chained).mapInArrow(gathered, "node long, together long").distinct())
        near = near.join(large, "together", "left_anti").unionByName(closer)
    wanted = classes.join(in_groups(near), "node").groupBy("first.id", "first.th").agg(F.collect_list(F.struct("first.place", "node", "groups")).alias("wanted"))  # one document's own
    lines = only(docs, "id", "th", "text").join(wanted, ["id", "th"]).select("text", "wanted").mapInArrow(texts, "key long, fp binary, node long, line string")
    links = lines.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(verify, "u long, v long")
    named = classes.select("k1", "k2", "first", "node").join(components(links, batch_bytes=BATCH_BYTES), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("first").alias("stays"))
    stays = named.join(first, "root").select("k1", "k2", "stays")
    gone = occurrences.select("id", "th", "place", "k1", "k2").join(stays, ["k1", "k2"]).where(F.struct("id", "th", "place") != F.col("stays"))
    found = written(gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("place")).alias("gone")))  # one document's own
    for no_longer_read in (occurrences, classes):
        deleted(no_longer_read)
    return found


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about ``most`` bytes on average."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of docs needs."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def without_lines(docs: DataFrame, similarity: float = SIMILARITY, count_as: str | None = None) -> DataFrame:
    """docs with the texts that are left; count_as: a further column with the number of lines removed."""
    of, th, gone, whole, uid = (fresh(docs, c) for c in ("id", "th", "gone", "whole", "uid"))
    rows = docs.withColumns({of: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), th: F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())})
    found = repeated_lines(rows.where("text is not null").select(F.col(of).alias("id"), F.col(th).alias("th"), "text"), similarity)
    found = found.select(F.col("id").alias(of), F.col("th").alias(th), F.col("gone").alias(gone))
    schema = StructType([*docs.schema.fields, *([StructField(count_as, IntegerType())] if count_as else [])])
    names = schema.names

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SCAN_BYTES):
            lost, all_go = batch.column(gone), batch.column(whole).to_pylist()
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            count = [0] * len(texts)
            for i in np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False) | np.array(all_go, bool)).tolist():
                if texts[i] is None:
                    continue
                raw = texts[i].encode()
                out = set(Lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).place.tolist() if all_go[i] else lost[i].as_py())
                count[i] = len(out)
                texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in out])
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns[:-2])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(count, pa.int32())] if count_as else [])], names=names)

    again = written(rows.where("text is not null").groupBy(of, th).count().where("count > 1").select(of, th))
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= FEW else again
        copies = written(rows.join(again, [of, th], "left_semi").withColumn(uid, F.monotonically_increasing_id()))
        kept = copies.groupBy(of, th).agg(F.min(uid).alias(uid))
        others = copies.join(kept, [of, th, uid], "left_anti").withColumns({gone: F.lit(None).cast("array<int>"), whole: F.lit(True)})
        rows = rows.join(again, [of, th], "left_anti").unionByName(copies.join(kept, [of, th, uid], "left_semi").drop(uid))
    rows = rows.join(found, [of, th], "left").withColumn(whole, F.lit(False))
    if n:
        rows = rows.unionByName(others.drop(uid))
    return rows.select(*[rows[c] for c in docs.columns], gone, whole).mapInArrow(rebuild, schema)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and n_removed (of the input's lines), kept_sha256 (of the text that is left)."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    left = without_lines(docs, count_as="removed_lines")
    return left.select("doc_id", "n_lines", F.col("removed_lines").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
