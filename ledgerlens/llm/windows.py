"""Operator 6: substring dedup over fixed-length word windows.

Rabin-Karp hashes of every window that can repeat (see repeats.py) are counted in Spark; a window whose hash is
counted more than once is repeated, and repeated windows merge into maximal intervals of removed words. Hashes are
128 bits, so windows aren't compared by text again. Identical runs of windows are counted as one row with its number.

Defined results: a null or wordless text has no words and keeps the empty string; a text shorter than a window keeps
its words, joined by one space; windows are judged on the input; repeated rows make each other's windows repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, chunks, is_word, mixed, prefix_hash, span_hash, spans, table, utf8
from .repeats import BASE, BASE_TWO, Substrings
from .words import joined_words

WIDTH, CORE = 35, 8
_WORD = is_word()


class WordWindows(Substrings):
    columns = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}

    def __init__(self, width: int = WIDTH, core: int = CORE):
        self.width, self.core = width, min(core, width)

    def items(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = spans(_WORD[data], offsets)
        return span_hash(prefix_hash(byte_values(data)), starts, ends), first

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        text, starts, ends, first = joined_words(data, offsets)
        return [(int(b - a), 0, hashlib.sha256(text[starts[a] : ends[b - 1]] if b > a else b"").hexdigest()) for a, b in zip(first[:-1], first[1:], strict=True)]

    def kept(self, data: np.ndarray, gone: np.ndarray) -> tuple:
        starts, ends, _ = spans(_WORD[data], np.array([0, len(data)]))
        text, stay = data.tobytes(), np.flatnonzero(~gone)
        words = [text[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]
        return len(starts), int(gone.sum()), hashlib.sha256(b" ".join(words)).hexdigest()

    def repeated(self, wanted: DataFrame) -> DataFrame:
        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                values, first = self.items(*utf8(part.column("text")))
                one, two = prefix_hash(values, BASE), prefix_hash(mixed(values ^ np.uint64(BASE_TWO)), BASE_TWO)
                lists = part.column("pieces")
                flat = lists.flatten()
                start, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                start = start + np.repeat(first[:-1], np.diff(np.asarray(lists.offsets)))
                piece = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
                at = start[piece] + place
                keys = (span_hash(x, at, at + self.width, b).view(np.int64) for x, b in ((one, BASE), (two, BASE_TWO)))
                pick = pa.array(piece)
                yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys), *(flat.field(i).take(pick) for i in range(2, 6)), pa.array(place.astype(np.int32))], names=["k1", "k2", "h", "c1", "c2", "copies", "place"])

        rows = wanted.select("row", "text", "pieces").mapInArrow(windows, "k1 long, k2 long, h long, c1 long, c2 long, copies long, place int")
        again = rows.groupBy("k1", "k2").agg(F.sum("copies").alias("times")).where("times > 1").select("k1", "k2")
        return rows.join(again, ["k1", "k2"]).groupBy("h", "c1", "c2").agg(F.collect_list("place").alias("places"))  # one piece's own


def op6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WordWindows().remove(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest([sha256(array_to_string(w[j:j + 34], ' ')) for j in range(1, len(w) - 33)]) AS k FROM d WHERE len(w) >= 35),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
marked AS (SELECT p.doc_id, p.i, p.word, coalesce(sum(CASE WHEN rep.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM p LEFT JOIN rep ON p.doc_id = rep.doc_id AND p.i = rep.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
