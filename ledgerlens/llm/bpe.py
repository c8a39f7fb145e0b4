"""Operator 3: byte-level BPE encoding and decoding.

The tiktoken library does the merges, with ranks from a local rank file whose bytes travel to the executors with
the task. Long texts are cut at places where no match of the pattern can go across, so a task never holds the
tokens of more than one piece beside the output.

Defined results: a null text counts as empty and gives no tokens; ids and decoded bytes of an empty text are empty;
rows aren't merged, so repeated doc_ids and rows stay; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, only, table

#: Texts of more characters than this are cut before they are encoded.
LONG = 1 << 16
#: A place between a letter or digit and a space: every match of the pattern ends or starts here.
_SAFE = re.compile(r"(?<=[^\W_])(?= )")
_CODECS: dict[bytes, Codec] = {}


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder over a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = max(table.values()) + 1
        self.decimal = [str(i) for i in range(self.size)]

    @classmethod
    def of(cls, ranks: bytes, pattern: str = public_tokenizers.PATTERN) -> Codec:
        key = hashlib.sha256(ranks + pattern.encode()).digest()
        if key not in _CODECS:
            _CODECS[key] = cls(ranks, pattern)
        return _CODECS[key]

    def encode(self, text: str, long: int = LONG) -> list[int]:
        if len(text) <= long:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for piece in pieces(text, long):
            out += self.encoding.encode_ordinary(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """Pieces of about ``long`` characters that, encoded one by one, give the tokens of the whole text.

    Only a text without any safe place stays longer.
    """
    first = 0
    while len(text) - first > long:
        cut = _SAFE.search(text, first + long)
        if not cut:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:]


def encode_documents(docs: DataFrame, ranks: bytes, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row; decoded_sha256 is of the bytes decoded from the ids."""
    of = docs.sparkSession.sparkContext.broadcast(ranks)  # a rank file is a megabyte or so, whatever the documents
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(of.value)
        word = codec.decimal
        for part in chunks(batches):
            out = {"doc_id": part.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
            for text in part.column(1).to_pylist():
                ids = codec.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join([word[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    out["ids"].append(pa.array(ids, pa.int32()))
            columns = [out["doc_id"], pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            if with_ids:
                ends = pa.array([0, *out["n_tokens"]], pa.int64()).to_numpy().cumsum().astype("int32")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(out["ids"] or [pa.array([], pa.int32())])))
            yield pa.RecordBatch.from_arrays(columns, names=list(out))

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(encode, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), with_ids=False)
