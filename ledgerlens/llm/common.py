"""Helpers shared by the operators: tables, intermediate tables, and vectorised word and byte views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text handled at a time inside a task, so that a worker's arrays stay small whatever the batch.
CHUNK_BYTES = 1 << 20
#: Bytes between words: space and the controls from tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables; on a local master without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Whether Spark deletes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch that Spark gives a task's function at a time.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: what follows doesn't compute it anew, nor depends on an executor.

    The shuffles behind it are deleted once it stands: nothing reads them again. batch_bytes: the Arrow batches that functions
    get meanwhile end at about so many bytes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Delete the files of a written() table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of the caller can't clash with ours."""
    return df.select(*[df[c] for c in columns])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about ``most`` bytes of text, null text as empty; a longer text comes alone."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = batch.column(at).cast(pa.large_string()).fill_null("")
        batch = batch.set_column(at, pa.field(text, pa.large_string()), column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of chunks(): row i is bytes[offsets[i]:offsets[i + 1]]."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(data):
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: their starts, their ends, and the first run of each row (one more at the end)."""
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def is_word(spaces: tuple[int, ...] = SPACES) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(spaces)] = False
    return inside


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; base is odd, so that its inverse exists."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(values: np.ndarray, base: int = _ODD) -> np.ndarray:
    """Prefix sums of values[i] * base ** i modulo 2 ** 64, from which every span's polynomial hash follows."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _ODD) -> np.ndarray:
    """A 64-bit hash of each span's values; equal spans get equal hashes wherever they stand."""
    inverse = powers(len(prefix), pow(base, -1, 2**64))
    length = (ends - starts).astype(np.uint64)
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def hash_bytes(word: bytes) -> int:
    """What span_hash gives for this word in a text."""
    data = np.frombuffer(word, np.uint8)
    prefix = prefix_hash(byte_values(data))
    return int(span_hash(prefix, np.array([0]), np.array([len(data)]))[0])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
