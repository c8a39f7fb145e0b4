"""SimHashes of lines against majorities counted bit by bit."""

import numpy as np

from ledgerlens.llm.common import mixed
from ledgerlens.llm.lines import RUN, WORDS, Lines


def test_simhashes_by_bit():
    texts = ["", "a", "b a b a b", *(" ".join(f"w{i % m}" for i in range(n)) for n, m in ((RUN, 999), (RUN + 1, 999), (3 * RUN, 999), (4 * RUN, 40)))]
    raw = "\n".join(texts).encode()
    lines = Lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    got = lines.simhashes()
    assert got.shape == (len(texts) - 1, WORDS)
    for row, first, last in zip(got, lines.first, lines.last, strict=True):
        hashes, counts = np.unique(lines.words[first:last] >> np.uint64(24), return_counts=True)
        hashes = np.repeat(hashes, np.minimum(counts, 2))
        for k in range(WORDS):
            bits = mixed(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
            ones = [int((bits >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
            assert int(row[k]) == sum(1 << b for b, n in enumerate(ones) if 2 * n > len(hashes))
    some = np.array([4, 0, 5, 4])
    assert np.array_equal(lines.simhashes(of=some), got[some])
    assert lines.simhashes(of=some[:0]).shape == (0, WORDS)


def test_a_scan_of_lines_holds_few_numbers():
    """The text fingerprinted at a time is small, and the slices give what the whole gives."""
    import tracemalloc

    import pyarrow as pa

    from ledgerlens.llm.common import chunks, utf8
    from ledgerlens.llm.lines import SCAN_BYTES, Lines, fingerprints

    batch = pa.RecordBatch.from_arrays([pa.array([f"line {i} of a text with words w{i % 97}\n" * 40 for i in range(600)])], names=["text"])
    whole = np.concatenate([fingerprints(Lines(*utf8(p.column("text")))) for p in chunks(iter([batch]), most=1 << 30)])
    parts = []
    tracemalloc.start()
    for p in chunks(iter([batch]), most=SCAN_BYTES):
        parts.append(fingerprints(Lines(*utf8(p.column("text")))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(whole, np.concatenate(parts))
    assert peak - whole.nbytes < 40 * SCAN_BYTES * 4


def test_a_scan_gets_small_batches(spark, monkeypatch):
    """Tasks of the scan and of the texts get batches of a few bytes, not of 10,000 texts; the setting is as it was afterwards."""
    import pyarrow as pa

    from ledgerlens.llm import common, lines

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    texts = spark.range(0, 3000, 1, 2).selectExpr("repeat('abcdefgh', 125) AS text")
    assert max(r.bytes for r in common.written(texts.mapInArrow(sizes, "bytes long"), 100_000).collect()) < 200_000
    assert spark.conf.get(name, None) == before
    used = []
    real = common.written
    for module in (lines, lines.components.__globals__):
        wrapped = lambda df, batch_bytes=None: used.append(batch_bytes) or real(df, batch_bytes)
        monkeypatch.setitem(module, "written", wrapped) if isinstance(module, dict) else monkeypatch.setattr(module, "written", wrapped)
    docs = spark.createDataFrame([(i, f"one line of text number {i // 2}\nand a common line") for i in range(6)], "doc_id long, text string")
    assert lines.without_lines(docs).count() == 6
    assert used.count(lines.BATCH_BYTES) == 2
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 50)], names=["text"])
    assert pa.Table.from_batches(list(lines.slices(iter([batch]), 5000))).num_rows == 50 and len(list(lines.slices(iter([batch]), 5000))) > 9
