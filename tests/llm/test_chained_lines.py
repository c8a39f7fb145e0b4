"""Classes that candidates chain are verified with their own candidates, not all with all."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import lines
from ledgerlens.llm.common import mixed


def rows_of(found, more):
    """Rows (key, more, node), sorted by key, from (block value, node); the key's check bits follow from ``more`` without bit 40."""
    node = np.array([n for _, n in found], np.int64)
    key = np.array([v for v, _ in found], np.int64) << 32 | (mixed(more[node].view(np.uint64) | np.uint64(1 << 40)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(more[node]), pa.array(node)], names=["key", "more", "node"])


def pairs(batches):
    """The rows of two columns."""
    return {x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}


def bits(n, seed=6):
    return (np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) & ~np.uint64(0xFF) | np.uint64(lines.SHORT + 5)).view(np.int64)


def test_unlike_classes_of_a_common_block_value_are_no_candidates():
    """A value of more classes than are verified together: two of 3,000 are near each other."""
    n = lines.TOGETHER + 952
    more = bits(n)
    more[7] = more[2000] ^ (1 << 40)
    links = pairs(lines.candidates(iter([rows_of([(9, k) for k in range(n)], more)])))
    assert {frozenset(x) for x in links} == {frozenset((7, 2000))}


def test_chained_classes_stay_few_together(spark, monkeypatch):
    """Each of 200 classes shares a value with the next: every pair of candidates is verified together, and no class with many."""
    n = 200
    more = np.full(n, int(bits(1)[0]))
    batch = rows_of([(value, node) for value in range(n - 1) for node in (value, value + 1)] + [(value + 1000, node) for value in range(n - 1) for node in (value, value + 1)], more)
    rows = pairs(lines.gathered(iter([batch])))
    assert len(rows) == 2 * (n - 1), "both values of a pair give one group"
    monkeypatch.setattr(lines, "TOGETHER", 4)
    near = spark.createDataFrame(sorted(rows), "node long, together long")
    groups = lines.in_groups(near).select("node", F.explode("groups").alias("g"))
    by_group = [set(r.nodes) for r in groups.groupBy("g").agg(F.collect_list("node").alias("nodes")).collect()]
    assert sorted(map(sorted, by_group)) == [[k, k + 1] for k in range(n - 1)]


def test_runs_of_a_very_common_value_are_one_group(monkeypatch):
    monkeypatch.setattr(lines, "MANY", 4)
    n = 90
    batch = rows_of([(3, k) for k in range(n)], bits(n))
    parts = [batch.slice(k, 10) for k in range(0, n, 10)]
    rows = pairs(lines.gathered(iter(parts)))
    assert {k for k, _ in rows} == set(range(n)) and len({g for _, g in rows}) == 1


def test_results_are_those_of_whole_components(spark, monkeypatch):
    """Chains of similar lines: with groups by block value the same lines stay as with the whole component in one group."""
    rng = np.random.default_rng(3)
    words = [f"w{k}x{k * 7919 % 1000}" for k in range(400)]
    texts, line = [], list(rng.choice(words, 30))
    for k in range(60):
        line = list(line)
        line[k * 7 % 30] = str(rng.choice(words))
        texts.append(" ".join(line))
        if k % 20 == 19:
            line = list(rng.choice(words, 30))
    docs = spark.createDataFrame([(k, f"{t}\nThe end of a text") for k, t in enumerate(texts)], "doc_id long, text string")
    whole = {r.doc_id: r.text for r in lines.without_lines(docs).collect()}
    assert sum("w" in (t or "") for t in whole.values()) < 30
    monkeypatch.setattr(lines, "TOGETHER", 2)
    assert {r.doc_id: r.text for r in lines.without_lines(docs).collect()} == whole


def test_line_dedup_leaves_no_table_of_lines(spark):
    """Stage 2 of the pipeline, before its documents are written: what held a row for each line or class is deleted."""
    from pathlib import Path

    import corpus_pipeline

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("table-*"))
    docs = spark.createDataFrame([(k, f"A line of words number {k // 2}\nand another one", 40) for k in range(8)], "doc_id long, text string, n_chars int")
    left = corpus_pipeline.line_dedup(spark, docs, "")
    made = [spark.read.parquet(str(p)).columns for p in set(shared.glob("table-*")) - before if list(p.glob("*.parquet"))]
    assert made and not [c for c in made if "fp" in c]
    assert left.count() == 8
