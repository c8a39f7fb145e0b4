"""Years that appear whole or not at all, and a store whose updates equal a rebuild."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.events import entity_interactions
from ledgerlens.operators.feature_store import FeatureStore
from ledgerlens.operators.payments import spend_mart
from ledgerlens.plans import marts
from ledgerlens.plans.fixtures import CONFIG, view
from ledgerlens.sources import io
from ledgerlens.sources.years import YearTable

SF_DIR = "/root/testdata/sf0.001"


def payments(spark):
    return spark.createDataFrame([(f"r{y}{i}", "Acme" if i % 2 else "Other", y) for y in (2022, 2023, 2024) for i in range(20)], "record_id string, company_raw string, program_year long")


def counts(spark, path):
    return {r.program_year: r["count"] for r in spark.read.parquet(path).groupBy("program_year").count().collect()}


def test_a_killed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), payments(spark)
    assert io.ingest_years(spark, rows, path, [2022]) == [2022]
    move = YearTable._move

    def killed(self, source, target):
        if "2024" in target:
            raise KeyboardInterrupt
        move(self, source, target)

    monkeypatch.setattr(YearTable, "_move", killed)
    with pytest.raises(KeyboardInterrupt):
        io.ingest_years(spark, rows, path, [2022, 2023, 2024])
    assert counts(spark, path) == {2022: 20, 2023: 20} and YearTable(spark, path).years() == {2022, 2023}
    monkeypatch.undo()
    # half of a year that was being moved
    rows.where("program_year = 2024").limit(3).drop("program_year").write.parquet(f"{path}/program_year=2024")
    assert io.ingest_years(spark, rows, path, [2022, 2023, 2024]) == [2024]
    assert counts(spark, path) == {2022: 20, 2023: 20, 2024: 20}
    assert io.ingest_years(spark, rows, path, [2022, 2023, 2024]) == []
    assert not (tmp_path / "t" / "_staging").exists()


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "t"), payments(spark)
    bad = rows.withColumn("record_id", F.when(F.col("record_id") == "r20235", F.raise_error(F.lit("stop"))).otherwise(F.col("record_id")))
    with pytest.raises(Exception, match="stop"):
        io.ingest_years(spark, bad, path, [2022, 2023])
    assert YearTable(spark, path).years() == set()
    assert io.ingest_years(spark, rows, path, [2022, 2023]) == [2022, 2023] and counts(spark, path) == {2022: 20, 2023: 20}


def test_years_without_markers_and_without_rows(spark, tmp_path):
    path, rows = str(tmp_path / "t"), payments(spark)
    rows.where("program_year = 2022").limit(5).write.partitionBy("program_year").parquet(path)
    assert io.ingest_years(spark, rows, path, [2022, 2030]) == [2030]
    assert io.ingest_years(spark, rows, path, [2022, 2030, 2023], "acme") == [2023]
    assert counts(spark, path) == {2022: 5, 2023: 10}
    assert YearTable(spark, str(tmp_path / "none")).read(rows).count() == 0


def close(a, b):
    return a.keys() == b.keys() and all(x == y or isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(x)) for k in a for x, y in zip(a[k], b[k], strict=True))


def keyed(df):
    return {r.hcp_id: tuple(r) for r in df.collect()}


def test_updates_equal_a_rebuild(spark, tmp_path):
    target, met, entities = marts.target(spark, SF_DIR), view(spark, SF_DIR, "interactions"), view(spark, SF_DIR, "master")
    years = sorted({r[0] for df in (target, met) for r in df.select("program_year").distinct().collect()})
    store = FeatureStore(spark, str(tmp_path / "s"), CONFIG)
    assert store.update(target, met, years[:1]) == years[:1]
    for y in years[1:]:
        assert store.update(target.where(F.col("program_year") == y), met.where(F.col("program_year") == y), [y]) == [y]
    assert store.update(target, met, years) == []
    assert close(keyed(store.spend_mart(entities)), keyed(spend_mart(entities, target, met, CONFIG)))
    assert close(keyed(store.entity_interactions()), keyed(entity_interactions(met, CONFIG)))
    # a year that changes is renewed
    less = target.where("record_id not like '%1-%'")
    assert store.update(less, met, years[-1:], again=True) == years[-1:]
    mixed = target.where(F.col("program_year") != years[-1]).union(less.where(F.col("program_year") == years[-1]))
    assert close(keyed(store.spend_mart(entities)), keyed(spend_mart(entities, mixed, met, CONFIG)))
