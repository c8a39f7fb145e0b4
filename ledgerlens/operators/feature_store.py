"""A store of yearly aggregates from which the marts follow: a new year updates them without the payments of the others.

What is kept of a year are sums, counts and maxima by entity, and the counts by entity and representative, whose
distinct numbers and shares can be merged; so a mart over all years reads a row an entity and year, not its payments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..sources.years import YearTable
from .events import interaction_years, merged_interactions
from .payments import classify_payments, entity_year_spend, rep_years, spend_mart_of_years


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str, cfg: Config = Config()):
        self.cfg = cfg
        self.tables = {name: YearTable(spark, f"{root.rstrip('/')}/{name}") for name in ("spend_years", "interaction_years", "rep_years")}
        self.like: dict[str, DataFrame] = {}

    def _parts(self, target: DataFrame, interactions: DataFrame) -> dict[str, DataFrame]:
        counted = interactions.where("rep_id is not null").groupBy("hcp_id", "program_year", "rep_id").count().withColumnRenamed("count", "n")
        return {"spend_years": entity_year_spend(classify_payments(target, self.cfg)), "interaction_years": interaction_years(interactions, self.cfg), "rep_years": counted}

    def update(self, target: DataFrame, interactions: DataFrame, years: list[int], again: bool = False) -> list[int]:
        """Adds the years that are missing (``again``: renews all of them); gives those. Only their rows are read."""
        self.like = self._parts(target, interactions)
        changed: set[int] = set()
        for name, table in self.tables.items():
            table.recover()
            wanted = sorted(years if again else set(years) - table.years())
            if wanted:
                rows = self._parts(*(df.where(df.program_year.isin(wanted)) for df in (target, interactions)))[name]
                table.publish(rows, wanted)
                changed |= set(wanted)
        return sorted(changed)

    def _read(self, name: str) -> DataFrame:
        return self.tables[name].read(self.like[name])

    def spend_mart(self, entities: DataFrame) -> DataFrame:
        return spend_mart_of_years(entities, self._read("spend_years"), rep_years(self._read("rep_years")), self.cfg)

    def entity_interactions(self) -> DataFrame:
        return merged_interactions(self._read("interaction_years"), self._read("rep_years"))
