"""Tables that grow a year at a time: each year appears whole or not at all.

A year is written to a staging folder and moved to ``program_year=Y`` by one rename. A marker ``_commits/Y.started`` stands
while that goes on, ``_commits/Y.done`` after it. A run that ends in between leaves the first without the second: the next run
deletes what it finds of that year and of the staging folders. Readers don't see folders whose names begin with _.
A year without markers was there before and counts as whole. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class YearTable:
    """A Parquet table partitioned by program_year, on any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def _mark(self, year: int, state: str) -> None:
        self._fs.create(self._path(f"{self.path}/_commits/{year}.{state}"), True).close()

    def _move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} wasn't moved to {target}")

    def recover(self) -> list[int]:
        """Takes away what an interrupted run left; gives the years whose half it was."""
        marks = set(self._names(f"{self.path}/_commits"))
        half = sorted(int(m.removesuffix(".started")) for m in marks if m.endswith(".started") and f"{m.removesuffix('.started')}.done" not in marks)
        for year in half:
            self._delete(f"{self.path}/program_year={year}")
            self._delete(f"{self.path}/_commits/{year}.started")
        self._delete(f"{self.path}/_staging")
        return half

    def years(self) -> set[int]:
        """The years that are whole, those without a row included."""
        marks = self._names(f"{self.path}/_commits")
        half = {m.removesuffix(".started") for m in marks if m.endswith(".started")} - {m.removesuffix(".done") for m in marks if m.endswith(".done")}
        there = {n.removeprefix("program_year=") for n in self._names(self.path) if n.startswith("program_year=")}
        return {int(y) for y in (there | {m.removesuffix(".done") for m in marks if m.endswith(".done")}) - half if y.isdigit()}

    def publish(self, rows: DataFrame, years: list[int]) -> None:
        """Writes the rows of these years, in place of what is there of them."""
        staging = f"{self.path}/_staging/{uuid.uuid4().hex}"
        rows.where(F.col("program_year").isin(years)).write.partitionBy("program_year").parquet(staging)
        written = set(self._names(staging))
        for year in years:
            name = f"program_year={year}"
            self._delete(f"{self.path}/_commits/{year}.done")
            self._mark(year, "started")
            self._delete(f"{self.path}/{name}")
            if name in written:
                self._move(f"{staging}/{name}", f"{self.path}/{name}")
            self._mark(year, "done")
            self._delete(f"{self.path}/_commits/{year}.started")
        self._delete(f"{self.path}/_staging")

    def read(self, like: DataFrame) -> DataFrame:
        """All years' rows, with the columns of ``like``, also where there is no year yet."""
        if not any(n.startswith("program_year=") for n in self._names(self.path)):
            return like.limit(0)
        rows = self.spark.read.schema(like.schema).option("basePath", self.path).parquet(self.path)
        return rows.select(*like.columns)
