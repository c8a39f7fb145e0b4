"""Sources and sinks: payment files by year, tables, rules, summaries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .years import YearTable

PAYMENT_SCHEMA = "record_id string, profile_id string, recipient_type string, specialty string, state string, company_raw string, payment_amount string, payment_date string, nature_of_payment string"


def read_payments_csv(spark: SparkSession, root: str, partition: str = "program_year") -> DataFrame:
    """Quoted CSV in one folder a year (``program_year=2022/...``). The year is the folder's; values that don't parse are null."""
    raw = spark.read.schema(PAYMENT_SCHEMA).option("basePath", root).csv(root, header=True, quote='"', escape='"', mode="PERMISSIVE", multiLine=True)
    return raw.select("record_id", F.expr("try_cast(profile_id AS bigint)").alias("profile_id"), "recipient_type", "specialty", "state", "company_raw", F.expr("try_cast(payment_amount AS double)").alias("payment_amount"), F.expr("try_cast(payment_date AS date)").alias("payment_date"), "nature_of_payment", F.col(partition).cast("bigint").alias("program_year"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ingest_years(spark: SparkSession, source: DataFrame, path: str, years: list[int], company_pattern: str | None = None) -> list[int]:
    """Writes the years that path doesn't have yet, one partition each, only rows of the company; gives those written.

    A year appears whole: what a run that ended early left of it is written anew (see YearTable).
    """
    table = YearTable(spark, path)
    table.recover()
    missing = sorted(set(years) - table.years())
    if missing:
        table.publish(source.where(F.lower("company_raw").contains(company_pattern.lower())) if company_pattern else source, missing)
    return missing


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, rule sources) of a registry {"rules": [...]}. Thresholds are numbers; true and false become 1 and 0."""
    schema = "rules array<struct<rule_id string, rule_name string, category string, threshold string, unit string, threshold_type string, severity string, applies_to array<string>, sources array<struct<doc_id string, authority string, doc_type string, chunk_id string, extracted_value string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("rules").alias("r")).select("r.*")

    def number(name: str):
        return F.when(F.lower(name) == "true", 1.0).when(F.lower(name) == "false", 0.0).otherwise(F.expr(f"try_cast({name} AS double)"))

    rules = rows.withColumns({"is_boolean": F.coalesce(F.lower("threshold").isin("true", "false"), F.lit(False)), "threshold": number("threshold")})
    sources = rows.select("rule_id", F.posexplode_outer("sources").alias("place", "s")).select("rule_id", "place", "s.*")
    return rules.drop("sources"), sources.withColumn("value", number("extracted_value"))


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def optional_source(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table at path, or an empty one of the schema if there is none."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_summary(df: DataFrame, path: str) -> None:
    """A few aggregated rows as JSON."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors reach; on a local master without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder or own.isDefined():
        return folder or own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path within the shared one; the driver deletes it when it ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: what reads it several times computes it once, and an executor lost later costs nothing of it."""
    spark = df.sparkSession
    path = f"{own_folder(spark, 'kept')}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
