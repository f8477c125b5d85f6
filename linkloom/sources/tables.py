"""Table readers: fixed schemas, column pruning and filters left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema


def scan_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table written by this library, read with its declared schema."""
    return spark.read.schema(schema(name)).parquet(f"{directory}/{name}")


def write_table(df: DataFrame, directory: str, name: str, mode: str = "append") -> None:
    """Write with the declared columns, partitioned by site so reads of one site prune."""
    declared = schema(name)
    shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared])
    writer = shaped.write.mode(mode)
    if "site_id" in declared.names:
        writer = writer.partitionBy("site_id")
    writer.parquet(f"{directory}/{name}")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages; ``html`` is read only by plans that use it."""
    return spark.read.parquet(path)


def append_fetch_logs(logs: DataFrame, path: str) -> DataFrame:
    """Append one row per request; the redirect chain is stored as JSON."""
    shaped = fetch_log_rows(logs)
    shaped.write.mode("append").parquet(path)
    return shaped


def fetch_log_rows(logs: DataFrame) -> DataFrame:
    return logs.withColumn("redirect_chain", F.to_json("redirect_chain"))
