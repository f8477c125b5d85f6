"""Intermediate tables on the shared folder of the cluster.

Iterative jobs cut their lineage by writing each round as Parquet below the
folder named by ``spark.checkpoint.dir``.  A lost executor therefore costs a
re-read, never a recomputation of earlier rounds, and a written round is
computed exactly once (``DataFrame.checkpoint`` would compute it twice).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session.

    Only a session whose tasks run inside the driver (``local`` masters) gets a
    private folder when none is named; on a cluster that is an error, because
    executors would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-linkloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/linkloom-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a reader over the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of staged tables that no later plan reads."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/linkloom-" in f}:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def staged_by(df: DataFrame, key: str, label: str = "stage") -> DataFrame:
    """Like ``staged``, bucketed by ``key``: later joins on it do not shuffle this side.

    ``df`` should already be partitioned by ``key`` into as many parts as there
    are buckets (``buckets``), so that every task writes one bucket.  The table
    is external; its catalog entry is needed only for the lookup here.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets(spark), key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return table


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_merge(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the data: merged, since a broadcast would pass through the driver."""
    return df.hint("merge")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
