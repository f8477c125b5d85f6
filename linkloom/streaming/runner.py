"""Run a streaming plan over what is available and read the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.stage import new_path


def read_table_stream(spark: SparkSession, directory: str, name: str, schema: StructType) -> DataFrame:
    """A stream over the files of one table in a folder of tables."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)


#: Typed state, timers and the state reader need this provider.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, mode: str = "update", label: str = "stream") -> DataFrame:
    """Process all available input, then stop; rows carry their ``batch_id``.

    Each micro-batch overwrites its own folder, so a replayed batch after a
    failure leaves no duplicates.  Results and checkpoints live on the shared
    folder.
    """
    return run_with_state(stream, mode, label)[0]


def run_with_state(stream: DataFrame, mode: str = "update", label: str = "stream") -> tuple[DataFrame, str]:
    """Like ``run_available``, with the folder of the checkpoint, from which state can be read."""
    spark = stream.sparkSession
    path = new_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    provider = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if provider is None else spark.conf.set(PROVIDER, provider)
    schema = StructType(stream.schema.fields).add("batch_id", "long")
    return spark.read.schema(schema).parquet(f"{path}/data"), f"{path}/checkpoint"


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """Last emitted version per key of an update-mode result."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )
