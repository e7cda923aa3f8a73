"""Running a stream to the end of what is there, with output per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def follow(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
           every: str = "30 seconds") -> StreamingQuery:
    """Keep processing what arrives, with a flush at most ``every`` interval; the caller stops the query."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
            .trigger(processingTime=every).start())


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all files there are, then stop; a rerun goes on from the checkpoint."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a batch that runs again overwrites itself."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(out)


def last_state(emitted: DataFrame, key: list[str]) -> DataFrame:
    """Last emission per key of an update-mode output."""
    rest = [n for n in emitted.columns if n not in (*key, "batch")]
    return emitted.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(
        *key, *[F.col("r")[n].alias(n) for n in rest])
