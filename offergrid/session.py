"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("offergrid")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Where that is unset, a session that runs in one process (tests, a laptop)
    gets a temporary folder once; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("offergrid.shared.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("offergrid.shared.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/offergrid/{label}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted when the session's process ends; until then results may read it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


# Shuffled rows a task reads inside ``small_tasks`` where the session names no size, and the partitions they are dealt over.
TASK_SIZE, TASK_PARTITIONS = "16m", 600


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """What runs inside reads its shuffles in more and smaller tasks, for steps that sort wide rows after a join.

    Adaptive execution still puts small partitions together and splits hot ones; where it may not, nothing changes.
    """
    size, count = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    before = {n: spark.conf.get(n, None) for n in (size, count)}
    if all(spark.conf.get(f"spark.sql.adaptive.{n}") == "true" for n in ("enabled", "coalescePartitions.enabled")):
        spark.conf.set(size, before[size] or TASK_SIZE)
        spark.conf.set(count, max(TASK_PARTITIONS, int(spark.conf.get(count))))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read back.

    It cuts the lineage, so a lost executor can not make Spark work out again
    rows whose placement was already used, and several readers share one pass;
    unlike a checkpoint it prunes columns and has a known size.
    """
    path = new_folder(df.sparkSession, "settled")
    df.write.option("compression", "zstd").parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
