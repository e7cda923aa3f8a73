"""Helpers of the training-data operators: stored steps and distributed running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offergrid.session import drop_at_exit, new_folder

#: The white space of all operators: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_ROWS = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back.

    It cuts the lineage, so rows whose placement was used once never move when
    an executor is lost; the shuffle files behind the step are dropped with it.
    """
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{label}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def squeezed(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one within ``by``.

    Rows are range-sorted into chunks, so a key that holds most rows spans many
    tasks; one small table of chunk totals gives each chunk its start.
    """
    spark, keys = df.sparkSession, [F.col(k).asc_nulls_first() for k in by]
    rows = df.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // CHUNK_ROWS))
    chunks = settle(df.withColumn("_value", value).repartitionByRange(parts, *keys, *order)
                    .withColumn("_chunk", F.spark_partition_id()), "chunks")
    totals = chunks.groupBy("_chunk", *by).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_chunk").alias("_c"), *[F.col(k).alias(f"_k_{k}") for k in by],
                           F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    on = chunks["_chunk"] == starts["_c"]
    for k in by:
        on = on & chunks[k].eqNullSafe(starts[f"_k_{k}"])
    here = Window.partitionBy("_chunk", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (chunks.join(starts, on, "left")
            .withColumn(out, (F.col("_start") + F.coalesce(F.sum("_value").over(here), F.lit(0))).cast("long"))
            .drop("_value", "_chunk", "_c", "_start", *[f"_k_{k}" for k in by]))
