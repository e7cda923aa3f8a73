"""Whole-table ordering without a single-task window.

A plain ``row_number() over (order by …)`` moves every row into one task, and
``partition by key`` does the same for a key that holds a large part of the
table.  ``ranked`` cuts the rows into range chunks first, so one key may span
many tasks, and adds up the chunk sizes afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offergrid.session import settled

CHUNK_ROWS = 100_000


def _plain(name: str) -> Column:
    return F.col(name).asc_nulls_first()


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "pos",
           chunk_rows: int = CHUNK_ROWS, stored: bool = False, worked: tuple[dict[str, Column], Sequence[Column]] | None = None,
           shown: Sequence[str] | None = None) -> DataFrame:
    """Add ``out`` = 1, 2, 3 … within ``by`` (or over the whole table).

    ``order`` must end in a unique column.  The number of chunks follows from the
    number of rows alone, so no task sees more than about ``chunk_rows`` rows
    whatever the shuffle settings; range bounds come from a sample, hence the
    margin.  Rows are counted, sampled and dealt, so they are stored first, unless they
    are cheap to read (``stored``).  A chunk is sorted before it is stored with the place of its rows:
    bounds must not move under a later read, and no second shuffle numbers them.

    ``worked`` is for keys wider than what they are made of: columns added once the rows are dealt, and ``order`` over them;
    they are neither shuffled nor stored.  ``shown`` names the columns to keep beside ``by``.
    """
    keys = list(by)
    full = [_plain(k) for k in keys] + list(order)
    rows = df if stored else settled(df)
    parts = max(1, -(-2 * rows.count() // chunk_rows))
    placed, added = rows.repartitionByRange(parts, *full), {}
    if worked:
        added, inside = worked
        placed, full = placed.withColumns(added), [_plain(k) for k in keys] + list(inside)
    placed = placed.sortWithinPartitions(*full).drop(*added)
    placed = (placed.select(*keys, *shown) if shown else placed).withColumns(
        {"_chunk": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})  # grows by one inside a chunk
    chunks = settled(placed)
    sizes = chunks.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_c"), "_first",
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = chunks["_chunk"] == starts["_c"]
    for k in keys:
        on = on & chunks[k].eqNullSafe(starts[f"_k_{k}"])
    # without keys there is one row a chunk
    return (chunks.join(starts if keys else F.broadcast(starts), on, "left")
            .withColumn(out, (F.col("_start") + F.col("_at") - F.col("_first") + 1).cast("long"))
            .drop("_chunk", "_at", "_first", "_start", "_c", *[f"_k_{k}" for k in keys]))


def top_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, salts: int = 32) -> DataFrame:
    """First ``n`` rows per key in two rounds: per (key, salt), then per key.

    The second round sees at most ``n * salts`` rows of a key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    last = Window.partitionBy(*by).orderBy(*order)
    return (salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
            .withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= n)
            .drop("_salt", "_rn"))
