"""A keyed table that a stream keeps up to date: hash buckets, small deltas, compaction, one pointer.

A flush writes the newest row of every changed key to a delta folder, one file a bucket
at most, and flips the pointer.  Every ``COMPACT`` flushes the buckets that the deltas touch are
merged with their base and written anew; other buckets keep their files.  What
the newest pointers do not show is deleted, so the number of files is bounded by
buckets and not by flushes.  The pointer names the micro-batch, so one that runs again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offergrid.sources import pointers as P

BUCKETS, COMPACT = 16, 8
c = F.col


def _newest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [n for n in rows.columns if n != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[c("r")[n].alias(n) for n in rest])


def _write(rows: DataFrame, out: str, key: str, buckets: int) -> str:
    folder = f"set-{uuid.uuid4().hex}"
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    placed.repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{out}/{folder}")
    return folder


def _buckets(spark: SparkSession, out: str, folder: str) -> list[str]:
    return [n for n in P.names_in(spark, f"{out}/{folder}") if n.startswith("_bucket=")]


def _load(spark: SparkSession, out: str, schema: StructType, paths: Sequence[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out}/{p}" for p in paths])


def _paths(known: dict) -> list[str]:
    return [f"{folder}/{b}" for b, folder in sorted(known["base"].items())] + [f"{f}/{b}" for f, inside in known["deltas"] for b in inside]


def upsert_writer(out: str, key: str, order: Sequence[str], version: int = 1, buckets: int = BUCKETS,
                  compact: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the newest row per ``key`` by ``order``, whatever batch it came with."""
    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        known = P.newest(spark, out) or {"base": {}, "deltas": [], "batch": -1}
        if known["batch"] >= batch:  # flushed before the restart
            return
        schema = df.schema
        base, deltas = dict(known["base"]), list(known["deltas"])
        folder = _write(_newest(df, key, order), out, key, buckets)
        deltas.append((folder, _buckets(spark, out, folder)))
        if len(deltas) >= compact:
            touched = sorted({b for _, inside in deltas for b in inside})
            paths = [f"{base[b]}/{b}" for b in touched if b in base] + [f"{f}/{b}" for f, inside in deltas for b in inside]
            merged = _write(_newest(_load(spark, out, schema, paths), key, order), out, key, buckets)
            base |= {b: merged for b in touched}
            deltas = []
        P.point(spark, out, {"base": base, "deltas": deltas, "batch": batch, "schema_version": version, "key": key,
                             "order": list(order), "schema": schema.jsonValue()})
        live = {p for shown in P.forget(spark, out) for p in _paths(shown)}
        for old in P.names_in(spark, out):
            if old.startswith("set-"):
                inside = {f"{old}/{b}" for b in _buckets(spark, out, old)}
                for gone in [old] if not inside & live else inside - live:
                    P.drop(spark, f"{out}/{gone}")

    return each


def read_upserted(spark: SparkSession, out: str) -> DataFrame:
    """The table as the newest pointer shows it, with its ``schema_version``."""
    known = P.newest(spark, out)
    if known is None:
        raise ValueError(f"nothing flushed to {out}")
    rows = _load(spark, out, StructType.fromJson(known["schema"]), _paths(known))
    return _newest(rows, known["key"], known["order"]).withColumn("schema_version", F.lit(known["schema_version"]))
