"""Sinks: versioned publish with read-back check, manifest, keyed append, report tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

c = F.col


def observed_hash(df: DataFrame) -> list:
    h = F.xxhash64(*[c(f"`{n}`") for n in sorted(df.columns)])
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"),
            F.coalesce(F.sum(h % 1_000_000_007), F.lit(0)).alias("total")]


def logical_hash(df: DataFrame) -> DataFrame:
    """(rows, xor, sum): equal for equal row sets whatever their order or files."""
    return df.agg(*observed_hash(df))


class Version(NamedTuple):
    """One row of the pointer: its number, the table it shows, and the number of the row it stands on (0: none)."""

    number: int
    path: str
    parent: int = 0


def _pointer(target: str) -> str:
    return f"{target.rstrip('/')}/pointer"


def _pointer_row(spark: SparkSession, target: str, number: int | None = None) -> Version | None:
    """The newest row of the pointer, or the one with ``number``; None if there is none."""
    try:
        rows = spark.read.schema("seq long, path string, parent long").parquet(_pointer(target))
        row = (rows if number is None else rows.filter(c("seq") == number)).orderBy(c("seq").desc()).first()
    except Exception as exc:  # noqa: BLE001 - only a table that does not exist yet is fine
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise
    return Version(row["seq"], row["path"], row["parent"]) if row else None


def _point(spark: SparkSession, target: str, seq: int, path: str, parent: int) -> Version:
    row = spark.createDataFrame([(seq, path, parent)], "seq long, path string, parent long")
    row.coalesce(1).write.mode("append").parquet(_pointer(target))  # one row
    return Version(seq, path, parent)


def publish(df: DataFrame, target: str, partition_by: Sequence[str] = ("term",)) -> Version:
    """Write a new version, read it back, and point to it only when it is whole.

    Readers follow the pointer, so they see the old or the new table, never
    half of one.  A failed write or check leaves the pointer alone; the version
    before is the backup.  The hash of what is written is taken by the write.
    """
    spark = df.sparkSession
    old = _pointer_row(spark, target)
    seq = (old.number if old else 0) + 1
    path, seen = f"{target.rstrip('/')}/version={seq}", Observation()
    df.observe(seen, *observed_hash(df)).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    want = tuple(seen.get[n] for n in ("rows", "xor", "total"))
    back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    got = logical_hash(back).first()
    if want != tuple(got):
        raise ValueError(f"read-back of {path} differs: wrote {want}, read {tuple(got)}")
    return _point(spark, target, seq, path, old.number if old else 0)


def read_published(spark: SparkSession, target: str) -> DataFrame:
    known = _pointer_row(spark, target)
    if known is None:
        raise ValueError(f"nothing published at {target}")
    return spark.read.parquet(known.path)


def rollback(spark: SparkSession, target: str) -> Version:
    """Point back to what the current version was published upon; a second call goes back one more."""
    known = _pointer_row(spark, target)
    earlier = _pointer_row(spark, target, known.parent) if known else None
    if earlier is None:
        raise ValueError(f"no earlier version at {target}")
    return _point(spark, target, known.number + 1, earlier.path, earlier.parent)


def table_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Path, bytes and sha256 of every file below the paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet") \
        .load(list(paths))
    return files.select("path", c("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_by_id(existing: DataFrame, incoming: DataFrame, key: str = "listing_id") -> DataFrame:
    """Merge keyed by id: the incoming row wins; rows of other ids pass as they are, ids being unique on each side."""
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(incoming)


def report_tables(parts: dict[str, DataFrame]) -> DataFrame:
    """Report parts as one long table: part, field, value, row key."""
    out = None
    for name, df in parts.items():
        key, *rest = df.columns
        cells = F.array(*[F.struct(F.lit(n).alias("field"), c(n).cast("string").alias("value")) for n in rest])
        long = df.select(F.lit(name).alias("part"), c(key).cast("string").alias("row"), F.inline(cells))
        out = long if out is None else out.unionByName(long)
    return out
