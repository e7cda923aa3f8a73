"""A table published in parts: a change writes the touched parts only and flips one pointer.

The pointer says for every part (a term) in which folder its rows are, so the files of other
parts are neither read nor written, a reader sees one state of all parts, and
the pointer before is the way back.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offergrid.sources import pointers as P
from offergrid.sources.sinks import logical_hash, observed_hash

c = F.col
PART = "_part"


def part_of(term: Column) -> Column:
    """Name of a term's part: safe in any path, and the same for all spellings in letters of either case."""
    return F.md5(F.lower(F.trim(F.coalesce(term, F.lit("")))))


def _read(spark: SparkSession, target: str, schema: StructType, parts: dict[str, str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields]).add("_version", "long").add(PART, "string")
    paths = [f"{target}/_version={v}/{PART}={p}" for p, v in sorted(parts.items())]
    return spark.read.schema(stored).option("basePath", target).parquet(*paths).select(*schema.fieldNames())


def known_parts(spark: SparkSession, target: str) -> list[str]:
    return sorted((P.newest(spark, target) or {"parts": {}})["parts"])


def read_parts(spark: SparkSession, target: str, only: Iterable[str] | None = None) -> DataFrame:
    """The table as the newest pointer shows it; ``only`` some parts of it."""
    known = P.newest(spark, target)
    if known is None:
        raise ValueError(f"nothing published at {target}")
    wanted = None if only is None else set(only)
    return _read(spark, target, StructType.fromJson(known["schema"]),
                 {p: v for p, v in known["parts"].items() if wanted is None or p in wanted})


def publish_parts(df: DataFrame, target: str, term: str = "term", touched: Iterable[str] | None = None, **facts: Any) -> dict[str, Any]:
    """Write the rows of ``df`` as the new content of the parts they fall into, and of the ``touched`` ones.

    A touched part without rows goes.  What was written is read back and compared before
    the pointer flips; a failed write or check leaves the table as it was.  ``facts`` are kept with the pointer.
    """
    spark = df.sparkSession
    old = P.newest(spark, target) or {"number": 0, "parts": {}}
    version, seen = old["number"] + 1, Observation()
    path = f"{target}/_version={version}"
    df.observe(seen, *observed_hash(df)).withColumn(PART, part_of(c(term))).write.mode("overwrite").partitionBy(PART).parquet(path)
    written = [n.split("=", 1)[1] for n in P.names_in(spark, path) if n.startswith(f"{PART}=")]
    back = logical_hash(_read(spark, target, df.schema, {p: version for p in written})).first()
    want = tuple(seen.get[n] for n in ("rows", "xor", "total"))
    if want != tuple(back):
        raise ValueError(f"read-back of {path} differs: wrote {want}, read {tuple(back)}")
    parts = {p: v for p, v in old["parts"].items() if p not in set(touched or ())} | {p: version for p in written}
    return P.point(spark, target, {"parts": parts, "schema": df.schema.jsonValue(), "parent": old["number"], "facts": facts})


def roll_back(spark: SparkSession, target: str) -> dict[str, Any]:
    """Point back to the state that the current one was published upon."""
    all_ = {p["number"]: p for p in P.pointers(spark, target)}
    known = P.newest(spark, target)
    earlier = all_.get(known["parent"]) if known else None
    if earlier is None:
        raise ValueError(f"no earlier state at {target}")
    return P.point(spark, target, {k: earlier[k] for k in ("parts", "schema", "parent", "facts")})


def tidy(spark: SparkSession, target: str, kept: int = P.KEPT) -> None:
    """Drop pointers but the newest ``kept``, and parts that none of those shows."""
    live = {f"_version={v}/{PART}={p}" for known in P.forget(spark, target, kept) for p, v in known["parts"].items()}
    for folder in P.names_in(spark, target):
        if folder.startswith("_version="):
            inside = {f"{folder}/{n}" for n in P.names_in(spark, f"{target}/{folder}") if n.startswith(PART)}
            for gone in [folder] if not inside & live else inside - live:
                P.drop(spark, f"{target}/{gone}")
