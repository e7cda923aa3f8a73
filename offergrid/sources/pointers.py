"""Numbered pointers of a stored table: small JSON files, of which readers follow the newest whole one.

A pointer is created without overwriting, so of two writers with the same number one
fails; a reader that meets a half-written one takes the one before.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

KEPT = 2


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """File and folder names in ``folder``; none if it is not there."""
    _, at, fs = _store(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def drop(spark: SparkSession, path: str) -> None:
    _, at, fs = _store(spark, path)
    fs.delete(at, True)


def _numbers(spark: SparkSession, target: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names_in(spark, f"{target}/_pointers") if n.endswith(".json"))


def _load(spark: SparkSession, target: str, number: int) -> dict[str, Any] | None:
    jvm, at, fs = _store(spark, f"{target}/_pointers/{number:012d}.json")
    stream = fs.open(at)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return {**json.loads(text), "number": number} if text.endswith("\n") else None
    except json.JSONDecodeError:
        return None


def pointers(spark: SparkSession, target: str) -> list[dict[str, Any]]:
    """All whole pointers, newest first; each with its ``number``."""
    found = (_load(spark, target, n) for n in reversed(_numbers(spark, target)))
    return [p for p in found if p is not None]


def newest(spark: SparkSession, target: str) -> dict[str, Any] | None:
    for n in reversed(_numbers(spark, target)):
        if (known := _load(spark, target, n)) is not None:
            return known
    return None


def point(spark: SparkSession, target: str, payload: dict[str, Any]) -> dict[str, Any]:
    """Write the next pointer."""
    number = max(_numbers(spark, target), default=0) + 1
    _, at, fs = _store(spark, f"{target}/_pointers/{number:012d}.json")
    out = fs.create(at, False)
    out.write(bytearray((json.dumps(payload) + "\n").encode()))
    out.close()
    return {**payload, "number": number}


def forget(spark: SparkSession, target: str, kept: int = KEPT) -> list[dict[str, Any]]:
    """Drop all but the newest ``kept`` pointers and give those."""
    left = pointers(spark, target)[:kept]
    oldest = min((p["number"] for p in left), default=0)
    for n in _numbers(spark, target):
        if n < oldest:
            drop(spark, f"{target}/_pointers/{n:012d}.json")
    return left
