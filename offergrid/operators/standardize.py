"""Raw text tables to typed tables, with the failed conversions as rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``column`` = ``value(raw column)``; a null from non-blank raw text breaks ``name``."""
    name: str
    raw: str
    column: str
    value: Column


class Standardized(NamedTuple):
    rows: DataFrame
    issues: DataFrame


def standardize(df: DataFrame, key: str, rules: Sequence[Rule], keep: Sequence[str] = ()) -> Standardized:
    """One narrow pass for the rows, one for the issues; no shuffle."""
    typed = df.select(key, *keep, *[r.raw for r in rules], *[r.value.alias(r.column) for r in rules])
    rows = typed.select(key, *keep, *[r.column for r in rules])
    failed = [F.when((F.coalesce(F.trim(r.raw), F.lit("")) != "") & F.col(r.column).isNull(),
                     F.struct(F.lit(r.name).alias("rule"), F.lit(r.raw).alias("column"), F.col(r.raw).alias("raw")))
              for r in rules]
    issues = (typed.select(key, F.explode(F.filter(F.array(*failed), lambda x: x.isNotNull())).alias("i"))
              .select(key, "i.rule", "i.column", "i.raw"))
    return Standardized(rows, issues)


def split_subject(df: DataFrame, text: str, known: DataFrame, subject: str, key: str) -> DataFrame:
    """Longest known prefix wins; the next word must look like a number.

    Word prefixes are exploded and met by an equi join, so the list of subjects
    may have any size.
    """
    words = F.split(F.upper(F.trim(F.regexp_replace(text, r"\s+", " "))), " ")
    n = F.col("_n")
    cut = (df.select(key, words.alias("_w"))
           .filter(F.size("_w") > 1)
           .select(key, "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("_n"))
           .select(key, n, F.array_join(F.slice("_w", F.lit(1), n), " ").alias("_p"),
                   F.element_at("_w", n + 1).alias("_c"))
           .filter(F.col("_c").rlike(r"^[0-9][0-9A-Z.-]*$")))
    names = known.select(F.upper(F.trim(F.regexp_replace(subject, r"\s+", " "))).alias("_p"),
                         F.col(subject).alias("_s")).groupBy("_p").agg(F.min("_s").alias("_s"))
    best = (cut.join(names, "_p").groupBy(key)
            .agg(F.max(F.struct("_n", "_s", "_c")).alias("b"))
            .select(key, F.col("b._s").alias("subject"), F.col("b._c").alias("catalog_number")))
    return best
