"""Person and program name matching as tiers of equi joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offergrid.functions.text import has_degree, person_key, program_signature, program_words
from offergrid.session import settled

c = F.col


def name_ratio(a: Column, b: Column) -> Column:
    """Share of matching characters, for the pairs no exact tier decided.

    The function is nested so that it travels with the plan and executors need
    no copy of this package.
    """
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(ratio, T.DoubleType())(a, b)


def _names(df: DataFrame, key: str, name: str) -> DataFrame:
    words = F.split("name_key", " ")
    return (df.select(key, person_key(c(name)).alias("name_key")).filter(c("name_key") != "").distinct()
            .withColumn("first", F.get(words, F.lit(0))).withColumn("last", F.element_at(words, -1))
            .withColumn("given", F.slice(words, F.lit(1), F.size(words) - 1)))


def match_people(targets: DataFrame, candidates: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(target_id, cand_id, score) for every pair with a score above zero.

    ``targets``: target_id, name; ``candidates``: cand_id, name; ``aliases``:
    name, alias.  Each tier joins on a key of its own (whole name; surname and
    given name; surname and four letters; surname and initial), so a common
    surname is never paired with all of its namesakes.  Names are matched once
    per distinct spelling and carried back to the ids afterwards.
    """
    t_ids = targets.select("target_id", person_key(c("name")).alias("t_name")).filter(c("t_name") != "")
    c_ids = candidates.select("cand_id", person_key(c("name")).alias("c_name")).filter(c("c_name") != "")
    own = t_ids.select("t_name", c("t_name").alias("name"), F.lit(False).alias("is_alias")).distinct()
    if aliases is not None:
        other = aliases.select(person_key(c("name")).alias("t_name"), person_key(c("alias")).alias("name"),
                               F.lit(True).alias("is_alias"))
        own = own.union(other.join(own.select("t_name"), "t_name", "left_semi")
                        .filter(c("name") != c("t_name")).distinct())
    words = F.split("name", " ")
    variants = own.withColumns({"first": F.get(words, F.lit(0)), "last": F.element_at(words, -1)})
    people = _names(candidates, "cand_id", "name").select("name_key", "first", "last", "given").distinct() \
        .withColumnsRenamed({"name_key": "c_name", "first": "c_first"})
    exact = variants.join(people.select("c_name"), c("name") == c("c_name")).select(
        "t_name", "c_name", F.when(c("is_alias"), 0.99).otherwise(1.0).alias("score"))
    parts = people.select("c_name", "last", F.explode("given").alias("part"))
    given = (variants.join(parts.withColumnRenamed("part", "first"), ["last", "first"])
             .filter(c("name") != c("c_name"))
             .select("t_name", "c_name", F.lit(0.98).alias("score")))
    short = F.least(F.length("first"), F.length("part"))
    prefix = (variants.withColumn("four", F.substring("first", 1, 4))
              .join(parts.withColumn("four", F.substring("part", 1, 4)), ["last", "four"])
              .filter((short >= 4) & (c("name") != c("c_name")) & (c("part") != c("first"))
                      & (F.startswith("first", "part") | F.startswith("part", "first")))
              .select("t_name", "c_name", F.lit(0.94).alias("score")))
    decided = exact.union(given).union(prefix).groupBy("t_name", "c_name").agg(F.max("score").alias("score"))
    longest, both = F.greatest(F.length("name"), F.length("c_name")), F.length("name") + F.length("c_name")
    reachable = 2 * (both - longest) / both >= 0.82
    near = (variants.withColumn("initial", F.substring("first", 1, 1))
            .join(people.withColumn("initial", F.substring("c_first", 1, 1)), ["last", "initial"])
            .filter(reachable & (c("name") != c("c_name")))
            .join(decided.select("t_name", "c_name"), ["t_name", "c_name"], "left_anti")
            .select("t_name", "c_name", (c("first") == c("c_first")).alias("same_first"),
                    name_ratio(c("name"), c("c_name")).alias("ratio")))
    score = F.when(c("same_first") & (c("ratio") >= 0.86), F.least(F.lit(0.96), c("ratio"))) \
        .when(c("ratio") >= 0.82, F.least(F.lit(0.88), c("ratio")))
    fuzzy = near.withColumn("score", score).filter(c("score").isNotNull()).groupBy("t_name", "c_name") \
        .agg(F.max("score").alias("score"))
    pairs = decided.union(fuzzy)
    return (pairs.join(t_ids, "t_name").join(c_ids, "c_name").groupBy("target_id", "cand_id")
            .agg(F.max("score").alias("score")))


def pick_match(targets: DataFrame, scored: DataFrame, target_courses: DataFrame, cand_courses: DataFrame) -> DataFrame:
    """(target_id, cand_id, score, outcome): one best, one by shared course, ambiguous or none."""
    scored = settled(scored)  # read three times; the name tiers run once
    best = scored.groupBy("target_id").agg(F.max("score").alias("best"))
    tied = scored.join(best, "target_id").filter(F.abs(c("score") - c("best")) < 1e-9)
    size = tied.groupBy("target_id").agg(F.count(F.lit(1)).alias("ties"), F.min("cand_id").alias("only"),
                                         F.first("best").alias("best"))
    shared = (tied.join(size.filter("ties > 1").select("target_id"), "target_id", "left_semi")
              .select("target_id", "cand_id")
              .join(target_courses.select("target_id", "course").distinct(), "target_id")
              .join(cand_courses.select("cand_id", "course").distinct(), ["cand_id", "course"])
              .select("target_id", "cand_id").distinct().groupBy("target_id")
              .agg(F.count(F.lit(1)).alias("hits"), F.min("cand_id").alias("by_course")))
    rows = targets.select("target_id").distinct().join(size, "target_id", "left").join(shared, "target_id", "left")
    by_course = c("hits") == 1
    outcome = F.when(c("ties").isNull(), "no_name_match").when(c("ties") == 1, "matched") \
        .when(by_course, "matched_by_course").otherwise("ambiguous_name")
    return rows.withColumn("outcome", outcome).select(
        "target_id", F.when(c("outcome") == "matched", c("only")).when(c("outcome") == "matched_by_course", c("by_course"))
        .alias("cand_id"),
        F.when(c("outcome") == "matched", c("best")).when(c("outcome") == "matched_by_course", F.least(
            F.lit(1.0), c("best") + 0.01)).alias("score"), "outcome")


def match_registry(plans: DataFrame, scraped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per plan with method and name, scraped names no plan took).

    ``plans``: plan_code, idx, name (own name first, then its catalog names).
    Every tier accepts only names that stand alone under their key.
    """
    names = scraped.select("scraped").distinct()

    def alone(key):
        return names.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("scraped").alias("scraped")) \
            .filter("n = 1").select("k", "scraped")

    def first_hit(key, side, method: str, rank: int) -> DataFrame:
        return plans.withColumn("k", key).join(side, "k").groupBy("plan_code").agg(
            F.min(F.struct("idx", "scraped"))["scraped"].alias("scraped")).select(
            "plan_code", F.lit(rank).alias("rank"), F.lit(method).alias("method"), "scraped")

    def sig(col, keep):
        return F.array_join(program_signature(col, keep_degree=keep), "+")

    exact = first_hit(program_words(c("name")), alone(program_words(c("scraped"))), "exact", 1)
    signed = first_hit(sig(c("name"), True), alone(sig(c("scraped"), True)), "signature", 2)
    bare = plans.filter(~has_degree(c("name"))).withColumn("k", sig(c("name"), False))
    loose = bare.join(names.select(sig(c("scraped"), False).alias("k"), "scraped"), "k").select("plan_code", "scraped") \
        .distinct().groupBy("plan_code").agg(F.count(F.lit(1)).alias("n"), F.min("scraped").alias("scraped"))
    third = loose.select("plan_code", F.lit(3).alias("rank"),
                         F.when(c("n") == 1, "unique_without_degree").otherwise("ambiguous").alias("method"),
                         F.when(c("n") == 1, c("scraped")).alias("scraped"))
    best = exact.union(signed).union(third).groupBy("plan_code").agg(
        F.min(F.struct("rank", "method", "scraped")).alias("b")).select("plan_code", "b.method", "b.scraped")
    out = plans.select("plan_code").distinct().join(best, "plan_code", "left").select(
        "plan_code", F.coalesce("method", F.lit("missing")).alias("method"), "scraped")
    return out, names.join(out.select("scraped").filter("scraped IS NOT NULL"), "scraped", "left_anti")


def registry_coverage(matches: DataFrame) -> DataFrame:
    hit = F.count("scraped")
    n = F.count(F.lit(1))
    return matches.agg(n.alias("expected"), hit.alias("matched"), F.count_distinct("scraped").alias("catalog"),
                       F.count_if(c("method") == "missing").alias("missing"),
                       F.count_if(c("method") == "ambiguous").alias("ambiguous"),
                       F.when(n == 0, 100.0).otherwise(F.round(hit / n * 100, 1)).alias("percent"))


def ratings_sync(targets: DataFrame, cached: DataFrame, matched: DataFrame) -> DataFrame:
    """State of every rating record after a sync.

    ``targets``: name_key; ``cached``: name_key, manual; ``matched``: name_key,
    outcome.  Manual records survive as they are; other cached records are
    refreshed when their name is matched again, kept when it is not, and dropped
    when nobody of that name is listed; the rest is matched new or unmatched.
    """
    t = targets.select("name_key", F.lit(True).alias("_t"))
    old = cached.select("name_key", "manual", F.lit(True).alias("_c"))
    rows = t.join(old, "name_key", "full_outer").join(matched.select("name_key", "outcome"), "name_key", "left")
    hit = c("outcome").isin("matched", "matched_by_course")
    state = (F.when(c("_t").isNull(), "dropped").when(c("manual"), "manual_kept").when(c("_c") & hit, "refreshed")
             .when(c("_c"), "kept").when(hit, "new").otherwise("unmatched"))
    return rows.withColumn("state", state).select("name_key", "state", F.when(c("state") == "unmatched", F.coalesce(
        "outcome", F.lit("no_name_match"))).alias("reason"))


def sync_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("state", "reason").agg(F.count(F.lit(1)).alias("n"))


def upsert_override(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual matches replace records of the same name and keep the first ``created_at`` of a manual one."""
    old = records.select("name_key", c("metrics_rating").alias("_r"), c("manual").alias("_m"),
                         c("created_at").alias("_c"), c("updated_at").alias("_u"))
    new = overrides.select("name_key", "metrics_rating", c("updated_at"), F.lit(True).alias("_n"))
    return old.join(new, "name_key", "full_outer").select(
        "name_key", F.coalesce("metrics_rating", "_r").alias("metrics_rating"),
        F.coalesce("_n", "_m").alias("manual"),
        F.when(c("_n") & c("_m"), F.coalesce("_c", "updated_at")).when(c("_n"), c("updated_at")).otherwise(c("_c"))
         .alias("created_at"), F.coalesce("updated_at", "_u").alias("updated_at"))


def delete_override(records: DataFrame, unmatched: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records left, unmatched list): only manual records go, and come back as unmatched once."""
    gone = records.filter("manual").join(names.select("name_key").distinct(), "name_key", "left_semi").select("name_key")
    left = records.join(gone.withColumn("manual", F.lit(True)), ["name_key", "manual"], "left_anti")
    back = gone.join(unmatched.select("name_key"), "name_key", "left_anti").select(
        "name_key", F.lit("manual_override_removed").alias("reason"))
    return left, unmatched.select("name_key", "reason").union(back)
