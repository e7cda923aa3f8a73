"""Snapshot diff with move and rekey detection, target checks, merges of partial rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.functions.keys import catalog_identity, filled, snapshot_key
from offergrid.functions.text import squeeze

c = F.col
FIELDS = ("subject", "number", "title", "crse_id", "offer", "career", "section_count", "class_number")
COMPARED = ("number", "title", "career", "section_count")


class Diff(NamedTuple):
    matched: DataFrame   # key, kind (same key / moved), changed fields, offers
    rekeyed: DataFrame
    added: DataFrame
    removed: DataFrame
    summary: DataFrame


def with_keys(df: DataFrame) -> DataFrame:
    crse = F.coalesce("crse_id", F.concat(F.lit("catalog:"), c("number")))
    return df.select(*FIELDS, snapshot_key(c("subject"), c("crse_id"), c("number"), c("offer"), c("career")).alias("key"),
                     F.concat_ws("|", "subject", crse).alias("crse_key"),
                     catalog_identity(c("subject"), c("number"), c("career")).alias("identity"))


def preferred(df: DataFrame) -> DataFrame:
    """One row per key: an offer is there first, then the lowest offer, then the class number."""
    order = F.struct(c("offer").isNull(), filled(c("offer")), c("class_number"))
    rest = [n for n in df.columns if n != "key"]
    return df.groupBy("key").agg(F.min_by(F.struct(*rest), order).alias("r")).select(
        "key", *[c("r")[n].alias(n) for n in rest])


def _changed(a: str, b: str, fields: Sequence[str]) -> Column:
    """Names of differing fields, joined; null equals null."""
    return F.concat_ws(",", *[F.when(~c(f"{a}.{f}").eqNullSafe(c(f"{b}.{f}")), F.lit(f)) for f in fields])


def _once(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur exactly once, with their row."""
    rest = [n for n in df.columns if n != key]
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_r")).filter("_n = 1")
            .select(key, *[c("_r")[n].alias(n) for n in rest]))


def _struct(df: DataFrame, name: str) -> DataFrame:
    return df.select("key", "crse_key", "identity", F.struct(*FIELDS).alias(name))


def reconcile_moves(left: DataFrame, right: DataFrame, all_a: DataFrame, all_b: DataFrame) -> DataFrame:
    """Same subject and id, once in each FULL snapshot and unmatched once on each side."""
    def alone(df: DataFrame) -> DataFrame:
        return df.groupBy("crse_key").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("crse_key")

    a = _once(left.select("crse_key", c("key").alias("key_a"), "a"), "crse_key")
    b = _once(right.select("crse_key", c("key").alias("key_b"), "b"), "crse_key")
    return (a.join(b, "crse_key").join(alone(all_a), "crse_key", "left_semi")
            .join(alone(all_b), "crse_key", "left_semi").filter(c("a.crse_id").eqNullSafe(c("b.crse_id"))))


def detect_rekeys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same subject, number and career, once per side, same title, another id."""
    a = _once(left.select("identity", c("key").alias("key_a"), "a"), "identity")
    b = _once(right.select("identity", c("key").alias("key_b"), "b"), "identity")
    return a.join(b, "identity").filter(
        (F.lower(squeeze(c("a.title"))) == F.lower(squeeze(c("b.title")))) & ~c("a.crse_id").eqNullSafe(c("b.crse_id")))


def snapshot_diff(before: DataFrame, after: DataFrame) -> Diff:
    all_a, all_b = with_keys(before), with_keys(after)
    a, b = _struct(preferred(all_a), "a"), _struct(preferred(all_b), "b")
    both = a.select("key", "a").join(b.select("key", "b"), "key")
    left, right = a.join(b, "key", "left_anti"), b.join(a, "key", "left_anti")
    moves = reconcile_moves(left, right, all_a, all_b)
    left2 = left.join(moves.select(c("key_a").alias("key")), "key", "left_anti")
    right2 = right.join(moves.select(c("key_b").alias("key")), "key", "left_anti")
    rekeys = detect_rekeys(left2, right2)
    removed = left2.join(rekeys.select(c("key_a").alias("key")), "key", "left_anti").select("key", "a.*")
    added = right2.join(rekeys.select(c("key_b").alias("key")), "key", "left_anti").select("key", "b.*")
    moved_offer = ~c("a.offer").eqNullSafe(c("b.offer"))
    matched = both.select("key", F.lit("same").alias("kind"), _changed("a", "b", COMPARED).alias("changed"),
                          F.lit(False).alias("offer_changed")).union(
        moves.select("crse_key", F.lit("moved"), _changed("a", "b", COMPARED), moved_offer))
    rekeyed = rekeys.select("identity", "key_a", "key_b",
                            _changed("a", "b", ("crse_id", "offer", "class_number", "section_count")).alias("changed"))
    parts = (matched.select(F.when(c("changed") != "", "changed").otherwise("plain").alias("p"), "offer_changed")
             .union(rekeyed.select(F.lit("rekeyed"), F.lit(False))).union(added.select(F.lit("added"), F.lit(False)))
             .union(removed.select(F.lit("removed"), F.lit(False))))
    drift = c("p").isin("rekeyed", "added", "removed")
    summary = parts.agg(
        F.count_if(~drift).alias("matching"), F.count_if(c("p") == "changed").alias("metadata_changes"),
        F.count_if("offer_changed").alias("offer_changes"), F.count_if(c("p") == "rekeyed").alias("rekeyed"),
        F.count_if(c("p") == "added").alias("added"), F.count_if(c("p") == "removed").alias("removed"),
        F.when(F.count_if(drift) > 0, "drift_detected")
         .when(F.count_if((c("p") == "changed") | c("offer_changed")) > 0, "metadata_changed")
         .otherwise("match").alias("status"))
    return Diff(matched, rekeyed, added, removed, summary)


def check_targets(targets: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Issue code per target; targets in order are complete when nothing is listed.

    ``details``: key, status, has_info, grid_complete, n_rows.
    """
    code = (F.when(c("_d").isNull(), "course_detail_missing")
            .when(c("status") != "complete", "course_detail_not_complete")
            .when(~c("has_info"), "course_info_missing")
            .when(~c("grid_complete"), "course_option_grid_incomplete")
            .when(c("n_rows") == 0, "course_sections_missing"))
    return (targets.join(details.withColumn("_d", F.lit(True)), key, "left").withColumn("code", code)
            .filter(c("code").isNotNull()).select(key, "code"))


def same_key_list(expected: DataFrame, stored: DataFrame, key: str, position: str, by: str) -> DataFrame:
    """Per group: do the two ordered key lists agree place by place?"""
    a = expected.select(by, c(position).alias("_p"), c(key).alias("_a"))
    b = stored.select(by, c(position).alias("_p"), c(key).alias("_b"))
    return (a.join(b, [by, "_p"], "full_outer").groupBy(by)
            .agg(F.bool_and(c("_a").eqNullSafe(c("_b"))).alias("same")))


def merge_partials(df: DataFrame, key: str, order: str, scalars: Sequence[str], status: str | None = None) -> DataFrame:
    """First non-null of each column in ``order``; first status that is not “unknown”.

    One aggregate: ``min_by`` keeps one value per column and task, whatever the
    number of partial rows.
    """
    aggs = [F.min_by(c(n), F.when(c(n).isNotNull(), c(order))).alias(n) for n in scalars]
    if status:
        known = c(status) != "unknown"
        aggs.append(F.coalesce(F.min_by(c(status), F.when(known, c(order))), F.lit("unknown")).alias(status))
    return df.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("parts"))


def merge_lists(df: DataFrame, key: str, order: str, items: Column) -> DataFrame:
    """Distinct list items per key with the place of their first occurrence, as rows."""
    exploded = df.select(key, c(order).alias("_o"), F.posexplode(items).alias("_i", "item"))
    return exploded.groupBy(key, "item").agg(F.min(F.struct("_o", "_i")).alias("f")).select(
        key, "item", c("f._o").alias("first_part"), c("f._i").alias("first_place"))


def assemble_listings(courses: DataFrame, options: DataFrame, classes: DataFrame) -> DataFrame:
    """Class value, else option value, else course value.

    A class without meetings gets one from its option row; the instructor is the
    first meeting's, else the option's.
    """
    o = options.select("class_number", "course_key", *[c(n).alias(f"o_{n}") for n in (
        "section_number", "component", "status", "open_seats", "capacity", "location", "instructor", "meeting")])
    k = classes.select("class_number", *[c(n).alias(f"k_{n}") for n in (
        "section_number", "component", "status", "open_seats", "capacity", "location", "units_min", "units_max",
        "grading", "meetings")])
    joined = o.join(k, "class_number").join(courses, "course_key")
    meetings = F.when(F.size("k_meetings") > 0, c("k_meetings")).when(c("o_meeting").isNotNull(), F.array("o_meeting")) \
        .otherwise(c("k_meetings"))
    named = F.filter(meetings, lambda m: F.coalesce(m["instructor"], F.lit("")) != "")
    return joined.select(
        "class_number", "course_key", "course_code", "title",
        *[F.coalesce(f"k_{n}", f"o_{n}").alias(n) for n in ("section_number", "component", "open_seats", "capacity",
                                                           "location")],
        F.when(c("k_status") != "unknown", c("k_status")).otherwise(c("o_status")).alias("status"),
        F.coalesce("k_units_min", "units_min").alias("units_min"),
        F.coalesce("k_units_max", "units_max").alias("units_max"), F.coalesce("k_grading", "grading").alias("grading"),
        meetings.alias("meetings"), F.coalesce(F.get(named, F.lit(0))["instructor"], c("o_instructor")).alias("instructor"))


def collapse_duplicate_offers(details: DataFrame, rows: DataFrame) -> DataFrame:
    """Offers of one course with the SAME set of class numbers: keep one, list the rest.

    ``details``: detail_key, identity columns, offer, score; ``rows``: detail_key,
    class_number.  The set is compared by (count, two order-free 64-bit sums), and
    the winner's set is then checked element by element with a join, so a hash
    accident can not merge two offers.
    """
    members = rows.select("detail_key", "class_number").distinct()
    sets = members.groupBy("detail_key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("class_number")).alias("h1"),
        F.sum(F.xxhash64(F.lit("s"), "class_number") % 1_000_000_007).alias("h2"))
    group = ["identity", "n", "h1", "h2"]
    candidates = details.join(sets, "detail_key")
    number = c("offer").try_cast("int")
    order = F.struct((-c("score")).alias("s"), number.isNull().alias("t"), number.alias("o"), "offer", "detail_key")
    heads = candidates.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.count_distinct("offer").alias("offers"),
                                           F.min(order)["detail_key"].alias("kept")) \
        .filter("size > 1 AND offers > 1")
    pairs = candidates.join(heads.select(*group, "kept"), group).filter("detail_key <> kept").select("detail_key", "kept", "n")
    common = (pairs.join(members, "detail_key").join(
        members.select(c("detail_key").alias("kept"), "class_number"), ["kept", "class_number"])
        .groupBy("detail_key", "kept").agg(F.count(F.lit(1)).alias("common")))
    return (pairs.join(common, ["detail_key", "kept"]).filter("common = n")
            .select("detail_key", "kept", c("n").alias("classes")))


def fill_if_agreed(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """A missing value is filled where all given values of the key agree on one."""
    given = F.when(F.trim(column) != "", F.trim(column))
    agreed = (df.groupBy(*key).agg(F.min(given).alias("_lo"), F.max(given).alias("_hi")).filter("_lo = _hi")
              .select(*key, c("_lo").alias("_v")))
    return (df.join(agreed, list(key), "left").withColumn("filled", given.isNull() & c("_v").isNotNull())
            .withColumn(column, F.coalesce(given, "_v")).drop("_v"))


def merge_hits(df: DataFrame, key: str, count: str, seq: str) -> DataFrame:
    """One row per key: the larger count, then the first seen; ``complete`` when no part was capped."""
    rest = [n for n in df.columns if n != key]
    best = F.struct((-F.coalesce(c(count), F.lit(-1))).alias("n"), c(seq).alias("s"))
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), best).alias("r"), F.bool_or("capped").alias("any_capped")).select(
        key, *[c("r")[n].alias(n) for n in rest if n != "capped"], (~c("any_capped")).alias("complete"))


def run_progress(targets: DataFrame, details: DataFrame, by: str, key: str) -> DataFrame:
    """Per subject: targeted, attempted, complete, partial, warnings, and the status."""
    d = details.select(key, F.lit(True).alias("_d"), "status", "warnings", "failed")
    out = targets.join(d, key, "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("targeted"), F.count("_d").alias("attempted"),
        F.count_if(c("status") == "complete").alias("complete"),
        F.count_if(c("_d") & (c("status") != "complete")).alias("partial"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
        F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"))
    done = c("complete") == c("targeted")
    return out.withColumn("status", F.when(c("attempted") == 0, "pending").when(done & ~c("failed"), "complete")
                          .when(c("failed"), "failed").otherwise("partial")).drop("failed")


def resume_plan(targets: DataFrame, prior: DataFrame, key: str, inventory: DataFrame | None = None) -> DataFrame:
    """What to keep and what to do again.

    ``targets``: key, place, by; ``prior``: key, status, attempts.  A target
    with a complete prior record is kept; others are to do, one attempt more;
    prior keys that are no target any more are dropped.  ``inventory`` (by,
    same) marks groups whose stored key list differs: all of them are redone.
    """
    p = prior.select(key, c("status").alias("_s"), c("attempts").alias("_a"))
    rows = targets.join(p, key, "left")
    redo = F.lit(False)
    if inventory is not None:
        rows = rows.join(inventory.filter("NOT same").select("by", F.lit(True).alias("_redo")), "by", "left")
        redo = F.coalesce("_redo", F.lit(False))
    plan = rows.select(key, "place", F.when((c("_s") == "complete") & ~redo, "keep").otherwise("todo").alias("action"),
                       (F.coalesce("_a", F.lit(0)) + F.when((c("_s") == "complete") & ~redo, 0).otherwise(1)).alias("attempts"))
    gone = prior.join(targets.select(key), key, "left_anti").select(
        key, F.lit(None).cast("long").alias("place"), F.lit("drop").alias("action"), c("attempts"))
    return plan.unionByName(gone)


def fold_export_rows(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per class, its distinct meetings and instructors as rows, class numbers under two courses)."""
    heads = df.groupBy(key).agg(
        *[F.min_by(c(n), F.when(c(n).isNotNull(), c(order))).alias(n) for n in (
            "subject", "catalog_number", "title", "units", "capacity", "enrolled", "status")],
        F.array_sort(F.collect_set("mode")).alias("modes"), F.bool_or(c("start_min").isNotNull()).alias("timed"),
        F.count(F.lit(1)).alias("n_rows"))
    facts = F.filter(F.array(
        F.when(c("day").isNotNull(), F.struct(F.lit("meeting").alias("kind"), F.concat_ws(
            " ", "day", c("start_min").cast("string"), c("end_min").cast("string"), "room").alias("value"))),
        F.when(c("instructor") != "", F.struct(F.lit("instructor").alias("kind"), c("instructor").alias("value")))),
        lambda x: x.isNotNull())
    parts = (df.select(key, c(order).alias("_o"), F.inline(facts)).groupBy(key, "kind", "value")
             .agg(F.min("_o").alias("first_row")))
    conflicts = (df.groupBy(key).agg(F.count_distinct("subject", "catalog_number").alias("courses"))
                 .filter("courses > 1"))
    return heads, parts, conflicts
