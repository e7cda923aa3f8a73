"""Data-quality rules, gates and invariants.

Every rule is a select that yields (code, severity, subject, course_key,
class_number); the issue table is their union.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.operators.snapshots import collapse_duplicate_offers, same_key_list
from offergrid.session import settled

c = F.col
# Rule codes that are not errors.
WARNINGS = ("conflicting_discovery_course_identity", "discovery_snapshot_missing", "inventory_drift_detected",
            "invalid_deep_aggregate", "deep_aggregate_inventory_stale", "deep_aggregate_completion_stale",
            "mixed_run_ids", "checkpoint_not_marked_complete", "checkpoint_subject_states_stale")
INFOS = ("duplicate_administrative_offering_collapsed", "cross_listed_physical_section")


@dataclass
class BuildInputs:
    """Tables of one dataset build.

    expected: subject.  files: subject, file_subject, valid, term, term_code,
    run_id, search_complete, unresolved, complete.  checkpoint: subject, status,
    term, term_code, completed.  hits / discovery_hits: key, subject, meta (a
    struct), ord.  discovery_run / aggregate_run: one row each (given, valid,
    errors, requested, completed, results_complete, detail_complete,
    detail_partial).  aggregate_keys: key.  targets / expected_targets: by, pos,
    key.  details: key, subject, status, has_info, grid_complete, units_min,
    units_max, n_rows, identity, offer, score.  sections: id, key, subject,
    course_code, detail_subject, detail_code, class_number, units_min,
    units_max, term_code, body.  unaccounted: physical classes no option holds.
    drift: one row, status.
    """
    expected: DataFrame
    files: DataFrame
    checkpoint: DataFrame
    hits: DataFrame
    discovery_hits: DataFrame
    discovery_run: DataFrame
    aggregate_run: DataFrame
    aggregate_keys: DataFrame
    targets: DataFrame
    expected_targets: DataFrame
    details: DataFrame
    sections: DataFrame
    unaccounted: DataFrame
    drift: DataFrame


def issue(df: DataFrame, code: str | Column, subject: str | None = None, key: str | None = None,
          number: str | None = None) -> DataFrame:
    text = F.lit(code) if isinstance(code, str) else code
    none = F.lit(None).cast("string")
    severity = F.when(text.isin(*WARNINGS), "warning").when(text.isin(*INFOS), "info").otherwise("error")
    return df.select(text.alias("code"), severity.alias("severity"),
                     (c(subject) if subject else none).alias("subject"), (c(key) if key else none).alias("course_key"),
                     (c(number) if number else none).alias("class_number"))


def flags(df: DataFrame, rules: dict[str, Column], subject: str | None = None, key: str | None = None,
          number: str | None = None) -> DataFrame:
    """Several independent rules over one table in one pass."""
    hit = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]),
                   lambda x: x.isNotNull())
    keep = [n for n in (subject, key, number) if n]
    return issue(df.select(*keep, F.explode(hit).alias("_code")), c("_code"), subject, key, number)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def identity_conflicts(df: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """Rows that differ from the first row of their key: ``conflict``; equal ones: ``duplicate``.

    Bodies are compared by a 256-bit digest and their length, so no long text is
    aggregated or carried to another row.
    """
    text = c(body).cast("string")
    marked = df.withColumn("_d", F.struct(F.length(text).alias("n"), F.unhex(F.sha2(text, 256)).alias("h")))
    first = marked.groupBy(key).agg(F.min_by(F.struct(c("_d").alias("d"), c(order).alias("o")), order).alias("_f"),
                                    F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    later = marked.join(first, key).filter(c(order) > c("_f.o"))
    return later.withColumn("kind", F.when(c("_d").eqNullSafe(c("_f.d")), "duplicate").otherwise("conflict")) \
        .drop("_f", "_n", "_d")


def run_consistency(i: BuildInputs) -> DataFrame:
    """One term, code and run over the files; agreement with checkpoint, aggregate and discovery."""
    file = i.expected.join(i.files.withColumn("_f", F.lit(True)), "subject", "left")
    per_file = flags(file, {"subject_output_missing": c("_f").isNull(), "subject_output_invalid": ~c("valid"),
                            "subject_output_name_mismatch": c("valid") & (c("file_subject") != c("subject"))}, "subject")
    good = i.files.join(i.expected, "subject", "left_semi").filter("valid")
    one = good.agg(F.count_distinct("term").alias("terms"), F.count_distinct("term_code").alias("codes"),
                   F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("n"), F.min("term").alias("term"),
                   F.min("term_code").alias("code")).select(
        "*", i.expected.agg(F.count(F.lit(1))).scalar().alias("wanted"))
    whole = flags(one, {"mixed_terms": c("terms") > 1, "mixed_term_codes": c("codes") > 1, "mixed_run_ids": c("runs") > 1,
                        "subject_output_count_mismatch": c("n") != c("wanted")})
    state = i.checkpoint.agg(
        F.min("term").alias("cp_term"), F.min("term_code").alias("cp_code"), F.bool_and("completed").alias("done"),
        F.count_if(c("status") != "complete").alias("open")).select(
        "*", *[one.select(n).scalar().alias(n) for n in ("terms", "codes", "term", "code")])
    cp = flags(state, {"checkpoint_term_mismatch": (c("terms") == 1) & (c("cp_term") != c("term")),
                       "checkpoint_term_code_mismatch": (c("codes") == 1) & (c("cp_code") != c("code")),
                       "checkpoint_not_marked_complete": ~c("done"), "checkpoint_subject_states_stale": c("open") > 0})
    disc = flags(i.discovery_run, {
        "discovery_snapshot_missing": ~c("given"), "invalid_discovery_snapshot": c("given") & ~c("valid"),
        "discovery_snapshot_incomplete": c("given") & c("valid") & (
            (c("errors") > 0) | (c("requested") != c("completed")) | ~c("results_complete"))})
    deep = i.hits.select("key").distinct()
    stale = deep.join(i.aggregate_keys, "key", "left_anti").select("key").union(
        i.aggregate_keys.join(deep, "key", "left_anti").select("key"))
    run = i.aggregate_run.select("*", deep.agg(F.count(F.lit(1))).scalar().alias("deep"),
                                 stale.agg(F.count(F.lit(1))).scalar().alias("stale"))
    agg = flags(run, {
        "invalid_deep_aggregate": c("given") & ~c("valid"),
        "deep_aggregate_inventory_stale": c("given") & c("valid") & (c("stale") > 0),
        "deep_aggregate_completion_stale": c("given") & c("valid") & (
            (c("detail_complete") != c("deep")) | (c("detail_partial") > 0) | (c("errors") > 0)
            | (c("requested") != c("completed")))})
    return _union([per_file, whole, cp, disc, agg])


def build_issues(i: BuildInputs) -> DataFrame:
    """All 36 rules.

    Tables that several rules read are stored once, and every group of rules is stored
    on its own: the plan of one holds few joins, and what it sends to the driver is free before the next.
    """
    i = replace(i, hits=settled(i.hits), discovery_hits=settled(i.discovery_hits), targets=settled(i.targets),
                details=settled(i.details), sections=settled(i.sections))
    deep = identity_conflicts(i.hits, "key", "meta", "ord").filter("kind = 'conflict'")
    found = identity_conflicts(i.discovery_hits, "key", "meta", "ord").filter("kind = 'conflict'")
    drift = i.drift.filter("status = 'drift_detected'")
    good = i.files.join(i.expected, "subject", "left_semi").filter("valid")
    subject = flags(good, {"subject_search_incomplete": ~c("search_complete") | (c("unresolved") > 0),
                           "subject_detail_incomplete": ~c("complete")}, "subject")
    lists = same_key_list(i.expected_targets, i.targets, "key", "pos", "by").filter("NOT same")
    complete = i.details.filter("status = 'complete' AND has_info AND n_rows > 0 AND identity IS NOT NULL")
    collapsed = settled(collapse_duplicate_offers(complete.select(c("key").alias("detail_key"), "identity", "offer", "score"),
                                                  settled(i.sections.select(c("key").alias("detail_key"), "class_number").distinct())))
    heads = collapsed.select(c("kept").alias("key")).distinct().join(i.details.select("key", "subject"), "key")
    live = i.targets.select("key", c("by").alias("t_subject")).join(
        collapsed.select(c("detail_key").alias("key")), "key", "left_anti")
    d = settled(live.join(i.details.drop("subject").withColumn("_d", F.lit(True)), "key", "left"))
    done = c("_d") & (c("status") == "complete")
    info = done & c("has_info")
    detail = flags(d, {
        "course_detail_missing": c("_d").isNull(), "course_detail_not_complete": c("_d") & (c("status") != "complete"),
        "course_info_missing": done & ~c("has_info"), "course_option_grid_incomplete": info & ~c("grid_complete"),
        "course_units_range_invalid": info & (c("units_min") > c("units_max")),
        "course_sections_missing": info & (c("n_rows") == 0)}, "t_subject", "key").withColumnRenamed("t_subject", "subject")
    used = d.filter(info & (c("n_rows") > 0)).select("key")
    wrong = ~(c("subject").eqNullSafe(c("detail_subject")) & c("course_code").eqNullSafe(c("detail_code")))
    bad_units = F.coalesce(c("units_min") > c("units_max"), F.lit(False))
    rows = settled(i.sections.join(used, "key", "left_semi").withColumns({"_wrong": wrong, "_bad": bad_units}).drop(
        "detail_subject", "detail_code", "units_min", "units_max"))
    row_rules = flags(rows, {"section_course_mismatch": c("_wrong"), "section_units_range_invalid": ~c("_wrong") & c("_bad")},
                      "subject", "key", "class_number")
    valid = rows.filter("NOT _wrong AND NOT _bad")
    twice = identity_conflicts(valid.select("id", "body", "ord", "subject", "key", "class_number"), "id", "body", "ord").filter("kind = 'conflict'")
    firsts = settled(valid.groupBy("id").agg(F.min_by(F.struct("key", "term_code", "class_number", "course_code"), "ord").alias("r"))
                     .select("r.*"))
    empty = used.join(firsts.select("key").distinct(), "key", "left_anti")
    crossed = firsts.groupBy("term_code", "class_number").agg(F.count_distinct("course_code").alias("n")).filter("n > 1")
    lost = i.unaccounted.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return _union([settled(part) for part in (
        run_consistency(i),
        issue(deep, "conflicting_deep_course_identity", "subject", "key"),
        issue(found, "conflicting_discovery_course_identity", "subject", "key"),
        issue(drift, "inventory_drift_detected"), subject,
        issue(lists, "detail_target_mismatch", "by"),
        issue(heads, "duplicate_administrative_offering_collapsed", "subject", "key"), detail, row_rules,
        issue(twice, "conflicting_course_section_listing", "subject", "key", "class_number"),
        issue(empty, "normalized_course_sections_missing", None, "key"),
        issue(crossed, "cross_listed_physical_section", None, None, "class_number"),
        issue(lost, "physical_sections_unaccounted"))])


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def publish_gate(issues: DataFrame, strict: bool = True) -> DataFrame:
    """One row: may the candidate be written, may it be installed, and the exit code."""
    errors = F.count_if(c("severity") == "error")
    return issues.agg(errors.alias("errors"), F.count_if(c("severity") == "warning").alias("warnings")).select(
        "errors", "warnings", ((c("errors") == 0) | F.lit(not strict)).alias("write"),
        (c("errors") == 0).alias("install"), F.when(c("errors") == 0, 0).otherwise(1 if strict else 2).alias("exit_code"))


def check(name: str, ok: Column, details: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.when(ok, "pass").otherwise("fail").alias("status"),
                    details.cast("string").alias("details"))
