"""Counts, coverage, rollups and registries.

All groupings reduce map-side.  Sets are kept only where the catalog bounds
them (modes, campuses, labels); open-ended sets come out as rows or counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.functions import keys as K
from offergrid.functions import labels as L
from offergrid.functions import text as T
from offergrid.operators.filters import FilterSpec
from offergrid.operators.ordering import ranked, top_per_key

c = F.col
SITE_ORDER = ("San Diego Campus", "Imperial Valley Campus", "Global Campus")
STATUS_ORDER = ("open", "waitlist", "closed", "unknown")
GRADING_ORDER = ("letter", "credit_no_credit", "letter_or_credit_no_credit", "other")
MODE_ORDER = tuple(key for key, _ in L.MODE_LABELS)
CLASS_ORDER = ("major_prep", "major_course", "elective")


def inventory_counts(df: DataFrame) -> DataFrame:
    offering = K.offering_key(c("term"), c("term_code"), c("subject"), c("crse_id"), c("course_code"), c("offer"),
                              c("career"))
    return df.agg(F.count(F.lit(1)).alias("listings"), F.count_distinct(offering).alias("offerings"),
                  F.count_distinct(K.physical_key(c("term"), c("term_code"), c("schedule_number"))).alias("physical"),
                  F.count_distinct("subject").alias("subjects"), F.count_distinct("term").alias("terms"))


def _place(value: Column, order: Sequence[str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ((v, i) for i, v in enumerate(order)) for x in pair])
    return F.coalesce(table[value], F.lit(len(order)))


def filter_options(df: DataFrame, linked_names: DataFrame | None = None) -> DataFrame:
    """Distinct values per facet with their position in that facet's own order."""
    def one(facet: str, value: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"))

    name = F.when(~T.is_placeholder(c("instructor")), F.trim("instructor"))
    flat = F.array(one("term", c("term")), one("campus", T.canonical_label(c("campus"))),
                   one("grading", c("grading")), one("mode", c("instruction_mode")), one("status", c("seat_status")),
                   one("instructor", name))
    tags = F.concat(
        F.transform("requirement_tags", lambda t: one("requirement", t)),
        F.flatten(F.transform("program_tags", lambda t: F.array(
            one("program", t["program"]), one("year", t["year"]), one("class", t["classification"])))))
    values = df.select(F.inline(F.concat(flat, tags)))
    if linked_names is not None:
        values = values.union(linked_names.filter(~T.is_placeholder(c(linked_names.columns[0]))).select(
            F.lit("instructor"), F.trim(linked_names.columns[0])))
    values = values.filter(c("value") != "").distinct()
    v, facet = c("value"), c("facet")
    key = T.term_key(v)
    rank = (F.when(facet == "term", key["year"] * 100 + key["season"])
            .when(facet == "campus", _place(v, SITE_ORDER)).when(facet == "grading", _place(v, GRADING_ORDER))
            .when(facet == "mode", _place(v, MODE_ORDER)).when(facet == "status", _place(v, STATUS_ORDER))
            .when(facet == "class", _place(v, CLASS_ORDER)).when(facet == "requirement", L.requirement_rank(v))
            .when(facet == "year", -F.substring(v, 1, 4).cast("int")).otherwise(0))
    folded = F.when(facet == "instructor", F.lower(v)).otherwise(v)
    keyed = values.withColumns({"_r": rank, "_f": folded})
    return ranked(keyed, [c("_r"), c("_f"), v.asc()], by=["facet"]).select("facet", "value", "pos")


def facet_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plain counts per value of each column: one pass over one expanded stream."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), c(n).cast("string").alias("value")) for n in columns])
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_counts_excluding(df: DataFrame, spec: FilterSpec, columns: Mapping[str, str]) -> DataFrame:
    """Counts per value under the OTHER facets only.

    ``columns`` maps a facet of the spec to its column.  Rows that fail two of
    the counted facets count nowhere and are dropped before the shuffle.
    """
    facets = {n: F.coalesce(p, F.lit(False)) for n, p in spec.facets().items()}
    rest = [p for n, p in facets.items() if n not in columns]
    base = reduce(lambda a, b: a & b, rest, F.lit(True))

    def others(name: str) -> Column:
        return reduce(lambda a, b: a & b, [facets[n] for n in columns if n != name], F.lit(True))

    pairs = F.filter(F.array(*[
        F.when(others(n), F.struct(F.lit(n).alias("facet"), c(col).alias("value"))) for n, col in columns.items()]),
        lambda x: x.isNotNull())
    return df.filter(base).select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def coverage_rules() -> dict[str, Column]:
    """What counts as present, per field."""
    return {
        "section_number": c("section_number") != "", "description": c("description") != "",
        "component": c("component") != "", "campus": (c("campus") != "") & (c("campus") != "Unknown"),
        "location": c("location") != "", "instructor": c("instructor") != "", "meetings": F.size("meetings") > 0,
        "timed_meetings": F.exists("meetings", lambda m: m["start_min"].isNotNull() & m["end_min"].isNotNull()),
        "seat_capacity": c("seat_capacity").isNotNull(), "seats_available": c("seats_available").isNotNull(),
        "class_difficulty": c("class_difficulty").isNotNull(), "crse_id": c("crse_id").isNotNull(),
        "units_min": c("units_min").isNotNull(), "option_number": c("option_number").isNotNull(),
        "metrics": c("metrics").isNotNull(), "source_url": c("source_url") != "",
    }


def field_coverage(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """total, present, missing, percent per field: one aggregate, then unpivoted."""
    rules = rules or coverage_rules()
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(rule, F.lit(False))).alias(name)
                                                     for name, rule in rules.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("field"), c(n).alias("present")) for n in rules])
    percent = F.when(c("total") == 0, 100.0).otherwise(F.round(c("present") / c("total") * 100, 2))
    return one.select("total", F.inline(cells)).select(
        "field", "total", "present", (c("total") - c("present")).alias("missing"), percent.alias("percent"))


def coverage_examples(df: DataFrame, rules: Mapping[str, Column] | None = None, n: int = 10) -> DataFrame:
    """First ``n`` distinct examples of rows that lack a field, in text order."""
    rules = rules or coverage_rules()
    example = F.concat(c("course_code"), F.lit(" / "), c("schedule_number"))
    lacking = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]),
                       lambda x: x.isNotNull())
    rows = df.select(example.alias("example"), F.explode(lacking).alias("field")).distinct()
    return top_per_key(rows, ["field"], [c("example")], n).select("field", "example", "rank")


def completeness(df: DataFrame) -> DataFrame:
    """Physical classes with no instructor, location or meeting on any listing."""
    place = (F.coalesce(F.trim("location"), F.lit("")) != "") | F.exists(
        "meetings", lambda m: F.coalesce(F.trim(m["location"]), F.lit("")) != "")
    per = df.groupBy(K.physical_key(c("term"), c("term_code"), c("schedule_number")).alias("physical")).agg(
        F.bool_or(~T.is_placeholder(c("instructor"))).alias("i"), F.bool_or(place).alias("l"),
        F.bool_or(F.size("meetings") > 0).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("physical"), F.count_if(~c("i")).alias("missing_instructor"),
                   F.count_if(~c("l")).alias("missing_location"), F.count_if(~c("m")).alias("missing_meetings"))


def representative(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; ties by lower case, then by value.  ``n_values`` > 1 is a conflict."""
    counts = (df.select(key, F.trim(value).alias("v")).filter(c("v") != "").groupBy(key, "v")
              .agg(F.count(F.lit(1)).alias("n")))
    best = F.min(F.struct((-c("n")).alias("n"), F.lower("v").alias("f"), c("v")))
    return counts.groupBy(key).agg(best.alias("b"), F.count(F.lit(1)).alias("n_values")).select(
        key, c("b.v").alias(value), (-c("b.n")).alias("n_top"), "n_values")


def course_rollup(rows: DataFrame) -> DataFrame:
    """Per course code: representative texts, label sets, option count, units.

    The representative of each text comes from one count per (code, field,
    value), so the rows are shuffled once for all fields.  ``prerequisite_text``
    and ``enrollment_requirements`` (an array) may be missing from ``rows``.
    """
    if "prerequisite_text" not in rows.columns:
        rows = rows.withColumn("prerequisite_text", F.lit(None).cast("string"))
    if "enrollment_requirements" not in rows.columns:
        rows = rows.withColumn("enrollment_requirements", F.array().cast("array<string>"))
    code = T.norm_code(c("course_code"))
    fields = {"subject": T.norm_code(c("subject")), "title": F.trim("title"), "description": F.trim("description"),
              "prerequisite_text": F.trim("prerequisite_text")}
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("f"), e.alias("v")) for n, e in fields.items()]),
                     lambda x: F.coalesce(x["v"], F.lit("")) != "")
    counts = rows.select(code.alias("code"), F.inline(pairs)).groupBy("code", "f", "v").agg(F.count(F.lit(1)).alias("n"))
    best = F.struct((-c("n")).alias("n"), F.lower("v").alias("l"), c("v"))
    texts = counts.groupBy("code").agg(*[F.min(F.when(c("f") == n, best))["v"].alias(n) for n in fields],
                                       F.count_if(c("f") == "title").alias("n_titles"))
    low, high = F.coalesce("units_min", "units"), F.coalesce("units_max", "units")
    one_text = F.when(F.min(F.trim("units_text")) == F.max(F.trim("units_text")), F.min(F.trim("units_text")))
    facts = rows.groupBy(code.alias("code")).agg(
        F.count(F.lit(1)).alias("option_count"),
        F.array_join(F.array_sort(F.collect_set(T.canonical_label(c("campus")))), ", ").alias("campuses"),
        F.array_join(F.array_sort(F.collect_set(L.label_of(c("instruction_mode"), L.MODE_LABELS))), ", ").alias("modes"),
        F.coalesce(one_text, L.units_label(F.min(low), F.max(high))).alias("units_text"))
    needed = rows.select(code.alias("code"), F.explode("enrollment_requirements").alias("r")).select("code", F.trim("r").alias("r"))
    needed = needed.filter(c("r") != "").distinct().groupBy("code").agg(F.array_sort(F.collect_list("r")).alias("_r"))
    none = F.array().cast("array<string>")
    return facts.join(texts, "code").join(needed, "code", "left").withColumn("enrollment_requirements", F.coalesce("_r", none)) \
        .drop("_r").withColumn("slug", T.slug(c("code")))


def subject_rollup(courses: DataFrame) -> DataFrame:
    return courses.groupBy("subject").agg(F.count(F.lit(1)).alias("courses"), F.sum("option_count").alias("options")) \
        .withColumn("slug", T.slug(c("subject")))


FIXED_PAGES = ("/", "/privacy", "/terms", "/subjects")


def sitemap_rows(courses: DataFrame) -> DataFrame:
    """One path per fixed page, subject and course."""
    subjects = courses.select(F.concat(F.lit("/subjects/"), T.slug(c("subject"))).alias("path"))
    pages = courses.select(F.concat(F.lit("/courses/"), c("slug")).alias("path"))
    fixed = courses.sparkSession.createDataFrame([(p,) for p in FIXED_PAGES], "path string")
    return fixed.union(subjects).union(pages).distinct()


def instructor_codes(df: DataFrame) -> DataFrame:
    """(person, name, course code) for every real name; the long form of the inventory."""
    real = df.filter(~T.is_placeholder(c("instructor")))
    return real.groupBy(T.person_key(c("instructor")).alias("person"), T.norm_code(c("course_code")).alias("code")).agg(
        F.min(F.struct("listing_id", T.display_name(c("instructor")).alias("name"))).alias("first"),
        F.bool_or(c("metrics").isNotNull()).alias("matched")).filter(c("person") != "")


def instructor_inventory(df: DataFrame) -> DataFrame:
    return instructor_codes(df).groupBy("person").agg(
        F.min("first")["name"].alias("name"), F.count(F.lit(1)).alias("n_codes"),
        F.bool_or("matched").alias("matched"))


def match_rate(inventory: DataFrame) -> DataFrame:
    hit = F.count_if("matched")
    n = F.count(F.lit(1))
    return inventory.agg(n.alias("instructors"), hit.alias("matched"), (n - hit).alias("unmatched"),
                         F.coalesce(F.round(hit / n * 100, 1), F.lit(0.0)).alias("rate"))


def cross_listed(df: DataFrame) -> DataFrame:
    """Physical classes under more than one code, as (physical, code) rows plus the count.

    Long form: a class may carry any number of codes.
    """
    pairs = df.select(K.physical_key(c("term"), c("term_code"), c("schedule_number")).alias("physical"),
                      T.norm_code(c("course_code")).alias("code")).distinct()
    many = pairs.groupBy("physical").agg(F.count(F.lit(1)).alias("n_codes")).filter("n_codes > 1")
    return pairs.join(many, "physical")


def merge_requirements(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same (year, code, name) over pages: (heads with the first URL, distinct codes)."""
    key = ["year", "code", "name"]
    heads = df.groupBy(*key).agg(F.min_by("url", "seq").alias("url"), F.count_distinct("course_code").alias("n_codes"))
    return heads, df.select(*key, "course_code").distinct()


def source_registry(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per source URL, one row per URL and schedule number)."""
    whole = (c("crse_id").isNotNull() & c("offer").isNotNull() & (c("term_code") != "") & c("career").isNotNull())
    key = K.term_id(c("term"), c("term_code"))
    slots = df.groupBy("source_url", "schedule_number").agg(F.min_by(key, "listing_id").alias("term_key"))
    ids = F.struct("listing_id", "crse_id", "offer", "term_code", "career", "schedule_number", "subject", "term")
    sources = df.groupBy("source_url").agg(F.count_distinct("course_code").alias("n_codes"),
                                           F.min(F.when(whole, ids)).alias("r"))
    n = slots.groupBy("source_url").agg(F.count(F.lit(1)).alias("n_classes"))
    return (sources.join(n, "source_url").select(
        "source_url", "n_codes", "n_classes", c("r.listing_id").alias("recovery_listing"),
        c("r.crse_id").alias("recovery_crse_id"), c("r.subject").alias("recovery_subject"),
        c("r.term").alias("recovery_term")), slots)


def freshness_by_term(listings: DataFrame, records: DataFrame, now: Column, stale_after: int = 1800) -> DataFrame:
    """Fresh, stale, pending and uncached physical classes per term."""
    keys = listings.groupBy("physical").agg(F.min("term").alias("term"))
    seen = records.select("physical", F.lit(True).alias("_c"), c("ts").alias("_ts"))
    age = F.greatest(now.cast("double") - c("_ts").cast("double"), F.lit(0.0))
    out = keys.join(seen, "physical", "left").groupBy("term").agg(
        F.count(F.lit(1)).alias("total"), F.count("_c").alias("cached"),
        F.count_if(c("_c") & (age <= stale_after)).alias("fresh"),
        F.count_if(c("_c") & (age > stale_after)).alias("stale"),
        F.count_if(c("_c") & c("_ts").isNull()).alias("pending"))
    return out.withColumn("uncached", c("total") - c("cached")).withColumn(
        "percent", F.round(c("fresh") / c("total") * 100, 1))


def placeholder_targets(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Physical classes with a placeholder name, the refreshable ones, and their pages."""
    live = sources.select(c("source_url").alias("_s")).distinct()
    rows = df.filter(T.is_placeholder(c("instructor"))).join(live, c("source_url") == c("_s"), "left")
    return rows.agg(F.count_distinct("physical").alias("classes"),
                    F.count_distinct(F.when(c("_s").isNotNull(), c("physical"))).alias("refreshable"),
                    F.count_distinct("_s").alias("pages"))


def term_counts(df: DataFrame, previous: DataFrame) -> DataFrame:
    """Listings and physical classes per term, and the change against the previous table."""
    now = df.groupBy("term").agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("physical").alias("physical"))
    old = previous.groupBy("term").agg(F.count(F.lit(1)).alias("previous"))
    return now.join(old, "term", "left").withColumn("change", c("listings") - c("previous"))


def set_changes(now: DataFrame, before: DataFrame, column: str) -> DataFrame:
    """Values added and removed, by two anti joins."""
    a, b = now.select(column).distinct(), before.select(column).distinct()
    return (a.join(b, column, "left_anti").select(c(column).alias("value"), F.lit("added").alias("change"))
            .union(b.join(a, column, "left_anti").select(column, F.lit("removed"))))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Listing ids, and (term, code, schedule) triples, that occur twice."""
    def dup(name: str, key: Column) -> DataFrame:
        return (df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select(F.lit(name).alias("kind"), "key", "n"))

    return dup("listing_id", c("listing_id")).unionByName(
        dup("term_code_schedule", F.concat_ws("|", "term", "course_code", "schedule_number")))


def subject_inventory(seed: DataFrame, seen: DataFrame) -> DataFrame:
    """Seed and discovered subjects: flags, and the order to work in (seed first)."""
    s = seed.select("subject", c("pos").alias("seed_pos"), F.lit(True).alias("in_seed"))
    d = seen.select("subject", F.lit(True).alias("seen")).distinct()
    both = s.join(d, "subject", "full_outer").select(
        "subject", F.coalesce("in_seed", F.lit(False)).alias("in_seed"), F.coalesce("seen", F.lit(False)).alias("seen"),
        "seed_pos")
    return ranked(both, [c("seed_pos").asc_nulls_last(), c("subject").asc()]).select(
        "subject", (c("seen") & ~c("in_seed")).alias("is_new"), (c("in_seed") & ~c("seen")).alias("not_seen"), "pos")


# Public codes of failed resources; the first rule that a path meets decides.  (how, texts, code)
PUBLIC_CODES = (
    ("starts", ("/api/seats", "/api/admin/seats"), "seat_data_unavailable"),
    ("holds", ("ratings", "professor"), "professor_ratings_unavailable"),
    ("starts", ("/api/catalog", "/api/profile"), "catalog_data_unavailable"),
    ("starts", ("/api/classes",), "class_results_unavailable"),
    ("starts", ("/api/options",), "filter_options_unavailable"),
    ("starts", ("/api/admin",), "admin_data_unavailable"),
)


def public_code(path: Column) -> Column:
    """Stable code of a failed resource."""
    low = F.lower(F.coalesce(path, F.lit("")))
    out = F.lit("service_unavailable")
    for how, texts, code in reversed(PUBLIC_CODES):
        met = F.lit(False)
        for text in texts:
            met = met | (F.startswith(low, F.lit(text)) if how == "starts" else F.contains(low, F.lit(text)))
        out = F.when(met, code).otherwise(out)
    return out


def error_rollup(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Occurrences, first and last time per error key; newest first, all of them.

    A key with ``path`` gets its ``public_code``.
    """
    rows = _error_rollup(events, key)
    return rows.withColumn("public_code", public_code(c("path"))) if "path" in key else rows


def _error_rollup(events: DataFrame, key: Sequence[str]) -> DataFrame:
    return (events.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"), F.min("ts").alias("first_at"),
                                     F.max("ts").alias("last_at"))
            .orderBy(c("last_at").desc(), *[c(k).asc() for k in key]))


def latency_stats(df: DataFrame, column: str, key: str, slow: float) -> DataFrame:
    """Count, total, median, nearest-rank p95 and max.

    Exact quantiles are read off whole-table positions; ``percentile`` would
    keep every distinct value of the table in one task.
    """
    placed = ranked(df.filter(c(column).isNotNull()).select(key, c(column).alias("x")), [c("x").asc(), c(key).asc()])
    n = placed.agg(F.count(F.lit(1))).scalar()
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    return placed.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("total"),
        F.round(F.avg(F.when((c("pos") == low) | (c("pos") == high), c("x"))), 4).alias("median"),
        F.max(F.when(c("pos") == F.ceil(n * 95 / 100), c("x"))).alias("p95"), F.max("x").alias("max"),
        (F.max("x") >= slow).alias("has_slow"))


def rescrape_targets(listings: DataFrame, class_signals: DataFrame, source_signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals per offering: (heads with the sorted signal set, class rows).

    ``class_signals``: physical, signal; ``source_signals``: source_url.  Signal
    names come from a fixed list, so the set per offering is small.
    """
    own = class_signals.groupBy("physical").agg(F.collect_set("signal").alias("_s"))
    new = source_signals.select("source_url", F.lit(True).alias("_new")).distinct()
    detail = K.detail_key(c("subject"), c("crse_id"), c("course_code"), c("offer"), c("career"))
    rows = (listings.withColumn("course_key", detail).join(own, "physical", "left").join(new, "source_url", "left")
            .filter(c("_s").isNotNull() | c("_new")))
    none = F.slice(F.array(F.lit("")), 1, 0)
    names = F.explode(F.concat(F.coalesce("_s", none),
                               F.when(c("_new"), F.array(F.lit("new_class_number"))).otherwise(none)))
    key = ["term", "course_code", "course_key"]
    heads = rows.select(*key, names.alias("signal")).groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))
    classes = rows.filter(c("_s").isNotNull()).select(*key, "schedule_number").distinct()
    return heads, classes


def removal_candidates(listings: DataFrame, seats: DataFrame, failed_pages: DataFrame, missing: DataFrame, now: Column,
                       stale_hours: int = 48) -> DataFrame:
    """Physical classes that are stale or carry a signal, most urgent first.

    Ages are hours since the newest seat time.  A cut for a report belongs to ``page``.
    """
    bad = failed_pages.select("source_url", F.lit(True).alias("_f")).distinct()
    per = (listings.join(bad, "source_url", "left").groupBy("physical").agg(
        F.min("course_code").alias("course_code"), F.coalesce(F.bool_or("_f"), F.lit(False)).alias("failed"),
        (F.count_distinct("course_code", F.coalesce("crse_id", F.lit(""))) > 1).alias("crosslisted")))
    age = F.round((now.cast("double") - c("ts").cast("double")) / 3600, 1)
    rows = (per.join(seats.select("physical", "ts"), "physical", "left")
            .join(missing.select("physical", F.lit(True).alias("_m")).distinct(), "physical", "left")
            .withColumn("age_hours", F.greatest(age, F.lit(0.0)))
            .withColumn("missing", F.coalesce("_m", F.lit(False))))
    kept = rows.filter((c("age_hours") >= stale_hours) | c("failed") | c("missing"))
    signal = c("failed") | c("missing")
    return (kept.withColumn("status", F.when(signal, "suspected").otherwise("stale"))
            .orderBy(c("missing").desc(), signal.desc(), F.coalesce("age_hours", F.lit(0.0)).desc(), "course_code",
                     "physical")
            .select("physical", "course_code", "age_hours", "failed", "missing", "crosslisted", "status"))


