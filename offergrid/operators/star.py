"""Nested listings to normalised tables with hashed surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.functions.text import display_name, is_placeholder, person_key

c = F.col


def key_of(*cols: Column) -> Column:
    """128-bit text key: stable over runs, and no accident at any table size."""
    return F.md5(F.concat_ws("|", *cols))


def sync_tables(runs: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
    """Runs and their errors under one hashed run key.

    ``runs``: source_name, started_at and any columns of a run; ``errors``:
    source_name, started_at (of the run), term_name, subject, error_type, message,
    occurred_at.  Errors of a run that is not given are left out, as the key demands.
    """
    run = key_of(c("source_name"), c("started_at").cast("string")).alias("run_key")
    known = runs.select(run, "*").dropDuplicates(["run_key"])
    rows = errors.select(run, "term_name", "subject", "error_type", "message", "occurred_at")
    return {"sync_runs": known, "sync_errors": rows.join(known.select("run_key"), "run_key", "left_semi")}


# What the tables of the star read of a listing.
READ = ("listing_id", "term", "term_code", "subject", "catalog_number", "title", "section_number", "schedule_number", "component",
        "instruction_mode", "seat_status", "seat_capacity", "seats_available", "units", "class_difficulty", "instructor", "metrics",
        "meetings", "requirement_tags", "program_tags")


def normalise_to_star(listings: DataFrame) -> dict[str, DataFrame]:
    """The tables, as plans: callers that use several store the columns ``READ`` of the listings first.

    What is told apart by listing is dealt by listing before it is unfolded, so counts per section need no second shuffle.
    """
    term = key_of(F.coalesce(F.when(c("term_code") != "", c("term_code")), c("term")))
    course = key_of(c("subject"), c("catalog_number"))
    person = key_of(person_key(c("instructor")))
    named = listings.filter(~is_placeholder(c("instructor")))
    sections = listings.select(
        c("listing_id").alias("section_key"), term.alias("term_key"), course.alias("course_key"), "section_number",
        "schedule_number", "component", "instruction_mode", "seat_status", "seat_capacity", "seats_available",
        c("units").cast("decimal(4,1)").alias("units"), c("class_difficulty").cast("decimal(3,1)").alias("class_difficulty"))
    m = c("metrics")

    def by_section(df: DataFrame, *own: str) -> DataFrame:
        return df.select(c("listing_id").alias("section_key"), *own).repartition("section_key")

    return {
        "terms": listings.select(term.alias("term_key"), "term", "term_code").distinct(),
        "courses": listings.groupBy(course.alias("course_key"), "subject", "catalog_number").agg(
            F.min_by("title", "listing_id").alias("title")),
        "sections": sections,
        "meetings": listings.select(c("listing_id").alias("section_key"), F.posexplode("meetings").alias("place", "m"))
        .select("section_key", "place", F.explode("m.days").alias("day"), "m.start_min", "m.end_min", "m.location"),
        "instructors": named.groupBy(person.alias("instructor_key")).agg(
            F.min(display_name(c("instructor"))).alias("name")),
        "section_instructors": by_section(named, "instructor").select("section_key", person.alias("instructor_key")).distinct(),
        "instructor_metrics": named.filter(m.isNotNull()).groupBy(person.alias("instructor_key")).agg(
            F.min_by(m["rating"], "listing_id").cast("decimal(3,2)").alias("rating"),
            F.min_by(m["reviews"], "listing_id").alias("reviews")),
        "section_requirements": by_section(listings, "requirement_tags").select(
            "section_key", F.explode("requirement_tags").alias("label")).distinct(),
        "course_programs": listings.select(course.alias("course_key"), F.inline("program_tags")).distinct(),
        "course_metrics": listings.filter(c("class_difficulty").isNotNull()).groupBy(course.alias("course_key")).agg(
            F.min_by("class_difficulty", "listing_id").cast("decimal(3,2)").alias("class_difficulty")),
        "requirement_definitions": listings.select(F.explode("requirement_tags").alias("name")).distinct().select(
            key_of(c("name")).alias("requirement_key"), "name"),
    }
