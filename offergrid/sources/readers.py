"""Readers: nested listings, schedule exports, snapshot folders, overlay documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offergrid.functions.text import is_placeholder
from offergrid.operators import overlays
from offergrid.operators.options import physical
from offergrid.operators.rollups import duplicate_keys

c = F.col

LISTING_DDL = (
    "listing_id STRING, term STRING, term_code STRING, course_code STRING, subject STRING, catalog_number STRING, "
    "section_number STRING, schedule_number STRING, option_number INT, source_key STRING, group_indices ARRAY<INT>, "
    "primary_group_indices ARRAY<INT>, group_ids ARRAY<STRING>, primary_group_ids ARRAY<STRING>, crse_id STRING, "
    "offer STRING, career STRING, component STRING, title STRING, description STRING, units DOUBLE, units_min DOUBLE, "
    "units_max DOUBLE, units_text STRING, class_difficulty DOUBLE, grading STRING, requirement_tags ARRAY<STRING>, "
    "program_tags ARRAY<STRUCT<program: STRING, year: STRING, classification: STRING>>, instruction_mode STRING, "
    "seat_status STRING, seats_available INT, seat_capacity INT, campus STRING, location STRING, instructor STRING, "
    "meetings ARRAY<STRUCT<days: ARRAY<STRING>, start_min: INT, end_min: INT, location: STRING, date_from: DATE, "
    "date_to: DATE>>, metrics STRUCT<rating: DOUBLE, difficulty: DOUBLE, again: DOUBLE, reviews: INT, "
    "attendance: BOOLEAN, textbook: BOOLEAN>, source_url STRING")


def listing_schema() -> T.StructType:
    return T.StructType.fromDDL(LISTING_DDL)


REQUIRED = ("listing_id", "term", "course_code", "subject", "schedule_number")


class Loaded(NamedTuple):
    rows: DataFrame
    rejected: DataFrame
    load_errors: DataFrame


def read_listings(spark: SparkSession, path: str, form: str = "json", whole_file: bool = False,
                  overlays: dict[str, str] | None = None) -> Loaded:
    """Nested listings with a fixed schema; rows that do not fit are set apart.

    ``form`` is ``json`` (one record per line, so files split; ``whole_file``
    for one JSON array) or ``parquet``.  ``overlays`` (kind: path) are laid over the
    rows that fit (``lay_over``).  One that can not be read, or holds documents
    that do not parse, leaves its error text, and the rows as they are.
    """
    if form == "parquet":
        raw = spark.read.schema(listing_schema()).parquet(path).withColumn("_bad", F.lit(None).cast("string"))
    else:
        schema = T.StructType([*listing_schema().fields, T.StructField("_bad", T.StringType())])
        raw = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad",
                                             multiLine=whole_file, dateFormat="yyyy-MM-dd")
    blank = F.lit(False)
    for name in REQUIRED:
        blank = blank | (F.coalesce(F.trim(name), F.lit("")) == "")
    marked = raw.withColumn("_reason", F.when(c("_bad").isNotNull(), "unreadable").when(blank, "required_value_missing"))
    errors, sides = [], {}
    for kind, where in (overlays or {}).items():
        try:
            side = read_overlay(spark, kind, where)
            if lost := unread_documents(spark, kind, where):
                errors.append((kind, "Unreadable", f"{lost} documents do not parse"))
            else:
                sides[kind] = side
        except Exception as exc:  # noqa: BLE001 - overlays are optional, their errors are reported
            errors.append((kind, type(exc).__name__, str(exc).splitlines()[0]))
    return Loaded(lay_over(marked.filter("_reason IS NULL").drop("_bad", "_reason"), sides),
                  marked.filter("_reason IS NOT NULL").select(
                      c("_reason").alias("reason"), F.coalesce("_bad", "listing_id").alias("record")),
                  spark.createDataFrame(errors, "overlay string, error string, message string"))


def lay_over(rows: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """Listings with their side tables applied: names, then ratings of these names, seats, requirement and program tags; hidden classes go.

    Columns stay those of the listings.  A program overlay has course_code, program, year, classification.
    """
    names, out = rows.columns, physical(rows)
    if "instructor" in sides:
        cache = sides["instructor"].groupBy("physical").agg(F.max_by("instructor", F.struct("updated_at", "instructor")).alias("person"))
        # a real name stays, so only rows without one meet the names; the rows come from files and are cheap to read twice
        nobody = F.coalesce(is_placeholder(c("instructor")), F.lit(True))
        out = overlays.overlay_instructors(out.filter(nobody), cache).select(*out.columns).unionByName(out.filter(~nobody))
    if "ratings" in sides:
        known = F.col("metrics")
        shaped = sides["ratings"].withColumn("metrics", F.when(known.isNotNull(), F.struct(
            *[known[n].alias(n) for n in ("rating", "difficulty", "again", "reviews")],
            *[F.lit(None).cast("boolean").alias(n) for n in ("attendance", "textbook")])))
        out = overlays.overlay_metrics(out, shaped).drop("changed")
    if "seat" in sides:
        newest = overlays.newest(sides["seat"].withColumn("_o", F.struct("updated_at", "seat_status")), "physical", ["_o"])
        out = overlays.overlay_seats(out, newest.select("physical", *overlays.SEAT_COLUMNS))
    if "requirement" in sides or "program" in sides:
        spark = rows.sparkSession
        out = overlays.overlay_tags(
            out, sides.get("program", spark.createDataFrame([], "course_code string, program string, year string, classification string")),
            sides.get("requirement", spark.createDataFrame([], "course_code string, label string")))
    if "hidden" in sides:
        out = out.join(sides["hidden"].select("physical"), "physical", "left_anti")
    return out.select(*names)


# Header spellings of schedule exports.
HEADER_ALIASES = {
    "class_number": ("class nbr", "class number", "class no", "class #"),
    "subject": ("subject", "subject code"),
    "catalog_number": ("catalog nbr", "catalog number", "course number"),
    "title": ("title", "course title", "class title"),
    "description": ("description", "course description", "catalog description"),
    "section_number": ("class section", "section", "section number"),
    "units": ("component units", "units", "minimum units", "unit"),
    "facility": ("facility id", "facility", "room", "location"),
    "meeting_start": ("meeting start", "start time", "meeting start time"),
    "meeting_end": ("meeting end", "end time", "meeting end time"),
    "meeting_pattern": ("standard meeting pattern", "meeting pattern", "days", "meeting days"),
    "last_name": ("last name", "instructor last name"),
    "initials": ("initials", "instructor initials"),
    "instructor": ("instructor", "instructor name", "faculty"),
    "class_status": ("class status", "status", "seat status"),
    "instruction_mode": ("instruction mode", "mode", "instruction format"),
    "campus": ("campus", "campus description", "location campus"),
    "grading": ("grading", "grading basis", "grading scheme"),
    "seat_capacity": ("enrollment capacity", "seat capacity", "class capacity", "capacity"),
    "seats_enrolled": ("enrollment total", "total enrollment", "seats enrolled", "enrolled seats", "current enrollment"),
    "seats_available": ("seats available", "available seats", "open seats"),
    "waitlist_available": ("waitlist available", "available waitlist seats", "wait list available"),
}
EXPORT_REQUIRED = ("class_number", "subject", "catalog_number", "title", "section_number", "units")


def _bare(name: str) -> str:
    return "".join(ch for ch in name.lower().lstrip("﻿") if ch.isascii() and ch.isalnum())


def resolve_headers(names: list[str]) -> dict[str, str]:
    """Canonical column to header; fails when a required one is missing."""
    by_bare = {_bare(n): n for n in names if n}
    found = {}
    for column, spellings in HEADER_ALIASES.items():
        hit = next((by_bare[_bare(s)] for s in spellings if _bare(s) in by_bare), None)
        if hit is not None:
            found[column] = hit
    missing = [n for n in EXPORT_REQUIRED if n not in found]
    if missing:
        raise ValueError(f"missing required columns {missing}; headers are {names}")
    return found


def read_schedule_csv(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Export rows as trimmed text under canonical names; blank rows are dropped."""
    if not term.strip():
        raise ValueError("term cannot be blank")
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", quote='"', escape='"')
    found = resolve_headers(raw.columns)
    cells = F.array(*[F.trim(F.coalesce(c(f"`{n}`"), F.lit(""))) for n in raw.columns])
    return (raw.filter(F.exists(cells, lambda x: x != ""))
            .select(F.lit(term.strip()).alias("term"),
                    *[F.trim(F.coalesce(c(f"`{found[n]}`"), F.lit(""))).alias(n) for n in HEADER_ALIASES if n in found]))


def read_snapshot_dir(spark: SparkSession, path: str, expected: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records with the subject their file name stands for, problems).

    One file or folder per subject, ``subject=<name>/…``.
    """
    record = F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    name = F.url_decode(F.url_decode(F.regexp_extract(c("_metadata.file_path"), "subject=([^/]+)/", 1)))
    named = spark.read.option("recursiveFileLookup", True).text(path).select(record.alias("r"), name.alias("file_subject")) \
        .select("r.*", "file_subject")
    bad = named.filter("_bad IS NOT NULL").select("file_subject").distinct().withColumn("problem", F.lit("unreadable"))
    good = named.filter("_bad IS NULL").drop("_bad")
    missing = expected.select(c("subject").alias("file_subject")).join(named.select("file_subject").distinct(),
                                                                       "file_subject", "left_anti") \
        .withColumn("problem", F.lit("missing"))
    other = good.filter(~c("subject").eqNullSafe(c("file_subject"))).select("file_subject").distinct() \
        .withColumn("problem", F.lit("name_mismatch"))
    return good, missing.unionByName(bad).unionByName(other)


OVERLAY_TYPES = {
    "seat": ("sections", "MAP<STRING, STRUCT<seat_status: STRING, seats_available: INT, seat_capacity: INT, "
                         "updated_at: TIMESTAMP, source_url: STRING>>", "empty"),
    "instructor": ("sections", "MAP<STRING, STRUCT<instructor: STRING, updated_at: TIMESTAMP, source_url: STRING>>", "empty"),
    "hidden": ("records", "MAP<STRING, STRUCT<course_code: STRING, crse_id: STRING, section_ids: ARRAY<STRING>, "
                          "hidden_at: TIMESTAMP>>", "error"),
    "ratings": ("records", "ARRAY<STRUCT<name: STRING, metrics: STRUCT<rating: DOUBLE, difficulty: DOUBLE, again: DOUBLE, "
                           "reviews: INT>>>", "any"),
    "requirement": ("requirements", "MAP<STRING, ARRAY<STRING>>", "any"),
    "program": ("programs", "ARRAY<STRUCT<name: STRING, catalog_year: STRING, "
                            "mappings: ARRAY<STRUCT<course_code: STRING, classification: STRING>>>>", "any"),
}
OVERLAY_VERSION = 1


def read_overlay(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Side table of one kind from JSON documents, one per line.

    A document of another ``schema_version`` counts as empty (seat, instructor)
    or is an error (hidden).  Ratings come as an object or as a plain list.
    """
    field, inner, on_version = OVERLAY_TYPES[kind]
    text = spark.read.text(path)
    plain = F.startswith(F.trim("value"), F.lit("["))
    whole = F.from_json("value", f"STRUCT<schema_version: INT, {field}: {inner}>")
    docs = text.select(whole.alias("d"), F.when(plain, F.from_json("value", inner)).alias("bare")) if kind == "ratings" \
        else text.select(whole.alias("d"))
    if on_version == "error":
        wrong = docs.filter(~c("d.schema_version").eqNullSafe(F.lit(OVERLAY_VERSION))).limit(1).count()
        if wrong:
            raise ValueError(f"{kind} overlay has an unsupported schema_version")
    elif on_version == "empty":
        docs = docs.filter(c("d.schema_version") == OVERLAY_VERSION)
    if kind == "ratings":
        return docs.select(F.explode(F.coalesce(c(f"d.{field}"), c("bare"))).alias("r")).select("r.name", "r.metrics")
    if kind == "program":
        return docs.select(F.explode(c(f"d.{field}")).alias("p")).select("p", F.explode("p.mappings").alias("m")).select(
            "m.course_code", c("p.name").alias("program"), c("p.catalog_year").alias("year"), "m.classification")
    if kind == "requirement":
        return docs.select(F.explode(c(f"d.{field}")).alias("label", "codes")).select(
            "label", F.explode("codes").alias("course_code"))
    return docs.select(F.explode(c(f"d.{field}")).alias("physical", "r")).select("physical", "r.*")


def unread_documents(spark: SparkSession, kind: str, path: str) -> int:
    """Documents of an overlay that are no JSON, or whose ``kind`` field has another shape."""
    field, inner, _ = OVERLAY_TYPES[kind]
    text = spark.read.text(path).filter(F.trim("value") != "")
    shaped = F.from_json("value", f"STRUCT<{field}: {inner}>")[field]
    if kind == "ratings":
        shaped = F.coalesce(shaped, F.when(F.startswith(F.trim("value"), F.lit("[")), F.from_json("value", inner)))
    misshapen = shaped.isNull() & (F.contains("value", F.lit(f'"{field}"')) | F.startswith(F.trim("value"), F.lit("[")))
    return text.filter(F.try_parse_json("value").isNull() | misshapen).count()


def reject_duplicates(rows: DataFrame) -> DataFrame:
    """Duplicate ids and listings of a loaded table."""
    return duplicate_keys(rows)
