"""Program and requirement tables: summaries, lists, student progress."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.functions.text import norm_code
from offergrid.operators.search import page

c = F.col
KEY = ("program", "year")


def _codes(prog: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Distinct (program, class, code) rows with ``scheduled``."""
    here = scheduled.select(norm_code(c("course_code")).alias("code"), F.lit(True).alias("_s")).distinct()
    rows = prog.select(*KEY, "classification", norm_code(c("course_code")).alias("code")).distinct()
    return rows.join(here, "code", "left").withColumn("scheduled", c("_s").isNotNull()).drop("_s")


def list_programs(programs: DataFrame, year: str | None = None, name_part: str | None = None, degree: str | None = None,
                  number: int = 1, size: int = 20) -> DataFrame:
    """One page of programs (name, year, degree) that meet the given parts, by name and year."""
    wanted = programs
    if year is not None:
        wanted = wanted.filter(F.col("year") == year)
    if name_part:
        wanted = wanted.filter(F.contains(F.lower("name"), F.lit(name_part.strip().lower())))
    if degree is not None:
        wanted = wanted.filter(F.lower("degree") == degree.strip().lower())
    return page(wanted, [F.lower("name").asc(), F.col("year").asc(), F.col("degree").asc()], number, size, largest=100)


def program_summary(prog: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Distinct mapped codes, all and per class, and how many are scheduled."""
    per_code = _codes(prog, scheduled).groupBy(*KEY, "code").agg(
        *[F.bool_or(c("classification") == k).alias(k) for k in ("major_prep", "major_course", "elective")],
        F.bool_or("scheduled").alias("scheduled"))
    return per_code.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("mapped"), F.count_if("major_prep").alias("major_prep"),
        F.count_if("major_course").alias("major_course"), F.count_if("elective").alias("elective"),
        F.count_if("scheduled").alias("scheduled"))


def program_detail(prog: DataFrame) -> DataFrame:
    """One row per program, class, group and code, with class order and the first note."""
    order = F.when(c("classification") == "major_prep", 0).when(c("classification") == "major_course", 1) \
        .when(c("classification") == "elective", 2).otherwise(99)
    group = F.trim(F.coalesce("group_name", "classification"))
    return prog.groupBy(*KEY, "classification", group.alias("group_name"), norm_code(c("course_code")).alias("code")) \
        .agg(F.min(F.when(F.trim("note") != "", F.trim("note"))).alias("note"), F.count_distinct("note").alias("notes")) \
        .withColumn("class_order", order)


def requirement_list(reqs: DataFrame) -> DataFrame:
    return reqs.filter(c("label").isNotNull()).groupBy("label", "year").agg(
        F.count_distinct(norm_code(c("course_code"))).alias("courses"))


def profile_progress(prog: DataFrame, scheduled: DataFrame, completed: DataFrame,
                     slots: Mapping[str, int]) -> DataFrame:
    """Progress of every (student, program) pair the ``completed`` table names.

    ``completed``: student, program, year, course_code.  ``slots`` limits how
    many electives of a group count.  Only the student's own codes are joined:
    what a program asks for in total is worked out once per program.
    """
    rows = _codes(prog.withColumn("course_code", norm_code(c("course_code"))), scheduled)
    fixed = rows.filter("classification <> 'elective'").select(*KEY, "code").distinct().withColumn("_f", F.lit(True))
    group = F.trim(F.coalesce("group_name", "classification"))
    elective = (prog.filter("classification = 'elective'")
                .select(*KEY, group.alias("grp"), norm_code(c("course_code")).alias("code")).distinct()
                .join(fixed, [*KEY, "code"], "left_anti"))
    slot_table = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]) if slots else None
    cap: Column = slot_table[c("grp")] if slots else F.lit(None).cast("int")
    choices = elective.groupBy(*KEY, "grp").agg(F.count(F.lit(1)).alias("choices")) \
        .withColumn("asked", F.least(cap, c("choices")))
    asked = choices.groupBy(*KEY).agg(F.sum("asked").alias("asked"))
    need = fixed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("fixed")).join(asked, list(KEY), "full_outer") \
        .select(*KEY, (F.coalesce("fixed", F.lit(0)) + F.coalesce("asked", F.lit(0))).alias("required"))
    codes = rows.groupBy(*KEY, "code").agg(F.bool_or("scheduled").alias("scheduled"))
    totals = codes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("mapped"), F.count_if("scheduled").alias("scheduled"))
    done = completed.select("student", *KEY, norm_code(c("course_code")).alias("code")).distinct()
    own = done.join(codes, [*KEY, "code"]).groupBy("student", *KEY).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if("scheduled").alias("done_scheduled"))
    core = done.join(fixed, [*KEY, "code"], "left_semi").groupBy("student", *KEY).agg(F.count(F.lit(1)).alias("n"))
    extra = (done.join(elective, [*KEY, "code"]).groupBy("student", *KEY, "grp").agg(F.count(F.lit(1)).alias("k"))
             .join(choices.select(*KEY, "grp", "asked"), [*KEY, "grp"])
             .groupBy("student", *KEY).agg(F.sum(F.least("k", "asked")).alias("n")))
    met = core.union(extra.select(core.columns)).groupBy("student", *KEY).agg(F.sum("n").alias("completed_required"))
    students = done.select("student", *KEY).distinct()
    zero = F.lit(0)
    return (students.join(totals, list(KEY)).join(need, list(KEY)).join(own, ["student", *KEY], "left")
            .join(met, ["student", *KEY], "left").select(
                "student", *KEY, "mapped", "scheduled", F.coalesce("completed", zero).alias("completed"), "required",
                F.coalesce("completed_required", zero).alias("completed_required"),
                (c("scheduled") - F.coalesce("done_scheduled", zero)).alias("remaining_scheduled")))


def program_list(programs: DataFrame, prog: DataFrame, **asked) -> DataFrame:
    """One page of ``list_programs`` with the distinct mapped codes of each item, all and per class.

    ``programs``: name, year, degree; ``prog``: program, year, classification, course_code.  The
    mappings of the programs on the page are counted, no others.
    """
    shown = list_programs(programs, **asked)
    codes = (prog.join(F.broadcast(shown.select(c("name").alias("program"), "year")), list(KEY), "left_semi")  # a page: 100 rows at most
             .select(*KEY, "classification", norm_code(c("course_code")).alias("code")).distinct())
    per_code = codes.groupBy(*KEY, "code").agg(*[F.bool_or(c("classification") == k).alias(k) for k in ("major_prep", "major_course", "elective")])
    counts = per_code.groupBy(c("program").alias("name"), "year").agg(
        F.count(F.lit(1)).alias("mapped"), *[F.count_if(k).alias(k) for k in ("major_prep", "major_course", "elective")])
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("mapped", "major_prep", "major_course", "elective")]
    return shown.join(counts, ["name", "year"], "left").select(*shown.columns, *zero)


def requirement_detail(reqs: DataFrame, label: str, year: str) -> DataFrame:
    """The distinct codes of one requirement, in order, with their number; no rows if it is not known."""
    mine = reqs.filter((c("year") == year) & (F.lower(F.trim("label")) == label.strip().lower()))
    codes = mine.select("label", "year", norm_code(c("course_code")).alias("code")).distinct()
    return codes.withColumn("courses", codes.agg(F.count(F.lit(1))).scalar()).orderBy("code")
