"""Group A, H7: readers and sinks over tables written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.functions.parsing import clock_minutes, count_value, meeting_days, units_value
from offergrid.operators import options as O
from offergrid.operators import rollups as R
from offergrid.operators.star import READ, normalise_to_star
from offergrid.operators.options import physical
from offergrid.plans.registry import query
from offergrid.session import new_folder, settled
from offergrid.sources import readers as A
from offergrid.sources import sinks as W

c = F.col


@query("a1_read_listings", """
SELECT listing_id, 'ok' AS reason, term, course_code, coalesce(units_max, -1) AS units_max, seat_status,
 CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber = 2 THEN 2 ELSE 1 END::INT AS n_meetings, rating FROM lst WHERE p_size <> 50
UNION ALL SELECT listing_id, 'required_value_missing', NULL, NULL, NULL, NULL, NULL, NULL FROM lst WHERE p_size = 50
UNION ALL SELECT 'hidden', 'AnalysisException', NULL, NULL, NULL, NULL, NULL, NULL""")
def a1(v):
    """Listings written as JSON lines and read back; size 50 lost its subject; one overlay is missing."""
    path = new_folder(v.spark, "listings-json")
    v.listings().withColumn("subject", F.when(c("p_size") != 50, c("subject"))).select(*A.listing_schema().names).write.json(path, compression="gzip")
    got = A.read_listings(v.spark, path, overlays={"hidden": path + "-absent"})
    return (got.rows.select("listing_id", F.lit("ok").alias("reason"), "term", "course_code",
                            F.coalesce("units_max", F.lit(-1.0)).alias("units_max"), "seat_status",
                            F.size("meetings").alias("n_meetings"), c("metrics.rating").alias("rating"))
            .unionByName(got.rejected.select(c("record").alias("listing_id"), "reason"), allowMissingColumns=True)
            .unionByName(got.load_errors.select(c("overlay").alias("listing_id"), c("error").alias("reason")),
                         allowMissingColumns=True))


@query("a1_read_with_overlays", """
SELECT listing_id, CASE WHEN instructor IS NULL OR instructor = 'To Be Announced' THEN CASE WHEN l_suppkey % 4 = 3 THEN 'New Person' ELSE instructor END ELSE instructor END AS instructor,
 CASE WHEN instructor IS NOT NULL AND instructor <> 'To Be Announced' AND l_suppkey % 3 = 0 THEN l_suppkey % 5 + 0.5
  WHEN (instructor IS NULL OR instructor = 'To Be Announced') AND l_suppkey % 4 = 3 THEN NULL ELSE rating END AS rating,
 p_size % 2 = 0 AS tagged, p_size % 3 = 0 AS in_program FROM lst""")
def a1_overlays(v):
    """Names, ratings, requirement and program overlays applied on load; one that does not parse leaves the rows as they are."""
    path = new_folder(v.spark, "listings")
    v.listings().select(*A.listing_schema().names, "p_size", "l_suppkey").write.parquet(f"{path}/rows", compression="zstd")
    lst = physical(v.spark.read.parquet(f"{path}/rows"))  # the overlays are made from what was written

    def store(kind: str, docs):
        docs.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/{kind}", compression="gzip")
        return f"{path}/{kind}"

    said = F.struct(F.lit("New  Person").alias("instructor"))
    names = lst.filter("l_suppkey % 4 = 3").select("physical").distinct().select(
        F.lit(1).alias("schema_version"), F.create_map("physical", said).alias("sections"))
    rated = v.table("supplier").filter("s_suppkey % 3 = 0").select(F.array(F.struct(c("s_name").alias("name"), F.struct(
        (c("s_suppkey") % 5 + 0.5).alias("rating")).alias("metrics"))).alias("records"))
    codes = lst.select("course_code", "p_size").distinct()
    wanted = codes.filter("p_size % 2 = 0").select(F.create_map(F.lit("GWAR"), F.array("course_code")).alias("requirements"))
    mapped = codes.filter("p_size % 3 = 0").select(F.array(F.struct(F.lit("Art").alias("name"), F.lit("2027").alias("catalog_year"), F.array(F.struct(
        "course_code", F.lit("elective").alias("classification"))).alias("mappings"))).alias("programs"))
    where = {kind: store(kind, docs) for kind, docs in (("instructor", names), ("ratings", rated), ("requirement", wanted), ("program", mapped))}
    v.spark.createDataFrame([("{",)], "value string").write.text(f"{path}/seat")
    got = A.read_listings(v.spark, f"{path}/rows", "parquet", overlays={**where, "seat": f"{path}/seat"})
    return got.rows.select("listing_id", "instructor", c("metrics.rating").alias("rating"),
                           F.array_contains("requirement_tags", "GWAR").alias("tagged"),
                           F.exists("program_tags", lambda t: t["program"] == "Art").alias("in_program"))


@query("a1_read_listings_parquet", "SELECT term, count(*) AS n, count(*) FILTER (WHERE has_metrics) AS rated FROM lst GROUP BY 1")
def a1_parquet(v):
    path = new_folder(v.spark, "listings-parquet")
    v.listings().select(*A.listing_schema().names).write.partitionBy("term").parquet(path, compression="zstd")
    return A.read_listings(v.spark, path, form="parquet").rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.count("metrics").alias("rated"))


@query("a2_read_schedule_csv", """
SELECT listing_id AS class_number, subject, catalog_number, title, units, seat_capacity * 100 AS capacity,
 CASE WHEN l_linenumber < 6 THEN 480 + 30 * (l_partkey % 20) END::INT AS start_min,
 CASE WHEN l_linenumber = 7 THEN '' ELSE lower(strftime(l_shipdate, '%a')) END AS days FROM lst""")
def a2(v):
    """An export with other header spellings, padded cells and blank rows."""
    path = new_folder(v.spark, "schedule-csv")
    m = F.get("meetings", F.lit(0))
    clock = F.format_string("%02d:%02d", F.floor(m["start_min"] / 60).cast("int"), (m["start_min"] % 60).cast("int"))
    lst = v.listings("order", "part")
    rows = lst.select(
        c("listing_id").alias("Class Nbr"), F.concat(F.lit(" "), c("subject")).alias("SUBJECT CODE"),
        c("catalog_number").alias("Course-Number"), c("title").alias("Class Title"), c("section_number").alias("Section"),
        F.format_string("%.1f", "units").alias("Minimum Units"), F.format_string("%,d", c("seat_capacity") * 100).alias("Capacity"),
        F.when(m["start_min"].isNotNull(), clock).alias("Start Time"),
        F.upper(F.get(m["days"], F.lit(0))).alias("Meeting Days"))
    gap = lst.filter("l_linenumber = 3").select(*[F.lit("  ").alias(n) for n in rows.columns])
    rows.union(gap).write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    got = A.read_schedule_csv(v.spark, path, "Fall 1997")
    return got.select("class_number", "subject", "catalog_number", "title", units_value(c("units")).alias("units"),
                      count_value(c("seat_capacity")).alias("capacity"), clock_minutes(c("meeting_start")).alias("start_min"),
                      F.array_join(meeting_days(c("meeting_pattern")), ",").alias("days"))


@query("a3_read_snapshot_dir", """
SELECT p_brand AS file_subject, count(*) AS n, CASE WHEN p_brand = 'Brand#9' THEN 'name_mismatch' ELSE 'ok' END AS problem
FROM part WHERE p_brand <> 'Brand#5' GROUP BY ALL UNION ALL SELECT 'Brand#5', 0, 'missing' UNION ALL SELECT 'Brand#99', 0, 'missing'""")
def a3(v):
    """One folder per brand; one brand is not written, one folder holds another name."""
    path = new_folder(v.spark, "snapshot")
    part = v.table("part").filter("p_brand <> 'Brand#5'")
    rows = part.select(c("p_brand").alias("brand"), F.to_json(F.struct(
        F.when(c("p_brand") == "Brand#9", "Brand#X").otherwise(c("p_brand")).alias("subject"), "p_partkey", "p_name")).alias("value"))
    rows.withColumnRenamed("brand", "subject").write.partitionBy("subject").text(path)
    expected = v.table("part").select(c("p_brand").alias("subject")).union(
        v.table("part").select(F.lit("Brand#99"))).distinct()
    good, problems = A.read_snapshot_dir(v.spark, path, expected, "subject STRING, p_partkey LONG, p_name STRING")
    counts = good.groupBy("file_subject").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(problems, "file_subject", "full_outer").select(
        "file_subject", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("problem", F.lit("ok")).alias("problem"))


@query("a4_read_overlay", """
SELECT 'seat' AS kind, physical AS k, coalesce(said, '') AS a FROM obs WHERE k < 90
UNION ALL SELECT 'rating', s_name, (s_acctbal::INT)::VARCHAR FROM supplier
UNION ALL SELECT 'requirement', course_code, label FROM prog WHERE label IS NOT NULL""")
def a4(v):
    """Overlay documents of three kinds; seat documents of version 2 count as empty."""
    root = new_folder(v.spark, "overlays")
    item = F.struct(c("said").alias("seat_status"), c("open_seats").alias("seats_available"),
                    c("capacity").alias("seat_capacity"), c("ts").alias("updated_at"))
    version = F.when(c("k") < 90, 1).otherwise(2).alias("schema_version")
    v.observations().select(F.to_json(F.struct(version, F.create_map("physical", item).alias("sections")))).write.text(root + "/seat")
    person = F.struct(c("s_name").alias("name"), F.struct(F.rint("s_acctbal").alias("rating")).alias("metrics"))
    listed = F.to_json(F.array(person))
    whole = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array(person).alias("records")))
    v.table("supplier").select(F.when(c("s_nationkey") < 10, listed).otherwise(whole)).write.text(root + "/ratings")
    v.programs().filter("label IS NOT NULL").select(F.to_json(F.struct(
        F.create_map("label", F.array("course_code")).alias("requirements")))).write.text(root + "/requirement")
    seat, rating, req = (A.read_overlay(v.spark, k, f"{root}/{k}") for k in ("seat", "ratings", "requirement"))
    return (seat.select(F.lit("seat").alias("kind"), c("physical").alias("k"), F.coalesce("seat_status", F.lit("")).alias("a"))
            .union(rating.select(F.lit("rating"), "name", c("metrics.rating").cast("int").cast("string")))
            .union(req.select(F.lit("requirement"), "course_code", "label")))


@query("a5_publish", """
SELECT 1 AS step, count(*) AS n, count(DISTINCT term) AS terms FROM lst UNION ALL
SELECT 2, count(*), count(DISTINCT term) FROM lst WHERE term <> 'Fall 1997' UNION ALL SELECT 3, count(*), count(DISTINCT term) FROM lst""")
def a5(v):
    """Publish, publish a smaller version, roll back; each state as readers see it."""
    target = new_folder(v.spark, "published")
    lst = v.listings("order", "part").select("listing_id", "term", "course_code", "title", "seat_status", "seat_capacity")

    def seen(step: int):
        return W.read_published(v.spark, target).agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"),
                                                     F.count_distinct("term").alias("terms"))

    W.publish(lst, target)
    first = seen(1)
    W.publish(lst.filter("term <> 'Fall 1997'"), target)
    second = seen(2)
    W.rollback(v.spark, target)
    return first.union(second).union(seen(3))


@query("a6_table_manifest", """
SELECT true AS files_found, true AS hashes_whole, count(*) AS rows, true AS same_rows FROM lst""")
def a6(v):
    """Manifest of a published table: every file hashed, and the logical hash of its rows."""
    target = new_folder(v.spark, "manifest")
    lst = v.listings("order").select("listing_id", "term", "seat_status")
    path = W.publish(lst, target).path
    files = W.table_manifest(v.spark, [path])
    back = W.logical_hash(W.read_published(v.spark, target).select(*lst.columns))
    want = W.logical_hash(lst)
    return files.agg((F.count(F.lit(1)) > 0).alias("files_found"), F.bool_and((F.length("sha256") == 64) & (c("bytes") > 0))
                     .alias("hashes_whole")).select(
        "files_found", "hashes_whole", back.select("rows").scalar().alias("rows"),
        ((back.select("xor").scalar() == want.select("xor").scalar())
         & (back.select("total").scalar() == want.select("total").scalar())).alias("same_rows"))


@query("a7_append_by_id", """
SELECT listing_id, CASE WHEN l_quantity > 20 THEN title || ' new' ELSE title END AS title FROM lst""")
def a7(v):
    lst = v.listings("part").select("listing_id", "title", "l_quantity")
    old = lst.filter("l_quantity <= 40").drop("l_quantity")
    new = lst.filter("l_quantity > 20").select("listing_id", F.concat(c("title"), F.lit(" new")).alias("title"))
    return W.append_by_id(old, new)


@query("a8_report_tables", """
SELECT 'counts' AS part, term AS row, 'listings' AS field, count(*)::VARCHAR AS value FROM lst GROUP BY term
UNION ALL SELECT 'counts', term, 'physical', count(DISTINCT physical)::VARCHAR FROM lst GROUP BY term
UNION ALL SELECT 'coverage', f, k, v::VARCHAR FROM (
 SELECT 'location' AS f, count(*) AS t, count(location) AS p FROM lst UNION ALL SELECT 'instructor', count(*), count(instructor) FROM lst),
 LATERAL (VALUES ('total', t), ('present', p), ('missing', t - p)) x(k, v)
UNION ALL SELECT 'duplicates', 'term_code_schedule', 'keys', count(*)::VARCHAR FROM (SELECT 1 FROM lst GROUP BY term, course_code, schedule_number HAVING count(*) > 1)""")
def a8(v):
    """Counts, coverage and duplicates of one build, written with ``publish`` and read back."""
    lst = O.physical(v.listings())
    rules = {k: x for k, x in R.coverage_rules().items() if k in ("location", "instructor")}
    parts = {
        "counts": lst.groupBy("term").agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("physical").alias("physical")),
        "coverage": R.field_coverage(lst, rules).select("field", "total", "present", "missing"),
        "duplicates": R.duplicate_keys(lst).groupBy("kind").agg(F.count(F.lit(1)).alias("keys")),
    }
    target = new_folder(v.spark, "report")
    W.publish(W.report_tables(parts), target, partition_by=("part",))
    return W.read_published(v.spark, target).select("part", "row", "field", "value")


@query("h7_normalise_to_star", """
SELECT 'terms' AS name, count(DISTINCT term) AS n, count(DISTINCT term) AS keys FROM lst
UNION ALL SELECT 'courses', count(DISTINCT course_code), count(DISTINCT course_code) FROM lst
UNION ALL SELECT 'sections', count(*), count(*) FROM lst
UNION ALL SELECT 'meetings', count(*), count(DISTINCT listing_id) FROM meet
UNION ALL SELECT 'instructors', count(DISTINCT instructor), count(DISTINCT instructor) FROM lst WHERE instructor <> 'To Be Announced'
UNION ALL SELECT 'section_instructors', count(*), count(*) FROM lst WHERE instructor <> 'To Be Announced'
UNION ALL SELECT 'instructor_metrics', count(DISTINCT instructor), count(DISTINCT instructor) FROM lst WHERE instructor <> 'To Be Announced' AND has_metrics
UNION ALL SELECT 'section_requirements', count(*), count(DISTINCT listing_id) FROM reqtag
UNION ALL SELECT 'course_programs', count(*), count(DISTINCT cc) FROM (SELECT DISTINCT l.course_code AS cc, program, year, classification FROM progtag JOIN lst l USING (listing_id))""")
def h7(v):
    """Rows and distinct keys per table of the star, from listings joined once."""
    out = None
    for name, df in normalise_to_star(settled(v.listings().select(*READ))).items():
        if name in ("course_metrics", "requirement_definitions"):  # h7_course_tables
            continue
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(df.columns[0]).alias("keys")).select(
            F.lit(name).alias("name"), "n", "keys")
        out = row if out is None else out.union(row)
    return out


@query("h7_course_tables", """
SELECT 'course_metrics' AS name, count(DISTINCT course_code) AS n FROM lst WHERE class_difficulty IS NOT NULL
UNION ALL SELECT 'requirement_definitions', count(DISTINCT tag) FROM reqtag""")
def h7_course(v):
    star = normalise_to_star(v.listings())
    count = [star[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("course_metrics", "requirement_definitions")]
    return count[0].union(count[1])


@query("h7_star_sections", """
SELECT listing_id AS section_key, md5(term_key) AS term_key, md5(subject || '|' || catalog_number) AS course_key, seat_status,
 units::DOUBLE AS units, class_difficulty FROM lst""")
def h7_sections(v):
    return normalise_to_star(v.listings())["sections"].select(
        "section_key", "term_key", "course_key", "seat_status", c("units").cast("double").alias("units"),
        c("class_difficulty").cast("double").alias("class_difficulty"))
