"""The driver tables as the tables the operators expect.

``listings`` joins only the dimensions a caller needs: ``order`` (term, status,
mode, grouping kind), ``part`` (course, units, tags) and ``supplier``
(instructor, metrics).  Every join is on a unique key and keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENT_KINDS = (("click", "open"), ("view", "waitlist"), ("purchase", "closed"),
               ("signup", "unknown"), ("error", "failure"))
SEASONS = ("Winter", "Spring", "Summer", "Fall")
STATUSES = (("O", "open"), ("P", "waitlist"), ("F", "closed"))
MODES = (("1-URGENT", "in_person"), ("2-HIGH", "online_synchronous"), ("3-MEDIUM", "hybrid"),
         ("4-NOT SPECIFIED", "online_asynchronous"))
COMPONENTS = (("N", "Lecture"), ("A", "Activity"), ("R", "Laboratory"))
CLASSES = ("major_prep", "major_course", "elective")
TAGS = ("GWAR", "American Institutions", "Ethnic Studies", "Cultural Diversity", "3A Arts",
        "3B Humanities", "5A Physical Science", "5B Biological Science")
CATALOG_YEAR = "2026-2027"


def pick(col: Column, pairs, other: str | None = None) -> Column:
    out = None
    for key, value in pairs:
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(F.lit(other)) if other is not None else out


def term_of(ts: Column) -> Column:
    season = F.element_at(F.array(*[F.lit(s) for s in SEASONS]), F.quarter(ts))
    return F.concat(season, F.lit(" "), F.year(ts).cast("string"))


def term_code_of(ts: Column) -> Column:
    """Year and quarter; blank for winter terms, so the name must stand in."""
    return F.when(F.quarter(ts) == 1, F.lit("")).otherwise(
        F.concat(F.year(ts).cast("string"), F.quarter(ts).cast("string")))


def day_of(ts: Column) -> Column:
    return F.lower(F.date_format(ts, "EEE"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        # event time is an instant; the files store it without a zone (UTC)
        return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df

    def listings(self, *needs: str) -> DataFrame:
        """LIST with the columns of the asked dimensions (all when none is named)."""
        needs = needs or ("order", "part", "supplier")
        c = F.col
        df = self.table("lineitem")
        line = c("l_linenumber")
        start = (F.lit(480) + 30 * (c("l_partkey") % 20)).cast("int")
        end = (start + 50 + 25 * (c("l_suppkey") % 4)).cast("int")
        room = F.concat(F.lit("Room "), (c("l_suppkey") % 30).cast("string"))
        first = F.to_date("l_shipdate")

        def meeting(day, s, e):
            return F.struct(F.array(day).alias("days"), s.alias("start_min"), e.alias("end_min"),
                            room.alias("location"), first.alias("date_from"),
                            F.date_add(first, 90).alias("date_to"))

        untimed = F.lit(None).cast("int")
        one = F.array(meeting(day_of(c("l_shipdate")), start, end))
        two = F.array(meeting(day_of(c("l_shipdate")), start, end),
                      meeting(F.lit("fri"), (start + 60).cast("int"), (end + 60).cast("int")))
        bare = F.array(meeting(day_of(c("l_shipdate")), untimed, untimed))
        cols = {
            "listing_id": F.concat_ws("-", c("l_orderkey").cast("string"), line.cast("string"),
                                      c("l_partkey").cast("string"), c("l_suppkey").cast("string"),
                                      F.date_format("l_shipdate", "yyyyMMdd")),
            "schedule_number": F.concat_ws("-", c("l_suppkey").cast("string"),
                                           c("l_quantity").cast("int").cast("string")),
            "section_number": line.cast("string"),
            "offer": (line % 2 + 1).cast("string"),
            "component": pick(c("l_returnflag"), COMPONENTS),
            "is_primary": c("l_linestatus") == "F",
            "seat_capacity": c("l_quantity").cast("int"),
            "campus": F.when(c("l_tax") < 0.02, " imperial  valley").when(c("l_tax") < 0.06, "Main  San Diego site")
                       .otherwise(" Global  Campus "),
            "class_difficulty": F.when(line != 5, F.round(c("l_discount") * 50, 1)),
            "meetings": F.when(line == 7, F.slice(one, 1, 0)).when(line == 6, bare).when(line == 2, two)
                         .otherwise(one),
            "location": F.when(line != 7, room),
            "source_url": F.concat(F.lit("https://classes.example.edu/s/"), c("l_suppkey").cast("string")),
        }
        if "order" in needs:
            df = df.join(self.table("orders"), c("l_orderkey") == c("o_orderkey"))
            prio, row = c("o_orderpriority"), c("o_orderpriority").isin("2-HIGH", "3-MEDIUM")
            status = pick(c("o_orderstatus"), STATUSES)
            rows = F.when(line == 1, F.array(F.lit(1), F.lit(2))).when(line >= 5, F.array(F.lit(2))) \
                .otherwise(F.array(F.lit(1)))
            sigs = F.when(line % 2 == 1, F.array(F.lit("S1"), F.lit("S2"))).otherwise(F.array(F.lit("S1")))
            nobody, noid = F.slice(F.array(F.lit(1)), 1, 0), F.slice(F.array(F.lit("")), 1, 0)
            cols |= {
                "term": term_of(c("o_orderdate")), "term_code": term_code_of(c("o_orderdate")),
                "instruction_mode": pick(prio, MODES, "other"), "seat_status": status,
                "seats_available": F.when(status == "open", F.greatest(c("l_quantity").cast("int") - line, F.lit(1)))
                                    .when(status == "closed", F.lit(0)),
                "group_ids": F.when(prio == "1-URGENT", sigs).otherwise(noid),
                "primary_group_ids": F.when((prio == "1-URGENT") & c("is_primary"), sigs).otherwise(noid),
                "source_key": F.when(row, c("l_orderkey").cast("string")),
                "group_indices": F.when(row, rows).otherwise(nobody),
                "primary_group_indices": F.when(row & c("is_primary"), rows).otherwise(nobody),
                "option_number": F.when(prio == "5-LOW", F.lit(None)).otherwise(line).cast("int"),
            }
        if "part" in needs:
            df = df.join(self.table("part"), c("l_partkey") == c("p_partkey"))
            low = (c("p_size") % 4).cast("double")
            number = F.concat(c("p_size").cast("string"), F.when(c("l_returnflag") == "R", "L").otherwise(""))
            cols |= {
                "subject": c("p_brand"), "catalog_number": number,
                "course_code": F.concat(c("p_brand"), F.lit(" "), number),
                "title": c("p_name"),
                "crse_id": F.when(c("p_size") != 13, c("p_partkey").cast("string")),
                "career": F.when(c("p_size") < 40, "UGRD").otherwise("GRAD"),
                "units": low, "units_min": F.when(line != 6, low),
                "units_max": F.when(line != 6, low + line % 3),
                "units_text": F.when(line % 3 == 0, F.format_string("%.2f", low)).otherwise(
                    F.format_string("%.2f - %.2f", low, low + line % 3)),
                "grading": F.element_at(F.array(F.lit("letter"), F.lit("credit_no_credit"),
                                                F.lit("letter_or_credit_no_credit"), F.lit("other")),
                                        (c("p_size") % 4 + 1).cast("int")),
                "description": F.when(c("p_size") % 5 != 0, F.concat(F.lit("About "), c("p_type"))),
                "requirement_tags": F.filter(F.array(
                    F.element_at(F.array(*[F.lit(t) for t in TAGS]), (c("p_size") % 8 + 1).cast("int")),
                    F.when(c("l_returnflag") == "R", "5C Laboratory")), lambda x: x.isNotNull()),
                "program_tags": F.filter(F.array(
                    F.struct(c("p_type").alias("program"), F.lit(CATALOG_YEAR).alias("year"),
                             F.element_at(F.array(*[F.lit(x) for x in CLASSES]),
                                          (c("p_size") % 3 + 1).cast("int")).alias("classification")),
                    F.when(line % 2 == 0, F.struct(c("p_brand").alias("program"), F.lit("2025-2026").alias("year"),
                                                   F.lit("elective").alias("classification")))),
                    lambda x: x.isNotNull()),
            }
        if "supplier" in needs:
            df = df.join(self.table("supplier"), c("l_suppkey") == c("s_suppkey"))
            key = c("s_suppkey")
            cols |= {
                "instructor": F.when(key % 10 == 3, "To Be Announced").when(key % 10 != 4, c("s_name")),
                "metrics": F.when(key % 10 != 0, F.struct(
                    F.round(1 + (key % 41) / 10, 1).alias("rating"),
                    F.round(1 + (key % 9) / 2, 1).alias("difficulty"),
                    (key * 7 % 101).cast("double").alias("again"),
                    (key % 60).cast("int").alias("reviews"),
                    F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("attendance"),
                    F.when(key % 5 == 0, True).when(key % 5 == 1, False).alias("textbook"))),
            }
        df = df.withColumns(cols) if "order" not in needs else (
            df.withColumn("is_primary", cols.pop("is_primary")).withColumns(cols))
        return df

    def updates(self) -> DataFrame:
        """UPD: seat observations from the event table."""
        c = F.col
        return self.table("events").select(
            "event_id", "ts", "user_id", "event_type",
            pick(c("event_type"), EVENT_KINDS).alias("kind"),
            c("value").alias("seconds"), F.floor("value").cast("int").alias("seats"),
            F.get_json_object("props", "$.k").cast("int").alias("k"))

    def observations(self, updates: DataFrame | None = None) -> DataFrame:
        """Seat observations per physical class, from ``updates()`` without failures."""
        c = F.col
        return (updates if updates is not None else self.updates()).filter("kind <> 'failure'").select(
            "event_id", "ts", "user_id", "k", c("kind").alias("said"),
            F.concat((1996 + c("event_id") % 4).cast("string"), F.lit("4|"), c("user_id").cast("string"), F.lit("-"),
                     (c("k") % 50 + 1).cast("string")).alias("physical"),
            F.when(c("kind") == "open", c("seats")).when(c("kind") == "closed", 0).alias("open_seats"),
            F.when(c("kind").isin("open", "closed"), c("k")).alias("capacity"))

    def names(self, updates: DataFrame | None = None) -> DataFrame:
        """Names seen per physical class; some are placeholders."""
        c = F.col
        return self.observations(updates).select(
            "physical", "event_id", "ts",
            F.when(c("k") % 5 == 0, "Staff").otherwise(F.concat(F.lit("Person "), c("user_id").cast("string")))
             .alias("person"))

    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """SNAP_A and SNAP_B: the part table as two inventories.  Size 50 is not
        listed in A, size 47 no longer in B; in B size 11 has new ids, size 23 a
        new offer number and size 37 a new title."""
        c = F.col
        base = self.table("part").select(
            c("p_brand").alias("subject"), F.concat(c("p_size").cast("string"), F.lit("-"),
                                                    c("p_partkey").cast("string")).alias("number"),
            c("p_name").alias("title"), F.when(c("p_size") != 13, c("p_partkey").cast("string")).alias("crse_id"),
            F.lit("1").alias("offer"), F.when(c("p_size") < 40, "UGRD").otherwise("GRAD").alias("career"),
            c("p_partkey").cast("string").alias("class_number"),
            c("p_type").alias("course_type"), (c("p_size") % 7).cast("int").alias("section_count"),
            c("p_size"), c("p_partkey"))
        a = base.filter(c("p_size") != 50)
        b = base.filter(c("p_size") != 47).withColumns({
            "crse_id": F.when(c("p_size") == 11, F.concat(F.lit("N"), c("p_partkey").cast("string")))
                        .otherwise(c("crse_id")),
            "offer": F.when(c("p_size") == 23, "2").otherwise(c("offer")),
            "title": F.when(c("p_size") == 37, F.concat(c("title"), F.lit(" II"))).otherwise(c("title")),
            "class_number": F.concat(F.lit("9"), c("class_number"))})
        return a, b

    def programs(self) -> DataFrame:
        """PROG: one row per program and mapped course."""
        c = F.col
        return self.table("part").select(
            c("p_type").alias("program"), F.lit(CATALOG_YEAR).alias("year"),
            c("p_brand").alias("group_name"),
            F.concat(c("p_brand"), F.lit(" "), c("p_size").cast("string")).alias("course_code"),
            F.element_at(F.array(*[F.lit(x) for x in CLASSES]), (c("p_size") % 3 + 1).cast("int"))
             .alias("classification"),
            F.when(c("p_size") % 17 < 8, F.get(F.array(*[F.lit(t) for t in TAGS]), (c("p_size") % 17).cast("int")))
             .alias("label"),
            F.concat(F.lit("see "), c("p_name")).alias("note"), c("p_partkey"))
