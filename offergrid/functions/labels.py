"""Display texts and the requirement vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offergrid.functions.text import bind, squeeze

# Labels.
MODE_LABELS = (("in_person", "In person"), ("online_synchronous", "Online synchronous"),
               ("online_asynchronous", "Online asynchronous"),
               ("online_with_in_person_exams", "Online with in-person exams"),
               ("hybrid", "Hybrid"), ("other", "Other"))
STATUS_LABELS = (("open", "Open"), ("waitlist", "Waitlisted"), ("closed", "Closed"), ("unknown", "Unknown"))
DAY_LABELS = (("mon", "Mon"), ("tue", "Tue"), ("wed", "Wed"), ("thu", "Thu"), ("fri", "Fri"), ("sat", "Sat"),
              ("sun", "Sun"))
# Requirement labels in display order.
REQUIREMENT_ORDER = (
    "GWAR", "American Institutions", "Ethnic Studies", "Cultural Diversity", "1A English Composition",
    "1B Critical Thinking", "1C Oral Communication", "2 Mathematical/Quantitative Reasoning", "3A Arts",
    "3B Humanities", "4 Social and Behavioral Sciences", "5A Physical Science", "5B Biological Science",
    "5C Laboratory", "EXPLORATIONS - PHYS, BIO, MATH/QUANT", "EXPLORATIONS - ARTS & HUMANITIES",
    "EXPLORATIONS - SOCIAL & BEHAVIORAL SCIENCES")
# Fixed values: (code, word the name must hold or "", label), first hit wins.
REQUIREMENT_RULES = (
    ("GE A1", "oral communication", "1C Oral Communication"),
    ("GE A3", "critical thinking", "1B Critical Thinking"),
    ("GE B2", "life science", "5B Biological Science"),
    ("GE C2", "humanities", "3B Humanities"),
    ("GE D", "social and behavioral", "4 Social and Behavioral Sciences"),
    ("GWAR", "", "GWAR"),
    ("AI", "", "American Institutions"),
    ("GE 6", "", "Ethnic Studies"),
    ("GE F", "", "Ethnic Studies"),
    ("GE 1A", "", "1A English Composition"),
    ("GE 1B", "", "1B Critical Thinking"),
    ("GE 1C", "", "1C Oral Communication"),
    ("GE 2", "or 5", "EXPLORATIONS - PHYS, BIO, MATH/QUANT"),
    ("GE 2", "physical and biological sciences", "EXPLORATIONS - PHYS, BIO, MATH/QUANT"),
    ("GE 2", "", "2 Mathematical/Quantitative Reasoning"),
    ("GE B4", "or 5", "EXPLORATIONS - PHYS, BIO, MATH/QUANT"),
    ("GE B4", "physical and biological sciences", "EXPLORATIONS - PHYS, BIO, MATH/QUANT"),
    ("GE B4", "", "2 Mathematical/Quantitative Reasoning"),
    ("GE 3A", "", "3A Arts"),
    ("GE 3B", "", "3B Humanities"),
    ("GE 3", "", "EXPLORATIONS - ARTS & HUMANITIES"),
    ("GE 4", "6 units", "4 Social and Behavioral Sciences"),
    ("GE 4", "sciences", "4 Social and Behavioral Sciences"),
    ("GE 4", "", "EXPLORATIONS - SOCIAL & BEHAVIORAL SCIENCES"),
    ("GE 5A", "", "5A Physical Science"),
    ("GE 5B", "", "5B Biological Science"),
    ("GE 5C", "", "5C Laboratory"),
)
# Older display labels.
OLD_LABELS = (
    ("gwar", "GWAR"),
    ("graduation writing assessment requirement", "GWAR"),
    ("american institutions", "American Institutions"),
    ("american institutions requirement", "American Institutions"),
    ("ethnic studies", "Ethnic Studies"),
    ("cultural diversity", "Cultural Diversity"),
    ("ge a1: oral communication", "1C Oral Communication"),
    ("ge a3: critical thinking", "1B Critical Thinking"),
    ("ge b2: life science", "5B Biological Science"),
    ("ge b4: mathematics/quantitative reasoning", "2 Mathematical/Quantitative Reasoning"),
    ("ge c2: humanities", "3B Humanities"),
    ("ge d: social and behavioral sciences", "4 Social and Behavioral Sciences"),
)


def lookup(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def label_of(c: Column, pairs) -> Column:
    words = F.initcap(F.trim(F.replace(c, F.lit("_"), F.lit(" "))))
    return F.coalesce(lookup(pairs)[c], words)


def requirement_label(code: Column, name: Column) -> Column:
    """Catalog requirement code and name to one label; unknown codes give null."""
    def label(x: Column) -> Column:
        out = None
        for want, word, text in REQUIREMENT_RULES:
            hit = (x["k"] == want) & F.contains(x["n"], F.lit(word)) if word else x["k"] == want
            out = F.when(hit, text) if out is None else out.when(hit, text)
        return out

    return bind(F.struct(F.upper(squeeze(code)).alias("k"), F.lower(squeeze(F.coalesce(name, F.lit("")))).alias("n")), label)


def requirement_tag(c: Column) -> Column:
    """Older tags and display labels to the label in use; unknown tags give null."""
    rule = r"^ge\s+([^:]+):\s*(.*)$"

    def label(t: Column) -> Column:
        coded = requirement_label(F.concat(F.lit("GE "), F.regexp_extract(t, rule, 1)), F.regexp_extract(t, rule, 2))
        wide = (F.when(F.contains(t, F.lit("arts and humanities")), "EXPLORATIONS - ARTS & HUMANITIES")
                .when(F.contains(t, F.lit("social and behavioral")), "EXPLORATIONS - SOCIAL & BEHAVIORAL SCIENCES")
                .when(t.rlike("physical|biological|mathemat|quantitative"), "EXPLORATIONS - PHYS, BIO, MATH/QUANT"))
        named = (F.when(F.contains(t, F.lit("ethnic studies")), "Ethnic Studies")
                 .when(F.contains(t, F.lit("american institutions")), "American Institutions"))
        exact = lookup(OLD_LABELS)[t]
        return (F.when(exact.isNotNull(), exact)
                .when(t.rlike(rule), coded)
                .when(F.startswith(t, F.lit("ai:")), "American Institutions")
                .when(F.startswith(t, F.lit("gwar:")), "GWAR")
                .when(F.contains(t, F.lit("explorations")), F.coalesce(wide, named))
                .otherwise(named))

    return bind(F.lower(squeeze(c)), label)


def requirement_rank(c: Column) -> Column:
    return F.coalesce(lookup([(label, i) for i, label in enumerate(REQUIREMENT_ORDER)])[c],
                      F.lit(len(REQUIREMENT_ORDER)))


def sort_labels(labels: Column) -> Column:
    keyed = F.transform(F.array_distinct(labels), lambda x: F.struct(
        requirement_rank(x).alias("r"), F.lower(x).alias("f"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def clock_label(minutes: Column) -> Column:
    hour = (minutes / 60).cast("int")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.format_string("%d:%02d %s", shown.cast("int"), (minutes % 60).cast("int"),
                           F.when(hour < 12, "AM").otherwise("PM"))


def meeting_label(days: Column, start: Column, end: Column) -> Column:
    """“Mon/Wed 10:00 AM–11:15 AM”, or TBA."""
    day_part = F.array_join(F.transform(days, lambda d: F.coalesce(lookup(DAY_LABELS)[d], F.initcap(d))), "/")
    time_part = (F.when(start.isNotNull() & end.isNotNull(),
                        F.concat(clock_label(start), F.lit("–"), clock_label(end)))
                 .when(start.isNotNull(), clock_label(start)))
    text = F.concat_ws(" ", F.when(day_part != "", day_part), time_part)
    return F.when(text == "", "TBA").otherwise(text)


def seat_label(available: Column, enrolled: Column, capacity: Column) -> Column:
    """Open over total, never enrolled over total."""
    def text(c: Column, tail: str) -> Column:
        return F.concat(c.cast("string"), F.lit(tail))

    total = F.concat(F.lit(" / "), capacity.cast("string"))
    return (F.when(available.isNotNull() & capacity.isNotNull(), F.concat(available.cast("string"), total))
            .when(enrolled.isNotNull() & capacity.isNotNull(),
                  F.concat(F.greatest(capacity - enrolled, F.lit(0)).cast("string"), total))
            .when(available.isNotNull(), text(available, " available"))
            .when(enrolled.isNotNull(), text(enrolled, " enrolled"))
            .when(capacity.isNotNull(), text(capacity, " capacity"))
            .otherwise("—"))


def number_label(c: Column) -> Column:
    """3.0 as “3”, 1.5 as “1.5”."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def units_label(low: Column, high: Column) -> Column:
    return F.when(low == high, number_label(low)).otherwise(
        F.concat(number_label(low), F.lit("–"), number_label(high)))


def term_list_label(terms: Column) -> Column:
    n = F.size(terms)
    return (F.when(n == 0, "Current terms").when(n == 1, F.get(terms, F.lit(0)))
            .when(n == 2, F.array_join(terms, " & "))
            .otherwise(F.concat(F.array_join(F.slice(terms, F.lit(1), n - 1), ", "), F.lit(", & "),
                                F.element_at(terms, -1))))


def tone(c: Column, kind: str) -> Column:
    bands = {"quality": (c >= 4, c >= 2.5), "difficulty": (c <= 2, c <= 3.5), "again": (c >= 80, c >= 50)}
    good, mixed = bands[kind]
    return F.when(c.isNull(), "neutral").when(good, "good").when(mixed, "mixed").otherwise("poor")


def freshness_label(updated: Column, now: Column, stale_after: int = 1800) -> Column:
    """“Updated just now”, “Updated 12 min ago”, “Stale · updated 3.4 hr ago”."""
    age = F.greatest(now.cast("double") - updated.cast("double"), F.lit(0.0))
    hours = age / 3600
    said = (F.when(age < 90, "just now")
            .when(age < 3600, F.concat(F.greatest(F.lit(1), F.floor(age / 60 + 0.5)).cast("string"),
                                       F.lit(" min ago")))
            .when(hours < 10, F.concat(F.format_string("%.1f", hours), F.lit(" hr ago")))
            .otherwise(F.concat(F.floor(hours + 0.5).cast("string"), F.lit(" hr ago"))))
    return (F.when(updated.isNull(), "Live update pending")
            .when(age > stale_after, F.concat(F.lit("Stale · updated "), said))
            .otherwise(F.concat(F.lit("Updated "), said)))
