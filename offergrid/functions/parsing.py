"""Raw schedule text to typed values.  A value that does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offergrid.functions.text import squeeze

DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
# Day words and one-letter day codes.
DAY_WORDS = (("mon", r"(?i)\bMON(?:DAY)?\b"), ("tue", r"(?i)\bTUE(?:SDAY)?\b"),
             ("wed", r"(?i)\bWED(?:NESDAY)?\b"), ("thu", r"(?i)\bTHU(?:RSDAY)?\b"),
             ("fri", r"(?i)\bFRI(?:DAY)?\b"), ("sat", r"(?i)\bSAT(?:URDAY)?\b"),
             ("sun", r"(?i)\bSUN(?:DAY)?\b"))
DAY_LETTERS = (("M", "mon"), ("T", "tue"), ("W", "wed"), ("R", "thu"), ("F", "fri"), ("S", "sat"), ("U", "sun"))
UNITS = r"^(\d+(?:\.\d+)?) ?(?:- ?(\d+(?:\.\d+)?))?$"


def plain(c: Column) -> Column:
    """Lower case, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def has(c: Column, word: str) -> Column:
    return F.contains(c, F.lit(word))


def instruction_mode(text: Column, timed: Column) -> Column:
    t = plain(text)
    return (F.when(text.isNull(), F.lit(None).cast("string"))
            .when(has(t, "hybrid"), "hybrid")
            .when(has(t, "online with in person exams"), "online_with_in_person_exams")
            .when(has(t, "asynchronous"), "online_asynchronous")
            .when(has(t, "synchronous"), "online_synchronous")
            .when(has(t, "online") & timed.isNull(), "other")
            .when(has(t, "online") & timed, "online_synchronous")
            .when(has(t, "online"), "online_asynchronous")
            .when(has(t, "in person") | has(t, "face to face"), "in_person")
            .otherwise("other"))


def mode_of_codes(codes: Column, timed: Column) -> Column:
    """Mode of one class from the set of mode codes on its rows."""
    words = F.transform(codes, plain)
    tight = F.transform(words, lambda x: F.replace(x, F.lit(" "), F.lit("")))

    def any_of(*values: str) -> Column:
        return F.arrays_overlap(tight, F.array(*[F.lit(v) for v in values]))

    hybrid = any_of("hy", "hybrid", "hyflex")
    person = any_of("p", "ip", "inperson", "facetoface") | F.array_contains(words, "on campus")
    online = any_of("on", "online", "fullyonline", "web")
    return (F.when(hybrid | (person & online), "hybrid")
            .when(online & timed, "online_synchronous").when(online, "online_asynchronous")
            .when(person, "in_person").otherwise("other"))


def grading_type(text: Column) -> Column:
    t = plain(F.coalesce(text, F.lit("")))
    letter, credit = has(t, "letter"), has(t, "cr nc") | has(t, "credit no credit")
    return (F.when(letter & credit, "letter_or_credit_no_credit").when(letter, "letter")
            .when(credit, "credit_no_credit").otherwise("other"))


def grading_of_export(text: Column) -> Column:
    """The spelling used in schedule exports."""
    t = plain(F.coalesce(text, F.lit("")))
    return (F.when(has(t, "credit") & has(t, "letter"), "letter_or_credit_no_credit")
            .when(t.isin("cr nc", "credit no credit", "credit noncredit"), "credit_no_credit")
            .when(has(t, "letter") | t.isin("graded", "grade"), "letter").otherwise("other"))


def status_word(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " "))
    return (F.when(t.isin("open", "available", "o"), "open")
            .when(t.isin("waitlist", "wait list", "waiting list", "w"), "waitlist")
            .when(t.isin("closed", "full", "c"), "closed").otherwise("unknown"))


def status_phrase(text: Column) -> Column:
    t = F.lower(squeeze(F.coalesce(text, F.lit(""))))
    return (F.when(has(t, "wait"), "waitlist").when(has(t, "closed"), "closed")
            .when(has(t, "open"), "open").otherwise("unknown"))


def seat_status(text: Column, capacity: Column, enrolled: Column, available: Column, waiting: Column) -> Column:
    """The stated status; when unknown, what the counts say."""
    said = status_word(text)
    return (F.when(said != "unknown", said)
            .when(available > 0, "open").when(enrolled < capacity, "open")
            .when(waiting > 0, "waitlist")
            .when((available == 0) | (enrolled >= capacity), "closed")
            .otherwise("unknown"))


def complement(whole: Column, part: Column, known: Column) -> Column:
    """``known``, else ``whole - part`` floored at zero."""
    return F.coalesce(known, F.when(whole.isNotNull() & part.isNotNull(), F.greatest(whole - part, F.lit(0))))


def seat_counts(text: Column) -> Column:
    """“Seats n of m” to struct<available, capacity, enrolled>."""
    rule = r"(?i)Seats?\s+(\d+)\s+of\s+(\d+)"
    n, m = F.regexp_extract(text, rule, 1).try_cast("int"), F.regexp_extract(text, rule, 2).try_cast("int")
    return F.struct(n.alias("available"), m.alias("capacity"),
                    F.when(n.isNotNull(), F.greatest(m - n, F.lit(0))).alias("enrolled"))


def count_value(text: Column) -> Column:
    n = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double").cast("int")
    return F.when(n >= 0, n)


def units_value(text: Column) -> Column:
    n = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
    return F.when(n >= 0, n)


def units_range(text: Column) -> Column:
    """struct<units, low, high, text, ok>; units is null for a true range."""
    tidy = squeeze(text)
    low = F.regexp_extract(tidy, UNITS, 1).try_cast("double")
    high = F.coalesce(F.regexp_extract(tidy, UNITS, 2).try_cast("double"), low)
    ok = F.coalesce(low <= high, F.lit(False))
    return F.struct(F.when(ok & (low == high), low).alias("units"), F.when(ok, low).alias("low"),
                    F.when(ok, high).alias("high"), tidy.alias("text"), ok.alias("ok"))


def meeting_days(text: Column) -> Column:
    """Day words win over day letters; each day once, letters in order of first hit."""
    words = F.filter(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(rule), F.lit(day))
                               for day, rule in DAY_WORDS]), lambda x: x.isNotNull())
    table = F.create_map(*[F.lit(x) for pair in DAY_LETTERS for x in pair])
    letters = F.split(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^MTWRFSU]", ""), "")
    coded = F.array_distinct(F.filter(F.transform(letters, lambda x: table[x]), lambda x: x.isNotNull()))
    none = F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("", "arr", "arranged", "tba", "online")
    return F.when(none, F.slice(words, 1, 0)).when(F.size(words) > 0, words).otherwise(coded)


def clock_minutes(text: Column) -> Column:
    """“9:05 AM”, “09:05:00 PM” or “21:05” to minutes of the day."""
    t = F.upper(squeeze(text))
    half = r"\b(\d{1,2}):(\d{2})(?::\d{2})?\s*([AP])M\b"
    full = r"^(\d{1,2}):(\d{2})(?::\d{2})?$"
    h12, m12 = F.regexp_extract(t, half, 1).try_cast("int"), F.regexp_extract(t, half, 2).try_cast("int")
    h24, m24 = F.regexp_extract(t, full, 1).try_cast("int"), F.regexp_extract(t, full, 2).try_cast("int")
    pm = F.when(F.regexp_extract(t, half, 3) == "P", 720).otherwise(0)
    twelve = F.when((h12 >= 1) & (h12 <= 12) & (m12 < 60), h12 % 12 * 60 + m12 + pm)
    return F.coalesce(twelve, F.when((h24 < 24) & (m24 < 60), h24 * 60 + m24)).cast("int")


def date_range(text: Column) -> Column:
    """struct<date_from, date_to> from the first two mm/dd/yyyy values."""
    hits = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), F.lit(1))

    def at(i: int) -> Column:
        return F.try_to_date(F.get(hits, F.lit(i)), "M/d/yyyy")

    both = at(0).isNotNull() & at(1).isNotNull()
    return F.struct(F.when(both, at(0)).alias("date_from"), F.when(both, at(1)).alias("date_to"))


def iso_ts(text: Column) -> Column:
    """ISO text with Z, an offset or no zone (then UTC); bad text is null."""
    return F.trim(text).try_cast("timestamp")
