"""Side tables laid over the listings: tags, metrics, names, seats, hidden classes.

No join here carries a broadcast hint: Spark broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise it is
a sort-merge join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.functions.labels import requirement_tag, sort_labels
from offergrid.functions.text import is_placeholder, norm_code, person_key
from offergrid.operators.ordering import ranked, top_per_key
from offergrid.session import settled

c = F.col


def newest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest row per key; an aggregate, so a hot key is reduced before the shuffle."""
    rest = [n for n in df.columns if n != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(key, *[c("_r")[n].alias(n) for n in rest]))


def overlay_tags(listings: DataFrame, mapping: DataFrame, requirements: DataFrame) -> DataFrame:
    """Program and requirement tags by course code.

    ``mapping``: course_code, program, year, classification; ``requirements``:
    course_code, label.  The sets per code hold at most one entry per program
    and label of the catalog.
    """
    programs = (mapping.groupBy(norm_code(c("course_code")).alias("_code"))
                .agg(F.collect_set(F.struct("program", "year", "classification")).alias("_p")))
    labels = (requirements.filter(c("label").isNotNull()).groupBy(norm_code(c("course_code")).alias("_code"))
              .agg(F.collect_set("label").alias("_l")))
    tags = programs.join(labels, "_code", "full_outer")
    own = F.filter(F.transform("requirement_tags", requirement_tag), lambda x: x.isNotNull())
    none = F.slice(F.array(F.lit("")), 1, 0)
    return (listings.join(tags, norm_code(c("course_code")) == c("_code"), "left")
            .withColumn("requirement_tags", sort_labels(F.concat(own, F.coalesce("_l", none))))
            .withColumn("program_tags", F.array_sort(F.array_distinct(F.concat(
                c("program_tags"), F.coalesce(c("_p"), F.slice("program_tags", 1, 0))))))
            .drop("_code", "_p", "_l"))


def overlay_metrics(listings: DataFrame, ratings: DataFrame) -> DataFrame:
    """``ratings``: name, metrics.  No hit keeps the embedded metrics; ``changed`` marks the rest,
    also where the rating says what the listing already had."""
    keyed = (ratings.select(person_key(c("name")).alias("_n"), c("metrics").alias("_m"), c("name"))
             .groupBy("_n").agg(F.min_by("_m", "name").alias("_m")))
    new = F.coalesce("_m", "metrics")
    return (listings.join(keyed, person_key(c("instructor")) == c("_n"), "left")
            .withColumn("changed", c("_m").isNotNull()).withColumn("metrics", new).drop("_n", "_m"))


def overlay_instructors(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """One way only: a placeholder becomes a real name, and loses its metrics.

    ``listings`` has ``physical``; ``cache`` has one row per physical class.
    """
    real = cache.select("physical", F.trim(F.regexp_replace("person", r"\s+", " ")).alias("_name")) \
        .filter(~is_placeholder(c("_name")))
    up = is_placeholder(c("instructor")) & c("_name").isNotNull()
    return (listings.join(real, "physical", "left").withColumn("changed", up)
            .withColumn("metrics", F.when(~c("changed"), c("metrics")))
            .withColumn("instructor", F.when(c("changed"), c("_name")).otherwise(c("instructor"))).drop("_name"))


SEAT_COLUMNS = ("seat_status", "seats_available", "seat_capacity")


def overlay_seats(listings: DataFrame, updates: DataFrame, columns: Sequence[str] = SEAT_COLUMNS) -> DataFrame:
    """Seat columns of EVERY listing of an updated physical class.

    ``updates`` holds one row per physical class and the given columns; a column
    it does not have stays.  ``old_status`` and ``changed`` are added.
    """
    given = [n for n in columns if n in updates.columns]
    side = updates.select("physical", F.lit(True).alias("_hit"), *[c(n).alias(f"_u_{n}") for n in given])
    differs = None
    for n in given:
        d = ~c(n).eqNullSafe(c(f"_u_{n}"))
        differs = d if differs is None else differs | d
    out = (listings.join(side, "physical", "left")
           .withColumn("old_status", c("seat_status"))
           .withColumn("changed", F.coalesce(c("_hit") & differs, F.lit(False))))
    for n in given:
        out = out.withColumn(n, F.when(c("_hit"), c(f"_u_{n}")).otherwise(c(n)))
    return out.drop("_hit", *[f"_u_{n}" for n in given])


def status_changes(overlaid: DataFrame) -> DataFrame:
    """Changed listings and classes per (old status, new status)."""
    return (overlaid.filter("changed").groupBy("old_status", "seat_status")
            .agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("physical").alias("classes")))


def hidden_report(listings: DataFrame, hidden: DataFrame) -> DataFrame:
    """Per hidden record: ``same_ids`` and ``applied``.

    ``hidden`` is flat: physical, listing_id, course_code, crse_id.  The id sets
    are equal when recorded, actual and common counts agree, so no set is built.
    """
    actual = listings.join(hidden.select("physical").distinct(), "physical", "left_semi").select(
        "physical", "listing_id", c("course_code").alias("_code"), F.coalesce("crse_id", F.lit("")).alias("_crse"),
        F.lit(True).alias("_a"))
    both = hidden.withColumn("_r", F.lit(True)).join(actual, ["physical", "listing_id"], "full_outer")
    who = hidden.groupBy("physical").agg(F.min("course_code").alias("course_code"),
                                         F.min(F.coalesce("crse_id", F.lit(""))).alias("crse_id"))
    sets = both.groupBy("physical").agg(
        F.count("_r").alias("recorded"), F.count("_a").alias("actual"),
        F.count_if(c("_r") & c("_a")).alias("common"),
        F.min("_code").alias("_lo"), F.max("_code").alias("_hi"), F.min("_crse").alias("_lo2"),
        F.max("_crse").alias("_hi2"))
    same = (c("recorded") == c("common")) & (c("actual") == c("common"))
    uniform = ((c("_lo") == c("course_code")) & (c("_hi") == c("course_code")) & (c("_lo2") == c("crse_id"))
               & (c("_hi2") == c("crse_id")))
    return sets.join(who, "physical").select("physical", "course_code", "crse_id", same.alias("same_ids"),
                                             F.coalesce(same & uniform, F.lit(False)).alias("applied"))


def hide_overlay(listings: DataFrame, hidden: DataFrame) -> DataFrame:
    """Listings left after hiding; a listing goes when ids, code and id of its record match."""
    gone = hidden_report(listings, hidden).filter("same_ids").select(
        "physical", c("course_code").alias("_code"), c("crse_id").alias("_crse"))
    return listings.join(gone, (listings["physical"] == gone["physical"]) & (listings["course_code"] == c("_code"))
                         & (F.coalesce(listings["crse_id"], F.lit("")) == c("_crse")), "left_anti")


def code_lookup(scheduled: DataFrame, mapped: DataFrame) -> DataFrame:
    """Scheduled codes with their first non-blank title, and mapped-only codes."""
    code, title = F.upper(F.trim("course_code")), F.trim(F.coalesce("title", F.lit("")))
    here = (scheduled.filter(code != "").groupBy(code.alias("code"))
            .agg(F.coalesce(F.min_by(F.when(title != "", title),
                                     F.when(title != "", c("listing_id"))), F.lit("")).alias("title"),
                 F.lit(True).alias("scheduled")))
    there = mapped.select(code.alias("code")).filter(c("code") != "").distinct()
    return there.join(here, "code", "full_outer").select(
        "code", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("scheduled", F.lit(False)).alias("scheduled"))


def _grams(text: Column) -> Column:
    """All substrings of one to three characters."""
    size = F.length(text)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array(
        F.substring(text, i, F.lit(1)), F.substring(text, i, F.lit(2)), F.substring(text, i, F.lit(3))))))


def _suggestion_score(q: Column) -> Column:
    return (F.when(F.startswith(c("_code"), q), 0).when(F.startswith(c("_title"), q), 1)
            .when(F.contains(c("_code"), q), 2).when(F.contains(c("_title"), q), 3))


def suggestion_index(lookup: DataFrame) -> DataFrame:
    """Every course under each of its one to three characters, ranked as an answer to just these; stored.

    Made once per catalog version: gram, pos (1 is best), code, title, score.
    """
    texts = lookup.select("code", "title", F.lower("code").alias("_code"), F.lower("title").alias("_title")) \
        .withColumn("gram", F.explode(F.array_distinct(F.concat(_grams(c("_code")), _grams(c("_title")))))).filter("gram <> ''")
    rows = texts.withColumn("score", _suggestion_score(c("gram"))).select("gram", "code", "title", "score")
    return settled(ranked(rows, [c("score").asc(), c("code").asc()], ["gram"]).repartitionByRange("gram", "pos").sortWithinPartitions("gram", "pos"))


def suggest_stored(queries: DataFrame, index: DataFrame, excluded: DataFrame | None = None, allowed: DataFrame | None = None,
                   limit: int = 8) -> DataFrame:
    """``suggest`` over a ``suggestion_index``.

    A query of up to three characters is a gram itself: its answer is among the first
    ``limit`` rows and as many more as codes are excluded, so only these are read.  With an allowed set
    the rows of its codes are read.  A longer query reads the rows of its first three characters.
    """
    asks = (queries.select(c(queries.columns[0]).alias("q"), F.lower(F.trim(queries.columns[0])).alias("_q"))
            .filter(c("_q") != "").distinct().withColumn("gram", F.substring("_q", 1, 3)))
    short = F.length("_q") <= 3
    rows = index
    reach = F.lit(limit)
    if allowed is not None:
        rows = rows.join(allowed.select(norm_code(c(allowed.columns[0])).alias("_x")), norm_code(c("code")) == c("_x"), "left_semi")
    if excluded is not None:
        gone = excluded.select(norm_code(c(excluded.columns[0])).alias("_x")).distinct()
        reach = reach + gone.agg(F.count(F.lit(1))).scalar()
    brief, long = asks.filter(short), asks.filter(~short)
    near = rows if allowed is not None else rows.filter(c("pos") <= reach)
    one = near.join(brief, "gram").select("q", "code", "title", "score")
    two = rows.join(long, "gram").withColumns({"_code": F.lower("code"), "_title": F.lower("title")}).withColumn(
        "score", _suggestion_score(c("_q"))).filter(c("score").isNotNull()).select("q", "code", "title", "score")
    scored = one.unionByName(two)
    if excluded is not None:
        scored = scored.join(gone, norm_code(c("code")) == c("_x"), "left_anti")
    return top_per_key(scored, ["q"], [c("score"), c("code")], limit)


def suggest(queries: DataFrame, lookup: DataFrame, excluded: DataFrame | None = None,
            allowed: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """Best ``limit`` courses per query text: code prefix, title prefix, code part, title part.

    ``excluded`` and ``allowed`` are one-column code tables.  Codes are one row each.  Callers that ask again and
    again store the ``suggestion_index`` and use ``suggest_stored``.
    """
    return suggest_stored(queries, suggestion_index(lookup), excluded, allowed, limit)


def hit_key() -> Column:
    """Stable key of a search hit: the id form, else the code form."""
    return F.when(c("crse_id").isNotNull(), F.concat_ws("|", F.lit("id"), c("crse_id"), F.coalesce("offer", F.lit("")),
                                                       F.coalesce("career", F.lit("")))) \
        .otherwise(F.concat_ws("|", F.lit("code"), c("subject"), c("number"), F.concat_ws(" ", "subject", "number")))


def canonical_url(base: str) -> Column:
    """Detail URL from the four ids; null ids keep the stored URL."""
    whole = c("crse_id").isNotNull() & c("offer").isNotNull() & c("career").isNotNull() & c("class_number").isNotNull()
    return F.when(whole, F.concat(F.lit(base + "?CRSE_ID="), c("crse_id"), F.lit("&CRSE_OFFER_NBR="), c("offer"),
                                  F.lit("&ACAD_CAREER="), c("career"), F.lit("&CLASS_NBR="), c("class_number"))) \
        .otherwise(c("detail_url"))


def merge_fresh_urls(original: DataFrame, fresh: DataFrame, base: str) -> DataFrame:
    """Fresh hits replace the original of the same key but keep the larger section count."""
    o = original.withColumn("hit_key", hit_key())
    f = newest(fresh.withColumn("hit_key", hit_key()).withColumn("_ord", c("class_number")), "hit_key", ["_ord"])
    cols = [n for n in original.columns if n != "section_count"]
    side = f.select("hit_key", F.lit(True).alias("_f"), c("section_count").alias("_count"),
                    *[c(n).alias(f"_f_{n}") for n in cols])
    joined = o.join(side, "hit_key", "left").select(
        "hit_key", F.coalesce("_f", F.lit(False)).alias("refreshed"),
        F.greatest("section_count", "_count").alias("section_count"),
        *[F.when(c("_f"), c(f"_f_{n}")).otherwise(c(n)).alias(n) for n in cols])
    return joined.withColumn("detail_url", canonical_url(base))


def prune_overlay(cache: DataFrame, active: DataFrame, on: str) -> DataFrame:
    """Cache rows whose key is still active."""
    return cache.join(active.select(on).filter(c(on).isNotNull()), on, "left_semi")


def prune_overlays(caches: dict[str, tuple[DataFrame, str]], active: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(what stays of every cache, part and rows before and after of each); ``caches`` gives the table and its key."""
    kept = {name: prune_overlay(cache, active, on) for name, (cache, on) in caches.items()}
    counts = None
    for name, (cache, _) in caches.items():
        row = cache.agg(F.count(F.lit(1)).alias("before")).select(
            F.lit(name).alias("part"), "before", kept[name].agg(F.count(F.lit(1))).scalar().alias("after"))
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts


def saved_items_refresh(saved: DataFrame, seats: DataFrame, hidden: DataFrame) -> DataFrame:
    """Saved items with the newest seat values; hidden classes are gone."""
    side = seats.select("physical", c("status").alias("_s"), c("open_seats").alias("_o"))
    return (saved.join(hidden.select("physical"), "physical", "left_anti").join(side, "physical", "left")
            .withColumn("seat_status", F.coalesce("_s", "seat_status"))
            .withColumn("seats_available", F.coalesce("_o", "seats_available"))
            .withColumn("refreshed", c("_s").isNotNull()).drop("_s", "_o"))


def saved_option_keys(saved: DataFrame, members: DataFrame) -> DataFrame:
    """Saved options with ``saved_key``: term, code, and the sorted class numbers of all members.

    ``saved`` has option_id; ``members``: option_id, is_primary, rank, term, course_code, schedule_number, one row a member.  Term and
    code are those of the first primary member.  Only members of saved options are read; the numbers of an option are those that its key spells out.
    """
    mine = members.join(saved.select("option_id").distinct(), "option_id", "left_semi")
    number = F.trim(F.coalesce("schedule_number", F.lit("")))
    first = F.min_by(F.struct(F.trim(F.coalesce("term", F.lit(""))).alias("t"), norm_code(c("course_code")).alias("c")), "rank")
    keys = mine.groupBy("option_id").agg(first.alias("f"), F.array_sort(F.collect_set(F.when(number != "", number))).alias("n"))
    return saved.join(keys.select("option_id", F.concat_ws("::", "f.t", "f.c", F.array_join("n", "+")).alias("saved_key")), "option_id")


def saved_options_refresh(saved: DataFrame, members: DataFrame, seats: DataFrame, hidden: DataFrame) -> DataFrame:
    """Members of saved options with the newest seat values; an option with a hidden member is gone.

    ``members`` also has physical, seat_status, seats_available.
    """
    keyed = saved_option_keys(saved, members)
    gone = members.join(hidden.select("physical"), "physical", "left_semi").select("option_id").distinct()
    shown = keyed.join(gone, "option_id", "left_anti").join(members.drop("term", "course_code"), "option_id")
    return saved_items_refresh(shown, seats, hidden)
