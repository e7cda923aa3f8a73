"""Sort, page and the search pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offergrid.functions.text import natural_key, term_key
from offergrid.operators.filters import FilterSpec
from offergrid.operators.options import Options, component_rank, match_options, published, stored_grouping
from offergrid.operators.ordering import ranked
from offergrid.session import settled

c = F.col
# Sort modes as (metric column, descending); none means A to Z.
SORT_MODES = {
    "alphabetical": None, "alphabetical_desc": None,
    "professor_rating_asc": ("rating", False), "professor_rating": ("rating", True),
    "difficulty": ("class_difficulty", False), "difficulty_desc": ("class_difficulty", True),
    "professor_difficulty_asc": ("difficulty", False), "professor_difficulty": ("difficulty", True),
    "reviews_asc": ("reviews", False), "reviews": ("reviews", True),
    "take_again_asc": ("again", False), "take_again": ("again", True),
}
SHALLOW_ROWS = 10_000


AZ_COLUMNS = ("_az_subject", "_az_number", "_az_section", "_az_option", "_az_schedule")


def az_keys() -> list[Column]:
    return [natural_key(c("subject")), natural_key(c("catalog_number")), natural_key(c("section_number")),
            F.coalesce("option_number", F.lit(0)), natural_key(c("schedule_number"))]


def with_az(df: DataFrame) -> DataFrame:
    """The A to Z key as columns, so that partitioning and sorting do not work it out again."""
    return df.withColumns(dict(zip(AZ_COLUMNS, az_keys())))


def sort_order(mode: str, last: str = "option_id", az: Sequence[Column] | None = None) -> list[Column]:
    """Order over ``with_az`` columns, or ``az`` in their place: missing metrics last both ways, ties A to Z, then ``last``."""
    keys = [*(az or [c(n) for n in AZ_COLUMNS]), c(last)]
    if mode == "alphabetical_desc":
        return [k.desc() for k in keys]
    metric = SORT_MODES[mode]
    if metric is None:
        return [k.asc() for k in keys]
    name, descending = metric
    first = c(name).desc_nulls_last() if descending else c(name).asc_nulls_last()
    return [first, *[k.asc() for k in keys]]


def sort_options(df: DataFrame, mode: str, last: str = "option_id", stored: bool = False, shown: Sequence[str] | None = None) -> DataFrame:
    """Rows, or their ``shown`` columns, with their position under ``mode``; the A to Z key does not travel with them."""
    worked = (dict(zip(AZ_COLUMNS, az_keys())), sort_order(mode, last))
    return ranked(df, sort_order(mode, last, az_keys()), stored=stored, worked=worked, shown=shown)


def order_key(mode: str, last: str = "option_id") -> Column:
    """The order of ``sort_order`` as one value: it grows from row to row, or falls for ``alphabetical_desc``."""
    keys = [*[c(n) for n in AZ_COLUMNS], c(last)]
    metric = SORT_MODES[mode]
    if metric is None:
        return F.struct(*keys)
    name, descending = metric
    return F.struct(c(name).isNull().alias("_none"), (-c(name) if descending else c(name)).alias("_metric"), *keys)


def page_place(total: Column, number: int, size: int) -> tuple[Column, Column]:
    """(pages of ``total`` rows, page that ``number`` clamps to); no rows are one page."""
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
    return pages, F.least(F.lit(max(number, 1)), pages)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, largest: int = 50,
         total: Column | None = None, stored: bool = False) -> DataFrame:
    """Rows of one page with ``pos``, ``total`` and ``pages``; numbers clamp.

    A shallow page is a top-k (no full sort); a deep one uses whole-table ranks.
    ``total`` is the row count where the caller has a cheaper way to it.
    """
    size = min(max(size, 1), largest)
    number = max(number, 1)
    if total is None:
        total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    if number * size <= SHALLOW_ROWS:
        top = df.orderBy(*order).limit(number * size)
        placed = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        placed = ranked(df, order, stored=stored)
    pages, at = page_place(c("total"), number, size)
    sized = placed.withColumn("total", total).withColumn("pages", pages)
    return sized.filter((c("pos") > (at - 1) * size) & (c("pos") <= at * size))


INDEX_BLOCK = 100_000


def index_orders(rows: DataFrame, modes: Sequence[str], last: str = "option_id", stored: bool = False) -> DataFrame:
    """``rows`` (``with_az``) with their position under every mode, stored: ``_pos_`` and the mode's name.

    Made once per catalog version.  A to Z is ranked once; the metric modes rank by the metric and
    that position, and ``alphabetical_desc`` is the same position read backwards.
    """
    out = ranked(rows, sort_order("alphabetical", last), out="_pos_alphabetical", stored=stored).drop(*AZ_COLUMNS)
    for mode in modes:
        if SORT_MODES[mode] is not None:
            name, descending = SORT_MODES[mode]
            first = c(name).desc_nulls_last() if descending else c(name).asc_nulls_last()
            out = ranked(out, [first, c("_pos_alphabetical").asc()], out=f"_pos_{mode}", stored=True)
    return settled(out)


def indexed_page(hits: DataFrame, mode: str, number: int, size: int, largest: int = 50, block: int = INDEX_BLOCK) -> DataFrame:
    """Rows of one page of ``hits``, any part of an ``index_orders`` table, with ``pos``, ``total`` and ``pages``.

    Hits are counted per block of stored positions.  The few block counts tell which blocks hold
    the page, and only their rows are sorted, at any depth and for any filter.
    """
    size, number = min(max(size, 1), largest), max(number, 1)
    backwards = mode == "alphabetical_desc"
    place = c("_pos_alphabetical" if backwards else f"_pos_{mode}")
    rows = hits.withColumn("_at", -place if backwards else place).withColumn("_block", F.floor(c("_at") / block).cast("long"))
    counts = settled(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")))
    total = F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0))
    pages, at = page_place(total, number, size)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    holding = settled(starts.filter((c("start") < at * size) & (c("start") + c("n") > (at - 1) * size)))
    low, high, start = (holding.agg(f).scalar() for f in (F.min("_block"), F.max("_block"), F.min("start")))
    near = rows.filter((c("_block") >= low) & (c("_block") <= high))
    placed = near.withColumn("pos", (F.row_number().over(Window.orderBy("_at")) + start).cast("long"))
    return placed.withColumns({"total": total, "pages": pages}).filter((c("pos") > (at - 1) * size) & (c("pos") <= at * size)).drop("_at", "_block")


def option_rows(listings: DataFrame, options: DataFrame) -> DataFrame:
    """Options with the current values of their primary listing."""
    return options.join(listings.drop("option_number").withColumnRenamed("listing_id", "primary_id"), "primary_id")


SHOWN = ("subject", "catalog_number", "section_number", "schedule_number", "course_code", "title", "term",
         "seat_status", "instructor", "class_difficulty")


METRICS = ("rating", "difficulty", "reviews", "again")


def publish_options(listings: DataFrame, opts: Options) -> Options:
    """The option table a search reads, stored: every option with its A to Z key and metrics; and the membership.

    Built once per catalog version; searches and seat updates then never group again.
    """
    slim = listings.select("listing_id", *SHOWN, *[c("metrics")[n].alias(n) for n in METRICS])
    rows = with_az(option_rows(slim, opts.options)).select(
        "option_id", "kind", "primary_id", "option_number", "n_members", "class_difficulty", *METRICS, *AZ_COLUMNS)
    return published(opts._replace(options=rows))


def publish_grouping(listings: DataFrame) -> Options:
    """``publish_options`` of listings grouped here: their columns travel with the grouping, nothing joins back."""
    names = ["class_difficulty", *METRICS]
    rows = listings.withColumns({n: c("metrics")[n] for n in METRICS})
    return stored_grouping(rows, ["subject", "catalog_number", "section_number", "schedule_number", *names], lambda df: with_az(df).select(
        "option_id", "kind", "primary_id", "option_number", "n_members", *names, *AZ_COLUMNS))


def search(listings: DataFrame, opts: Options, spec: FilterSpec) -> DataFrame:
    """One row per member of each option on the page, with live member values.

    ``opts`` is what ``publish_options`` stored.  The predicate goes to the scan
    of the listings, the hits are option ids, the page is a top-k over the
    narrow option table, and only the options on it meet their members.
    """
    hits = match_options(listings.filter(spec.predicate()), opts.membership, opts.options)
    total = hits.agg(F.count(F.lit(1)).alias("total")).scalar()
    shown = page(hits, sort_order(spec.sort_by), spec.page, spec.page_size, total=total)
    unfiltered = opts.options.agg(F.count(F.lit(1))).scalar()
    heads = shown.select("pos", "option_id", "primary_id", "option_number", "n_members", "total", "pages",
                         unfiltered.alias("unfiltered"))
    live = listings.select("listing_id", "component", "seat_status", "seats_available", "section_number",
                           "schedule_number", "instructor")
    members = heads.join(opts.membership.select("option_id", "listing_id"), "option_id").join(live, "listing_id")
    return members.withColumn("component_rank", component_rank(c("component")))


def with_term_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_term", term_key(c("term")))


def canonical_keys() -> list[Column]:
    return [c("_term").asc(), F.lower("subject").asc(), F.lower("catalog_number").asc(),
            F.lower("section_number").asc(), F.lower("schedule_number").asc(), c("listing_id").asc()]


def canonical_order(df: DataFrame) -> DataFrame:
    """Publish order: ranges over the table, sorted inside each file."""
    keys = canonical_keys()
    return with_term_key(df).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_term")
