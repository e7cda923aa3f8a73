"""Enrollment options: many-to-many grouping of listings, and its audit.

The bridge (option key, listing) stays flat.  Every per-option value comes from
an aggregate with map-side partials (count, bool_or, min of a struct), so an
option that holds a large part of the table never sits in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offergrid.functions import keys as K
from offergrid.functions.text import norm_code
from offergrid.session import settled, small_tasks

c = F.col
# Words of secondary components, and the order of components.
SECONDARY_WORDS = ("activity", "laboratory", "lab", "tech acts", "tech act", "clinical")
COMPONENT_ORDER = ("lecture", "discussion", "seminar", "activity", "laboratory", "lab", "tech")


def is_secondary(component: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(component, F.lit(""))))
    return F.exists(F.array(*[F.lit(w) for w in SECONDARY_WORDS]), lambda w: F.contains(low, w))


def component_rank(component: Column) -> Column:
    low = F.lower(F.coalesce(component, F.lit("")))
    out = None
    for i, word in enumerate(COMPONENT_ORDER):
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(99)


class Options(NamedTuple):
    options: DataFrame      # one row per option
    membership: DataFrame   # option_id, listing_id, is_primary, n_members
    bridge: DataFrame       # key, listing_id, is_primary of every listing, also of dropped groups


def option_keys() -> Column:
    """array<struct<kind, key, idx, is_primary>> by the first rule that applies."""
    term = F.lower(F.trim(F.coalesce(F.when(c("term") != "", c("term")), c("term_code"))))
    code = norm_code(c("course_code"))

    def key(kind: str, *parts: Column) -> Column:
        return F.concat_ws("|", F.lit(kind), *parts)

    def item(kind: str, k: Column, idx: Column, primary: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), k.alias("key"), idx.alias("idx"), primary.alias("is_primary"))

    nothing = F.lit(None).cast("int")
    first = ~is_secondary(c("component"))
    signature = F.transform("group_ids", lambda g: item(
        "signature", key("signature", term, code, g), nothing, F.array_contains("primary_group_ids", g)))
    row = F.transform("group_indices", lambda g: item(
        "row", key("row", term, c("source_key"), g.cast("string")), g,
        F.array_contains("primary_group_indices", g)))
    single = F.array(item("single", key("single", c("listing_id")), nothing, first))
    legacy = F.array(item("legacy", key(
        "legacy", K.offering_key(c("term"), c("term_code"), c("subject"), c("crse_id"), c("course_code"),
                                 c("offer"), c("career")), c("option_number").cast("string")), nothing, first))
    return (F.when(F.size("group_ids") > 0, signature)
            .when((c("source_key") != "") & (F.size("group_indices") > 0), row)
            .when(c("option_number").isNull(), single).otherwise(legacy))


MEMBER_COLUMNS = ("listing_id", "course_code", "term", "component", "section_number", "schedule_number",
                  "option_number", "units")


# What the grouping reads of a listing.
GROUPED = (*MEMBER_COLUMNS, "term_code", "subject", "crse_id", "offer", "career", "source_key", "group_ids", "primary_group_ids",
           "group_indices", "primary_group_indices")


def option_bridge(listings: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per listing and option key, with the physical class, so that audits need no join back."""
    return (physical(listings).withColumn("_k", F.explode(option_keys()))
            .select(*MEMBER_COLUMNS, *carried, "physical", c("_k.kind").alias("kind"), c("_k.key").alias("key"), c("_k.idx").alias("idx"),
                    c("_k.is_primary").alias("is_primary")))


def alias_groups(bridge: DataFrame) -> DataFrame:
    """Row groups without a primary, and the ONE group they belong to.

    Same term, code and index, exactly one group with a primary; two or more
    candidates are left alone.  Term and code come from the first member.
    """
    groups = (bridge.filter("kind = 'row'").groupBy("key", "idx")
              .agg(F.bool_or("is_primary").alias("has_primary"), F.min_by(_term_and_code(), "listing_id").alias("who")))
    return _alias_targets(groups)


def _term_and_code() -> Column:
    return F.struct(F.lower(F.trim("term")).alias("t"), F.upper(F.trim("course_code")).alias("c"))


def _alias_targets(groups: DataFrame) -> DataFrame:
    targets = (groups.filter("has_primary").groupBy("idx", "who")
               .agg(F.min("key").alias("target"), F.count(F.lit(1)).alias("n")).filter("n = 1"))
    return (groups.filter("NOT has_primary").join(targets, ["idx", "who"]).select("key", "target"))


def group_options(listings: DataFrame) -> Options:
    """Options and membership, as plans: nothing runs or is written here.

    ``published`` stores both for callers that read them again and again.
    """
    bridge = option_bridge(listings)
    moved = alias_groups(bridge)
    joined = (bridge.join(moved, "key", "left").withColumn("key", F.coalesce("target", "key")).drop("target"))
    options = _kept(_with_kind(joined.groupBy("key").agg(*_facts())))
    return Options(options, members(joined, options), joined)


def _facts(carried: Sequence[str] = (), rank: Column | None = None, secondary: Column | None = None) -> list[Column]:
    """What a group of bridge rows says about its option, beside its key; ``carried`` are columns of the first member."""
    rank = component_rank(c("component")) if rank is None else rank
    secondary = is_secondary(c("component")) if secondary is None else secondary
    member = F.struct((~c("is_primary")).alias("late"), rank.alias("rank"),
                      c("section_number"), c("schedule_number"), c("listing_id"), c("option_number"), *[c(n) for n in carried])
    return [F.count(F.lit(1)).alias("n_members"),
            F.bool_or("is_primary").alias("has_primary"), F.bool_and(secondary).alias("all_secondary"),
            F.min(member).alias("first")]


def _with_kind(groups: DataFrame) -> DataFrame:
    """Kind and index as the key names them."""
    kind = F.substring_index("key", "|", 1)
    return groups.withColumns({"kind": kind, "idx": F.when(kind == "row", F.substring_index("key", "|", -1).try_cast("int"))})


def _kept(groups: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Groups that are options.  A single listing is primary unless it is secondary, so one without units needs no rule of its own."""
    return groups.filter(c("has_primary") | ~c("all_secondary")).select(
        c("key").alias("option_id"), "kind", c("first.listing_id").alias("primary_id"),
        F.when(c("kind") == "row", c("idx")).otherwise(c("first.option_number")).alias("option_number"), "n_members",
        *[c("first")[n].alias(n) for n in carried])


def _grouped(listings: DataFrame, carried: Sequence[str] = (), counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(options with columns of their primary listing, stored aliases); without ``counted``, ``n_members`` is not to be read.

    The listings are read and grouped once: groups are stored before aliases are followed, what a moved
    group says is added to its target, and the columns travel with the first member, so nothing joins back.
    """
    own = [n for n in carried if n not in ("section_number", "schedule_number", "listing_id")]
    bridge = option_bridge(listings, [n for n in carried if n not in MEMBER_COLUMNS])
    # rows are sorted by key to be grouped: they hold the rank for the component, and term and code in row groups only
    in_row, who = c("kind") == "row", _term_and_code()
    # where not being primary means being secondary, such a row makes no option and is first in none: it only counts
    named = ("single", "legacy") if not counted else ("single",)
    slim = bridge.filter(c("is_primary") | ~c("kind").isin(*named)).select(
        "key", "is_primary", component_rank(c("component")).cast("byte").alias("_rank"), is_secondary(c("component")).alias("_secondary"),
        "section_number", "schedule_number", "listing_id", "option_number", *own, in_row.alias("_row"),
        F.when(in_row, who["t"]).alias("_t"), F.when(in_row, who["c"]).alias("_c"))
    row = F.min(F.when(c("_row"), F.struct("listing_id", F.struct(c("_t").alias("t"), c("_c").alias("c")).alias("who"))))
    found = slim.groupBy("key").agg(*_facts(own, c("_rank"), c("_secondary")), row["who"].alias("who"))
    with small_tasks(listings.sparkSession):
        # a row group that is no option may still move to one
        groups = _with_kind(settled(found.filter(F.startswith("key", F.lit("row|")) | c("has_primary") | ~c("all_secondary"))))
    rows = groups.filter("kind = 'row'")
    moved = settled(_alias_targets(rows))
    added = settled(rows.filter("NOT has_primary").join(moved, "key").groupBy(c("target").alias("key")).agg(
        F.sum("n_members").alias("_n_members"), F.bool_or("has_primary").alias("_has_primary"),
        F.bool_and("all_secondary").alias("_all_secondary"), F.min("first").alias("_first")))
    # only row groups without a primary move, only those with one take them in: no other group is shuffled again
    facts = ["key", "kind", "idx", "n_members", "has_primary", "all_secondary", "first"]
    targets = rows.filter("has_primary").join(added, "key", "left").select(
        "key", "kind", "idx", (c("n_members") + F.coalesce("_n_members", F.lit(0))).alias("n_members"),
        (c("has_primary") | F.coalesce("_has_primary", F.lit(False))).alias("has_primary"),
        (c("all_secondary") & F.coalesce("_all_secondary", F.lit(True))).alias("all_secondary"),
        F.least("first", "_first").alias("first"))
    staying = rows.filter("NOT coalesce(has_primary, false)").join(moved.select("key"), "key", "left_anti").select(*facts)
    both = groups.filter("kind <> 'row'").select(*facts).unionByName(staying).unionByName(targets)
    return _kept(both, carried), moved


def stored_options(listings: DataFrame, carried: Sequence[str] = (), shown: Sequence[str] | None = None) -> DataFrame:
    """The options of ``group_options`` with columns of their primary listing (not ``option_number``), stored; or their ``shown`` columns."""
    options = _grouped(listings, carried, counted=not shown or "n_members" in shown)[0]
    return settled(options.select(*shown) if shown else options)


def stored_grouping(listings: DataFrame, carried: Sequence[str] = (), shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Options:
    """``group_options``, stored: options in the given ``shape`` and the membership, from two reads of the listings."""
    options, moved = _grouped(listings, carried)
    options = settled(shape(options))
    bridge = option_bridge(listings).join(moved, "key", "left").withColumn("key", F.coalesce("target", "key")).drop("target")
    return Options(options, settled(members(bridge, options)), bridge)


KEY_BUCKETS = 4096
HOT_ROWS = 1_000_000


def option_members(listings: DataFrame, carried: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every listing under each of its keys with the option it is in there, from one shuffle of the keys.

    option_id (null where the group is no option), listing_id, physical, is_primary, n_members and the ``carried`` columns;
    ``rep`` and ``head`` mark one row per class of an option and one per option, where ``plain``; other options
    took a group in or have a key that may be too large for a task, and are to be told apart by grouping.
    ``listings`` is read twice, so it is stored.
    """
    in_row = c("kind") == "row"
    own = [n for n in carried if n not in ("listing_id", "physical")]
    flat = option_bridge(listings, [n for n in own if n not in MEMBER_COLUMNS]).select(
        "key", in_row.alias("_row"), "idx", "listing_id", "physical", "is_primary", is_secondary(c("component")).alias("_secondary"),
        F.when(in_row, _term_and_code()).alias("_who"), *own)

    def facts(over: Callable[[Column], Column]) -> dict[str, Column]:
        return {"n_members": over(F.count(F.lit(1))), "_has_primary": over(F.bool_or("is_primary")), "_all_secondary": over(F.bool_and("_secondary")),
                "_lead": over(F.min(F.when(c("_row"), F.struct("listing_id", "_who"))))["_who"]}

    bucket = F.pmod(F.xxhash64("key"), F.lit(KEY_BUCKETS))
    sizes = flat.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a bucket
    mean = sum(r.n for r in sizes) / KEY_BUCKETS
    hot = [r.bucket for r in sizes if r.n > max(hot_rows, 8 * mean if hot_rows else 0)]
    small = flat.filter(~bucket.isin(hot)) if hot else flat
    group, classes = Window.partitionBy("key"), Window.partitionBy("key", "physical").orderBy("listing_id")
    told = small.repartition("key").withColumn("rep", F.row_number().over(classes) == 1).withColumns(facts(lambda f: f.over(group))).withColumns(
        {"head": c("rep") & c("physical").eqNullSafe(F.min("physical").over(group)), "plain": F.lit(True)})
    if hot:
        large = flat.filter(bucket.isin(hot))
        no = F.lit(False)
        told = told.unionByName(large.join(large.groupBy("key").agg(*[f.alias(n) for n, f in facts(lambda f: f).items()]), "key").withColumns(
            {"rep": no, "head": no, "plain": no}))
    with small_tasks(listings.sparkSession):
        told = settled(told.drop("_who", "_secondary"))

    # groups that move, and their targets: the option they are now and its members
    groups = told.filter("_row").groupBy("key", "idx").agg(
        F.min("_lead").alias("who"), F.bool_or("is_primary").alias("has_primary"), F.max("n_members").alias("n"))
    targets = groups.filter("has_primary").groupBy("idx", "who").agg(
        F.min("key").alias("target"), F.max("n").alias("own"), F.count(F.lit(1)).alias("homes")).filter("homes = 1")
    moved = settled(groups.filter("NOT has_primary").join(targets, ["idx", "who"]).select("key", "target", "n", "own"))
    total = moved.groupBy("target").agg((F.sum("n") + F.max("own")).alias("_n"))
    moves = settled(moved.select("key", "target").join(total, "target").select("key", "target", "_n").unionByName(
        total.select(c("target").alias("key"), "target", "_n")))
    out = ["listing_id", "physical", "is_primary", "rep", "head", *own]
    mine = F.when(c("_has_primary") | ~c("_all_secondary"), c("key"))
    rest = told.filter("NOT _row").select(mine.alias("option_id"), "n_members", "plain", *out)
    return rest.unionByName(told.filter("_row").join(moves, "key", "left").select(
        F.coalesce("target", mine).alias("option_id"), F.coalesce("_n", "n_members").alias("n_members"),
        (c("plain") & c("target").isNull()).alias("plain"), *out))


def member_totals(listings: DataFrame, rows: DataFrame) -> DataFrame:
    """The totals of ``coverage_audit`` from ``option_members``: classes and listings are shuffled once each."""
    n = F.count(F.lit(1))
    placed = rows.filter(c("option_id").isNotNull())
    pairs = placed.filter("plain AND rep").select("physical", "n_members", "head").unionByName(_apart(placed))
    one = F.struct(F.lit(0).alias("listings"), F.lit(1).alias("m"), (c("n_members") == 1).alias("st"), (c("n_members") > 1).alias("gr"))
    none = F.lit(None).cast("boolean")
    listed = F.struct(F.lit(1).alias("listings"), F.lit(0).alias("m"), none.alias("st"), none.alias("gr"))
    per = pairs.select("physical", F.inline(F.array(one))).unionByName(
        physical(listings).select("physical", F.inline(F.array(listed)))).groupBy("physical").agg(
        F.sum("listings").alias("listings"), F.sum("m").alias("m"), F.bool_or("st").alias("st"), F.bool_or("gr").alias("gr"))
    number = {"listings": F.coalesce(F.sum("listings"), F.lit(0)), "physical": n, "standalone": F.count_if("st"), "grouped": F.count_if("gr"),
              "memberships": F.coalesce(F.sum("m"), F.lit(0)), "accounted": F.count_if(c("m") > 0), "unaccounted": F.count_if(c("m") == 0)}
    return per.agg(*[e.cast("long").alias(k) for k, e in number.items()]).select(
        "*", F.greatest(c("memberships") - c("accounted"), F.lit(0)).alias("duplicates"), pairs.agg(F.count_if("head")).scalar().alias("options"),
        placed.select("listing_id").distinct().agg(n).scalar().alias("represented"),
        F.when(c("unaccounted") == 0, "passed").otherwise("failed").alias("status"))


def _apart(placed: DataFrame) -> DataFrame:
    """physical, n_members, head: the classes of options that are not ``plain``, told apart by grouping."""
    pairs = placed.filter("NOT plain").groupBy("option_id", "physical").agg(F.max("n_members").alias("n_members"))
    heads = pairs.groupBy("option_id").agg(F.min("physical").alias("_least"))
    return pairs.join(heads, "option_id").select("physical", "n_members", c("physical").eqNullSafe(c("_least")).alias("head"))


def members(bridge: DataFrame, options: DataFrame) -> DataFrame:
    return (bridge.join(options.select(c("option_id").alias("key"), "n_members"), "key")
            .select(c("key").alias("option_id"), "listing_id", "is_primary", "n_members", "physical"))


def published(opts: Options) -> Options:
    """Options and membership stored once in the shared folder, for many searches and seat updates over them."""
    options = settled(opts.options)
    return Options(options, settled(members(opts.bridge, options)), opts.bridge)


def match_options(matched: DataFrame, membership: DataFrame, options: DataFrame) -> DataFrame:
    """Options with a hit on ANY member."""
    hit = membership.join(matched.select("listing_id"), "listing_id", "left_semi").select("option_id")
    return options.join(hit, "option_id", "left_semi")


def physical(df: DataFrame) -> DataFrame:
    return df.withColumn("physical", K.physical_key(c("term"), c("term_code"), c("schedule_number")))


def coverage_audit(listings: DataFrame, opts: Options) -> tuple[DataFrame, DataFrame]:
    """(totals, every unaccounted class with an example).  Fails only when a physical class is lost."""
    lst = physical(listings).select("listing_id", "physical", "course_code", "schedule_number", "component")
    per_option = opts.membership.select("option_id", "physical", "n_members").distinct()
    classes = (per_option.groupBy("physical").agg(
        F.count(F.lit(1)).alias("memberships"), F.bool_or(c("n_members") == 1).alias("standalone"),
        F.bool_or(c("n_members") > 1).alias("grouped")))
    state = (lst.groupBy("physical").agg(F.count(F.lit(1)).alias("listings"))
             .join(classes, "physical", "left"))
    number = {"listings": F.sum("listings"), "physical": F.count(F.lit(1)),
              "standalone": F.count_if("standalone"), "grouped": F.count_if("grouped"),
              "memberships": F.coalesce(F.sum("memberships"), F.lit(0)),
              "accounted": F.count("memberships"), "unaccounted": F.count_if(c("memberships").isNull())}
    listed = opts.membership.select("listing_id").distinct().agg(F.count(F.lit(1)))
    totals = state.agg(*[e.cast("long").alias(n) for n, e in number.items()]).select(
        "*", F.greatest(c("memberships") - c("accounted"), F.lit(0)).alias("duplicates"),
        opts.options.agg(F.count(F.lit(1))).scalar().alias("options"), listed.scalar().alias("represented"),
        F.when(c("unaccounted") == 0, "passed").otherwise("failed").alias("status"))
    lost = (lst.join(classes.select("physical"), "physical", "left_anti").groupBy("physical")
            .agg(F.min_by(F.concat(c("course_code"), F.lit(" schedule #"), c("schedule_number"), F.lit(" ("),
                                   F.coalesce(F.when(F.trim("component") != "", F.trim("component")), F.lit("unknown")),
                                   F.lit(")")), "listing_id").alias("example"), F.min("listing_id").alias("first_id")))
    return totals, lost


class Placement(NamedTuple):
    rows: DataFrame     # listing_id, physical, sure, items (its keys), as stored
    sound: DataFrame    # key of every group that is an option, or moves to one
    moved: DataFrame    # stored: key and target of the groups that move
    rescued: DataFrame  # stored: listing_id, physical of listings that only other members of their groups place


def placement_rows(listings: DataFrame) -> DataFrame:
    """listing_id, physical, items (keys; ``p`` primary, ``s`` primary or not secondary), term and code of listings with row groups."""
    sure = F.transform(option_keys(), lambda k: F.struct(
        k["kind"].alias("kind"), k["key"].alias("key"), k["idx"].alias("idx"), F.coalesce(k["is_primary"], F.lit(False)).alias("p"),
        (F.coalesce(k["is_primary"], F.lit(False)) | ~is_secondary(c("component"))).alias("s")))
    return physical(listings).select("listing_id", "physical", sure.alias("items"), F.when(
        F.size("group_indices") > 0, _term_and_code()).alias("who"))


def placement(listings: DataFrame) -> Placement:
    """Which listings ``group_options`` places, from one read of them and without its options.

    A group with a primary, or with a member that is not secondary, is an option, so a listing that is
    either itself is placed for sure; only the others look their keys up.
    """
    rows = settled(placement_rows(listings)).withColumn("sure", F.exists("items", lambda k: k["s"]))
    flat = rows.select("listing_id", "physical", "sure", "who", F.inline("items"))
    groups = settled(flat.filter("kind = 'row'").groupBy("key", "idx").agg(
        F.bool_or("p").alias("has_primary"), F.min_by("who", "listing_id").alias("who")))
    moved = settled(_alias_targets(groups))
    sound = flat.filter("s").select("key").union(moved.select("key")).distinct()
    doubtful = flat.filter("NOT sure").select("key", "listing_id", "physical")
    rescued = settled(doubtful.join(sound, "key", "left_semi").select("listing_id", "physical"))
    return Placement(rows, sound, moved, rescued)


def lost_classes(placed: Placement) -> DataFrame:
    """``physical`` of every class that no option holds, as in ``coverage_audit``."""
    state = placed.rows.groupBy("physical").agg(F.bool_or("sure").alias("sure")).filter("NOT sure")
    return state.join(placed.rescued.select("physical"), "physical", "left_anti").select("physical")


def placement_counts(placed: Placement) -> DataFrame:
    """One row with the totals of ``coverage_audit`` that need no options: listings, physical, options, unaccounted, unlisted."""
    n = F.count(F.lit(1))
    listed = placed.rows.filter("sure").select("listing_id").union(placed.rescued.select("listing_id")).distinct()
    options = placed.sound.join(placed.moved.select("key"), "key", "left_anti").agg(n).scalar()
    state = placed.rows.groupBy("physical").agg(n.alias("n"))
    return state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("listings"), n.alias("physical")).select(
        "listings", "physical", options.alias("options"), lost_classes(placed).agg(n).scalar().alias("unaccounted"),
        (c("listings") - listed.agg(n).scalar()).alias("unlisted"))


def members_of(opts: Options, listings: DataFrame) -> DataFrame:
    """Flat member rows with their place order (rank, section, schedule, id)."""
    cols = [n for n in listings.columns if n != "listing_id"]
    return (opts.membership.join(listings.select("listing_id", *cols), "listing_id")
            .withColumn("component_rank", component_rank(c("component"))))
