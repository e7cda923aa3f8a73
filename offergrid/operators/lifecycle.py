"""Term and offering replacement: plans over whole tables, audits of what changes, and changes in place.

A change touches the options of the listings that go and come, and the row groups
that share a term, code and index with one of them.  ``audit_delta`` groups only
these again, before and after, so an audit after a change is the audit before plus
a difference.  The ``apply_`` functions write the touched parts of a published table only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.functions import keys as K
from offergrid.functions.text import is_placeholder, squeeze
from offergrid.operators.options import group_options, option_bridge, physical, placement, placement_counts
from offergrid.operators.rollups import duplicate_keys, set_changes
from offergrid.session import settled
from offergrid.sources import partitions as P

c = F.col


class Replaced(NamedTuple):
    table: DataFrame
    counts: DataFrame


def incoming_term(incoming: DataFrame) -> tuple[str, str | None]:
    """The one term of a dataset and its code; one small aggregate row is read."""
    row = incoming.agg(F.count_distinct(F.trim("term")).alias("terms"), F.min(F.trim("term")).alias("term"),
                       F.count_distinct(F.when(F.trim("term_code") != "", F.trim("term_code"))).alias("codes"),
                       F.min(F.when(F.trim("term_code") != "", F.trim("term_code"))).alias("code")).first()
    if row["terms"] != 1:
        raise ValueError(f"incoming rows must hold exactly one term, found {row['terms']}")
    if row["codes"] > 1:
        raise ValueError(f"incoming rows must hold one term code, found {row['codes']}")
    return row["term"], row["code"]


def matches_term(term: str, code: str | None) -> Column:
    same = F.lower(F.trim("term")) == term.strip().lower()
    if code:
        same = same | F.coalesce(F.trim("term_code") == code, F.lit(False))
    return same


def require_unique(df: DataFrame, context: str) -> None:
    bad = duplicate_keys(df).limit(1).collect()
    if bad:
        raise ValueError(f"duplicate {bad[0]['kind']} in {context}: {bad[0]['key']}")


def replace_term(active: DataFrame, incoming: DataFrame, check_unique: bool = True) -> Replaced:
    """Drop the incoming term from the active table and put the new rows in.

    The term is a literal in the filter, so a table partitioned by term skips
    the replaced partition instead of joining.
    """
    term, code = incoming_term(incoming)
    gone = matches_term(term, code)
    table = active.filter(~gone).unionByName(incoming)
    if check_unique:
        require_unique(table, f"the table after installing {term}")
    n = F.count(F.lit(1))
    counts = active.agg(n.alias("before"), F.count_if(gone).alias("replaced")).select(
        F.lit(term).alias("term"), incoming.agg(n).scalar().alias("incoming"), "replaced",
        (c("before") - c("replaced")).alias("preserved")).withColumn("after", c("preserved") + c("incoming"))
    return Replaced(table, counts)


def retire_term(active: DataFrame, term: str, allow_empty: bool = False) -> Replaced:
    """Refused when nothing matches, or when nothing would be left."""
    gone = F.lower(F.trim("term")) == term.strip().lower()
    counts = active.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("remaining"),
                        F.count_distinct(F.when(~gone, c("term"))).alias("remaining_terms"))
    row = counts.first()
    if row["removed"] == 0:
        raise ValueError(f"no rows of term {term!r}")
    if row["remaining"] == 0 and not allow_empty:
        raise ValueError("retiring the last term would leave an empty table")
    return Replaced(active.filter(~gone), counts)


AUDIT = ("listings", "physical", "options", "unaccounted", "unlisted")


def audit_counts(listings: DataFrame) -> DataFrame:
    """One row of ``AUDIT``: the totals of the whole audit; ``unlisted`` counts the listings in no option."""
    return placement_counts(placement(listings)).select(*AUDIT)


def audit_delta(active: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """One row of ``AUDIT``: how the totals change when the listings ``gone`` leave ``active`` and ``come`` join it.

    ``gone`` are rows of ``active``, named by listing_id; ids of ``come`` are new or those of ``gone``.
    """
    where = F.struct("idx", F.lower(F.trim("term")).alias("t"), F.upper(F.trim("course_code")).alias("c"))

    def flat(df: DataFrame) -> DataFrame:
        return option_bridge(df).select("key", "listing_id", "physical", F.when(c("kind") == "row", where).alias("who"))

    now, new = flat(active), flat(come)
    out = now.join(gone.select("listing_id"), "listing_id", "left_semi")
    all_rows = settled(now.unionByName(new).distinct())
    names = all_rows.filter("who IS NOT NULL").select("key", "who").distinct()

    def neighbours(keys: DataFrame) -> DataFrame:
        """The keys, and the row groups that may be or find a home for one of them."""
        near = names.join(keys, "key", "left_semi").select("who").distinct()
        return settled(keys.select("key").union(names.join(near, "who", "left_semi").select("key")).distinct())

    touched = neighbours(out.select("key").union(new.select("key")).distinct())
    classes = settled(all_rows.join(touched, "key", "left_semi").select("physical").union(physical(gone).select("physical"))
                      .union(physical(come).select("physical")).distinct())
    needed = neighbours(all_rows.join(classes, "physical", "left_semi").select("key").distinct())
    ids = settled(all_rows.join(needed, "key", "left_semi").select("listing_id").union(gone.select("listing_id")).distinct())
    part = active.join(ids, "listing_id", "left_semi")
    after = part.join(gone.select("listing_id"), "listing_id", "left_anti").unionByName(come)
    # rows of other classes stand in groups that are not whole here: only the touched options and classes count
    def counts(df: DataFrame, sign: int) -> DataFrame:
        opts = group_options(df)
        mine = physical(df).join(classes, "physical", "left_semi").select("physical", "listing_id")
        placed = opts.membership.select("physical", "listing_id").distinct()
        state = mine.join(placed.select("listing_id").distinct().withColumn("_in", F.lit(1)), "listing_id", "left").groupBy("physical").agg(
            F.count(F.lit(1)).alias("n"), F.count("_in").alias("n_in"))
        number = opts.options.join(touched.select(c("key").alias("option_id")), "option_id", "left_semi").agg(F.count(F.lit(1))).scalar()
        return state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("listings"), F.count(F.lit(1)).alias("physical"),
                         F.count_if(c("n_in") == 0).alias("unaccounted"), F.coalesce(F.sum(c("n") - c("n_in")), F.lit(0)).alias("unlisted")).select(
            *[(sign * c(x)).cast("long").alias(x) for x in ("listings", "physical", "unaccounted", "unlisted")], (sign * number).cast("long").alias("options"))

    both = counts(part, -1).unionByName(counts(after, 1))
    return both.agg(*[F.sum(x).alias(x) for x in AUDIT])


class AuditFailed(ValueError):
    """The change would leave classes that no option shows."""


class Rotation:
    """``table`` and ``changes`` are plans; ``counts``, with the audit, is worked out when it is asked for."""

    def __init__(self, table: DataFrame, changes: DataFrame, count: Callable[[], DataFrame]):
        self.table, self.changes, self._count = table, changes, count

    @cached_property
    def counts(self) -> DataFrame:
        return self._count()


def rotate(active: DataFrame, incoming: DataFrame, retire: str, known: DataFrame | None = None) -> Rotation:
    """Retire one term and install another; ``counts.status`` is the audit of the result.

    With ``known``, the audit of ``active`` (``AUDIT``, as kept with a published table), only the options
    that change are grouped, else those of the whole result.
    """
    term, code = incoming_term(incoming)
    if squeeze_text(term) == squeeze_text(retire):
        raise ValueError("the incoming and the retired term are the same")
    old = F.lower(squeeze(c("term"))) == squeeze_text(retire)
    same = matches_term(term, code)
    kept = active.filter(~old & ~same)
    table = kept.unionByName(incoming)

    def counts() -> DataFrame:
        audit = settled(audit_counts(table)) if known is None else _after(active, active.filter(old | same), incoming, known)
        n = F.count(F.lit(1))
        return active.agg(n.alias("before"), F.count_if(old).alias("retired"), F.count_if(same & ~old).alias("replaced")) \
            .select(F.lit(term).alias("incoming_term"), "before", "retired", "replaced",
                    incoming.agg(n).scalar().alias("incoming"), *[audit.select(x).scalar().alias(x) for x in AUDIT]) \
            .withColumn("status", F.when(c("unaccounted") == 0, "passed").otherwise("failed"))

    retiring = active.filter(old)
    named = F.when(~is_placeholder(c("instructor")), squeeze(c("instructor")))

    def people(df: DataFrame) -> DataFrame:
        return df.select(named.alias("instructor")).filter("instructor IS NOT NULL")

    changes = (set_changes(incoming, retiring, "subject").withColumn("what", F.lit("subject"))
               .union(set_changes(incoming, retiring, "course_code").withColumn("what", F.lit("course")))
               .union(set_changes(people(incoming), people(kept), "instructor").filter("change = 'added'")
                      .withColumn("what", F.lit("instructor"))))
    return Rotation(table, changes, counts)


def _after(active: DataFrame, gone: DataFrame, come: DataFrame, known: DataFrame | None) -> DataFrame:
    """The audit after a change: the one before and the difference."""
    before = settled((known if known is not None else audit_counts(active)).select(*AUDIT))
    return settled(before.unionByName(audit_delta(active, gone, come).select(*AUDIT)).agg(*[F.sum(x).alias(x) for x in AUDIT]))


def squeeze_text(value: str) -> str:
    return " ".join(value.split()).lower()


def offering() -> Column:
    return K.detail_key(c("subject"), c("crse_id"), c("course_code"), c("offer"), c("career"))


class KeyReplacement:
    """``table``, ``class_changes`` and ``counts`` are plans; ``report``, with both audits, is worked out when it is asked for."""

    def __init__(self, table: DataFrame, class_changes: DataFrame, counts: DataFrame, describe: Callable[[], DataFrame]):
        self.table, self.class_changes, self.counts, self._describe = table, class_changes, counts, describe

    @cached_property
    def report(self) -> DataFrame:
        return self._describe()


def replace_keys(active: DataFrame, incoming: DataFrame, keys: DataFrame, term: str, known: DataFrame | None = None) -> KeyReplacement:
    """Replace only the chosen offerings of one term.

    ``keys``: offering; ``known``: the audit of ``active``, else it is worked out.  The report counts
    keys missing on either side and both audits; ``ok`` holds when the key sets agree and
    neither unaccounted count rises.
    """
    a, b = active.withColumn("offering", offering()), incoming.withColumn("offering", offering())
    k = settled(keys.select("offering").distinct())
    here = a.filter(c("term") == term).join(k, "offering", "left_semi")
    rest = a.filter(c("term") != term).unionByName(a.filter(c("term") == term).join(k, "offering", "left_anti"))
    table = rest.unionByName(b).drop("offering")

    def missing(x: DataFrame, y: DataFrame) -> Column:
        return x.select("offering").distinct().join(y.select("offering").distinct(), "offering", "left_anti") \
            .agg(F.count(F.lit(1))).scalar()

    n = F.count(F.lit(1))
    counts = here.agg(n.alias("current")).select(
        "current", b.agg(n).scalar().alias("incoming"), rest.agg(n).scalar().alias("preserved"),
        missing(k, b).alias("not_incoming"), missing(b, k).alias("unexpected"), missing(k, here).alias("not_active"))

    def report() -> DataFrame:
        before = settled((known if known is not None else audit_counts(active)).select(*AUDIT))
        # where nothing is known, a second audit is cheaper than grouping what the change touches before and after
        after = settled(audit_counts(table)) if known is None else _after(active, here.drop("offering"), incoming, before)
        out = counts.select("*", *[x.select(m).scalar().alias(f"{m}_{when}") for m in ("unaccounted", "unlisted")
                                   for x, when in ((before, "before"), (after, "after"))])
        return out.withColumn("ok", (c("not_incoming") == 0) & (c("unexpected") == 0) & (c("not_active") == 0)
                              & (c("unaccounted_after") <= c("unaccounted_before")) & (c("unlisted_after") <= c("unlisted_before")))

    return KeyReplacement(table, set_changes(physical(b), physical(here), "physical"), counts, report)


def _kept_audit(spark, target: str) -> DataFrame | None:
    """The audit that was published with the table."""
    facts = (P.P.newest(spark, target) or {}).get("facts", {}).get("audit")
    return spark.createDataFrame([[facts[x] for x in AUDIT]], ", ".join(f"{x} long" for x in AUDIT)) if facts else None


def _facts(audit: DataFrame) -> dict[str, int]:
    row = audit.first()  # one row of totals
    return {x: row[x] for x in AUDIT}


def publish_terms(listings: DataFrame, target: str) -> dict:
    """A table in parts by term, with its audit beside the pointer."""
    require_unique(listings, "the table")
    return P.publish_parts(listings, target, "term", P.known_parts(listings.sparkSession, target), audit=_facts(audit_counts(listings)))


def _change(target: str, active: DataFrame, gone: Column, come: DataFrame, audit: DataFrame) -> dict:
    """Rewrite the parts that hold a row to go or take one that comes; all other files stay as they are."""
    spark = active.sparkSession
    part = P.part_of(c("term"))
    touched = [r[0] for r in active.filter(gone).select(part.alias("p")).union(come.select(part.alias("p"))).distinct().collect()]  # terms
    staying = P.read_parts(spark, target, touched).filter(~F.coalesce(gone, F.lit(False)))
    others = active.filter(~F.coalesce(gone, F.lit(False))).select("listing_id")
    twice = others.join(come.select("listing_id"), "listing_id", "left_semi").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate id {twice[0][0]} in the table after the change")
    rows = staying.unionByName(come)
    require_unique(rows, "the changed parts")
    return P.publish_parts(rows, target, "term", touched, audit=_facts(audit))


def apply_replace_term(spark, target: str, incoming: DataFrame) -> dict:
    """Put one term into a published table; parts without a row of it keep their files."""
    active = P.read_parts(spark, target)
    gone = matches_term(*incoming_term(incoming))
    audit = _after(active, active.filter(gone), incoming, _kept_audit(spark, target))
    return _change(target, active, gone, incoming, audit)


def apply_rotation(spark, target: str, incoming: DataFrame, retire: str) -> dict:
    """Retire a term and install another at once.

    Refused if the retired term is not there, if it is the incoming one, or if the audit of
    the result fails; the table then stays as it was.
    """
    active = P.read_parts(spark, target)
    plan = rotate(active, incoming, retire, _kept_audit(spark, target))
    row = plan.counts.first()
    if row["retired"] == 0:
        raise ValueError(f"no rows of term {retire!r}")
    if row["status"] != "passed":
        raise AuditFailed(f"{row['unaccounted']} classes would be in no option after the rotation")
    gone = (F.lower(squeeze(c("term"))) == squeeze_text(retire)) | matches_term(*incoming_term(incoming))
    return _change(target, active, gone, incoming, plan.counts.select(*AUDIT))


def apply_replace_keys(spark, target: str, incoming: DataFrame, keys: DataFrame, term: str) -> dict:
    """Replace the chosen offerings of one term; refused unless the key sets agree and the audit gets no worse."""
    active = P.read_parts(spark, target)
    known = _kept_audit(spark, target)
    report = replace_keys(active, incoming, keys, term, known).report.first()
    if not report["ok"]:
        raise AuditFailed(f"the replacement does not hold: {report.asDict()}")
    chosen = [r[0] for r in keys.select("offering").distinct().collect()]  # the keys a caller names
    gone = (c("term") == term) & offering().isin(chosen)
    return _change(target, active, gone, incoming, _after(active, active.filter(gone), incoming, known))
