"""Ordered operators that survive a key holding a large part of the table.

``numbered`` gives every row its place inside its key with ``ranked`` and cuts
the key into blocks of equal size.  Running values are worked out inside the
blocks, then a short summary per block carries them on; windows of bounded
length copy the last rows of a block into the next.  No task sees more of a key
than one block plus one line per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offergrid.operators.ordering import CHUNK_ROWS, ranked

c = F.col


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], block: int = CHUNK_ROWS) -> DataFrame:
    """Add ``pos`` (1, 2, …) and ``block`` within ``by``."""
    return ranked(df, order, by=by, out="pos").withColumn("block", F.floor((c("pos") - 1) / block))


def _inside(by: Sequence[str]):
    return Window.partitionBy(*by, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _earlier(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def carry_last(df: DataFrame, by: Sequence[str], columns: Sequence[str], into: Sequence[str]) -> DataFrame:
    """Last non-null value up to and including each row, for several columns."""
    tails = df.groupBy(*by, "block").agg(*[
        F.max_by(c(n), F.when(c(n).isNotNull(), c("pos"))).alias(f"_t{i}") for i, n in enumerate(columns)])
    before = tails.select(*by, "block", *[F.last(f"_t{i}", ignorenulls=True).over(_earlier(by)).alias(f"_b{i}")
                                          for i in range(len(columns))])
    out = df.withColumns({f"_h{i}": F.last(n, ignorenulls=True).over(_inside(by)) for i, n in enumerate(columns)})
    return (out.join(before, [*by, "block"], "left")
            .withColumns({name: F.coalesce(f"_h{i}", f"_b{i}") for i, name in enumerate(into)})
            .drop(*[f"_{k}{i}" for k in "hb" for i in range(len(columns))]))


def running_sum(df: DataFrame, by: Sequence[str], value: Column, into: str) -> DataFrame:
    marked = df.withColumn("_v", value)
    sizes = marked.groupBy(*by, "block").agg(F.sum("_v").alias("_s"))
    before = sizes.select(*by, "block", F.coalesce(F.sum("_s").over(_earlier(by)), F.lit(0)).alias("_b"))
    return (marked.withColumn("_h", F.sum("_v").over(_inside(by))).join(before, [*by, "block"], "left")
            .withColumn(into, c("_h") + c("_b")).drop("_v", "_h", "_b"))


def with_context(df: DataFrame, rows: int, block: int) -> DataFrame:
    """Copy the last ``rows`` rows of each block into the next one, marked ``is_context``."""
    if rows > block:
        raise ValueError("a window longer than a block needs larger blocks")
    tail = (c("pos") - 1) % block >= block - rows
    own = F.struct(c("block").alias("block"), F.lit(False).alias("is_context"))
    ahead = F.struct((c("block") + 1).alias("block"), F.lit(True).alias("is_context"))
    places = F.filter(F.array(own, F.when(tail, ahead)), lambda x: x.isNotNull())
    rest = [n for n in df.columns if n != "block"]
    return df.select(*rest, F.inline(places))


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str],
                  block: int = CHUNK_ROWS) -> DataFrame:
    """Blank values take the last value above them."""
    return carry_last(numbered(df, by, order, block), by, columns, columns).drop("block")


def running_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], is_label: Column,
                  block: int = CHUNK_ROWS) -> DataFrame:
    """A new group at each labelled row; rows before the first label are group 1."""
    out = running_sum(numbered(df, by, order, block), by, F.when(is_label, 1).otherwise(0), "_g")
    return out.withColumn("grp", F.greatest(c("_g"), F.lit(1))).drop("_g", "block")


def failure_streaks(df: DataFrame, by: Sequence[str], order: Sequence[Column], kind: str,
                    block: int = CHUNK_ROWS) -> DataFrame:
    """``streak`` = length of the current run of failures of one ``kind`` (null is a success)."""
    placed = with_context(numbered(df, by, order, block), 1, block)
    w = Window.partitionBy(*by, "block").orderBy("pos")
    starts = (placed.withColumn("_p", F.lag(kind).over(w)).filter("NOT is_context").drop("is_context")
              .withColumn("_start", F.when(c(kind).isNull() | ~c(kind).eqNullSafe(c("_p")), c("pos"))))
    out = carry_last(starts, by, ["_start"], ["_from"])
    return out.withColumn("streak", F.when(c(kind).isNull(), 0).otherwise(c("pos") - c("_from") + 1).cast("long")) \
        .drop("_p", "_start", "_from", "block")


def recent_stats(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, last: int = 100,
                 block: int = CHUNK_ROWS) -> DataFrame:
    """Mean and nearest-rank p95 over the last ``last`` rows."""
    placed = with_context(numbered(df, by, order, block), last - 1, block)
    w = Window.partitionBy(*by, "block").orderBy("pos").rowsBetween(-(last - 1), 0)
    seen = F.sort_array(F.collect_list(value).over(w))
    return (placed.withColumn("mean", F.avg(value).over(w)).withColumn("_l", seen)
            .withColumn("p95", F.element_at("_l", F.ceil(F.size("_l") * 95 / 100).cast("int")))
            .filter("NOT is_context").drop("is_context", "_l", "block"))


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; an aggregate, so no window and no hot task."""
    rest = [n for n in df.columns if n not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        *by, *[c("_r")[n].alias(n) for n in rest])


def option_signature(rows: DataFrame, row: Sequence[str], member: str, place: str) -> DataFrame:
    """Signature per row (its sorted class numbers joined with “+”), back on each class.

    The text has this one form for rows of any size; distinct classes are taken
    out first with partial aggregates, so a row's list holds each class once.
    """
    members = rows.groupBy(*row, member).agg(F.min(place).alias("_p"))
    heads = members.groupBy(*row).agg(F.min_by(member, F.struct("_p", member)).alias("_first"),
                                      F.array_join(F.array_sort(F.collect_list(member)), "+").alias("signature"))
    return members.join(heads, list(row)).select(*row, member, "signature", (c(member) == c("_first")).alias("is_primary"))


def heading_context(lines: DataFrame, page: str, pos: str, level: str, text: str) -> DataFrame:
    """For every item line (null level) the active headings, nearest first.

    A heading is active until one of its own or a higher level comes.  The
    window runs over the lines of one stored page, which arrived as one row.
    """
    w = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    seen = {f"_l{k}": F.last(F.when(c(level) == k, F.struct(c(pos).alias("p"), c(text).alias("t"))), ignorenulls=True)
            .over(w) for k in range(1, 7)}
    out = lines.withColumns(seen).filter(c(level).isNull())
    active = []
    for k in range(6, 0, -1):
        higher = F.greatest(*[F.coalesce(c(f"_l{j}.p"), F.lit(-1)) for j in range(1, k)], F.lit(-1)) if k > 1 else F.lit(-1)
        active.append(F.when(c(f"_l{k}.p") > higher, c(f"_l{k}.t")))
    labels = F.filter(F.array(*active), lambda x: x.isNotNull())
    return out.withColumn("labels", labels).drop(*seen)


def refresh_queue(sources: DataFrame, now: Column, preferred: str, priority_seconds: int = 180) -> DataFrame:
    """Ordered work list: manual, viewed, then routine with four preferred to one other.

    ``sources``: source_url, term, last_success, last_attempt, retry_after,
    manual, viewed.  Cooling sources wait, except manual ones.  Other terms take
    turns.
    """
    ready = F.coalesce(c("retry_after") <= now, F.lit(True))
    waited = F.coalesce(now.cast("double") - c("last_attempt").cast("double") >= priority_seconds, F.lit(True))
    tier = F.when(c("manual"), 1).when(c("viewed") & ready & waited, 2).when(ready, 3)
    pool = F.when(tier < 3, tier).when(c("term") == preferred, 3).otherwise(4)
    rows = sources.withColumn("tier", tier).filter(c("tier").isNotNull()).withColumn("pool", pool)
    rows = rows.withColumn("turn_of", F.when(c("pool") == 4, c("term")).otherwise(""))
    oldest = F.when(c("pool") == 2, c("last_attempt")).otherwise(c("last_success"))
    placed = ranked(rows.withColumn("_o", oldest), [c("_o").asc_nulls_first(), c("source_url").asc()],
                    by=["pool", "turn_of"], out="rn")
    turns = ranked(placed, [c("rn").asc(), c("turn_of").asc()], by=["pool"], out="prn")
    slot = F.when(c("pool") == 3, c("prn") + F.floor((c("prn") - 1) / 4)).when(c("pool") == 4, c("prn") * 5) \
        .otherwise(c("prn"))
    return ranked(turns.withColumn("slot", slot), [c("tier").asc(), c("slot").asc()], out="queue_pos").select(
        "source_url", "term", "tier", "queue_pos")
