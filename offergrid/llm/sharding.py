"""Shards of even size by balanced label propagation, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import running, settle

SHARDS = 24
#: Documents that fill up the shards are dealt in classes of size, as parts of a shard's share: the large ones first,
#: so that the smaller ones even out what the large ones left.
CLASSES = (1 / 16, 1 / 256, 1 / 4096)


def _by_shard(rows: DataFrame, shards: int) -> list[int]:
    """Bytes in each shard; one number per shard comes to the driver."""
    sums = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    return [int(sums.get(s) or 0) for s in range(shards)]


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def _propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Move linked documents to the shard that holds most of their group, as far as its quota goes, until none moves.

    It ends: a round moves documents of a group only to one shard that holds at least
    as much of it as theirs, so the sum of squared bytes of (group, shard) grows with every move.
    """
    state = linked
    while True:
        used = _by_shard(state, shards)
        slack = [max(0, capacity - u) for u in used]
        held = state.groupBy("h", "shard").agg(F.sum("size").alias("b"))
        goals = (held.withColumn("free", _pick(slack, F.col("shard"))).filter(F.col("free") > 0).groupBy("h")
                 .agg(F.max(F.struct("b", (-F.col("shard")).alias("s"))).alias("top"))
                 .select(F.col("h").alias("g"), (-F.col("top.s")).alias("goal"), F.col("top.b").alias("weight")))
        own = held.select(F.col("h").alias("oh"), F.col("shard").alias("os"), F.col("b").alias("own"))
        wish = (state.join(goals, F.col("h") == F.col("g"), "left").drop("g")
                .join(own, (F.col("h") == F.col("oh")) & (F.col("shard") == F.col("os")), "left").drop("oh", "os"))
        # a move must lead to a shard that holds more of the group; ties lead to the smaller number
        better = (F.col("weight") > F.col("own")) | ((F.col("weight") == F.col("own")) & (F.col("goal") < F.col("shard")))
        wish = settle(wish.withColumn("goal", F.when(better, F.col("goal"))).drop("weight", "own"), "wish")
        moving = F.col("goal").isNotNull()
        if wish.filter(moving).limit(1).count() == 0:
            return state
        queued = running(wish, ["goal"], [F.col("h"), F.col("doc_id"), F.col("crc")],
                         F.when(moving, F.col("size")).otherwise(F.lit(0)), "ahead")
        fits = moving & (F.col("ahead") + F.col("size") <= _pick(slack, F.coalesce("goal", F.lit(0))))
        moved = settle(queued.withColumn("moved", F.coalesce(fits, F.lit(False)))
                       .withColumn("shard", F.when(F.col("moved"), F.col("goal")).otherwise(F.col("shard"))).drop("goal", "ahead"), "state")
        if moved.filter("moved").limit(1).count() == 0:
            return state
        state = moved.drop("moved")


def _fill(rest: DataFrame, used: list[int], capacity: float, shards: int) -> DataFrame:
    """Deal ``rest`` along the free bytes of the shards, in the order of a hash."""
    free = [max(0.0, capacity - u) for u in used]
    free = free if sum(free) > 0 else [1.0] * shards
    total = int(rest.agg(F.sum("size").alias("b")).first()["b"] or 0)
    bounds, at = [], 0.0
    for f in free:
        at += f * total / sum(free)
        bounds.append(at)
    lined = running(rest, [], [F.xxhash64("doc_id", "h"), F.col("doc_id"), F.col("crc")], F.col("size"), "ahead")
    middle = F.col("ahead") + F.col("size") / 2
    shard = reduce(lambda n, b: n + (middle >= F.lit(b)).cast("int"), bounds[:-1], F.lit(0))
    return lined.withColumn("shard", shard.cast("int")).drop("ahead")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    The law is ``bytes``: shards hold about the same number of bytes.  Documents
    with equal texts are linked.  Linked documents start in a shard by hash; in
    each round those whose group has more bytes in another shard move there, in
    a fixed order and only as far as the shard's free bytes go, until none moves, so
    a group that is larger than a shard spreads over few of them.  Unlinked documents then
    fill every shard up to its share.  Slots count from 0 within a shard by
    doc_id.  A null text is empty; repeated rows are rows of their own and
    linked; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = settle(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                              F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("h")), "base")
    groups = settle(base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("g")), "linked")
    linked = base.join(groups, F.col("h") == F.col("g"), "left_semi")
    capacity = int(base.agg(F.sum("size").alias("b")).first()["b"] or 0) / shards
    start = linked.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    placed = _propagate(settle(start, "start"), shards, int(capacity))
    used = _by_shard(placed, shards)
    rest = base.join(groups, F.col("h") == F.col("g"), "left_anti")
    if max(used) > capacity:  # hashing alone overfilled a shard: what stands beyond its share is dealt anew
        lined = settle(running(placed, ["shard"], [F.col("h"), F.col("doc_id"), F.col("crc")], F.col("size"), "ahead"), "over")
        beyond = F.col("ahead") + F.col("size") > capacity
        rest = rest.unionByName(lined.filter(beyond).select(*rest.columns))
        placed = lined.filter(~beyond).drop("ahead")
        used = _by_shard(placed, shards)
    rest, parts = settle(rest, "rest"), [placed.select(*base.columns, "shard")]
    top = None
    for least in (*CLASSES, 0.0):
        within = F.col("size") > least * capacity
        part = rest.filter(within if top is None else within & (F.col("size") <= top * capacity))
        top = least
        if part.limit(1).count() == 0:
            continue
        dealt = settle(_fill(part, used, capacity, shards), "dealt")
        used = [a + b for a, b in zip(used, _by_shard(dealt, shards), strict=True)]
        parts.append(dealt.select(*base.columns, "shard"))
    whole = reduce(DataFrame.unionByName, parts)
    slotted = running(whole, ["shard"], [F.col("doc_id").asc_nulls_last(), F.col("crc"), F.col("size")], F.lit(1), "slot")
    return slotted.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
