"""Schedule tables: entries, occurrences, conflicts, and adds in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


c = F.col
# Calendar codes of the week days.
DAY_CODES = (("sun", "SU"), ("mon", "MO"), ("tue", "TU"), ("wed", "WE"), ("thu", "TH"), ("fri", "FR"), ("sat", "SA"))


def _timed(m):
    return (F.size(m["days"]) > 0) & m["start_min"].isNotNull() & m["end_min"].isNotNull()


def meeting_entries(df: DataFrame, key: str = "listing_id") -> tuple[DataFrame, DataFrame]:
    """(one row per timed meeting and day, members without one)."""
    timed = (df.select(key, F.posexplode(F.filter("meetings", _timed)).alias("place", "m"))
             .select(key, "place", F.explode("m.days").alias("day"), c("m.start_min").alias("start_min"),
                     c("m.end_min").alias("end_min"), c("m.location").alias("location")))
    return timed, df.filter(~F.exists("meetings", _timed)).select(key)


def _with_dates(df: DataFrame, key: str) -> DataFrame:
    """Meetings with a range and a start time; ``first`` is the first date on each of their days."""
    rows = df.select(key, F.posexplode("meetings").alias("place", "m")).select(
        key, "place", "m.days", "m.date_from", "m.date_to", "m.start_min")
    return rows.withColumn("ok", c("date_from").isNotNull() & c("date_to").isNotNull() & (F.size("days") > 0)
                           & c("start_min").isNotNull())


def _day_runs(days: Column) -> Column:
    """array<struct<day, first, n>>: first date of every week day in the range, and how often it comes."""
    number = F.create_map(*[F.lit(x) for i, (d, _) in enumerate(DAY_CODES) for x in (d, i)])

    def run(day: Column) -> Column:
        ahead = (number[day] - (F.dayofweek("date_from") - 1) + 7) % 7
        first = F.date_add("date_from", ahead)
        return F.struct(day.alias("day"), first.alias("first"),
                        F.greatest(F.floor(F.date_diff("date_to", first) / 7) + 1, F.lit(0)).cast("int").alias("n"))

    return F.filter(F.transform(F.array_distinct(days), run), lambda r: r["n"] > 0)


def meeting_occurrences(df: DataFrame, key: str = "listing_id") -> DataFrame:
    """Every date of every meeting: one weekly sequence per meeting day."""
    rows = _with_dates(df, key).filter("ok AND date_from <= date_to").withColumn("_r", F.explode(_day_runs(c("days"))))
    week = F.expr("INTERVAL 7 DAYS")
    return rows.select(key, "place", F.explode(F.sequence("_r.first", "date_to", week)).alias("date"))


def occurrences_per_date(df: DataFrame, key: str = "listing_id") -> DataFrame:
    """date, n (occurrences), listings (distinct keys): only the meetings are shuffled by key, as date arrays, not every occurrence."""
    counts = meeting_occurrences(df, key).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    rows = _with_dates(df, key).filter("ok AND date_from <= date_to").withColumn("_r", _day_runs(c("days")))
    week = F.expr("INTERVAL 7 DAYS")
    dates = F.flatten(F.transform("_r", lambda r: F.sequence(r["first"], c("date_to"), week)))
    own = rows.select(key, dates.alias("_d")).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("_d"))).alias("_d"))
    return counts.join(own.select(F.explode("_d").alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("listings")), "date")


def meeting_recurrence(df: DataFrame, key: str = "listing_id") -> DataFrame:
    """First date, day codes and count per meeting; ``skipped`` where range or time is missing.

    Worked out from week days alone; no date is listed.
    """
    codes = F.create_map(*[F.lit(x) for kv in DAY_CODES for x in kv])
    rows = _with_dates(df, key).withColumn("_r", F.when(c("ok") & (c("date_from") <= c("date_to")), _day_runs(c("days"))))
    some = F.coalesce(F.size("_r") > 0, F.lit(False))
    total = F.aggregate("_r", F.lit(0), lambda a, r: a + r["n"])
    return rows.select(key, "place", F.when(some, F.array_min(F.transform("_r", lambda r: r["first"]))).alias("first_date"),
                       F.when(some, F.array_join(F.transform(F.array_distinct("days"), lambda d: codes[d]), ","))
                        .alias("by_days"),
                       F.when(some, total).otherwise(0).alias("n"), (~some).alias("skipped"))


SLOT = ("grp", "day", "start_min", "end_min", "date_from", "date_to")


#: Half minutes of a day and more; powers of two of them are the nodes of the sweep.
LEVELS = 13


def _points(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last half minute inside an interval; one without length is the point itself."""
    empty = end <= start
    return F.when(empty, 2 * start).otherwise(2 * start + 1), F.when(empty, 2 * start).otherwise(2 * end - 1)


def _cover(first: Column, last: Column) -> Column:
    """The fewest nodes (level, number) whose half minutes make up ``first`` to ``last``: two a level at most."""
    nodes = []
    for k in range(LEVELS):
        low, high = F.shiftright(first + F.lit((1 << k) - 1), k), F.shiftright(last + 1, k)
        nodes += [F.when((low < high) & (low % 2 == 1), F.struct(F.lit(k).alias("level"), low.alias("node"))),
                  F.when((low < high) & (high % 2 == 1), F.struct(F.lit(k).alias("level"), (high - 1).alias("node")))]
    return F.filter(F.array(*nodes), lambda n: n.isNotNull())


def _above(point: Column) -> Column:
    """The node of every level that holds a half minute."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(point, k).alias("node")) for k in range(LEVELS)])


def schedule_conflicts(picked: DataFrame, candidates: DataFrame) -> DataFrame:
    """First conflicting pick per candidate.

    Both sides: grp, key, ord, day, start_min, end_min, date_from, date_to (one
    row per meeting and day).  Two intervals overlap if one holds the other's start.
    An interval is covered by a few power-of-two nodes of the day and a start lies in one node a
    level, so both cases are equi joins on nodes.  Picks are folded to the first one
    per node and dates before the join; a (grp, day) then has no more rows than nodes times
    date ranges, however many intervals crowd into an hour.  Dates are compared after the join.
    A candidate that is picked already is left out; one that ends before it starts counts as a point.
    """
    candidates = candidates.join(picked.select("grp", "key"), ["grp", "key"], "left_anti")
    timed = picked.filter("start_min IS NOT NULL AND end_min IS NOT NULL")
    cand = candidates.filter("start_min IS NOT NULL AND end_min IS NOT NULL")
    first, last = _points(c("start_min"), c("end_min"))

    def spread(df: DataFrame, side: str, nodes: Column, *keep: str) -> DataFrame:
        return df.select("grp", "day", (c("end_min") <= c("start_min")).alias(f"{side}_point"), *[c(n).alias(f"{side}_{n}") for n in SLOT[2:]], *keep,
                         F.explode(nodes).alias("n")).select("*", "n.level", "n.node").drop("n")

    def folded(nodes: Column, case: int) -> DataFrame:
        rows = spread(timed.withColumn("pick", F.struct("ord", "key")), "p", nodes, "pick")
        return rows.groupBy("grp", "day", "level", "node", "p_date_from", "p_date_to", "p_point").agg(F.min("pick").alias("first")).withColumn(
            "case", F.lit(case))

    q = cand.select(*SLOT).distinct()
    asked = spread(q, "q", _above(first)).withColumn("case", F.lit(1)).unionByName(spread(q, "q", _cover(first, last)).withColumn("case", F.lit(2)))
    held = folded(_cover(first, last), 1).unionByName(folded(_above(first), 2))
    dates = (F.coalesce(c("q_date_from") <= c("p_date_to"), F.lit(True))
             & F.coalesce(c("p_date_from") <= c("q_date_to"), F.lit(True)))
    hit = (asked.join(held, ["grp", "day", "level", "node", "case"]).filter(dates & ~(c("q_point") & c("p_point")))
           .groupBy("grp", "day", *["q_" + n for n in SLOT[2:]]).agg(F.min("first").alias("first")))
    hit = hit.withColumnsRenamed({"grp": "q_grp", "day": "q_day"})
    on = F.lit(True)
    for n in SLOT:
        on = on & c(n).eqNullSafe(c("q_" + n))
    return cand.join(hit, on).groupBy("grp", "key").agg(F.min("first")["key"].alias("conflict_with"))


def _fold():
    """A class that takes the adds and removes of one grp in order; made here so that it travels with the plan."""
    from bisect import bisect_left, bisect_right

    class Held:
        """Accepted items, and per week day their meetings sorted by start, with the dates they run.

        Meetings of one day may share their hours if their dates are apart, so a look-up goes from the
        longest meeting before the start up to the end.
        """

        def __init__(self):
            self.items, self.days = {}, {}

        def meets(self, slots) -> bool:
            for day, start, end, first, last in slots:
                if start is None or end is None or day not in self.days:
                    continue
                starts, kept, longest = self.days[day]
                for _, until, f, t, _ in kept[bisect_right(starts, start - longest):bisect_left(starts, end)]:
                    if start < until and (first is None or t is None or first <= t) and (f is None or last is None or f <= last):
                        return True
            return False

        def add(self, item, slots) -> None:
            self.items[item] = slots
            for day, start, end, first, last in slots:
                if start is not None and end is not None:
                    starts, kept, longest = self.days.get(day, ([], [], 0))
                    at = bisect_right(starts, start)
                    starts.insert(at, start)
                    kept.insert(at, (start, end, first, last, item))
                    self.days[day] = (starts, kept, max(longest, end - start))

        def remove(self, item) -> None:
            for day in {x[0] for x in self.items.pop(item)} & self.days.keys():
                kept = [x for x in self.days[day][1] if x[4] != item]
                self.days[day] = ([x[0] for x in kept], kept, max((x[1] - x[0] for x in kept), default=0))

        def take(self, action, item, slots) -> str:
            if action == "remove":
                if item not in self.items:
                    return "not_held"
                self.remove(item)
                return "removed"
            if item in self.items:
                return "duplicate"
            if self.meets(slots):
                return "conflict"
            self.add(item, slots)
            return "accepted"

    return Held


def _adds(df: DataFrame) -> DataFrame:
    """The columns of an add; dates as day numbers, unknown where there are none."""
    dates = [F.unix_date(n).alias(n) if n in df.columns else F.lit(None).cast("int").alias(n) for n in ("date_from", "date_to")]
    return df.select("grp", "day", "ord", "action", "item", "start_min", "end_min", *dates)


def accept_schedule(adds: DataFrame) -> DataFrame:
    """Each add is accepted, a duplicate, or refused for a conflict; removes free the slot.

    ``adds``: grp, day, ord (in time order), action, item, start_min, end_min, and
    date_from, date_to if meetings end within the term; one row per meeting, and rows with one
    (grp, ord) are the meetings of one add, taken or refused together.  Two
    meetings conflict on a shared day if their hours overlap and their dates do, or
    are unknown; one without hours conflicts with none.  The order is
    sequential by nature.  Rows stream through sorted partitions: a task holds
    the accepted items of one grp and the meetings of one add, never the rows of the grp.
    """
    held_by = _fold()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, add = None, held_by(), []

        def decide() -> list[tuple]:
            nonlocal now, held
            if not add:
                return []
            grp, _, order, action, item = add[0][:5]
            if grp != now:
                now, held = grp, held_by()
            said = held.take(action, item, [(r[1], *r[5:]) for r in add])
            return [(grp, r[1], order, item, said) for r in add]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 5, kinds)],
                                              names=["grp", "day", "ord", "item", "result"])

        for batch in batches:
            rows = []
            for row in zip(*[x.to_pylist() for x in batch.columns]):
                if add and (row[0], row[2]) != (add[0][0], add[0][2]):
                    rows += decide()
                    add = []
                add.append(row)
            yield out(rows)
        yield out(decide())

    return (_adds(adds).repartition("grp").sortWithinPartitions("grp", "ord")
            .mapInArrow(fold, "grp long, day string, ord long, item long, result string"))


def accept_schedule_stream(adds: DataFrame) -> DataFrame:
    """The same over a stream of adds (update mode): the accepted meetings of a grp are a list in the state store.

    Rows of a grp are put in order within a micro-batch, whose size the source limits.
    """
    held_by = _fold()

    class Schedule(StatefulProcessor):
        def init(self, handle) -> None:
            self.meetings = handle.getListState("meetings", "item LONG, day STRING, start_min INT, end_min INT, date_from INT, date_to INT")

        def handleInputRows(self, key, rows, timers):
            held, known = held_by(), {}
            for item, *slot in self.meetings.get():
                known.setdefault(item, []).append(tuple(slot))
            for item, slots in known.items():
                held.add(item, slots)
            adds = {}
            for batch in rows:
                clean = batch.astype(object).where(batch.notna(), None)
                for r in clean.itertuples(index=False):
                    adds.setdefault(r.ord, []).append(r)
            out = []
            for order in sorted(adds):
                add = adds[order]
                slots = [(r.day, *[None if x is None else int(x) for x in (r.start_min, r.end_min, r.date_from, r.date_to)]) for r in add]
                said = held.take(add[0].action, add[0].item, slots)
                out += [(key[0], r.day, order, r.item, said) for r in add]
            left = [(item, *slot) for item, slots in held.items.items() for slot in slots]
            if left:
                self.meetings.put(left)
            else:
                self.meetings.clear()
            yield pd.DataFrame(out, columns=["grp", "day", "ord", "item", "result"])

        def close(self) -> None:
            pass

    return _adds(adds).groupBy("grp").transformWithStateInPandas(
        statefulProcessor=Schedule(), outputStructType="grp LONG, day STRING, ord LONG, item LONG, result STRING",
        outputMode="Update", timeMode="None")
