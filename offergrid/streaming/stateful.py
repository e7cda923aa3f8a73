"""Custom state: retry backoff, inventory evidence, late rows, refresh cycles."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from offergrid.operators.sequences import failure_streaks

c = F.col
# Cooldown start, cap and doublings for plain failures and for inventory mismatches.
PLAIN = (60, 1800, 6)
MISMATCH = (1800, 21600, 4)


def cooldown(streak: Column, mismatch: Column) -> Column:
    def delay(first: int, cap: int, doublings: int) -> Column:
        return F.least(F.lit(cap), F.lit(first) * F.pow(F.lit(2), F.least(streak - 1, F.lit(doublings)))).cast("long")

    return F.when(streak > 0, F.when(mismatch, delay(*MISMATCH)).otherwise(delay(*PLAIN)))


def backoff_batch(df: DataFrame, by: str, order, block: int) -> DataFrame:
    """State after the last attempt of every source, from the streak windows."""
    streaks = failure_streaks(df, [by], order, "failure", block)
    last = streaks.groupBy(by).agg(F.max_by(F.struct("ts", "failure", "streak"), "pos").alias("s")).select(by, "s.*")
    wait = cooldown(c("streak"), c("failure") == "mismatch")
    return last.select(by, "failure", "streak", (c("ts").cast("double") + wait).alias("retry_at"))


def backoff_stream(df: DataFrame, by: str, delay: str = "1 hour") -> DataFrame:
    """The same state kept per source in the state store, and a row when its cooldown has ended (update mode).

    ``kind`` is ``state`` for a source that has new attempts and ``due`` for one whose event-time timer has
    fired: the watermark, ``delay`` behind the newest event, is past ``retry_at`` and no newer attempt came.
    The processor is nested so that it travels with the plan.  Attempts of one source are put in event order inside
    a micro-batch; what an earlier change of the failure already separates from the end is dropped
    chunk by chunk, so a task holds two numbers for every attempt of the last streak only.
    """
    plain, mismatch = PLAIN, MISMATCH

    class Backoff(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("streak", "failure STRING, streak LONG, at DOUBLE, retry_at DOUBLE")

        def row(self, source, what):
            failure, streak, _, retry_at = self.state.get()
            return pd.DataFrame({by: [source], "kind": [what], "failure": [failure], "streak": [streak], "retry_at": [retry_at]})

        def handleInputRows(self, key, rows, timers):
            names = []  # failures as numbers; a success is -1
            held = [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            cut = False
            for chunk in rows:
                for name in chunk["failure"].dropna().unique():
                    if name not in names:
                        names.append(name)
                kind = chunk["failure"].map({n: i for i, n in enumerate(names)}).fillna(-1).to_numpy(np.int64)
                new = [chunk["at"].to_numpy(float), chunk["event_id"].to_numpy(np.int64), kind]
                held = [np.concatenate(pair) for pair in zip(held, new)]
                order = np.lexsort((held[1], held[0]))
                held = [x[order] for x in held]
                other = np.flatnonzero(held[2] != held[2][-1])
                if len(other):  # the attempt before the last streak ends all earlier ones
                    cut = True
                    held = [x[other[-1]:] for x in held]
            last = int(held[2][-1])
            failure = names[last] if last >= 0 else None
            run = int((held[2] == last).sum())
            kind, streak = self.state.get()[:2] if self.state.exists() else (None, 0)
            streak = 0 if failure is None else run + (streak if not cut and kind == failure else 0)
            at = float(held[0][-1])
            first, cap, doublings = mismatch if failure == "mismatch" else plain
            wait = min(cap, first * 2 ** min(streak - 1, doublings)) if streak else None
            retry_at = None if wait is None else at + wait
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if retry_at is not None:
                self.handle.registerTimer(math.ceil(retry_at * 1000))
            self.state.update((failure, streak, at, retry_at))
            yield self.row(key[0], "state")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self.row(key[0], "due")

        def close(self) -> None:
            pass

    rows = df.withWatermark("ts", delay).select(by, "event_id", "failure", "ts", c("ts").cast("double").alias("at"))
    return rows.groupBy(by).transformWithStateInPandas(
        statefulProcessor=Backoff(), outputStructType=f"{by} LONG, kind STRING, failure STRING, streak LONG, retry_at DOUBLE",
        outputMode="Update", timeMode="EventTime")


def inventory_stream(grids: DataFrame, expected: DataFrame) -> DataFrame:
    """What the grids of a source say about its class numbers, as a stream (update mode).

    ``grids``: source, grid (in order), complete, right_term, says_empty (the page states that nothing is
    scheduled), numbers; ``expected``: source, number.  The numbers that the newest trustworthy grid left out
    (``missing``) or had beside the expected ones (``unlisted``) stay in the
    state store until the next trustworthy grid; a partial, wrong-term or unrelated one leaves it alone.
    ``status`` is that of the newest grid: ``trusted`` (complete, of the right term, with some expected number), ``different`` (none of
    them, but others), ``unverified`` (the page says it is empty), else ``untrusted``; all numbers are those of one page.
    The state is a running aggregate of Spark's own, a row a source.
    """
    none = F.array().cast("array<string>")
    page = expected.groupBy("source").agg(F.collect_set(c("number").cast("string")).alias("expected"))
    rows = grids.join(page, "source", "left").select(
        "source", c("grid").cast("long").alias("grid"), (c("complete") & c("right_term")).alias("whole"), "says_empty",
        F.coalesce(F.array_distinct(c("numbers").cast("array<string>")), none).alias("seen"), F.coalesce("expected", none).alias("wanted"))
    status = (F.when(~F.coalesce("whole", F.lit(False)), "untrusted").when(F.arrays_overlap("seen", "wanted"), "trusted")
              .when((F.size("seen") > 0) & (F.size("wanted") > 0), "different")
              .when(c("says_empty") & (F.size("seen") == 0), "unverified").otherwise("untrusted"))
    found = F.struct(F.array_sort(F.array_except("wanted", "seen")).alias("missing"), F.array_sort(F.array_except("seen", "wanted")).alias("unlisted"))
    told = rows.select("source", "grid", status.alias("status"), found.alias("found"))
    last = told.groupBy("source").agg(F.max_by(F.struct("grid", "status"), "grid").alias("l"),
                                      F.max_by("found", F.when(c("status") == "trusted", c("grid"))).alias("f"))
    return last.select("source", "l.grid", "l.status", *[F.coalesce(c("f")[n], none).alias(n) for n in ("missing", "unlisted")])


def _state(spark, path: str, batch: int, ddl: str) -> DataFrame:
    """State written by the batch before; empty for the first one."""
    if batch == 0:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{path}/batch={batch - 1}")


def late_splitter(out: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch: rows older than the newest time of earlier batches minus the delay are late."""
    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = _state(spark, f"{out}/state", batch, "newest DOUBLE")
        newest = before.agg(F.max("newest")).scalar()
        late = F.coalesce(c("ts").cast("double") < newest - delay_seconds, F.lit(False))
        df.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{out}/rows/batch={batch}")
        seen = df.agg(F.max(c("ts").cast("double")).alias("newest")).union(before)
        seen.agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{out}/state/batch={batch}")

    return each


def cycle_counter(out: str, registry: DataFrame, by: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: a cycle ends when every source succeeded once since the last end.

    The state is the first success per source since the last end, one row per
    source; each turn of the loop closes one cycle.
    """
    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        total = registry.select(by).distinct().count()
        ddl = f"{by} LONG, at DOUBLE"
        state = _state(spark, f"{out}/state", batch, ddl)
        rows = df.select(by, c("ts").cast("double").alias("at"))
        open_rows, ends = state.union(rows), []
        while True:
            firsts = open_rows.groupBy(by).agg(F.min("at").alias("at"))
            row = firsts.agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("end")).first()
            if total == 0 or row["n"] < total:
                break
            ends.append((row["end"],))
            open_rows = rows.filter(c("at") > row["end"])
        spark.createDataFrame(ends, "ended DOUBLE").write.mode("overwrite").parquet(f"{out}/ends/batch={batch}")
        firsts.write.mode("overwrite").parquet(f"{out}/state/batch={batch}")

    return each
