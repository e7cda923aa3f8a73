"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import WORD, free_name, running, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, none above ``most`` times its source.

    Sources are ordered by code point, null last, and the weights repeat.  With
    the sources sorted by limit / weight, those before the water line stop at
    their limit and the others share what is left by weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = running(sources, [], [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                                       (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    weighed = settle(weighed.withColumn("limit", most * F.col("source_size"))
                     .withColumn("level", F.col("limit") / F.col("weight")), "weights")
    order = [F.col("level"), F.col("source").asc_nulls_last()]
    lined = running(weighed, [], order, F.col("limit"), "limit_before")
    lined = settle(running(lined, [], order, F.col("weight"), "weight_before"), "lined")
    total = lined.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    line = ((F.col("words") * F.lit(float(share)) - F.col("limit_before")) / (F.col("weights") - F.col("weight_before")))
    # one row of totals, read as two scalar subqueries
    words, all_weights = total.select("words").scalar(), total.select("weights").scalar()
    lined = lined.withColumn("words", words).withColumn("weights", all_weights).withColumn("line", line)
    level = lined.filter(F.col("line") <= F.col("level")).agg(F.min_by("line", F.struct("level", F.coalesce(F.col("source"), F.lit("\U0010ffff"))))).scalar()
    return lined.select("source", "source_size", F.least(F.col("limit").cast("double"), F.coalesce(level, F.col("level"))
                                                         * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of ``docs``.

    Within its source a document stands at the place of a hash of its id; the
    words before it are a distributed running sum.  The source takes whole
    rounds (epochs) of all its documents and of the last round the documents up
    to the budget; the one at the cut gives only the words that still fit.
    ``copies`` is the same in whole documents: the one at the cut counts if at
    least half of it fits.  A null text has no words, a null source is a source
    of its own, repeated rows count each; an empty table gives no rows.
    """
    sizes = settle(docs.select("doc_id", "source", words_of(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, weights, share, most)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = running(sizes.withColumn("key", key), ["source"], [F.col("key"), F.col("doc_id"), F.col("size")],
                     F.col("size"), "start")
    t = targets.withColumnRenamed("source", "_source")
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    rest = budget - F.col("rounds") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))).cast("long")
    return (placed.join(t, placed["source"].eqNullSafe(t["_source"]), "left").drop("_source", "key")
            .withColumn("rounds", rounds).withColumn("rest", rest).withColumn("part", part)
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("rounds") * F.col("size") + F.col("part")).alias("taken"),
                    (F.col("rounds") + ((F.col("start") < F.col("rest")) & (2 * F.col("part") >= F.col("size")))
                     .cast("int")).cast("int").alias("copies")))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows alike in id, source and size are numbered and their copies dealt out: as
    many whole rounds as all get, and one more to the first ones.
    """
    id_, source, size, copies, rows, words = (free_name(docs, n) for n in ("id", "source_", "size", "copies", "rows", "words"))
    plan = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    plan = settle(plan.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), copies, rows)
                  .filter(F.col(copies) > 0), "plan")
    met = docs.withColumn(words, words_of(F.col("text"))).join(
        plan, F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size)))
    packed = met.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_).alias("id"), F.col(source).alias("source"),
                        F.col(size).alias("size"), F.col(copies).alias("copies"), F.col(rows).alias("rows"))
    alone, alike = packed.filter("rows = 1").withColumn("at", F.lit(0).cast("long")), packed.filter("rows > 1")
    if alike.select("id").limit(1).count():  # rows without an id, or repeated ones
        order = [F.md5(F.coalesce("row.text", F.lit("")))]
        alone = alone.unionByName(running(settle(alike, "alike"), ["id", "source", "size"], order, F.lit(1), "at"))
    share = F.floor(F.col("copies") / F.col("rows")) + (F.col("at") < F.col("copies") % F.col("rows")).cast("int")
    dealt = alone.withColumn("share", share.cast("int")).filter("share > 0")
    return dealt.withColumn("round", F.explode(F.sequence(F.lit(1), F.col("share")))).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size,
                  [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
     l AS (SELECT *, 2 * source_size AS most, (2 * source_size)::DOUBLE / weight AS level,
                  sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weights FROM s),
     b AS (SELECT *, coalesce(sum(most) OVER w, 0)::BIGINT AS most_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
           FROM l WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     c AS (SELECT *, (words * 1.5::DOUBLE - most_before) / (weights - weight_before) AS line FROM b),
     v AS (SELECT line AS water FROM c WHERE line <= level ORDER BY level, source NULLS LAST LIMIT 1),
     t AS (SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT water FROM v), level) * weight) AS target FROM c),
     p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id::VARCHAR), d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
     r AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM p)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(size, budget - rounds * source_size - start)))::BIGINT AS taken FROM r
"""
