"""How the terms of a source differ from the other sources of its language.

Single-pass in-memory indexing: a task reads its documents once and keeps postings
(language, term, source -> occurrences, documents) until ``BLOCK`` of them are
held, then hands the block on as a run sorted by term.  The shuffle files hold the
runs, cut by hash shards of terms; in a shard Spark's external sort merges them by its
heap, and the merged rows are added up.

For a pair of sources nearly all terms occur in neither or one of them.  What a
source gives a term depends on its count only, so the sum over all terms starts
from the value for a term that neither has, times the number of terms; it is
corrected for what each side has alone through the few distinct counts of a source,
and the postings of terms that several sources have are streamed for the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offergrid.llm.common import settle

LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Occurrences are the low bits of a posting's number, documents the high ones.
SHIFT = 40
ONE, FEW = 1 << SHIFT, (1 << SHIFT) - 1
#: Postings a task holds, characters of a text split at once, and pairs of postings worked on at a time.
BLOCK, LONG_TEXT, PAIRS = 300_000, 4_000_000, 500_000


def _runs(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held, size = re.compile(TERM), {}, 0

        def sorted_run() -> list[pa.RecordBatch]:
            kinds = {"lang": pa.string(), "term": pa.string(), "source": pa.string(), "times": pa.int64(), "docs": pa.int64()}
            parts = [pa.table({"lang": pa.repeat(lang, len(counts)), "term": pa.array(counts, pa.string()), "source": pa.repeat(source, len(counts)),
                               "times": pa.array([n & FEW for n in counts.values()], pa.int64()),
                               "docs": pa.array([n >> SHIFT for n in counts.values()], pa.int64())}) for (lang, source), counts in held.items()]
            held.clear()
            rows = pa.concat_tables(parts) if parts else pa.schema(kinds.items()).empty_table()
            return rows.sort_by("term").combine_chunks().to_batches(max_chunksize=max(1, len(rows))) or [
                pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds.values()], names=list(kinds))]

        for batch in batches:
            for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                low = text.as_py().lower().decode("utf-8")  # of bytes: A-Z only
                here = Counter(terms.findall(low) if len(low) < LONG_TEXT else (m.group() for m in terms.finditer(low)))
                here[""] = 1  # so that a group without terms is known
                counts = held.setdefault((lang, source), {})
                size -= len(counts)
                known = counts.get
                for term, n in here.items():
                    counts[term] = known(term, 0) + n + ONE
                size += len(counts)
                if size >= block:
                    yield from sorted_run()
                    size = 0
        yield from sorted_run()

    return run


def frequencies(docs: DataFrame, least: int = LEAST_DOCS, block: int = BLOCK) -> DataFrame:
    """lang, term, sources, times of every kept term; the term '' names the groups that occur."""
    body = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = body.mapInArrow(_runs(block), "lang string, term string, source string, times long, docs long")
    shards = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    merged = shards.groupBy("lang", "term", "source").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
    rows = merged.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "times")).alias("x"), F.sum("docs").alias("docs")).filter(
        (F.col("docs") >= least) | (F.col("term") == ""))
    return settle(rows.select("lang", "term", F.col("x.source").alias("sources"), F.col("x.times").alias("times")), "terms")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), exact."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, item, value: what two sources that have the same terms differ by from what each gives alone."""

    def gap(p, q):
        return (p - q) * (p - q) // q

    for batch in batches:
        lists = batch.column("cells")
        cells, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        names = cells.field("source").dictionary_encode()
        langs = batch.column("lang").dictionary_encode()
        who, label = names.indices.to_numpy(), names.dictionary
        p, zero = cells.field("p").to_numpy(), cells.field("zero").to_numpy()
        lang_of = np.repeat(langs.indices.to_numpy(), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = np.repeat(sizes, sizes)
        first = 0
        done = np.cumsum(width)
        while first < len(who):  # rows of the pair matrices, so that one long list is worked on in parts too
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + PAIRS, "right")))
            n = width[first:last]
            one = np.repeat(np.arange(first, last), n)
            two = np.repeat(begin[first:last], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            apart = one != two
            one, two = one[apart], two[apart]
            value = gap(p[one], p[two]) - gap(p[one], zero[two]) - gap(zero[one], p[two]) + gap(zero[one], zero[two])
            code = (lang_of[one].astype(np.int64) * len(label) + who[one]) * len(label) + who[two]
            codes, at = np.unique(code, return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, at, value)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(codes // len(label) // len(label))), label.take(pa.array(codes // len(label) % len(label))),
                 label.take(pa.array(codes % len(label))), pa.array(sums)], names=["lang", "source", "item", "value"])
            first = last


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source).

    Null text, lang and source count as empty.  Terms are runs of letters or of
    anything beyond ASCII, A-Z in lower case; a language keeps those in ``least`` of its
    rows.  Part ``pair`` compares a source with each other source of its language
    over all kept terms, part ``term`` names the ``top`` terms it has more of
    than its language.  A group without terms has pairs of value 0 if its language
    keeps none; the only source of a language has no pairs; ties go to the smaller
    item.  Repeated rows count each, an empty table gives no rows, a long text is
    split as a stream, other columns are ignored.  Everything is exact as long as a
    count stays below 10^19.
    """
    terms = frequencies(docs, least, block)
    groups = terms.filter("term = ''").select("lang", F.explode("sources").alias("source"))
    posted = settle(terms.filter("term <> ''").select("lang", "term", F.explode(F.arrays_zip("sources", "times")).alias("x"),
                                                      F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b).alias("all_times"))
                    .select("lang", "term", F.col("x.sources").alias("source"), F.col("x.times").alias("times"), "all_times"), "posted")
    of_source = posted.groupBy("lang", "source").agg(F.sum("times").alias("n"))
    of_lang = terms.filter("term <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b)).alias("lang_n"))
    sized = settle(groups.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n")), "groups")
    zeros = sized.select("lang", "source", "v", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n") + F.col("v"))).otherwise(1).alias("zero"))
    shares = settle(posted.join(sized, ["lang", "source"]).select(
        "lang", "term", "source", _share(F.col("times"), F.col("n") + F.col("v")).alias("p"), _share(F.lit(0), F.col("n") + F.col("v")).alias("zero"),
        _share(F.col("all_times"), F.col("lang_n") + F.col("v")).alias("q")), "shares")

    one = zeros.select("lang", "source", "v", "zero")
    two = zeros.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    pairs = settle(one.join(two, "lang").filter(F.col("source") != F.col("item")), "pairs")
    plain = pairs.select("lang", "source", "item", (F.col("v") * _gap(F.col("zero"), F.col("item_zero"))).alias("value"))
    counts = settle(shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")), "counts")
    base = _gap(F.col("zero"), F.col("item_zero"))
    left = pairs.join(counts, ["lang", "source"]).select(
        "lang", "source", "item", (F.col("k") * (_gap(F.col("p"), F.col("item_zero")) - base)).alias("value"))
    right = pairs.join(counts.withColumnRenamed("source", "item"), ["lang", "item"]).select(
        "lang", "source", "item", (F.col("k") * (_gap(F.col("zero"), F.col("p")) - base)).alias("value"))
    shared = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("cells")).filter(F.size("cells") > 1)
    both = shared.select("lang", "cells").mapInArrow(_corrections, "lang string, source string, item string, value long")
    total = plain.unionByName(left).unionByName(right).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    more = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                         _gap(F.col("p"), F.col("q")).alias("value"))
    best = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # every task cuts its rows to the top first
    return ranked.unionByName(best)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), found AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_c FROM found GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
posted AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM found JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
vs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_c)::HUGEINT AS n FROM kept GROUP BY lang),
ns AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM posted GROUP BY 1, 2),
grid AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(p.c, 0)::HUGEINT AS c,
         1 + (1000000000::HUGEINT * (coalesce(p.c, 0) + 1)) // (coalesce(ns.n, 0) + vs.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_c + 1)) // (vs.n + vs.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN ns USING (lang, source) LEFT JOIN posted p USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), parts AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM grid WHERE c > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""
