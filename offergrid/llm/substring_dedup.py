"""Substring deduplication with automata of recurring phrases.

Every window of 13 words has an anchor: the least hash among its shingles of 6
words.  Equal windows have equal anchors, and neighbouring windows mostly share
theirs, so a text falls into a few regions, each a run of windows with one
anchor.  Anchors of one document only are dropped at once.  The regions of the
others go, with their words, to the shard of their anchor, where the windows
that recur are confirmed word by word and compiled into an Aho-Corasick
automaton over word numbers; all regions of the shard are streamed through it.
So every document meets exactly the automata that can match it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import settle
from offergrid.llm.words import shingles, slices, word_hashes

WINDOW, ANCHOR = 13, 6
#: Windows in one region at most, documents of an anchor that share one place, and region texts in one automaton.
REGION, HOT, COMPILED = 64, 20_000, 2_000
SHARD_TEXTS = 20_000


def _regions(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """(text, first word, windows, anchor) of every region."""
    words, counts = word_hashes(data, offsets)
    n = len(words)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least, _ = shingles(words, counts, anchor)
    span, have = window - anchor + 1, 1
    while have < span:  # sliding minimum of ``span`` shingles by doubling
        step = min(have, span - have)
        least[:n - step] = np.minimum(least[:n - step], least[step:])
        have += step
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(ends >= np.arange(n) + window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    text, marks = np.repeat(np.arange(len(counts)), counts)[at], least[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (marks[1:] != marks[:-1])
    place = np.arange(len(at))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % REGION == 0
    first = np.flatnonzero(new)
    begin = np.cumsum(counts) - counts
    return text[first], at[first] - begin[text[first]], np.diff(np.append(first, len(at))), marks[first]


def _anchored(window: int, anchor: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in slices(batch.column(1)):
                text, at, size, marks = _regions(data, offsets, window, anchor)
                marks = marks.view(np.int64)
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(ids[first + text]), pa.array(at * 256 + size)],
                                                     names=["h", "doc_id", "place"])
                else:
                    order = np.lexsort((marks, text))
                    text, marks = text[order], marks[order]
                    new = np.ones(len(text), bool)
                    new[1:] = (text[1:] != text[:-1]) | (marks[1:] != marks[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(marks[new]), pa.array(ids[first + text[new]])],
                                                     names=["h", "doc_id"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, version, text, found in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "found")],
                                                 strict=True):
                words = text.encode().split()
                for r in found:
                    at, size = divmod(r["place"], 256)
                    # an anchor of very many documents is dealt out by its windows
                    runs = ((at, size),) if r["parts"] == 1 else ((at + i, 1) for i in range(size))
                    for start, n in runs:
                        body = b" ".join(words[start:start + n + window - 1])
                        out.append((r["h"], zlib.crc32(body) % r["parts"] if r["parts"] > 1 else 0, doc, version, start, body.decode()))
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=["h", "part", "doc_id", "version", "start", "body"])

    return run


def _located(window: int):
    def compiled(texts: list[tuple]) -> Iterator[tuple]:
        """(h, part, body, first document of every window) for the region texts of some anchors."""
        number: dict[str, int] = {}
        coded = [tuple([number.setdefault(w, len(number)) for w in body.split(" ")]) for _, _, body, _, _ in texts]
        seen: dict[tuple, list] = {}
        for words, (_, _, _, low, high) in zip(coded, texts, strict=True):
            for i in range(len(words) - window + 1):
                held = seen.setdefault(words[i:i + window], [low, high])
                if low < held[0]:
                    held[0] = low
                if high > held[1]:
                    held[1] = high
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        confirmed = 0
        for words, (low, high) in seen.items():
            if low < high:
                machine.add_word(words, low)
                confirmed += 1
        if not confirmed:
            return
        machine.make_automaton()
        for words, (h, part, body, _, high) in zip(coded, texts, strict=True):
            firsts: list = [None] * (len(words) - window + 1)
            for end, low in machine.iter(words):
                firsts[end - window + 1] = low
            if any(low is not None and low < high for low in firsts):
                yield h, part, hashlib.md5(body.encode()).hexdigest(), firsts

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        rows = shard.sort_values(["h", "part"], kind="stable")[["h", "part", "body", "low", "high"]]
        out: list[tuple] = []
        batch: list[tuple] = []
        for row in rows.itertuples(index=False, name=None):
            if len(batch) >= COMPILED and row[:2] != batch[-1][:2]:
                out.extend(compiled(batch))
                batch = []
            batch.append(row)
        out.extend(compiled(batch))
        return pd.DataFrame(out, columns=["h", "part", "body_md5", "firsts"])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, shas, texts = [], [], [], []
            for text, starts in zip(batch.column("body"), batch.column("starts"), strict=True):
                words = text.as_py().encode().split()
                starts = starts.as_py()
                left = words
                if starts:
                    mark = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(starts)
                    mark[at] += 1
                    np.add.at(mark, np.minimum(at + window, len(words)), -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                body = b" ".join(left)
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                shas.append(hashlib.sha256(body).hexdigest())
                texts.append(body.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_starts(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, version (hash of the text), starts: the words at which a window of an earlier document begins."""
    spark = docs.sparkSession
    body = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    held = body.mapInArrow(_anchored(window, anchor, False), "h long, doc_id long")
    recurring = settle(held.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                             F.count(F.lit(1)).alias("n")).filter("low < high")
                       .select(F.col("h").alias("g"), (F.col("n") / HOT).cast("int").alias("parts")), "anchors")
    places = body.mapInArrow(_anchored(window, anchor, True), "h long, doc_id long, place long")
    found = settle(places.join(recurring, F.col("h") == F.col("g"))
                   .select("doc_id", "h", "place", (F.col("parts") + 1).alias("parts")), "places")
    by_doc = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("h", "place", "parts")).alias("found"))
    regions = settle(body.join(by_doc, F.col("doc_id") == F.col("id"))
                     .select("doc_id", F.xxhash64("text").alias("version"), "text", "found")
                     .mapInArrow(_cut(window), "h long, part long, doc_id long, version long, start long, body string"), "regions")
    texts = settle(regions.groupBy("h", "part", "body").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "texts")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.count() // SHARD_TEXTS)
    located = settle(texts.withColumn("shard", F.pmod(F.xxhash64("h", "part"), F.lit(shards)))
                     .groupBy("shard").applyInPandas(_located(window), "h long, part long, body_md5 string, firsts array<long>")
                     .select(F.col("h").alias("lh"), F.col("part").alias("lp"), "body_md5", "firsts"), "located")
    keyed = regions.select("h", "part", F.md5("body").alias("m"), "doc_id", "version", "start")
    met = keyed.join(located, (F.col("h") == F.col("lh")) & (F.col("part") == F.col("lp")) & (F.col("m") == F.col("body_md5")))
    starts = F.filter(F.transform("firsts", lambda low, i: F.when(low < F.col("doc_id"), F.col("start") + i)),
                      lambda x: x.isNotNull())
    marked = met.select("doc_id", "version", starts.alias("starts")).filter(F.size("starts") > 0)
    return settle(marked.groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")),
                  "starts")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of ``docs`` (doc_id, text).

    Each word is removed that lies in a window of ``window`` words which also
    starts in a document with a smaller doc_id.  A null text has no words; a
    null doc_id neither gives nor takes; rows with the same doc_id do not take
    from each other; texts shorter than a window stay; other columns are
    ignored; an empty table gives no rows.
    """
    starts = repeated_starts(docs, window, anchor).select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "starts")
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    whole = body.join(starts, (F.col("doc_id") == F.col("id")) & (F.xxhash64("body") == F.col("v")), "left")
    return whole.select("doc_id", "body", "starts").mapInArrow(
        _kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     p AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS body
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
     f AS (SELECT body, min(doc_id) AS low FROM p GROUP BY body HAVING min(doc_id) < max(doc_id)),
     h AS (SELECT DISTINCT p.doc_id, p.i + k AS i FROM p JOIN f ON p.body = f.body AND f.low < p.doc_id, range(0, 13) AS r(k)),
     o AS (SELECT w.doc_id, u.i, u.word, h.i IS NOT NULL AS gone
           FROM (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w) u
           JOIN w USING (doc_id) LEFT JOIN h ON u.doc_id = h.doc_id AND u.i = h.i),
     s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                  coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS body FROM o GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
"""
