"""Near-duplicates by 64-bit SimHash and pigeonring filtering.

A fingerprint is a ring of ``SEGMENTS`` segments.  If two differ in at most ``BITS``
bits, some segment starts a chain all of whose fronts stay within their share:
the first k segments together differ in no more than ``k * BITS // SEGMENTS`` bits.
The first shares are zero, so these segments of the chain are equal and are
the key of a bucket; inside a bucket the longer fronts prune a pair before its
full Hamming distance is counted.

Many fingerprints of one cluster meet in the same buckets.  Those of a bucket
with more than ``CROWD`` members are linked by what lies between them instead: two
differ in at most 2 bits exactly if one fingerprint is within one bit of both, and
all that are within one bit of the same are at most 2 bits apart.  So each of them
names itself and its 64 neighbours, and those that name the same (65 at most)
are linked to the smallest.  That is exact and linear in a crowd's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offergrid.llm.common import settle
from offergrid.llm.near_dedup import components

SHINGLE, SEED, BITS, SEGMENTS, CROWD = 3, 42, 2, 16, 8
#: Shingles hashed at a time.
SLICE = 50_000


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text in UTF-8, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= k:
        return int.from_bytes(digest(joined, seed), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.append(0, ends[:-k]), ends[k - 1:] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE):
        pairs = zip(starts[at:at + SLICE].tolist(), ends[at:at + SLICE].tolist())
        marks = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8)
        ones += np.unpackbits(marks.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _prints(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), k, seed) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], names=["doc_id", "mark"])

    return run


def _turned(mark: Column, bits: int) -> Column:
    """The ring turned left by ``bits``."""
    return mark if bits == 0 else F.shiftleft(mark, bits).bitwiseOR(F.shiftrightunsigned(mark, 64 - bits))


def links(marks: DataFrame, bits: int = BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """a, b: links that join the same fingerprints of ``marks`` (mark; distinct) as all pairs within ``bits`` bits do.

    ``crowd`` bounds the pairs of a bucket; above it the exact way for crowds takes over, which is made for 2 bits.
    """
    if bits != 2 or 64 % segments:
        raise ValueError("made for 2 bits and segments that divide 64")
    width = 64 // segments
    share = [k * bits // segments for k in range(segments + 1)]
    equal = max(k for k in range(segments + 1) if share[k] == 0)
    rings = marks.select("mark", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), _turned(F.col("mark"), i * width).alias("ring"))
                                                     for i in range(segments)])).alias("x")).select("mark", "x.start", "x.ring")
    keyed = settle(rings.withColumn("front", F.shiftrightunsigned("ring", 64 - equal * width)), "rings")
    buckets = settle(keyed.groupBy("start", "front").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    held = keyed.join(buckets, ["start", "front"])
    few = settle(held.filter(F.col("n") <= crowd).select("start", "front", "mark", "ring"), "few")
    other = few.select(F.col("start").alias("s"), F.col("front").alias("f"), F.col("mark").alias("b"), F.col("ring").alias("turned"))
    apart = F.col("ring").bitwiseXOR(F.col("turned"))
    chain = F.lit(True)
    for k in range(equal + 1, segments + 1):
        chain = chain & (F.bit_count(apart if k == segments else F.shiftrightunsigned(apart, 64 - k * width)) <= share[k])
    pairs = few.join(other, (F.col("start") == F.col("s")) & (F.col("front") == F.col("f")) & (F.col("mark") < F.col("b")) & chain).filter(
        F.bit_count(F.col("mark").bitwiseXOR(F.col("b"))) <= bits).select(F.col("mark").alias("a"), "b")
    many = held.filter(F.col("n") > crowd).select("mark").distinct()
    around = F.array(F.col("mark"), *[F.col("mark").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    between = many.select("mark", F.explode(around).alias("point"))
    least = F.min("mark").over(Window.partitionBy("point"))  # at most 65 rows
    stars = between.select("mark", least.alias("a")).filter("a < mark").select("a", F.col("mark").alias("b"))
    return pairs.union(stars).distinct()


def linked(docs: DataFrame, k: int = SHINGLE, seed: int = SEED, bits: int = BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links for every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z in lower case; a text of
    fewer than ``k`` words is one shingle; one without words, null among them, has
    the fingerprint zero and is linked like any other.  ``component_id`` is the
    smallest doc_id reachable; a null doc_id is linked but names no component
    unless there is no other.  Repeated rows are rows of one fingerprint; an empty
    table gives no rows; long texts are hashed in slices; other columns are ignored.
    """
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = settle(body.mapInArrow(_prints(k, seed), "doc_id long, mark long"), "prints")
    marks = settle(printed.groupBy("mark").agg(F.min("doc_id").alias("least")), "marks")
    near = settle(links(marks.select("mark"), bits, segments, crowd), "links")
    found = components(near)
    joined = marks.join(found, F.col("mark") == F.col("node"), "left").select("mark", "least", F.coalesce("label", "mark").alias("label"))
    joined = settle(joined, "joined")
    firsts = joined.groupBy(F.col("label").alias("named")).agg(F.min("least").alias("component_id"))
    named = joined.join(firsts, F.col("label") == F.col("named")).select(F.col("mark").alias("m"), "component_id")
    return printed.join(named, F.col("mark") == F.col("m")).select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
