"""Near-duplicates by BagMinHash signatures over multisets of word shingles, banded and verified.

A shingle that stands c times in a text weighs c.  The weights are cut into
octaves 1, 2, 3-4, 5-8 and so on, each with a Poisson process of its own whose rate
is the octave's width; a point also has a level inside its octave and counts
for a text only if the text's weight reaches that level.  So two texts share
exactly the points of their common weight, and the first point that falls into
a register is the same for both with a probability of their weighted Jaccard
similarity.  An octave is at most twice the weight it holds, so at most half of
the points are drawn in vain; drawing ends for a shingle once its time is past
the text's slowest register.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import free_name, settle
from offergrid.llm.words import mix, shingles, slices, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Ids sent to every executor at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A shingle that no more of the undecided nodes have brings all of them together; it decides what work is done and not what is found.
FEW_NODES = 8
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def bags(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, times it stands there), sorted; a text of fewer than k words is one shingle."""
    words, counts = word_hashes(data, offsets)
    hashes, whole = shingles(words, counts, k)
    texts = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < k))
    owner, value = texts[whole], hashes[whole]
    if len(short):
        firsts, total = ends[short] - counts[short], np.zeros(len(short), _U)
        for j in range(k - 1):
            there = counts[short] > j
            total[there] = mix(total[there] + words[firsts[there] + j])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, total])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, value: np.ndarray, times: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """First arrival in every register of every text (inf for a text without shingles)."""
    who, seed, rate, cover = [owner], [value], [np.ones(len(owner))], [np.ones(len(owner))]
    width = 1
    while (more := np.flatnonzero(times > width)).size:
        who.append(owner[more])
        seed.append(mix(value[more] + _U(width * int(_GOLD) % 2**64)))
        rate.append(np.full(more.size, float(width)))
        cover.append(np.minimum(1.0, (times[more] - width) / width))
        width *= 2
    who, seed, rate, cover = map(np.concatenate, (who, seed, rate, cover))
    first = np.full(texts * registers, np.inf)
    clock = np.zeros(len(who))
    while len(who):
        seed = seed + _GOLD
        a = mix(seed)
        clock = clock - np.log((a >> _U(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
        b = mix(a ^ _GOLD)
        register = ((b >> _U(32)) * _U(registers)) >> _U(32)
        counts = (b & _U(0xFFFFFF)).astype(float) * 2.0**-24 < cover
        np.minimum.at(first, who[counts] * registers + register[counts].astype(np.int64), clock[counts])
        slowest = first.reshape(texts, registers).max(1)
        on = clock < slowest[who]
        who, seed, rate, cover, clock = who[on], seed[on], rate[on], cover[on], clock[on]
    return first.reshape(texts, registers)


def _signed(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                n = end - first
                owner, value, times = bags(data, offsets, k)
                marks = signatures(owner, value, times, n, bands * rows).view(_U).reshape(n, bands, rows)
                keys = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _GOLD, (n, bands))
                for r in range(rows):
                    keys = mix(keys ^ marks[:, :, r])
                size = np.bincount(owner, times, n).astype(np.int64)
                digest = []
                for salt in (_U(1), _U(2)):  # sums over the bag: equal for equal bags, whatever the order
                    total = np.zeros(n, _U)
                    np.add.at(total, owner, mix(mix(value + salt) + times.astype(_U)))
                    digest.append(total.view(np.int64))
                keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1).view(np.int64)), bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(size), pa.array(digest[0]), pa.array(digest[1]),
                     keys.cast(pa.list_(pa.int64()))], names=["doc_id", "size", "d1", "d2", "bands"])

    return run


def similarity(left: pa.Array, right: pa.Array, k: int = WORDS) -> np.ndarray:
    """Weighted Jaccard of the shingle bags of two columns, row by row."""
    out = np.zeros(len(left))
    for i in range(len(left)):
        sides = []
        for column in (left, right):
            one = column.slice(i, 1)
            _, _, data, offsets = next(slices(one))
            sides.append(bags(data, offsets, k)[1:])
        (a, ca), (b, cb) = sides
        _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        common = np.minimum(ca[x], cb[y]).sum()
        out[i] = common / max(1, ca.sum() + cb.sum() - common)
    return out


def _verified(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = similarity(batch.column("ta"), batch.column("tb"), k)
            keep = pa.array(near >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)],
                                             names=["a", "b", "similarity"]).filter(keep)

    return run


def _spread(k: int):
    """Every shingle of every text with its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in slices(batch.column(1)):
                owner, value, times = bags(data, offsets, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + owner]), pa.array(value.view(np.int64)),
                                                  pa.array(times.astype(np.int64))], names=["node", "shingle", "times"])

    return run


def _held(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is counted small enough for every executor; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it is linked to) of every node of ``edges`` (a, b).

    Every round takes the least label among a node's neighbours and then the
    label of that label, so long chains shrink by half and more.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    state = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        known = _held(state.select(F.col("a").alias("k"), "label"))
        near = both.join(known.select(F.col("k").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(
            F.min("theirs").alias("theirs"))
        low = near.join(known, F.col("a") == F.col("k")).select("a", "label", F.least("label", "theirs").alias("low"))
        jump = known.select(F.col("k").alias("low"), F.col("label").alias("next"))
        after = settle(low.join(jump, "low", "left")
                       .select("a", "label", F.least("low", F.coalesce("next", "low")).alias("new")), "labels")
        moved = after.filter(F.col("new") < F.col("label")).limit(1).count()
        state = after.select("a", F.col("new").alias("label"))
        if not moved:
            return state.withColumnRenamed("a", "node")


def widened(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node, label of all nodes of ``labels`` and ``edges`` (a, b) once the edges are added.

    The components found before are the nodes of this search, so an edge takes part in one search only.
    """
    if labels is None:
        return settle(components(edges), "found")
    known = _held(labels).select(F.col("node").alias("k"), F.col("label").alias("lk"))
    one = edges.select("a", "b").join(known, F.col("a") == F.col("k"), "left").select(F.coalesce("lk", "a").alias("a"), "b")
    two = one.join(known, F.col("b") == F.col("k"), "left").select("a", F.coalesce("lk", "b").alias("b")).filter("a <> b")
    more = settle(components(settle(two.distinct(), "between")), "more")
    new = more.select(F.col("node").alias("n"), F.col("label").alias("ln"))
    moved = labels.join(_held(new), F.col("label") == F.col("n"), "left").select("node", F.coalesce("ln", "label").alias("label"))
    return settle(moved.unionByName(more.join(labels.select("node"), "node", "left_anti")), "found")


def groups(docs: DataFrame, k: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of ``docs`` (doc_id, text).

    Words are runs of anything but white space, in lower case; texts of fewer
    than ``k`` words are one shingle; texts without words are alike to nothing.
    Two texts are linked if their bags of shingles have a weighted Jaccard
    similarity of ``least`` or more, and a class holds all that is linked, named
    by its smallest doc_id, which is the one kept.  Rows with the same doc_id
    are one document; a null doc_id is a class of its own; other columns are
    ignored; an empty table gives no rows.

    Texts with equal bags are one node.  In every bucket of a band, each node
    meets the bucket's smallest node.  In buckets that this leaves in several
    components, the shingles that one node alone has bound what it can share:
    nodes that can reach ``least`` with some node meet the most central one of
    the bucket.  Those of two components that are left can only be alike if they
    have a shingle in common that few of them have, so they meet there (``FEW_NODES``
    at most), or if the shingles that many have are enough for both, so they
    meet in their bucket.  So no pair of a bucket that could still join two
    components goes unverified.
    """
    body = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    signed = settle(body.mapInArrow(_signed(bands, rows, k), "doc_id long, size long, d1 long, d2 long, bands array<long>"),
                    "signed")
    there = signed.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    nodes = settle(there.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"),
                                                 F.first("bands").alias("bands")), "nodes")
    keys = nodes.select("node", "size", F.posexplode("bands").alias("band", "key")).select(
        "node", "size", F.xxhash64("band", "key").alias("key"))
    buckets = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).filter("n > 1")
                     .select(F.col("key").alias("bucket"), "pivot"), "buckets")
    held = settle(keys.join(_held(buckets), F.col("key") == F.col("bucket")).select("bucket", "pivot", "node", "size"), "held")
    ids = settle(held.select(F.col("node").alias("id")).distinct(), "ids")
    texts = settle(body.join(_held(ids), F.col("doc_id") == F.col("id"), "left_semi"), "texts")

    def compared(pairs: DataFrame, least: float) -> DataFrame:
        """Pairs of ``least`` similarity or more."""
        one = texts.select(F.col("doc_id").alias("ia"), F.col("text").alias("ta"))
        two = texts.select(F.col("doc_id").alias("ib"), F.col("text").alias("tb"))
        met = two.join(_held(pairs), F.col("b") == F.col("ib")).join(one, F.col("a") == F.col("ia"))
        return settle(met.select("a", "b", "ta", "tb").mapInArrow(_verified(k, least), "a long, b long, similarity double"),
                      "links")

    stars = settle(held.filter(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
                   .distinct(), "stars")
    first = compared(stars, least)
    found = widened(None, first)

    def unresolved(members: DataFrame, found: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component, with ``label`` and the bucket's largest, ``main``."""
        labels = _held(found).select(F.col("node").alias("ln"), "label")
        named = settle(members.join(labels, F.col("node") == F.col("ln"), "left").drop("ln")
                       .withColumn("label", F.coalesce("label", "node")), "named")
        parts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        mains = parts.groupBy(F.col("bucket").alias("mb")).agg(
            F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        mains = _held(settle(mains.select("mb", (-F.col("top.l")).alias("main")), "mains"))
        return named.join(mains, F.col("bucket") == F.col("mb")).drop("mb")

    def could_link(size_a, alone_a, size_b, alone_b):
        """Whether two bags can reach ``least``: no more than what is not theirs alone can be common."""
        common = F.least(F.col(size_a) - F.col(alone_a), F.col(size_b) - F.col(alone_b))
        return common >= F.lit(least) * (F.col(size_a) + F.col(size_b) - common)

    open_now = settle(unresolved(held.select("bucket", "node", "size"), found), "open")
    wanted = open_now.select(F.col("node").alias("id")).distinct()
    spread = settle(texts.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text").mapInArrow(
        _spread(k), "node long, shingle long, times long"), "spread")
    carried = settle(spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("an"), F.min("times").alias("times")), "carried")
    own = settle(carried.filter("nodes = 1").groupBy("an").agg(F.sum("times").alias("alone")), "own")
    able = settle(open_now.join(_held(own), F.col("node") == F.col("an"), "left").drop("an").withColumn("alone", F.coalesce("alone", F.lit(0)))
                  .filter(F.col("size") - F.col("alone") >= F.lit(least) * F.col("size")), "able")
    centres = settle(able.groupBy("bucket").agg(F.min(F.struct((F.col("alone") / F.col("size")).alias("share"), "node")).alias("c"))
                     .select(F.col("bucket").alias("cb"), F.col("c.node").alias("cn")), "centres")
    centred = able.join(_held(centres), F.col("bucket") == F.col("cb")).drop("cb")
    spokes = settle(centred.filter(F.col("node") != F.col("cn"))
                    .select(F.least("node", "cn").alias("a"), F.greatest("node", "cn").alias("b")).distinct(), "spokes")
    measured = compared(spokes, 0.0)
    second = measured.filter(F.col("similarity") >= least)
    away = _held(measured.select(F.col("a").alias("ma"), F.col("b").alias("mb"), "similarity"))
    placed = centred.join(away, (F.least("node", "cn") == F.col("ma")) & (F.greatest("node", "cn") == F.col("mb")), "left").select(
        "bucket", "node", "size", "alone", F.when(F.col("node") == F.col("cn"), 1.0).otherwise(F.col("similarity")).alias("near"))
    found = widened(found, second)
    still = settle(unresolved(placed, found), "still")
    # what two nodes share are shingles that many open nodes have, or that few have: without one of the latter they
    # share no more than the lesser of them has of the former, so only pairs of nodes that are nearly all common shingles go on
    left = settle(still.select("node", "size", "alone", "label").distinct(), "left")
    here = spread.join(_held(left.select(F.col("node").alias("ln"))), F.col("node") == F.col("ln"), "left_semi")
    common = here.join(carried.filter(F.col("nodes") > FEW_NODES).select(F.col("shingle").alias("cs")), F.col("shingle") == F.col("cs"), "left_semi")
    common = settle(common.groupBy(F.col("node").alias("on")).agg(F.sum("times").alias("often")), "common")
    full = settle(still.join(_held(common), F.col("node") == F.col("on")).drop("on").withColumn("rest", F.col("size") - F.col("often"))
                  .filter(F.col("often") >= F.lit(least) * F.col("size")), "full")
    few = full.filter(F.col("label") != F.col("main")).select(
        F.col("bucket").alias("fb"), F.col("node").alias("fn"), F.col("size").alias("fs"), F.col("rest").alias("fr"), F.col("label").alias("fl"), F.col("near").alias("fc"))
    # one minus the similarity is a metric: two nodes are at least as far apart as their distances to the centre differ
    within = F.coalesce(F.abs(F.col("near") - F.col("fc")) <= 1 - least + 1e-9, F.lit(True))
    alike = (full.join(few, (F.col("bucket") == F.col("fb")) & (F.col("label") != F.col("fl")) & could_link("size", "rest", "fs", "fr") & within)
             .select(F.least("node", "fn").alias("a"), F.greatest("node", "fn").alias("b")))
    rare = carried.filter((F.col("nodes") > 1) & (F.col("nodes") <= FEW_NODES)).select(F.col("shingle").alias("rs"))
    held_by = settle(here.join(rare, F.col("shingle") == F.col("rs"), "left_semi").select("shingle", "node")
                     .join(_held(left), "node"), "held-by")
    other = held_by.select(F.col("shingle").alias("os"), F.col("node").alias("fn"), F.col("size").alias("fs"), F.col("alone").alias("fa"), F.col("label").alias("fl"))
    meet = held_by.join(other, (F.col("shingle") == F.col("os")) & (F.col("node") < F.col("fn")) & (F.col("label") != F.col("fl"))
                        & could_link("size", "alone", "fs", "fa")).select(F.col("node").alias("a"), F.col("fn").alias("b"))
    rest = alike.unionByName(meet).distinct().join(stars.unionByName(spokes), ["a", "b"], "left_anti")
    third = compared(settle(rest, "rest"), least)
    found = widened(found, third)
    of_text = settle(signed.filter(F.col("doc_id").isNotNull()).join(nodes.select("d1", "d2", F.col("node").alias("owner")), ["d1", "d2"])
                     .select("doc_id", "owner").distinct(), "owners")
    # a doc_id that stands with several texts joins their classes
    twice = of_text.groupBy("doc_id").agg(F.min("owner").alias("a"), F.max("owner").alias("z")).filter("a <> z")
    several = of_text.join(twice.select(F.col("doc_id").alias("d"), "a"), F.col("doc_id") == F.col("d")).select("a", F.col("owner").alias("b")).filter("a <> b")
    found = widened(found, several)
    named = of_text.groupBy("doc_id").agg(F.min("owner").alias("owner")).join(
        _held(found).select(F.col("node").alias("fn"), "label"), F.col("owner") == F.col("fn"), "left").select(
        F.col("doc_id").alias("node"), F.coalesce("label", "owner").alias("label"))
    named = settle(named, "classes")
    sizes = named.join(signed.select("doc_id"), F.col("node") == F.col("doc_id")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "name")
    classed = named.join(sizes, F.col("label") == F.col("name"))
    out = signed.select("doc_id").join(classed, F.col("doc_id") == F.col("node"), "left")
    class_id = F.coalesce("label", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
                      F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def keep_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns."""
    id_ = free_name(docs, "gone")
    gone = settle(groups(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(id_)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(id_), "left_anti")
