"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts, and a small
classifier learns which parts the neighbours of a vector lie in.  The classifier
then places every vector in a part and sends every query to its most probable
parts, where distances are worked out in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offergrid.llm.common import settle

#: Vectors the graph and the classifier are fitted on, at most; parts, at most; vectors a part should hold.
FIT, PARTS, PART_ROWS = 8_192, 64, 400
#: Neighbours in the graph, units of the classifier's hidden layer, rounds of training.
GRAPH, HIDDEN, EPOCHS = 16, 96, 16
#: Recall that the number of parts a query visits is set for, measured on the sample.
AIM = 0.97
BLOCK = 2_000


def _near(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of ``x`` for each of ``rows``."""
    out = np.empty((len(rows), k), np.int64)
    norms = (x * x).sum(1)
    for at in range(0, len(rows), 512):
        part = rows[at:at + 512]
        d = norms[None, :] - 2.0 * (x[part] @ x.T)
        d[np.arange(len(part)), part] = np.inf
        out[at:at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of every row: halves along the main direction, then moves towards neighbours under a capacity."""
    label = np.zeros(len(x), np.int64)
    queue = [(np.arange(len(x)), 0, parts)]
    while queue:
        rows, first, n = queue.pop()
        if n == 1:
            label[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        v = np.ones(y.shape[1])
        for _ in range(12):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-30
        order, half = np.argsort(y @ v, kind="stable"), n // 2
        cut = len(rows) * half // n
        queue += [(rows[order[:cut]], first, half), (rows[order[cut:]], first + half, n - half)]
    capacity = -(-len(x) * 21 // (parts * 20))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        for j in range(graph.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[graph[:, j]]), 1.0)
            np.add.at(votes, (graph[:, j], label), 1.0)
        goal = votes.argmax(1)
        gain = votes[np.arange(len(x)), goal] - votes[np.arange(len(x)), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[goal[i]] < capacity:
                sizes[label[i]] -= 1
                sizes[goal[i]] += 1
                label[i] = goal[i]
                moved += 1
        if moved * 200 < len(x):
            break
    return label


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; ``visits`` parts are searched for a query."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2


def _trained(x: np.ndarray, target: np.ndarray, seed: int) -> Router:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), float(x.std()) + 1e-12
    z, parts = (x - mean) / scale, target.shape[1]
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 128):
            rows = order[at:at + 128]
            h = np.maximum(z[rows] @ p[0] + p[1], 0.0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(1, keepdims=True))
            d = (o / o.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                rate = 0.004 * (1 - epoch / EPOCHS) + 1e-4
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *p, visits=parts)


def fit(x: np.ndarray, parts: int, k: int = 10, aim: float = AIM, seed: int = 7) -> Router:
    """Cut the graph of ``x``, train the classifier and set the visits by recall on the sample."""
    if parts < 2 or len(x) < 4 * GRAPH:
        d = x.shape[1]
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = _near(x, np.arange(len(x)), GRAPH)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    target[np.arange(len(x)), label] = 0.3
    for j in range(GRAPH):
        np.add.at(target, (np.arange(len(x)), label[graph[:, j]]), 0.7 / GRAPH)
    router = _trained(x, target, seed)
    placed = router.scores(x).argmax(1)
    probe = np.linspace(0, len(x) - 1, min(len(x), 600)).astype(int)
    rank = np.argsort(np.argsort(-router.scores(x[probe]), axis=1), axis=1)
    ranks = np.take_along_axis(rank, placed[_near(x, probe, k)], axis=1)
    visits = next(n for n in range(1, parts + 1) if (ranks < n).mean() >= aim)
    return Router(router.mean, router.scale, router.w1, router.b1, router.w2, router.b2, max(visits, min(parts, 2)))


def usable(vector: Column) -> Column:
    """Whether ``vector`` is not null or zero and has only finite components."""
    inf = float("inf")
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def search(vectors: DataFrame, queries: Column, k: int = 10, fit_rows: int = FIT, most_parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row where ``queries`` holds, by Euclidean distance.

    ``vectors`` has vec_id and embedding.  Vectors that are null, zero, hold a
    null or non-finite component or have another length than most take no part,
    nor do rows without an id; rows with a query's id are its own; of repeated
    query ids one row asks.  Ties go to the smaller vec_id.  A query visits more
    parts if those due hold fewer than ``k`` other vectors; other columns are
    ignored; an empty table gives no rows.
    """
    asks = F.coalesce(queries, F.lit(False))
    rows = settle(vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
                  .select("vec_id", F.col("embedding").cast("array<double>").alias("v"), asks.alias("asks")), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rows, total = rows.filter(F.size("v") == lengths["d"]), lengths["count"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").toPandas()  # at most fit_rows vectors
    router = fit(_matrix(sample["v"]), max(1, min(most_parts, total // PART_ROWS)), k)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(part=router.scores(_matrix(f["v"])).argmax(1))

    placed = settle(rows.mapInPandas(place, "vec_id long, v array<double>, asks boolean, part long"), "placed")
    counted = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
    members = np.array([counted.get(i, 0) for i in range(router.parts)])

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            order = np.argsort(-router.scores(_matrix(f["v"])), axis=1, kind="stable")
            reach = np.cumsum(members[order], axis=1)
            need = np.maximum(router.visits, (reach < k + 1).sum(1) + 1)
            yield pd.DataFrame({"query_id": f["vec_id"].repeat(np.minimum(need, router.parts)),
                                "q": f["v"].repeat(np.minimum(need, router.parts)),
                                "part": np.concatenate([o[:n] for o, n in zip(order, need, strict=True)])})

    asked = placed.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = settle(asked.mapInPandas(route, "query_id long, q array<double>, part long"), "routed")
    load = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.array(*[F.lit(int(members[i]) // BLOCK + 1) for i in range(router.parts)])
    loads = F.array(*[F.lit(int(load.get(i, 0)) // BLOCK + 1) for i in range(router.parts)])
    here = (F.col("part") + 1).cast("int")
    # a part is searched in squares of at most about BLOCK vectors by BLOCK queries
    stored = (placed.select("vec_id", "v", "part", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, here)).cast("int").alias("block"),
                            F.explode(F.sequence(F.lit(0), F.element_at(loads, here) - 1)).alias("turn")))
    asking = (routed.select("query_id", "q", "part", F.pmod(F.xxhash64("query_id"), F.element_at(loads, here)).cast("int").alias("turn"),
                            F.explode(F.sequence(F.lit(0), F.element_at(blocks, here) - 1)).alias("block")))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, ids = _matrix(left["v"]), left["vec_id"].to_numpy()
            for query, q in zip(right["query_id"], right["q"], strict=True):
                d = np.sqrt(((x - np.asarray(q)) ** 2).sum(1))
                d[ids == query] = np.inf
                top = np.lexsort((ids, d))[:k] if len(d) <= 4 * k else _top(d, ids, k)
                out += [(query, ids[i], d[i]) for i in top if np.isfinite(d[i])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (stored.groupBy("part", "block", "turn").cogroup(asking.groupBy("part", "block", "turn"))
             .applyInPandas(nearest, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _top(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    bound = np.partition(d, k - 1)[k - 1]
    some = np.flatnonzero(d <= bound)
    return some[np.lexsort((ids[some], d[some]))][:k]
