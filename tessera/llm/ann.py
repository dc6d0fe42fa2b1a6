"""Approximate nearest neighbours by inner product: balanced posting lists.

Inner product becomes distance by one more component, ``sqrt(M*M - |x|*|x|)`` with M the longest vector's norm.
Centroids are fitted on at most ``SAMPLE`` rows (k-means, clusters above twice the mean size split again); every
row is then listed: with its nearest centroid and, near a boundary, with each of up to ``COPIES`` centroids within
``1 + BUILD`` times that distance. A query walks the centroids' neighbour graph, held in memory by each task, and
visits the lists within ``1 + PROBE`` times the distance of its ``REFERENCE``-th nearest centroid (the nearest may
be the query itself), ``VISITS`` at least. Lists are cut into shards of bounded size,
and their queries into chunks, so a vector that a third of all rows hold is no single task. Scores are inner
products of the original vectors in double precision, summed in one order, so equal vectors tie exactly.

Recall against brute force is at least 0.95 on the given tables (see the README). Vectors that are null, zero,
empty or hold null or non-finite components take no part, nor do null ids. Distances are taken of vectors scaled by a
power of two, so that no square overflows; scores that leave double precision are infinite and tie.
Vectors of different lengths are not compared. Repeated ids are one candidate (with their best score) and one query.
An empty table gives no rows, and other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.vectors import dims, finite, matrix

SAMPLE = 20_000
LIST = 200  # rows of a list, on average, before boundary copies
MOST_LISTS = 2048
COPIES, BUILD, PROBE = 8, 0.08, 0.06
REFERENCE, VISITS = 4, 24  # the centroid whose distance the ratio is taken to; lists visited at least
SHARD, CHUNK = 4096, 2048
DEGREE = 24
STARTS, LEAST = 32, 64  # of a walk: first nodes, and nodes expanded at least


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0))


def centroids(x: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Balanced k-means: clusters of over twice the mean size are split in two, the smallest give way."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for step in range(12):
        near = _distances(x, c).argmin(axis=1)
        size = np.bincount(near, minlength=len(c))
        for k in np.flatnonzero(size):
            c[k] = x[near == k].mean(axis=0)
        if step < 9:
            large = np.argsort(-size)[: (size > 2 * len(x) / len(c)).sum()]
            small = np.argsort(size)[: len(large)]
            for a, b in zip(large, small, strict=True):
                if size[b] < size[a] // 4:
                    c[b] = x[rng.choice(np.flatnonzero(near == a))]
    return c


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each centroid's nearest ones and those that it is nearest to, and the next in a ring; padded with itself.

    Edges go both ways, so a cluster far from all others is reached from the ones nearest to it.
    """
    n = len(c)
    d = _distances(c, c)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, : min(degree, n - 1)]
    own = [{(i + 1) % n, *near[i].tolist()} for i in range(n)]
    for i in range(n):
        for j in near[i].tolist():
            own[j].add(i)
    out = np.repeat(np.arange(n)[:, None], max(map(len, own)), axis=1)
    for i, to in enumerate(own):
        out[i, : len(to)] = sorted(to)
    return out


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, ratio: float) -> np.ndarray:
    """(queries, centroids): distance of the visited centroids, infinite elsewhere. Best first.

    A query's walk ends when LEAST nodes are expanded and the nearest other one is beyond `ratio` times its nearest
    centroid.
    """
    n, starts = len(q), np.unique(np.linspace(0, len(c) - 1, min(STARTS, len(c))).astype(int))
    d = np.full((n, len(c)), np.inf)
    d[:, starts] = _distances(q, c[starts])
    open_, live, steps = d.copy(), np.arange(n), 0
    while len(live) and graph.shape[1]:
        node = open_[live].argmin(axis=1)
        reach = open_[live, node]
        going = np.isfinite(reach) & ((steps < LEAST) | (reach <= np.maximum(ratio * d[live].min(axis=1), 1e-9)))
        steps += 1
        live, node = live[going], node[going]
        if not len(live):
            break
        open_[live, node] = np.inf
        to = graph[node]
        new = np.isinf(d[live[:, None], to])
        r, s = np.nonzero(new)
        at = to[r, s]
        dist = np.sqrt(np.maximum(((q[live[r]] - c[at]) ** 2).sum(axis=1), 0))
        d[live[r], at] = dist
        open_[live[r], at] = dist
    return d


def _lists(c, graph, dim, longest, scale):
    """(id, vector, is_query) to (list, kind, id, vector): postings (0) and visits of queries (1)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _lift(matrix(part.column(1), dim) * scale, longest)
                d = _distances(x, c)
                order = np.argsort(d, axis=1)[:, :COPIES]
                near = np.take_along_axis(d, order, axis=1)
                r, s = np.nonzero(near <= (1 + BUILD) * near[:, :1])
                rows, lists, kinds = [r], [order[r, s]], [np.zeros(len(r), np.int32)]
                asks = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                for a in range(0, len(asks), 256):
                    own = asks[a : a + 256]
                    seen = walk(x[own], c, graph, 1 + 2 * PROBE)
                    by = np.sort(seen, axis=1)
                    reach = np.maximum((1 + PROBE) * by[:, min(REFERENCE, len(c)) - 1], by[:, min(VISITS, len(c)) - 1])
                    r, s = np.nonzero(np.isfinite(seen) & (seen <= reach[:, None]))
                    rows.append(own[r]), lists.append(s), kinds.append(np.ones(len(r), np.int32))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), pa.array(np.concatenate(kinds)), part.column(0).take(at), part.column(1).take(at)], names=["list", "kind", "id", "v"])

    return run


def _search(k: int, scale: float):
    def run(key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            ids, x = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.float64)
            qids, q = asks["id"].to_numpy(), np.stack(asks["v"].to_numpy()).astype(np.float64)
            order = np.argsort(ids, kind="stable")
            each = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))  # an id's rows count once
            for i in range(0, len(qids), 256):
                s = (q[i : i + 256] * scale) @ (x * scale).T
                s[qids[i : i + 256, None] == ids[None, :]] = -np.inf
                top = s if len(each) == len(ids) else np.maximum.reduceat(s[:, order], each, axis=1)
                keep = np.partition(top, max(len(each) - k, 0), axis=1)[:, max(len(each) - k, 0)]
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(keep), keep, 0)))
                for r in range(len(s)):
                    c = np.flatnonzero((s[r] >= keep[r] - slack[r]) & np.isfinite(s[r]))
                    if len(c):
                        with np.errstate(over="ignore", invalid="ignore"):
                            exact = (x[c] * q[i + r]).sum(axis=1)
                        far = ~np.isfinite(exact)
                        exact[far] = np.copysign(np.inf, s[r, c[far]])
                        best = np.lexsort((ids[c], -exact))
                        first = np.unique(ids[c][best], return_index=True)[1]
                        best = best[np.sort(first)][:k]
                        out.append(pd.DataFrame({"query_id": qids[i + r], "vec_id": ids[c][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})

    return run


def nearest(df: DataFrame, id_col: str, vec_col: str, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: of rows where is_query holds, the k nearest other rows found."""
    spark, parts = df.sparkSession, []
    v = F.col(vec_col)
    rows = df.where(finite(v) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("is_query"))
    for dim in dims(rows, "v"):
        own = rows.where(F.size("v") == dim)
        most = F.array_max(F.transform("v", lambda x: F.abs(x)))
        n, widest = own.agg(F.count("*"), F.max(most)).first()
        scale = float(2.0 ** -np.frexp(widest)[1])
        longest = own.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * scale) * (x * scale))))).first()[0]
        key = F.xxhash64("id", F.lit(3))
        some = own.where(key.bitwiseAND((1 << 40) - 1) < min(1.0, 1.2 * SAMPLE / n) * (1 << 40)) if n > 2 * SAMPLE else own
        drawn = some.select("v", key.alias("key"), "id").orderBy("key", "id").limit(SAMPLE).select("v").toArrow()
        sample = matrix(drawn.column(0).combine_chunks(), dim) * scale
        c = centroids(_lift(sample, longest), int(np.clip(n // LIST, 1, MOST_LISTS)))
        listed = stored(own.mapInArrow(_lists(c, neighbour_graph(c), dim, longest, scale), "list int, kind int, id bigint, v array<double>"), "ann-lists")
        sizes = listed.groupBy("list").agg(F.sum(F.expr("int(kind = 0)")).alias("n"), F.sum("kind").alias("q"))
        sizes = sizes.select("list", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("q") / CHUNK).cast("int").alias("chunks")).where("shards > 0 and chunks > 0")
        cut = listed.join(F.broadcast(sizes), "list")  # at most MOST_LISTS rows
        each = F.expr("explode(sequence(0, chunks - 1))")
        posts = cut.where("kind = 0").select("list", F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard"), each.alias("chunk"), "id", "v")
        asks = cut.where("kind = 1").select("list", F.expr("explode(sequence(0, shards - 1))").alias("shard"), F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id", "v")
        at = ["list", "shard", "chunk"]
        found = posts.toDF(*at, "id", "v").groupBy(*at).cogroup(asks.toDF(*at, "id", "v").groupBy(*at)).applyInPandas(_search(k, scale), "query_id bigint, vec_id bigint, score double")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        parts.append(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for p in parts:
        out = out.union(p)
    return out
