"""Exact top-k by inner product of integer vectors: distributed histogram selection.

Queries come in blocks of a bounded size, and a pass over the table scores ``BLOCKS`` of them against every row: each
pass counts scores in 512 bins of every query's current range and keeps the bin that holds the k-th highest, until that
bin is one value wide. A last pass keeps what is above that value, and of what equals it the smallest ids. A task reports
of each query only the bins down to its own k-th score, and at most k rows, so nothing grows with the table. The
number of passes does, with the number of queries: each multiplies ``BLOCK * BLOCKS`` vectors by all rows.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with null ids. Scores of
pairs so long that 64 bits may not hold them are computed with whole numbers of any size; a query with such a score
among its k highest fails, as does a component of 2^62 or more. Vectors of different lengths are not compared. Repeated query ids
are one query, with the first of their vectors in order (the rows with that id are no candidates of it); other repeated
rows are candidates each. An empty table gives no rows, and other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.vectors import dims, finite, matrix

BLOCK = 2048  # queries scored together
BLOCKS = 8  # of queries, that one pass over the table serves
BINS = 512
_EXACT = float(1 << 53)
_LIMIT = (1 << 62) - 1  # scores beyond count as this


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products (queries, rows); by floating point where every partial sum is exact there."""
    if len(x) and len(q) and np.abs(q).max() * float(np.abs(x).max()) * q.shape[1] < _EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    out = q @ x.T
    norms = [np.linalg.norm(m.astype(np.float64), axis=1) for m in (q, x)]
    for r, c in zip(*np.nonzero(np.outer(*norms) > 0.99 * _LIMIT), strict=True):  # may have wrapped around
        out[r, c] = max(-_LIMIT, min(_LIMIT, sum(a * b for a, b in zip(q[r].tolist(), x[c].tolist(), strict=True))))
    return out


def _blocks(batches, dim: int, rows: int = 512):
    for batch in batches:
        ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim, np.int64)
        for i in range(0, len(ids), rows):
            yield ids[i : i + rows], x[i : i + rows]


class _Block:
    """Queries and the range in which each one's k-th score lies: `span` values from `lo` on, of which `need` are wanted."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, bound: float, k: int):
        reach = int(np.ceil(np.linalg.norm(q.astype(np.float64), axis=1).max(initial=0) * bound)) + 1
        self.qid, self.q, self.reach = qid, q, min(reach, _LIMIT)
        self.lo, self.span = np.full(len(qid), -self.reach, np.int64), np.full(len(qid), 2 * self.reach + 1, np.int64)
        self.need, self.few = np.full(len(qid), k, np.int64), np.zeros(len(qid), bool)  # few: fewer than k candidates

    @property
    def width(self) -> np.ndarray:
        return -(-self.span // BINS)

    def narrow(self, got: dict[int, tuple]) -> None:
        """got: of each query the bin that holds its k-th score, and how many candidates are above it."""
        width = self.width
        for i in range(len(self.qid)):
            b, above = got.get(i, (None, None))
            if b is None:
                self.few[i], self.span[i], self.lo[i] = True, 1, -self.reach
            elif not self.few[i]:
                self.span[i] = min(width[i], self.span[i] - b * width[i])
                self.lo[i] += b * width[i]
                self.need[i] -= above


def _histogram(asks: list[_Block], k: int, step: int):
    """Rows (query's number, bin, candidates); a block's queries are numbered from its place times `step`."""

    def run(batches):
        counts = [np.zeros(len(x.qid) * BINS, np.int64) for x in asks]
        for ids, v in _blocks(batches, asks[0].q.shape[1]):
            for x, c in zip(asks, counts, strict=True):
                s, n = _scores(x.q, v), len(x.qid)
                at = (s - x.lo[:, None]) // x.width[:, None]
                ok = (s >= x.lo[:, None]) & (s < (x.lo + x.span)[:, None]) & (ids[None, :] != x.qid[:, None])
                c += np.bincount((np.arange(n)[:, None] * BINS + at)[ok], minlength=n * BINS)
        for b, c in enumerate(counts):
            c = c.reshape(-1, BINS)
            above = np.cumsum(c[:, ::-1], axis=1)[:, ::-1] - c
            r, at = np.nonzero((c > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array((r + b * step).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(c[r, at])], names=["q", "bin", "n"])

    return run


def _select(asks: list[_Block], k: int):
    """Rows above each query's k-th value; of those at it, the smallest ids."""

    def run(batches):
        best: list[list[list]] = [[[] for _ in x.qid] for x in asks]
        for ids, v in _blocks(batches, asks[0].q.shape[1]):
            for x, own in zip(asks, best, strict=True):
                s = _scores(x.q, v)
                ok = (s >= x.lo[:, None]) & (ids[None, :] != x.qid[:, None])
                for r in np.flatnonzero(ok.any(axis=1)):
                    c = np.flatnonzero(ok[r])
                    own[r] += zip((-s[r, c]).tolist(), ids[c].tolist(), strict=True)
                    if len(own[r]) > 4 * k:
                        own[r] = sorted(own[r])[:k]
        rows = [(int(x.qid[r]), v, -s) for x, own in zip(asks, best, strict=True) for r, b in enumerate(own) for s, v in sorted(b)[:k]]
        cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _top(rows: DataFrame, asks: list[_Block], k: int) -> DataFrame:
    step = max(len(x.qid) for x in asks)
    while any((x.span > 1).any() for x in asks):
        found = rows.mapInArrow(_histogram(asks, k, step), "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        found = found.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))))
        need = [(i + b * step, int(v)) for b, x in enumerate(asks) for i, v in enumerate(x.need)]
        found = found.join(rows.sparkSession.createDataFrame(need, "q int, need bigint"), "q").where("upto >= need")
        got = found.groupBy("q").agg(F.max("bin").alias("bin"), F.min(F.col("upto") - F.col("n")).alias("above")).collect()  # a row for each query of the blocks
        for b, x in enumerate(asks):
            x.narrow({r[0] - b * step: (r[1], r[2]) for r in got if r[0] // step == b})
    out = rows.mapInArrow(_select(asks, k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    held = F.when(F.abs("score") < _LIMIT, F.col("score")).otherwise(F.raise_error(F.lit("a score doesn't fit 62 bits")).cast("long"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))


def exact_top_k(df: DataFrame, id_col: str, vec_col: str, is_query, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where is_query holds, the k rows of highest score among all others.

    Components count as floor(scale * x).
    """
    spark, parts = df.sparkSession, []
    ok = finite(F.col(vec_col)) & F.col(id_col).isNotNull()
    large = F.raise_error(F.lit("a component doesn't fit 62 bits")).cast("long")
    whole = lambda x: F.when(F.abs(x.cast("double") * scale) < float(_LIMIT), F.floor(x.cast("double") * scale).cast("long")).otherwise(large)
    ints = df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, whole).alias("v"), is_query.alias("is_query"))
    ints = stored(ints, "topk-ints")
    for dim in dims(ints, "v"):
        rows = ints.where(F.size("v") == dim)
        queries = rows.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
        n = queries.count()
        if not n:
            continue
        bound = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()[0]
        blocks = -(-n // BLOCK)
        queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "topk-queries")
        for b in range(0, blocks, BLOCKS):
            asks = []
            for own in (queries.where(F.col("block") == c).orderBy("id").select("id", "v").toArrow() for c in range(b, min(b + BLOCKS, blocks))):  # about BLOCK rows
                if own.num_rows:
                    asks.append(_Block(own.column(0).to_numpy(), matrix(own.column(1).combine_chunks(), dim, np.int64), bound, k))
            parts.append(stored(_top(rows.select("id", "v"), asks, k), "topk"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return spark.read.schema(parts[0].schema).parquet(*[p._stored_at for p in parts])
