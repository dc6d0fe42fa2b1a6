"""QR of tall tables with Q, and the randomised SVD that rests on it.

A tall table has a row (id, vector) for each row of the matrix. Tasks factor blocks of the rows that they read; the
triangles of up to about ``FAN`` blocks are stacked and factored by one group each, level by level, until one is left.
Every group keeps the small orthogonal factor of each of its children. These go back down: what a node is multiplied
by is its own factor times its parent's, so a level is one join on the parent's number, and the rows' own Q is
multiplied last. R's diagonal isn't negative, so Q and R don't depend on how rows are dealt out.

Rows with a null vector take no part; vectors of different lengths fail. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lowrank import jacobi_svd
from tessera.sources.matrices import dropped, stored

BLOCK_ROWS, FAN = 4096, 32


def _leaves(block_rows: int, id_type: pa.DataType):
    names = ["node", "ids", "k", "n", "q", "r"]

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0

        def block(ids, x):
            nonlocal count
            q, r = np.linalg.qr(x)
            count += 1
            cols = [pa.array([task << 32 | count]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([r.shape[0]], pa.int32()), pa.array([r.shape[1]], pa.int32()), pa.array([q.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        ids, xs, held = [], [], 0
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_rows - held)
                ids.append(part.column(0))
                xs.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1))
                at, held = at + part.num_rows, held + part.num_rows
                if held == block_rows:
                    yield block(pa.concat_arrays(ids), np.vstack(xs))
                    ids, xs, held = [], [], 0
        if held:
            yield block(pa.concat_arrays(ids), np.vstack(xs))

    return run


def _array(data, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1)


_STACKED = "node bigint, up bigint, k int, n int, piece binary, r binary"


def _stack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row for each child (node, up, piece) and one of the group's triangle (node null)."""
    pdf = pdf.sort_values("node")
    q, r = np.linalg.qr(np.vstack([_array(x, k) for x, k in zip(pdf["r"], pdf["k"], strict=True)]))
    pieces = [x.tobytes() for x in np.split(q, np.cumsum(pdf["k"])[:-1])]
    up, n = pdf["up"].iloc[0], r.shape[1]
    rows = [(int(node), up, int(k), n, piece, None) for node, k, piece in zip(pdf["node"], pdf["k"], pieces, strict=True)]
    return pd.DataFrame([*rows, (None, up, r.shape[0], n, None, r.tobytes())], columns=["node", "up", "k", "n", "piece", "r"]).astype({"node": "Int64"})


def _down(frames):
    """What each child is multiplied by: its piece times what its parent is multiplied by."""
    for pdf in frames:
        by = [(_array(p, k) @ _array(m, mk)).tobytes() for p, k, m, mk in zip(pdf["piece"], pdf["k"], pdf["by"], pdf["rows"], strict=True)]
        yield pd.DataFrame({"node": pdf["node"], "by": by, "rows": pdf["k"]})


def _rows(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            ids = batch.column(0).slice(r, 1).flatten()
            q = _array(batch.column(1)[r].as_buffer(), len(ids)) @ _array(batch.column(2)[r].as_buffer(), batch.column(3)[r].as_py())
            offsets = np.arange(0, q.size + 1, max(1, q.shape[1]), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, q.ravel())], names=["id", "q"])


def tall_qr(df: DataFrame, id_col: str, vector: str, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> tuple[DataFrame, np.ndarray]:
    """((id, q), R): orthonormal rows of Q by id, and R, which is as wide as the vectors and no higher.

    R comes to the driver; its size is the square of the vectors' length, whatever the number of rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    kind = dict(rows.dtypes)["id"]
    id_type = rows.select("id").limit(0).toArrow().schema.field(0).type
    leaves = stored(rows.mapInArrow(_leaves(block_rows, id_type), f"node bigint, ids array<{kind}>, k int, n int, q binary, r binary"), "qr-leaves")
    now, levels = leaves.select("node", "k", "n", "r"), []
    while True:
        count = now.count()
        if count == 0:
            return spark.createDataFrame([], f"id {kind}, q array<double>"), np.zeros((0, 0))
        if count == 1:
            break
        up = F.pmod(F.xxhash64("node"), F.lit(-(-count // fan)))
        level = stored(now.withColumn("up", up).groupBy("up").applyInPandas(_stack, _STACKED), "qr-level")
        levels.append(level)
        now = level.where("node is null").select(F.col("up").alias("node"), "k", "n", "r")
    top = now.first()
    r = _array(top["r"], top["k"])
    sign = np.where(np.diagonal(r[:, : r.shape[0]]) < 0, -1.0, 1.0)
    by = spark.createDataFrame([(top["node"], bytearray(np.diag(sign).tobytes()), top["k"])], "node bigint, by binary, rows int")
    for level in reversed(levels):
        children = level.where("node is not null").join(by.withColumnsRenamed({"node": "up"}), "up")
        by = children.select("node", "piece", "k", "by", "rows").mapInPandas(_down, "node bigint, by binary, rows int")
    q = stored(leaves.join(by, "node").select("ids", "q", "by", "rows").mapInArrow(_rows, f"id {kind}, q array<double>"), "qr-q")
    dropped(leaves, *levels)
    return q, sign[:, None] * r


def times(cells: DataFrame, vectors: DataFrame, width: int, flip: bool = False) -> DataFrame:
    """(id, q): rows of A X, or of AᵀX if flip, from cells (i, j, v) and rows (id, q) of X: a join and partial sums."""
    row, at = ("j", "i") if flip else ("i", "j")
    joined = cells.join(vectors, F.col(at) == F.col("id"))
    sums = [F.sum(F.col("v") * F.element_at("q", c + 1)) for c in range(width)]
    return joined.groupBy(row).agg(F.array(*sums).alias("q")).select(F.col(row).alias("id"), "q")


def turned(vectors: DataFrame, m: np.ndarray) -> DataFrame:
    """(id, q M) from rows (id, q)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ m
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())], names=["id", "q"])

    return vectors.select("id", "q").mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, q array<double>")


def randomized_svd(cells: DataFrame, rank: int, oversample: int = 6, power: int = 2) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(U, s, V) of a sparse matrix (i, j, v): rows (id, q) of both factors, singular values, largest first.

    The range is found by A times signs that are bits of a column's hash, so that no random matrix is stored; power
    steps multiply by AᵀA and orthonormalise both times. Then QᵀA is factored: a tall QR, and the SVD of its triangle.
    Every product is a join on the index that is contracted, with sums of at most 64 numbers for each row.
    """
    width = rank + oversample
    if width > 64:
        raise ValueError("rank and oversampling are 64 at most")
    a = cells.select("i", "j", F.col("v").cast("double").alias("v"))
    a = a if hasattr(cells, "_stored_at") else stored(a, "rsvd-cells")
    bits = F.xxhash64("j")
    signs = [F.sum(F.when(F.shiftright(bits, c).bitwiseAND(1) == 1, F.col("v")).otherwise(-F.col("v"))) for c in range(width)]
    q, r = tall_qr(a.groupBy("i").agg(F.array(*signs).alias("q")), "i", "q")
    for _ in range(power):
        for flip in (True, False):
            before = q
            q, r = tall_qr(times(a, q, r.shape[0], flip), "id", "q")
            dropped(before)
    qb, rb = tall_qr(times(a, q, r.shape[0], True), "id", "q")
    us, v = jacobi_svd(rb.T)  # A is near Q RbᵀQbᵀ
    size = np.linalg.norm(us, axis=0)
    order = np.argsort(-size)[:rank]
    held = order[size[order] > 0]
    return turned(q, us[:, held] / size[held]), size[held], turned(qb, v[:, held])
