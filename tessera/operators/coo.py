"""Products and copies of coordinate matrices: joins and group sums that Catalyst plans."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TASK_CELLS, TASK_PRODUCTS = 1 << 19, 1 << 21  # of a product with hot keys: cells of both sides in a task, and what it multiplies, about


def view(m: DataFrame, i0: int, j0: int, ny: int, nx: int) -> DataFrame:
    """The ny by nx part that starts at (i0, j0), with coordinates of its own."""
    inside = F.col("i").between(i0, i0 + ny - 1) & F.col("j").between(j0, j0 + nx - 1)
    return m.where(inside).select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "v")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def packed_copy(m: DataFrame, ny: int, nx: int, flipped: bool = False, lane: int = 4) -> tuple[DataFrame, int]:
    """A copy of an ny by nx matrix with its stride padded to whole lanes of the dimension that runs fastest."""
    return (transpose(m) if flipped else m), -(-(ny if flipped else nx) // lane) * lane


def gemm(a: DataFrame, b: DataFrame, a_t: bool = False, b_t: bool = False) -> DataFrame:
    """op(A) op(B). A flag swaps coordinate names; nothing is transposed physically."""
    x = (transpose(a) if a_t else a).select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    y = (transpose(b) if b_t else b).select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def key_counts(x: DataFrame, y: DataFrame) -> DataFrame:
    """(k, n, m): how often either side holds a contracted key. Counts are summed where cells are read."""
    counts = x.groupBy("k").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).union(y.groupBy("k").agg(F.lit(0).cast("long"), F.count("*")))
    return counts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def heavy_keys(x: DataFrame, y: DataFrame, share: int) -> DataFrame:
    """(k, down, across) of contracted keys that either side holds over `share` times: a grid of so many parts of either.

    At most (rows of both) / share keys are heavy.
    """
    both = key_counts(x, y).where(f"(n > {share} or m > {share}) and n > 0 and m > 0")
    parts = lambda c: F.ceil(F.col(c) / share).cast("int")
    return both.select("k", parts("n").alias("down"), parts("m").alias("across"))


def gemm_skewed(a: DataFrame, b: DataFrame, a_t: bool = False, b_t: bool = False, tasks: int = 64) -> DataFrame:
    """op(A) op(B) where some contracted keys hold much of either side.

    A key with over 1 / tasks of the cells, 2 * tasks at most, is spread over a grid: A's cells are dealt to its rows by
    i and copied to its columns, B's are dealt to columns by j and copied to rows, so each pair meets in one part. Other
    keys are a grid of one part: it is one hash join by key and part. Tasks are `tasks`, or as many as `TASK_CELLS` and
    `TASK_PRODUCTS` ask for; if that is beyond the session's, products go to so many by their cell and are summed there.
    """
    x = (transpose(a) if a_t else a).select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    y = (transpose(b) if b_t else b).select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    count, products = (int(v or 0) for v in key_counts(x, y).agg(F.sum(n + m), F.sum(n * m)).first())
    tasks = max(tasks, -(-count // TASK_CELLS), -(-products // TASK_PRODUCTS))
    share = max(1, -(-count // tasks))
    dealt_out = tasks > int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(x, y, share))
    one = F.lit(1)

    def dealt(side, by, own, other, own_part, other_part):
        d = side.join(heavy, "k", "left").withColumn(own_part, F.pmod(F.xxhash64(by), F.coalesce(own, one)).cast("int"))
        d = d.withColumn(other_part, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("down", "across")
        return d.repartition(tasks, "k", "r", "c") if dealt_out else d

    left = dealt(x, "i", F.col("down"), F.col("across"), "r", "c")
    right = dealt(y, "j", F.col("across"), F.col("down"), "c", "r")
    out = left.join(right, ["k", "r", "c"]).select("i", "j", (F.col("x") * F.col("y")).alias("v"))
    return (out.repartition(tasks, "i", "j") if dealt_out else out).groupBy("i", "j").agg(F.sum("v").alias("v"))


def scaled(m: DataFrame, by: float) -> DataFrame:
    return m if by == 1 else m.select("i", "j", (F.col("v") * float(by)).alias("v"))


def accumulate(m: DataFrame, product: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha * product + beta * M. beta = 0 leaves M unread; alpha = 0 leaves the product unread."""
    parts = [scaled(p, f) for p, f in ((m, beta), (product, alpha)) if f]
    if not parts:
        return scaled(m, 0.0)
    if len(parts) == 1:
        return parts[0]
    return parts[0].unionByName(parts[1]).groupBy("i", "j").agg(F.sum("v").alias("v"))


def gemm_into(m: DataFrame, a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0, a_t: bool = False, b_t: bool = False) -> DataFrame:
    return accumulate(m, gemm(a, b, a_t, b_t), alpha, beta)


#: Association of a product of three and of four factors by control word. Fixed values.
CHAIN3 = {0: "a(bc)", 1: "(ab)c"}
CHAIN4 = {0: "((ab)c)d", 1: "(a(bc))d", 2: "a((bc)d)", 3: "a(b(cd))", 4: "(ab)(cd)"}


def chain3(a: DataFrame, b: DataFrame, c: DataFrame, control: int) -> DataFrame:
    """ABC; any control but 0 means (AB)C."""
    return gemm(gemm(a, b), c) if control else gemm(a, gemm(b, c))


def chain4(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, control: int) -> DataFrame:
    plans = {0: (((0, 1), 2), 3), 1: ((0, (1, 2)), 3), 2: (0, ((1, 2), 3)), 3: (0, (1, (2, 3))), 4: ((0, 1), (2, 3))}
    if control not in plans:
        raise ValueError(f"control {control} is none of {sorted(plans)}")
    factors = (a, b, c, d)

    def product(tree):
        return factors[tree] if isinstance(tree, int) else gemm(product(tree[0]), product(tree[1]))

    return product(plans[control])


def best_order(dims: list[int]):
    """(multiplications, tree) of the cheapest association of factors dims[k] by dims[k + 1]."""

    @lru_cache(None)
    def cost(i: int, j: int):
        if i == j:
            return 0, i
        return min((cost(i, k)[0] + cost(k + 1, j)[0] + dims[i] * dims[k + 1] * dims[j + 1], k) for k in range(i, j))

    def tree(i: int, j: int):
        if i == j:
            return i
        k = cost(i, j)[1]
        return (tree(i, k), tree(k + 1, j))

    return cost(0, len(dims) - 2)[0], tree(0, len(dims) - 2)


def chain(factors: list[DataFrame], dims: list[int]) -> DataFrame:
    """The product of any number of factors in the cheapest order."""

    def product(tree):
        return factors[tree] if isinstance(tree, int) else gemm(product(tree[0]), product(tree[1]))

    return product(best_order(dims)[1])


# ---- orders by estimated cells -------------------------------------------------------------------------------

SKETCH = 256  # rows or columns, those of the least hashes, that stand for all in a sketch


def supports(m: DataFrame) -> dict:
    """For rows (i) and columns (j): how many hold cells (n), and the cells of the SKETCH ones whose hashes are least.

    Two sketches hold the same coordinates where both reach, so what they share tells what all share.
    """
    out = {}
    for c in "ij":
        held = m.groupBy(c).agg(F.count("*").alias("n")).select(F.xxhash64(c).alias("h"), "n")
        out[c] = {"n": held.count(), "keys": {r["h"]: r["n"] for r in held.orderBy("h").limit(SKETCH).collect()}}
    return out


def _shared(a: dict, b: dict) -> tuple[float, float]:
    """(coordinates in common, sum over these of the product of cells), estimated; exact if both sketches hold all."""
    reach = min((max(s["keys"]) for s in (a, b) if len(s["keys"]) == SKETCH), default=2**63 - 1)
    part = (reach + 2.0**63) / 2.0**64
    both = [h for h in a["keys"].keys() & b["keys"].keys() if h <= reach]
    return len(both) / part, sum(a["keys"][h] * b["keys"][h] for h in both) / part


def _joined(a: dict, b: dict) -> tuple[float, dict]:
    """(multiplications, supports) of a product, as if its cells lay in rows and columns independently."""
    shared, muls = _shared(a["j"], b["i"])
    if not muls:
        return 0.0, {"i": {"n": 0.0, "keys": {}}, "j": {"n": 0.0, "keys": {}}}

    def met(side, inner):  # rows with a cell at a shared coordinate
        mean = sum(side["keys"].values()) / max(1, len(side["keys"]))
        return side["n"] * (1 - (1 - min(1.0, shared / inner["n"])) ** max(1.0, mean))

    rows, cols = met(a["i"], a["j"]), met(b["j"], b["i"])
    cells = -rows * cols * math.expm1(-muls / (rows * cols))  # distinct ones of so many random cells
    return muls, {"i": {"n": rows, "keys": dict.fromkeys(a["i"]["keys"], cells / rows)}, "j": {"n": cols, "keys": dict.fromkeys(b["j"]["keys"], cells / cols)}}


def sparse_order(of: list[dict]):
    """(multiplications, tree) of the association of sketched factors that is estimated cheapest."""
    best = {(k, k): (0.0, k, s) for k, s in enumerate(of)}
    for width in range(1, len(of)):
        for i in range(len(of) - width):
            found = []
            for k in range(i, i + width):
                left, right = best[i, k], best[k + 1, i + width]
                muls, held = _joined(left[2], right[2])
                found.append((left[0] + right[0] + muls, (left[1], right[1]), held))
            best[i, i + width] = min(found, key=lambda f: f[0])
    return best[0, len(of) - 1][:2]


def sparse_chain(factors: list[DataFrame]) -> DataFrame:
    """The product of sparse factors in the order that sketches of their rows and columns tell to be cheapest."""

    def product(tree):
        return factors[tree] if isinstance(tree, int) else gemm(product(tree[0]), product(tree[1]))

    return product(sparse_order([supports(m) for m in factors])[1])


def gram(df: DataFrame, vector: str) -> DataFrame:
    """AᵀA of a table with a vector of A in each row: partial sums by task, then one sum by cell.

    A dense product needs no join: each task multiplies its own rows, so what is shuffled is a matrix for each task.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = None
        for batch in batches:
            column = batch.column(0).drop_null()
            if len(column):
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
                part = x.T @ x
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int64)), pa.array(j.ravel().astype(np.int64)), pa.array(total.ravel())], names=["i", "j", "v"])

    return df.select(vector).mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
