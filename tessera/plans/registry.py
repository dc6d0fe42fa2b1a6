"""Queries of the block-algebra and task-graph operators over the given tables, with their DuckDB SQL.

Queries over tables read them whole; those of the task graphs make their graphs from a size and read none. Numbers are rounded, and 0.0 is added so that no negative zero is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import profile
from tessera.operators import blocks, clusters, coo, deps, hierarchical, lowrank, nested, paths, permute, tall, tournament
from tessera.plans import machine, schedule, tasks, tiled
from tessera.sources import matrices as M
from tessera.sources import tables as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 4


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def rounded(m: DataFrame, digits: int = DIGITS) -> DataFrame:
    return m.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("v", digits) + 0.0).alias("v"))


def rounded_sql(m: str, digits: int = DIGITS) -> str:
    return f"SELECT i, j, round(v, {digits}) + 0.0 AS v FROM ({m})"


def matrix(name: str, query, sql: str | None = None, digits: int = DIGITS) -> None:
    register(name, lambda s, d: rounded(query(s, d), digits), None if sql is None else rounded_sql(sql, digits))


def f(name: str):
    return S.FRAMES[name]


def flip(m: str) -> str:
    return f"SELECT j AS i, i AS j, v FROM ({m})"


def mul(a: str, b: str) -> str:
    return f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM ({a}) a JOIN ({b}) b ON a.j = b.i GROUP BY a.i, b.j"


def add(m: str, ab: str, alpha: float, beta: float) -> str:
    return f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, {beta} * v AS v FROM ({m}) UNION ALL SELECT i, j, {alpha} * v AS v FROM ({ab})) GROUP BY i, j"


P, R, T, U, D, W, A = (S.SQL[k] for k in "prtudwa")

# ---- products and copies -------------------------------------------------------------------------------------

register("gram_gemm", lambda s, d: rounded(coo.gram(S.table(s, d, "embeddings"), "embedding")), rounded_sql(mul(flip(A), A)))
matrix("mat_copy_view", lambda s, d: coo.view(f("p")(s, d), 3, 1, 10, 4), f"SELECT i - 3 AS i, j - 1 AS j, v FROM ({P}) WHERE i BETWEEN 3 AND 12 AND j BETWEEN 1 AND 4")
matrix("mat_copy_packed", lambda s, d: coo.packed_copy(f("p")(s, d), 25, 7, flipped=True)[0], flip(P))
matrix("mat_transpose", lambda s, d: coo.transpose(f("p")(s, d)), flip(P))
matrix("gemm", lambda s, d: coo.gemm(f("p")(s, d), f("r")(s, d)), mul(P, R))
matrix("gemm_at", lambda s, d: coo.gemm(f("r")(s, d), f("d")(s, d), a_t=True), mul(flip(R), D))
matrix("gemm_bt", lambda s, d: coo.gemm(f("p")(s, d), f("p")(s, d), b_t=True), mul(P, flip(P)))
matrix("gemm_at_bt", lambda s, d: coo.gemm(f("r")(s, d), f("p")(s, d), a_t=True, b_t=True), mul(flip(R), flip(P)))
G25, G12 = mul(P, flip(P)), mul(flip(R), R)


def g25(s, d):
    return coo.gemm(f("p")(s, d), f("p")(s, d), b_t=True)


def g12(s, d):
    return coo.gemm(f("r")(s, d), f("r")(s, d), a_t=True)


UP = mul(flip(U), flip(T))
matrix("gemm_minus", lambda s, d: coo.gemm_into(coo.gemm(f("p")(s, d), f("r")(s, d)), f("u")(s, d), f("t")(s, d), -1, 1, True, True), add(mul(P, R), UP, -1, 1))
matrix("gemm_plus", lambda s, d: coo.gemm_into(coo.gemm(f("p")(s, d), f("r")(s, d)), f("u")(s, d), f("t")(s, d), 1, 1, True, True), add(mul(P, R), UP, 1, 1))
matrix("gemm_alpha_beta", lambda s, d: coo.gemm_into(coo.gemm(f("p")(s, d), f("r")(s, d)), f("u")(s, d), f("t")(s, d), 2, 0.5, True, True), add(mul(P, R), UP, 2, 0.5))
matrix("gemm_beta0", lambda s, d: coo.gemm_into(f("p")(s, d), f("u")(s, d), f("t")(s, d), 2, 0, True, True), f"SELECT i, j, 2 * v AS v FROM ({UP})")
matrix("gemm_alpha0", lambda s, d: coo.gemm_into(f("p")(s, d), f("u")(s, d), f("t")(s, d), 0, 3, True, True), f"SELECT i, j, 3 * v AS v FROM ({P})")
matrix("gemm3_left", lambda s, d: coo.chain3(f("p")(s, d), f("r")(s, d), f("t")(s, d), 1), mul(mul(P, R), T))
matrix("gemm3_right", lambda s, d: coo.chain3(f("p")(s, d), f("r")(s, d), f("t")(s, d), 0), mul(P, mul(R, T)))
for c in range(5):
    matrix(f"gemm4_c{c}", lambda s, d, c=c: coo.chain4(*(f(k)(s, d) for k in "prtu"), c), mul(mul(P, R), mul(T, U)))
matrix("gemm_chain_best", lambda s, d: coo.chain([f(k)(s, d) for k in "prtu"], [25, 7, 12, 5, 25]), mul(mul(P, R), mul(T, U)))


def sparse(s, d):
    l = S.table(s, d, "lineitem")
    return M.cells(l, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"))


def supplier_nation(s, d):
    return S.table(s, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("long").alias("j"), F.lit(1.0).alias("v"))


matrix("sparse_product", lambda s, d: coo.gemm(sparse(s, d), supplier_nation(s, d)), "SELECT l_partkey AS i, CAST(s_nationkey AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
matrix("zero_matrix", lambda s, d: M.zeros(s, 12, 5), "SELECT x.k AS i, y.k AS j, CAST(0 AS DOUBLE) AS v FROM range(0, 12) x(k), range(0, 5) y(k)")
register("matrix_rows", lambda s, d: M.print_rows(rounded(f("r")(s, d))), f"SELECT i, string_agg(printf('%e', v), ' ' ORDER BY j) AS line FROM ({rounded_sql(R)}) GROUP BY i")
matrix("tiles_round_trip", lambda s, d: M.from_tiles(M.to_tiles(g12(s, d), 12, 12, 5), 5), G12)

# ---- permutations and reductions -----------------------------------------------------------------------------

register("argmax_abs", lambda s, d: permute.argmax_abs(f("p")(s, d).withColumn("v", F.round("v", 6)), "i", "j"), f"SELECT j, CASE WHEN max(abs(v)) > 0 THEN arg_max(i, (abs(v), -i)) ELSE 0 END AS index FROM (SELECT i, j, round(v, 6) AS v FROM ({P})) GROUP BY j")
matrix("swap_rows", lambda s, d: permute.swap_rows(f("p")(s, d), 2, 19), f"SELECT CASE i WHEN 2 THEN 19 WHEN 19 THEN 2 ELSE i END AS i, j, v FROM ({P})")
matrix("swap_cols", lambda s, d: permute.swap_columns(f("p")(s, d), 0, 5), f"SELECT i, CASE j WHEN 0 THEN 5 WHEN 5 THEN 0 ELSE j END AS j, v FROM ({P})")


def pivot(s):
    return s.range(25).select(F.col("id").alias("row"), ((F.col("id") * 7 + 3) % 25).alias("target"))


matrix("pivot_apply", lambda s, d: permute.apply_pivot(f("p")(s, d), pivot(s)), f"SELECT q.r AS i, j, v FROM ({P}) p JOIN range(0, 25) q(r) ON p.i = (q.r * 7 + 3) % 25")
matrix("pivot_recover", lambda s, d: permute.apply_pivot(f("p")(s, d), pivot(s), recover=True), f"SELECT (i * 7 + 3) % 25 AS i, j, v FROM ({P})")
register("pivot_reset", lambda s, d: permute.reset_pivot(s, 25), "SELECT k AS row, k AS target FROM range(0, 25) q(k)")
register("allreduce_sum", lambda s, d: permute.sum_to_all(S.table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "n"), "SELECT o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY o_orderpriority")
register("read_rank", lambda s, d: permute.read_rank(f("p")(s, d), 1.0), f"SELECT count(*) AS rank FROM (SELECT j, sum(v * v) AS n2 FROM ({P}) GROUP BY j) WHERE n2 >= 1.0")

# ---- factorisation and solves --------------------------------------------------------------------------------

SPD, SPD_SQL = (lambda s, d: S.boosted(g12(s, d), 12, 10.0)), S.boosted_sql(G12, 12, 10.0)
TALL, TALL_SQL = (lambda s, d: S.boosted(f("p")(s, d), 7, 1000.0)), S.boosted_sql(P, 7, 1000.0, (25, 7))
WIDE, WIDE_SQL = (lambda s, d: S.boosted(f("r")(s, d), 7, 1000.0)), S.boosted_sql(R, 7, 1000.0, (7, 12))


def lu_sql(m: str, steps: int) -> str:
    return (
        f"WITH RECURSIVE lu AS (SELECT CAST(0 AS BIGINT) AS k, i, j, v FROM ({m}) UNION ALL SELECT a.k + 1, a.i, a.j, CASE WHEN a.i > a.k AND a.j = a.k THEN a.v / p.v WHEN a.i > a.k AND a.j > a.k THEN a.v - c.v / p.v * r.v ELSE a.v END "
        f"FROM lu a JOIN lu p ON p.i = a.k AND p.j = a.k JOIN lu c ON c.i = a.i AND c.j = a.k JOIN lu r ON r.i = a.k AND r.j = a.j WHERE a.k < {steps}) SELECT i, j, v FROM lu WHERE k = {steps}"
    )


def trsml_sql(b: str, l: str, n: int) -> str:
    return (
        f"WITH RECURSIVE l AS (SELECT i, j, v FROM ({l}) WHERE i > j), x AS (SELECT CAST(0 AS BIGINT) AS k, i, j, v FROM ({b}) UNION ALL SELECT a.k + 1, a.i, a.j, CASE WHEN a.i > a.k THEN a.v - l.v * r.v ELSE a.v END "
        f"FROM x a JOIN x r ON r.i = a.k AND r.j = a.j LEFT JOIN l ON l.i = a.i AND l.j = a.k WHERE a.k < {n}) SELECT i, j, v FROM x WHERE k = {n}"
    )


def trsmr_sql(b: str, u: str, n: int) -> str:
    return (
        f"WITH RECURSIVE u AS (SELECT i, j, v FROM ({u}) WHERE i <= j), x AS (SELECT CAST(0 AS BIGINT) AS k, i, j, v FROM ({b}) UNION ALL SELECT a.k + 1, a.i, a.j, CASE WHEN a.j = a.k THEN a.v / p.v WHEN a.j > a.k THEN a.v - c.v / p.v * u.v ELSE a.v END "
        f"FROM x a JOIN u p ON p.i = a.k AND p.j = a.k JOIN x c ON c.i = a.i AND c.j = a.k LEFT JOIN u ON u.i = a.k AND u.j = a.j WHERE a.k < {n}) SELECT i, j, v FROM x WHERE k = {n}"
    )


def block_query(make, m: int, n: int, expression):
    def query(s, d):
        one = M.to_block(make(s, d), m, n).select(expression(F.col("m")).alias("m"))
        return M.from_block(one, F.col("m"))

    return query


def pair_query(b, bm: int, bn: int, factor, fm: int, fn: int, expression):
    def query(s, d):
        lu = M.to_block(factor(s, d), fm, fn).select(blocks.getrf(F.col("m")).alias("f"))  # below the join, so it is computed once
        one = M.to_block(b(s, d), bm, bn, "b").join(F.broadcast(lu))  # one row each
        return M.from_block(one.select(expression(F.col("b"), F.col("f")).alias("m")), F.col("m"))

    return query


LU_SQL = lu_sql(SPD_SQL, 12)
matrix("getrf", block_query(SPD, 12, 12, blocks.getrf), LU_SQL)
matrix("getrf_rect_tall", block_query(TALL, 25, 7, blocks.getrf), lu_sql(TALL_SQL, 7))
matrix("getrf_rect_wide", block_query(WIDE, 7, 12, blocks.getrf), lu_sql(WIDE_SQL, 7))
matrix("getrf_gram", lambda s, d: block_query(lambda s, d: S.boosted(coo.gram(S.table(s, d, "embeddings"), "embedding"), 64, 64.0), 64, 64, blocks.getrf)(s, d), lu_sql(S.boosted_sql(mul(flip(A), A), 64, 64.0), 64))
matrix("trsml", pair_query(f("w"), 12, 3, SPD, 12, 12, blocks.trsml), trsml_sql(S.dense_sql(W, 12, 3), f"SELECT * FROM ({LU_SQL})", 12), 6)
matrix("trsmr", pair_query(f("u"), 5, 25, lambda s, d: S.boosted(g25(s, d), 25, 10.0), 25, 25, blocks.trsmr), trsmr_sql(S.dense_sql(U, 5, 25), f"SELECT * FROM ({lu_sql(S.boosted_sql(G25, 25, 10.0), 25)})", 25), 6)
matrix("trsmr_bt", pair_query(lambda s, d: coo.transpose(f("u")(s, d)), 25, 5, lambda s, d: S.boosted(g25(s, d), 25, 10.0), 25, 25, blocks.trsmr_stored_transposed), flip(trsmr_sql(S.dense_sql(U, 5, 25), f"SELECT * FROM ({lu_sql(S.boosted_sql(G25, 25, 10.0), 25)})", 25)), 6)


def lu_product(m):
    lu = blocks.getrf(m)
    low, up = blocks.lower(lu), blocks.upper(lu)
    columns = blocks.transpose(up)
    return F.transform(low, lambda row: F.transform(columns, lambda c: F.aggregate(F.zip_with(row, c, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)))


matrix("lu_reconstruct", block_query(SPD, 12, 12, lu_product), SPD_SQL)
matrix("getrf_tiled", lambda s, d: M.from_tiles(tiled.tiled_lu(M.to_tiles(SPD(s, d), 12, 12, 4), 3), 4), LU_SQL)
matrix("trsml_tiled", lambda s, d: M.from_tiles(tiled.tiled_solve(M.to_tiles(f("w")(s, d), 12, 3, 4), lu_tiles(s, d), 3, 1, "l"), 4), trsml_sql(S.dense_sql(W, 12, 3), f"SELECT * FROM ({LU_SQL})", 12), 6)
matrix("trsmr_tiled", lambda s, d: M.from_tiles(tiled.tiled_solve(M.to_tiles(coo.transpose(f("w")(s, d)), 3, 12, 4), lu_tiles(s, d), 1, 3, "r"), 4), trsmr_sql(S.dense_sql(flip(W), 3, 12), f"SELECT * FROM ({LU_SQL})", 12), 6)


matrix("trsmr_bt_tiled", lambda s, d: M.from_tiles(tiled.tiled_solve(M.to_tiles(f("w")(s, d), 12, 3, 4), lu_tiles(s, d), 3, 1, "r", transposed=True), 4), flip(trsmr_sql(S.dense_sql(flip(W), 3, 12), f"SELECT * FROM ({LU_SQL})", 12)), 6)


def lu_tiles(s, d):
    return tiled.tiled_lu(M.to_tiles(SPD(s, d), 12, 12, 4), 3)


# ---- orthogonal and low-rank ---------------------------------------------------------------------------------

FLAGS = "SELECT l_returnflag AS flag, CAST(s_nationkey AS BIGINT) AS i, CAST(l_linenumber - 1 AS BIGINT) AS j, sum(l_quantity / 997) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3"
FLAG_GRAM = f"SELECT a.flag, a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM ({FLAGS}) a JOIN ({FLAGS}) b ON a.flag = b.flag AND a.i = b.i GROUP BY 1, 2, 3"


def flag_blocks(s, d):
    l, sup = S.table(s, d, "lineitem"), S.table(s, d, "supplier")
    x = l.join(sup, l["l_suppkey"] == sup["s_suppkey"]).groupBy(F.col("l_returnflag").alias("flag"), F.col("s_nationkey").cast("long").alias("i"), (F.col("l_linenumber") - 1).cast("long").alias("j")).agg(F.sum(F.col("l_quantity") / 997).alias("v"))
    return lowrank.blocks_of(x, "flag", 25, 7)


def by_flag(a: DataFrame, b: DataFrame) -> DataFrame:
    """AᵀB of each block's cells."""
    x, y = a.select("flag", F.col("i").alias("k"), F.col("j").alias("i"), F.col("v").alias("x")), b.select("flag", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, ["flag", "k"]).groupBy("flag", "i", "j").agg((F.round(F.sum(F.col("x") * F.col("y")), DIGITS) + 0.0).alias("v"))


def qr_gram(s, d):
    r = M.stored(lowrank.givens_qr(flag_blocks(s, d), "flag"), "qr")
    return by_flag(r, r)


def q_gram(s, d):
    q = M.stored(lowrank.givens_q(flag_blocks(s, d), "flag"), "q")
    return by_flag(q, q)


def qr_product(s, d):
    b = flag_blocks(s, d)
    q, r = (M.stored(x, "qr") for x in (lowrank.givens_q(b, "flag"), lowrank.givens_qr(b, "flag")))
    x = q.select("flag", "i", F.col("j").alias("k"), F.col("v").alias("x")).join(r.select("flag", F.col("i").alias("k"), "j", F.col("v").alias("y")), ["flag", "k"])
    return x.groupBy("flag", "i", "j").agg((F.round(F.sum(F.col("x") * F.col("y")), DIGITS) + 0.0).alias("v"))


register("givens_qr", qr_gram, f"SELECT flag, i, j, round(v, {DIGITS}) + 0.0 AS v FROM ({FLAG_GRAM})")
register("givens_q", q_gram, "SELECT flag, x.k AS i, y.k AS j, CAST(CASE WHEN x.k = y.k THEN 1 ELSE 0 END AS DOUBLE) AS v FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem), range(0, 7) x(k), range(0, 7) y(k)")
register("qr_reconstruct", qr_product, f"SELECT f.flag, x.k AS i, y.k AS j, round(coalesce(m.v, 0), {DIGITS}) + 0.0 AS v FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem) f CROSS JOIN range(0, 25) x(k) CROSS JOIN range(0, 7) y(k) LEFT JOIN ({FLAGS}) m ON m.flag = f.flag AND m.i = x.k AND m.j = y.k")


def sv_sums(s, d):
    v2 = F.col("v") * F.col("v")
    return lowrank.singular_values(flag_blocks(s, d), "flag").groupBy("flag").agg(F.round(F.sum(v2), 3).alias("sum_s2"), F.round(F.sum(v2 * v2) / F.sum(v2), 3).alias("mean_s2"))


register("jacobi_sv", sv_sums, f"SELECT flag, round(sum(CASE WHEN i = j THEN v ELSE 0 END), 3) AS sum_s2, round(sum(v * v) / sum(CASE WHEN i = j THEN v ELSE 0 END), 3) AS mean_s2 FROM ({FLAG_GRAM}) GROUP BY flag")
register("svd_rank", lambda s, d: lowrank.svd_rank(flag_blocks(s, d), "flag", 1e-9).select("flag", F.col("v").cast("long").alias("rank")), "SELECT l_returnflag AS flag, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS rank FROM lineitem GROUP BY 1")


def tall_gram(s, d):
    r = M.stored(lowrank.tall_r(S.table(s, d, "embeddings"), "embedding"), "tall-r")
    return coo.gram(r, "row")


matrix("tall_qr", tall_gram, mul(flip(A), A))


def embedding_qr(s, d):
    return tall.tall_qr(S.table(s, d, "embeddings"), "vec_id", "embedding")


def qr_rows(s, d):
    q, r = embedding_qr(s, d)
    return M.from_vectors(tall.turned(q, r), F.col("id"), F.col("q"))


matrix("tall_qr_rows", qr_rows, A)
matrix("tall_q_gram", lambda s, d: coo.gram(embedding_qr(s, d)[0], "q"), "SELECT x.k AS i, y.k AS j, CAST(CASE WHEN x.k = y.k THEN 1 ELSE 0 END AS DOUBLE) AS v FROM range(0, 64) x(k), range(0, 64) y(k)", 9)


def moments(values: DataFrame, *key: str) -> DataFrame:
    """Sum of squares, and their mean weighted by themselves."""
    v2 = F.col("v") * F.col("v")
    return values.groupBy(*key).agg(F.round(F.sum(v2), 3).alias("sum_s2"), F.round(F.sum(v2 * v2) / F.sum(v2), 3).alias("mean_s2"))


def moments_sql(gram: str, *key: str) -> str:
    by = "".join(f"{k}, " for k in key)
    return f"SELECT {by}round(sum(CASE WHEN i = j THEN v ELSE 0 END), 3) AS sum_s2, round(sum(v * v) / sum(CASE WHEN i = j THEN v ELSE 0 END), 3) AS mean_s2 FROM ({gram})" + (f" GROUP BY {by[:-2]}" if key else "")


def flag_rows(s, d):
    """The flags' matrices lying down, 7 by 25."""
    l, sup = S.table(s, d, "lineitem"), S.table(s, d, "supplier")
    x = l.join(sup, l["l_suppkey"] == sup["s_suppkey"])
    return x.groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") - 1).cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.sum(F.col("l_quantity") / 997).alias("v"))


def of_values(s, values) -> DataFrame:
    return s.createDataFrame([(float(v),) for v in values], "v double")


def embedding_values(s, d):
    _, r = embedding_qr(s, d)
    cells = s.createDataFrame([(0, i, j, float(v)) for i, row in enumerate(r) for j, v in enumerate(row)], "key long, i long, j long, v double")
    return tournament.singular_values(cells, "key", len(r), r.shape[1], width=16)


register("jacobi_wide", lambda s, d: moments(tournament.singular_values(flag_rows(s, d), "flag", 7, 25, width=7), "flag"), moments_sql(FLAG_GRAM, "flag"))
register("jacobi_tall", lambda s, d: moments(embedding_values(s, d)), moments_sql(mul(flip(A), A)))
register("rsvd_moments", lambda s, d: moments(of_values(s, tall.randomized_svd(f("p")(s, d), 7)[1])), moments_sql(mul(flip(P), P)))

SUPPLY = "SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, sum(l_quantity / 997) AS v FROM lineitem GROUP BY 1, 2"


def supply(s, d):
    """Quantity by supplier and part, sparse."""
    return M.cells(S.table(s, d, "lineitem"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_quantity") / 997)


def leading(s, d):
    """The leading singular value, the squared norm, and whether what is left lies between nothing and all but the values found."""
    a = M.stored(supply(s, d), "supply")
    u, values, v = tall.randomized_svd(a, 8)
    total = a.agg(F.sum(F.col("v") * F.col("v")).alias("t"))
    dot = sum((F.element_at("q", c + 1) * F.element_at("p", c + 1) * float(s_) for c, s_ in enumerate(values)), F.lit(0.0))
    # |A - USVt|^2 = |A|^2 - 2 <A, USVt> + |S|^2, as U and V are orthonormal, and <A, USVt> is that of AV and US, row by row
    av = tall.times(a, v, len(values)).withColumnRenamed("q", "p")
    inner = u.join(av, "id").agg(F.sum(dot).alias("inner"))
    s2 = float((values**2).sum())
    left = F.col("t") - 2 * F.col("inner") + s2
    ok = (left >= -1e-6 * F.col("t")) & (F.abs(left - (F.col("t") - s2)) <= 1e-6 * F.col("t"))
    return total.crossJoin(inner).select(F.round(F.lit(float(values[0])), 4).alias("sigma1"), F.round("t", 3).alias("norm2"), ok.alias("within"))


def squared(name: str, of: str) -> str:
    return f"{name} AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {of} a JOIN {of} b ON a.j = b.i GROUP BY 1, 2)"


register(
    "rsvd_leading", leading,
    f"WITH a AS ({SUPPLY}), g AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.j GROUP BY 1, 2), {squared('g2', 'g')}, {squared('g4', 'g2')}, {squared('g8', 'g4')} "
    "SELECT round(pow((SELECT sum(v * v) FROM g8), CAST(1 AS DOUBLE) / 32), 4) AS sigma1, (SELECT round(sum(v * v), 3) FROM a) AS norm2, true AS within",
)


def arrays(m: DataFrame, rows: int, cols: int) -> DataFrame:
    return M.to_block(m, rows, cols)


def low_rank_sum(s, d):
    p, w = f("p")(s, d), f("w")(s, d)
    one = F.lit(0).alias("key")
    a = arrays(p, 25, 7).select(one, F.col("m").alias("u")).join(F.broadcast(arrays(coo.transpose(f("r")(s, d)), 12, 7).select(one, F.col("m").alias("v"))), "key")
    b = arrays(coo.gemm(p, f("d")(s, d)), 25, 3).select(one, F.col("m").alias("u")).join(F.broadcast(arrays(w, 12, 3).select(one, F.col("m").alias("v"))), "key")
    return lowrank.accumulate(a, b, "key")


matrix("lowrank_accum", low_rank_sum, S.dense_sql(add(mul(P, R), mul(mul(P, D), flip(W)), 1, 1), 25, 12), 3)
matrix("lowrank_product", lambda s, d: lowrank.low_rank_product(f("p")(s, d), coo.transpose(f("r")(s, d))), mul(P, R))

# ---- a block for each key of a table -------------------------------------------------------------------------

BY_KEY = {
    "months": "SELECT CAST(l_suppkey AS BIGINT) AS key, CAST(month(l_shipdate) - 1 AS BIGINT) AS i, CAST(l_linenumber - 1 AS BIGINT) AS j, sum(l_quantity / 997) AS v FROM lineitem GROUP BY 1, 2, 3",
    "flags": "SELECT CAST(l_suppkey AS BIGINT) AS key, CAST(l_linenumber - 1 AS BIGINT) AS i, CAST(instr('ANR', l_returnflag) - 1 AS BIGINT) AS j, count(*) * (CAST(1 AS DOUBLE) / 997) AS v FROM lineitem GROUP BY 1, 2, 3",
    "seasons": "SELECT CAST(l_suppkey AS BIGINT) AS key, CAST(month(l_shipdate) - 1 AS BIGINT) AS i, CAST(instr('ANR', l_returnflag) - 1 AS BIGINT) AS j, sum(l_quantity / 997) AS v FROM lineitem GROUP BY 1, 2, 3",
    "sales": "SELECT CAST(l_suppkey AS BIGINT) AS key, CAST(month(l_shipdate) - 1 AS BIGINT) AS i, CAST(instr('ANR', l_returnflag) - 1 AS BIGINT) AS j, sum(l_discount / 997) AS v FROM lineitem GROUP BY 1, 2, 3",
}


def by_key(s, d, name: str) -> DataFrame:
    l = S.table(s, d, "lineitem")
    line, month, flag = F.col("l_linenumber") - 1, F.month("l_shipdate") - 1, F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1
    i, j, v = {"months": (month, line, F.col("l_quantity") / 997), "flags": (line, flag, F.lit(1 / 997)), "seasons": (month, flag, F.col("l_quantity") / 997), "sales": (month, flag, F.col("l_discount") / 997)}[name]
    return l.groupBy(F.col("l_suppkey").cast("long").alias("key"), i.cast("long").alias("i"), j.cast("long").alias("j")).agg(F.sum(v.cast("double")).alias("v"))


def keyed_gram(s, d) -> DataFrame:
    """Of each supplier, 7 by 7: the Gram matrix of its months' quantities by line number, and 10 I."""
    m = by_key(s, d, "months")
    x, y = m.select("key", F.col("i").alias("k"), F.col("j").alias("i"), F.col("v").alias("x")), m.select("key", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    own = m.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("i"))
    parts = x.join(y, ["key", "k"]).groupBy("key", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return parts.unionByName(own.select("key", "i", F.col("i").alias("j"), F.lit(10.0).alias("v"))).groupBy("key", "i", "j").agg(F.sum("v").alias("v"))


def keyed_lu(s, d) -> DataFrame:
    """(key, lu): a row for each supplier's factor."""
    return M.stored(M.to_keyed_blocks(keyed_gram(s, d), "key", 7, 7).select("key", blocks.getrf(F.col("m")).alias("lu")), "keyed-lu")


def keyed_cells(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return M.from_keyed_blocks(df, "key", F.col("m")).withColumn("v", F.round("v", digits) + 0.0)


def keyed_solve(flipped: bool, expression):
    def query(s, d):
        flags = by_key(s, d, "flags")
        b = flags.select("key", F.col("j").alias("i"), F.col("i").alias("j"), "v") if flipped else flags
        both = M.to_keyed_blocks(b, "key", *((3, 7) if flipped else (7, 3)), "b").join(keyed_lu(s, d), "key")
        return keyed_cells(both.select("key", expression(F.col("b"), F.col("lu")).alias("m")), 6)

    return query


def keyed_accum(s, d):
    """U V1 + U V2 of each supplier, by the rank of U."""
    u, v1, v2 = (M.to_keyed_blocks(by_key(s, d, k), "key", rows, 3, n) for k, rows, n in (("flags", 7, "u"), ("seasons", 12, "v"), ("sales", 12, "v")))
    out = lowrank.accumulate(u.join(v1, "key"), M.to_keyed_blocks(by_key(s, d, "flags"), "key", 7, 3, "u").join(v2, "key"), "key")
    return out.withColumn("v", F.round("v", 6) + 0.0)


def keyed_dense_sql(m: str, ny: int, nx: int) -> str:
    return f"SELECT key, i, j, sum(v) AS v FROM (SELECT key, i, j, v FROM ({m}) UNION ALL SELECT q.key, a.k AS i, b.k AS j, CAST(0 AS DOUBLE) AS v FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS key FROM lineitem) q, range(0, {ny}) a(k), range(0, {nx}) b(k)) GROUP BY 1, 2, 3"


KEYED_GRAM = f"SELECT a.key, a.j AS i, b.j, sum(a.v * b.v) AS v FROM ({BY_KEY['months']}) a JOIN ({BY_KEY['months']}) b ON a.key = b.key AND a.i = b.i GROUP BY 1, 2, 3"
KEYED_A = keyed_dense_sql(f"SELECT key, i, j, v FROM ({KEYED_GRAM}) UNION ALL SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS key, k AS i, k AS j, CAST(10 AS DOUBLE) AS v FROM lineitem, range(0, 7) q(k)", 7, 7)
KEYED_LU = (
    f"WITH RECURSIVE lu AS (SELECT CAST(0 AS BIGINT) AS k, key, i, j, v FROM ({KEYED_A}) UNION ALL SELECT a.k + 1, a.key, a.i, a.j, CASE WHEN a.i > a.k AND a.j = a.k THEN a.v / p.v WHEN a.i > a.k AND a.j > a.k THEN a.v - c.v / p.v * r.v ELSE a.v END "
    "FROM lu a JOIN lu p ON p.key = a.key AND p.i = a.k AND p.j = a.k JOIN lu c ON c.key = a.key AND c.i = a.i AND c.j = a.k JOIN lu r ON r.key = a.key AND r.i = a.k AND r.j = a.j WHERE a.k < 7) SELECT key, i, j, v FROM lu WHERE k = 7"
)
KEYED_L = (
    f"WITH RECURSIVE l AS MATERIALIZED (SELECT key, i, j, v FROM ({KEYED_LU}) WHERE i > j), x AS (SELECT CAST(0 AS BIGINT) AS k, key, i, j, v FROM ({keyed_dense_sql(BY_KEY['flags'], 7, 3)}) UNION ALL SELECT a.k + 1, a.key, a.i, a.j, CASE WHEN a.i > a.k THEN a.v - l.v * r.v ELSE a.v END "
    "FROM x a JOIN x r ON r.key = a.key AND r.i = a.k AND r.j = a.j LEFT JOIN l ON l.key = a.key AND l.i = a.i AND l.j = a.k WHERE a.k < 7) SELECT key, i, j, round(v, 6) + 0.0 AS v FROM x WHERE k = 7"
)
KEYED_R = (
    f"WITH RECURSIVE u AS MATERIALIZED (SELECT key, i, j, v FROM ({KEYED_LU}) WHERE i <= j), x AS (SELECT CAST(0 AS BIGINT) AS k, key, i, j, v FROM ({keyed_dense_sql(f'SELECT key, j AS i, i AS j, v FROM ({BY_KEY["flags"]})', 3, 7)}) UNION ALL SELECT a.k + 1, a.key, a.i, a.j, CASE WHEN a.j = a.k THEN a.v / p.v WHEN a.j > a.k THEN a.v - c.v / p.v * u.v ELSE a.v END "
    "FROM x a JOIN u p ON p.key = a.key AND p.i = a.k AND p.j = a.k JOIN x c ON c.key = a.key AND c.i = a.i AND c.j = a.k LEFT JOIN u ON u.key = a.key AND u.i = a.k AND u.j = a.j WHERE a.k < 7) SELECT key, i, j, round(v, 6) + 0.0 AS v FROM x WHERE k = 7"
)
register("getrf_keyed", lambda s, d: keyed_cells(keyed_lu(s, d).withColumnRenamed("lu", "m")), f"SELECT key, i, j, round(v, {DIGITS}) + 0.0 AS v FROM ({KEYED_LU})")
register("trsml_keyed", keyed_solve(False, blocks.trsml), KEYED_L)
register("trsmr_keyed", keyed_solve(True, blocks.trsmr), KEYED_R)
register("trsmr_bt_keyed", keyed_solve(False, blocks.trsmr_stored_transposed), f"SELECT key, j AS i, i AS j, v FROM ({KEYED_R})")
BOTH_V = f"SELECT key, i, j, sum(v) AS v FROM (SELECT * FROM ({BY_KEY['seasons']}) UNION ALL SELECT * FROM ({BY_KEY['sales']})) GROUP BY 1, 2, 3"
register("lowrank_accum_keyed", keyed_accum, f"SELECT key, i, j, round(v, 6) + 0.0 AS v FROM ({keyed_dense_sql(f'SELECT a.key, a.i, b.i AS j, sum(a.v * b.v) AS v FROM ({BY_KEY["flags"]}) a JOIN ({BOTH_V}) b ON a.key = b.key AND a.j = b.j GROUP BY 1, 2, 3', 7, 12)})")

# ---- hierarchical --------------------------------------------------------------------------------------------


def kernel(s, d):
    """K, 25 by 25 with separable parts off the diagonal: G = PPᵀ has rank 7, and 10 I is added."""
    return S.boosted(g25(s, d), 25, 10.0)


def kernel_leaves(s, d):
    return M.stored(hierarchical.leaves(M.to_tiles(M.stored(kernel(s, d), "kernel"), 25, 25, 7), 1e-12), "leaves")


def reconstructed(s, d):
    """L U of the factored leaves."""
    lu = M.stored(M.from_tiles(hierarchical.expand(hierarchical.hlu(kernel_leaves(s, d), 4, 1e-13)), 7), "hlu")
    low = lu.where("i > j").unionByName(M.identity(s, 25))
    return coo.gemm(low, lu.where("i <= j"))


register("hlu_leaf_table", lambda s, d: hierarchical.leaf_table(kernel_leaves(s, d), 7, 2).select("i0", "j0", "ny", "nx"), "SELECT x.k * 7 AS i0, y.k * 7 AS j0, CAST(least(7, 25 - x.k * 7) AS INTEGER) AS ny, CAST(least(7, 25 - y.k * 7) AS INTEGER) AS nx FROM range(0, 4) x(k), range(0, 4) y(k)")
matrix("hlu_factor", reconstructed, S.boosted_sql(G25, 25, 10.0), 3)



def falling(i, j):
    """A kernel whose blocks off the diagonal have low rank; its diagonal is large, so that LU needs no pivoting."""
    import numpy as np

    return 100.0 / (3.0 * (1.0 + np.abs(i - j))) + 1000.0 * (i == j)


def nested_matrices(s, *sizes):
    return s.createDataFrame([(n, n) for n in sizes], "key long, n long")


def residual(m):
    """Whether L U times some vectors is the matrix times them, to six digits; and what dense LU would cost."""
    import numpy as np
    import pandas as pd

    x, step = np.random.default_rng(2).standard_normal((m.n, 4)), 512
    want = np.vstack([falling(np.arange(a, min(a + step, m.n))[:, None], np.arange(m.n)[None, :]) @ x for a in range(0, m.n, step)])
    off = np.abs(m.lower_times(m.upper_times(x)) - want).max() / np.abs(want).max()
    return pd.DataFrame({"levels": [m.depth], "leaves": [len(m.leaves)], "accurate": [bool(off < 1e-6)]})


register(
    "hlu_nested",
    lambda s, d: nested.factored(nested_matrices(s, 150), falling, 20, 16, nested.product, "i long, j long, v double").select("key", "i", "j", (F.round("v", 3) + 0.0).alias("v")),
    "SELECT CAST(150 AS BIGINT) AS key, a.i AS i, b.j AS j, round(100 / (3 * (CAST(1 AS DOUBLE) + abs(a.i - b.j))) + CASE WHEN a.i = b.j THEN 1000 ELSE 0 END, 3) + 0.0 AS v FROM range(0, 150) a(i), range(0, 150) b(j)",
)
#: Of a tree of d levels: a task for each dense leaf, two solves for each inner node, then a task for each leaf of a node's last quadrant.
register(
    "hlu_nested_tasks",
    lambda s, d: nested.factored(nested_matrices(s, 64, 128, 256), falling, 16, 8, nested.task_list, nested.TASK).groupBy("key", "op").agg(F.count("*").alias("n")),
    "WITH d AS (SELECT CAST(n AS BIGINT) AS key, d FROM (VALUES (64, 2), (128, 3), (256, 4)) v(n, d)), l AS (SELECT key, d, k, CAST(pow(2, k) AS BIGINT) AS nodes, CAST(pow(2, d - k - 1) AS BIGINT) AS half FROM d, range(0, 4) q(k) WHERE k < d) "
    "SELECT key, 'getrf' AS op, CAST(pow(2, d) AS BIGINT) AS n FROM d UNION ALL SELECT key, 'trsml', CAST(sum(nodes) AS BIGINT) FROM l GROUP BY key UNION ALL SELECT key, 'trsmr', CAST(sum(nodes) AS BIGINT) FROM l GROUP BY key "
    "UNION ALL SELECT key, 'gemm', CAST(sum(nodes * half) AS BIGINT) FROM l GROUP BY key UNION ALL SELECT key, 'accum', CAST(sum(nodes * 2 * (half - 1)) AS BIGINT) FROM l GROUP BY key",
)
register(
    "hlu_sizes",
    lambda s, d: nested.factored(nested_matrices(s, 1024, 2048, 4096), falling, 128, 16, residual, "levels int, leaves int, accurate boolean"),
    "SELECT CAST(n AS BIGINT) AS key, CAST(d AS INTEGER) AS levels, CAST(pow(2, d) + 2 * (pow(2, d) - 1) AS INTEGER) AS leaves, true AS accurate FROM (VALUES (1024, 3), (2048, 4), (4096, 5)) v(n, d)",
)

# ---- products with hot keys and sparse chains ----------------------------------------------------------------

#: Half of all lines have one key, 0; the others have their part's.
HOT_KEY = "CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_partkey END"
HOT = f"SELECT CAST(l_orderkey AS BIGINT) AS i, CAST({HOT_KEY} AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
COLD = f"SELECT CAST({HOT_KEY} AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS j, count(*) * CAST(1 AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"


def hot_product(s, d):
    l = S.table(s, d, "lineitem")
    key = F.expr(HOT_KEY)
    return coo.gemm_skewed(M.cells(l, F.col("l_orderkey"), key, F.col("l_quantity")), M.cells(l, key, F.col("l_linenumber"), F.lit(1.0)))


#: Orders by part; part by supplier; supplier by nation. The dimensions would join the first two first.
BY_PART = "SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, count(*) * CAST(1 AS DOUBLE) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2"
PART_SUPPLY = "SELECT CAST(l_partkey AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j, count(*) * CAST(1 AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"
HOME = "SELECT CAST(s_suppkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v FROM supplier"


def sparse_factors(s, d):
    l, sup = S.table(s, d, "lineitem"), S.table(s, d, "supplier")
    return [
        M.cells(l.where("l_quantity > 45"), F.col("l_orderkey"), F.col("l_partkey"), F.lit(1.0)),
        M.cells(l, F.col("l_partkey"), F.col("l_suppkey"), F.lit(1.0)),
        M.cells(sup, F.col("s_suppkey"), F.col("s_nationkey"), F.lit(1.0)),
    ]


matrix("gemm_hot_key", hot_product, mul(HOT, COLD))
matrix("sparse_chain", lambda s, d: coo.sparse_chain(sparse_factors(s, d)), mul(BY_PART, mul(PART_SUPPLY, HOME)))

# ---- kernel matrices over a table of points ------------------------------------------------------------------


def cluster_points(s, d):
    """The embeddings' first two components as points in the plane."""
    x = S.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    points, nodes = clusters.cluster_tree(x, 2)
    return points, nodes, clusters.blocks(nodes)


def cluster_cover(s, d):
    """For each point: partners in its blocks, and gaps or overlaps between these."""
    return clusters.coverage(*cluster_points(s, d)).select(F.col("id").alias("vec_id"), F.col("covered").cast("long").alias("covered"), "gaps")


def kernel_rows(s, d):
    """For points whose id is divisible by 50, held against all others: whether crosses and the product are near the kernel's own."""
    points, _, pairs = cluster_points(s, d)
    w = S.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[2].cast("double").alias("w"))
    some = F.col("id") % 50 == 0
    got = clusters.multiplied(points, pairs, w, some).join(clusters.plainly(points, w, some), "id")
    return got.select(F.col("id").alias("vec_id"), (F.col("off") <= 1e-4 * F.col("whole")).alias("crosses"), (F.abs(F.col("y") - F.col("want")) <= 1e-3 * F.col("size")).alias("product"))


register("cluster_cover", cluster_cover, "SELECT vec_id, (SELECT count(*) FROM embeddings) AS covered, CAST(0 AS BIGINT) AS gaps FROM embeddings")
register("kernel_product", kernel_rows, "SELECT vec_id, true AS crosses, true AS product FROM embeddings WHERE vec_id % 50 = 0")

# ---- regions and dependencies --------------------------------------------------------------------------------

PART_REGIONS = "SELECT p_partkey AS id, p_partkey * 24 AS ptr, CAST(8 + p_size + p_size % 9 AS BIGINT) AS pitch, CAST(8 + p_size AS BIGINT) AS width, CAST(1 + p_size % 5 AS BIGINT) AS height FROM part"
RUNS = f"SELECT id, ptr + r * pitch AS s, ptr + r * pitch + width AS e FROM ({PART_REGIONS}) JOIN range(0, 5) q(r) ON r < height"


def part_regions(s, d):
    size = F.col("p_size").cast("long")
    return S.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 24).alias("ptr"), (8 + size + size % 9).alias("pitch"), (8 + size).alias("width"), (1 + size % 5).alias("height"))


register("region_overlap", lambda s, d: deps.overlapping(part_regions(s, d), "id"), f"SELECT DISTINCT x.id AS a, y.id AS b FROM ({RUNS}) x JOIN ({RUNS}) y ON x.s < y.e AND y.s < x.e AND x.id < y.id")


#: A billion rows each, of a pitch of 1,000; a part's region reaches over the next few parts' ones.
TALL, PITCH = 10**9, 1000


def tall_regions(s, d):
    ptr = F.col("p_partkey") * (TALL * PITCH // 4 + 37)
    return S.table(s, d, "part").select(F.col("p_partkey").alias("id"), ptr.alias("ptr"), F.lit(PITCH).cast("long").alias("pitch"), (8 + F.col("p_size")).cast("long").alias("width"), F.lit(TALL).cast("long").alias("height"))


register(
    "region_overlap_tall",
    lambda s, d: deps.overlapping(tall_regions(s, d), "id"),
    f"WITH r AS (SELECT p_partkey AS id, p_partkey * {TALL * PITCH // 4 + 37} AS ptr, 8 + p_size AS w FROM part) SELECT a.id AS a, b.id AS b FROM r a, range(1, 5) k(k) JOIN r b ON b.id = a.id + k "
    f"WHERE ((b.ptr - a.ptr) % {PITCH} < a.w AND (b.ptr - a.ptr) // {PITCH} < {TALL}) OR ((b.ptr - a.ptr) % {PITCH} + b.w > {PITCH} AND (b.ptr - a.ptr) // {PITCH} + 1 < {TALL})",
)


def part_operands(s, d):
    return part_regions(s, d).select(F.expr("id div 4").alias("inst"), (F.col("id") % 4 != 0).alias("is_read"), "ptr", "pitch", "width", "height")


PART_DEPS = (
    f"SELECT x.id // 4 AS inst_from, y.id // 4 AS inst_to, CAST(bit_or(CASE WHEN x.id % 4 <> 0 THEN 2 WHEN y.id % 4 <> 0 THEN 1 ELSE 4 END) AS INTEGER) AS dep FROM ({RUNS}) x JOIN ({RUNS}) y "
    "ON x.s < y.e AND y.s < x.e AND x.id // 4 < y.id // 4 AND NOT (x.id % 4 <> 0 AND y.id % 4 <> 0) GROUP BY 1, 2"
)
register("dep_classify", lambda s, d: deps.classify(part_operands(s, d)), PART_DEPS)


def dep_table(s, d):
    return M.stored(deps.classify(part_operands(s, d)), "deps")


def dep_changes(s, d):
    """Every part gives two changes: first dep 4, then its size mod 5."""
    x = S.table(s, d, "part").select(F.expr("p_partkey div 4").alias("inst_from"), F.expr("p_partkey div 4 + 1").alias("inst_to"), F.col("p_size"), F.col("p_partkey"))
    return x.select("inst_from", "inst_to", F.expr("inline(array(struct(4 as dep, p_partkey * 2 as seq), struct(p_size % 5 as dep, p_partkey * 2 + 1 as seq)))"))


CHANGED = "SELECT p_partkey // 4 AS inst_from, p_partkey // 4 + 1 AS inst_to, arg_max(p_size % 5, p_partkey) AS new FROM part GROUP BY 1, 2"
register("dep_update", lambda s, d: deps.update(dep_table(s, d), dep_changes(s, d)), f"SELECT inst_from, inst_to, CAST(coalesce(new, dep) AS INTEGER) AS dep FROM ({PART_DEPS}) FULL JOIN ({CHANGED}) USING (inst_from, inst_to) WHERE coalesce(new, dep) <> 0")


def next_pairs(s, d):
    return S.table(s, d, "part").select(F.expr("p_partkey div 4").alias("inst_from"), F.expr("p_partkey div 4 + 2").alias("inst_to")).distinct()


register("dep_lookup", lambda s, d: deps.lookup(dep_table(s, d), next_pairs(s, d)), f"SELECT inst_from, inst_to, CAST(coalesce(dep, 0) AS INTEGER) AS dep FROM (SELECT DISTINCT p_partkey // 4 AS inst_from, p_partkey // 4 + 2 AS inst_to FROM part) LEFT JOIN ({PART_DEPS}) USING (inst_from, inst_to)")
register("dep_successors", lambda s, d: text_list(deps.successors(dep_table(s, d))), f"SELECT inst_from AS inst, string_agg(CAST(inst_to AS VARCHAR), ',' ORDER BY inst_to) AS others FROM ({PART_DEPS}) GROUP BY 1")
register("dep_predecessors", lambda s, d: text_list(deps.predecessors(dep_table(s, d))), f"SELECT inst_to AS inst, string_agg(CAST(inst_from AS VARCHAR), ',' ORDER BY inst_from) AS others FROM ({PART_DEPS}) GROUP BY 1")


def text_list(x: DataFrame) -> DataFrame:
    return x.select("inst", F.array_join(F.transform("others", lambda v: v.cast("string")), ",").alias("others"))


def all_changes(s, d):
    """A change of a pair for every line of an order: dep is its number mod 4, so some delete."""
    x = S.table(s, d, "lineitem")
    return x.select((F.col("l_suppkey") % 40).alias("inst_from"), (40 + F.col("l_partkey") % 60).alias("inst_to"), (F.col("l_linenumber") % 4).cast("int").alias("dep"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


CHANGES = "SELECT l_suppkey % 40 AS inst_from, 40 + l_partkey % 60 AS inst_to, CAST(l_linenumber % 4 AS INTEGER) AS dep, l_orderkey * 8 + l_linenumber AS seq FROM lineitem"
REPLAYED = (
    f"SELECT inst_from, inst_to, arg_max(dep, seq) AS dep, min(seq) FILTER (seq > gone) AS seq FROM (SELECT *, coalesce(max(CASE WHEN dep = 0 THEN seq END) OVER (PARTITION BY inst_from, inst_to), -1) AS gone FROM ({CHANGES})) "
    "GROUP BY inst_from, inst_to HAVING arg_max(dep, seq) <> 0"
)
register("dep_inserted", lambda s, d: text_list(deps.successors(deps.replayed(all_changes(s, d)))), f"SELECT inst_from AS inst, string_agg(CAST(inst_to AS VARCHAR), ',' ORDER BY seq, inst_to) AS others FROM ({REPLAYED}) GROUP BY 1")
register("dep_inserted_before", lambda s, d: text_list(deps.predecessors(deps.replayed(all_changes(s, d)))), f"SELECT inst_to AS inst, string_agg(CAST(inst_from AS VARCHAR), ',' ORDER BY seq, inst_from) AS others FROM ({REPLAYED}) GROUP BY 1")
register("dep_dump", lambda s, d: deps.dump(deps.replayed(all_changes(s, d))), f"SELECT inst_from, inst_to, dep FROM ({REPLAYED}) ORDER BY 1, 2")


#: Changes in a file of the stream, about.
FILE_CHANGES = 1 << 20


def dep_stream(s, d):
    """The same table by a stream of the changes, dealt over four batches in no order, of as many files as rows ask for."""
    from tessera.streaming import dependencies

    folder = M.shared_folder(s, "dep-stream")
    changes = all_changes(s, d).select(F.col("inst_from").cast("long"), F.col("inst_to").cast("long"), F.col("dep").cast("int"), F.col("seq").cast("long"))
    files = max(1, -(-changes.count() // (4 * FILE_CHANGES)))
    changes.repartition(4 * files, F.xxhash64("inst_from", "inst_to", "seq")).write.parquet(f"{folder}/changes")
    return dependencies.run_stream(f"{folder}/changes", changes.schema, folder, s, files)


register("dep_stream", dep_stream, f"SELECT inst_from, inst_to, dep, seq FROM ({REPLAYED})")
register(
    "dep_levels",
    lambda s, d: paths.levels(dep_table(s, d), S.table(s, d, "part").select(F.expr("p_partkey div 4").alias("inst")).distinct()),
    f"WITH RECURSIVE e AS MATERIALIZED ({PART_DEPS}), l AS (SELECT DISTINCT p_partkey // 4 AS inst, 0 AS level FROM part UNION SELECT e.inst_to, l.level + 1 FROM l JOIN e ON e.inst_from = l.inst) SELECT inst, max(level) AS level FROM l GROUP BY 1",
)
register(
    "dep_reduced",
    lambda s, d: paths.reduced(dep_table(s, d)),
    f"WITH RECURSIVE e AS MATERIALIZED ({PART_DEPS}), r AS (SELECT inst_from AS u, inst_to AS v FROM e UNION SELECT r.u, e.inst_to FROM r JOIN e ON e.inst_from = r.v) "
    "SELECT inst_from, inst_to, dep FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN r ON r.u = x.inst_to WHERE x.inst_from = e.inst_from AND r.v = e.inst_to)",
)
register("dep_mirrored", lambda s, d: deps.mirrored(dep_table(s, d)), f"SELECT inst_to AS inst_from, inst_from AS inst_to, dep FROM ({PART_DEPS})")
register("dep_degrees", lambda s, d: deps.degrees(dep_table(s, d), part_operands(s, d).select("inst").distinct()), f"SELECT inst, CAST((SELECT count(*) FROM ({PART_DEPS}) e WHERE e.inst_from = inst) AS BIGINT) AS deps_from, CAST((SELECT count(*) FROM ({PART_DEPS}) e WHERE e.inst_to = inst) AS BIGINT) AS deps_to FROM (SELECT DISTINCT p_partkey // 4 AS inst FROM part)")
register("dep_clear", lambda s, d: deps.cleared(dep_table(s, d)), f"SELECT * FROM ({PART_DEPS}) WHERE false")
register("dep_combine", lambda s, d: dep_table(s, d).groupBy("dep").agg(F.count("*").alias("n")).select("dep", deps.combined(F.col("dep"), F.lit(2)).alias("with_anti"), deps.stronger(F.col("dep"), F.lit(1)).alias("above_flow"), "n"), f"SELECT dep, dep | 2 AS with_anti, dep > 1 AS above_flow, count(*) AS n FROM ({PART_DEPS}) GROUP BY dep")

# ---- task graphs ---------------------------------------------------------------------------------------------

GRID = 8


def tasks_sql(n: int) -> str:
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY k, part, i, j) - 1 AS BIGINT) AS inst, op, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(CASE op WHEN 'getrf' THEN 2 WHEN 'gemm' THEN 6 ELSE 3 END AS BIGINT) AS flops FROM (SELECT k, i, j, CASE WHEN i = k AND j = k THEN 'getrf' WHEN i = k THEN 'trsml' WHEN j = k THEN 'trsmr' ELSE 'gemm' END AS op, "
        f"CASE WHEN i = k AND j = k THEN 0 WHEN i = k THEN 1 WHEN j = k THEN 2 ELSE 3 END AS part FROM range(0, {n}) a(k) JOIN range(0, {n}) b(i) ON i >= k JOIN range(0, {n}) c(j) ON j >= k)"
    )


TASKS = tasks_sql(GRID)
TILES = "SELECT inst, i, j, false AS r FROM t UNION ALL SELECT inst, k, k, true FROM t WHERE op IN ('trsml', 'trsmr') UNION ALL SELECT inst, i, k, true FROM t WHERE op = 'gemm' UNION ALL SELECT inst, k, j, true FROM t WHERE op = 'gemm'"


def edges_sql(tasks_: str) -> str:
    return f"WITH t AS ({tasks_}), o AS ({TILES}) SELECT x.inst AS inst_from, y.inst AS inst_to, CAST(bit_or(CASE WHEN x.r THEN 2 WHEN y.r THEN 1 ELSE 4 END) AS INTEGER) AS dep FROM o x JOIN o y ON x.i = y.i AND x.j = y.j AND x.inst < y.inst AND NOT (x.r AND y.r) GROUP BY 1, 2"


EDGES = edges_sql(TASKS)
register("lu_tasks", lambda s, d: tasks.lu_tasks(s, GRID), TASKS)
register("dag_edges", lambda s, d: tasks.dag_edges(s, GRID), EDGES)
register("dag_density", lambda s, d: tasks.density(tasks.dag_edges(s, GRID), 204).select(F.round("density", 8).alias("density")), f"SELECT round(count(*) / (204 * 203 / 2), 8) AS density FROM ({EDGES})")
register("dag_levels", lambda s, d: tasks.levels(tasks.dag_edges(s, GRID), tasks.lu_tasks(s, GRID)), f"WITH RECURSIVE e AS ({EDGES}), v AS (SELECT inst_to AS inst, CAST(1 AS BIGINT) AS level FROM e WHERE inst_from NOT IN (SELECT inst_to FROM e) UNION SELECT e.inst_to, v.level + 1 FROM v JOIN e ON e.inst_from = v.inst) SELECT t.inst, coalesce(max(level), 0) AS level FROM ({TASKS}) t LEFT JOIN v ON v.inst = t.inst GROUP BY t.inst")
register("batch_slices", lambda s, d: tasks.batch_slices(tasks.lu_tasks(s, GRID), 50), f"SELECT inst, inst // 50 AS slice, inst // 50 * 50 AS start FROM ({TASKS})")


SIZES, WORKERS = (3, 4, 8), 2


def graphs(s):
    """LU graphs of several sizes (tiles a side), as (tasks, edges) with the size as dag."""
    t, e = zip(*((tasks.lu_tasks(s, n).withColumn("dag", F.lit(n).cast("long")), tasks.dag_edges(s, n).withColumn("dag", F.lit(n).cast("long"))) for n in SIZES), strict=True)
    return t[0].unionByName(t[1]).unionByName(t[2]), e[0].unionByName(e[1]).unionByName(e[2])


def scheduled(s):
    t, e = graphs(s)
    return M.stored(schedule.schedule(t, e, WORKERS), "schedule"), t


def union_sql(make) -> str:
    return " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS dag, * FROM ({make(tasks_sql(n))})" for n in SIZES)


ALL_TASKS = union_sql(lambda t: t)
#: The policy of schedule.py for two workers, a decision in each step of the recursion. Lists count from 1.
STATE = "STRUCT(t BIGINT, a BIGINT, v BIGINT)[]"
SCHEDULE = f"""
WITH RECURSIVE task AS ({ALL_TASKS}), edge AS ({union_sql(edges_sql)}),
graph AS (
    SELECT dag, list(flops ORDER BY inst) AS flops, list(after ORDER BY inst) AS after, list(before ORDER BY inst) AS before FROM (
        SELECT dag, inst, flops, coalesce((SELECT list(inst_to ORDER BY inst_to) FROM edge e WHERE e.dag = t.dag AND e.inst_from = t.inst), CAST([] AS BIGINT[])) AS after,
            coalesce((SELECT list(inst_from ORDER BY inst_from) FROM edge e WHERE e.dag = t.dag AND e.inst_to = t.inst), CAST([] AS BIGINT[])) AS before
        FROM task t) GROUP BY dag
), state AS (
    SELECT dag, len(list_filter(before, lambda b: len(b) = 0)) AS arrived,
        CAST(list_transform(list_reverse_sort(list_filter(range(len(flops)), lambda v: len(before[v + 1]) = 0)), lambda v, n: {{'t': 0, 'a': n - 1, 'v': v}}) AS {STATE}) AS ready,
        CAST([0, 0] AS BIGINT[]) AS load, CAST([0, 0] AS BIGINT[]) AS waited, list_transform(before, lambda b: CAST(len(b) AS BIGINT)) AS missing,
        list_transform(flops, lambda f: CAST(0 AS BIGINT)) AS ends, list_transform(flops, lambda f: CAST(-1 AS BIGINT)) AS ran,
        CAST([] AS STRUCT(worker BIGINT, inst BIGINT, is_exec BOOLEAN, start_flops BIGINT)[]) AS done
    FROM graph
    UNION ALL
    SELECT dag, arrived + len(free), list_concat(list_filter(ready, lambda x: x.a <> pick.a), CAST(list_transform(free, lambda v, n: {{'t': list_max(list_transform(before[v + 1], lambda p: ends2[p + 1])), 'a': arrived + n - 1, 'v': v}}) AS {STATE})),
        list_transform(load, lambda x, n: CASE WHEN n = mine + 1 THEN start_ + greatest(flops[pick.v + 1], 1) ELSE x END),
        list_transform(waited, lambda x, n: CASE WHEN n = mine + 1 AND needs THEN until ELSE x END), missing2, ends2,
        list_transform(ran, lambda x, n: CASE WHEN n = pick.v + 1 THEN mine ELSE x END),
        list_concat(list_concat(done, CASE WHEN needs THEN [{{'worker': mine, 'inst': last, 'is_exec': false, 'start_flops': load[mine + 1]}}] ELSE [] END), [{{'worker': mine, 'inst': pick.v, 'is_exec': true, 'start_flops': start_}}])
    FROM (
        SELECT *, list_reverse_sort(list_filter(after[pick.v + 1], lambda v: missing2[v + 1] = 0)) AS free FROM (
            SELECT *, list_transform(ends, lambda x, n: CASE WHEN n = pick.v + 1 THEN start_ + greatest(flops[pick.v + 1], 1) ELSE x END) AS ends2,
                list_transform(missing, lambda x, n: x - CASE WHEN list_contains(after[pick.v + 1], n - 1) THEN 1 ELSE 0 END) AS missing2
            FROM (SELECT *, CASE WHEN needs THEN greatest(load[mine + 1], until) ELSE load[mine + 1] END AS start_ FROM (
                SELECT *, ends[last + 1] AS until, last IS NOT NULL AND ends[last + 1] > waited[mine + 1] AS needs FROM (
                    SELECT *, list_sort(list_transform(list_filter(before[pick.v + 1], lambda p: ran[p + 1] = 1 - mine), lambda p: {{'e': -ends[p + 1], 'p': p}}))[1].p AS last FROM (
                        SELECT *, CASE WHEN load[1] <= pick.t AND load[2] <= pick.t THEN CASE WHEN load[2] > load[1] THEN 1 ELSE 0 END WHEN load[1] <= pick.t THEN 0 WHEN load[2] <= pick.t THEN 1 WHEN load[2] < load[1] THEN 1 ELSE 0 END AS mine FROM (
                            SELECT s.*, g.flops, g.after, g.before, coalesce(
                                list_sort(list_transform(list_filter(s.ready, lambda x: x.t <= list_min(s.load)), lambda x: {{'f': -len(g.after[x.v + 1]), 't': x.t, 'a': x.a, 'v': x.v}}))[1],
                                list_sort(list_transform(s.ready, lambda x: {{'f': CAST(0 AS BIGINT), 't': x.t, 'a': x.a, 'v': x.v}}))[1]) AS pick
                            FROM state s JOIN graph g ON g.dag = s.dag WHERE len(s.ready) > 0
    )))))))
), flat AS (SELECT dag, unnest(done) AS x, generate_subscripts(done, 1) AS n FROM state WHERE len(ready) = 0)
SELECT dag, CAST(x.worker AS INTEGER) AS worker, CAST(row_number() OVER (PARTITION BY dag, x.worker ORDER BY n) - 1 AS INTEGER) AS seq, x.inst AS inst, x.is_exec AS is_exec, x.start_flops AS start_flops FROM flat"""
LOADS = f"SELECT dag, worker, max(start_flops + flops) AS load FROM ({SCHEDULE}) s JOIN ({ALL_TASKS}) t USING (dag, inst) WHERE is_exec GROUP BY dag, worker"
register("schedule", lambda s, d: scheduled(s)[0], SCHEDULE)
register(
    "sched_summary",
    lambda s, d: schedule.summary(*scheduled(s), WORKERS).select("dag", "instructions", *[F.round(c, 6).alias(c) for c in ("heaviest_percent", "utilisation_percent", "waits_per_instruction")]),
    f"SELECT l.dag, n AS instructions, round(100.0 * top / total, 6) AS heaviest_percent, round(CAST(100.0 AS DOUBLE) * total / top / {WORKERS}, 6) AS utilisation_percent, round(CAST(waits AS DOUBLE) / n, 6) AS waits_per_instruction "
    f"FROM (SELECT dag, max(load) AS top FROM ({LOADS}) GROUP BY dag) l JOIN (SELECT dag, sum(flops) AS total, count(*) AS n FROM ({ALL_TASKS}) GROUP BY dag) USING (dag) JOIN (SELECT dag, count(*) FILTER (NOT is_exec) AS waits FROM ({SCHEDULE}) GROUP BY dag) USING (dag)",
)
register("sched_loads", lambda s, d: schedule.loads(*scheduled(s)), LOADS)
register("sched_smallest_load", lambda s, d: schedule.smallest_load(*scheduled(s), WORKERS), f"SELECT dag, min(load) AS load FROM ({LOADS}) GROUP BY dag")
register("sched_elapsed", lambda s, d: schedule.elapsed(scheduled(s)[0]), f"SELECT *, lead(start_flops) OVER (PARTITION BY dag, worker ORDER BY seq) - start_flops AS elapsed_flops FROM ({SCHEDULE})")
register("sched_execution_list", lambda s, d: schedule.execution_list(scheduled(s)[0]).withColumn("insts", F.array_join(F.transform("insts", lambda v: v.cast("string")), ",")), f"SELECT dag, worker, string_agg(CAST(inst AS VARCHAR), ',' ORDER BY seq) AS insts FROM ({SCHEDULE}) WHERE is_exec GROUP BY dag, worker")
register("sched_lengths", lambda s, d: schedule.lengths(scheduled(s)[0].where("dag = 8"), 3), f"SELECT CAST(w AS INTEGER) AS worker, count(x.worker) AS length FROM range(0, 3) q(w) LEFT JOIN ({SCHEDULE}) x ON x.worker = w AND x.dag = 8 GROUP BY w")


def lu_program(s, t: int, tile: int):
    return machine.lu_streams(scheduled(s)[0].where(F.col("dag") == t), tasks.lu_tasks(s, t), t, tile)


def words_sql(t: int, tile: int) -> str:
    """Words of tiled LU as text: opcode, signal, operation, operands."""
    n = t * tile
    at = lambda i, j: f"{i} * {tile * n} + {j} * {tile}"
    words = {
        "getrf": [1, 0, at("k", "k"), tile, tile, n], "trsml": [2, 0, 0, at("k", "j"), at("k", "k"), tile, tile, tile, n, n, 0],
        "trsmr": [3, 0, 0, at("i", "k"), at("k", "k"), tile, tile, tile, n, n, 0], "gemm": [4, 0, 0, 0, at("i", "j"), at("i", "k"), at("k", "j"), tile, tile, tile, n, n, n, 0, 0],
    }
    text = " ".join(f"WHEN op = '{op}' THEN concat_ws(',', 0, inst, {', '.join(map(str, w))})" for op, w in words.items())
    return (
        f"WITH p AS (SELECT worker, seq, inst, is_exec FROM ({SCHEDULE}) WHERE dag = {t}) SELECT worker, seq, CASE WHEN NOT is_exec THEN concat_ws(',', 1, inst, 0) {text} END AS words FROM p JOIN ({tasks_sql(t)}) USING (inst) "
        "UNION ALL SELECT worker, max(seq) + 1, '2' FROM p GROUP BY worker"
    )


register("inst_stream", lambda s, d: lu_program(s, GRID, 4).withColumn("words", F.array_join(F.transform("words", lambda v: v.cast("string")), ",")), words_sql(GRID, 4))


def memory(*parts) -> DataFrame:
    """(m, pos, v) of matrices (number, cells, columns)."""
    out = [c.select(F.lit(m).alias("m"), (F.col("i") * n + F.col("j")).alias("pos"), "v") for m, c, n in parts]
    return out[0] if len(out) == 1 else out[0].union(memory(*parts[1:]))


def read_back(mem: DataFrame, columns: int) -> DataFrame:
    return mem.select(F.expr(f"pos div {columns}").alias("i"), (F.col("pos") % columns).alias("j"), "v")


matrix("inst_run", lambda s, d: read_back(machine.run(memory((0, SPD(s, d), 12)), lu_program(s, 3, 4)), 12), LU_SQL)


def program(s, streams) -> DataFrame:
    """Streams of instructions, a list for each worker, with their ends."""
    return s.createDataFrame([(w, n, x) for w, own in enumerate(streams) for n, x in enumerate([*own, [machine.FINISH]])], machine.STREAM)


def every_operation(s, d):
    """Matrices 10 to 16, each written by an instruction of another kind; worker 1 waits for what worker 0 wrote."""
    e = machine.encode
    mem = memory((0, f("p")(s, d), 7), (1, f("r")(s, d), 12), (2, f("t")(s, d), 5), (3, f("u")(s, d), 25), (13, f("w")(s, d), 3), (4, S.boosted(g12(s, d), 12, 10.0), 12), (5, f("d")(s, d), 3))
    p, r, t, u = (0, 0, 7), (1, 0, 12), (2, 0, 5), (3, 0, 25)
    first = [
        e(0, "nop"),
        e(1, "gemm_plus", [(10, 0, 12), p, r], [25, 12, 7], [0, 0]),
        e(2, "gemm_3x", [(11, 0, 5), p, r, t], [25, 5, 7, 12], [0, 0, 0], 1),
        e(3, "getrf", [(4, 0, 12)], [12, 12]),
    ]
    second = [
        e(4, "gemm_4x", [(12, 0, 25), p, r, t, u], [25, 25, 7, 12, 5], [0, 0, 0, 0], 4),
        [machine.SIGNAL_WAIT, 3, 0],
        e(5, "trsmr", [(13, 0, 3), (4, 0, 12)], [12, 3, 12], [1]),  # matrix 13 holds B transposed
        [machine.SIGNAL_WAIT, 1, 0],
        e(6, "gemm", [(14, 0, 25), (10, 0, 12), (10, 0, 12)], [25, 25, 12], [0, 1]),
        e(7, "gemm_3x", [(15, 0, 3), r, p, (16, 0, 3)], [12, 3, 7, 25], [1, 1, 0], 0),
    ]
    mem = mem.union(memory((16, coo.gemm(f("p")(s, d), f("d")(s, d)), 3)))
    out = machine.run(mem, program(s, [first, second])).where("m >= 10 and m < 16")
    columns = {10: 12, 11: 5, 12: 25, 13: 3, 14: 25, 15: 3}
    n = F.element_at(F.create_map(*[F.lit(x) for p in columns.items() for x in p]), F.col("m"))
    return out.select("m", F.floor(F.col("pos") / n).cast("long").alias("i"), (F.col("pos") % n).cast("long").alias("j"), (F.round("v", 3) + 0.0).alias("v")).where("v <> 0")  # an absent cell is 0


def minus(m: str) -> str:
    return f"SELECT i, j, -v AS v FROM ({m})"


WRITTEN = {
    10: mul(P, R), 11: minus(mul(mul(P, R), T)), 12: minus(mul(mul(P, R), mul(T, U))), 13: flip(trsmr_sql(S.dense_sql(flip(W), 3, 12), f"SELECT * FROM ({LU_SQL})", 12)),
    14: minus(mul(mul(P, R), flip(mul(P, R)))), 15: minus(mul(flip(R), mul(flip(P), mul(P, D)))),
}
register("inst_program", every_operation, " UNION ALL ".join(f"SELECT CAST({m} AS INTEGER) AS m, i, j, round(v, 3) + 0.0 AS v FROM ({q}) WHERE round(v, 3) <> 0" for m, q in WRITTEN.items()))


def accumulated(s, d):
    """U Vᵀ of the block that an accum instruction has added another one to."""
    pd_ = coo.gemm(f("p")(s, d), f("d")(s, d))
    mem = memory((0, f("p")(s, d), 7), (1, coo.transpose(f("r")(s, d)), 7), (2, pd_, 3), (3, f("w")(s, d), 3))
    out = M.stored(machine.run(mem, program(s, [[machine.encode(0, "accum", [(0, 0, 7), (1, 0, 7), (2, 0, 3), (3, 0, 3)], [12, 25, 7, 3])]])), "accum")
    return coo.gemm(read_back(out.where("m = 0"), 7), read_back(out.where("m = 1"), 7), b_t=True)


matrix("inst_accum", accumulated, S.dense_sql(add(mul(P, R), mul(mul(P, D), flip(W)), 1, 1), 25, 12), 3)

# ---- profile -------------------------------------------------------------------------------------------------

register(
    "timer_elapsed",
    lambda s, d: profile.timer_elapsed(S.table(s, d, "events"), "event_type", "ts", "event_id"),
    "SELECT event_type AS name, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type) AS elapsed_us FROM events QUALIFY n > 0",
)
MINUTE = 60_000_000


def tick():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def kind():
    return F.when(F.col("value") >= 10, "execute").otherwise("wait")


register(
    "clock_cells",
    lambda s, d: profile.clock_cells(S.table(s, d, "events"), "event_type", tick(), F.floor("value").cast("long") % 2, 60 * MINUTE),
    f"SELECT event_type AS worker, CAST((epoch_us(ts) - t0) // {60 * MINUTE} AS BIGINT) AS cell, CAST(floor(value) AS BIGINT) % 2 AS kind, count(*) AS n FROM events JOIN (SELECT event_type, min(epoch_us(ts)) AS t0 FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2, 3",
)
register(
    "clock_strip",
    lambda s, d: profile.clock_strip(profile.clock_cells(S.table(s, d, "events"), "event_type", tick(), kind(), 60 * MINUTE), 24),
    f"WITH c AS (SELECT event_type AS worker, (epoch_us(ts) - t0) // {60 * MINUTE} AS cell, CASE WHEN value >= 10 THEN 'execute' ELSE 'wait' END AS kind, count(*) AS n FROM events JOIN (SELECT event_type, min(epoch_us(ts)) AS t0 FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2, 3), "
    "m AS (SELECT worker, cell, arg_max(kind, (n, kind)) AS kind FROM c GROUP BY 1, 2) SELECT worker, CAST(cell // 24 AS BIGINT) AS row, string_agg(kind[1], '' ORDER BY cell) AS strip FROM m GROUP BY 1, 2",
)
register("total_ticks", lambda s, d: profile.total_ticks(S.table(s, d, "events"), "event_type", tick()), "SELECT event_type AS worker, max(epoch_us(ts)) - min(epoch_us(ts)) AS ticks FROM events GROUP BY 1")


def flop_rows(s, d):
    """A run for each brand: n from its parts, work from their sizes, milliseconds from their prices."""
    x = S.table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), (F.sum("p_size") * 1000.0).alias("flops"), F.sum("p_retailprice").alias("ms"))
    x = profile.flop_report(x.withColumn("dense", profile.dense_lu_flops(F.col("n").cast("double"))), "flops", "dense", "ms")
    value, unit = profile.scaled_unit(F.col("dense"))
    return x.select("p_brand", F.round("dense", 4).alias("dense"), F.round("ratio_percent", 4).alias("ratio_percent"), F.round("rate", 4).alias("rate"), F.round("dense_rate", 4).alias("dense_rate"), F.round(value, 4).alias("dense_scaled"), unit.alias("dense_unit"))


register(
    "flop_report",
    flop_rows,
    "WITH b AS (SELECT p_brand, CAST(count(*) AS DOUBLE) AS n, sum(p_size) * 1000.0 AS flops, sum(p_retailprice) AS ms FROM part GROUP BY 1), x AS (SELECT *, 2.0 * n * n * n / 3.0 AS dense FROM b), y AS (SELECT *, CAST(100.0 * flops / dense AS DOUBLE) AS ratio, CAST(1000.0 * flops / ms AS DOUBLE) AS rt, least(4, greatest(0, CAST(floor(log10(greatest(dense, 1.0)) / 3) AS INTEGER))) AS step FROM x) "
    "SELECT p_brand, round(CAST(dense AS DOUBLE), 4) AS dense, round(ratio, 4) AS ratio_percent, round(rt, 4) AS rate, round(rt * 100.0 / ratio, 4) AS dense_rate, round(CAST(dense AS DOUBLE) / pow(1000.0, step), 4) AS dense_scaled, ['', 'K', 'M', 'G', 'T'][step + 1] AS dense_unit FROM y",
)
