"""Hierarchical matrices over a table of points: cluster tree, admissible blocks, cross approximation, product.

The matrix is a kernel of pairs of points; it is never formed.

* The cluster tree splits clusters at the approximate median of their widest coordinate, all clusters of a level in one
  pass. Node 1 is the root, 2 k and 2 k + 1 are the children of k. Clusters of at most ``leaf`` points, or of equal
  points, are leaves.
* A pair of clusters is admissible if neither box's diameter is over ``eta`` times their distance. From the root's pair
  on, pairs that aren't are split, level by level, until both sides are leaves. The blocks partition all pairs.
* An admissible block is approximated by crosses: a row of what is left, the column where that is largest, the row where
  that column is largest, and so on. Points of a node are one row, blocks are grouped by nodes of at most `AT_ONCE` points
  above theirs, larger ones by nodes of up to 8, 64, ... times as many, and a task takes all steps of its groups' blocks; factors need not leave it (`multiplied`).
* Blocks of over `SPREAD` points on a side take a step together; each reads single rows and columns, which are
  rows of two tables (block, point), so they are spread over tasks. Blocks leave when a cross is small enough.
* The product with a vector sums V^T x by block and adds U times that by point, and adds pairs of points of leaf blocks.

Points with a null id or a null coordinate take no part; equal points are one cluster's. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import crosses
from tessera.sources.matrices import dropped, stored

FEW_NODES = 1 << 14  # nodes that are broadcast to points; more have so few points each that they are shuffled
AT_ONCE = 512  # points of the nodes whose blocks go to a task together, at most; of larger ones' nodes 8, 64, ... times as many
SPREAD = 1 << 17  # points on a side of a block that one task takes, at most
TASK_POINTS = 1 << 18  # of both sides of all blocks in a task, about
PACK = 1 << 12  # points in a row when all are held against all, about


def _known(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= FEW_NODES else nodes


def cluster_tree(points: DataFrame, dims: int, leaf: int = 32) -> tuple[DataFrame, DataFrame]:
    """((id, x, node), (node, n, lo, hi, is_leaf, first)) of points (id, x): the leaf of each, and all nodes of the tree.

    first: the points in leaves before the node's, so that a node is the interval [first, first + n) of the order of leaves.
    """
    at = [F.element_at("x", d + 1) for d in range(dims)]
    whole = F.size("x") >= dims
    for c in at:
        whole = whole & c.isNotNull()
    now = stored(points.where(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False))).select("id", F.slice("x", 1, dims).alias("x"), F.lit(1).cast("long").alias("node"), F.lit(True).alias("open")), "tree")
    levels = []
    while True:
        lo, hi = F.array(*map(F.min, at)), F.array(*map(F.max, at))
        cut = F.array(*[F.percentile_approx(c, 0.5, 1000) for c in at])
        stats = now.where("open").groupBy("node").agg(F.count("*").alias("n"), lo.alias("lo"), hi.alias("hi"), cut.alias("cut"))
        widest = F.array_max(F.transform(F.arrays_zip("lo", "hi"), lambda z, k: F.struct((z["hi"] - z["lo"]).alias("width"), (-k).alias("d"))))
        stats = stats.withColumn("w", widest).select("node", "n", "lo", "hi", ((F.col("n") <= leaf) | (F.col("w.width") <= 0)).alias("is_leaf"), (-F.col("w.d") + 1).alias("d"), F.element_at("cut", -F.col("w.d") + 1).alias("cut"))
        level = stored(stats, "tree-level")
        levels.append(level)
        split = level.where("not is_leaf").select("node", "d", "cut", (F.col("cut") >= F.element_at("hi", F.col("d"))).alias("last"))
        if split.isEmpty():
            break
        x = F.element_at("x", F.col("d"))
        right = F.when(F.col("last"), x >= F.col("cut")).otherwise(x > F.col("cut")).cast("long")
        after = now.join(_known(split), "node", "left").select("id", "x", F.when(F.col("d").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right).alias("node"), F.col("d").isNotNull().alias("open"))
        before, now = now, stored(after, "tree")
        dropped(before)
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    nodes = nodes.select("node", "n", "lo", "hi", "is_leaf")
    ups = nodes.select("node", F.explode(F.filter(ancestors(F.col("node")), lambda a: (a > 1) & (a % 2 == 1))).alias("a"))
    first = ups.join(nodes.select((F.col("node") + 1).alias("a"), "n"), "a").groupBy("node").agg(F.sum("n").alias("first"))
    tree = stored(nodes.join(first, "node", "left").withColumn("first", F.coalesce("first", F.lit(0))), "tree-nodes")
    dropped(*levels)
    return now.select("id", "x", "node"), tree


def ancestors(node: Column) -> Column:
    """A node and all above it, as an array."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", node, k)), lambda a: a >= 1)


def _gap(a: str, b: str) -> tuple[Column, Column]:
    """(diameter of the larger box, distance between the boxes), both squared."""
    square = lambda acc, v: acc + v * v
    wide = lambda s: F.aggregate(F.zip_with(f"{s}_hi", f"{s}_lo", lambda h, l: h - l), F.lit(0.0), square)
    one = lambda p, q: F.zip_with(f"{p}_lo", f"{q}_hi", lambda l, h: F.greatest(F.lit(0.0), l - h))
    apart = F.aggregate(F.zip_with(one(a, b), one(b, a), lambda p, q: F.greatest(p, q)), F.lit(0.0), square)
    return F.greatest(wide(a), wide(b)), apart


def blocks(nodes: DataFrame, eta: float = 1.0) -> DataFrame:
    """(a, b, low): pairs of clusters that partition all pairs of points; low: admissible, or else both are leaves."""
    found, now = [], nodes.where("node = 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("lo", "hi", "is_leaf")])
    while True:
        diameter, apart = _gap("a", "b")
        state = F.when(diameter <= eta * eta * apart, 1).when(F.col("a_is_leaf") & F.col("b_is_leaf"), 0).otherwise(2)
        level = stored(now.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_is_leaf", "b_is_leaf", state.alias("state")), "blocks")
        found.append(level)
        open_ = level.where("state = 2")
        if open_.isEmpty():
            break
        down = lambda s: F.explode(F.when(F.col(f"{s}_is_leaf"), F.array(F.col(s))).otherwise(F.array(F.col(s) * 2, F.col(s) * 2 + 1)))
        now = open_.select(down("a").alias("a"), "b", "b_is_leaf").select("a", down("b").alias("b"))
    out = found[0]
    for level in found[1:]:
        out = out.union(level)
    out = stored(out.where("state < 2").select("a", "b", (F.col("state") == 1).alias("low")), "blocks")
    dropped(*found)
    return out


def members(points: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """(a, b, id, x): the points of each block on one side, by the nodes above their leaves."""
    above = points.select("id", "x", F.explode(ancestors(F.col("node"))).alias(side))
    return above.join(pairs.select("a", "b"), side).select("a", "b", "id", "x")


def coverage(points: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, covered, gaps): partners that a point's blocks hold, and where these, in the order of leaves, leave gaps or overlap."""
    at = members(points, pairs, "a").join(nodes.select(F.col("node").alias("b"), "first", "n"), "b").select("id", "first", (F.col("first") + F.col("n")).alias("to"))
    before = F.coalesce(F.lag("to").over(Window.partitionBy("id").orderBy("first")), F.lit(0))
    return at.select("id", "first", "to", before.alias("before")).groupBy("id").agg(F.sum(F.col("to") - F.col("first")).alias("covered"), F.sum((F.col("before") != F.col("first")).cast("long")).alias("gaps"))


def inverse_square(x, y, soft: float = 0.01):
    """1 / (soft + |x - y|^2), for points: columns of arrays, or in a task arrays whose first axis has the coordinates."""
    if not isinstance(x, Column):
        return 1 / (soft + sum((p - q) ** 2 for p, q in zip(x, y)))
    return 1 / (F.lit(soft) + F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def _left(kernel: Column, mine: str, other: str) -> Column:
    """What earlier crosses leave of a cell: the kernel less the sum of products of factors."""
    return kernel - F.aggregate(F.zip_with(mine, other, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


_BLOCK = ["a", "b"]
CALM = crosses.CALM


def _from_to(node: str, name: str) -> list[Column]:
    """Where a node's leaves begin and end in the order of leaves: its number, and the last below it, at 63 binary digits."""
    up = F.lit(63) - F.length(F.bin(node))
    first, wide = (F.call_function("shiftleft", c, up) for c in (F.col(node), F.lit(1).cast("long")))
    return [first.alias(f"{name}_lo"), (first + (wide - 1)).alias(f"{name}_hi")]


def _grouped(points: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((left, right, blocks), pairs that are left): rows as `crosses` reads them, and blocks for more than a task, if any.

    left, right: all columns of points but node, as an array of the points of two nodes; blocks: those of their descendants.
    """
    spark = points.sparkSession
    counts = points.select(F.explode(ancestors(F.col("node"))).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    counts = stored(counts, "cross-counts")
    ups = counts.select("node", "n", F.explode(ancestors(F.col("node"))).alias("up")).join(counts.select(F.col("node").alias("up"), F.col("n").alias("held")), "up")
    edges = [AT_ONCE * 8**k for k in range(20) if AT_ONCE * 8**k < SPREAD] + [SPREAD]
    edge = F.array_min(F.filter(F.array(*map(F.lit, edges)), lambda e: e >= F.col("n")))  # so that a point goes along once for three levels
    tops = ups.groupBy("node", "n").agg(F.min(F.when(F.col("held") <= edge, F.col("up"))).alias("top")).select("node", "n", F.coalesce("top", "node").alias("top"))
    of = lambda s: tops.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("top").alias(f"g{s}"))
    here = F.greatest("na", "nb") <= SPREAD
    held = stored(pairs.join(of("a"), "a").join(of("b"), "b").withColumn("here", here), "cross-blocks")
    dropped(counts)
    total, more = held.agg(F.sum(F.when(F.col("here"), F.col("na") + F.col("nb"))), F.count(F.when(~F.col("here"), 1))).first()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(-(-(total or 0) // TASK_POINTS), usual)
    senders = max(tasks // 16, usual)  # nodes go to many groups each, so few rows make much to send
    few = held.where("here").repartition(tasks, "ga", "gb")
    blocks_ = few.groupBy("ga", "gb").agg(F.collect_list(F.struct("a", "b", "low", *_from_to("a", "a"), *_from_to("b", "b"))).alias("blocks"))
    keys = held.where("here").select("ga", "gb").distinct()
    wanted = keys.select(F.explode(F.array("ga", "gb")).alias("g")).distinct()
    rows = points.select(F.struct(_from_to("node", "at")[0].alias("at"), *[c for c in points.columns if c != "node"]).alias("p"), F.explode(ancestors(F.col("node"))).alias("g"))
    packed = stored(rows.join(wanted, "g").groupBy("g").agg(F.sort_array(F.collect_list("p")).alias("p")), "cross-points")
    side = lambda g, name: keys.repartition(senders, g).join(packed.select(F.col("g").alias(g), F.col("p").alias(name)).repartition(senders, g), g).repartition(tasks, "ga", "gb")
    out = blocks_.join(side("ga", "left"), ["ga", "gb"]).join(side("gb", "right"), ["ga", "gb"]).select("left", "right", "blocks")
    return out, held.where("not here").select("a", "b", "low") if more else None


def cross_approximation(points: DataFrame, pairs: DataFrame, kernel=inverse_square, eps: float = 1e-4, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """((a, b, id, f), (a, b, id, f)): factors U by row and V by column of each admissible block, block = U V^T to eps.

    A cross is small if its |u| |v| is at most eps of the norm of what the block holds, as when nothing is left in its
    row. The next row is then the one whose point is farthest from all that were read, and a block stops at `CALM` small
    crosses in a row, or when it has no row of another point. Raises if a block doesn't within `most` crosses.
    """
    rows, more = _grouped(points.select("id", "x", "node"), pairs.where("low"))
    kind = dict(points.dtypes)["id"]
    found = stored(rows.mapInArrow(crosses.factors(kernel, eps, most), f"a bigint, b bigint, side int, id {kind}, f array<double>"), "cross-out")
    out = [found.where(F.col("side") == k).drop("side") for k in (0, 1)]
    if more is not None:
        out = [t.union(s) for t, s in zip(out, _spread(points, more, kernel, eps, most))]
    return out[0], out[1]


def _spread(points: DataFrame, low: DataFrame, kernel, eps: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The factors of admissible blocks of any size: all take a step together, and their rows and columns are rows of tables."""
    none = F.expr("cast(array() as array<double>)").alias("f")
    rows = stored(members(points, low, "a").select(*_BLOCK, "id", "x", none, F.lit(float("inf")).alias("near")), "cross-rows")
    cols = stored(members(points, low, "b").select(*_BLOCK, "id", "x", none), "cross-cols")
    done_u, done_v = [], []
    pivot = rows.groupBy(*_BLOCK).agg(F.min(F.struct("id", "x", "f")).alias("p")).select(*_BLOCK, F.col("p.id").alias("pid"), F.col("p.x").alias("px"), F.col("p.f").alias("pf"), F.lit(0.0).alias("norm2"), F.lit(0).alias("calm"))
    pivot = stored(pivot, "cross-pivot")
    for k in range(most + 1):
        if pivot.isEmpty():
            break
        if k == most:
            raise ArithmeticError(f"a block needs over {most} crosses")
        # the pivot row's residual over columns, and the column where it is largest
        r = _left(kernel(F.col("px"), F.col("x")), "f", "pf")
        res = stored(cols.join(pivot.select(*_BLOCK, "px", "pf"), _BLOCK).select(*_BLOCK, "id", "x", "f", r.alias("r")), "cross-res")
        best = res.groupBy(*_BLOCK).agg(F.max(F.struct(F.abs("r").alias("size"), "id", "x", "f", "r")).alias("q"))
        best = stored(best.select(*_BLOCK, F.col("q.x").alias("qx"), F.col("q.f").alias("qf"), F.col("q.r").alias("qr")), "cross-best")
        alive = F.abs("qr") > 1e-300
        v = F.when(alive, F.col("r") / F.col("qr")).otherwise(F.lit(0.0))
        new_cols = stored(res.join(best.select(*_BLOCK, "qr"), _BLOCK).select(*_BLOCK, "id", "x", F.concat("f", F.array(v)).alias("f")), "cross-cols")
        # that column's residual over rows
        c = F.when(alive, _left(kernel(F.col("x"), F.col("qx")), "f", "qf")).otherwise(F.lit(0.0))
        near = F.least("near", F.aggregate(F.zip_with("x", "px", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, y: t + y))
        new_rows = stored(rows.join(best.join(pivot.select(*_BLOCK, "px"), _BLOCK), _BLOCK).select(*_BLOCK, "id", "x", F.concat("f", F.array(c)).alias("f"), near.alias("near")), "cross-rows")
        last = F.element_at("f", -1)
        dots = F.array(*[F.sum(F.element_at("f", l + 1) * last) for l in range(k + 1)])
        unused = lambda by: F.max(F.when(F.col("near") > 0, F.struct(by.alias("by"), "id", "x", "f")))
        of_rows = new_rows.groupBy(*_BLOCK).agg(dots.alias("du"), unused(F.abs(last)).alias("largest"), unused(F.col("near")).alias("farthest"))
        both = of_rows.join(new_cols.groupBy(*_BLOCK).agg(dots.alias("dv")), _BLOCK).join(pivot.select(*_BLOCK, "norm2", "calm"), _BLOCK)
        cross = F.element_at("du", -1) * F.element_at("dv", -1)
        norm2 = F.col("norm2") + 2 * F.aggregate(F.slice(F.zip_with("du", "dv", lambda p, q: p * q), 1, k), F.lit(0.0), lambda s, x: s + x) + cross
        both = both.withColumn("cross", cross).withColumn("norm2", norm2)
        both = both.withColumn("calm", F.when(F.col("cross") <= eps * eps * F.col("norm2"), F.col("calm") + 1).otherwise(0)).withColumn("p", F.when(F.col("calm") > 0, F.struct("farthest.id", "farthest.x", "farthest.f")).otherwise(F.struct("largest.id", "largest.x", "largest.f")))
        after = stored(both.select(*_BLOCK, F.col("p.id").alias("pid"), F.col("p.x").alias("px"), F.col("p.f").alias("pf"), "norm2", "calm", (F.col("p.id").isNull() | (F.col("calm") >= CALM)).alias("done")), "cross-pivot")
        ended, dead = after.where("done").select(*_BLOCK), (rows, cols, res, best, pivot)
        u, v_ = (stored(t.join(ended, _BLOCK, "left_semi").select(*_BLOCK, "id", "f"), "cross-out") for t in (new_rows, new_cols))
        done_u.append(u)
        done_v.append(v_)
        rows, cols = (stored(t.join(ended, _BLOCK, "left_anti"), "cross-next") for t in (new_rows, new_cols))
        pivot = stored(after.where("not done").drop("done"), "cross-pivot")
        dropped(*dead, new_rows, new_cols, after)
    out = []
    for parts in (done_u, done_v):
        all_ = parts[0] if parts else rows.select(*_BLOCK, "id", "f")
        for p in parts[1:]:
            all_ = all_.union(p)
        out.append(all_)
    return out[0], out[1]


def product(points: DataFrame, pairs: DataFrame, factors: tuple[DataFrame, DataFrame], vector: DataFrame, kernel=inverse_square) -> DataFrame:
    """(id, y): the matrix times a vector (id, w); leaf blocks by pairs of points, the others by their factors."""
    u, v = factors
    scaled = v.join(vector, "id").select(*_BLOCK, F.posexplode("f").alias("l", "f"), "w")
    t = scaled.groupBy(*_BLOCK, "l").agg(F.sum(F.col("f") * F.col("w")).alias("t"))  # V^T x
    far = u.select(*_BLOCK, "id", F.posexplode("f").alias("l", "f")).join(t, [*_BLOCK, "l"]).select("id", (F.col("f") * F.col("t")).alias("y"))
    dense = pairs.where("not low")
    left = members(points, dense, "a")
    right = members(points, dense, "b").join(vector, "id").select(*_BLOCK, F.col("x").alias("z"), "w")
    near = left.join(right, _BLOCK).select("id", (kernel(F.col("x"), F.col("z")) * F.col("w")).alias("y"))
    return far.groupBy("id").agg(F.sum("y").alias("y")).union(near.groupBy("id").agg(F.sum("y").alias("y"))).groupBy("id").agg(F.sum("y").alias("y"))


def multiplied(points: DataFrame, pairs: DataFrame, vector: DataFrame, tested: Column, kernel=inverse_square, eps: float = 1e-4, most: int = 30) -> DataFrame:
    """(id, y, off, whole): the matrix times a vector (id, w), by crosses that are used where they are found.

    For tested points off and whole are sums of squares over the row's cells in admissible blocks: of how far the crosses'
    cells are from the kernel's, and of the kernel's; else 0. A point that the vector lacks counts as 0 there.
    """
    own = vector.groupBy("id").agg(F.sum("w").alias("w"))
    held = points.join(own, "id", "left").select("id", "x", "node", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce(tested, F.lit(False)).alias("tested"))
    rows, more = _grouped(held, pairs)
    out = rows.mapInArrow(crosses.products(kernel, eps, most), f"id {dict(points.dtypes)['id']}, y double, off double, whole double")
    if more is not None:
        u, v = factors = _spread(points, more.where("low"), kernel, eps, most)
        out = out.union(product(points, more, factors, vector, kernel).select("id", "y", F.lit(0.0), F.lit(0.0)))
        # points join their factors first, so that pairs are summed where they are made and none is shuffled
        mine = u.join(points.where(tested).select("id", "x"), "id")
        theirs = v.select(*_BLOCK, F.col("id").alias("j"), F.col("f").alias("g")).join(points.select(F.col("id").alias("j"), F.col("x").alias("z")), "j")
        cell, miss = kernel(F.col("x"), F.col("z")), _left(kernel(F.col("x"), F.col("z")), "f", "g")
        out = out.union(mine.join(theirs, _BLOCK).groupBy("id").agg(F.lit(0.0), F.sum(miss * miss), F.sum(cell * cell)))
    return out.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("y", "off", "whole")])


def plainly(points: DataFrame, vector: DataFrame, tested: Column, kernel=inverse_square) -> DataFrame:
    """(id, want, size): tested rows of the matrix times a vector (id, w) without its blocks, every pair; size sums amounts."""
    own = points.join(vector.groupBy("id").agg(F.sum("w").alias("w")), "id", "left").select("id", "x", F.coalesce("w", F.lit(0.0)).alias("w"))
    some = own.where(tested)

    def packs(rows: DataFrame, name: str) -> DataFrame:
        k = max(1, -(-rows.count() // PACK))
        rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(k)).alias("pack"), F.struct("id", "x", "w").alias("p")).repartition(k, "pack")
        return rows.groupBy("pack").agg(F.collect_list("p").alias(name)).select(name)

    both = packs(own, "right").crossJoin(F.broadcast(packs(some, "left")))  # the query set against all rows
    sums = both.mapInArrow(crosses.plain(kernel), f"id {dict(points.dtypes)['id']}, want double, size double")
    return sums.groupBy("id").agg(F.sum("want").alias("want"), F.sum("size").alias("size"))
