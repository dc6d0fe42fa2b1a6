"""Strided memory regions, dependencies between instructions, and the dependency table.

A region (ptr, pitch, width, height) is `height` runs of `width` bytes whose starts are `pitch` apart. Two regions
overlap if they share a byte; 1 <= width <= pitch holds. Dependency masks: 1 flow (read after write), 2 anti (write
after read), 4 output (write after write); a read-write operand counts as written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW, ANTI, OUT = 1, 2, 4
TASK_ROWS = 1 << 19  # of both sides in a task of an interval join, about


def valid_regions(regions: DataFrame) -> DataFrame:
    """regions, failing at run time on a region outside the definition."""
    ok = (F.col("width") >= 1) & (F.col("width") <= F.col("pitch")) & (F.col("height") >= 1)
    return regions.withColumn("width", F.when(ok, F.col("width")).otherwise(F.raise_error(F.lit("a region needs 1 <= width <= pitch and height >= 1")).cast("long")))


def spans(regions: DataFrame, *keep: str) -> DataFrame:
    """A row for each region with [start, end) from its first byte to its last; nothing is made for each run."""
    end = F.col("ptr") + (F.col("height") - 1) * F.col("pitch") + F.col("width")
    return valid_regions(regions).select(*keep, "ptr", "pitch", "width", "height", F.col("ptr").alias("start"), end.alias("end"))


def chosen_scales(histogram: dict[int, int], extent: float) -> list[int]:
    """Scales (powers of two) of bins for intervals counted by size class, over so many bytes.

    A scale serves the classes above the one before it, and holds every smaller interval as a guest; what it costs is
    the rows that it holds and the pairs that meet in its bins. The cheapest set is found by dynamic programming; there
    are 64 classes at most.
    """
    sizes = sorted(histogram)
    upto = np.cumsum([histogram[s] for s in sizes]).tolist()
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for k, size in enumerate(sizes):
        rows = 2.0 * upto[k]

        def cost(j, rows=rows, size=size, k=k):
            own = upto[k] - (upto[j - 1] if j else 0)
            return best[j][0] + rows + own * rows * min(1.0, 2.0**size / max(1.0, extent))

        j = min(range(k + 1), key=cost)
        best.append((cost(j), [*best[j][1], size]))
    return best[-1][1]


def interval_join(a: DataFrame, b: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs (x.*, y.*) of overlapping intervals [start, end), each once, by an equi-join on bins.

    Bins have a few widths, powers of two that are chosen by the histogram of lengths. An interval belongs to the least
    width that isn't below its length, where it lies in two bins at most, and is a guest of the wider ones. A pair meets
    in the wider one's bins, and is made in the bin where the later one starts. Tasks are as many as the rows in bins ask for.
    """
    size = F.ceil(F.log2(F.col("end") - F.col("start"))).cast("int")
    both = a.select("start", "end").union(b.select("start", "end"))
    held = both.groupBy(size.alias("size")).agg(F.count("*"), F.min("start"), F.max("end")).collect()  # 64 rows at most
    extent = max((r[3] for r in held), default=1) - min((r[2] for r in held), default=0)
    chosen = chosen_scales({r[0]: r[1] for r in held}, extent) if held else [0]
    scales = F.array(*map(F.lit, chosen))
    tasks = -(-sum(2 * r[1] * sum(c >= r[0] for c in chosen) for r in held) // TASK_ROWS)
    dealt = tasks > int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bins(d):
        own = F.filter(scales, lambda c: c >= size)
        d = d.withColumn("own", F.element_at(own, 1)).withColumn("scale", F.explode(own))
        d = d.withColumn("bin", F.explode(F.expr("sequence(shiftright(start, scale), shiftright(end - 1, scale))")))
        return d.repartition(tasks, "scale", "bin") if dealt else d

    x, y = bins(a).alias("x"), bins(b).alias("y")
    on = (F.col("x.scale") == F.col("y.scale")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
    on = on & F.expr("x.scale = greatest(x.own, y.own) and x.bin = shiftright(greatest(x.start, y.start), x.scale)")
    return x.join(y, on if condition is None else on & condition)


def floor_sum(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of floor((a * x + b) / m) over x = 0 .. n - 1, modulo 2 ** 64, for arrays; a, b >= 0, m > 0.

    Quotients go into the sum; then the rest counts points under a line, whose axes are swapped, as in Euclid's
    algorithm, so steps are as many as the logarithm of m.
    """
    n, m, a, b = (np.array(x, np.int64) for x in (n, m, a, b))
    total, live = np.zeros(len(n), np.int64), np.flatnonzero(n > 0)
    while len(live):
        n_, m_, a_, b_ = n[live], m[live], a[live], b[live]
        half = np.where(n_ % 2 == 0, n_ // 2 * (n_ - 1), n_ * ((n_ - 1) // 2))
        total[live] += half * (a_ // m_) + n_ * (b_ // m_)
        a_, b_ = a_ % m_, b_ % m_
        last = a_ * n_ + b_
        n[live], b[live], m[live], a[live] = last // m_, last % m_, a_, m_
        live = live[last >= m_]
    return total


def regions_meet(p1, pitch1, w1, h1, p2, pitch2, w2, h2) -> np.ndarray:
    """Whether regions share a byte, for arrays, in time that doesn't depend on heights.

    Run r of the second ends at hi = p2 - p1 + r * pitch2 + w2 - 1 as the first counts bytes. As long as hi lies within
    the first's rows, the two meet where hi modulo pitch1 is at most w1 + w2 - 2: rows that do so are counted by two floor
    sums. Beyond the first's last row, runs that still reach it are an interval of r.
    """
    p1, pitch1, w1, h1, p2, pitch2, w2, h2 = (np.asarray(x, np.int64) for x in (p1, pitch1, w1, h1, p2, pitch2, w2, h2))
    base, reach = p2 - p1 + w2 - 1, w1 + w2 - 2
    first = np.maximum(0, -(base // pitch2))
    first = np.where(base >= 0, 0, first)
    last = np.minimum(h2 - 1, (h1 * pitch1 - 1 - base) // pitch2)
    n = np.maximum(0, last - first + 1)
    at = np.where(n > 0, base + first * pitch2, 0)
    narrow = reach < pitch1 - 1
    k = np.where(narrow, n, 0)
    count = floor_sum(k, pitch1, pitch2, at) - floor_sum(k, pitch1, pitch2, np.where(narrow, at - reach - 1 + pitch1, 0)) + k
    past = np.maximum(0, -((base - h1 * pitch1) // pitch2))
    to = np.minimum(h2 - 1, ((h1 - 1) * pitch1 + reach - base) // pitch2)
    return (~narrow & (n > 0)) | (count > 0) | (past <= to)


_SIDES = [f"{s}.{c}" for s in "xy" for c in ("ptr", "pitch", "width", "height")]


def region_pairs(regions: DataFrame, *keep: str, condition: Column) -> DataFrame:
    """Pairs of regions that share a byte and meet the condition: candidates by their spans, then the exact test.

    Single runs share a byte if their spans do; the others are tested by `regions_meet`.
    """
    r = spans(regions, *keep)
    pairs = interval_join(r, r, condition).select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in keep], *[F.col(c).alias(c.replace(".", "_")) for c in _SIDES])
    out = [f"{s}_{c}" for s in "xy" for c in keep]
    kinds = dict(pairs.dtypes)

    def run(batches):
        for batch in batches:
            sides = [batch.column(len(out) + k).to_numpy() for k in range(8)]
            yield batch.select(out).filter(pa.array(regions_meet(*sides)))

    flat = (F.col("x_height") == 1) & (F.col("y_height") == 1)
    return pairs.where(flat).select(*out).union(pairs.where(~flat).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in out)))


def overlapping(regions: DataFrame, key: str) -> DataFrame:
    """(a, b), a < b: keys of the regions that share a byte; a key may have several regions."""
    pairs = region_pairs(regions, key, condition=F.col(f"x.{key}") < F.col(f"y.{key}"))
    return pairs.select(F.col(f"x_{key}").alias("a"), F.col(f"y_{key}").alias("b")).distinct()


def classify(operands: DataFrame) -> DataFrame:
    """(inst_from, inst_to, dep) of instructions in program order, from operands (inst, is_read, region)."""
    either_writes = ~(F.col("x.is_read") & F.col("y.is_read"))
    pairs = region_pairs(operands, "inst", "is_read", condition=(F.col("x.inst") < F.col("y.inst")) & either_writes)
    kind = F.when(F.col("x_is_read"), ANTI).when(F.col("y_is_read"), FLOW).otherwise(OUT)
    return pairs.groupBy(F.col("x_inst").alias("inst_from"), F.col("y_inst").alias("inst_to")).agg(F.bit_or(kind).cast("int").alias("dep"))


def mirrored(table: DataFrame) -> DataFrame:
    """The same dependencies asked from the other side."""
    return table.select(F.col("inst_to").alias("inst_from"), F.col("inst_from").alias("inst_to"), "dep")


def update(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table with changes (inst_from, inst_to, dep, seq) applied: the last of a pair wins, dep 0 deletes."""
    last = changes.groupBy("inst_from", "inst_to").agg(F.max_by("dep", "seq").alias("new"))
    both = table.join(last, ["inst_from", "inst_to"], "full").select("inst_from", "inst_to", F.coalesce("new", "dep").cast("int").alias("dep"))
    return both.where("dep <> 0")


def replayed(changes: DataFrame) -> DataFrame:
    """(inst_from, inst_to, dep, seq) that changes leave: the last one of a pair decides, seq is when it was put in.

    A pair that is there already keeps its place; one that was deleted and put in again gets a new one.
    """
    pair = ["inst_from", "inst_to"]
    gone = changes.groupBy(*pair).agg(F.max(F.when(F.col("dep") == 0, F.col("seq"))).alias("gone"), F.max_by("dep", "seq").cast("int").alias("last")).where("last <> 0")
    since = changes.join(gone, pair).where("gone is null or seq > gone")
    return since.groupBy(*pair, F.col("last").alias("dep")).agg(F.min("seq").alias("seq"))


def dump(table: DataFrame) -> DataFrame:
    """(inst_from, inst_to, dep), sorted."""
    return table.select("inst_from", "inst_to", "dep").orderBy("inst_from", "inst_to")


def lookup(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with their dep, 0 for none."""
    return pairs.join(table, ["inst_from", "inst_to"], "left").withColumn("dep", F.coalesce("dep", F.lit(0)))


def _others(table: DataFrame, inst: str, other: str) -> DataFrame:
    order = F.col("seq") if "seq" in table.columns else F.col(other)
    held = F.array_sort(F.collect_list(F.struct(order.alias("order"), F.col(other).alias("other"))))
    return table.groupBy(F.col(inst).alias("inst")).agg(F.transform(held, lambda x: x["other"]).alias("others"))


def successors(table: DataFrame) -> DataFrame:
    """(inst, others): what depends on each instruction, in the order of insertion if table has seq, or else ascending."""
    return _others(table, "inst_from", "inst_to")


def predecessors(table: DataFrame) -> DataFrame:
    """(inst, others): what each instruction depends on, in the same order."""
    return _others(table, "inst_to", "inst_from")


def degrees(table: DataFrame, insts: DataFrame) -> DataFrame:
    """(inst, deps_from, deps_to): out-degree and in-degree, 0 included. One pass over the table."""
    ends = table.select(F.explode(F.array(F.struct(F.col("inst_from").alias("inst"), F.lit(1).alias("o"), F.lit(0).alias("n")), F.struct(F.col("inst_to").alias("inst"), F.lit(0).alias("o"), F.lit(1).alias("n")))).alias("e")).select("e.*")
    return insts.select("inst", F.lit(0).alias("o"), F.lit(0).alias("n")).unionByName(ends).groupBy("inst").agg(F.sum("o").alias("deps_from"), F.sum("n").alias("deps_to"))


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)


def combined(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def stronger(a: Column, b: Column) -> Column:
    return a > b
