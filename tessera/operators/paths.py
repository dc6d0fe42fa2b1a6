"""Longest paths in graphs whose edges go forward in program order: levels and transitive reduction in logarithmic rounds.

Instructions fall into segments of ``LEAF`` numbers, and two neighbouring segments of a level make one of the next, so an
edge belongs to the level where both ends share a segment for the first time. A node with an edge that leaves its
segment is a port. A segment is described by the longest paths between its ports, and from any node to each port; that
of two halves is joined over the edges between them, as a path crosses once at most. After as many rounds as the number
of segments has binary digits the whole graph is described; levels then come back down the same way.

The rows of a segment are the pairs of its ports, few where dependencies are local in program order, whatever the depth
of the graph; a round is two joins and a maximum.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.matrices import dropped, stored

LEAF = 64
_START = -1  # stands for any node of a segment, as a path's beginning


def _digits(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def _longest(sources, edges: list[tuple[int, int]]):
    """For each source, the longest path to each node that it reaches; edges in order of their first node."""
    for s in sources:
        far = {s: 0}
        for u, v in edges:
            if u in far:
                far[v] = max(far.get(v, 0), far[u] + 1)
        yield s, far


def _leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    """Longest paths between a segment's ports (top not null), and over each of its own edges."""
    ports = pdf.loc[pdf["top"].notna(), "u"].astype("int64").tolist()
    own = pdf[pdf["top"].isna()]
    edges = sorted(zip(own["u"].astype("int64").tolist(), own["v"].astype("int64").tolist(), strict=True))
    nodes = sorted({*ports, *(x for e in edges for x in e)})
    far = dict(_longest(nodes, edges))
    rows = [(False, e, x, far[e][x]) for e in ports for x in ports if x in far[e]]
    rows += [(False, _START, x, max(far[n][x] for n in nodes if x in far[n])) for x in ports]
    rows += [(True, u, v, far[u][v]) for u, v in edges]
    out = pd.DataFrame(rows, columns=["edge", "e", "x", "len"])
    out.insert(0, "seg", pdf["seg"].iloc[0])
    return out


class _Segments:
    """The rounds upwards. paths[m]: (seg, e, x, len) of level m; crossing: (u, v, longest) over the edges of all levels."""

    def __init__(self, edges: DataFrame):
        e = stored(edges.select(F.col("inst_from").cast("long").alias("u"), F.col("inst_to").cast("long").alias("v")).distinct(), "paths-edges")
        ends = e.agg(F.min("u"), F.max("v"), F.sum((F.col("u") >= F.col("v")).cast("int"))).first()
        if ends[2]:
            raise ValueError("an edge doesn't go forward")
        self.low, self.levels = ends[0] or 0, 0 if ends[0] is None else ((ends[1] - ends[0]) // LEAF).bit_length()
        self.edges = stored(e.withColumn("m", _digits(self.segment("u").bitwiseXOR(self.segment("v")))), "paths-edges")
        dropped(e)
        both = self.edges.where("m > 0").select(F.explode(F.array("u", "v")).alias("u"), "m")
        self.ports = stored(both.groupBy("u").agg(F.max("m").alias("top")), "paths-ports")
        none = lambda kind: F.lit(None).cast(kind)
        self.own = self.edges.where("m = 0").select(self.segment("u").alias("seg"), "u", "v", none("int").alias("top"))
        leaf = self.own.union(self.ports.select(self.segment("u").alias("seg"), "u", none("long"), "top"))
        done = stored(leaf.groupBy("seg").applyInPandas(_leaf, "seg bigint, edge boolean, e bigint, x bigint, len bigint"), "paths-leaf")
        self.crossing = [done.where("edge").select(F.col("e").alias("u"), F.col("x").alias("v"), F.col("len").alias("longest"))]
        self.paths, self.made = [done.where("not edge").drop("edge")], [self.edges, self.ports, done]

    def segment(self, node: str, level: int = 0) -> Column:
        return F.shiftright(F.expr(f"({node} - {self.low}L) div {LEAF}L"), level)

    def halves(self, m: int) -> tuple[DataFrame, DataFrame]:
        """Paths of the first and second halves of level m's segments, by segment."""
        seg, below = F.shiftright("seg", 1), self.paths[m - 1]
        return tuple(below.where(F.col("seg") % 2 == k).select(seg.alias("seg"), *names) for k, names in ((0, ("e", F.col("x").alias("u"), F.col("len").alias("before"))), (1, (F.col("e").alias("v"), "x", F.col("len").alias("after")))))

    def between(self, m: int) -> DataFrame:
        return self.edges.where(F.col("m") == m).select(self.segment("u", m).alias("seg"), "u", "v")

    def up(self) -> None:
        for m in range(1, self.levels + 1):
            first, second = self.halves(m)
            over = first.join(self.between(m), ["seg", "u"]).join(second, ["seg", "v"]).select("seg", "e", "x", (F.col("before") + 1 + F.col("after")).alias("len"))
            over = stored(over.groupBy("seg", "e", "x").agg(F.max("len").alias("len")), "paths-over")
            here = self.between(m)
            self.crossing.append(here.join(over.select("seg", F.col("e").alias("u"), F.col("x").alias("v"), "len"), ["seg", "u", "v"]).select("u", "v", F.col("len").alias("longest")))
            kept = self.ports.where(F.col("top") > m).select("u")
            all_ = self.paths[m - 1].select(F.shiftright("seg", 1).alias("seg"), "e", "x", "len").union(over)
            some = all_.join(kept.select(F.col("u").alias("x")), "x", "left_semi").join(kept.select(F.col("u").alias("e")).union(kept.sparkSession.range(1).select(F.lit(_START).cast("long").alias("e"))), "e", "left_semi")
            self.paths.append(stored(some.groupBy("seg", "e", "x").agg(F.max("len").alias("len")), "paths-up"))
            self.made += [over, self.paths[-1]]

    def down(self) -> DataFrame:
        """(seg, e, at): of level 0's ports, the longest path that comes in from other segments."""
        spark = self.edges.sparkSession
        come = spark.createDataFrame([], "seg long, e long, at long")
        for m in range(self.levels, 0, -1):
            inside = come.select(self.segment("e", m - 1).alias("seg"), "e", "at")
            begun = inside.union(spark.range(1).select(F.lit(None).cast("long"), F.lit(_START).cast("long"), F.lit(0).cast("long")))
            first = self.paths[m - 1].where("seg % 2 = 0").select(F.col("seg"), "e", F.col("x").alias("u"), "len").join(self.edges.where(F.col("m") == m).select("u", "v"), "u")
            reached = first.join(begun.select("e", "at"), "e").groupBy("v").agg(F.max(F.col("at") + F.col("len") + 1).alias("at")).select(self.segment("v", m - 1).alias("seg"), F.col("v").alias("e"), "at")
            come = stored(inside.union(reached).groupBy("seg", "e").agg(F.max("at").alias("at")), "paths-down")
            self.made.append(come)
        return come

    def drop(self) -> None:
        dropped(*self.made)


def _level(key, own: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
    level = {}
    for e, at in zip(come["e"].tolist(), come["at"].tolist(), strict=True):
        level[int(e)] = int(at)
    for u, v in sorted(zip(own["u"].astype("int64").tolist(), own["v"].astype("int64").tolist(), strict=True)):
        level[v] = max(level.get(v, 0), level.get(u, 0) + 1)
    return pd.DataFrame({"inst": list(level), "level": list(level.values())}, columns=["inst", "level"])


def levels(edges: DataFrame, insts: DataFrame) -> DataFrame:
    """(inst, level): the longest path of edges (inst_from, inst_to) that ends at each instruction; 0 where none does."""
    s = _Segments(edges)
    s.up()
    found = s.own.groupBy("seg").cogroup(s.down().groupBy("seg")).applyInPandas(_level, "inst bigint, level bigint")
    out = stored(insts.select("inst").join(found, "inst", "left").select("inst", F.coalesce("level", F.lit(0)).cast("int").alias("level")), "levels")
    s.drop()
    return out


def reduced(edges: DataFrame) -> DataFrame:
    """The edges that no longer path goes around, with all their columns: the transitive reduction."""
    s = _Segments(edges)
    s.up()
    around = s.crossing[0]
    for part in s.crossing[1:]:
        around = around.union(part)
    around = around.where("longest > 1").select(F.col("u").alias("inst_from"), F.col("v").alias("inst_to"))
    out = stored(edges.join(around, ["inst_from", "inst_to"], "left_anti"), "reduced")
    s.drop()
    return out
