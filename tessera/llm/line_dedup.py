"""Fuzzy line deduplication: MinHash over character shingles, bands, exact Jaccard, distributed union-find.

Lines are what lies between line feeds. A line of at least ``least`` characters is described by one-permutation
MinHash of its shingles of ``width`` characters (``BANDS * ROWS`` bins, empty ones filled by rotation). All different
lines that agree in a band are compared by exact Jaccard similarity of their shingle sets; ``percent`` % or more is a
link, and links make components. Each component keeps its first line by (id, line number). 12 bands of 5 rows meet a
pair of similarity 0.8 with odds of 0.99.

A bucket's lines are compared where they lie, by a product of their matrix of shared shingles, so no pair becomes a
row: a task writes of each bucket only the links that join its components. Buckets of the same lines in several bands
are compared once. A bucket of over ``BLOCK`` lines is dealt out in blocks; blocks are compared within first, then,
if the bucket still holds several components, each with each other, lines of different components only.

Shorter lines stay as they are, exact repeats of them as well. A null text stays null; an empty text is one empty
line. Rows with equal id and text are one document (they keep the same lines); rows with null ids come first. Very
long texts and lines are whole; an empty table gives no rows. All of df's columns stay; where it has n_lines or
n_removed, the new columns get a ``_`` after their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.common import blocks, components, drop, least_reachable, marked, marks, mix, stored, text_bytes, unused_name

BANDS, ROWS = 12, 5
WIDTH, LEAST, PERCENT = 8, 20, 80
BLOCK = 512  # lines of a bucket that are compared in one go
CELLS = 1 << 21  # of a matrix of lines and shingles
BYTES = 1 << 19  # of lines whose sets are made together
_EMPTY = np.uint32(0xFFFFFFFF)


def _lines(data: np.ndarray, offs: np.ndarray):
    """(first byte of each line, end of each line, text of each line, characters)."""
    feed = np.flatnonzero(data == 10)
    first = np.concatenate([offs[:-1], feed + 1])
    doc = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs[1:], feed, "right")])
    order = np.lexsort((first, doc))
    first, doc = first[order], doc[order]
    last = np.append(first[1:] - 1, 0)
    final = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    last[final] = offs[1:][doc[final]]
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return first, last, doc, lead[last] - lead[first]


def _line_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxh64_intdigest(view[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))


def _points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def _shingles(points: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` points, by doubling."""
    n = max(len(points) - width + 1, 0)
    out, done, run, size, by = np.zeros(n, np.uint64), 0, points.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while n:
        if width & size:
            out = out * np.uint64(by) + run[done : done + n]
            done += size
        if done == width:
            break
        run = run[:-size] * np.uint64(by) + run[size:]
        size, by = 2 * size, by * by & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def _bands(points: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """BANDS hashes for each line; every line has at least `width` characters."""
    bins, n = BANDS * ROWS, len(first)
    count = last - first - width + 1
    line = np.repeat(np.arange(n), count)
    at = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    h = _shingles(points, width)[at]
    sig = np.full(n * bins, _EMPTY, np.uint32)
    np.minimum.at(sig, line * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), (h & np.uint64(0x7FFFFFFF)).astype(np.uint32))
    sig = sig.reshape(n, bins)
    # An empty bin takes the next one's value, going round, and how far that is.
    ahead = np.where(np.tile(sig != _EMPTY, 2), np.arange(2 * bins, dtype=np.int16), np.int16(2 * bins))
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :bins] - np.arange(bins, dtype=np.int16)
    far = np.take_along_axis(sig, ((ahead + np.arange(bins)) % bins).astype(np.int64), axis=1) + ahead.astype(np.uint32) * np.uint32(0x9E3779B1)
    filled = np.where(ahead == 0, sig, far & np.uint32(0x7FFFFFFF))
    parts = filled.reshape(n, BANDS, ROWS).astype(np.uint64)
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (n, 1))
    for r in range(ROWS):
        out = mix(out * np.uint64(0x100000001B3) + parts[:, :, r])
    return out.view(np.int64)


class _Seen:
    """Which values a task has met before; bounded, so some may be met again as new."""

    def __init__(self, most: int = 1 << 19):
        self.values, self.most = set(), most

    def new(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), bool)
        for i, v in enumerate(values.tolist()):
            if v not in self.values:
                self.values.add(v)
                out[i] = True
        if len(self.values) > self.most:
            self.values.clear()
        return out


def _describe(width: int, least: int):
    def run(batches):
        seen = _Seen()
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            for i, j in blocks(offs):
                own = data[offs[i] : offs[j]]
                first, last, doc, size = _lines(own, offs[i : j + 1] - offs[i])
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                long = np.flatnonzero(size >= least)
                first, last, doc, number, size = first[long], last[long], doc[long], number[long], size[long]
                lh = _line_hashes(own, first, last).view(np.int64)
                new = np.flatnonzero(seen.new(lh))
                bands, at = np.zeros((0, BANDS), np.int64), np.zeros(len(lh) + 1, np.int32)
                if len(new):
                    end = np.cumsum(size[new])
                    bands = _bands(_points(np.concatenate([own[a:b] for a, b in zip(first[new], last[new], strict=True)])), end - size[new], end, width)
                    at[new + 1] = BANDS
                where = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(number.astype(np.int32)), pa.array(lh), pa.ListArray.from_arrays(pa.array(np.cumsum(at).astype(np.int32)), pa.array(bands.ravel()))], names=["key", "id", "line", "lh", "bands"])

    return run


def _wanted_lines(wanted: np.ndarray, least: int):
    def run(batches):
        seen = _Seen()
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            for i, j in blocks(offs):
                own = data[offs[i] : offs[j]]
                first, last, _, size = _lines(own, offs[i : j + 1] - offs[i])
                long = np.flatnonzero(size >= least)
                first, last = first[long], last[long]
                lh = _line_hashes(own, first, last)
                hit = np.flatnonzero(marked(wanted, lh))
                hit = hit[seen.new(lh[hit])]
                if len(hit):
                    body = pa.array([own[a:b].tobytes() for a, b in zip(first[hit], last[hit], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(lh[hit].view(np.int64)), body.cast(pa.string())], names=["lh", "body"])

    return run


def _sets(bodies: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line's different shingle hashes, sorted, and their offsets by line."""
    data, offs = text_bytes(bodies)
    points = _points(data)
    cut = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    count = np.diff(cut) - width + 1
    line = np.repeat(np.arange(len(count)), count)
    h = _shingles(points, width)[np.arange(len(line)) - np.repeat(np.cumsum(count) - count - cut[:-1], count)]
    end = np.cumsum(count)
    for a, b in zip((end - count).tolist(), end.tolist(), strict=True):
        h[a:b].sort()
    new = np.append(True, (h[1:] != h[:-1]) | (line[1:] != line[:-1]))[: len(h)]
    return h[new], np.searchsorted(line[new], np.arange(len(count) + 1))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections: products of the matrix of sets and shared shingles, some columns at a time."""
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    who, at = who[shared], column[at[shared]]
    order = np.argsort(at, kind="stable")
    who, at, out, columns = who[order], at[order], np.zeros((len(sets), len(sets))), int((times > 1).sum())
    step = max(1, CELLS // len(sets))
    for c in range(0, columns, step):
        a, b = np.searchsorted(at, [c, c + step])
        cells = np.zeros((len(sets), min(step, columns - c)), np.float32)
        cells[who[a:b], at[a:b] - c] = 1
        out += cells @ cells.T
    return out


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs (row < column) of sets reach the similarity."""
    both, n = _overlaps(sets), np.array([len(x) for x in sets])
    return np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1)


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _compare(width: int, percent: int):
    """Rows (band, block, other, lh, comp, side, body), sorted by the first three, to links (a, b).

    Those of one group are compared if their comps differ (each line has its own in the first round), in a pair of
    blocks only across the two sides.
    """

    def links(rows: pa.RecordBatch):
        lh, comp, side = (rows.column(c).to_numpy() for c in (3, 4, 5))
        key = np.stack([rows.column(c).to_numpy() for c in (0, 1, 2)])
        start = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))), len(lh))
        at = text_bytes(rows.column(6))[1][start]
        a, b, until = [], [], 0
        for g, (s, e) in enumerate(zip(start[:-1], start[1:], strict=True)):
            if e > until:  # the sets of as many groups as have BYTES, or of one
                base, until = s, start[max(g + 1, int(np.searchsorted(at, at[g] + BYTES, "right")) - 1)]
                h, off = _sets(rows.column(6).slice(base, until - base), width)
                off = np.append(np.zeros(base, np.int64), off)  # by row
            if e - s == 2:
                if comp[s] != comp[s + 1] and (key[1, s] == key[2, s] or side[s] != side[s + 1]) and _alike(h[off[s] : off[s + 1]], h[off[s + 1] : off[e]], percent):
                    a.append(lh[s : s + 1]), b.append(lh[s + 1 : e])
                continue
            if e - s == 1 or (comp[s:e] == comp[s]).all():
                continue
            near = _similar([h[off[r] : off[r + 1]] for r in range(s, e)], percent) & (comp[s:e, None] != comp[None, s:e])
            if key[1, s] != key[2, s]:
                near &= side[s:e, None] != side[None, s:e]
            x, y = np.nonzero(near)
            if len(x):
                nodes, low = least_reachable(lh[s + x], lh[s + y])
                a.append(nodes[nodes != low]), b.append(low[nodes != low])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (a, b)], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
            last = np.array([[held[0].column(c)[-1].as_py()] for c in (0, 1, 2)])
            cut = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end or (len(held) > 1 and (key[:, :1] != last).any()):
                done = pa.Table.from_batches([*held[:-1], batch.slice(0, end)]).combine_chunks().to_batches(max_chunksize=1 << 30)
                for part in done:
                    yield links(part)
                held = [batch.slice(end)]
        if held:
            for part in pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30):
                yield links(part)

    return run


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """df with repeated lines dropped from its texts, then n_lines and n_removed."""
    if least < width:
        raise ValueError("least must be at least width")
    spark, key = df.sparkSession, unused_name(df, "_row")
    rows = df.withColumn(key, F.xxhash64(id_col, text_col))
    id_sql = dict(df.dtypes)[id_col]
    texts = rows.select(key, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = stored(texts.where("text is not null").mapInArrow(_describe(width, least), f"key bigint, id {id_sql}, line int, lh bigint, bands array<bigint>"), "lines")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    banded = lines.select("lh", F.explode("bands").alias("band")).repartition(parts, "band")
    ends = banded.groupBy("band").agg(F.min("lh").alias("lo"), F.max("lh").alias("hi")).where("lo <> hi").select("band")
    shared = stored(banded.join(ends.hint("shuffle_hash"), "band").select("lh", "band").distinct(), "line-shared")

    bodies = texts.where("text is not null").select("text").mapInArrow(_wanted_lines(marks(shared.select("lh").distinct()), least), "lh bigint, body string").groupBy("lh").agg(F.first("body").alias("body"))
    bodies = stored(bodies, "line-bodies")
    buckets = shared.groupBy("band").agg(F.count("*").alias("size"), *[F.expr(f"bit_xor(xxhash64(lh, {n}))").alias(f"x{n}") for n in (1, 2)])
    buckets = stored(buckets.groupBy("size", "x1", "x2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "line-buckets")
    members = shared.join(buckets, "band").withColumn("block", F.pmod(F.xxhash64("lh"), "blocks").cast("int"))

    def compared(groups: DataFrame, tag: str) -> DataFrame:
        """Links of groups (band, block, other, lh, comp, side)."""
        at = ["band", "block", "other"]
        dealt = groups.join(bodies, "lh").select(*at, "lh", "comp", "side", "body").repartition(parts, *at).sortWithinPartitions(*at)
        return stored(dealt.mapInArrow(_compare(width, percent), "a bigint, b bigint"), tag)

    links = compared(members.select("band", "block", F.col("block").alias("other"), "lh", F.col("lh").alias("comp"), F.lit(0).alias("side")), "line-links")
    comp = stored(components(links, "a", "b", "line-cc"), "line-comps")

    large = members.where("blocks > 1").join(comp.withColumnRenamed("node", "lh"), "lh", "left").withColumn("comp", F.coalesce("comp", "lh"))
    mixed = large.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    large = stored(large.join(mixed, "band"), "line-large")
    if not large.isEmpty():
        pairs = large.withColumn("to", F.explode(F.expr("sequence(0, blocks - 1)"))).where("to <> block")
        pairs = pairs.select("band", F.least("block", "to").alias("block"), F.greatest("block", "to").alias("other"), "lh", "comp", (F.col("block") > F.col("to")).cast("int").alias("side"))
        more = compared(pairs, "line-more")
        stars = comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more)
        comp = stored(components(stars, "a", "b", "line-cc"), "line-comps")
    drop(bodies)

    of_line = lines.groupBy("lh").agg(F.count("*").alias("n")).join(comp.withColumnRenamed("node", "lh"), "lh", "left").withColumn("comp", F.coalesce("comp", "lh"))
    several = of_line.groupBy("comp").agg(F.sum("n").alias("n")).where("n > 1").select("comp")
    repeated = stored(of_line.select("lh", "comp").join(several, "comp"), "line-repeated")
    held = stored(lines.select("key", "id", "line", "lh").join(repeated, "lh").select("key", "id", "line", "comp"), "line-held")
    drop(lines, shared, buckets, links, large, repeated)
    place = F.struct(F.col("id").isNotNull().alias("g"), "id", "key", "line")
    kept = stored(held.groupBy("comp").agg(F.min(place).alias("keep")), "line-kept")  # a table, so that a hot component's join can be split
    drops = held.join(kept, "comp").where(~((F.col("key") == F.col("keep.key")) & (F.col("line") == F.col("keep.line"))))
    gone = unused_name(df, "_drops")
    drops = drops.groupBy("key").agg(F.collect_set("line").alias(gone)).withColumnRenamed("key", key)  # at most the lines of a text

    n_lines, n_removed = unused_name(df, "n_lines"), unused_name(df, "n_removed")

    def rest(line):  # of an array that a lambda's variable holds, so that a text is split once
        kept = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.get(line, i)), "\n")

    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.get(F.transform(F.array(F.split(text_col, "\n", -1)), rest), F.lit(0)))
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"))) + 1)
    out = rows.join(drops, key, "left")
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns], size.cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed))
