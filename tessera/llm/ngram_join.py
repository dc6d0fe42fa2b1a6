"""N-gram Jaccard self-join: size-banded tiles, hashed bitmaps that bound overlaps, exact sorted-array intersection.

Every text becomes its sorted set of 64-bit hashes of k-word shingles (two different sets share a 64-bit
signature with odds of about n*n / 2**65). Texts with equal sets are one class. Classes meet in tiles:

* A global order puts frequent shingles last (a fixed-size table of counts over all shingles marks them), then
  sorts by hash. Two sets that reach the threshold share one of the first ``n - ceil(t*n) + 1`` shingles of each, and
  of the first ``n - ceil(2*t*n / (1+t)) + 1`` of the smaller one.
* Sizes fall into bands so wide that sets of near enough sizes are in one band or in neighbouring ones. A tile is a
  band and a prefix shingle; it holds the sets of its own band and, as guests, those of the band below.
* Every class is first compared with the least and the greatest class of its own band in each tile. Tiles that
  then still hold several components compare all their classes of different components.
* Bitmaps hold the parity of the hashes at each bit, so the bits that differ between two sets are at most the
  elements that do: ``(n1 + n2 - hamming) / 2`` bounds the overlap from above, however large the sets. The bound is
  part of the join's condition, so no row is made for a pair that it rejects; sets over ``BITS`` x 2 have wider bitmaps too.
* What passes is checked by exact intersection of the sorted arrays: for each class its closest pair first, then
  those pairs that are still not connected. Components are made of the links by ``common.components``.

A shingle that is frequent (so marked) is dealt out with a salt while tiles of one class are sorted out; the pairs of
a tile are made in a sort-merge join whose large partitions Spark splits.

Nulls and texts without words have an empty set and no link. Rows with null ids take part (their text can connect
others) and get a null component unless a row with an id is reachable. Rows with equal ids are rows of their own, each
with the component of its text. Very long texts are whole. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, components, drop, marked, marks, mix, shingles, stored, text_bytes, words

SEGMENTS, SEGMENT = 64, 1 << 14  # the table of shingle counts: SEGMENTS * SEGMENT counters
BITS = 1024
SALTS = 64  # of a frequent shingle
HEAD = 8  # tiles of a set that tell where its pairs are made
_LONGS = [f"b{i}" for i in range(BITS // 64)]

def _sets(texts: pa.Array, k: int):
    """For blocks of rows: (i, j, sorted distinct hashes, offsets)."""
    data, offs = text_bytes(texts)
    for i, j in blocks(offs):
        wh, woff, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        h, off = shingles(wh, woff, k)
        doc = np.repeat(np.arange(j - i), np.diff(off))
        for d in range(j - i):
            h[off[d] : off[d + 1]].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
        yield i, j, h, np.searchsorted(doc, np.arange(j - i + 1))


def _signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    sig = n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    full = n > 0
    if full.any():
        rolled = (h << np.uint64(23)) | (h >> np.uint64(41))
        sig[full] ^= np.add.reduceat(h * (rolled | np.uint64(1)), off[:-1][full])
    return mix(sig).view(np.int64)


def _parity(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, BITS) bits: whether an odd number of a text's hashes fall on the bit."""
    bits = np.zeros(n * BITS, bool)
    at, times = np.unique(doc * BITS + ((h >> np.uint64(40)).astype(np.int64) & (BITS - 1)), return_counts=True)
    bits[at[times & 1 == 1]] = True
    return bits.reshape(n, BITS)


def _wide(h: np.ndarray) -> bytes | None:
    """A bitmap of parities with a bit or more for each hash; None for sets that BITS tell apart."""
    if len(h) <= 2 * BITS:
        return None
    width = 1 << int(len(h) - 1).bit_length()
    count = np.bincount((h >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width)
    return np.packbits(count & 1 == 1, bitorder="little").tobytes()


def _wide_bound(percent: int):
    """Of pairs (a, b, na, nb, wa, wb, ...), those whose wide bitmaps don't rule them out."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.ones(batch.num_rows, bool)
            for r in range(batch.num_rows):
                wa, wb = batch.column(4)[r], batch.column(5)[r]
                if wa.is_valid and wb.is_valid:
                    x, y = np.frombuffer(wa.as_buffer(), np.uint64), np.frombuffer(wb.as_buffer(), np.uint64)
                    x, y = (y, x) if len(x) > len(y) else (x, y)
                    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # folded to the shorter width
                    ham, total = int(np.bitwise_count(x ^ y).sum()), int(na[r] + nb[r])
                    keep[r] = (100 + percent) * ((total - ham) // 2) >= percent * total
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1, 6)], names=["a", "b", "close"])

    return run


def _band(n: str, percent: int):
    """The band of a size. Sets whose sizes allow the similarity are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / F.lit(max(1e-9, math.log(100 / percent) * (1 + 1e-9)))).cast("int")


def _describe(k: int, id_type: pa.DataType):
    """Rows of texts (kind 0: id, key, n, sig, bitmaps) and of counters (kind 1: segment, counts)."""
    names = ["kind", "id", "key", "n", "sig", *_LONGS, "wide", "segment", "counts"]

    def run(batches):
        table = np.zeros(SEGMENTS * SEGMENT, np.int64)
        for batch in batches:
            for i, j, h, off in _sets(batch.column(2), k):
                n = np.diff(off)
                at = (h & np.uint64(len(table) - 1)).astype(np.int64)
                if len(h) > 1 << 16:
                    table += np.bincount(at, minlength=len(table))
                else:
                    np.add.at(table, at, 1)
                longs = np.packbits(_parity(h, np.repeat(np.arange(j - i), n), j - i), axis=1, bitorder="little").view(np.int64)
                wide = [_wide(h[off[d] : off[d + 1]]) for d in range(j - i)]
                cols = [pa.array(np.zeros(j - i, np.int32)), batch.column(0).slice(i, j - i).cast(id_type), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(_signatures(h, off)), *[pa.array(np.ascontiguousarray(longs[:, c])) for c in range(len(_LONGS))], pa.array(wide, pa.binary()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        if table.any():
            parts = table.reshape(SEGMENTS, SEGMENT)
            nul = [pa.nulls(SEGMENTS, pa.int64())] * (3 + len(_LONGS))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SEGMENTS, np.int32)), pa.nulls(SEGMENTS, id_type), *nul, pa.nulls(SEGMENTS, pa.binary()), pa.array(np.arange(SEGMENTS, dtype=np.int32)), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=names)

    return run


def _sum_counts(key, pdf):
    import pandas as pd

    total = np.zeros(SEGMENT, np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, "<i8")
    return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "salt": [0], "counts": [total.tobytes()]})


def _frequent(described: DataFrame) -> np.ndarray:
    """A bit for each counter: well above the mean. Two summing steps, so no task gathers all partial tables."""
    schema = "segment int, salt int, counts binary"
    part = described.where("kind = 1").select("segment", F.expr("cast(rand(7) * 32 as int)").alias("salt"), "counts")
    part = part.groupBy("segment", "salt").applyInPandas(_sum_counts, schema).groupBy("segment").applyInPandas(_sum_counts, schema)
    table = np.zeros((SEGMENTS, SEGMENT), np.int64)
    for r in part.select("segment", "counts").collect():  # SEGMENTS rows, 8 MB in all
        table[r[0]] = np.frombuffer(r[1], "<i8")
    flat = table.reshape(-1)
    mean = flat.mean()
    return np.packbits(flat > 1.5 * mean + 6 * np.sqrt(mean) + 8)


def _prefixes(k: int, percent: int, frequent: np.ndarray):
    """Rows (h, salt, sig, n) of the prefix shingles of each set, once a task; n is negative beyond the first part.

    That part holds the first shingle that a set shares with any similar one of its size or above it.
    """

    def run(batches):
        late_bits = np.unpackbits(frequent).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            for i, j, h, off in _sets(batch.column(0), k):
                sig, ns, hs, salts, ss, sizes = _signatures(h, off), np.diff(off), [], [], [], []
                late = late_bits[(h & np.uint64(len(late_bits) - 1)).astype(np.int64)]
                for d in range(j - i):
                    n, s = int(ns[d]), int(sig[d])
                    if not n or s in seen:  # a copy has the same prefix
                        continue
                    if len(seen) > 1 << 18:
                        seen.clear()
                    seen.add(s)
                    own, hot = h[off[d] : off[d + 1]], late[off[d] : off[d + 1]]
                    most, part = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                    pre = own[~hot][:most]
                    salt, size = np.zeros(most, np.int32), np.full(most, n, np.int32)
                    salt[len(pre) :], size[part:] = 1 + s % SALTS, -n
                    hs += [pre, own[hot][: most - len(pre)]]
                    salts.append(salt), sizes.append(size), ss.append(np.full(most, s, np.int64))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *[pa.array(np.concatenate(x)) for x in (salts, ss, sizes)]], names=["h", "salt", "sig", "n"])

    return run


def _wanted_sets(k: int, sigs: np.ndarray, ids: np.ndarray):
    """(sig, hashes) of the rows whose signature and id hash both pass the filters."""

    def run(batches):
        for batch in batches:
            own = marked(ids, batch.column(0).to_numpy())
            for i, j, h, off in _sets(batch.column(1).filter(pa.array(own)), k):
                sig = _signatures(h, off)
                hit = np.flatnonzero(marked(sigs, sig) & (np.diff(off) > 0))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[hit]), pa.array([h[off[d] : off[d + 1]].tobytes() for d in hit], pa.binary())], names=["sig", "hashes"])

    return run


def _exact(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = np.frombuffer(a[r].as_buffer(), np.uint64), np.frombuffer(b[r].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[r] = 100 * both >= percent * (len(x) + len(y) - both)
            if keep.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _may_reach(percent: int, x: str, y: str):
    """Size and bitmap bounds of a pair: x.n, x.b0 ... and y.n, y.b0 ..."""
    return F.expr(f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and {100 + percent} * (({_most_common(x, y)})) >= {percent} * ({x}.n + {y}.n)")


def _most_common(x: str, y: str) -> str:
    """The overlap that the bitmaps allow at most."""
    ham = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _LONGS)
    return f"(({x}.n + {y}.n) - ({ham})) div 2"


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, row_key: Column | None = None) -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of df.

    component_id: the least id that links of ``100 * intersection >= percent * union`` reach, its own included.
    With `row_key`, a long of df's columns, also row_key and group_key: a number that a component's rows share, whatever
    their ids, null for empty sets.
    """
    id_sql = dict(df.dtypes)[id_col]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(id_sql)
    if id_type is None:
        raise ValueError(f"ids of type {id_sql}: cast them to bigint, int or string")
    text = F.col(text_col).cast("string")
    texts = df.select(F.col(id_col).alias("id"), (F.lit(0) if row_key is None else row_key).cast("long").alias("key"), text.alias("text"))
    longs = "".join(f", {c} bigint" for c in _LONGS)
    described = stored(texts.mapInArrow(_describe(k, id_type), f"kind int, id {id_sql}, key bigint, n bigint, sig bigint{longs}, wide binary, segment int, counts binary"), "ngram-described")
    docs = described.where("kind = 0")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    # Prefix shingles that several sets hold. Those of a frequent one are dealt out by salt and counted in two steps.
    # What follows reads one exchange: all its columns are used each time, and the filters below it are the same.
    dealt = texts.select("text").mapInArrow(_prefixes(k, percent, _frequent(described)), "h bigint, salt int, sig bigint, n int").where("h is not null and salt is not null").repartition(parts, "h", "salt")
    ends = dealt.groupBy("h", "salt").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.max("n").alias("early"), F.max("salt").alias("hot"))
    salted = ends.where("hot > 0").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("early").alias("early")).where("lo <> hi and early > 0").select("h", F.explode(F.sequence(F.lit(1), F.lit(SALTS))).alias("salt"))
    several = ends.where("hot = 0 and lo <> hi and early > 0").select("h", "salt").union(salted)
    tiles = stored(dealt.join(several.hint("shuffle_hash"), ["h", "salt"]).select("h", "sig", "n").distinct().select("h", "sig", F.abs("n").alias("n"), (F.col("n") > 0).alias("early")).withColumn("band", _band("n", percent)), "ngram-tiles")

    def bounds(sigs: DataFrame, *columns: str) -> DataFrame:
        """(sig, columns) of the classes in sigs."""
        return docs.join(sigs, "sig", "left_semi").groupBy("sig").agg(*[F.first(c).alias(c) for c in columns])

    def fetched(pairs: DataFrame, tag: str) -> DataFrame:
        """(sig, hashes) of the sets of the pairs (a, b). One row of each class brings its set."""
        wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        wanted = stored(docs.join(wanted, "sig").groupBy("sig").agg(F.min(F.xxhash64("id")).alias("idh")), tag + "-wanted")
        sets = texts.select(F.xxhash64("id").alias("idh"), "text").mapInArrow(_wanted_sets(k, marks(wanted.select("sig")), marks(wanted.select("idh"))), "sig bigint, hashes binary")
        return stored(sets, tag + "-sets")

    def verified(pairs: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
        """The pairs (a, b) that reach the threshold."""
        joined = pairs.select("a", "b").join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("ha")), "a").select("a", "b", "ha", "hb")
        return stored(joined.mapInArrow(_exact(percent), "a bigint, b bigint").distinct(), tag)

    def near(pairs: DataFrame) -> DataFrame:
        """(a, b, close) without the pairs that the wide bitmaps rule out; only those of two large sets have such."""
        wides = described.where("kind = 0 and wide is not null").groupBy("sig").agg(F.first("wide").alias("wide"))
        large = pairs.where(f"least(na, nb) > {2 * BITS}")
        for c in "ab":
            large = large.join(wides.withColumnRenamed("sig", c).withColumnRenamed("wide", "w" + c), c)
        large = large.select("a", "b", "na", "nb", "wa", "wb", "close").mapInArrow(_wide_bound(percent), "a bigint, b bigint, close double")
        return pairs.where(f"least(na, nb) <= {2 * BITS}").select("a", "b", "close").union(large)

    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    close = F.expr(f"({_most_common('x', 'y')}) / (x.n + y.n)").alias("close")
    pair = [F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), close]

    # Each class against the ends of its own band in its tiles.
    place = F.struct("sig", "n")
    ends = tiles.groupBy("h", "band").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.sig <> hi.sig")
    met = tiles.join(ends, ["h", "band"]).select("sig", "n", F.explode(F.array("lo", "hi")).alias("end")).where("sig <> end.sig").where(f"100 * least(n, end.n) >= {percent} * greatest(n, end.n)")
    met = stored(met.select(F.least("sig", "end.sig").alias("a"), F.greatest("sig", "end.sig").alias("b")).distinct(), "ngram-met")
    maps = bounds(met.select(F.col("a").alias("sig")).union(met.select("b")).distinct(), "n", *_LONGS)
    pairs = met.alias("p").join(maps.alias("x"), F.col("p.a") == F.col("x.sig")).join(maps.alias("y"), F.col("p.b") == F.col("y.sig")).where(_may_reach(percent, "x", "y")).select(*pair)
    pairs = stored(near(stored(pairs, "ngram-pairs")), "ngram-near")
    links = verified(pairs, fetched(pairs, "ngram-links"), "ngram-links")
    comp = stored(components(links, "a", "b", "ngram-cc"), "ngram-labels")

    # Tiles that still hold several components: all pairs across components, within the join's condition.
    own = tiles.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    own = own.select("h", "band", F.lit(False).alias("guest"), "sig", "n", "early", "comp").union(own.where("early").select("h", F.expr("band + 1"), F.lit(True), "sig", "n", "early", "comp"))
    own = stored(own, "ngram-own")
    drop(tiles, met)
    mixed = own.groupBy("h", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("guest").alias("guest"), F.max("early").alias("early")).where("lo <> hi and early and not guest").select("h", "band")
    own, before = stored(own.join(mixed, ["h", "band"]), "ngram-mixed"), own
    drop(before)
    heads = own.groupBy("sig").agg(*[F.slice(F.array_sort(F.collect_set(c)), 1, HEAD).alias(name) for c, name in (("h", "head"), (F.when(F.col("early"), F.col("h")), "early_head"))])  # at most a text's prefix
    members = stored(own.join(heads.join(bounds(own.select("sig").distinct(), *_LONGS), "sig"), "sig"), "ngram-members")
    # The smaller set of a pair is an early holder. A pair whose least tiles overlap is made in the least of these alone.
    smaller, larger = members.where("early").drop("head").alias("x").hint("merge"), members.where("not guest").drop("early_head").alias("y")
    first = "coalesce(array_min(array_intersect(x.early_head, y.head)) = x.h, true)"
    at = f"x.h = y.h and x.band = y.band and x.comp <> y.comp and {fits} and (x.n < y.n or x.n = y.n and x.sig < y.sig)"
    across = smaller.join(larger, F.expr(at) & _may_reach(percent, "x", "y") & F.expr(first)).select(*pair)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb", "close").dropDuplicates(["a", "b"])
    rest = stored(near(stored(across.join(pairs, ["a", "b"], "left_anti"), "ngram-across")), "ngram-rest")
    drop(own, members)
    if not rest.isEmpty():
        sets = fetched(rest, "ngram-rest")
        # One link joins a class to a whole component, so the closest pair of each class goes first.
        closest = rest.groupBy("a").agg(F.max_by("b", "close").alias("b")).union(rest.groupBy("b").agg(F.max_by("a", "close").alias("a")).select("a", "b")).distinct()
        stars = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        stars = stars.union(verified(closest, sets, "ngram-closest"))
        comp = stored(components(stars, "a", "b", "ngram-cc"), "ngram-labels")
        ca, cb = (comp.select(F.col("node").alias(c), F.col("comp").alias(f"now_{c}")) for c in "ab")
        rest = rest.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).select("a", "b")
        more = verified(rest, sets, "ngram-others")
        if not more.isEmpty():
            stars = comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more)
            comp = stored(components(stars, "a", "b", "ngram-cc"), "ngram-labels")

    of_row = docs.select("id", "key", "n", "sig").join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "sig")))
    least = stored(of_row.where("n > 0").groupBy("comp").agg(F.min("id").alias("component_id")), "ngram-least")  # a table, so that a hot component's join can be split
    out = of_row.join(least, "comp", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("key").alias("row_key"), F.col("comp").alias("group_key"))
    return out.drop("row_key", "group_key") if row_key is None else out
