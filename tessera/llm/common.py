"""What several operators share: durable intermediate tables, text hashing on Arrow buffers, components.

Intermediate results that several jobs read are Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_LOCAL_DIR[0]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and return the table as read back."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables. Only for those whose every reader has been stored, so that no lost task needs them again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


HOT = 1000


def join_hot(rows: DataFrame, small: DataFrame, key: str, n: str) -> DataFrame:
    """rows with small's columns by key; small has one row for each key of rows and in n how often rows hold it.

    Keys with over 1 / HOT of all rows, HOT at most, are broadcast, so a frequent key isn't one task's; both are read twice.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = small.where(F.col(n) * HOT > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(small, key)
    return rows.join(F.broadcast(hot), key).union(rest)


def unused_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


# ---- text as bytes -------------------------------------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_BYTE[_SEP] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POWERS = [np.multiply.accumulate(np.full(4096, _MUL | np.uint64(1), np.uint64))]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.multiply.accumulate(np.full(2 * n, _MUL | np.uint64(1), np.uint64))
    return _POWERS[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, most: int = 1 << 19):
    """Row ranges (i, j) of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True):
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of each text; word range of each text; first byte of each word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    sep = _SEP[data]
    start = ~sep
    start[1:] &= sep[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    start[first] = ~sep[first]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), at
    value = (_BYTE_LOWER if lower else _BYTE)[data]
    reach = np.diff(np.append(at, len(data)))
    pos = np.arange(len(data), dtype=np.int64)
    pos[at[0] :] -= np.repeat(at, reach)
    pos[: at[0]] = 0
    pos[sep] = 0
    value *= powers(int(pos.max()) + 1)[pos]
    return mix(np.add.reduceat(value, at)), np.searchsorted(at, offs).astype(np.int64), at


def shingles(wh: np.ndarray, woff: np.ndarray, k: int, whole_if_short: bool = True):
    """Hashes of every text's k-word shingles, in order, and their offsets by text.

    A text of 1 to k-1 words has its whole sequence as one shingle, or none if not whole_if_short.
    """
    n, counts = len(wh), np.diff(woff)
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        full = full * np.uint64(0xD6E8FEB86659FD93) + wh[j : j + len(full)]
    full = mix(full)
    own = np.where(counts >= k, counts - k + 1, (counts > 0) * 1 if whole_if_short else 0)
    off = np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
    idx = np.repeat(woff[:-1] - off[:-1], own) + np.arange(off[-1])
    out = np.zeros(off[-1], np.uint64)
    ok = idx < len(full)
    out[ok] = full[idx[ok]]
    if whole_if_short:
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            h = int(counts[d])
            for w in wh[woff[d] : woff[d + 1]].tolist():
                h = (h * 0xA0761D6478BD642F + w) & 0xFFFFFFFFFFFFFFFF
            out[off[d]] = mix(np.array([h], np.uint64))[0]
    return out, off


# ---- filters -------------------------------------------------------------------------------------------------


def marks(hashes: DataFrame) -> np.ndarray:
    """A filter of a column of hashes, as bytes: 16 bits a value, 2 ** 26 at most.

    Beyond some millions of values it lets more through and saves less; it never holds a value back.
    """
    name = hashes.columns[0]
    bits = 1 << min(26, max(16, (16 * max(1, hashes.count()) - 1).bit_length()))
    bit = hashes.select(F.col(name).bitwiseAND(bits - 1).alias("bit"))
    words_ = bit.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("m")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[words_.column(0).to_numpy()] = words_.column(1).to_numpy()
    return out.view(np.uint8)


def marked(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(filter_) - 1)
    return (filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


# ---- connected components ------------------------------------------------------------------------------------

FEW = 1 << 20  # links (16 MB) that one task joins by itself


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node that links u - v reach from each)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return nodes, nodes[label]
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _stars(batches):
    """Links (u, v) to as few that connect the same nodes: each node of the task's links to the least it reaches."""

    def star(held):
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, low = least_reachable(u, v)
        far = nodes != low
        return nodes[far], low[far]

    def rows(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > FEW:
            held = [star(held)]
            size = len(held[0][0])
            if 2 * size > FEW:
                yield rows(*held[0])
                held, size = [], 0
    if size:
        yield rows(*star(held))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = near.join(low, "u")
    out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else out.select("v", "m").union(low.select("u", "m")).toDF("u", "v")
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str, tag: str = "cc", few: int = FEW) -> DataFrame:
    """(node, comp) of links between longs: comp is the least node that links reach. Nodes without a link are absent.

    Every task first reduces its links to stars. If at most `few` remain, one task joins them; otherwise large-star
    and small-star steps alternate until nothing changes, each round a written table, so no group is gathered.
    Both steps lower the least label that each node sees, so the rounds end; they are as many as the logarithm of the
    longest path, as a rule.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(u.alias("u"), v.alias("v"))
    now, seen = stored(now.mapInArrow(_stars, "u bigint, v bigint"), tag), None
    if now.count() <= few:
        now, before = stored(now.repartition(1).mapInArrow(_stars, "u bigint, v bigint"), tag), now
        drop(before)
    else:
        while True:
            now, before = stored(_star(_star(now, True), False), tag), now
            drop(before)
            print_ = tuple(now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first())
            if print_ == seen:
                break
            seen = print_
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
