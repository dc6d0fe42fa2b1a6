"""SimHash near-duplicates: every text's 64-bit fingerprint, compared exactly in tiles.

A text's shingles are its 4-word sequences, repeats included (a text of fewer words is one shingle); their XXH64
values vote for each bit. Fingerprints that differ in at most ``radius`` bits are linked, and components of links are
the groups:

* Equal fingerprints are one class. Classes are sorted by the population counts of the whole word, its halves,
  quarters and bytes, over ranges of partitions, and cut into tiles of ``TILE`` words.
* Two words differ in at least as many bits as their population counts do, and so do the sums over halves, quarters or
  bytes. Tiles carry the least and greatest count of the word and its quarters; only tile pairs that these leave within
  the radius meet. Inside a pair the same holds for blocks of ``BLOCK`` words, by all four levels.
* What is left is compared word by word, by exclusive-or and bit counts. A tile pair's links become a forest before they
  leave the task, so a dense group gives as many rows as it has words.

Null and empty texts and texts without words have the fingerprint zero, which is linked as any other. Rows with null ids
take part (they can connect others) and get a null component unless a row with an id is reachable; repeated rows and
equal ids are rows of their own. Very long texts are whole. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, components, drop, join_hot, least_reachable, stored, text_bytes

WORDS, RADIUS, SEED = 4, 4, 42
TILE, BLOCK = 1 << 13, 64
_STEP = 1 << 16
#: Shifts and widths of the parts that are counted: the word, its halves, quarters and bytes.
_LEVELS = [[(64 - width * (k + 1), width) for k in range(64 // width)] for width in (64, 32, 16, 8)]


def shingle_hashes(raw: bytes, k: int = WORDS) -> np.ndarray:
    """XXH64 of a text's k-word shingles, in order."""
    words = raw.lower().split()  # of bytes: A-Z alone, and white space as \\x20\\x09-\\x0D
    if not words:
        return np.zeros(0, np.uint64)
    text, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    to = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    from_ = np.append(0, to[:-1] + 1)
    last = to[min(k, len(words)) - 1 :].tolist()
    return np.fromiter((hash_(text[i:j], SEED) for i, j in zip(from_.tolist(), last, strict=False)), np.uint64, len(last))


def fingerprints(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A word for each text: the bits that over half of its hashes have. count: hashes of each text."""
    doc, votes = np.repeat(np.arange(len(count)), count), np.zeros((len(count), 64), np.int64)
    for at in range(0, len(hashes), _STEP):
        d = doc[at : at + _STEP]
        bits = np.unpackbits(hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        votes[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _describe(k: int):
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            out = np.zeros(batch.num_rows, np.uint64)
            for i, j in blocks(offs):
                hashes = [shingle_hashes(data[offs[d] : offs[d + 1]].tobytes(), k) for d in range(i, j)]
                out[i:j] = fingerprints(np.concatenate(hashes), np.array(list(map(len, hashes))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    return run


def _part(shift: int, width: int):
    word = F.col("fp") if width == 64 else F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)
    return F.bit_count(word)


def _tiles(batches):
    """Of words in order: tiles with the least and greatest counts of the word and its quarters."""
    task, n = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def tile(fp):
        nonlocal n
        parts = _counts(fp)[:, [0, 3, 4, 5, 6]]
        n += 1
        cols = [np.array([v], np.int32) for v in (*parts.min(0), *parts.max(0))]
        return pa.RecordBatch.from_arrays([pa.array([task << 24 | n]), *map(pa.array, cols), pa.array([fp.tobytes()], pa.binary())], names=["tile", *_BOX, "words"])

    for batch in batches:
        held.append(batch.column(0).to_numpy())
        size += len(held[-1])
        if size >= TILE:
            fp = np.concatenate(held)
            for at in range(0, size - TILE + 1, TILE):
                yield tile(fp[at : at + TILE])
            held = [fp[size - size % TILE :]]
            size %= TILE
    if size:
        yield tile(np.concatenate(held))


_BOX = [f"{x}{k}" for x in ("lo", "hi") for k in range(5)]


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the word, its 2 halves, 4 quarters and 8 bytes."""
    word = fp.view(np.uint64)
    return np.stack([np.bitwise_count((word >> np.uint64(s)) & np.uint64((1 << w) - 1)) for level in _LEVELS for s, w in level], 1).astype(np.int16)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that words of two blocks differ in at least, for all blocks of a and b."""

    def boxes(x):
        first, parts = np.arange(0, len(x), BLOCK), _counts(x)
        return np.minimum.reduceat(parts, first), np.maximum.reduceat(parts, first)

    (al, ah), (bl, bh) = boxes(a), boxes(b)
    out, at = np.zeros((len(al), len(bl)), np.int16), 0
    for level in _LEVELS:
        gap = np.zeros_like(out)
        for k in range(at, at + len(level)):
            gap += np.maximum(0, np.maximum(al[:, None, k] - bh[None, :, k], bl[None, :, k] - ah[:, None, k]))
        np.maximum(out, gap, out=out)
        at += len(level)
    return out


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (u, v) of the links between words of two tiles."""
    links, size = [], 0

    def forest():
        nodes, low = least_reachable(*(np.concatenate(x) for x in zip(*links, strict=True)))
        far = nodes != low
        return nodes[far], low[far]

    for i, close in enumerate(_apart(a, b) <= radius):
        if not close.any():
            continue
        rows, cols = a[i * BLOCK : (i + 1) * BLOCK].view(np.uint64), b[np.repeat(close, BLOCK)[: len(b)]].view(np.uint64)
        r, c = np.nonzero(np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius)
        u, v = rows[r].view(np.int64), cols[c].view(np.int64)
        new = u != v
        links.append((u[new], v[new]))
        size += int(new.sum())
        if size > 1 << 20:
            links = [forest()]
            size = len(links[0][0])
    return forest() if size else (np.zeros(0, np.int64),) * 2


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                u, v = near(*(np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in (0, 1)), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(words: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect what lies within the radius, of distinct words (fp)."""
    order = [_part(s, w) for level in _LEVELS for s, w in level[: max(1, len(level) - 1)]]
    tiles = stored(words.select("fp").repartitionByRange(*order, "fp").sortWithinPartitions(*order, "fp").mapInArrow(_tiles, f"tile bigint, {', '.join(f'{c} int' for c in _BOX)}, words binary"), "simhash-tiles")
    boxes = tiles.drop("words")
    a = boxes.select("*", F.explode(F.sequence(F.col("lo0") - radius, F.col("hi0") + radius)).alias("p")).alias("a")
    b = boxes.select("*", F.explode(F.sequence("lo0", "hi0")).alias("p")).alias("b")
    gap = sum((F.greatest(F.lit(0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")) for k in range(2, 5)), F.greatest(F.lit(0), F.col("a.lo1") - F.col("b.hi1"), F.col("b.lo1") - F.col("a.hi1")))
    once = F.col("a.p") == F.greatest(F.col("a.lo0") - radius, F.col("b.lo0"))
    pairs = a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.tile") <= F.col("b.tile")) & once & (gap <= radius)).select(F.col("a.tile").alias("x"), F.col("b.tile").alias("y"))
    of = [tiles.select(F.col("tile").alias(k), F.col("words").alias(w)) for k, w in (("x", "wx"), ("y", "wy"))]
    out = stored(pairs.join(of[0], "x").join(of[1], "y").select("wx", "wy").mapInArrow(_compare(radius), "u bigint, v bigint"), "simhash-links")
    drop(tiles)
    return out


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = WORDS) -> DataFrame:
    """A row for each text: id, fingerprint (16 hexadecimal digits), component_id (the least id reachable by links)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = stored(rows.mapInArrow(_describe(k), f"id {dict(rows.dtypes)['id']}, fp bigint"), "simhash-docs")
    words = stored(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-words")
    found = links(words, radius)
    comp = components(found, "u", "v", "simhash-cc").withColumnsRenamed({"node": "fp"})
    labelled = stored(words.join(comp, "fp", "left").select("fp", "least", "n", F.coalesce("comp", "fp").alias("comp")), "simhash-label")
    least = labelled.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    whose = stored(join_hot(labelled.select("comp", "fp", "n"), stored(least, "simhash-least"), "comp", "size"), "simhash-whose")
    drop(found, words, labelled)
    out = join_hot(docs, whose.select("fp", "component_id", "n"), "fp", "n")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
