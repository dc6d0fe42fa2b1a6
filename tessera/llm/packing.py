"""Packing tokenised documents into sequences: shortest pack first over the length histogram.

A document's ids (one end id added) are cut into pieces of ``most`` ids and a last one. The histogram of piece
lengths (at most ``most`` rows) goes to the driver, which places lengths longest first, each into the pack with
the most space left that holds it, and keeps counts of packing patterns, not packs. A piece finds its pack by its
rank among the pieces of its length. Ranks come from counts by (length, salt), with as many salts as the row count
asks for, so a length that a third of the pieces have is no single task.

Null and empty texts hold the end id alone; very long texts make many pieces; repeated rows are pieces each; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_bytes, blocks

MOST = 2048
END_ID = 1
_ENCODERS: dict = {}


def encoder(vocabulary: str, ranks: str | None):
    """A function from texts to lists of ids, as the `tokenizers` file `vocabulary` gives them.

    ranks: the same vocabulary for tiktoken, which gives the same ids several times as fast; texts that hold a
    special token's string go to `tokenizers`, which alone reads those.
    """
    if (vocabulary, ranks) not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocabulary)
        if ranks is None:
            _ENCODERS[vocabulary, ranks] = lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            special = [t.content for t in slow.get_added_tokens_decoder().values()]

            def encode(texts):
                out = []
                for x in texts:
                    if any(s in x for s in special):
                        out.append(slow.encode(x, add_special_tokens=False).ids)
                    else:
                        out.append(fast.encode_ordinary(x))
                return out

            _ENCODERS[vocabulary, ranks] = encode
    return _ENCODERS[vocabulary, ranks]


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pieces(files: tuple[str, str | None], most: int):
    def run(batches):
        encode = encoder(*files)
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            for i, j in blocks(offs):
                rows: list[list] = [[], [], [], [], []]
                texts = [bytes(data[offs[d] : offs[d + 1]]).decode("utf-8", "replace") for d in range(i, j)]
                for d, ids in zip(range(i, j), encode(texts), strict=True):
                    ids = np.append(np.asarray(ids, "<u4"), np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), most):
                        part = ids[start : start + most]
                        for to, v in zip(rows, (d, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(r, pa.int64()) for r in rows[1:]]], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def patterns(histogram: dict[int, int], most: int = MOST) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, times)]) of the packs: lengths longest first, each to the shortest pack that holds it."""
    heap: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (-space, age, count, items)
    done, age = [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                space, _, count, items = heapq.heappop(heap)
                space, placed = -space, min(count, left)
                if placed < count:
                    age += 1
                    heapq.heappush(heap, (-space, age, count - placed, items))
                same = items[:-1] + [(length, items[-1][1] + 1)] if items[-1][0] == length else [*items, (length, 1)]
                new = [(placed, same)]
                left, room = left - placed, space - length
            else:
                times = min(most // length, left)
                new, room = [(left // times, [(length, times)])], most - length * times
                left -= left // times * times
            for count, items in new:
                if room:
                    age += 1
                    heapq.heappush(heap, (-room, age, count, items))
                else:
                    done.append((count, items))
    return done + [(c, items) for _, _, c, items in sorted(heap)]


def _slots(packs) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: rank from which a slot holds, its first sequence, times in a sequence, offset there."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for count, items in packs:
        offset = 0
        for length, times in items:
            rows.setdefault(length, []).append((used.get(length, 0), base, times, offset))
            used[length] = used.get(length, 0) + count * times
            offset += length * times
        base += count
    return {k: tuple(np.array(v, np.int64).T) for k, v in rows.items()}


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, files: tuple[str, str | None] | None = None) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    id_sql = dict(df.dtypes)[id_col]
    tail = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = stored(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pieces(files or default_files(), most), f"id {id_sql}, {tail}"), "pack-pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `most` rows
    slots = _slots(patterns(histogram, most))
    salts = max(8, sum(histogram.values()) // 20_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(counts, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                lo, base, times, offset = slots[int(v)]
                s = np.searchsorted(lo, rank[at], "right") - 1
                k = rank[at] - lo[s]
                seq[at], off[at] = base[s] + k // times[s], offset[s] + k % times[s] * v
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, f"`{id_col}` {id_sql}, {tail}, sequence_id bigint, offset bigint")
