"""Prefix trie of conversations against a plain dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie as T


def plain(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    sha = {p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest() for p in members}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha[p]) for p, m in members.items())


def made(seed, n, families=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = c if c % 7 else c * 1000
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", None, "a"]), rng.choice(["x", "xy", "", None, "é𝔘", "yes yes"])))
    return rows + rows[: len(rows) // 9] + [(None, 1, "user", "lost"), (100 * families, 0, "user", "x")]


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, path int").repartition(3)
    got = T.prefix_trie(T.rebuilt(df)).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got)


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_against_plain(spark, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = made(parts, 300)
        assert result(spark, rows) == plain(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_copies_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(T, "_CHUNK", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(4)] + [(c, 0, "user", "other") for c in range(200, 230)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert result(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_edges(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, 1, "a", "b")]) == []
    one = [(7, None, None, None)]
    assert result(spark, one) == plain(one)
    long = [(1, k, "user", str(k % 5)) for k in range(260)] + [(2, k, "user", str(k % 5)) for k in range(259)]
    got, want = result(spark, long), plain(long)
    assert got == want
    negative = [(c, k, "u", "t") for c in (-5, -105, -100, 0) for k in range(7)]
    signed = {c: c - (abs(c) % 100) * (1 if c > 0 else -1) for c in (-5, -105, -100, 0)}  # remainders have the sign of the id
    assert [signed[c] for c in (-5, -105)] == [0, -100]
    assert spark.range(1).select(F.lit(-105) % 100).first()[0] == -5
    assert sum(r[3] for r in result(spark, negative) if r[1] == 0) == 4


def test_very_long_turn(spark):
    rows = [(c, 0, "user", "é" * 300_000) for c in (4, 5)]
    assert result(spark, rows) == plain(rows)
