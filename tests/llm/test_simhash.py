"""SimHash fingerprints and groups against brute force."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as S


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(words, ids, radius=4):
    comp = {w: w for w in words}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in comp:
        for b in comp:
            if (a ^ b).bit_count() <= radius:
                comp[find(a)] = find(b)
    least = {}
    for w, i in zip(words, ids, strict=True):
        if i is not None:
            least[find(w)] = min(i, least.get(find(w), i))
    return [least.get(find(w)) for w in words]


def test_near_copies(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aäbCdß中") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts = list(base)
    for t in base:
        for _ in range(3):
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append("\n ".join(w))
    texts += [None, "", " \t\n", "one", "One", "a b c", "a  b\nc", "x " * 30_000, base[0], base[0]]
    rows = [((k % 170 if k % 11 else None), t, "e", 1, 2) for k, t in enumerate(texts)]
    got = sorted(map(repr, map(tuple, S.near_copies(spark.createDataFrame(rows, "doc_id long, text string, fp string, n int, comp int").repartition(3)).collect())))
    words = [plain_fingerprint(t) for t in texts]
    want = sorted(repr((r[0], f"{w:016x}", c)) for r, w, c in zip(rows, words, plain_groups(words, [r[0] for r in rows]), strict=True))
    assert got == want
    assert S.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("tile", [5, 70, 1 << 13])
def test_links_of_words(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rng = random.Random(tile)
    words = {rng.getrandbits(64) for _ in range(120)} | {0, (1 << 64) - 1}
    for w in list(words):
        for _ in range(3):
            words.add(w ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 6))}))
    words = sorted(words)
    signed = np.array(words, np.uint64).view(np.int64).tolist()
    found = S.links(spark.createDataFrame([(w,) for w in signed], "fp long")).collect()
    comp = {w: w for w in signed}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for u, v in found:
        comp[find(u)] = find(v)
    plain = plain_groups(words, words)
    assert len(set(zip(map(find, signed), plain, strict=True))) == len(set(map(find, signed))) == len(set(plain))


def test_dense_group_gives_few_rows():
    words = np.array([sum(1 << b for b in c) for c in ((i, j) for i in range(64) for j in range(i))], np.uint64).view(np.int64)
    u, v = S.near(words, words, 4)
    assert len(u) < len(words)
    assert len(collections.Counter(v.tolist())) == 1


def test_vector_of_a_very_long_text():
    raw = " ".join(str(k % 977) for k in range(150_000)).encode()
    h = S.shingle_hashes(raw)
    bits = np.array([sum(int(x) >> b & 1 for x in h[::1].tolist()) for b in (0, 17, 63)])
    fp = int(S.fingerprints(h, np.array([len(h)]))[0])
    assert [fp >> b & 1 for b in (0, 17, 63)] == (2 * bits > len(h)).astype(int).tolist()
