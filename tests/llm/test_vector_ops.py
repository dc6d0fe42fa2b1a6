"""Vector searches against brute force, and the pipeline's contract."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, list int, v string"


def vectors(spark, x, first=0, extra=()):
    rows = [(first + i, [float(c) for c in r], 1, "x") for i, r in enumerate(x)] + [(i, v, 1, "x") for i, v in extra]
    return spark.createDataFrame(rows, SCHEMA)


BAD = [(9001, None), (9002, [1.0, None, 2.0, 3.0]), (9003, [float("nan")] * 4), (9004, [float("inf")] * 4), (9005, []), (None, [1.0, 2.0, 3.0, 4.0])]


def test_exact_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((300, 4)), 1).astype(np.float32)
    x[100:200] = x[7]  # a vector that a third of the rows hold
    got = topk.exact_top_k(vectors(spark, x, extra=[*BAD, (9000, [0.0] * 4), (9006, [1.0, 2.0])]), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    ids = np.append(np.arange(300), 9000)
    ints = np.floor(256 * np.vstack([x, np.zeros((1, 4))]).astype(np.float64)).astype(np.int64)
    for q in [*range(0, 300, 50), 9000]:
        s = ints @ ints[np.flatnonzero(ids == q)[0]]
        want = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [o[1:] for o in own] == want and [o[0] for o in own] == [1, 2, 3, 4, 5]
    assert topk.exact_top_k(vectors(spark, []), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).count() == 0
    monkeypatch.setattr(topk, "BLOCK", 2)  # several blocks, and several passes
    monkeypatch.setattr(topk, "BLOCKS", 2)
    again = topk.exact_top_k(vectors(spark, x, extra=[(0, [9.0] * 4), (0, [9.0] * 4)]), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    assert len({r["query_id"] for r in again}) == 6
    assert sorted(tuple(r) for r in again if r["query_id"] == 150 and r["vec_id"] != 0) == sorted(tuple(r) for r in got if r["query_id"] == 150 and r["vec_id"] != 0)[:5] or any(r["vec_id"] == 0 for r in again if r["query_id"] == 150)
    monkeypatch.undo()
    few = topk.exact_top_k(vectors(spark, x[:3]), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    assert len(few) == 2


def test_exact_top_k_of_large_components(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((60, 4)), 1)
    x[[0, 7, 21]] = [[2.0**40, 3.0, 0.0, 0.0], [-(2.0**41), 3.0, 1.0, 0.0], [0.0, 2.0**43, 1.0, -4.0]]
    df = spark.createDataFrame([(i, r.tolist(), 1, "x") for i, r in enumerate(x)], "vec_id long, embedding array<double>, list int, v string")
    got = topk.exact_top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    ints = [[int(np.floor(256 * c)) for c in r] for r in x]
    for q in (0, 50):
        s = [sum(a * b for a, b in zip(r, ints[q], strict=True)) for r in ints]
        want = sorted(((-v, j) for j, v in enumerate(s) if j != q))[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, j, -v) for k, (v, j) in enumerate(want)]
    for bad in ([[3e38] * 4], [[2.0**50, 0, 0, 0], [2.0**50, 1, 0, 0]]):  # a component, a score beyond 62 bits
        rows = [(50 * i, [float(c) for c in v], 1, "x") for i, v in enumerate(bad)]
        with pytest.raises(Exception, match="62 bits"):
            topk.exact_top_k(spark.createDataFrame(rows, df.schema), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()


def test_nearest_of_large_components(spark):
    x = np.random.default_rng(9).standard_normal((120, 4)) * 1e200
    x[30:60] *= 1e-190
    df = spark.createDataFrame([(i, r.tolist(), 1, "x") for i, r in enumerate(x)], "vec_id long, embedding array<double>, list int, v string")
    got = ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5).collect()
    for q in (0, 40, 100):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        if q == 40:  # against the large ones scores fit
            s = x @ x[q]
            assert [o[1] for o in own] == [int(j) for j in np.lexsort((np.arange(120), -s)) if j != q][:5]
            assert all(o[2] == (x[o[1]] * x[q]).sum() for o in own)
        else:
            assert len(own) == 5 and all(o[2] == np.inf for o in own) and [o[1] for o in own] == sorted(o[1] for o in own)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[500:1000] = x[3]
    got = ann.nearest(vectors(spark, x, extra=[(i, None if v is None else v * 4 if v else v) for i, v in BAD] + [(9000, [0.0] * 16)]), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).collect()
    full, recall = x.astype(np.float64), []
    for q in range(0, 1500, 20):
        s = (full * full[q]).sum(1)
        want = [int(j) for j in np.lexsort((np.arange(1500), -s)) if j != q][:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert len(own) == 20 and all(o[2] == s[o[1]] for o in own)
        assert [o[1] for o in own] == sorted((o[1] for o in own), key=lambda j: (-s[j], j))
        recall.append(len({o[1] for o in own} & set(want)) / 20)
    assert np.mean(recall) >= 0.9
    assert not {r["query_id"] for r in got} & {9000, 9001, 9002}
    assert ann.nearest(vectors(spark, []), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0
    assert ann.nearest(vectors(spark, x[:3]), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 2


def test_nearest_of_many_lists(spark):
    rng = np.random.default_rng(6)
    n = 14_000
    x = (rng.standard_normal((40, 12))[rng.integers(0, 40, n)] * 2 + rng.standard_normal((n, 12))).astype(np.float32)
    asked = F.col("vec_id") % 200 == 0
    got = ann.nearest(vectors(spark, x), "vec_id", "embedding", asked, 20).collect()
    full, recall = x.astype(np.float64), []
    for q in range(0, n, 200):
        s = full @ full[q]
        want = [int(j) for j in np.lexsort((np.arange(n), -s)) if j != q][:20]
        recall.append(len({r["vec_id"] for r in got if r["query_id"] == q} & set(want)) / 20)
    assert n // ann.LIST >= 70 > 2 * ann.VISITS and np.mean(recall) >= 0.9


def test_nearest_repeats_and_overflow(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 4))
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)] * 2 + [(900, [1e200] * 4), (901, [1.0, None, 0.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    held, ids = np.vstack([x, [[1e200] * 4]]), np.append(np.arange(200), 900)
    for q in range(0, 200, 50):
        s = (held * x[q]).sum(1)
        want = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != q][:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_search_counts_a_repeated_id_once():
    rng = np.random.default_rng(4)
    x, ids = rng.standard_normal((60, 8)), np.arange(60)
    want = [int(j) for j in np.lexsort((ids, -(x * x[0]).sum(1))) if j != 0][:20]
    at = np.concatenate([ids, ids, np.repeat(want[0], 100)])
    got = ann._search(20, 1.0)((0, 0, 0), pd.DataFrame({"id": ids[at], "v": list(x[at])}), pd.DataFrame({"id": [0], "v": [x[0]]}))
    assert got["vec_id"].tolist() == want


def test_walk_visits_near_centroids():
    rng = np.random.default_rng(3)
    c = rng.standard_normal((300, 8))
    q = rng.standard_normal((40, 8))
    d = ann._distances(q, c)
    seen = ann.walk(q, c, ann.neighbour_graph(c), 1.1)
    near = np.argsort(d, axis=1)[:, :5]
    assert np.isfinite(np.take_along_axis(seen, near, axis=1)).mean() > 0.95
    ok = np.isfinite(seen)
    assert np.allclose(seen[ok], d[ok])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    text = "the quick brown fox jumps over a lazy dog and runs far away from here today " * 3
    rows = [(i, f"{text}number {i} is unlike the others in word{i} alone{i}\nline {i} of its own words{i}{i}{i} stays here", "en", f"s{i % 3}", 10) for i in range(40)]
    rows += [(100, None, "en", "s0", 0), (101, "123 456", None, "s1", 7), (102, "", "en", "s2", 0), (None, "a row without an id has words", "en", None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, before, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name != "packing":
            assert docs.columns == before.columns
        if name == "language_id":
            assert {r["doc_id"] for r in docs.collect()} == {*range(40), None}
        if name == "mixing":
            words = lambda t: len(t.split())
            assert abs(sum(words(r["text"]) for r in docs.collect()) - 1.5 * sum(words(r["text"]) for r in before.collect())) < 10
    assert P.run(spark, str(tmp_path)).count() == docs.count()


PIPE = "doc_id long, text string, lang string, source string, n_chars long, _h string, _copy long, _lang_pred string, _row int, _mix_size string, drops int, n_lines int"


def piped(spark, rows):
    """rows of (doc_id, text, lang, source), with columns whose names stages might use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), f"h{n}", n, "own", n, "m", n, n) for n, r in enumerate(rows)], PIPE)


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline as P

    rows = [(i, f"text number {i} has words of its own like w{i} and v{i}\nand a second line u{i} t{i} s{i}", "en", "s") for i in range(12)]
    docs = piped(spark, rows)
    held = {r["_copy"]: tuple(r)[5:] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in PIPE.split(", ")], name
        got = docs.collect()
        assert got and all(held[r["_copy"]] == tuple(r)[5:] for r in got), name
    assert P.STAGES[-1][1](spark, docs, "").count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_copy_stage_against_brute_force(spark):
    import random

    import corpus_pipeline as P
    from tests.llm.test_text_ops import brute_groups

    rng, rows = random.Random(41), []
    for _ in range(14):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, 7)):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = "edit"
            rows.append((len(rows), " ".join(w), "en", "s"))
    rng.shuffle(rows)
    want = {i for i, (_, c) in brute_groups([r[:2] for r in rows], 5, 80).items() if i == c}
    more = [(None, None, "en", "s"), (900, "", "en", "s"), (900, "", "en", "s"), (901, "alone in words of any kind here", "en", "s"), (901, "alone in words of any kind here", "en", "s")]
    more += [(902, "one text of an id that comes twice", None, "s"), (902, "another text of the id with other words", None, "s"), (None, "a b c d e f g h", "en", "s"), (None, "A b c d e f g h", "en", "s")]
    got = P.near_copy_stage(spark, piped(spark, [*rows, *more]).drop("_copy", "_row", "_h", "drops", "n_lines"), "").collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900) == sorted(want)
    rest = sorted((str(r["doc_id"]), str(r["text"])) for r in got if r["doc_id"] is None or r["doc_id"] >= 900)
    assert len(rest) == 7 and [r[0] for r in rest] == ["900", "900", "901", "902", "902", "None", "None"]


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_"])
def test_registered(name):
    from tessera.llm.queries import QUERIES

    assert sum(q.startswith(name) for q in QUERIES) == 1
