"""Hierarchical language identification.

A text is a vector of hashed byte trigrams and whole words (ASCII case folded), square-rooted and scaled to
length 1. Languages whose mean vectors are close form families (average-linkage clustering into
``ceil(sqrt(languages))`` families). One linear SVM for each family (one against the rest) picks the family, then
one linear SVM for each pair of its languages votes for the language.

The models are fitted on at most ``sample`` labelled rows, drawn by a hash of id and text, evenly over languages;
prediction covers every whole text, however long. A null text, or one without a letter, is ``und`` with score 0; so is every
text when there is nothing to learn from. Equal votes go to the lesser language name. Repeated rows are predicted
each and learned from once; rows with null language are predicted but not learned from. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, mix, text_bytes, words

DIMS = 2048
SAMPLE = 3000  # labelled rows that the models are fitted on, at most

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[[*range(0x09, 0x0E)]] = 32


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of DIMS values for each text."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    x = _FOLD[data]
    tri = x[:-2] | (x[1:-1] << np.uint64(8)) | (x[2:] << np.uint64(16)) if len(x) > 2 else np.zeros(0, np.uint64)
    same = doc[:-2] == doc[2:] if len(x) > 2 else np.zeros(0, bool)
    slot = ((tri * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)).astype(np.int64)
    out = np.bincount(doc[:-2][same] * DIMS + slot[same], minlength=n * DIMS) if len(x) > 2 else np.zeros(n * DIMS)
    wh, woff, _ = words(data, offs)
    wdoc = np.repeat(np.arange(n), np.diff(woff))
    out = out + np.bincount(wdoc * DIMS + (mix(wh) >> np.uint64(64 - 11)).astype(np.int64), minlength=n * DIMS)
    out = np.sqrt(out.reshape(n, DIMS)).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _parts(offs: np.ndarray):
    for i, j in blocks(offs):
        for a in range(i, j, 512):
            yield a, min(a + 512, j)


def _sparse(batches):
    for batch in batches:
        data, offs = text_bytes(batch.column(2))
        for i, j in _parts(offs):
            x = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            at = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([r[a].astype("<f4").tobytes() for r, a in zip(x, at, strict=True)], pa.binary())], names=["key", "lang", "at", "value"])


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the intercept) of squared hinge loss with an L2 penalty, classes balanced."""
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb, rate = w.copy(), b, np.float32(0.5)
    for t in range(rounds):
        lw, lb = w, b
        slack = np.maximum(0, 1 - y * (x @ vw + vb))
        g = -2 * c * y * slack
        w, b = vw - rate * (x.T @ g + penalty * vw), vb - rate * g.sum()
        m = np.float32(t / (t + 3))
        vw, vb = w + m * (w - lw), b + m * (b - lb)
    return np.append(w, b)


def families(means: np.ndarray) -> list[list[int]]:
    groups = [[i] for i in range(len(means))]
    sim = means @ means.T
    while len(groups) > int(np.ceil(np.sqrt(len(means)))):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: (sim[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
    return sorted(groups)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict | None:
    """labelled: (key, lang, text). The model, a few hundred KB for tens of languages; None without rows."""
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    most = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, 1.5 * most / n))])
    drawn = labelled.select(F.xxhash64("key", "text", F.lit(11)).alias("key"), "lang", "text")
    drawn = drawn.where(F.col("key").bitwiseAND((1 << 52) - 1) / float(1 << 52) < share[F.col("lang")]).dropDuplicates(["key", "lang"])
    rows = drawn.mapInArrow(_sparse, "key bigint, lang string, at binary, value binary").collect()  # about 1.5 * sample
    rows.sort(key=lambda r: (r[1], (r[0] or 0) & ((1 << 52) - 1), r[2], r[3]))
    langs, kept, taken = sorted(counts), [], dict.fromkeys(counts, 0)
    for r in rows:
        if taken[r[1]] < most:
            taken[r[1]] += 1
            kept.append(r)
    langs = [v for v in langs if taken[v]]
    if not langs:
        return None
    x, y = np.zeros((len(kept), DIMS), np.float32), np.array([langs.index(r[1]) for r in kept])
    for i, r in enumerate(kept):
        x[i, np.frombuffer(r[2], "<u2")] = np.frombuffer(r[3], "<f4")
    del rows, kept
    means = np.stack([x[y == i].mean(0) for i in range(len(langs))])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    groups = families(means)
    of = np.array([next(g for g, m in enumerate(groups) if i in m) for i in range(len(langs))])
    top = [linear_svm(x, np.where(of[y] == g, 1, -1).astype(np.float32)) for g in range(len(groups))] if len(groups) > 1 else []
    pairs = [(a, b) for m in groups for a, b in combinations(m, 2)]
    duel = [linear_svm(x[s := (y == a) | (y == b)], np.where(y[s] == a, 1, -1).astype(np.float32)) for a, b in pairs]
    return {"langs": langs, "groups": groups, "pairs": pairs, "top": np.array(top, np.float32), "duel": np.array(duel, np.float32)}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def decide(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and score (0 to 1) of each row of features."""
    langs, groups, n = model["langs"], model["groups"], len(x)
    fam = np.ones((n, 1)) if len(groups) < 2 else x @ model["top"][:, :-1].T + model["top"][:, -1]
    if len(groups) > 1:
        fam = np.exp(3 * (fam - fam.max(1, keepdims=True)))
        fam /= fam.sum(1, keepdims=True)
    votes, of = np.zeros((n, len(langs))), np.zeros(len(langs), int)
    for g, members in enumerate(groups):
        of[members] = g
        votes[:, members] = 1.0 if len(members) == 1 else 0.0
    if len(model["pairs"]):
        p = _sigmoid(3 * (x @ model["duel"][:, :-1].T + model["duel"][:, -1]))
        for c, (a, b) in enumerate(model["pairs"]):
            size = len(groups[of[a]]) - 1
            votes[:, a] += p[:, c] / size
            votes[:, b] += (1 - p[:, c]) / size
    best = fam.argmax(1)
    votes = np.where(of[None, :] == best[:, None], votes, -1)
    pick = votes.argmax(1)
    return pick, fam[np.arange(n), best] * votes[np.arange(n), pick]


def predict(df: DataFrame, text_col: str, model: dict | None, lang_name: str = "lang_pred", score_name: str = "score", keep_text: bool = False) -> DataFrame:
    """df's columns (the text, last of them, only if keep_text), then the predicted language and its score."""
    others = [c for c in df.columns if c != text_col]
    fields = df.select(*others, *[text_col] * keep_text).schema.fields
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(others))
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, offs = text_bytes(texts)
            for i, j in _parts(offs):
                ok = letter[i:j]
                if model is None:
                    names, score = ["und"] * (j - i), np.zeros(j - i)
                else:
                    pick, score = decide(model, features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                    names = [model["langs"][p] if good else "und" for p, good in zip(pick, ok, strict=True)]
                    score = np.where(ok, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(len(fields))], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*[f.name for f in fields], lang_name, score_name])

    return df.select(*others, text_col).mapInArrow(run, schema)


def held_out(id_col: str, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def learnable(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(key, lang, text) of the rows to learn from: crc32(id as text) mod 5 is not 0, language given."""
    return df.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0).select(F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
