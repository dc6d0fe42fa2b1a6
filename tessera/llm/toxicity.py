"""Toxicity: a lexicon trie met by Levenshtein automata, scored by context windows.

The lexicon is learned: words, and stems of four to eight letters with several endings, that toxic texts of a
bounded labelled sample (``SAMPLE`` rows at most) hold far more often than others; it has ``TERMS`` entries at most, those
of the highest odds, and an entry occurs in 1.5 % of the toxic sample, in 5 texts at least. A trie holds it. One
deterministic automaton is the intersection of that trie with the Levenshtein automata of the words in a text: its states
are sets of (trie node, edits so far); words of five or more letters allow one edit after the first letter (digits read
as the letters they stand for), shorter ones and stems none. All words of a block of texts run through it at once.

Every hit looks at its window of ``WINDOW`` words to either side: hits inside quotation marks of their line count as
quoted, others as abuse, and neighbouring hits add up. A logistic model of a handful of these sums, fitted on the same sample, gives
the score. A null or empty text has no hit and the score of such texts. Without labelled rows every score is 0.
Repeated rows get a row each, and very long texts, lines and words are whole. Labels of repeated ids count as toxic if any
is; of the rows of a repeated id the one whose text has the least hash is learned from. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import blocks, shingles, stored, text_bytes, words

SAMPLE = 12_000  # labelled rows learned from, at most: half of them toxic if there are as many
TERMS = 2_000  # entries of the lexicon, at most
WINDOW = 6
RATIO = 20.0  # how many times as often toxic texts hold an entry
#: Digits and the letters they stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
SPACES = np.array([c for c in range(1 << 14) if chr(c).isspace()], np.uint32)
N_FEATURES = 6
POINTS = 0x110000


def _folded() -> np.ndarray:
    """The folded letter of each code point, 0 for what is no letter."""
    out = np.zeros(POINTS, np.uint32)
    for c in range(POINTS):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif s in LEET:
            out[c] = ord(LEET[s])
    return out


_FOLD: list[np.ndarray] = []


def fold(points: np.ndarray) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_folded())
    return _FOLD[0][points]


def _tokens(data: np.ndarray, offs: np.ndarray):
    """(code points, folded, doc ends in points, first and end of each word)."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    f, cut = fold(points), lead[offs]
    letter = f > 0
    start = letter.copy()
    if len(start):
        start[1:] &= ~letter[:-1]
        inner = cut[:-1][cut[:-1] < len(points)]
        start[inner] = letter[inner]
    first = np.flatnonzero(start)
    stop = np.flatnonzero(np.append(~letter, True))
    end = stop[np.searchsorted(stop, first)]
    edge = cut[np.searchsorted(cut, first, "right")]  # words end with their text
    return points, f, cut, first, np.minimum(end, edge)


class Automaton:
    """Deterministic automaton of the lexicon's words with their edits. terms: (text, is_stem)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        kids: list[dict[str, int]] = [{}]
        word: list[int] = [-1]
        stem: list[int] = [-1]
        fuzzy: list[bool] = [False]  # some word below allows an edit
        for t, (text, is_stem) in enumerate(terms):
            node, path = 0, [0]
            for ch in text:
                if ch not in kids[node]:
                    kids[node][ch] = len(kids)
                    kids.append({}), word.append(-1), stem.append(-1), fuzzy.append(False)
                node = kids[node][ch]
                path.append(node)
            if is_stem:
                stem[node] = t
            else:
                word[node] = t
                if len(text) >= 5:
                    for p in path:
                        fuzzy[p] = True
        self.letters = sorted({c for text, _ in terms for c in text})
        code = {c: i + 2 for i, c in enumerate(self.letters)}  # 0: end, 1: any other letter
        edit_word = [word[n] >= 0 and len(terms[word[n]][0]) >= 5 for n in range(len(kids))]

        def close(states):
            states, todo = set(states), list(states)
            while todo:
                n, e = todo.pop()
                if n > 0 and e == 0:  # a letter of the lexicon's word is missing
                    for k in kids[n].values():
                        if fuzzy[k] and (k, 1) not in states:
                            states.add((k, 1)), todo.append((k, 1))
            return frozenset(s for s in states if s[1] == 0 or (s[0], 0) not in states)

        def step(states, ch):
            out = set()
            for n, e in states:
                k = kids[n].get(ch)
                if k is not None and (e == 0 or fuzzy[k]):
                    out.add((k, e))
                if e == 0 and n > 0:
                    if fuzzy[n]:
                        out.add((n, 1))  # one letter too many
                    for c in kids[n].values():
                        if fuzzy[c]:
                            out.add((c, 1))  # another letter
            return close(out)

        begin = frozenset({(0, 0)})
        ids, todo, rows, self.hit = {frozenset(): 0, begin: 1}, [begin], {0: {}}, {0: (-1, 0)}
        found_stem: dict[int, int] = {}
        while todo:
            states = todo.pop()
            s = ids[states]
            best = min(((e, word[n]) for n, e in states if word[n] >= 0 and (e == 0 or edit_word[n])), default=None)
            self.hit[s] = (best[1], best[0]) if best else (-1, 0)
            row = {}
            seen = {c for n, _ in states for c in kids[n]}
            for ch in [*sorted(seen), None]:
                new = step(states, ch)
                stems = [stem[n] for n, e in new if e == 0 and stem[n] >= 0]
                if stems:  # whatever follows: a state of its own
                    t = min(stems)
                    if t not in found_stem:
                        found_stem[t] = 1_000_000 + t
                    row[ch] = found_stem[t]
                    continue
                if new not in ids:
                    ids[new] = len(ids)
                    todo.append(new)
                row[ch] = ids[new]
            rows[s] = row
        n = len(ids)
        final = {v: n + i for i, v in enumerate(sorted(found_stem.values()))}
        self.table = np.zeros((n + len(final), len(self.letters) + 2), np.int32)
        for s, row in rows.items():
            self.table[s, :] = row.get(None, 0) if row.get(None, 0) < 1_000_000 else final[row[None]]
            for ch, to in row.items():
                if ch is not None:
                    self.table[s, code[ch]] = final.get(to, to)
        self.term = np.full(len(self.table), -1, np.int32)
        self.edits = np.zeros(len(self.table), np.int32)
        for s, (t, e) in self.hit.items():
            self.term[s], self.edits[s] = t, e
        self.is_final = np.zeros(len(self.table), bool)
        for t, v in found_stem.items():
            self.term[final[v]], self.is_final[final[v]] = t, True
        self.points = np.array([ord(c) for c in self.letters], np.uint32)  # ascending
        del self.hit

    def run(self, f: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The state in which each word ends; 0 is no match."""
        at = np.minimum(np.searchsorted(self.points, f), max(len(self.points) - 1, 0))
        known = self.points[at] == f if len(self.points) else np.zeros(len(f), bool)
        codes = np.where(f == 0, 0, np.where(known, at + 2, 1))
        out = np.zeros(len(first), np.int32)
        live = np.arange(len(first))
        state = np.ones(len(first), np.int32)
        k = 0
        while len(live):
            state = self.table[state, codes[first[live] + k]]
            k += 1
            over = (first[live] + k >= end[live]) | self.is_final[state] | (state == 0)
            out[live[over]] = state[over]
            live, state = live[~over], state[~over]
        return out


def _quoted(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of the places `at` stands between quotation marks of its line, or in a line that begins with >."""
    feeds = np.append(np.flatnonzero(text == 10), len(text))
    line = np.searchsorted(feeds, at)
    end, start = feeds[line], np.where(line > 0, feeds[line - 1] + 1, 0)
    solid = np.append(np.flatnonzero(~np.isin(text, SPACES)), len(text))
    lead = solid[np.searchsorted(solid, start)]
    out = (lead < end) & (text[np.minimum(lead, len(text) - 1)] == ord(">"))
    for o, c in QUOTES.items():
        opens, closes = (np.flatnonzero(text == ord(x)) for x in (o, c))
        before = np.searchsorted(opens, at)
        later = np.searchsorted(closes, end) > np.searchsorted(closes, at)
        if o == c:
            inside = (before - np.searchsorted(opens, start)) % 2 == 1
        else:
            last = lambda marks, n: np.where(n > 0, np.append(marks, -1)[n - 1], -1)
            opened, closed = last(opens, before), last(closes, np.searchsorted(closes, at))
            inside = (opened >= start) & (opened > closed)
        out |= inside & later
    return out


def features(auto: Automaton, weight: np.ndarray, data: np.ndarray, offs: np.ndarray):
    """A row for each text: sums over its hits; then hits and quoted hits."""
    n = len(offs) - 1
    points, f, cut, first, end = _tokens(data, offs)
    x, hits = np.zeros((n, N_FEATURES), np.float64), np.zeros((n, 2), np.int64)
    state = auto.run(f, first, end)
    at = np.flatnonzero(auto.term[state] >= 0)
    doc = np.searchsorted(cut, first[at], "right") - 1
    n_words = np.bincount(np.searchsorted(cut, first, "right") - 1, minlength=n)[:n]
    for d in np.unique(doc):
        own = at[doc == d]
        text = points[cut[d] : cut[d + 1]]
        near = np.searchsorted(own, own + WINDOW, "right") - np.searchsorted(own, own - WINDOW)
        term, place = auto.term[state[own]], first[own] - cut[d]
        value = weight[term] * (1 + 0.25 * (near - 1))
        quote, edited = _quoted(text, place), auto.edits[state[own]] > 0
        exact, fuzzy, quoted = (value[m].sum() for m in (~quote & ~edited, ~quote & edited, quote))
        hits[d, 1] = quote.sum()
        hits[d, 0] = len(own)
        x[d] = [np.log1p(exact), exact > 0, np.log1p(fuzzy), np.log1p(quoted), np.log1p(1000 * (exact + fuzzy) / max(n_words[d], 1)), len(np.unique(term)) > 1]
    return x, hits


def _parts(offs):
    for i, j in blocks(offs):
        for a in range(i, j, 4096):
            yield a, min(a + 4096, j)


def _words(batches):
    """(text, toxic) to a row for each different word of each text, with a sketch that copies of the text share."""
    for batch in batches:
        data, offs = text_bytes(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j in _parts(offs):
            _, f, cut, first, end = _tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            doc = np.searchsorted(cut, first, "right") - 1
            wh, woff, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            h, off = shingles(wh, woff, 5)
            sketch = [int(h[a:b].min().view(np.int64)) if b > a else 0 for a, b in zip(off[:-1], off[1:], strict=True)]
            seen = {(int(d), f[a:b].tobytes()) for d, a, b in zip(doc, first, end, strict=True)}
            terms = [w.decode("utf-32-le", "replace") for _, w in seen]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([int(toxic[i + d]) for d, _ in seen], pa.int32()), pa.array([sketch[d] for d, _ in seen], pa.int64())], names=["term", "toxic", "sketch"])


def _lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """(text, is_stem, log odds) of at most TERMS entries."""
    per_word = stored(sample.select("text", "toxic").mapInArrow(_words, "term string, toxic int, sketch bigint").distinct().groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxic-words")
    odds = F.log(((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1)))
    some = max(5, n_toxic * 3 // 200)
    found = per_word.where((F.length("term") >= 3) & (F.col("t") >= some)).withColumn("w", odds).where(F.col("w") >= float(np.log(RATIO))).orderBy(F.desc("w"), F.desc("t"), "term").limit(TERMS // 2).collect()
    cut = per_word.withColumn("n", F.explode(F.array(*[F.lit(k) for k in range(4, 9)]))).where(F.length("term") > F.col("n")).groupBy(F.expr("substring(term, 1, n)").alias("stem")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("endings"))
    stems = cut.where((F.col("t") >= 3 * some) & (F.col("endings") >= 5)).withColumn("w", odds).where(F.col("w") >= float(np.log(2 * RATIO))).orderBy(F.desc("w"), F.desc("t"), "stem").limit(TERMS // 2).collect()
    by_stem = {r["stem"]: r for r in stems}
    kept = {s: r for s, r in by_stem.items() if not any(o.startswith(s) and o != s and by_stem[o]["t"] >= 0.9 * r["t"] for o in by_stem)}
    kept = {s: r for s, r in kept.items() if not any(s.startswith(o) and s != o for o in kept)}
    # A word that begins with a stem stays beside it, for its edits.
    out = [(r["term"], False, float(r["w"])) for r in found if r["term"] not in kept]
    return out + [(s, True, float(r["w"])) for s, r in sorted(kept.items())]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights, intercept last, by Newton's method with a small L2 penalty, classes as in the sample."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.5 * np.append(w[:-1], 0)
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(len(w))
        s = np.linalg.solve(h, g)
        w -= s
        if np.abs(s).max() < 1e-8:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> dict | None:
    """The model, from rows whose crc32(id as text) mod 3 is not 1. None without labelled rows."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1))
    known = stored(known.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")), "toxic-labels")
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not n:
        return None
    draw = F.xxhash64("_id", F.lit(23)).bitwiseAND((1 << 40) - 1)
    some = [known.where(F.col("toxic") == v).where(draw <= int(min(1.0, sample / max(n.get(v, 0), 1)) * (1 << 40))).orderBy(draw, "_id").limit(sample // 2) for v in (0, 1)]
    drawn = stored(some[0].union(some[1]), "toxic-drawn")  # at most `sample` ids
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(drawn), "_id")
    rows = rows.groupBy("_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")
    rows = stored(rows, "toxic-sample")
    got = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = got.get(1, 0), got.get(0, 0)
    if not n_toxic + n_clean:
        return None
    terms = _lexicon(rows, n_toxic, n_clean) if n_toxic and n_clean else []
    auto, weight = Automaton([(t, s) for t, s, _ in terms]), np.array([w for _, _, w in terms] or [0.0])

    def describe(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            for i, j in _parts(offs):
                x, _ = features(auto, weight, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([pa.array(x[:, c]) for c in range(N_FEATURES)] + [batch.column(1).slice(i, j - i)], names=[*[f"x{c}" for c in range(N_FEATURES)], "toxic"])

    seen = rows.mapInArrow(describe, ", ".join(f"x{c} double" for c in range(N_FEATURES)) + ", toxic int").toArrow()
    x = np.stack([seen.column(c).to_numpy() for c in range(N_FEATURES)], axis=1)
    y = seen.column(N_FEATURES).to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))
    return {"auto": auto, "weight": weight, "w": _logistic(x[order], y[order])}


def score(df: DataFrame, text_col: str, model: dict | None) -> DataFrame:
    """df without the text, then score, n_hits and n_quoted."""
    others = [c for c in df.columns if c != text_col]
    schema = T.StructType([*df.select(*others).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("n_quoted", T.LongType())])

    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(len(others)))
            for i, j in _parts(offs):
                p, hits = np.zeros(j - i), np.zeros((j - i, 2), np.int64)
                if model is not None:
                    x, hits = features(model["auto"], model["weight"], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    p = 1 / (1 + np.exp(-np.clip(x @ model["w"][:-1] + model["w"][-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(len(others))], pa.array(p), pa.array(hits[:, 0]), pa.array(hits[:, 1])], names=[*others, "score", "n_hits", "n_quoted"])

    return df.select(*others, text_col).mapInArrow(run, schema)
