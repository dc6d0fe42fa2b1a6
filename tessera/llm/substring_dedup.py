"""Substring dedup by collinear chaining: passages that repeat in other documents, exactly or nearly.

Texts with equal words are one class, known by a hash of its words; it stands for its rows and is searched once.

Seeds are k-word shingles picked by winnowing (the least hash of every ``WINDOW`` consecutive shingles, so any repeated
run of ``WINDOW + K - 1`` words shares one). A seed that a text repeats counts by its number there, so the n-th meets the
n-th of other texts. As texts that repeat a phrase count it differently, runs of ``RUN`` words are seeds too, one kind told
from the other by the last bit; a run is two seeds ``RUN - K`` words apart. Up to ``MATES`` holders of a seed are all linked. At a seed of more, which may be a phrase that
unrelated texts use, every two holders are compared in place by the ``AROUND`` words on both sides: those that are alike to a
common holder are one cluster; between clusters a bitmap of word pairs bounds what two holders share from above, and those
left are linked, and their clusters joined, if ``least`` words about the seed are ``percent`` % equal, shifted by ``SHIFT``
words at most. So a group of near copies gives links as its holders are, no partner hides behind holders of fragments, and
no pair that fails becomes a row. Seeds of over ``TILE`` holders are compared in pairs of tiles, each a task's bounded group.

The links of a pair of classes are ordered matches; those that go together are chained by a Fenwick tree over positions
in the partner, with gap costs linear in the words skipped. Chains of two seeds or more that span ``SPAN`` words are
aligned on the words themselves: word by word where both sides skip equally, by their longest common subsequence in unequal
gaps, and extended at both ends, by ``ENDS`` words at most (longer equal stretches have seeds of their own), until too many
words differ. Passages of at least ``least`` words with ``percent`` % equal words remain: the whole chain, or its longest
parts between seeds.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z folded; offsets count words. Rows with null ids, null or empty texts have no
passages. Rows with equal ids and different texts are texts of their own, but no passage is reported between them. Ids may
be of any type that has an order. Ties between equally good chains go to the first. Very long texts are whole: their
links are spread over pairs. An empty table gives no rows, and other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, drop, least_reachable, marked, marks, mix, shingles, stored, text_bytes, words

K, WINDOW = 5, 6
LEAST, PERCENT = 50, 80
RUN = 20  # words of a run; one is picked of LEAST - RUN, so that LEAST equal words hold one
MATES = 4
SPAN = 12  # words from a chain's first seed to its last, at least
SCORE = K  # of a chain of several seeds, at least
GAP = 0.1  # cost of a skipped word, in words
ENDS = 2 * LEAST  # words kept around a chain, for extending it
AROUND = LEAST  # words that a holder of a frequent seed shows on each side
SHIFT = 12  # words by which two holders' words may be shifted against each other
TILE = 4096  # holders of a seed that a task compares with each other or with as many others
LEADERS = 4  # clusters looked for by equal words before holders are compared in pairs
CHUNK = 2048  # pairs whose words are compared at once
PAIRS = 1 << 17  # pairs looked at at once, an eighth by bitmaps
BITS = 4096  # of the bitmap of a holder's word pairs
DENSE = 256  # holders to be met from which bits are added up for all of them together


def _picks(h: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """The shingle of the least hash of each window of ``window`` shingles that lies in one text.

    Of equal hashes the one whose place in its text is a multiple of the window's length goes first, so a run of one
    word gives a seed for each window's length, not for each word.
    """
    n = np.diff(off)
    place = (np.arange(len(h)) - np.repeat(off[:-1], n)) % window
    h = (h & np.uint64(0xFFFFFFFFFFFFFFF0)) | place.astype(np.uint64)
    if len(h) < window:
        return np.zeros(0, np.int64)
    start = np.arange(len(h) - window + 1)
    start = start[np.repeat(off[1:], n)[start] - start >= window]
    return start + np.lib.stride_tricks.sliding_window_view(h, window)[start].argmin(axis=1)


def winnow(h: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the least hash of each window; of each whole text that is shorter."""
    n = np.diff(off)
    out = [_picks(h, off, window)]
    out += [[off[d] + int(h[off[d] : off[d + 1]].argmin())] for d in np.flatnonzero((n > 0) & (n < window))]
    return np.unique(np.concatenate(out)).astype(np.int64)


def numbered(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Seeds made different by how often their text has had them before, so that repeats match in order."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    hs, ds = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    place = np.arange(len(h))
    again = place - np.maximum.accumulate(np.where(first, place, 0))
    out = h.copy()
    out[order] = np.where(again > 0, mix(hs + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), hs)
    return out


def _signatures(wh: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """A hash of each text's word sequence."""
    n = np.diff(woff)
    place = np.arange(len(wh)) - np.repeat(woff[:-1], n)
    out = n.astype(np.uint64)
    some = n > 0
    if some.any():
        out[some] ^= np.add.reduceat(mix(wh ^ mix(place.astype(np.uint64))), woff[:-1][some])
    return mix(out).view(np.int64)


def _texts(column: pa.Array):
    """(first row, last, words, word offsets, signatures) of blocks of rows."""
    data, offs = text_bytes(column)
    for i, j in blocks(offs):
        wh, woff, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, j, wh, woff, _signatures(wh, woff)


def _describe(batches):
    """(id, text) to (id, sig, words)."""
    for batch in batches:
        for i, j, _, woff, sig in _texts(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sig), pa.array(np.diff(woff))], names=["id", "sig", "n"])


def _kind(wh: np.ndarray, woff: np.ndarray, new: np.ndarray, size: int, window: int, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, first word) of seeds of so many words in the texts that are `new`."""
    h, off = shingles(wh, woff, size, whole_if_short=False)
    at = winnow(h, off, window)
    doc = np.searchsorted(off, at, "right") - 1
    at, doc = at[new[doc]], doc[new[doc]]
    h = numbered(h[at], doc).view(np.int64)
    return (h & ~1) | bit, doc, (at - off[doc]).astype(np.int32)


def _seeded(batches):
    """(signature of each seed's text, seed, place, first word, word hashes, text ends) of blocks of different texts."""
    seen: set[int] = set()
    for batch in batches:
        for i, j, wh, woff, sig in _texts(batch.column(0)):
            new = np.zeros(j - i, bool)
            for d, v in enumerate(sig.tolist()):
                if v not in seen:  # texts of equal words have equal seeds
                    seen.add(v)
                    new[d] = True
            if len(seen) > 1 << 18:
                seen.clear()
            found = [_kind(wh, woff, new, size, window, bit) for bit, (size, window) in enumerate(((K, WINDOW), (RUN, LEAST - RUN)))]
            h, doc, pos = (np.concatenate(c) for c in zip(*found, strict=True))
            yield h, sig[doc], pos, wh, woff[doc], woff[doc + 1]


def _seeds(batches):
    """Texts to (h, sig, pos) of the n-th seed of a kind in a text."""
    for h, sig, pos, _, _, _ in _seeded(batches):
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(sig), pa.array(pos)], names=["h", "sig", "pos"])


def _contexts(hot: np.ndarray):
    """Texts to (h, sig, pos, ctx) of seeds that `hot` lets through; ctx has a byte for each word around, 0 beyond the text."""

    def run(batches):
        for h, sig, pos, wh, start, end in _seeded(batches):
            own = np.flatnonzero(marked(hot, h))
            at = (start + pos)[own, None] + np.arange(-AROUND, K + AROUND)
            inside = (at >= start[own, None]) & (at < end[own, None])
            byte = (wh >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
            ctx = np.where(inside, byte[np.clip(at, 0, len(wh) - 1)] if len(wh) else 0, 0).astype(np.uint8)
            ends = np.arange(len(own) + 1, dtype=np.int32) * np.int32(K + 2 * AROUND)
            binary = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ctx))])
            yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(sig[own]), pa.array(pos[own]), binary], names=["h", "sig", "pos", "ctx"])

    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    return np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)) if len(columns[0]) else np.zeros(0, bool)


def _links(mates: int, told: bool = False):
    """Seeds sorted by (h, sig) to links (id, other, pos, other_pos) of all who hold one, id the greater; of a seed with
    over `mates` holders to (h, number of holders, -1, -1). If told, then reach, as of `_reach`; 0 but for runs."""
    ahead = int(np.array([0, RUN - K, 0, RUN - K], np.uint8).view(np.int32)[0])  # a run's last words, as `_reach` tells of them

    def link(h, sig, pos, before):
        first = _changes(h)
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(h)))
        total = size.copy()
        total[:1] += before
        hot = total > mates
        rank = np.arange(len(h)) - np.repeat(start, size)
        cold = ~np.repeat(hot, size)
        i = [np.flatnonzero(cold & (rank >= back)) for back in range(1, mates)]
        a, b = np.concatenate(i), np.concatenate([v - back for back, v in enumerate(i, 1)])
        no = np.full(int(hot.sum()), -1, np.int32)
        cols = [np.append(sig[a], h[start[hot]]), np.append(sig[b], total[hot]), np.append(pos[a], no), np.append(pos[b], no)]
        if told:
            cols.append(np.append((h[a] & 1).astype(np.int32) * np.int32(ahead), no * np.int32(0)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "other", "pos", "other_pos", "reach"][: len(cols)])

    def run(batches):
        held, before = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)], 0  # the last seed may go on
        for batch in batches:
            held = [np.append(x, batch.column(c).to_numpy()) for c, x in enumerate(held)]
            new = np.flatnonzero(_changes(held[0], held[1]))  # a text that several tasks have met
            held = [x[new] for x in held]
            if not len(new):
                continue
            cut = int(np.argmax(held[0] == held[0][-1]))
            if cut:
                yield link(*[x[:cut] for x in held], before)
                held, before = [x[cut:] for x in held], 0
            if len(held[0]) > mates:
                before += len(held[0]) - 1
                held = [x[-1:] for x in held]
        if len(held[0]):
            yield link(*held, before)

    return run


def _holds(equal: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Which rows have a stretch of `least` places or more, `percent` % of them set, the first and the last among them."""
    n = equal.shape[1] - least + 1
    total = np.zeros((len(equal), equal.shape[1] + 1), np.int32)
    np.cumsum(equal * np.int32(100) - np.int32(percent), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(np.where(equal[:, :n], total[:, :n], 1 << 30), axis=1)
    return (equal[:, least - 1 :] & (total[:, least:] >= low)).any(axis=1)


def _side_by_side(a: np.ndarray, b: np.ndarray):
    """For every shift: which words of contexts a equal those of contexts b that are shifted by so many places."""
    size = a.shape[1]
    for s in range(-SHIFT, SHIFT + 1):
        equal = np.zeros(a.shape, bool)
        lo, hi = max(0, -s), min(size, size - s)
        equal[:, lo:hi] = (a[:, lo:hi] == b[:, lo + s : hi + s]) & (a[:, lo:hi] > 0)
        yield s, equal


def _alike(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Which contexts have `least` words or more of which `percent` % are equal, by one shift or by shifts that words nearby share."""
    out = _holds((a == b) & (a > 0), least, percent)
    left = np.flatnonzero(~out)
    a, b = a[left], b[left]
    matched = np.zeros(a.shape, bool)
    for _, e in _side_by_side(a, b):
        near = np.zeros(a.shape, bool)
        for d in (1, 2):
            near[:, d:] |= e[:, :-d]
            near[:, :-d] |= e[:, d:]
        matched |= e & near
    out[left] = _holds(matched, least, percent)
    return out


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of contexts: places of equal seeds before and after the common one, and their partners.

    Four bytes: words back and forth here, then there; within 22 words, so that they chain with it: the farthest without a
    shift, where there are such on both sides, or with any.
    """
    far, out = 22, np.zeros((len(a), 4), np.uint8)

    def look(rows, s, e):
        run = e[:, : e.shape[1] - K + 1].copy()
        for d in range(1, K):
            run &= e[:, d : d + run.shape[1]]
        before, after = run[:, AROUND - far : AROUND], run[:, AROUND + far : AROUND : -1]
        for side, part in ((0, before), (1, after)):
            here = np.where(part.any(axis=1), far - part.argmax(axis=1), 0)
            there = here - s if side == 0 else here + s
            better = (here > out[rows, side]) & (there > 0)
            out[rows[better], side], out[rows[better], 2 + side] = here[better], there[better]

    look(np.arange(len(a)), 0, (a == b) & (a > 0))
    left = np.flatnonzero((out[:, :2] == 0).any(axis=1))
    for s, e in _side_by_side(a[left], b[left]):
        look(left, s, e)
    return out.view(np.int32)[:, 0]


def _pair_bits(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps of the word pairs of each context, how many pairs fell on a bit that was set); repeats are pairs of their own."""
    pair = ctx[:, :-1].astype(np.int64) * 256 + ctx[:, 1:]
    pair[(ctx[:, :-1] == 0) | (ctx[:, 1:] == 0)] = -1
    pair.sort(axis=1)
    place = np.arange(pair.shape[1])
    first = np.ones(pair.shape, bool)
    first[:, 1:] = pair[:, 1:] != pair[:, :-1]
    again = place - np.maximum.accumulate(np.where(first, place, 0), axis=1)
    bit = (mix((pair * 128 + again).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)
    bits = np.zeros((len(ctx), BITS), bool)
    row, col = np.nonzero(pair >= 0)
    bits[row, bit[row, col]] = True
    return np.packbits(bits, axis=1).view(np.uint64), (pair >= 0).sum(axis=1) - bits.sum(axis=1)


def _turned(bits: np.ndarray) -> np.ndarray:
    """A row for each bit with a bit for each holder, and one of zeros, from the holders' bitmaps."""
    out = np.zeros((BITS + 1, -(-len(bits) // 8)), np.uint8)
    for k in range(0, len(bits), CHUNK):
        part = np.unpackbits(bits[k : k + CHUNK].view(np.uint8), axis=1)
        out[:BITS, k // 8 : (k + CHUNK) // 8] = np.packbits(part.T, axis=1)
    return out


def _sharing(turned: np.ndarray, own: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each of the bitmaps `own`, which holders of `turned` share at least so many of its bits.

    Counts of all holders are kept as eight rows of binary digits; two rows of bits at a time go in by full adders. They
    start at 128 less the least number, so that the last digit tells.
    """
    on = np.unpackbits(own.view(np.uint8), axis=1)
    at = np.full((len(own), int(on.sum(axis=1, dtype=np.int64).max(initial=0))), BITS)
    row, bit = np.nonzero(on)
    at[row, np.arange(len(row)) - np.searchsorted(row, row)] = bit
    start = 128 - np.clip(least, 0, 128)
    digits = [np.repeat((start >> d & 1).astype(np.uint8)[:, None] * np.uint8(255), turned.shape[1], axis=1) for d in range(8)]
    waits: list[np.ndarray | None] = [None] * 8

    def add(x, d):
        while d < 8 and waits[d] is not None:
            y, waits[d] = waits[d], None
            either = x ^ y
            digits[d], x, d = digits[d] ^ either, (x & y) | (digits[d] & either), d + 1
        if d < 8:
            waits[d] = x

    for k in range(at.shape[1]):
        add(turned[at[:, k]], 0)
    for d in range(8):
        if waits[d] is not None:
            add(np.zeros_like(digits[d]), d)
    return digits[7]


def _set_bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the bits that are set in rows of bytes, few of which are not zero."""
    at = np.flatnonzero(x.ravel() != 0)
    k, bit = np.nonzero(np.unpackbits(x.ravel()[at, None], axis=1))
    return at[k] // x.shape[1], at[k] % x.shape[1] * 8 + bit


def met(ctx: np.ndarray, seed: np.ndarray, part: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i > j: links by which those holders of each seed are connected that are alike, directly or over others.

    Holders of a seed are neighbours. `part` is the side of each in a pair of tiles; those of one side are compared
    elsewhere, but for seeds all of whose holders are of side 0: there is one tile.
    """
    label, rest, out = np.arange(len(ctx)), np.arange(len(ctx)), []
    for _ in range(LEADERS):
        first = _changes(seed[rest])
        lead, rest = rest[first][np.cumsum(first) - 1][~first], rest[~first]
        if not len(rest):
            break
        same = np.concatenate([_holds((ctx[x] == ctx[y]) & (ctx[y] > 0), least, percent) for x, y in zip(*(np.array_split(v, 1 + len(rest) // CHUNK) for v in (rest, lead)), strict=True)])
        label[rest[same]] = lead[same]
        out.append((rest[same], lead[same]))
        rest = rest[~same]
    start = np.flatnonzero(_changes(seed))
    size = np.diff(np.append(start, len(seed)))
    mixed = np.repeat(np.logical_or.reduceat(label != np.repeat(label[start], size), start), size)  # seeds of several clusters
    sides = np.repeat(np.logical_or.reduceat(part > 0, start), size)
    common = label == label[np.repeat(start, size)]  # in the cluster of its seed's first holder; the others go before
    open_ = np.lexsort((common, seed))
    open_ = open_[mixed[open_]]
    top = np.flatnonzero(_changes(seed[open_]))
    size = np.diff(np.append(top, len(open_)))
    others = np.add.reduceat(np.append(~common[open_], False).astype(np.int64), top) if len(top) else size
    n = np.minimum(np.arange(len(open_)) - np.repeat(top, size), np.repeat(others, size))  # of those before each, that it meets
    top = np.repeat(top, size)
    bits, lost = (np.concatenate(v) for v in zip(*[_pair_bits(ctx[rows]) for rows in np.array_split(open_, 1 + len(open_) // CHUNK)], strict=True))
    folded = np.bitwise_or.reduce(bits.reshape(len(bits), 4, BITS // 256), axis=1)
    hidden = lost + np.bitwise_count(bits).sum(axis=1, dtype=np.int64) - np.bitwise_count(folded).sum(axis=1, dtype=np.int64)
    same = -(-percent * least // 100)
    need = same - (least - same) - 1  # the equal words of such a stretch lie in least - same + 1 runs at most, the rest are pairs
    most = np.repeat(np.maximum.reduceat(n, np.unique(top)), size) if len(n) else n  # that a holder of its seed meets
    turned_at, total, r, waiting = -1, np.append(0, np.cumsum(n)), 0, [np.zeros(0, np.int64)] * 2
    while r < len(open_) or len(waiting[0]):
        if r < len(open_):
            r0, r = r, max(r + 1, int(np.searchsorted(total, total[r] + PAIRS, "right")) - 1)
            few = np.flatnonzero(most[r0:r] < DENSE) + r0
            x = np.repeat(few, n[few])
            y = np.arange(len(x)) - np.repeat(np.cumsum(n[few]) - n[few] - top[few], n[few])
            for t in np.unique(top[r0:r][most[r0:r] >= DENSE]).tolist():
                rows = np.flatnonzero(top[r0:r] == t) + r0
                if t != turned_at:
                    turned, turned_at = _turned(bits[t : t + most[t]]), t
                own, y_ = _set_bits(_sharing(turned[:, : -(-int(n[rows].max()) // 8)], bits[rows], need - lost[rows]))
                x, y = (np.append(v, w[y_ < n[rows][own]]) for v, w in ((x, rows[own]), (y, t + y_)))
            i, j = open_[x], open_[y]
            ok = (label[i] != label[j]) & (~sides[i] | (part[i] != part[j]))
            x, y = x[ok], y[ok]
            for k in range(0, len(x), PAIRS // 8):
                u, v = x[k : k + PAIRS // 8], y[k : k + PAIRS // 8]
                for held, gone in ((folded, hidden), (bits, lost)):  # a quarter of the bits rules most out
                    ok = np.bitwise_count(held[u] & held[v]).sum(axis=1, dtype=np.int16) + np.minimum(gone[u], gone[v]) >= need
                    u, v = u[ok], v[ok]
                i, j = open_[u], open_[v]
                waiting = [np.append(waiting[0], np.maximum(i, j)), np.append(waiting[1], np.minimum(i, j))]
        while len(waiting[0]) >= CHUNK or r == len(open_) and len(waiting[0]):
            (i, j), waiting = ([w[:CHUNK] for w in waiting], [w[CHUNK:] for w in waiting])
            good = _alike(ctx[i], ctx[j], least, percent)
            i, j = i[good], j[good]
            if len(i):
                _, first = np.unique(label[i] * len(ctx) + label[j], return_index=True)
                out.append((i[first], j[first]))
                nodes, low = least_reachable(label[i[first]], label[j[first]])
                to = np.arange(len(ctx))
                to[nodes] = low
                label = to[label]
                apart = label[waiting[0]] != label[waiting[1]]
                waiting = [w[apart] for w in waiting]
    return tuple(np.concatenate([np.zeros(0, np.int64), *[o[c] for o in out]]) for c in (0, 1))


def _meet(mates: int, least: int, percent: int):
    """Holders (h, a, b, part, sig, pos, ctx) sorted by (h, a, b, sig), where a and b are tiles, -1 for a seed of one, to links (id, other, pos, other_pos, reach)."""

    def links(h, a, b, part, sig, pos, ctx):
        new = _changes(h, a, b, sig)  # a text that several tasks have met
        h, a, b, part, sig, pos, ctx = (c[new] for c in (h, a, b, part, sig, pos, ctx))
        start = np.flatnonzero(_changes(h, a, b))
        size = np.diff(np.append(start, len(h)))
        seed, size = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
        real = (size > mates) | (b >= 0)  # others the filter let through in error
        seed, part, sig, pos, ctx = (c[real] for c in (seed, part, sig, pos, ctx))
        i, j = met(ctx, seed, part, least, percent) if len(seed) else (np.zeros(0, np.int64),) * 2
        reach = [_reach(ctx[x], ctx[y]) for x, y in zip(*(np.array_split(v, 1 + len(i) // CHUNK) for v in (i, j)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (sig[i], sig[j], pos[i], pos[j], np.concatenate(reach))], names=["id", "other", "pos", "other_pos", "reach"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ctx = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, K + 2 * AROUND)
            cols = [batch.column(c).to_numpy() for c in range(6)] + [ctx]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            last = int(np.flatnonzero(_changes(*cols[:3]))[-1])  # the last seed may go on
            if last:
                yield links(*[c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield links(*held)

    return run


class Fenwick:
    """Maxima of prefixes."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The maximum at indexes below i."""
        out = (-np.inf, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray, least_score: float) -> list[np.ndarray]:
    """Index arrays of disjoint chains of matches (x, y), best first; x and y both increase along each."""
    order = np.lexsort((y, x))
    xs, ys = x[order], y[order]
    if len(x) > 1:
        dx, dy = np.diff(xs), np.diff(ys)
        if (dx > 0).all() and (dy > 0).all() and (GAP * (dx + dy) < K).all():  # every step gains: one chain
            return [order] if K * len(x) - GAP * float((dx + dy).sum()) >= least_score else []
    rank = np.searchsorted(np.unique(ys), ys)
    tree, score, back = Fenwick(int(rank.max()) + 1), np.zeros(len(x)), np.full(len(x), -1)
    i = 0
    while i < len(x):
        j = i
        while j < len(x) and xs[j] == xs[i]:  # matches of one x see only those before it
            best, b = tree.upto(int(rank[j]))
            gain = best - GAP * float(xs[j] + ys[j])
            score[j], back[j] = (K + gain, b) if gain > 0 else (float(K), -1)
            j += 1
        for m in range(i, j):
            tree.put(int(rank[m]), (score[m] + GAP * float(xs[m] + ys[m]), m))
        i = j
    used, out = np.zeros(len(x), bool), []
    for end in np.argsort(-score, kind="stable"):
        if score[end] < least_score:
            break
        if used[end]:
            continue
        path, m = [], end
        while m >= 0 and not used[m]:
            path.append(m)
            m = back[m]
        used[path] = True
        own = K * len(path) - GAP * float(xs[path[0]] + ys[path[0]] - xs[path[-1]] - ys[path[-1]])  # not the gap to what is used
        if own >= least_score:
            out.append(order[np.array(path[::-1])])
    return out


def _spread(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different links, in order, with the equal seeds that a link tells of before and after it."""
    four = np.ascontiguousarray(reach.astype(np.int32)).view(np.uint8).reshape(-1, 4).astype(np.int64)
    back, forth = four[:, 0] > 0, four[:, 1] > 0
    x, y = (np.concatenate([v, v[back] - four[back, c], v[forth] + four[forth, c + 1]]) for v, c in ((x, 0), (y, 2)))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    return x[new], y[new]


def _chain(span: int):
    """Sorted links (id, other, pos, other_pos, reach) to chains (id, other, xs, ys)."""

    def flush(key, x, y, reach, out):
        if not reach.any() and (len(x) < 2 or min(x[-1] - x[0], y.max() - y.min()) < span):
            return
        x, y = _spread(x, y, reach)
        for c in chains(x, y, SCORE):
            if len(c) > 1 and min(x[c[-1]] - x[c[0]], y[c[-1]] - y[c[0]]) >= span:
                out.append((*key, x[c].tolist(), y[c].tolist()))

    def run(batches):
        held = None  # links of the last pair, which may go on
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in range(5)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.append(x, y) for x, y in zip(held, cols, strict=True)]
            a, b, x, y, reach = cols
            start = np.flatnonzero(_changes(a, b))
            told = np.add.reduceat((reach != 0).astype(np.int64), start)[:-1] > 0
            many, out = np.flatnonzero((np.diff(start) > 1) | told), []
            for s, e in zip(start[many].tolist(), start[many + 1].tolist(), strict=True):
                flush((int(a[s]), int(b[s])), x[s:e], y[s:e], reach[s:e], out)
            held = [v[start[-1] :] for v in cols]
            yield _chain_batch(out)
        if held is not None:
            out = []
            flush((int(held[0][0]), int(held[1][0])), *held[2:], out)
            yield _chain_batch(out)

    return run


def _chain_batch(rows):
    cols = list(zip(*rows, strict=True)) if rows else ([], [], [], [])
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "other", "xs", "ys"])


def _word_arrays(wanted: np.ndarray):
    """Texts to (sig, 32-bit hashes of the words) of the wanted signatures, each once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, wh, woff, sig in _texts(batch.column(0)):
                short, own = (wh >> np.uint64(32)).astype(np.uint32), []
                for d in np.flatnonzero(marked(wanted, sig)):
                    if int(sig[d]) not in seen:
                        seen.add(int(sig[d]))
                        own.append(d)
                if len(seen) > 1 << 18:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(sig[own]), pa.array([short[woff[d] : woff[d + 1]].tobytes() for d in own], pa.binary())], names=["sig", "hashes"])

    return run


def _gap_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in an alignment of two stretches: their longest common subsequence, a row of bits a word."""
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for w in b.tolist():
        if w in places:
            same = row & places[w]
            row = (row + same | row - same) & every
    return len(a) - row.bit_count()


def _extend(a: np.ndarray, b: np.ndarray, spare: int, percent: int) -> tuple[int, int]:
    """(words taken, equal words) of two stretches read side by side, to the best score: 1 for equal, -2 for not.

    No further than leaves ``percent`` % equal words, if the words before have ``spare`` / 100 equal words too many.
    """
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    best = int(score.argmax())
    if score[best] <= 0:
        return 0, 0
    equal = np.cumsum(same[: best + 1])
    ok = np.flatnonzero(same[: best + 1] & (spare + 100 * equal - percent * np.arange(1, best + 2) >= 0))
    return (int(ok[-1]) + 1, int(equal[ok[-1]])) if len(ok) else (0, 0)


def _longest(gain: np.ndarray, size: np.ndarray) -> tuple[int, int] | None:
    """The steps i to j - 1 of the most words whose gains add up to 0 or more."""
    total, place = np.append(0, np.cumsum(gain)), np.append(0, np.cumsum(size))
    low = np.minimum.accumulate(total)
    i = len(low) - np.searchsorted(low[::-1], total, "right")  # the first i with total[i] <= total[j]
    words = place - place[np.minimum(i, len(low) - 1)]
    j = int(words.argmax())
    return (int(i[j]), j) if words[j] > 0 else None


def align(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """[(start, end, other start, other end, equal words)] of a chain of seeds, on word hashes x and y.

    One passage if the chain has ``percent`` % equal words; otherwise the longest parts between seeds that have.
    """
    step = np.minimum(np.diff(xs), np.diff(ys)) if len(xs) > 1 else np.zeros(0, np.int64)
    own = np.append(np.minimum(K, step), K)  # words of each seed that the next doesn't hold
    bx, by = (np.append(np.stack([v, v + own], axis=1).ravel()[:-1], v[-1] + K) for v in (xs, ys))  # seed, gap, seed, ...
    equal = np.zeros(len(bx) - 1, np.int64)
    equal[::2] = own
    for i in range(1, len(equal), 2):
        a, b = x[bx[i] : bx[i + 1]], y[by[i] : by[i + 1]]
        equal[i] = (a == b).sum() if len(a) == len(b) else _gap_matches(a, b)
    size = np.maximum(np.diff(bx), np.diff(by))
    gain = 100 * equal - percent * size

    def passage(i: int, j: int, x0: int, x1: int, y0: int, y1: int):
        """Stretches i to j - 1 with what may be added within x0 to x1 and y0 to y1."""
        a, b, c, d, same = int(bx[i]), int(bx[j]), int(by[i]), int(by[j]), int(equal[i:j].sum())
        right, re = _extend(x[b:x1], y[d:y1], 100 * same - percent * max(b - a, d - c), percent)
        b, d, same = b + right, d + right, same + re
        left, le = _extend(x[x0:a][::-1], y[y0:c][::-1], 100 * same - percent * max(b - a, d - c), percent)
        return a - left, b, c - left, d, same + le

    def passes(p) -> bool:
        return min(p[1] - p[0], p[3] - p[2]) >= least and 100 * p[4] >= percent * max(p[1] - p[0], p[3] - p[2])

    out, todo = [], [(0, len(equal), 0, len(x), 0, len(y))]
    whole = passage(*todo[0])
    if passes(whole):
        return [whole]
    while todo:
        lo, hi, x0, x1, y0, y1 = todo.pop()
        part = _longest(gain[lo:hi], size[lo:hi]) if hi > lo and min(x1 - x0, y1 - y0) >= least else None
        if part is None:
            continue
        i, j = lo + part[0], lo + part[1]
        p = passage(i, j, x0, x1, y0, y1)
        if passes(p):
            out.append(p)
            after = max(j, int(np.searchsorted(bx[:-1], p[1])), int(np.searchsorted(by[:-1], p[3])))
            before = min(i, int(np.searchsorted(bx, p[0], "right")) - 1, int(np.searchsorted(by, p[2], "right")) - 1)
            todo += [(lo, before, x0, p[0], y0, p[2]), (after, hi, p[1], x1, p[3], y1)]
        else:  # the others may still take its words
            todo += [(lo, i, x0, x1, y0, y1), (j, hi, x0, x1, y0, y1)]
            worst = min(range(i | 1, j - 1, 2), key=lambda g: gain[g], default=-1)
            if worst > 0 and gain[worst] < 0:  # a stray seed at one end may keep the others from their words
                todo += [(i, worst, x0, x1, y0, y1), (worst + 1, j, x0, x1, y0, y1)]
    return sorted(set(out))


def _align_all(least: int, percent: int):
    """(id, other, x0, y0, xs, ys, hx, hy): hx and hy are words from x0 and y0 on."""

    def run(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                x0, y0 = batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
                xs, ys = (batch.column(c)[r].values.to_numpy() for c in (4, 5))
                hx, hy = (np.frombuffer(batch.column(c)[r].as_buffer(), np.uint32) for c in (6, 7))
                for a, b, c, d, equal in align(hx, hy, xs - x0, ys - y0, least, percent):
                    out.append((batch.column(0)[r].as_py(), a + x0, b + x0, batch.column(1)[r].as_py(), c + y0, d + y0, equal / max(b - a, d - c)))
            cols = list(zip(*out, strict=True)) if out else ([],) * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == 6 else pa.int64()) for n, c in enumerate(cols)], names=["id", "start", "end", "other", "other_start", "other_end", "identity"])

    return run


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """(id, start, end, other_id, other_start, other_end, identity): passages that id and other_id, the lesser, share.

    Passages of different texts are pairs of their least ids; any other row of such a text has a passage of its whole
    length with that least id.
    """
    if least < K:
        raise ValueError(f"least must be at least {K}")
    spark = df.sparkSession
    id_sql = dict(df.dtypes)[id_col]
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seeds = texts.select("text").mapInArrow(_seeds, "h bigint, sig bigint, pos int").repartition(parts, "h").sortWithinPartitions("h", "sig")
    few = stored(seeds.mapInArrow(_links(MATES, told=True), "id bigint, other bigint, pos int, other_pos int, reach int"), "passages-links")
    hot = few.where("pos < 0").select(F.col("id").alias("h"), F.ceil(F.col("other") / TILE).alias("tiles"))
    held = texts.select("text").mapInArrow(_contexts(marks(hot.select("h"))), "h bigint, sig bigint, pos int, ctx binary")
    tiles = stored(hot.where("tiles > 1"), "passages-tiles")
    t, u, one = F.pmod(F.hash("sig"), "tiles"), F.col("u"), F.lit(-1).cast("long")
    held = held.join(tiles, "h", "left").withColumn("u", F.explode(F.when(F.col("tiles").isNull(), F.array(one)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))))
    held = held.withColumn("t", F.coalesce(t, one)).select("h", F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), (F.col("t") > u).cast("int").alias("part"), "sig", "pos", "ctx")
    met_ = held.repartition(parts, "h", "a", "b").sortWithinPartitions("h", "a", "b", "sig").mapInArrow(_meet(MATES, min(least, LEAST), percent), "id bigint, other bigint, pos int, other_pos int, reach int")
    links = few.where("pos >= 0").union(met_)
    links = links.repartition(parts, "id", "other").sortWithinPartitions("id", "other", "pos", "other_pos")
    found = stored(links.mapInArrow(_chain(SPAN), "id bigint, other bigint, xs array<int>, ys array<int>"), "passages-chains")
    drop(few, tiles)

    arrays = texts.select("text").mapInArrow(_word_arrays(marks(found.select(F.col("id").alias("v")).union(found.select("other")).distinct())), "sig bigint, hashes binary")
    arrays = stored(arrays.groupBy("sig").agg(F.first("hashes").alias("hashes")), "passages-words")

    def cut(rows: DataFrame, key: str, at: str, start: str, out: str) -> DataFrame:
        """rows with the words of `key` from a little before its first seed to a little after its last."""
        first = F.greatest(F.lit(0), F.get(at, F.lit(0)) - ENDS)
        size = F.get(at, F.size(at) - 1) + K + ENDS - first
        held = arrays.select(F.col("sig").alias(key), F.col("hashes"))
        return rows.join(held, key).withColumn(start, first).withColumn(out, F.substring("hashes", F.lit(1) + first * 4, size * 4)).drop("hashes")

    rows = cut(cut(found, "id", "xs", "x0", "hx"), "other", "ys", "y0", "hy")
    out = rows.select("id", "other", "x0", "y0", "xs", "ys", "hx", "hy").mapInArrow(_align_all(least, percent), "id bigint, start bigint, end bigint, other bigint, other_start bigint, other_end bigint, identity double")
    out = stored(out.distinct(), "passages-found")
    drop(found, arrays)

    held = stored(texts.mapInArrow(_describe, f"id {id_sql}, sig bigint, n bigint"), "passages-texts").where(F.col("n") >= least)
    first = stored(held.groupBy("sig").agg(F.min("id").alias("first"), F.max("id").alias("last")), "passages-first")  # a table, so that a hot text's join can be split
    zero = F.lit(0).cast("long")
    copies = held.join(first.where("first <> last").select("sig", "first"), "sig").where("id <> first").select("id", zero.alias("start"), F.col("n").alias("end"), F.col("first").alias("other"), zero.alias("other_start"), F.col("n").alias("other_end"), F.lit(1.0).alias("identity")).distinct()
    for side in ("id", "other"):
        out = out.join(first.select(F.col("sig").alias(side), F.col("first").alias(f"{side}_first")), side).drop(side).withColumnRenamed(f"{side}_first", side)
    own, other = F.struct("id", "start", "end"), F.struct(F.col("other").alias("id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"))
    out = out.where("id <> other").select(F.greatest(own, other).alias("a"), F.least(own, other).alias("b"), "identity")
    out = out.select("a.id", "a.start", "a.end", F.col("b.id").alias("other"), F.col("b.start").alias("other_start"), F.col("b.end").alias("other_end"), "identity")
    return out.union(copies).select(F.col("id").alias(id_col), "start", "end", F.col("other").alias(f"other_{id_col}"), "other_start", "other_end", "identity")


def from_both_sides(passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """passages with a row for either document, so that all that a document repeats is under its own id."""
    sides = F.array(
        F.struct(*(F.col(c).alias(c) for c in passages.columns)),
        F.struct(F.col(f"other_{id_col}").alias(id_col), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col(id_col).alias(f"other_{id_col}"), F.col("start").alias("other_start"), F.col("end").alias("other_end"), "identity"),
    )
    return passages.select(F.inline(sides))


def _without(batches):
    """(..., text, spans) to (..., text, words removed): the words of the spans go, with the spaces before them."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        texts, spans = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        out, gone = [], []
        for text, own in zip(texts, spans, strict=True):
            drop = {w for s in own or () for w in range(s["start"], s["end"])}
            if drop:
                at, parts = 0, []
                for n, m in enumerate(word.finditer(text)):
                    if n not in drop:
                        parts.append(text[at : m.end()])
                    at = m.end()
                text = "".join([*parts, text[at:]])
            out.append(text)
            gone.append(len(drop))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string()), pa.array(gone, pa.int64())], names=[*batch.schema.names[:-1], "n_words_removed"])


def without_repeats(df: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df whose texts lack the passages that a document with a lesser id holds too, then n_words_removed."""
    spans = passages.where(F.col(f"other_{id_col}") < F.col(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))  # a text's own passages
    back = passages.where(F.col(f"other_{id_col}") > F.col(id_col)).select(F.col(f"other_{id_col}").alias("_id"), F.struct(F.col("other_start").alias("start"), F.col("other_end").alias("end")).alias("s")).groupBy("_id").agg(F.collect_set("s").alias("_back"))
    spans = spans.join(back, "_id", "full").select("_id", F.concat(F.coalesce("_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.coalesce("_back", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("_spans"))
    others = [c for c in df.columns if c != text_col]
    schema = df.select(*others, text_col).schema.add("n_words_removed", "long")
    return df.join(spans, F.col(id_col) == F.col("_id"), "left").select(*others, text_col, "_spans").mapInArrow(_without, schema).select(*df.columns, "n_words_removed")
