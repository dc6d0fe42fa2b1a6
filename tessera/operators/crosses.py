"""What a task does with the blocks of a kernel's matrix that it holds: crosses of alike blocks together, as arrays.

A batch has rows (left, right, blocks): the points of two nodes as arrays of (at, id, x, ...) in the order of leaves, and
the blocks (a, b, low, a_lo, a_hi, b_lo, b_hi) of their descendants, whose points lie from lo to hi in that order. Blocks
with about equally many points are padded to one size and take their steps together. Coordinates are an array's first axis.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINTS = 1 << 16  # padded points of both sides that are worked on together; one block may have more
CELLS = 1 << 20  # cells that are formed at a time
CALM = 3  # small crosses in a row that end a block


def side(column) -> tuple[np.ndarray, pa.StructArray, np.ndarray]:
    """(where each row's points start, all points, their coordinates) of a column of arrays of points."""
    points = column.values
    x = points.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)
    return column.offsets.to_numpy(), points, np.ascontiguousarray(x.T)


def opened(batch) -> tuple:
    """(left, right, blocks): both sides, and (a, b, low, start and number of points on the left, on the right) of all blocks."""
    left, right = side(batch.column("left")), side(batch.column("right"))
    offsets, held = batch.column("blocks").offsets.to_numpy(), batch.column("blocks").values
    field = lambda name: held.field(name).to_numpy(zero_copy_only=False)
    out = [field("a"), field("b"), field("low")]
    for name, (starts, points, _) in (("a", left), ("b", right)):
        at, lo, hi = points.field("at").to_numpy(), field(f"{name}_lo"), field(f"{name}_hi")
        start, end = np.zeros((2, len(lo)), np.int64)
        for r in range(batch.num_rows):
            mine, own = slice(offsets[r], offsets[r + 1]), at[starts[r] : starts[r + 1]]
            start[mine] = starts[r] + np.searchsorted(own, lo[mine])
            end[mine] = starts[r] + np.searchsorted(own, hi[mine], "right")
        out += [start, end - start]
    return left, right, out


def alike(which: np.ndarray, n: np.ndarray, m: np.ndarray, size):
    """Parts of which, blocks with n by m points: of about equal n and of about equal m, and no more than fit."""
    level = lambda k: np.ceil(np.log2(k[which]) * 4).astype(np.int64)
    kind = level(n) * 1000 + level(m)
    order = np.argsort(kind, kind="stable")
    for part in np.split(which[order], np.flatnonzero(np.diff(kind[order])) + 1) if len(which) else ():
        step = max(1, size(n[part].max(), m[part].max()))
        for k in range(0, len(part), step):
            yield part[k : k + step]


def padded(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of each block's points, the last one repeated; which aren't repeats)."""
    k = np.arange(n.max())
    return start[:, None] + np.minimum(k, n[:, None] - 1), k < n[:, None]


def crosses(kernel, x: np.ndarray, z: np.ndarray, real: np.ndarray, there: np.ndarray, eps: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, rank): factors (block, cross, point) of blocks by the kernel of x, their rows' points, and z, their columns'."""
    every = np.arange(len(real))
    u, v = np.zeros((len(every), most, real.shape[1])), np.zeros((len(every), most, there.shape[1]))
    norm2, calm, rank, p, done = np.zeros(len(every)), np.zeros_like(every), np.zeros_like(every), np.zeros_like(every), np.zeros(len(every), bool)
    near = np.where(real, np.inf, 0.0)
    left = lambda cells, f, mine: cells - (f[:, None, :] @ mine)[:, 0]
    for k in range(most + 1):
        if done.all():
            break
        if k == most:
            raise ArithmeticError(f"a block needs over {most} crosses")
        px = x[:, every, p][..., None]
        r = np.where(there, left(kernel(px, z), u[every, :k, p], v[:, :k]), 0.0)
        q = np.abs(r).argmax(1)
        qr = r[every, q]
        alive = ~done & ~(np.abs(qr) <= 1e-300)
        c = left(kernel(x, z[:, every, q][..., None]), v[every, :k, q], u[:, :k])
        v[alive, k] = r[alive] / qr[alive, None]
        u[alive, k] = np.where(real[alive], c[alive], 0.0)
        near = np.minimum(near, ((x - px) ** 2).sum(0))
        du, dv = ((f[:, : k + 1] @ f[:, k, :, None])[..., 0] for f in (u, v))
        cross = du[:, k] * dv[:, k]
        norm2 += 2 * (du[:, :k] * dv[:, :k]).sum(1) + cross
        calm = np.where(cross > eps * eps * norm2, 0, calm + 1)
        rank += ~done
        unused = near > 0
        p = np.where(calm > 0, near.argmax(1), np.where(unused, np.abs(u[:, k]), -1.0).argmax(1))
        done |= ~unused.any(1) | (calm >= CALM)
    return u, v, rank


def _low(sides, blocks, kernel, eps: float, most: int):
    """(part of the admissible blocks, padded positions and real ones of both sides, u, v, rank)."""
    (_, _, x), (_, _, z) = sides
    _, _, low, i, n, j, m = blocks
    for part in alike(np.flatnonzero(low), n, m, lambda a, b: POINTS // (a + b)):
        (rows, real), (cols, there) = padded(i[part], n[part]), padded(j[part], m[part])
        yield part, rows, real, cols, there, *crosses(kernel, x[:, rows], z[:, cols], real, there, eps, most)


def factors(kernel, eps: float, most: int):
    """Rows (a, b, side, id, f) of the factors of admissible blocks."""

    def run(batches):
        for batch in batches:
            *sides, blocks = opened(batch)
            for part, rows, real, cols, there, u, v, rank in _low(sides, blocks, kernel, eps, most):
                for k, (at, mine, f) in enumerate(((rows, real, u), (cols, there, v))):
                    of, _ = np.nonzero(mine)  # block by block
                    ends = np.concatenate([[0], np.cumsum(rank[of])])
                    held = np.arange(f.shape[1]) < rank[:, None]
                    values = f.transpose(0, 2, 1)[mine][held[of]]
                    ids = sides[k][1].field("id").take(pa.array(at[mine]))
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[0][part][of]), pa.array(blocks[1][part][of]), pa.array(np.full(len(of), k, np.int32)), ids, lists], names=["a", "b", "side", "id", "f"])

    return run


def products(kernel, eps: float, most: int):
    """Rows (id, y, off, whole): each left point's share of the product with w, and for tested ones how far the crosses'
    cells are from the kernel's, and these cells, as sums of squares."""

    def run(batches):
        for batch in batches:
            *sides, blocks = opened(batch)
            (_, points, x), (_, others, z) = sides
            _, _, low, i, n, j, m = blocks
            w, tested = others.field("w").to_numpy(), points.field("tested").to_numpy(zero_copy_only=False)
            y, off, whole = np.zeros((3, len(points)))
            for _, rows, real, cols, there, u, v, _ in _low(sides, blocks, kernel, eps, most):
                t = v @ np.where(there, w[cols], 0.0)[..., None]
                np.add.at(y, rows[real], (t.transpose(0, 2, 1) @ u)[:, 0][real])
                asked = real & tested[rows]
                for k in np.flatnonzero(asked.any(1)):
                    mine, theirs, mates = np.flatnonzero(asked[k]), cols[k][there[k]], v[k][:, there[k]]
                    for some in np.array_split(mine, -(-len(mine) * len(theirs) // CELLS)):
                        at = rows[k][some]
                        cells = kernel(x[:, at][..., None], z[:, None, theirs])
                        off[at] += ((u[k][:, some].T @ mates - cells) ** 2).sum(1)
                        whole[at] += (cells * cells).sum(1)
            near = np.flatnonzero(~low)
            if len(near):  # cut to sides of a root of CELLS at most: sums are by point
                edge = int(CELLS**0.5)
                down, over = -(-n[near] // edge), -(-m[near] // edge)
                of = np.repeat(near, down * over)
                k = np.arange(len(of)) - np.repeat(np.cumsum(down * over) - down * over, down * over)
                r, c = k // np.repeat(over, down * over) * edge, k % np.repeat(over, down * over) * edge
                ii, jj, nn, mm = i[of] + r, j[of] + c, np.minimum(n[of] - r, edge), np.minimum(m[of] - c, edge)
                for part in alike(np.arange(len(of)), nn, mm, lambda a, b: CELLS // (a * b)):
                    (rows, real), (cols, there) = padded(ii[part], nn[part]), padded(jj[part], mm[part])
                    cells = kernel(x[:, rows][..., None], z[:, cols][:, :, None, :])
                    np.add.at(y, rows[real], (cells @ np.where(there, w[cols], 0.0)[..., None])[..., 0][real])
            yield pa.RecordBatch.from_arrays([points.field("id"), pa.array(y), pa.array(off), pa.array(whole)], names=["id", "y", "off", "whole"])

    return run


def plain(kernel):
    """Rows (id, want, size): of points on the left, the kernel times w summed over points on the right, and its amounts."""

    def run(batches):
        for batch in batches:
            (starts, points, x), (ends, others, z) = side(batch.column("left")), side(batch.column("right"))
            w = others.field("w").to_numpy()
            for r in range(batch.num_rows):
                theirs = slice(ends[r], ends[r + 1])
                at = np.arange(starts[r], starts[r + 1])
                want, size = np.zeros((2, len(at)))
                for some in np.array_split(np.arange(len(at)), max(1, -(-len(at) * (ends[r + 1] - ends[r]) * 8 // CELLS))):
                    cells = kernel(x[:, at[some]][..., None], z[:, None, theirs])
                    want[some], size[some] = cells @ w[theirs], np.abs(cells) @ np.abs(w[theirs])
                yield pa.RecordBatch.from_arrays([points.field("id").take(pa.array(at)), pa.array(want), pa.array(size)], names=["id", "want", "size"])

    return run
