"""Instruction streams: their words, and a machine that runs the streams of several workers on a memory of matrices.

An instruction is a list of numbers: opcode, signal, operation, operands. A wait is (opcode, signal, hint), and a stream
ends with the opcode for it alone. Memory is a table (m, pos, v): position pos of matrix m, row by row; an absent
position is 0. An operand is a view: a matrix, an offset, rows, columns and the distance between rows.

Workers run side by side. In a round each goes on until a wait for what another worker has not done before that round;
a job for each round gives every worker the cells that it reads and takes what it wrote. So the waits alone order the
work of different workers, and as many rounds are needed as waits depend on each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.interpreter import execute
from tessera.sources.matrices import stored

#: Opcodes and operations. Values of our own.
EXECUTE, SIGNAL_WAIT, FINISH = 0, 1, 2
OPERATIONS = {"nop": 0, "getrf": 1, "trsml": 2, "trsmr": 3, "gemm": 4, "gemm_plus": 5, "gemm_3x": 6, "gemm_4x": 7, "accum": 8}
#: Words of an instruction by operation. Fixed values.
LENGTHS = {"nop": 3, "getrf": 8, "trsml": 13, "trsmr": 13, "gemm": 17, "gemm_plus": 17, "gemm_3x": 23, "gemm_4x": 29, "accum": 21}
#: Operands, sizes and flags of an operation, which stand in this order: matrices, offsets, sizes, distances, flags, others. Fixed values.
LAYOUT = {"getrf": (1, 2, 0, 0), "trsml": (2, 3, 1, 0), "trsmr": (2, 3, 1, 0), "gemm": (3, 3, 2, 0), "gemm_plus": (3, 3, 2, 0), "gemm_3x": (4, 4, 3, 1), "gemm_4x": (5, 5, 4, 2), "accum": (4, 4, 0, 2)}
_NAMES = {v: k for k, v in OPERATIONS.items()}
STREAM = "worker int, seq int, words array<int>"


def decode(words: list[int]) -> tuple[str, list[tuple[int, int, int, int, int]], list[bool], int]:
    """(operation, views (matrix, offset, rows, columns, distance) with those written first, T flags, control)."""
    if words[2] not in _NAMES:
        raise ValueError(f"unknown operation {words[2]}")
    op = _NAMES[words[2]]
    if len(words) != LENGTHS[op]:
        raise ValueError(f"{op} has {LENGTHS[op]} words, not {len(words)}")
    if op == "nop":
        return op, [], [], 0
    n, n_sizes, n_flags, _ = LAYOUT[op]
    at, groups = 3, []
    for size in (n, n, n_sizes, n, n_flags):
        groups.append(words[at : at + size])
        at += size
    matrices, offsets, sizes, lds, flags = groups
    if op == "getrf":
        shapes = [(sizes[1], sizes[0])]
    elif op == "trsml":
        shapes = [(sizes[1], sizes[0]), (sizes[1], sizes[2])]
    elif op == "trsmr":
        shapes = [(sizes[0], sizes[1]) if flags[0] else (sizes[1], sizes[0]), (sizes[2], sizes[0])]
    elif op == "accum":
        (nx, ny, k1, k2) = sizes
        shapes = [(ny, k1), (nx, k1), (ny, k2), (nx, k2)]
    else:  # m, n, then what the products are summed over
        chain = [sizes[0], *sizes[2:], sizes[1]]
        shapes = [(sizes[0], sizes[1])] + [(b, a) if t else (a, b) for a, b, t in zip(chain, chain[1:], flags, strict=False)]
    return op, [(m, o, *s, ld) for m, o, s, ld in zip(matrices, offsets, shapes, lds, strict=True)], [bool(f) for f in flags], words[at] if at < len(words) else 0


def encode(signal: int, op: str, views=(), sizes=(), flags=(), control: int = 0) -> list[int]:
    """Words of an instruction. views: (matrix, offset, distance) of each operand."""
    head = [EXECUTE, signal, OPERATIONS[op]]
    if op == "nop":
        return head
    rest = [control, 0][: LAYOUT[op][3]] if op != "accum" else [0, 0]
    return [*head, *(v[0] for v in views), *(v[1] for v in views), *sizes, *(v[2] for v in views), *map(int, flags), *rest]


def lu_streams(sched: DataFrame, tasks: DataFrame, t: int, tile: int) -> DataFrame:
    """STREAM rows: each worker's instructions for tiled LU on matrix 0, with its waits and its end."""
    n = t * tile
    at = lambda i, j: (F.col(i) * tile * n + F.col(j) * tile).cast("int")
    z, s, ld = F.lit(0), F.lit(tile), F.lit(n)
    head = [F.lit(EXECUTE), F.col("inst").cast("int"), F.element_at(F.create_map(*[F.lit(x) for p in OPERATIONS.items() for x in p]), F.col("op"))]
    words = (
        F.when(F.col("op") == "getrf", F.array(*head, z, at("k", "k"), s, s, ld))
        .when(F.col("op") == "trsml", F.array(*head, z, z, at("k", "j"), at("k", "k"), s, s, s, ld, ld, z))
        .when(F.col("op") == "trsmr", F.array(*head, z, z, at("i", "k"), at("k", "k"), s, s, s, ld, ld, z))
        .otherwise(F.array(*head, z, z, z, at("i", "j"), at("i", "k"), at("k", "j"), s, s, s, ld, ld, ld, z, z))
    )
    x = sched.join(tasks.select("inst", "op", "k", "i", "j"), "inst")
    wait = F.array(F.lit(SIGNAL_WAIT), F.col("inst").cast("int"), F.lit(0))
    rows = x.select("worker", "seq", F.when(F.col("is_exec"), words).otherwise(wait).alias("words"))
    ends = sched.groupBy("worker").agg((F.max("seq") + 1).cast("int").alias("seq")).withColumn("words", F.array(F.lit(FINISH)))
    return rows.union(ends)


def rounds(streams: list[list[list[int]]]) -> list[list[tuple[int, int]]]:
    """For each round the (worker, place) of the instructions that run in it. Raises on a deadlock or a missing end."""
    at, known, out = [0] * len(streams), [set() for _ in streams], []
    done: set[int] = set()
    while any(at[w] < len(s) for w, s in enumerate(streams)):
        ran, new, moved = [], set(), False
        for w, s in enumerate(streams):
            while at[w] < len(s):
                words = s[at[w]]
                if words[0] == FINISH:
                    at[w], moved = len(s), True
                    break
                if words[0] == SIGNAL_WAIT:
                    if words[1] not in done and words[1] not in known[w]:
                        break
                elif words[0] == EXECUTE:
                    ran.append((w, at[w]))
                    known[w].add(words[1])
                    new.add(words[1])
                else:
                    raise ValueError(f"unknown opcode {words[0]}")
                at[w], moved = at[w] + 1, True
                if at[w] == len(s):
                    raise ValueError(f"the stream of worker {w} has no end")
        if not moved:
            raise ValueError("deadlock: every worker waits")
        done |= new
        if ran:
            out.append(ran)
    return out


def run(memory: DataFrame, streams: DataFrame) -> DataFrame:
    """memory (m int, pos long, v double) after the STREAM rows have run."""

    def planned(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [[list(map(int, x)) for x in g.sort_values("seq")["words"]] for _, g in pdf.groupby("worker", sort=True)]
        rows = []
        for n, ran in enumerate(rounds(own)):
            for w, p in ran:
                _, views, _, _ = decode(own[w][p])
                rows += [(n, w, p, own[w][p], *v) for v in views]
        return pd.DataFrame(rows, columns=["round", "worker", "place", "words", "m", "offset", "rows", "columns", "ld"])

    # One program's streams are replayed in one task, as they were scheduled in one; it makes a row for each operand.
    plan = stored(streams.withColumn("program", F.lit(0)).groupBy("program").applyInPandas(planned, "round int, worker int, place int, words array<int>, m int, offset long, rows long, columns long, ld long"), "machine-plan")
    memory, last = stored(memory.select(F.col("m").cast("int"), F.col("pos").cast("long"), F.col("v").cast("double")), "memory"), plan.agg(F.max("round")).first()[0]

    def work(key, program: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        held = {m: g.sort_values("pos") for m, g in cells.groupby("m")}
        place = {m: g["pos"].to_numpy() for m, g in held.items()}
        value = {m: g["v"].to_numpy().copy() for m, g in held.items()}
        wrote = {m: np.zeros(len(p), bool) for m, p in place.items()}
        for words in program.sort_values("place")["words"]:
            op, views, flags, control = decode(list(map(int, words)))
            at = [(m, np.searchsorted(place[m], o + np.arange(r)[:, None] * ld + np.arange(c)[None, :])) for m, o, r, c, ld in views]
            new = execute(op, *[value[m][x] for m, x in at], flags=flags, control=control)
            for (m, x), v in zip(at, new if isinstance(new, tuple) else (new,), strict=False):
                value[m][x], wrote[m][x] = v, True
        out = [pd.DataFrame({"m": m, "pos": place[m][w], "v": value[m][w]}) for m, w in wrote.items() if w.any()]
        return pd.concat(out) if out else pd.DataFrame({"m": [], "pos": [], "v": []})

    for n in range(0 if last is None else last + 1):
        now = plan.where(F.col("round") == n)
        line = now.select("worker", "m", "columns", "offset", "ld", F.explode(F.expr("sequence(0L, rows - 1)")).alias("r"))
        needs = line.select("worker", "m", F.explode(F.expr("sequence(offset + r * ld, offset + r * ld + columns - 1)")).alias("pos")).distinct()
        cells = needs.join(memory, ["m", "pos"], "left").select("worker", "m", "pos", F.coalesce("v", F.lit(0.0))).toDF("reader", "m", "pos", "v")
        program = now.select("worker", "place", "words").distinct().toDF("runner", "place", "words")
        new = stored(program.groupBy("runner").cogroup(cells.groupBy("reader")).applyInPandas(work, "m int, pos long, v double"), "machine-wrote")
        memory = memory.join(new.select("m", "pos"), ["m", "pos"], "left_anti").union(new)
        if n % 8 == 7:
            memory = stored(memory, "memory")
    return memory
