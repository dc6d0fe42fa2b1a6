"""Static list scheduling of task graphs on workers, and what is read off a schedule.

A graph is scheduled step by step, which is sequential; many graphs are scheduled in parallel, one group each. Ready
instructions are ordered by the time at which their last predecessor ends; of equal times, those that were ready before
come first, and of those that get ready together the one with the greater number. If all workers are busy no longer than
the first one's time, that one goes next; otherwise, of those whose time has come, the one with most successors. It
goes to the worker with the largest load that does not exceed its time, or else to the one with the smallest load. The
worker first waits for the last predecessor on each other worker, unless an earlier wait for that worker implies it.
"""

from __future__ import annotations

from bisect import insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "dag long, worker int, seq int, inst long, is_exec boolean, start_flops long"


def plan(flops: dict[int, int], edges: list[tuple[int, int]], workers: int, floor: int = 1) -> list[tuple[int, int, bool, int]]:
    """[(worker, inst, is_exec, start)] in the order of decisions. flops: cost of each instruction."""
    after = {v: [] for v in flops}
    before = {v: [] for v in flops}
    for a, b in sorted(edges):
        after[a].append(b)
        before[b].append(a)
    missing = {v: len(p) for v, p in before.items()}
    load, waited = [0] * workers, [[0] * workers for _ in range(workers)]
    ends, ran_on, out, ready, arrived = {}, {}, [], [], 0  # ready: sorted (time, arrival, instruction)
    free = [v for v in flops if not missing[v]]
    while free or ready:
        for v in sorted(free, reverse=True):
            insort(ready, (max((ends[p] for p in before[v]), default=0), arrived, v))
            arrived += 1
        due = [x for x in ready if x[0] <= min(load)]
        entry = max(due, key=lambda x: (len(after[x[2]]), -x[0], -x[1])) if due else ready[0]
        ready.remove(entry)
        time, _, inst = entry
        early = [w for w in range(workers) if load[w] <= time]
        mine = max(early, key=lambda w: (load[w], -w)) if early else min(range(workers), key=lambda w: (load[w], w))
        last = {}
        for p in before[inst]:
            if ran_on[p] not in last or ends[p] > ends[last[ran_on[p]]]:
                last[ran_on[p]] = p
        for other in sorted(last):
            end = ends[last[other]]
            if other != mine and end > waited[mine][other]:
                out.append((mine, last[other], False, load[mine]))
                load[mine], waited[mine][other] = max(load[mine], end), end
        out.append((mine, inst, True, load[mine]))
        load[mine] += max(flops[inst], floor)
        ends[inst], ran_on[inst] = load[mine], mine
        for v in after[inst]:
            missing[v] -= 1
        free = [v for v in after[inst] if not missing[v]]
    return out


def schedule(tasks: DataFrame, edges: DataFrame, workers: int, floor: int = 1) -> DataFrame:
    """Rows of SCHEMA. tasks: (dag, inst, flops); edges: (dag, inst_from, inst_to). One group for each graph."""
    import pandas as pd

    def run(key, t, e):
        rows = plan(dict(zip(t["inst"].tolist(), t["flops"].tolist(), strict=True)), list(zip(e["inst_from"].tolist(), e["inst_to"].tolist(), strict=True)), workers, floor)
        out = pd.DataFrame(rows, columns=["worker", "inst", "is_exec", "start_flops"])
        out["seq"] = out.groupby("worker").cumcount()
        out["dag"] = key[0]
        return out[["dag", "worker", "seq", "inst", "is_exec", "start_flops"]]

    return tasks.select("dag", "inst", "flops").groupBy("dag").cogroup(edges.select(F.col("dag").alias("dag"), "inst_from", "inst_to").groupBy("dag")).applyInPandas(run, SCHEMA)


def loads(sched: DataFrame, tasks: DataFrame, floor: int = 1) -> DataFrame:
    """(dag, worker, load): when each worker's last instruction ends."""
    done = sched.where("is_exec").join(tasks.select("dag", "inst", "flops"), ["dag", "inst"])
    return done.groupBy("dag", "worker").agg(F.max(F.col("start_flops") + F.greatest("flops", F.lit(floor))).cast("long").alias("load"))


def smallest_load(sched: DataFrame, tasks: DataFrame, workers: int, floor: int = 1) -> DataFrame:
    """(dag, load): the least load of all workers, 0 if one has no instruction."""
    x = loads(sched, tasks, floor).groupBy("dag").agg(F.min("load").alias("load"), F.count("*").alias("n"))
    return x.select("dag", F.when(F.col("n") < workers, 0).otherwise(F.col("load")).cast("long").alias("load"))


def summary(sched: DataFrame, tasks: DataFrame, workers: int, floor: int = 1) -> DataFrame:
    """(dag, instructions, heaviest_percent, utilisation_percent, waits_per_instruction)."""
    top = loads(sched, tasks, floor).groupBy("dag").agg(F.max("load").alias("top"))
    total = tasks.groupBy("dag").agg(F.sum(F.greatest("flops", F.lit(floor))).alias("total"), F.count("*").alias("instructions"))
    waits = sched.groupBy("dag").agg(F.sum(F.expr("int(not is_exec)")).alias("waits"))
    x = top.join(total, "dag").join(waits, "dag")
    return x.select("dag", "instructions", (100.0 * F.col("top") / F.col("total")).alias("heaviest_percent"), (100.0 * F.col("total") / F.col("top") / workers).alias("utilisation_percent"), (F.col("waits") / F.col("instructions")).alias("waits_per_instruction"))


def elapsed(sched: DataFrame) -> DataFrame:
    """sched with elapsed_flops: until the next entry of the same worker starts; null for the last."""
    w = Window.partitionBy("dag", "worker").orderBy("seq")
    return sched.withColumn("elapsed_flops", (F.lead("start_flops").over(w) - F.col("start_flops")).cast("long"))


def execution_list(sched: DataFrame) -> DataFrame:
    """(dag, worker, insts): what each worker executes, in order."""
    return sched.where("is_exec").groupBy("dag", "worker").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "inst"))), lambda x: x["inst"]).alias("insts"))


def lengths(sched: DataFrame, workers: int) -> DataFrame:
    """(worker, length): entries of every worker, 0 for one that has none."""
    all_ = sched.sparkSession.range(workers).select(F.col("id").cast("int").alias("worker"))
    return all_.join(sched.groupBy("worker").agg(F.count("*").alias("n")), "worker", "left").select("worker", F.coalesce("n", F.lit(0)).cast("long").alias("length"))
