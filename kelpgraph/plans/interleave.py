"""Interleavings of threads that take and release locks: all of them, or seeded random ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import save


def findings(atoms: DataFrame, most_states: int = 10_000) -> DataFrame:
    """finding, witness: states in which threads are left but none can move (DEADLOCK_RISK), ends that hold a lock
    (RESOURCE_LEAK), or TRUNCATED.

    atoms: thread, pos, op, arg of one program, at most four threads by definition. A state is each thread's place and
    each lock's holder; a level of the search is a join of the frontier with the operations and an anti-join with the
    states seen.
    """
    program = atoms.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("pos", "op", "arg"))).alias("ops")).orderBy("thread").collect()
    if len(program) > 4:
        raise ValueError("at most four threads")
    spark = atoms.sparkSession
    ops = [[(o.op, o.arg) for o in r.ops] for r in program]
    names = [r.thread for r in program]

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for places, held, witness in zip(frame.places, frame.held, frame.witness, strict=True):
                at, locks, moved = [int(x) for x in places.split(",")], dict(x.split("=") for x in held.split(";") if x), False
                for t, mine in enumerate(ops):
                    if at[t] >= len(mine):
                        continue
                    op, arg = mine[at[t]]
                    if op == "ACQ" and locks.get(arg, names[t]) != names[t]:
                        continue
                    moved = True
                    new = locks | {arg: names[t]} if op == "ACQ" else {k: v for k, v in locks.items() if not (op == "REL" and k == arg)}
                    out.append((",".join(str(x + (k == t)) for k, x in enumerate(at)), ";".join(f"{k}={v}" for k, v in sorted(new.items())), f"{witness} {names[t]}:{op}({arg})".strip(), None))
                if not moved:
                    done = all(x >= len(mine) for x, mine in zip(at, ops, strict=True))
                    out.append((places, held, witness, ("RESOURCE_LEAK" if held else "OK") if done else "DEADLOCK_RISK"))
            yield pd.DataFrame(out, columns=["places", "held", "witness", "finding"])

    schema = "places string, held string, witness string, finding string"
    frontier = spark.createDataFrame([(",".join("0" for _ in names), "", "")], "places string, held string, witness string")
    seen, found, total = frontier.select("places", "held"), None, 0
    while True:
        moved = save(frontier.mapInPandas(step, schema))
        stops = moved.where("finding in ('DEADLOCK_RISK', 'RESOURCE_LEAK')").select("finding", "witness")
        found = stops if found is None else found.unionByName(stops)
        new = moved.where("finding is null").groupBy("places", "held").agg(F.min("witness").alias("witness")).join(seen, ["places", "held"], "left_anti")
        frontier = save(new)
        number = frontier.count()
        total += number
        if not number:
            return found.distinct()
        if total > most_states:
            return found.distinct().unionByName(spark.createDataFrame([("TRUNCATED", "")], "finding string, witness string"))
        seen = save(seen.unionByName(frontier.select("places", "held")))


def simulate(spark: SparkSession, atoms: list[tuple[str, str, str]], runs: int = 1000, seed: int = 1) -> DataFrame:
    """outcome, runs, risk of seeded random schedules; a run's seed is its number, so results don't depend on tasks."""
    threads = sorted({t for t, _, _ in atoms})
    ops = {t: [(o, a) for x, o, a in atoms if x == t] for t in threads}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ident in frame.id:
                rng, at, locks = np.random.default_rng([seed, int(ident)]), dict.fromkeys(threads, 0), {}
                while True:
                    ready = [t for t in threads if at[t] < len(ops[t]) and not (ops[t][at[t]][0] == "ACQ" and locks.get(ops[t][at[t]][1], t) != t)]
                    if not ready:
                        out.append("finished" if all(at[t] == len(ops[t]) for t in threads) else "deadlock")
                        break
                    t = ready[rng.integers(len(ready))]
                    op, arg = ops[t][at[t]]
                    if op == "ACQ":
                        locks[arg] = t
                    elif op == "REL":
                        locks.pop(arg, None)
                    at[t] += 1
            yield pd.DataFrame({"outcome": out})

    done = spark.range(runs).mapInPandas(run, "outcome string").groupBy("outcome").agg(F.count(F.lit(1)).alias("runs"))
    return done.withColumn("risk", F.round(F.when(F.col("outcome") == "deadlock", F.col("runs") / runs).otherwise(0.0), 6))
