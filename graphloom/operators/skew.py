"""Per-key joins and results when a handful of keys holds most rows.

Fragment and replicate by load: the loads of keys are estimated from a sample (all rows, if they are few); keys above a
fair share of a task are split into shards in proportion to their load, all shards are packed onto tasks (longest first,
each onto the task with the least so far), light keys are spread by their hash over tasks in proportion to the room left.
Rows go straight to their task (``repartitionById``), the only shuffle of all rows; the matching side's rows of a split
key are replicated to just the tasks that hold its shards. A task's results are final for light keys; those of the
shards of a heavy key are merged at the end. The estimates only decide where rows go: results are exact whatever they are.

Only heavy keys reach the driver, and there can be at most ``tasks / FAIR`` of them, whatever the data.
Defined cases: a null in a key is a value like another; an empty side gives an empty result; repeated rows count each;
rows are dealt to shards by a hash of all their columns and their place in the scan, so that copies spread too and a
repeated task deals them alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy from this part of a task's fair load.
FAIR = 0.25
#: Rows of the sample for each key that could be heavy; and its least size.
SAMPLE_KEY, SAMPLE_LEAST = 100, 200_000


def key_loads(rows: DataFrame, keys: Sequence[str], total: int, tasks: int, seed: int = 11) -> DataFrame:
    """``keys, load``: rows of each key as a sample of them has it, combined before the shuffle."""
    part = min(1.0, max(SAMPLE_LEAST, SAMPLE_KEY * tasks / FAIR) / max(total, 1))
    some = rows.select(*keys)
    some = some if part == 1 else some.sample(part, seed)
    return some.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(part)).cast("long").alias("load"))


def plan_shards(heavy: list[tuple[tuple, int]], total: int, tasks: int) -> tuple[dict[tuple, list[int]], list[int]]:
    """Tasks of each heavy key's shards, and slots for light keys: task numbers, repeated by the room left there."""
    fair = max(1.0, total / tasks)
    pieces = sorted(((load / (n := max(1, round(load / fair))), key) for key, load in heavy for _ in range(max(1, round(load / fair)))), key=lambda x: (-x[0], str(x[1])))
    room = [(0.0, t) for t in range(tasks)]
    placed: dict[tuple, list[int]] = {}
    load = [0.0] * tasks
    for size, key in pieces:
        now, t = heapq.heappop(room)
        placed.setdefault(key, []).append(t)
        load[t] = now + size
        heapq.heappush(room, (load[t], t))
    light = max(0.0, total - sum(n for _, n in heavy))
    level = _fill(load, light)
    slots = [t for t in range(tasks) for _ in range(round(max(0.0, level - load[t]) / fair * 16))]
    return placed, slots or list(range(tasks))


def _fill(load: list[float], amount: float) -> float:
    """The level to which ``amount`` fills the tasks that are below it."""
    filled = 0.0
    for n, x in enumerate(sorted(load)[1:], 1):
        step = (x - sorted(load)[n - 1]) * n
        if filled + step >= amount:
            return sorted(load)[n - 1] + (amount - filled) / n
        filled += step
    return max(load) + (amount - filled) / len(load)


class SkewPlan:
    """Where the rows of each key go."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], tasks: int | None = None, loads: DataFrame | None = None):
        self.keys = tuple(keys)
        spark = rows.sparkSession
        self.tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        self.total = rows.count() if loads is None else loads.agg(F.sum("load")).first()[0] or 0
        loads = key_loads(rows, keys, self.total, self.tasks) if loads is None else loads
        least = max(2, int(FAIR * self.total / self.tasks))
        found = loads.filter(F.col("load") >= least).collect()  # about tasks / FAIR rows at most
        self.heavy = [(tuple(r[k] for k in self.keys), r["load"]) for r in found]
        self.placed, self.slots = plan_shards(self.heavy, self.total, self.tasks)

    def _placed(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``df`` with ``_tasks``, the tasks of the row's key if it is heavy, else null. The table of heavy keys has at
        most ``tasks / FAIR`` rows, so it is broadcast."""
        if not self.placed:
            return df.withColumn("_tasks", F.lit(None).cast("array<int>"))
        fields = [T.StructField(f"_h{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        heavy = df.sparkSession.createDataFrame([(*k, v) for k, v in self.placed.items()], T.StructType([*fields, T.StructField("_tasks", T.ArrayType(T.IntegerType()))]))
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
        return df.join(F.broadcast(heavy), on, "left").drop(*[f"_h{i}" for i in range(len(keys))])

    def _light(self, keys: Sequence[str]) -> Column:
        slots = F.array(*map(F.lit, self.slots))
        return F.element_at(slots, (F.pmod(F.xxhash64(*keys), F.lit(len(self.slots))) + 1).cast("int"))

    def place(self, rows: DataFrame) -> DataFrame:
        """The rows with the number of their task, ``_task``, and whether their key is split; nothing is moved."""
        dealt = self._placed(rows.withColumn("_salt", F.xxhash64(*rows.columns, F.monotonically_increasing_id())), self.keys)
        shard = F.element_at("_tasks", (F.pmod("_salt", F.size("_tasks")) + 1).cast("int"))
        at = dealt.withColumn("_task", F.when(F.col("_tasks").isNull(), self._light(self.keys)).otherwise(shard)).withColumn("_heavy", F.col("_tasks").isNotNull())
        return at.drop("_tasks", "_salt")

    def spread(self, rows: DataFrame) -> DataFrame:
        """The rows on their tasks."""
        return self.place(rows).repartitionById(self.tasks, F.col("_task"))

    def replicate(self, other: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The matching side, one copy for each task that holds rows of the key."""
        at = self._placed(other, keys)
        tasks = F.coalesce(F.array_distinct("_tasks"), F.array(self._light(keys)))
        return at.withColumn("_task", F.explode(tasks)).drop("_tasks").repartitionById(self.tasks, F.col("_task"))


def skew_join(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner", tasks: int | None = None, plan: SkewPlan | None = None) -> DataFrame:
    """Join on equal ``keys`` (null equals null) without overloaded tasks; ``how`` is inner, left or left_semi.
    Columns of ``other`` that ``rows`` has too are dropped."""
    plan = plan or SkewPlan(rows, keys, tasks)
    right = other.select(*keys, *[c for c in other.columns if c not in rows.columns])
    a, b = plan.spread(rows), plan.replicate(right, keys)
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_task").alias("_k_task"), *[c for c in right.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col("_task") == F.col("_k_task"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]])
    return a.join(b, on, how).drop("_heavy", "_task", "_k_task", *[f"_k_{k}" for k in keys])


def results_per_key(rows: DataFrame, keys: Sequence[str], distinct: str | None = None, plan: SkewPlan | None = None) -> DataFrame:
    """``keys, n_rows[, n_distinct], shards``: results of the shards on their tasks; only those of heavy keys are merged,
    a few rows for each.

    Distinct values are first made unique by value, so that a heavy key's values are spread as well.
    """
    plan = plan or SkewPlan(rows, keys)
    partial = plan.spread(rows.select(*keys)).groupBy("_task", "_heavy", *keys).agg(F.count(F.lit(1)).alias("n_rows"))
    light = partial.filter("NOT _heavy").select(*keys, "n_rows", F.lit(1).cast("long").alias("shards"))
    merged = light.unionByName(partial.filter("_heavy").groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("shards")))
    if distinct:
        own = rows.select(*keys, distinct).distinct().groupBy(*keys).agg(F.count(distinct).alias("n_distinct"))
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        own = own.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n_distinct")
        merged = merged.join(own, on).drop(*[f"_k_{k}" for k in keys])
    return merged


def dominant_keys(rows: DataFrame, keys: Sequence[str], share: float = 0.01) -> DataFrame:
    """``keys, n_rows, share``: keys with at least ``share`` of all rows, from the balanced per-key results."""
    plan = SkewPlan(rows, keys)
    found = results_per_key(rows, keys, plan=plan)
    return found.filter(F.col("n_rows") >= share * plan.total).select(*keys, "n_rows", (F.col("n_rows") / F.lit(max(plan.total, 1))).alias("share"))
