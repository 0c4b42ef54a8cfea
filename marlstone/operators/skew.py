"""Per-key work without imbalance: fragment-replicate by estimated load.

A first, column-pruned pass counts the rows of each key. Keys above a load limit are cut
into proportionate shards; all other keys are hashed into buckets whose loads are known as
well. Shards and buckets are then packed onto tasks, largest first. Rows travel to their
task by number; a matching side is replicated only to the shards of the keys it matches.

Null keys are one ordinary group in aggregates and never match in joins. Empty tables give
empty results. Columns may have any names: helper columns start with ``_fr_``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

#: A key is heavy above 1 / (FINENESS * tasks) of all rows, so there are fewer than FINENESS * tasks of them.
FINENESS = 4
#: Hash buckets of light keys per task.
BUCKETS = 8
#: A key of a table with one row per key is frequent above 1 / FREQUENT of the rows that it joins.
FREQUENT = 4000


@dataclass(frozen=True)
class ShardPlan:
    """Where the rows of each key go. ``heavy`` maps a key (as text) to its shard count and tasks."""

    tasks: int
    heavy: dict[str, list[int]] = field(default_factory=dict)
    buckets: list[int] = field(default_factory=lambda: [0])
    loads: list[int] = field(default_factory=list)

    def shards_of(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with ``_fr_tasks``: the tasks of each shard of a heavy key, null for light keys.

        The plan travels as a table of fewer than ``FINENESS * tasks`` rows, not inside the expression.
        """
        spark = df.sparkSession
        heavy = spark.createDataFrame(list(self.heavy.items()), "_fr_key string, _fr_tasks array<int>")
        return df.withColumn("_fr_key", _text(F.col(key))).join(F.broadcast(heavy), "_fr_key", "left").drop("_fr_key")

    def tasks_of(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` (with ``_fr_tasks`` and ``_fr_shard``) with the number of each row's task; buckets travel as a table."""
        buckets = df.sparkSession.createDataFrame(list(enumerate(self.buckets)), "_fr_bucket int, _fr_light int")
        bucket = F.pmod(F.xxhash64(_text(F.col(key))), F.lit(len(self.buckets))).cast("int")
        joined = df.withColumn("_fr_bucket", bucket).join(F.broadcast(buckets), "_fr_bucket")
        return joined.withColumn("_fr_task", F.coalesce(F.get("_fr_tasks", F.col("_fr_shard")), F.col("_fr_light"))).drop("_fr_bucket", "_fr_light", "_fr_tasks")


def _text(key: Column) -> Column:
    """The key as text, with a text of its own for null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def _parts() -> Column:
    """Number of shards of a key: 1 unless it is heavy."""
    return F.when(F.col("_fr_tasks").isNull(), 1).otherwise(F.size("_fr_tasks"))


def pack(loads: list[int], tasks: int) -> list[int]:
    """Task of each item, largest load first onto the least loaded task (ties: lowest number)."""
    heap, out = [(0, t) for t in range(tasks)], [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, task = heapq.heappop(heap)
        out[i] = task
        heapq.heappush(heap, (load + loads[i], task))
    return out


def plan_shards(df: DataFrame, key: str, tasks: int | None = None) -> ShardPlan:
    """Count rows by key and pack keys onto ``tasks`` tasks.

    The driver receives only heavy keys (fewer than ``FINENESS * tasks``) and one load per
    bucket (``BUCKETS * tasks``), whatever the number of rows or keys.
    """
    spark = df.sparkSession
    tasks = tasks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_buckets = BUCKETS * tasks
    counts = df.groupBy(_text(F.col(key)).alias("_fr_key")).agg(F.count(F.lit(1)).alias("_fr_n"))
    bucket = F.pmod(F.xxhash64("_fr_key"), F.lit(n_buckets)).cast("int")
    # Two levels of grouping, both pre-aggregated: keys of a bucket, then totals. The count reads no column.
    total = df.count()
    limit = total / (FINENESS * tasks)
    is_heavy = F.col("_fr_n") > F.lit(limit)
    rows = (
        counts.groupBy(F.when(is_heavy, F.col("_fr_key")).alias("k"), F.when(is_heavy, F.lit(-1)).otherwise(bucket).alias("b"))
        .agg(F.sum("_fr_n").alias("n"))
        .collect()
    )
    heavy = sorted((r["k"], r["n"]) for r in rows if r["b"] < 0)
    light = {r["b"]: r["n"] for r in rows if r["b"] >= 0}
    share = max(1, int(total / (2 * tasks)))
    items: list[tuple[str | None, int, int]] = []
    for k, n in heavy:
        parts = -(-n // share)
        items += [(k, s, -(-n // parts)) for s in range(parts)]
    items += [(None, b, light.get(b, 0)) for b in range(n_buckets)]
    placed = pack([x[2] for x in items], tasks)
    out: dict[str, list[int]] = {k: [] for k, _ in heavy}
    buckets, loads = [0] * n_buckets, [0] * tasks
    for (k, at, n), task in zip(items, placed):
        loads[task] += n
        if k is None:
            buckets[at] = task
        else:
            out[k].append(task)
    return ShardPlan(tasks, out, buckets, loads)


def route(df: DataFrame, key: str, plan: ShardPlan, spread_by: list[str]) -> DataFrame:
    """``df`` with ``_fr_shard`` and each row in the task that the plan gives to its shard.

    Rows of a heavy key are divided by the hash of ``spread_by``, so equal values of these
    columns meet in one shard.
    """
    shard = F.pmod(F.xxhash64(*spread_by), _parts()).cast("int")
    routed = plan.tasks_of(plan.shards_of(df, key).withColumn("_fr_shard", shard), key)
    return routed.select(*df.columns, "_fr_shard", "_fr_task").repartitionById(plan.tasks, F.col("_fr_task"))


def balanced_stats(df: DataFrame, key: str, member: str, measures: dict[str, str], tasks: int | None = None) -> DataFrame:
    """Rows, distinct members and measures of each key, as ``key, n_rows, n_members, shards`` and measures.

    ``measures`` maps an output column to ``mean:column``, ``min:column`` or ``max:column``.
    Repeated rows of one member are combined before they are routed, so neither a hot key
    nor a hot member loads one task. Null members count as rows, not as members.
    """
    parts = [(out, *how.split(":")) for out, how in measures.items()]
    first = [F.count(F.lit(1)).alias("_fr_n")]
    again = [F.sum("_fr_n").alias("_fr_n"), F.count(member).alias("_fr_m")]
    last = [F.sum("_fr_n").alias("n_rows"), F.sum("_fr_m").alias("n_members"), F.count(F.lit(1)).cast("int").alias("shards")]
    for out, how, col in parts:
        if how == "mean":
            first += [F.sum(F.col(col).cast("double")).alias(f"_fr_s_{out}"), F.count(col).alias(f"_fr_c_{out}")]
            again += [F.sum(f"_fr_{x}_{out}").alias(f"_fr_{x}_{out}") for x in "sc"]
            last.append((F.sum(f"_fr_s_{out}") / F.nullif(F.sum(f"_fr_c_{out}"), F.lit(0))).alias(out))
        else:
            fn = {"min": F.min, "max": F.max}[how]
            first.append(fn(col).alias(f"_fr_x_{out}"))
            again.append(fn(f"_fr_x_{out}").alias(f"_fr_x_{out}"))
            last.append(fn(f"_fr_x_{out}").alias(out))
    plan = plan_shards(df.select(key), key, tasks)
    members = df.groupBy(key, member).agg(*first)
    routed = route(members, key, plan, [member])
    shards = routed.groupBy("_fr_task", "_fr_shard", key).agg(*again)
    return shards.groupBy(key).agg(*last)


def balanced_join(left: DataFrame, right: DataFrame, key: str, spread_by: list[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Equi join on ``key`` (inner or left): rows of heavy left keys spread over shards, ``right`` copied to those shards only."""
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    plan = plan_shards(left.select(key), key, tasks)
    taken = {c.lower() for c in left.columns} - {key.lower()}
    for c in right.columns:
        if c.lower() in taken:
            right = right.withColumnRenamed(c, f"right_{c}")
    fragments = route(left, key, plan, spread_by)
    copies = plan.shards_of(right, key).withColumn("_fr_shard", F.explode(F.sequence(F.lit(0), _parts() - 1)))
    copies = plan.tasks_of(copies, key).select(*right.columns, "_fr_shard", "_fr_task").repartitionById(plan.tasks, F.col("_fr_task"))
    return fragments.join(copies, ["_fr_task", "_fr_shard", key], how).drop("_fr_task", "_fr_shard")


def split_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join with a table of one row per key, whose ``weight`` is the number of left rows of the key.

    Keys with more than 1 / ``FREQUENT`` of ``total`` left rows, of which there are fewer than
    ``FREQUENT``, are broadcast; all others are shuffled, so no task gets more than that share of a key.
    """
    often = right.filter(F.col(weight) > F.lit(total / FREQUENT))
    seldom = right.filter(F.col(weight) <= F.lit(total / FREQUENT))
    rest = left.join(F.broadcast(often.select(key)), key, "left_anti")
    return left.join(F.broadcast(often), key).unionByName(rest.join(seldom, key))


def heavy_keys(stats: DataFrame, key: str, share: float) -> DataFrame:
    """Keys of ``balanced_stats`` that hold at least ``share`` of all rows; null is no key.

    The statistics, one row per key, are written once and read for the total and for the keys.
    """
    stats = cut(stats, "key_stats")
    total = stats.agg(F.sum("n_rows").alias("_fr_total"))
    return stats.join(F.broadcast(total), F.col("n_rows") >= F.lit(share) * F.col("_fr_total")).drop("_fr_total").filter(F.col(key).isNotNull())


def community_key(name: Column) -> Column:
    """A subreddit as it is compared: lower case, no outer blanks, no leading ``r/`` or ``/r/``."""
    blank = r"[\s\p{Z}\p{Cf}]+"
    trimmed = F.regexp_replace(F.lower(name), f"^{blank}|{blank}$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, "^/?r/", ""), f"^{blank}", "")
