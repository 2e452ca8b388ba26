"""Order statistics on range partitions: positions, ranks and exact quantiles.

Sequential numbering and exact percentiles are usually written as a window
per group (``row_number``) or a per-group aggregate that holds the group's
values (``percentile``).  Both put a whole group into one task.  Here the
rows are range-sorted on (group, value) instead -- a hot group spreads over
many ranges -- and each task numbers its own rows.  A table with one row per
task (bounded by the partition count, so broadcast) turns task-local indices
into global positions; a per-group partial aggregate gives each group's
first position and size.

The indexed rows are written once to the shared checkpoint folder and read
back (``session.materialize``): range bounds are sampled per plan branch, so
every later use must read the same ids, and the written table also makes
them survive executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def global_index(df: DataFrame, order) -> DataFrame:
    """``df`` plus ``_g``: the 0-based position of each row in ``order``."""
    from ..session import materialize
    cols = df.columns
    pid = F.spark_partition_id().cast("long")
    s = materialize(df.orderBy(*_cols(order)).select(
        "*", pid.alias("_pid"), (F.monotonically_increasing_id() - F.shiftleft(pid, 33)).alias("_idx")), "indexed")
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return s.join(F.broadcast(offsets), "_pid").select(*cols, (F.col("_off") + F.col("_idx")).alias("_g"))


def group_rank(df: DataFrame, partition, order) -> DataFrame:
    """``df`` plus ``_rn``: the 0-based row number within ``partition`` in ``order``.

    ``partition`` is a list of column names or Columns (NULL is a group of
    its own, as in a window).
    """
    part = _cols(partition or [])
    keys = [f"_k{i}" for i in range(len(part))]
    cols = df.columns
    g = global_index(df.select("*", *(p.alias(k) for p, k in zip(part, keys))),
                     [F.col(k) for k in keys] + list(order))
    if not keys:
        return g.select(*cols, F.col("_g").alias("_rn"))
    first = g.groupBy(*keys).agg(F.min("_g").alias("_first"))
    f = first.select(*(F.col(k).alias(f"_f{k}") for k in keys), "_first")
    g = g.join(f, [g[k].eqNullSafe(f[f"_f{k}"]) for k in keys])
    return g.select(*cols, (F.col("_g") - F.col("_first")).alias("_rn"))


def running_total(df: DataFrame, order, weight: str) -> DataFrame:
    """``df`` plus ``_before``: the sum of ``weight`` over the rows ahead in ``order``."""
    from ..session import materialize
    cols = df.columns
    pid = F.spark_partition_id().cast("long")
    s = materialize(df.orderBy(*_cols(order)).select("*", pid.alias("_pid"), F.monotonically_increasing_id().alias("_idx")), "running")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = s.groupBy("_pid").agg(F.sum(weight).alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return s.join(F.broadcast(offsets), "_pid").select(*cols, (F.col("_off") + F.col("_in")).alias("_before"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles, names=None, weighted: dict | None = None) -> DataFrame:
    """Continuous quantiles of ``value`` per ``keys`` group, exact, plus ``weighted``
    aggregates; one row per group: ``keys + weighted + names``.

    ``weighted`` maps a name to ``fn(value, count)``, an aggregate over the
    group's distinct values (NULL is one) and how often each occurs, so that the
    rows are read once.

    ``q`` sits at position ``(n - 1) * q`` of the group's sorted non-NULL
    values, interpolated linearly between the two neighbouring ranks (the
    ``quantile_cont`` / ``percentile`` definition).

    One path at every size: equal values are counted first (a value that most
    rows have is one row), the counts are summed up along range partitions of
    (keys, value), and each group picks the values whose span of ranks holds
    its quantiles.  A hot group is spread over as many ranges as it needs.
    """
    names = list(names or [f"_q{i}" for i in range(len(quantiles))])
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    v = running_total(v, [F.col(k) for k in keys] + [F.col("_v").asc_nulls_first()], "_c")
    known = F.col("_v").isNotNull()
    group = v.groupBy(*keys).agg(F.sum(F.when(known, F.col("_c"))).alias("_n"), F.min(F.when(known, F.col("_before"))).alias("_first"),
                                 *(fn(F.col("_v"), F.col("_c")).alias(name) for name, fn in (weighted or {}).items()))
    ranks = group.select(*(F.col(k).alias(f"_g_{k}") for k in keys), "_n", "_first")
    v = v.filter(known).join(ranks, [v[k].eqNullSafe(ranks[f"_g_{k}"]) for k in keys])
    lo = F.col("_before") - F.col("_first")

    def at(rank):
        return F.max(F.when((lo <= rank) & (rank < lo + F.col("_c")), F.col("_v")))
    picks = []
    for i, q in enumerate(quantiles):
        pos = (F.col("_n") - 1) * F.lit(float(q))
        picks += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"), F.max(pos - F.floor(pos)).alias(f"_d{i}")]
    found = v.groupBy(*keys).agg(*picks)
    found = found.select(*(F.col(k).alias(f"_q_{k}") for k in keys),
                         *[(F.col(f"_lo{i}") + F.col(f"_d{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(nm) for i, nm in enumerate(names)])
    j = group.join(found, [group[k].eqNullSafe(found[f"_q_{k}"]) for k in keys], "left")
    return j.select(*keys, *(weighted or {}), *names)


__all__ = ["global_index", "group_rank", "running_total", "exact_quantiles"]
