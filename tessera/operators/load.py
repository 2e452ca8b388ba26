"""Warehouse loader core: MERGE-update, load log, file diff, dedup, caps.

SURVEY rows JN1/JN2/JN16, DML1-5, FIL1, WIN1/WIN3/WIN4, SRT2, SNK1-3, STR12,
AGG1/AGG2.  Parquet has no ``MERGE``/``UPDATE``, so a merge is expressed as
"collapse the source per key (map-side partial aggregate) -> left join the
target -> choose per column" and written back by dynamic partition
overwrite of only the touched partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import minus_hours
from ..plans.dispatch import ENVELOPE_COLS

LOAD_LOG_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("s3_key", T.StringType()),
    T.StructField("copied_at", T.TimestampType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("bytes_loaded", T.LongType()),
    T.StructField("copy_duration_ms", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("tick_id", T.StringType()),
])

DONE_STATUSES = ("ok", "abandoned")  # Q7: both stop retries
ERROR_TEXT_LIMIT = 2000


# --------------------------------------------------------------------------
# MERGE (JN1, DML1, Q2-Q5)
# --------------------------------------------------------------------------

def merge_update(target: DataFrame, source: DataFrame, update_cols: dict, merge_key: str,
                 order: str = "event_time", tenant_scoped: bool = True,
                 ignore_nulls: bool = False, type_col: str = "_event_type",
                 name_order: list | None = None, versions: dict | None = None,
                 collapsed: bool = False) -> tuple:
    """JN1/DML1: ``UPDATE target SET cols FROM source WHERE key matches``.

    ``update_cols`` maps each updatable column to the event types that list it.
    Returns ``(updated_target, unmatched_source_keys)``; unmatched rows are
    the STR12 pending set (the reference silently dropped them).

    * ``order="event_time"`` (default): last event by (event_time, event_id)
      wins per column; ``order="name"`` reproduces apply-by-type-name order.
    * ``tenant_scoped``: key is (tenant_id, key) instead of key alone (Q4).
    * ``ignore_nulls``: NULL in a carrying event does not overwrite (Q3 opt-in).
    * ``versions`` (``plans.dispatch.merge_groups``): per column group a
      version column in the target holding the (event_time, event_id) that
      last set the group; a source group applies only when it is newer, so
      the result does not depend on the order in which batches arrive.
    * ``collapsed``: ``source`` is what :func:`collapse_source` made of it with the same settings.
    """
    settings = (update_cols, merge_key, order, tenant_scoped, ignore_nulls, type_col, name_order, versions)
    keys, _, _, by_types, versions = _merge_plan(*settings)
    s = (source if collapsed else collapse_source(source, *settings)).alias("s")
    groups = list(by_types.values())
    t = target.alias("t")
    cond = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]          # SQL equality: a NULL key matches nothing
    joined = t.join(s, cond, "left")
    group_of = {c: i for i, g in enumerate(groups) for c in g}
    vnames = list(by_types.keys()) if versions else []
    applies = []
    for i, g in enumerate(groups):
        ok = F.col(f"s._hasg{i}") == 1
        if versions and vnames[i] in target.columns:
            tv = F.col(f"t.{vnames[i]}")
            ok = ok & (tv.isNull() | (F.col(f"s._ordg{i}") > tv))
        applies.append(ok)
    out = []
    for f in target.schema.fields:
        c = f.name
        if c in group_of and c not in keys and c not in ENVELOPE_COLS:
            out.append(F.when(applies[group_of[c]], F.col(f"s.{c}").cast(f.dataType)).otherwise(F.col(f"t.{c}")).alias(c))
        elif versions and c in vnames:
            i = vnames.index(c)
            out.append(F.when(applies[i], F.col(f"s._ordg{i}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    for i, vcol in enumerate(vnames):
        if vcol not in target.columns:
            out.append(F.when(applies[i], F.col(f"s._ordg{i}")).alias(vcol))
    updated = joined.select(*out)
    unmatched = s.join(t.select(*keys).alias("t"), [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys],
                       "left_anti")
    return updated, unmatched


def collapse_source(source: DataFrame, update_cols: dict, merge_key: str, order: str = "event_time",
                    tenant_scoped: bool = True, ignore_nulls: bool = False, type_col: str = "_event_type",
                    name_order: list | None = None, versions: dict | None = None) -> DataFrame:
    """One row per merge key: what :func:`merge_update` sets, for callers that use it more than once."""
    keys, ord_col, carriers, by_types, _ = _merge_plan(update_cols, merge_key, order, tenant_scoped, ignore_nulls,
                                                       type_col, name_order, versions)
    return _collapse_with_order(source.withColumn("_ord", ord_col), keys, carriers, list(by_types.values()))


def _merge_plan(update_cols, merge_key, order, tenant_scoped, ignore_nulls, type_col, name_order, versions) -> tuple:
    """``(keys, ordering, carriers, column groups, versions in use)`` of a merge."""
    keys = (["tenant_id"] if tenant_scoped else []) + [merge_key]
    if order == "name":
        ranks = {t: i for i, t in enumerate(sorted(name_order or []))}
        rank = F.lit(None).cast("int")
        for t, i in ranks.items():
            rank = F.when(F.col(type_col) == t, F.lit(i)).otherwise(rank)
        ord_col = F.struct(rank.alias("r"), F.col("event_time"), F.col("event_id"))
    else:
        # native types: event_id may itself be a tie-break struct
        ord_col = F.struct(F.col("event_time").alias("event_time"), F.col("event_id").alias("event_id"))
    versions = versions if (versions and order != "name" and not ignore_nulls) else None
    carriers, by_types = {}, {}
    if versions:
        for vcol, (cols, types) in versions.items():
            cols = [c for c in cols if c in update_cols]
            if cols:
                by_types[vcol] = cols
                for c in cols:
                    carriers[c] = F.col(type_col).isin(list(types))
    else:
        for c, types in update_cols.items():
            carried = F.col(type_col).isin(list(types))
            if ignore_nulls:
                carried = carried & F.col(c).isNotNull()
                by_types[(c,)] = [c]                       # NULL-skipping is per column
            else:
                by_types.setdefault(tuple(sorted(types)), []).append(c)
            carriers[c] = carried
    return keys, ord_col, carriers, by_types, versions


def _collapse_with_order(src: DataFrame, keys, carriers: dict, groups: list) -> DataFrame:
    """Per key and column group: the last carrying event's values and its ordering.

    ``carriers`` maps a column to the predicate "this row's event type lists it".
    Columns with the same carriers are taken together with ONE ``max_by(struct)``;
    a NULL ordering makes it skip the others.  Combined map-side, so a hot key
    costs one row per map task, not a third of the data in one task.
    """
    aggs = []
    for i, cols in enumerate(groups):
        carried = carriers[cols[0]]
        val = F.struct(*[F.col(c) for c in cols], F.col("_ord").alias("_o"))
        aggs.append(F.max_by(val, F.when(carried, F.col("_ord"))).alias(f"_g{i}"))
        aggs.append(F.max(carried.cast("int")).alias(f"_hasg{i}"))
    aggs.append(F.count(F.lit(1)).alias("_n_source"))
    out = src.groupBy(*keys).agg(*aggs)
    sel = [F.col(k) for k in keys]
    for i, cols in enumerate(groups):
        sel += [F.col(f"_g{i}").getField(c).alias(c) for c in cols]
        sel += [F.col(f"_g{i}").getField("_o").alias(f"_ordg{i}"), F.col(f"_hasg{i}")]
    return out.select(*sel, "_n_source")


def touched_partitions(target: DataFrame, keys: DataFrame, key_cols, partition_cols) -> DataFrame:
    """Partition values of ``target`` that contain at least one merged key."""
    return (target.join(keys.select(*key_cols).distinct(), list(key_cols), "left_semi")
            .select(*partition_cols).distinct())


# --------------------------------------------------------------------------
# Load log (SNK2, DML2, FIL1, JN2, JN16, AGG1/AGG2)
# --------------------------------------------------------------------------

def load_state(log: DataFrame, as_of=None, hours: int | None = None) -> DataFrame:
    """FIL1/DML2: latest log row per (event_type, s3_key); optionally only recent.

    The log keeps history (failed attempts accumulate, Q8); the state view is
    ``max_by`` over the attempts, a partial aggregate keyed by file.
    """
    df = log
    if as_of is not None and hours is not None:
        lo = minus_hours(F.lit(as_of).cast("timestamp"), hours + 1)
        df = df.filter(F.col("copied_at") >= lo)
    cols = [c for c in log.columns if c not in ("event_type", "s3_key")]
    latest = F.max_by(F.struct(*cols), F.struct("copied_at", "tick_id", "status"))
    return (df.groupBy("event_type", "s3_key")
              .agg(latest.alias("_l"), F.count(F.lit(1)).alias("attempts"))
              .select("event_type", "s3_key", "_l.*", "attempts"))


def new_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """JN2/SET1: listed files minus those whose latest status is ok/abandoned."""
    done = state.filter(F.col("status").isin(*DONE_STATUSES)).select("event_type", "s3_key")
    return files.join(done, ["event_type", "s3_key"], "left_anti")


def forget_files(log: DataFrame, keys: DataFrame) -> DataFrame:
    """JN16: ``DELETE FROM log WHERE (event_type, s3_key) IN keys`` as an anti join."""
    return log.join(keys.select("event_type", "s3_key"), ["event_type", "s3_key"], "left_anti")


def log_rows(per_file: DataFrame, tick_id: str, copied_at, status: str = "ok",
             error: Column | None = None, duration_ms: Column | None = None) -> DataFrame:
    """SNK2: load-log rows (one per file) from ``(event_type, s3_key, row_count[, bytes])``."""
    err = F.left(error, F.lit(ERROR_TEXT_LIMIT)) if error is not None else F.lit(None)
    return per_file.select(
        F.col("event_type").cast("string"), F.col("s3_key").cast("string"),
        (copied_at if isinstance(copied_at, Column) else F.lit(copied_at)).cast("timestamp").alias("copied_at"),
        F.col("row_count").cast("long"),
        (F.col("bytes") if "bytes" in per_file.columns else F.lit(None)).cast("long").alias("bytes_loaded"),
        (duration_ms if duration_ms is not None else F.lit(None)).cast("long").alias("copy_duration_ms"),
        F.lit(status).alias("status"), err.cast("string").alias("error_message"),
        F.lit(tick_id).alias("tick_id"))


def load_metrics(log: DataFrame) -> DataFrame:
    """AGG1/AGG2: per event type: files, rows, failures, duration, rows/file estimate."""
    ok = F.col("status") == "ok"
    rows = F.sum(F.when(ok, F.col("row_count")))
    files = F.count_if(ok)
    return (log.groupBy("event_type").agg(
        files.alias("files_ok"),
        F.count_if(F.col("status") == "failed").alias("files_failed"),
        rows.alias("rows_loaded"),
        F.sum("copy_duration_ms").alias("duration_ms"))
        .withColumn("est_rows_per_file",
                    F.when(F.col("rows_loaded") > 0,
                           F.greatest(F.lit(1), F.floor(F.col("rows_loaded") / F.col("files_ok"))))
                    .cast("long")))


# --------------------------------------------------------------------------
# Dedup, caps, chunks, latest (WIN1, WIN4, SRT2, SRT3, AGG18)
# --------------------------------------------------------------------------

def dedup(df: DataFrame, key, order_cols) -> DataFrame:
    """WIN1: keep the first row per key by ``order_cols`` (then all columns).

    Expressed as ``min_by(struct(all), struct(order))`` so Spark combines
    map-side; duplicates of one hot key never meet in a single sort.  A row with
    a NULL in its key is no repeat of another: all of them stay.
    """
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key]
    ordering = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in rest])
    no_key = F.lit(False)
    for k in key:
        no_key = no_key | F.col(k).isNull()
    first = (df.filter(~no_key).groupBy(*key).agg(F.min_by(F.struct(*rest), ordering).alias("_r"))
               .select(*key, "_r.*"))
    return first.unionByName(df.filter(no_key).select(*first.columns))


def latest(df: DataFrame, key, ts: str) -> DataFrame:
    """AGG18/SRT3: newest row per key (ties broken on all columns)."""
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key]
    ordering = F.struct(F.col(ts), *[F.col(c) for c in rest])
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordering).alias("_r")).select(*key, "_r.*")


def cap_per_type(files: DataFrame, n: int, group: str = "event_type", order=None) -> tuple:
    """WIN4/SRT2: first ``n`` rows per group in ``order`` + per-group deferred count.

    ``row_number() <= n`` is planned as a WindowGroupLimit: each map task
    keeps only its local top-n per group before the shuffle, so a group
    holding a third of all rows still ships only n rows per task.
    """
    order = order or [F.col("s3_key")]
    w = Window.partitionBy(group).orderBy(*order)
    ranked = files.withColumn("rn", F.row_number().over(w))
    batch = ranked.filter(F.col("rn") <= n)
    deferred = (files.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
                .withColumn("deferred", F.greatest(F.col("total") - F.lit(n), F.lit(0))))
    return batch, deferred


def chunk(df: DataFrame, n: int, order, partition=None) -> DataFrame:
    """WIN4: ``chunk = floor((row_number - 1) / n)`` within ``partition``.

    Numbered with ``ordered.group_rank`` (range partitions plus per-task
    offsets), not a per-group or global window, so neither a hot group nor
    the whole table lands in one task.
    """
    from .ordered import group_rank
    r = group_rank(df, partition, order)
    return r.select(*df.columns, F.floor(F.col("_rn") / n).cast("int").alias("chunk"))


__all__ = ["LOAD_LOG_SCHEMA", "merge_update", "collapse_source", "touched_partitions", "load_state", "new_files", "forget_files", "log_rows", "load_metrics",
           "dedup", "latest", "cap_per_type", "chunk"]
