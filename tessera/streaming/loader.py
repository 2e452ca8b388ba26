"""Incremental warehouse loader as a Structured Streaming job (STR1-3, STR12, DML3-5, SNK1-3, SNK7-8).

``readStream.json(bronze)`` -> ``foreachBatch(load_tick)`` (dedup of
``event_id`` inside each tick; cross-tick watermark dedup is opt-in).  The streaming checkpoint
is the source of truth for "which files were read"; the load log is kept
as an audit table.  Every write of a tick is idempotent per ``batch_id``
(dynamic partition overwrite of the ``load_batch=<id>`` partition), so a
batch replayed after an executor or driver loss rewrites the same output.

Layout under ``warehouse``::

    <table>/load_batch=<id>/part-*.parquet     fact tables (24 + test tables)
    _load_log/tick=<id>/                       one row per (event_type, file)
    _pending/<table>/version=<id>/             MERGE rows whose parent is missing, after tick <id>
    _resolved/<table>/run=<uuid>/              event ids that a deep merge has applied
    _retry/version=<id>/                       events of failed tables, read again by the next tick
    _adopted/load_batch=<id>/                  formerly unmapped event types taken up by a tick
    _keyless/<table>/load_batch=<id>/          MERGE rows without a key (they can match nothing)
    _rejects/load_batch=<id>/error_type=/      malformed lines (with reject_date)
    _unmapped/load_batch=<id>/                 events with no registry entry
    _unmapped_types/load_batch=<id>/           the distinct types of those
    _key_index/<table>/<key>/load_batch=<id>/  which merge keys a partition may hold
    _seen/ids, _seen/filters                   event ids taken, by event hour (``across_ticks``)
    _data, _snapshots                          fact tables of ``atomic`` ticks (see ``store``)
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import load as L
from ..operators import project as P
from ..plans.dispatch import FACT_TABLES, REGISTRY, VERSION_TYPE, load_order, merge_groups
from ..session import ensure_checkpoint_dir, scratch
from ..sources.bronze import BRONZE_SCHEMA, split_corrupt, with_file
from . import store as ST
from .store import hadoop as _hadoop, names_in, read_table as _read_table, write_batch_partition as _write_batch_partition

MAX_FILES_PER_TRIGGER = 200      # SNK8: files per load
DEFAULT_TRIGGER = "5 minutes"    # STR1: load cadence
DEDUP_WATERMARK = "3 hours"      # opt-in cross-tick dedup horizon: lookback (2 h) + current hour


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=", 1)[1]) for n in names_in(spark, path) if n.startswith("version="))


def _read_version(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The newest version before ``batch_id``: a replayed tick reads what its first run read."""
    older = [v for v in _versions(spark, path) if v < int(batch_id)]
    return _read_table(spark, f"{path}/version={older[-1]}") if older else None


def pending_rows(spark: SparkSession, warehouse: str, table: str, before: int = 2**62) -> DataFrame | None:
    """STR12: MERGE rows that wait for their parent (newest version before ``before``, less the resolved ones)."""
    rows = _read_version(spark, f"{warehouse}/_pending/{table}", before)
    done = _read_table(spark, f"{warehouse}/_resolved/{table}")
    if rows is None or done is None:
        return rows
    return rows.join(done.select("event_id"), "event_id", "left_anti")


def _write_version(df: DataFrame, path: str, batch_id: int) -> None:
    """Write this tick's version; versions before the one it was made from are no longer read."""
    df.write.mode("overwrite").parquet(f"{path}/version={int(batch_id)}")
    older = [v for v in _versions(df.sparkSession, path) if v < int(batch_id)]
    for v in older[:-1]:
        fs, p = _hadoop(df.sparkSession, f"{path}/version={v}")
        fs.delete(p, True)


def _adopted(spark: SparkSession, warehouse: str, batch_id: int, registry: dict):
    """``(events, types)`` of earlier unmapped events whose type has an entry by now, once per type.

    Which types stand unmapped, and in which ticks, is read from a table of
    distinct types; the events themselves only once a type is taken up.
    """
    seen = _read_table(spark, f"{warehouse}/_unmapped_types")
    if seen is None:
        return None, []
    seen = seen.filter((F.col("load_batch") < int(batch_id)) & F.col("type").isin(list(registry)))
    done = _read_table(spark, f"{warehouse}/_adopted")
    if done is not None:
        taken = [r["type"] for r in done.filter(F.col("load_batch") < int(batch_id)).select("type").distinct().collect()]
        seen = seen.filter(~F.col("type").isin(taken))          # at most one row per registry entry
    found = seen.groupBy("type").agg(F.collect_set("load_batch").alias("batches")).collect()
    if not found:
        return None, []
    types, batches = [r["type"] for r in found], sorted({b for r in found for b in r["batches"]})
    stored = _read_table(spark, f"{warehouse}/_unmapped").filter(F.col("load_batch").isin(batches) & F.col("type").isin(types))
    return stored.drop("load_batch"), types


def load_tick(batch: DataFrame, batch_id: int, warehouse: str, registry: dict | None = None,
              strict: bool = False, tenant_scoped: bool = True, merge_order: str = "event_time",
              merge_horizon: int | None = None, atomic: bool = False, across_ticks: bool = False,
              key_index: bool = True) -> None:
    """One micro-batch: typed appends, MERGE updates, load log, pending, rejects.

    Order inside the tick follows the registry (INSERT types before MERGE
    types, WIN3).  A failure of one table is recorded in the log and the
    others continue (DML3); ``strict=True`` re-raises instead.

    ``merge_horizon`` bounds the per-tick MERGE work at scale: only the last
    N ``load_batch`` partitions are searched for parent rows (partition
    pruning); keys not found there wait in pending and :func:`deep_merge`
    resolves them against the whole table on a slower cadence.  With
    ``key_index`` (default) a tick opens only the partitions whose key filter
    may hold one of its merge keys, wherever in the table they are.

    ``atomic=True`` writes the tables as a snapshot: readers go through
    ``store.read_snapshot`` and see a tick in all tables or in none; a tick that
    is committed already is not run again.  ``across_ticks=True`` leaves out
    events that an earlier tick has taken, however late they repeat.
    """
    spark = batch.sparkSession
    registry = REGISTRY if registry is None else registry
    ensure_checkpoint_dir(spark)
    store = (ST.Snapshot if atomic else ST.InPlace)(spark, warehouse, batch_id)
    if store.committed():
        return
    with scratch(spark, "tick") as keep:
        batch = keep(batch, "batch")
        good, rejects = split_corrupt(batch)
        (rejects.withColumn("load_batch", F.lit(int(batch_id))).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("load_batch", "error_type")
            .json(f"{warehouse}/_rejects"))
        # every file read in this tick is logged with the rows it held (before dedup)
        per_file = P.split_mapped(good, registry)[0].groupBy(F.col("type").alias("event_type"), "s3_key").agg(
            F.count(F.lit(1)).alias("row_count"), _file_bytes(good))
        good = good.drop("s3_bytes")
        if across_ticks:
            good = keep(ST.drop_seen(good, f"{warehouse}/_seen", batch_id), "new-events")
        _, fresh_unmapped = P.split_mapped(good, registry)
        _write_batch_partition(L.dedup(fresh_unmapped.drop("_corrupt_record"), "id", ["time", "s3_key"]),
                               f"{warehouse}/_unmapped", batch_id)
        _write_batch_partition(fresh_unmapped.select("type").distinct(), f"{warehouse}/_unmapped_types", batch_id)
        # events of tables that failed, and unmapped ones whose entry exists by now, join this tick
        again, types = _adopted(spark, warehouse, batch_id, registry)
        _write_batch_partition(spark.createDataFrame([(t,) for t in types], "type string"), f"{warehouse}/_adopted", batch_id)
        for more in (again, _read_version(spark, f"{warehouse}/_retry", batch_id)):
            if more is not None:
                good = good.unionByName(more, allowMissingColumns=True)
                taken_up = P.split_mapped(more, registry)[0].groupBy(F.col("type").alias("event_type"), "s3_key").agg(
                    F.count(F.lit(1)).alias("row_count"))
                per_file = per_file.unionByName(taken_up, allowMissingColumns=True)
        per_file = keep(per_file.groupBy("event_type", "s3_key").agg(F.sum("row_count").alias("row_count"), F.max("bytes").alias("bytes")), "per-file")
        good = _drop_repeats(good, keep)                     # WIN1 inside the batch
        mapped, _ = P.split_mapped(good, registry)

        present = [r["event_type"] for r in per_file.select("event_type").distinct().collect()]  # <= registry size
        tables: dict = {}
        for et in load_order(present, registry):
            tables.setdefault(registry[et].table, []).append(registry[et])
        # tables with MERGE rows still pending from earlier ticks are retried too
        pending_tables = {e.table for e in registry.values()
                          if e.is_merge and _read_version(spark, f"{warehouse}/_pending/{e.table}", batch_id) is not None}
        for t in sorted(pending_tables):
            tables.setdefault(t, [])

        status_rows, failed = [], []
        for tbl, entries in tables.items():
            began, loaded = time.monotonic(), []
            inserts = [e for e in entries if not e.is_merge]
            # every MERGE entry of the table: pending rows may be of any of them
            merges = sorted((e for e in registry.values() if e.table == tbl and e.is_merge),
                            key=lambda e: e.event_type) \
                if (any(e.is_merge for e in entries) or tbl in pending_tables) else []
            try:
                if inserts:
                    rows = P.project_table(mapped, inserts, tbl).drop("_event_type")
                    rows = P.conform(rows, tbl) if tbl in FACT_TABLES else rows
                    for e in (e for e in registry.values() if e.table == tbl and e.is_merge):
                        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in zip(e.columns, e.types) if c not in rows.columns})
                    for vcol in merge_groups(tbl, registry):          # nothing merged yet
                        rows = rows.withColumn(vcol, F.lit(None).cast(VERSION_TYPE))
                    store.add(rows, tbl)
                    for key in sorted({e.merge_key for e in registry.values() if key_index and e.table == tbl and e.is_merge}):
                        written = store.read(tbl).filter(F.col("load_batch") == int(batch_id))
                        ST.write_key_index(written, key, f"{warehouse}/_key_index/{tbl}/{key}", batch_id)
                    loaded = inserts
                for key in sorted({e.merge_key for e in merges}):
                    group = [e for e in merges if e.merge_key == key]
                    _apply_merge(store, mapped, group, tbl, tenant_scoped, merge_order, merge_horizon, key_index)
                loaded = entries
            except Exception as exc:  # noqa: BLE001 - DML3 failure isolation
                if strict:
                    raise
                missed = [e.event_type for e in entries if e not in loaded]     # inserts may have been written already
                failed += missed
                status_rows += [(t, "failed", str(exc)[: L.ERROR_TEXT_LIMIT], int(1000 * (time.monotonic() - began))) for t in missed]
            status_rows += [(e.event_type, "ok", None, int(1000 * (time.monotonic() - began))) for e in loaded]

        _write_version(mapped.filter(F.col("type").isin(failed)) if failed else mapped.limit(0), f"{warehouse}/_retry", batch_id)
        st = spark.createDataFrame(status_rows or [("", "ok", None, 0)],
                                   "event_type string, status string, error string, duration long")
        log = (per_file.join(F.broadcast(st), "event_type")       # one status row per event type
               .select("event_type", "s3_key", "row_count", "bytes", "status", "error", "duration"))
        log = log.select(
            "event_type", "s3_key", F.current_timestamp().alias("copied_at"),
            F.col("row_count").cast("long"), F.col("bytes").alias("bytes_loaded"),
            F.col("duration").alias("copy_duration_ms"), "status",
            F.col("error").alias("error_message"), F.lit(str(batch_id)).alias("tick_id"))
        (log.withColumn("tick", F.lit(int(batch_id))).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("tick").parquet(f"{warehouse}/_load_log"))
        store.commit()


def _drop_repeats(rows: DataFrame, keep) -> DataFrame:
    """``load.dedup`` on the event id; only rows whose id occurs again (by its hash) are brought together, the others stay where they are."""
    rows = rows.withColumn("_id_hash", F.xxhash64("id"))
    hashes = rows.filter(F.col("id").isNotNull()).groupBy("_id_hash").agg(F.count(F.lit(1)).alias("n"))
    again = keep(hashes.filter("n > 1").select("_id_hash"), "ids-again")
    if again.isEmpty():
        return rows.drop("_id_hash")
    repeats = L.dedup(rows.join(again, "_id_hash", "left_semi").drop("_id_hash"), "id", ["time", "s3_key"])
    return keep(rows.join(again, "_id_hash", "left_anti").drop("_id_hash").unionByName(repeats), "events")


def _file_bytes(rows: DataFrame):
    """Size of a row's file, where the source tells it."""
    return (F.max("s3_bytes") if "s3_bytes" in rows.columns else F.lit(None)).cast("long").alias("bytes")


def _apply_merge(store, mapped, entries, tbl, tenant_scoped, merge_order, horizon=None, key_index=False, resolve=False):
    """DML1/DML5/STR12: MERGE this tick's rows (plus earlier pending ones) into the table.

    Only the ``load_batch`` partitions that may hold a touched key are read
    (``key_index``), only those that hold one are rewritten.  Rows without a
    parent stay pending and are retried next tick instead of being dropped.

    The rows are brought together by key once, to one row a key; searching,
    merging and telling the keys without a parent all use those.
    """
    spark, warehouse, batch_id = store.spark, store.warehouse, store.batch_id
    key = entries[0].merge_key
    keys = (["tenant_id"] if tenant_scoped else []) + [key]
    pending_path = f"{warehouse}/_pending/{tbl}"
    with scratch(spark, "merge") as keep:
        src = P.project_table(mapped, entries, tbl)
        prev = pending_rows(spark, warehouse, tbl, batch_id)
        if prev is not None and not prev.isEmpty():
            src = keep(L.dedup(src.unionByName(prev.select(*src.columns)), "event_id", ["event_time", "_event_type"]), "source")
        has_key = F.lit(True)
        for k in keys:
            has_key = has_key & F.col(k).isNotNull()
        _write_batch_partition(src.filter(~has_key), f"{warehouse}/_keyless/{tbl}", batch_id)
        src = src.filter(has_key)
        update_cols: dict = {}
        for e in entries:
            for c in e.update_columns():
                update_cols.setdefault(c, []).append(e.event_type)
        how = {"order": merge_order, "tenant_scoped": tenant_scoped, "name_order": [e.event_type for e in entries],
               "versions": merge_groups(tbl, {e.event_type: e for e in entries})}
        target = store.read(tbl)
        if target is not None and horizon is not None:
            target = target.filter(F.col("load_batch") >= int(batch_id) - int(horizon))   # partition pruning
        if target is None:
            still = src
        else:
            merges = keep(L.collapse_source(src, update_cols, key, **how), "merges")
            if key_index:
                index = f"{warehouse}/_key_index/{tbl}/{key}"
                target = target.filter(F.col("load_batch").isin(sorted(ST.partitions_to_open(spark, index, merges, key, store.batches(tbl)))))
            # Everything derived from files this tick overwrites is kept before any write.
            updated, _ = L.merge_update(target, merges, update_cols, key, collapsed=True, **how)
            touched = [r["load_batch"] for r in L.touched_partitions(target, merges, keys, ["load_batch"]).collect()]
            new_rows = store.settled(updated.filter(F.col("load_batch").isin(touched)), keep)
            orphans = keep(merges.select(*keys).join(target.select(*keys).distinct(), keys, "left_anti"), "orphans")
            still = src.join(orphans, keys, "left_semi")
            store.rewrite(new_rows, tbl)
        if resolve:
            applied = src.join(still.select("event_id").distinct(), "event_id", "left_anti").select("event_id")
            applied.filter(F.col("event_id").isNotNull()).write.parquet(f"{warehouse}/_resolved/{tbl}/run={uuid.uuid4().hex}")
        else:
            _write_version(still, pending_path, batch_id)


def deep_merge(spark: SparkSession, warehouse: str, batch_id: int, registry: dict | None = None,
               tenant_scoped: bool = True, merge_order: str = "event_time", atomic: bool = False) -> None:
    """Resolve pending MERGE rows against the whole table (no horizon).

    Run on a slow cadence next to a horizon-bounded stream, with a ``batch_id``
    above the ticks whose pending rows it shall see.  It leaves the pending
    versions to the stream and records the events it has applied instead,
    which later ticks leave out; applying one twice changes nothing.  On a
    warehouse of snapshots (``atomic``) it commits one under its ``batch_id``,
    which must then be a number that no tick uses.
    """
    registry = REGISTRY if registry is None else registry
    store = (ST.Snapshot if atomic else ST.InPlace)(spark, warehouse, batch_id)
    empty = spark.createDataFrame([], "id string, time string, type string, tenantid string, caseid string, "
                                      "data string")
    for tbl in sorted({e.table for e in registry.values() if e.is_merge}):
        if _read_version(spark, f"{warehouse}/_pending/{tbl}", batch_id) is None:
            continue
        entries = sorted((e for e in registry.values() if e.table == tbl and e.is_merge), key=lambda e: e.event_type)
        for key in sorted({e.merge_key for e in entries}):
            group = [e for e in entries if e.merge_key == key]
            _apply_merge(store, empty, group, tbl, tenant_scoped, merge_order, resolve=True)
    store.commit()


def bronze_stream(spark: SparkSession, root: str, max_files: int = MAX_FILES_PER_TRIGGER,
                  archive_dir: str | None = None, dedup_watermark: str | None = None) -> DataFrame:
    """STR1/SNK3/SNK8: file stream over the bronze layout with per-file provenance.

    The file source never re-reads a file (its checkpoint is the manifest),
    and each tick deduplicates ``event_id`` inside the batch.  Optional
    ``dedup_watermark`` (e.g. "3 hours") also drops repeats across ticks with
    bounded state -- at the price that events older than the watermark are
    dropped as late, so it is off by default (Q1: no silent loss).
    """
    r = (spark.readStream.schema(BRONZE_SCHEMA).option("basePath", root)
         .option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", max_files)
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record"))
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    df = with_file(r.json(root))
    if dedup_watermark:
        # malformed rows keep a unique key and the file's hour as event time
        hour = F.make_timestamp(F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.lit(0), F.lit(0))
        ts = F.coalesce(F.try_to_timestamp(F.col("time")), hour)
        key = F.coalesce(F.col("id"), F.concat(F.lit("corrupt:"), F.col("s3_key"),
                                               F.sha2(F.coalesce(F.col("_corrupt_record"), F.lit("")), 256)))
        df = (df.withColumn("_event_ts", ts).withColumn("_dedup_key", key)
                .withWatermark("_event_ts", dedup_watermark)
                .dropDuplicatesWithinWatermark(["_dedup_key"]).drop("_event_ts", "_dedup_key"))
    return df


def start_loader(spark: SparkSession, bronze_root: str, warehouse: str, checkpoint: str | None = None,
                 trigger: str | None = DEFAULT_TRIGGER, available_now: bool = False, registry: dict | None = None,
                 archive_dir: str | None = None, dedup_watermark: str | None = None,
                 max_files: int = MAX_FILES_PER_TRIGGER, **tick_kwargs):
    """Start the loader stream; ``available_now=True`` drains what is there and stops."""
    checkpoint = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "loader")
    stream = bronze_stream(spark, bronze_root, max_files, archive_dir=archive_dir, dedup_watermark=dedup_watermark)
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: load_tick(df, bid, warehouse, registry, **tick_kwargs)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def load_batch_files(spark: SparkSession, bronze_root: str, warehouse: str, batch_id: int = 0,
                     registry: dict | None = None, **tick_kwargs) -> None:
    """Batch form of one tick over everything under ``bronze_root`` (same code path)."""
    from ..sources.bronze import read_bronze
    load_tick(read_bronze(spark, bronze_root), batch_id, warehouse, registry, **tick_kwargs)
