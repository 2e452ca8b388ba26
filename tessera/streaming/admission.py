"""Which files a tick loads: a cap per event type, newest hour first (SRT2, SNK8, WIN4, STR1).

The load log is the manifest: files that no log row names wait (events of a
table that failed are kept by the loader itself and tried again).  Each tick takes at most ``cap`` files of every type, so a
backlog of one noisy type never delays the others, and the newest hours first,
so a backlog never delays fresh events either.  What a tick has admitted is
written down before it loads; a tick that stopped is run again with the same
files.

    _admitted/tick=<id>/      the files of a tick
    _deferred/tick=<id>/      per event type: files waiting, admitted, deferred
    _archive_log/             files moved to the archive, or that could not be
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import load as L
from ..sources.bronze import PARTITION_COLS, hour_ts, read_files
from .loader import DEFAULT_TRIGGER, MAX_FILES_PER_TRIGGER, load_tick
from .store import hadoop, names_in, read_table

FILES = "event_type string, hour_start timestamp, s3_key string, path string, bytes long"


def list_files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """``event_type, hour_start, s3_key, path, bytes`` of the event files, from the file listing alone.

    Files of zero bytes hold no event and are not listed.
    """
    if not names_in(spark, root):
        return spark.createDataFrame([], FILES)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    if not set(PARTITION_COLS) <= set(found.columns):
        return spark.createDataFrame([], FILES)
    return found.select(F.col("event_type").cast("string"), hour_ts().alias("hour_start"), 
                        F.col("_metadata.file_path").alias("s3_key"), "path", F.col("length").alias("bytes"))


def waiting(files: DataFrame, log: DataFrame | None) -> DataFrame:
    """Listed files that no log row names."""
    return files if log is None else files.join(log.select("event_type", "s3_key"), ["event_type", "s3_key"], "left_anti")


def admit(files: DataFrame, cap: int = MAX_FILES_PER_TRIGGER) -> tuple[DataFrame, DataFrame]:
    """``(admitted, per type)``: at most ``cap`` files a type, newest hour first, and how many stay behind."""
    batch, totals = L.cap_per_type(files, cap, order=[F.col("hour_start").desc(), F.col("s3_key")])
    return batch.drop("rn"), totals.select("event_type", F.col("total").alias("waiting"),
                                           (F.col("total") - F.col("deferred")).alias("admitted"), "deferred")


def _open_tick(spark: SparkSession, warehouse: str) -> tuple[int, bool]:
    """``(tick, begun)``: the tick to run, and whether it was admitted already but never logged."""
    ids = {what: {int(n[5:]) for n in names_in(spark, f"{warehouse}/{what}") if n.startswith("tick=")} for what in ("_admitted", "_done")}
    left = ids["_admitted"] - ids["_done"]
    return (min(left), True) if left else (max(ids["_done"], default=-1) + 1, False)


def run_tick(spark: SparkSession, root: str, warehouse: str, registry: dict | None = None, cap: int = MAX_FILES_PER_TRIGGER,
             pattern: str = "*.jsonl", **tick_kwargs) -> int | None:
    """List, admit and load one tick; its number, or None if no file waits."""
    tick, begun = _open_tick(spark, warehouse)
    admitted = f"{warehouse}/_admitted/tick={tick}"
    if not begun:
        files, per_type = admit(waiting(list_files(spark, root, pattern), read_table(spark, f"{warehouse}/_load_log")), cap)
        files = files.checkpoint()
        if files.isEmpty():
            return None
        per_type.write.mode("overwrite").parquet(f"{warehouse}/_deferred/tick={tick}")
        files.write.mode("overwrite").parquet(admitted)
    paths = [r["path"] for r in spark.read.parquet(admitted).select("path").collect()]      # at most cap x types names
    load_tick(read_files(spark, paths, root, pattern), tick, warehouse, registry, **tick_kwargs)
    _log_unlogged(spark, warehouse, tick, admitted)
    spark.createDataFrame([(tick,)], "n long").write.mode("overwrite").parquet(f"{warehouse}/_done/tick={tick}")
    return tick


def _log_unlogged(spark: SparkSession, warehouse: str, tick: int, admitted: str) -> None:
    """Files of the tick that no log row names (empty, malformed or unmapped ones) are done too."""
    path = f"{warehouse}/_load_log"
    log, files = read_table(spark, path), spark.read.parquet(admitted)
    rest = files if log is None else files.join(log.filter(F.col("tick") == tick).select("s3_key"), "s3_key", "left_anti")
    rows = L.log_rows(rest.select("event_type", "s3_key", F.lit(0).alias("row_count"), "bytes"), str(tick), F.current_timestamp())
    rows = rows.withColumn("tick", F.lit(tick)).checkpoint()
    rows.write.mode("append").partitionBy("tick").parquet(path)


def drain(spark: SparkSession, root: str, warehouse: str, registry: dict | None = None, **kwargs) -> list[int]:
    """Ticks until no file waits."""
    ticks = []
    while (tick := run_tick(spark, root, warehouse, registry, **kwargs)) is not None:
        ticks.append(tick)
    return ticks


def move_file(spark: SparkSession, source: str, target: str) -> None:
    """Copy, then delete; stopped anywhere and run again it leaves one whole copy at ``target``."""
    (fs, a), (to, b) = hadoop(spark, source), hadoop(spark, target)
    if not to.exists(b):
        half = spark._jvm.org.apache.hadoop.fs.Path(f"{target}.part")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, half, False, True, spark._jsc.hadoopConfiguration())
        to.rename(half, b)
    fs.delete(a, False)


def archive_loaded(spark: SparkSession, root: str, warehouse: str, archive: str) -> DataFrame:
    """SNK3: files of finished ticks move from ``root`` to the same place under ``archive``; ``tick, s3_key, outcome``.

    Runs after the commit, from what the ticks have admitted, so it never fails a
    load: a file that cannot be moved is logged as ``failed`` and tried again by
    the next run.
    """
    done, files = read_table(spark, f"{warehouse}/_done"), read_table(spark, f"{warehouse}/_admitted")
    log = read_table(spark, f"{warehouse}/_archive_log")
    if done is None or files is None:
        return spark.createDataFrame([], "tick long, s3_key string, outcome string")
    files = files.join(done.select("tick").distinct(), "tick", "left_semi")
    if log is not None:
        files = files.join(log.filter("outcome = 'moved'").select("s3_key"), "s3_key", "left_anti")
    base, rows = hadoop(spark, root)[0].makeQualified(hadoop(spark, root)[1]).toUri().getPath(), []
    for r in files.select("tick", "s3_key", "path").toLocalIterator():           # file names of the ticks since the last run
        try:
            inner = hadoop(spark, r["path"])[1].toUri().getPath()[len(base):]
            move_file(spark, r["path"], archive + inner)
            rows.append((r["tick"], r["s3_key"], "moved"))
        except Exception:  # noqa: BLE001 - counted and tried again
            rows.append((r["tick"], r["s3_key"], "failed"))
    out = spark.createDataFrame(rows, "tick long, s3_key string, outcome string")
    out.coalesce(1).write.mode("append").parquet(f"{warehouse}/_archive_log")
    return out


def start_ticks(spark: SparkSession, root: str, warehouse: str, checkpoint: str, registry: dict | None = None,
                trigger: str = DEFAULT_TRIGGER, **kwargs):
    """STR1: a tick at every trigger, whether or not new files came (a clock stream drives it)."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (clock.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=trigger)
                 .foreachBatch(lambda df, bid: run_tick(spark, root, warehouse, registry, **kwargs) and None).start())


def tick_metrics(spark: SparkSession, warehouse: str) -> DataFrame:
    """AGG1: per tick the files waiting, admitted, deferred, loaded and failed, rows loaded, unmapped and rejected, bytes, milliseconds."""
    ok = F.col("status") == "ok"
    sources = [
        (read_table(spark, f"{warehouse}/_deferred"), "tick", {f"files_{c}": F.sum(c) for c in ("waiting", "admitted", "deferred")}),
        (read_table(spark, f"{warehouse}/_load_log"), "tick",
         {"files_loaded": F.count_if(ok), "files_failed": F.count_if(~ok), "rows_loaded": F.sum(F.when(ok, F.col("row_count"))),
          "bytes_loaded": F.sum("bytes_loaded"), "duration_ms": F.max("copy_duration_ms")}),
        (read_table(spark, f"{warehouse}/_unmapped"), "load_batch", {"rows_unmapped": F.count(F.lit(1))}),
        (spark.read.json(f"{warehouse}/_rejects") if names_in(spark, f"{warehouse}/_rejects") else None, "load_batch", {"rows_rejected": F.count(F.lit(1))})]
    out = spark.createDataFrame([], "tick long")
    for df, by, sums in sources:
        if df is None or by not in df.columns:                 # nothing of the kind yet
            df = spark.createDataFrame([], "tick long, " + ", ".join(f"{name} long" for name in sums))
        else:
            df = df.groupBy(F.col(by).cast("long").alias("tick")).agg(*(x.cast("long").alias(name) for name, x in sums.items()))
        out = out.join(df, "tick", "full_outer")
    return out.select("tick", *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns[1:]))
