"""Stored files that really change: compaction, expiry and purge (DML6, DML8, DML9, DML11).

All three decide from the file listing or a small index which files of a
partitioned parquet folder change, rewrite only those in one Spark job into a
staging folder, and then swap files by rename.  The swap is planned on disk
before it begins; ``finish`` carries a plan through that a lost driver left, so
no row is lost or doubled.

    <root>/<partition folders>/*.parquet     the data
    <root>/_staging/<run>/                   rewritten files
    <root>/_plans/<run>/                     rows (folder, old, new): files to remove and to put in
    <root>/_tenants/                         which tenants a file holds, rows of each (``index_tenants``)
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

PLAN = "folder string, old string, new string"
ROLL_BYTES = 20 << 30                    # a day's files beyond this are left as they are
TARGET_BYTES = 256 << 20


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, folder, bytes`` and the partition columns of every data file, from the listing alone."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(root)
    parts = [c for c in found.columns if c not in ("path", "modificationTime", "length", "content")]
    return found.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("length").alias("bytes"), *parts)


def _rows_of(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """The rows of the listed files, with partition columns and ``_path``, the file's path as listed."""
    paths = [r["path"] for r in files.select("path").collect()]             # names of the files that change
    read = spark.read.option("basePath", root).parquet(*paths)
    return read.withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0))


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("_file", F.url_encode(F.regexp_extract("path", "[^/]*$", 0)))


def swap(spark: SparkSession, root: str, run: str, plan: DataFrame) -> None:
    """Write the plan down, then carry it through."""
    plan.coalesce(1).write.parquet(f"{root}/_plans/{run}")
    finish(spark, root)


def finish(spark: SparkSession, root: str) -> int:
    """Carry through every plan on disk; how many there were.

    New files come in under a name that readers skip, then the old ones go, then
    the new ones get their names.  Each step is done only where it is still open.
    """
    fs, plans = hadoop(spark, f"{root}/_plans")
    if not fs.exists(plans):
        return 0
    runs = sorted(s.getPath().getName() for s in fs.listStatus(plans))
    for run in runs:
        at = hadoop(spark, f"{root}/_plans/{run}")[1]
        if not fs.exists(hadoop(spark, f"{root}/_plans/{run}/_SUCCESS")[1]):
            fs.delete(at, True)                                              # never begun
            continue
        steps = spark.read.schema(PLAN).parquet(f"{root}/_plans/{run}").collect()
        path = spark._jvm.org.apache.hadoop.fs.Path
        put = [(path(r["new"]), path(f"{r['folder']}/_{run}-{k}.parquet"), path(f"{r['folder']}/{run}-{k}.parquet"))
               for k, r in enumerate(sorted((r for r in steps if r["new"]), key=lambda r: r["new"]))]
        for new, hidden, _ in put:
            if fs.exists(new):
                fs.rename(new, hidden)
        for r in steps:
            if r["old"]:
                fs.delete(path(r["old"]), False)
        for _, hidden, shown in put:
            if fs.exists(hidden):
                fs.rename(hidden, shown)
        for folder in {r["folder"] for r in steps}:
            if fs.exists(path(folder)) and not any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(path(folder))):
                fs.delete(path(folder), True)
        fs.delete(hadoop(spark, f"{root}/_staging/{run}")[1], True)
        fs.delete(at, True)
    return len(runs)


def _rewrite(spark: SparkSession, root: str, rows: DataFrame, parts: list[str], by: list[str], old: DataFrame) -> str:
    """Write ``rows`` dealt by ``by`` (one file each) into staging and swap them for the ``old`` files (``path, folder``)."""
    run = uuid.uuid4().hex
    staging = f"{root}/_staging/{run}"
    # a folder level of its own per file keeps one file per group, whatever task writes it
    key = F.concat_ws("-", *by)
    (rows.withColumn("_group", F.xxhash64(key)).repartition("_group", *parts).drop(*[c for c in by if c not in parts])
         .write.option("compression", "zstd").partitionBy(*parts, "_group").parquet(staging))
    written = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(staging).select("path")
    tail = F.regexp_replace(F.regexp_extract("path", f"/_staging/{run}(/.*)/[^/]*$", 1), "/_group=[^/]*$", "")
    new = written.select(F.concat(F.lit(root), tail).alias("folder"), F.lit(None).cast("string").alias("old"), F.col("path").alias("new"))
    gone = old.select("folder", F.col("path").alias("old"), F.lit(None).cast("string").alias("new"))
    swap(spark, root, run, gone.unionByName(new))
    return run


def small_files(files: DataFrame, closed: Column, target_bytes: int = TARGET_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """The files to merge, and the ``bin`` of at most about ``target_bytes`` each goes to: per folder, smallest first.

    ``closed`` selects folders that get no new files.  A folder over
    ``roll_bytes``, and one with a single small file, stays as it is.
    """
    in_folder = Window.partitionBy("folder")
    files = files.filter(closed).withColumn("_total", F.sum("bytes").over(in_folder)).filter(F.col("_total") <= roll_bytes)
    small = files.filter(F.col("bytes") < target_bytes // 2).withColumn("_n", F.count(F.lit(1)).over(in_folder)).filter("_n > 1")
    before = F.coalesce(F.sum("bytes").over(in_folder.orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return small.withColumn("bin", F.floor(before / target_bytes)).drop("_total", "_n")


def compact_files(spark: SparkSession, root: str, closed: Column, target_bytes: int = TARGET_BYTES, roll_bytes: int = ROLL_BYTES) -> int:
    """DML8: merge the small files of closed folders in place, folders kept; how many files were merged."""
    finish(spark, root)
    files = list_files(spark, root)
    parts = [c for c in files.columns if c not in ("path", "folder", "bytes")]
    small = materialize(small_files(files, closed, target_bytes, roll_bytes), "small-files")
    n = small.count()
    if n:
        rows = _rows_of(spark, root, small).join(_named(small).select("_file", *parts, "bin"), ["_file", *parts]).drop("_file")
        _rewrite(spark, root, rows, parts, [*parts, "bin"], small)
    return n


def drop_expired(spark: SparkSession, root: str, day: Column, keep_days: int, as_of, holds: DataFrame | None = None) -> DataFrame:
    """DML6/DML9: whole folders past retention are dropped by name, no row is read; ``folder, outcome`` (dropped, held, kept).

    ``day``: the folder's day, from partition columns.  ``holds``: rows of
    partition columns under legal hold; a folder that matches one stays.
    """
    files = list_files(spark, root)
    parts = [c for c in files.columns if c not in ("path", "folder", "bytes")]
    folders = files.select("folder", *parts).distinct()
    past = day.cast("date") < F.date_sub(F.lit(as_of).cast("date"), keep_days)
    if holds is None:
        held = folders.withColumn("_held", F.lit(False))
    else:
        on = [c for c in parts if c in holds.columns]
        held = folders.join(holds.select(*on).distinct().withColumn("_held", F.lit(True)), on, "left")
    out = materialize(held.select("folder", *parts, F.when(~past, "kept").when(F.coalesce("_held", F.lit(False)), "held").otherwise("dropped").alias("outcome")), "expiry")
    for r in out.filter("outcome = 'dropped'").select("folder").collect():       # names of folders
        fs, p = hadoop(spark, r["folder"])
        fs.delete(p, True)
    return out


def index_tenants(spark: SparkSession, root: str, tenant: str = "tenant_id") -> DataFrame:
    """``_file, <partition columns>, tenant, rows``: kept beside the data, made anew for files it does not know."""
    files = _named(list_files(spark, root))
    parts = [c for c in files.columns if c not in ("path", "folder", "bytes", "_file")]
    path = f"{root}/_tenants"
    fs, p = hadoop(spark, path)
    known = spark.read.parquet(path) if fs.exists(p) else None
    fresh = files if known is None else files.join(known.select("_file", *parts).distinct(), ["_file", *parts], "left_anti")
    fresh = materialize(fresh, "unindexed")
    if not fresh.isEmpty():
        rows = _rows_of(spark, root, fresh).groupBy("_file", *parts, F.col(tenant).alias("tenant")).agg(F.count(F.lit(1)).alias("rows"))
        rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(files.select("_file", "path", "folder", *parts), ["_file", *parts])


def purge_files(spark: SparkSession, root: str, tenants: DataFrame, held: Column | None = None, tenant: str = "tenant_id") -> DataFrame:
    """DML11: the rows of ``tenants`` (one column) leave the stored files; ``path, outcome, rows, purged``.

    The index names the files that hold one of the tenants; only those are read
    and rewritten.  Rows for which ``held`` is true stay (legal hold).  Outcomes:
    ``kept`` (not touched), ``rewritten``, ``dropped`` (nothing was left).
    """
    finish(spark, root)
    gone = tenants.toDF("tenant").distinct().withColumn("_gone", F.lit(True))
    index = index_tenants(spark, root, tenant)
    parts = [c for c in index.columns if c not in ("_file", "path", "folder", "tenant", "rows")]
    files = materialize(index.join(gone, "tenant", "left").groupBy("_file", "path", "folder", *parts).agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(F.col("_gone"), F.col("rows"))), F.lit(0)).alias("_hit")), "purge-files")
    hit = files.filter("_hit > 0")
    report = files.select("_file", *parts, "path", "rows")
    if hit.isEmpty():
        return report.select("path", *parts, F.lit("kept").alias("outcome"), "rows", F.lit(0).cast("long").alias("purged"))
    rows = _rows_of(spark, root, hit)
    leaves = F.coalesce("_gone", F.lit(False)) & (F.lit(True) if held is None else ~F.coalesce(held, F.lit(False)))
    left = rows.join(gone.withColumnRenamed("tenant", tenant), tenant, "left").withColumn("_leaves", leaves)
    left = materialize(left.filter("NOT _leaves").drop("_gone", "_leaves").select(*rows.columns), "purged")
    after = left.groupBy("_file", *parts).agg(F.count(F.lit(1)).alias("left"))
    out = report.join(after, ["_file", *parts], "left").join(hit.select("_file", *parts, F.lit(True).alias("_touched")), ["_file", *parts], "left")
    stay = F.when(F.col("_touched"), F.coalesce("left", F.lit(0))).otherwise(F.col("rows"))
    out = materialize(out.select("path", *parts, F.when(stay == F.col("rows"), "kept").when(stay == 0, "dropped").otherwise("rewritten").alias("outcome"),
                                 "rows", (F.col("rows") - stay).alias("purged")), "purge-report")
    changed = hit.join(out.filter("outcome <> 'kept'").select("path"), "path", "left_semi")
    keep = left.join(changed.select("_file", *parts), ["_file", *parts], "left_semi")
    _rewrite(spark, root, keep, parts, ["_file"], changed)
    return out
