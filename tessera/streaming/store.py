"""Where a tick writes its fact tables: in place, or as a snapshot that becomes visible at once (DML5, STR3).

``Snapshot`` writes every partition that a tick adds or rewrites to a folder of
its own and lists it in a manifest.  Renaming the manifest's folder to
``_snapshots/v=<tick>`` is the commit: before it readers see none of the tick,
after it all of it, in every table.  A tick that stopped half-way leaves folders
no manifest names; its replay overwrites them.

    _data/<table>/tick=<id>-<step>/load_batch=<n>/   partitions, never changed once written
    _snapshots/v=<id>/                               rows (table, load_batch, path) that tick <id> set
    _snapshots/v=<id>-full/                          the same with all partitions, every FULL_EVERY ticks

Side tables (load log, pending, retry, unmapped, rejects) are written per tick;
``read_snapshot`` shows of them what committed ticks wrote.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyfilter
from ..session import materialize, scratch

FULL_EVERY = 50
MANIFEST = "table string, load_batch long, path string, v long"


def hadoop(spark: SparkSession, path: str):
    """``(file system, path)`` of a path, whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; nothing if it does not exist."""
    fs, p = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """Existing parquet table (with its partition columns) or None if nothing was written yet.

    Only a missing path or a folder without files counts as nothing; any other
    read error is raised, so it can never be taken for an empty table.
    """
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def write_batch_partition(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("load_batch", F.lit(int(batch_id))).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("load_batch").parquet(path))


class InPlace:
    """Partitions of ``<warehouse>/<table>`` are overwritten one table after the other."""

    def __init__(self, spark: SparkSession, warehouse: str, batch_id: int):
        self.spark, self.warehouse, self.batch_id = spark, warehouse, int(batch_id)

    def committed(self) -> bool:
        return False

    def read(self, table: str) -> DataFrame | None:
        return read_table(self.spark, f"{self.warehouse}/{table}")

    def batches(self, table: str) -> set[int]:
        return {int(n.split("=", 1)[1]) for n in names_in(self.spark, f"{self.warehouse}/{table}") if n.startswith("load_batch=")}

    def add(self, df: DataFrame, table: str) -> None:
        """The tick's own new partition."""
        write_batch_partition(df, f"{self.warehouse}/{table}", self.batch_id)

    def settled(self, df: DataFrame, keep) -> DataFrame:
        """Rows to rewrite, computed before the partitions they come from are overwritten."""
        return keep(df, "rewritten")

    def rewrite(self, df: DataFrame, table: str) -> None:
        """Partitions (``load_batch``) that the tick changes."""
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_batch")
           .parquet(f"{self.warehouse}/{table}"))

    def commit(self) -> None:
        pass


def snapshot_versions(spark: SparkSession, warehouse: str) -> dict[int, str]:
    """Committed ticks and the names of their manifests."""
    names = [n for n in names_in(spark, f"{warehouse}/_snapshots") if n.startswith("v=")]
    return {int(n[2:].split("-", 1)[0]): n for n in names}


def manifest(spark: SparkSession, warehouse: str, as_of: int | None = None) -> DataFrame:
    """``table, load_batch, path, v``: the live partitions after tick ``as_of`` (default: the last committed one)."""
    known = {v: n for v, n in snapshot_versions(spark, warehouse).items() if as_of is None or v <= as_of}
    start = max((v for v, n in known.items() if n.endswith("-full")), default=min(known, default=0))
    paths = [f"{warehouse}/_snapshots/{n}" for v, n in sorted(known.items()) if v >= start]
    if not paths:
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(*paths)
    return rows.groupBy("table", "load_batch").agg(F.max_by("path", "v").alias("path"), F.max("v").alias("v"))


class Snapshot:
    """The warehouse as the last committed tick left it, with what this tick has staged on top."""

    def __init__(self, spark: SparkSession, warehouse: str, batch_id: int):
        self.spark, self.warehouse, self.batch_id = spark, warehouse, int(batch_id)
        self.live = manifest(spark, warehouse, self.batch_id - 1)
        self.staged: dict[tuple[str, int], str] = {}
        self.step = 0

    def committed(self) -> bool:
        return self.batch_id in snapshot_versions(self.spark, self.warehouse)

    def _paths(self, table: str) -> dict[int, str]:
        """Folders of a table's partitions (one short row each)."""
        rows = self.live.filter(F.col("table") == table).select("load_batch", "path").collect()
        own = {b: p for (t, b), p in self.staged.items() if t == table}
        return {**{r["load_batch"]: f"{self.warehouse}/{r['path']}" for r in rows}, **own}

    def read(self, table: str) -> DataFrame | None:
        paths = list(self._paths(table).values())
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.warehouse}/_data/{table}").parquet(*paths).drop("tick")

    def batches(self, table: str) -> set[int]:
        return set(self._paths(table))

    def add(self, df: DataFrame, table: str) -> None:
        self.rewrite(df.withColumn("load_batch", F.lit(self.batch_id)), table)

    def settled(self, df: DataFrame, keep) -> DataFrame:
        return df                                    # nothing is overwritten

    def rewrite(self, df: DataFrame, table: str) -> None:
        self.step += 1
        root = f"{self.warehouse}/_data/{table}/tick={self.batch_id}-{self.step}"
        df.write.mode("overwrite").partitionBy("load_batch").parquet(root)
        for n in names_in(self.spark, root):
            if n.startswith("load_batch="):
                self.staged[table, int(n.split("=", 1)[1])] = f"{root}/{n}"

    def commit(self) -> None:
        """Write the manifest beside its place and rename it there."""
        rows = [(t, b, p[len(self.warehouse) + 1:], self.batch_id) for (t, b), p in sorted(self.staged.items())]
        new = self.spark.createDataFrame(rows, MANIFEST)
        known = snapshot_versions(self.spark, self.warehouse)
        full = [v for v, n in known.items() if n.endswith("-full") and v < self.batch_id]
        name = f"v={self.batch_id}"
        if len([v for v in known if v > max(full, default=-1)]) >= FULL_EVERY:
            name += "-full"
            new = self.live.join(new, ["table", "load_batch"], "left_anti").select("table", "load_batch", "path", "v").unionByName(new)
        side = f"{self.warehouse}/_snapshots/.writing-{name}"
        new.coalesce(1).write.mode("overwrite").parquet(side)
        fs, source = hadoop(self.spark, side)
        if not fs.rename(source, hadoop(self.spark, f"{self.warehouse}/_snapshots/{name}")[1]):
            raise RuntimeError(f"commit of tick {self.batch_id} failed: cannot rename {side}")


def read_snapshot(spark: SparkSession, warehouse: str, table: str, as_of: int | None = None) -> DataFrame | None:
    """A table as the last committed tick (or tick ``as_of``) left it; None if it has no rows yet.

    Side tables (names with a leading underscore) show the rows of ticks up to that one.
    """
    ticks = [v for v in snapshot_versions(spark, warehouse) if as_of is None or v <= as_of]
    if not ticks:
        return None
    if not table.startswith("_"):
        return Snapshot(spark, warehouse, max(ticks) + 1).read(table)
    rows = read_table(spark, f"{warehouse}/{table}")
    if rows is None:
        return None
    return rows.filter(F.col("tick" if "tick" in rows.columns else "load_batch") <= max(ticks))


# --------------------------------------------------------------------------
# Which partitions may hold a merge key (JN1, DML1, STR12)
# --------------------------------------------------------------------------

def write_key_index(rows: DataFrame, key: str, path: str, batch_id: int) -> None:
    """The index of one partition: its keys' Bloom filter, smallest and largest key.

    It stays right when a MERGE rewrites the partition, which never changes keys.
    """
    with scratch(rows.sparkSession, "key-index") as keep:
        keys = keep(rows.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct(), "merge-keys")
        n, lo, hi = keys.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
        bits = keyfilter.sized_bits(n)
        blocks = keyfilter.filter_rows(keys, "key", bits)
        if n == 0:                                       # known to hold no key
            blocks = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("block"), *(F.lit(0).alias(w) for w in keyfilter.WORDS))
        out = blocks.select("*", F.lit(bits).alias("bits"), F.lit(lo).cast("string").alias("lo"), F.lit(hi).cast("string").alias("hi"))
        write_batch_partition(out, path, batch_id)


def partitions_to_open(spark: SparkSession, path: str, keys: DataFrame, key: str, stored: set[int]) -> set[int]:
    """The partitions of ``stored`` that may hold one of ``keys``: those the index names, and those it does not cover.

    The smallest and largest key prune the index while it is read; what is left
    is joined on (filter size, block).  Only partition numbers come to the driver.
    """
    index = read_table(spark, path)
    if index is None:
        return stored
    indexed = {int(n.split("=", 1)[1]) for n in names_in(spark, path) if n.startswith("load_batch=")}
    with scratch(spark, "asked-keys") as keep:
        asked = keep(keys.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct(), "keys")
        lo, hi = asked.agg(F.min("key"), F.max("key")).first()
        if lo is None:
            return stored - indexed
        index = index.filter((F.col("lo") <= hi) & (F.col("hi") >= lo))
        sizes = [r["bits"] for r in index.select("bits").distinct().collect()]               # at most MAX_BITS numbers
        if not sizes:
            return stored - indexed
        asked = asked.withColumn("bits", F.explode(F.array(*map(F.lit, sizes))))
        hit = keyfilter.may_hold(asked, "key", index).filter("key BETWEEN lo AND hi").select("load_batch").distinct().collect()
        return (stored - indexed) | ({r["load_batch"] for r in hit} & stored)


# --------------------------------------------------------------------------
# Repeats of an event in a later tick (WIN1, STR3)
# --------------------------------------------------------------------------

HOUR_BITS = 12                                       # blocks of an hour's filter: 65,536 events at 16 a block, fuller ones cost time only


def drop_seen(rows: DataFrame, path: str, batch_id: int, key: str = "id", time: str = "time", bits: int = HOUR_BITS) -> DataFrame:
    """WIN1 across ticks: the first row of every (event id, event hour) that no earlier tick has taken.

    One filter an event hour; only ids that pass it are looked up in the ids
    stored for those hours.  Late events stay however late they are, rows without
    an id pass, a replayed tick reads what its first run read.  Only the days
    that the tick's events lie in are read.

        <path>/ids/day=<yyyymmdd>/load_batch=<id>      the ids taken, with their hour
        <path>/filters/day=<yyyymmdd>/load_batch=<id>  the rows of the hours' filters
    """
    spark = rows.sparkSession
    hour = F.coalesce(F.date_format(F.try_to_timestamp(F.col(time)), "yyyyMMddHH"), F.lit("none"))
    rows = materialize(rows.withColumn("_hour", hour), "tick-rows")
    ids = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("_hour").alias("hour")).distinct()
    ids = materialize(ids, "tick-ids")
    hours = [r["hour"] for r in ids.select("hour").distinct().collect()]                   # hours, not events
    days = sorted({h[:8] for h in hours})

    def stored(what):
        df = read_table(spark, f"{path}/{what}")
        return None if df is None else df.filter(
            F.col("day").cast("string").isin(days) & (F.col("load_batch") < int(batch_id)) & F.col("hour").isin(hours))
    new, filters = ids, stored("filters")
    if filters is not None:
        merged = filters.groupBy("hour", "block").agg(*(F.bit_or(w).alias(w) for w in keyfilter.WORDS))
        hits = materialize(keyfilter.may_hold(ids, "key", merged, on=("hour",), bits=bits), "seen-maybe")
        if not hits.isEmpty():
            seen = hits.join(stored("ids").select("key", "hour"), ["key", "hour"], "left_semi")
            new = materialize(ids.join(seen, ["key", "hour"], "left_anti"), "tick-new-ids")
    for what, df in (("ids", new), ("filters", keyfilter.filter_rows(new, "key", bits, by=("hour",)))):
        # few files a day, more where a day is large
        (df.withColumns({"day": F.substring("hour", 1, 8), "load_batch": F.lit(int(batch_id))}).hint("rebalance", "day")
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "load_batch").parquet(f"{path}/{what}"))
    keyed = rows.filter(F.col(key).isNotNull()).join(new.select(F.col("key").alias(key), F.col("hour").alias("_hour")), [key, "_hour"], "left_semi")
    cols = [c for c in rows.columns if c not in (key, "_hour")]
    first = keyed.groupBy(key, "_hour").agg(F.min_by(F.struct(*cols), F.struct(time, *[c for c in cols if c != time])).alias("_r")).select(key, "_r.*")
    return first.unionByName(rows.filter(F.col(key).isNull()).select(*first.columns))
