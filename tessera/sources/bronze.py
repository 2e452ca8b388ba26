"""Bronze event files: hive-partitioned JSONL (SRC1-SRC6, SNK3, SNK7).

Layout: ``<root>/event_type=X/year=YYYY/month=MM/day=DD/hour=HH/<uuid>.jsonl``.
Reading goes through Spark's file source with an explicit schema, so
partition discovery gives ``event_type/year/month/day/hour`` columns and
predicates on them prune directories before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import minus_hours

ENVELOPE_STRUCT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("time", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("tenantid", T.StringType()),
    T.StructField("caseid", T.StringType()), T.StructField("data", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])
PARTITION_COLS = ("event_type", "year", "month", "day", "hour")
BRONZE_SCHEMA = T.StructType(ENVELOPE_STRUCT.fields + [
    T.StructField("event_type", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()), T.StructField("day", T.IntegerType()),
    T.StructField("hour", T.IntegerType()),
])


def _reader(spark: SparkSession, root: str, pattern: str = "*.jsonl"):
    return (spark.read.schema(BRONZE_SCHEMA)
            .option("basePath", root)
            .option("pathGlobFilter", pattern)            # SRC2: only .jsonl objects
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("recursiveFileLookup", "false"))


def read_bronze(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """SRC1/SRC6: envelopes + partition columns + per-row source file and its size."""
    return with_file(_reader(spark, root, pattern).json(root))


def with_file(df: DataFrame) -> DataFrame:
    """``df`` plus the file a row stands in and that file's bytes."""
    return df.withColumns({"s3_key": F.col("_metadata.file_path"), "s3_bytes": F.col("_metadata.file_size")})


def read_files(spark: SparkSession, paths, root: str | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """SRC5: an explicit manifest; every listed file must exist (missing => error)."""
    r = _reader(spark, root, pattern) if root else spark.read.schema(ENVELOPE_STRUCT)
    return with_file(r.option("ignoreMissingFiles", "false").json(list(paths)))


def hour_ts(df_or_none=None) -> Column:
    """Hour partition as a timestamp (built only from partition columns => prunable)."""
    return F.make_timestamp(F.col("year"), F.col("month"), F.col("day"), F.col("hour"),
                            F.lit(0), F.lit(0))


def lookback_filter(ts: Column, as_of, hours: int = 2) -> Column:
    """SRC4: current hour of ``as_of`` and the ``hours`` hours before it (3 by default)."""
    top = F.date_trunc("hour", F.lit(as_of).cast("timestamp_ntz"))
    lo = minus_hours(top, hours)
    hi = top + F.expr("INTERVAL 1 HOURS")
    return (ts >= lo) & (ts < hi)


def lookback(df: DataFrame, as_of, hours: int = 2) -> DataFrame:
    """SRC4 on a bronze frame: the predicate uses partition columns only, so the
    scan lists and reads just ``hours + 1`` hour directories per event type."""
    return df.filter(lookback_filter(hour_ts().cast("timestamp_ntz"), as_of, hours))


def late_report(df: DataFrame, as_of, hours: int = 2, ts: Column | None = None) -> DataFrame:
    """STR2: rows outside the lookback window, reported per event type and hour
    instead of being silently skipped (the stream itself reads them)."""
    t = ts if ts is not None else hour_ts().cast("timestamp_ntz")
    top = minus_hours(F.date_trunc("hour", F.lit(as_of).cast("timestamp_ntz")), hours)
    return (df.filter(t < top).groupBy("event_type", F.date_trunc("hour", t).alias("hour"))
              .agg(F.count(F.lit(1)).alias("late_rows")))


def list_event_types(df: DataFrame) -> DataFrame:
    """SRC3: event types present; answered from partition values (metadata)."""
    return df.select("event_type").distinct()


def split_corrupt(df: DataFrame) -> tuple:
    """Q14/SNK7: (good rows, rejected rows with error_type) instead of failing the batch.

    Spark refuses raw-JSON scans that read nothing but the corrupt-record
    column, so pass a persisted or written frame (the loader tick writes its batch).
    """
    bad = df.filter(F.col("_corrupt_record").isNotNull())
    good = df.filter(F.col("_corrupt_record").isNull())
    rejects = bad.select(
        "_corrupt_record", "s3_key",
        F.coalesce(F.col("event_type"), F.lit("unknown")).alias("event_type"),
        F.lit("malformed_json").alias("error_type"),
        F.current_date().alias("reject_date"))
    return good, rejects


def write_rejects(rejects: DataFrame, path: str) -> None:
    """SNK7: reject sink partitioned by date and error type."""
    rejects.write.mode("append").partitionBy("reject_date", "error_type").json(path)
