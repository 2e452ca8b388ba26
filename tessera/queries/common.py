"""Shared derivations from the test tables (Spark side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hour_key
from ..session import table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def envelopes(spark, sf_dir):
    """Events as event envelopes: id/time/type/tenant/case + JSON ``data``."""
    ev = events(spark, sf_dir)
    data = F.to_json(F.struct(
        F.col("value").alias("amount"), F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").cast("int").alias("k")))
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("string").alias("time"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("t"), F.floor(F.col("user_id") / 10).cast("string")).alias("tenantid"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("caseid"),
        data.alias("data"))


def bronze_files(ev):
    """Files a writer rolling every 10 minutes would have produced, with row counts."""
    return (ev.withColumn("s3_key", file_key(F.col("event_type"), F.col("ts")))
              .groupBy("event_type", "s3_key")
              .agg(F.count(F.lit(1)).alias("row_count"),
                   F.date_trunc("hour", F.min("ts")).alias("hour_start"),
                   F.dayofmonth(F.min("ts")).alias("day")))


def file_key(event_type, ts):
    part = F.lpad(F.floor(F.minute(ts) / 10).cast("string"), 2, "0")
    return F.concat(hour_key(event_type, ts), F.lit("part-"), part, F.lit(".jsonl"))
