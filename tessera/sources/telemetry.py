"""OTLP-shaped logs and spans as input tables (SRC7).

The network receiver is not built; telemetry arrives as JSON/Parquet files
with the schemas below (attributes as ``map<string,string>``, span events
and links as arrays of structs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = ("timestamp string, level string, service string, message string, spineDepth int, "
              "spineRef struct<kind: string, id: string>, tenantId string, traceId string, spanId string, "
              "attributes map<string, string>")
SPAN_SCHEMA = ("timestamp string, traceId string, spanId string, parentSpanId string, name string, kind string, "
               "service string, startTimeNanos long, endTimeNanos long, durationNanos long, statusCode string, "
               "statusMessage string, attributes map<string, string>, "
               "events array<struct<timestamp: string, name: string, attributes: map<string, string>>>, "
               "links array<struct<traceId: string, spanId: string>>, spineDepth int, "
               "spineRef struct<kind: string, id: string>")


def read_telemetry(spark: SparkSession, path: str, kind: str = "logs", fmt: str = "json") -> DataFrame:
    """SRC7: logs or spans with a fixed schema and a typed ``ts`` column."""
    schema = LOG_SCHEMA if kind == "logs" else SPAN_SCHEMA
    df = spark.read.schema(schema).format(fmt).load(path)
    return df.withColumn("ts", F.try_to_timestamp(F.col("timestamp")))
