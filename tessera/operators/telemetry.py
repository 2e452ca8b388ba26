"""Log/trace pipeline and audit archive (PRJ7-10, FIL3, FIL4, SNK4-8, DML8).

Records carry ``attributes: map<string,string>``; every processor is a
map-valued Column expression (``map_filter``/``map_concat``), so a chain of
processors is a single Project in one codegen stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_index
from ..plans.observability import (AUDIT_MESSAGES, AUDIT_SERVICES, ID_FIELD_RE, ID_IGNORE_ABOVE,
                                   LLM_INDEX_PREFIX, LLM_SPAN_RE, LOG_INDEX_PREFIX, MESSAGE_RAW_IGNORE_ABOVE, REDACT_KEYS,
                                   RESOURCE_NAMESPACE, TENANT_ATTR, TENANT_DEFAULT)


def redact(attrs: Column, keys=REDACT_KEYS) -> Column:
    """PRJ7: delete sensitive keys from an attribute map."""
    ks = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(attrs, lambda k, v: ~F.array_contains(ks, k))


def default_attr(attrs: Column, key: str = TENANT_ATTR, value: str = TENANT_DEFAULT) -> Column:
    """PRJ8: insert ``key=value`` only when absent (never overwrites)."""
    attrs = F.coalesce(attrs, F.create_map().cast("map<string,string>"))
    return F.when(~F.map_contains_key(attrs, F.lit(key)),
                  F.map_concat(attrs, F.create_map(F.lit(key), F.lit(value)))).otherwise(attrs)


def upsert_attrs(attrs: Column, consts: dict) -> Column:
    """PRJ9: always-overwrite attributes: drop the same keys, then concatenate.

    (``map_concat`` alone raises DUPLICATED_MAP_KEY under the default policy.)
    """
    keys = F.array(*[F.lit(k) for k in consts])
    kept = F.map_filter(F.coalesce(attrs, F.create_map().cast("map<string,string>")),
                        lambda k, v: ~F.array_contains(keys, k))
    new = F.create_map(*[F.lit(x) for kv in consts.items() for x in kv])
    return F.map_concat(kept, new)


def resource_attrs(environment: str, cluster: str) -> dict:
    return {"service.namespace": RESOURCE_NAMESPACE, "deployment.environment": environment,
            "cluster.name": cluster}


def clean(df: DataFrame, environment: str, cluster: str, attrs: str = "attributes",
          redact_keys=REDACT_KEYS) -> DataFrame:
    """Processor chain of the logs/traces pipelines: redact -> tenant default -> resource upsert."""
    a = F.col(attrs)
    if redact_keys:
        a = redact(a, redact_keys)
    a = default_attr(a)
    a = upsert_attrs(a, resource_attrs(environment, cluster))
    return df.withColumn(attrs, a)


def is_llm_span(name: Column) -> Column:
    """FIL3: name matches ``LLM_SPAN_RE``; evaluation errors (NULL) drop."""
    return F.coalesce(name.rlike(LLM_SPAN_RE), F.lit(False))


def llm_spans(spans: DataFrame, name: str = "name") -> DataFrame:
    return spans.filter(is_llm_span(F.col(name)))


def audit_decisions(logs: DataFrame, services=AUDIT_SERVICES, messages=AUDIT_MESSAGES) -> DataFrame:
    """FIL4: decision messages from the subscribed services."""
    return logs.filter(F.col("message").isin(*messages) & F.col("service").isin(*services))


def archive_layout(df: DataFrame, env: str, ts: str = "ts") -> DataFrame:
    """SNK6 partition columns ``env/year/month/day`` (UTC)."""
    return (df.withColumn("env", F.lit(env))
              .withColumn("year", F.date_format(ts, "yyyy"))
              .withColumn("month", F.date_format(ts, "MM"))
              .withColumn("day", F.date_format(ts, "dd")))


def archive_audit(df: DataFrame, path: str, env: str, ts: str = "ts", max_records_per_file: int = 500000) -> None:
    """SNK6: gzip JSON archive partitioned by env/year/month/day.

    Range-partitioning on (partition columns, ts) gives each writer task a
    contiguous slice: few files per task, and one busy day is cut over as
    many tasks as its size needs (hash-partitioning by day would put the
    whole day in one task).  ``maxRecordsPerFile`` bounds file size (the
    delivery stream's 5 MB buffer analogue).
    """
    out = archive_layout(df, env, ts)
    (out.repartitionByRange("env", "year", "month", "day", ts).write.mode("append")
        .option("compression", "gzip").option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("env", "year", "month", "day").json(path))


def with_index(df: DataFrame, prefix: str = LOG_INDEX_PREFIX, attrs: str = "attributes", ts: str = "ts") -> DataFrame:
    """FN15/SNK4: tenant + day partition columns and the index name."""
    tenant = F.coalesce(F.col(attrs)[TENANT_ATTR], F.lit(TENANT_DEFAULT))
    return (df.withColumn("tenant_id", tenant)
              .withColumn("day", F.date_format(ts, "yyyy.MM.dd"))
              .withColumn("index_name", day_index(prefix, tenant, F.col(ts))))


def write_telemetry(df: DataFrame, path: str, prefix: str = LOG_INDEX_PREFIX, ts: str = "ts", batch: int | None = None) -> None:
    """SNK4: sink in a folder a day, each day's rows laid out by tenant.

    Range-partitioned and sorted by (day, tenant, ts): a tenant's day stands in
    one run of rows, which readers find by the column's bounds in the files, and
    a tenant-day holding a third of all rows is cut over many tasks.  The number
    of files follows the bytes and the days, not tenants times days (a folder
    per tenant and day holds a few rows a file).  With ``batch`` (a micro-batch
    id) its rows are a partition of their own under each day, and writing the
    batch again replaces them; without it rows are appended.
    """
    rows, parts = with_index(df, prefix, ts=ts), ["day"]
    if batch is not None:
        rows, parts = rows.withColumn("batch", F.lit(int(batch))), [*parts, "batch"]
    (rows.repartitionByRange("day", "tenant_id", ts).sortWithinPartitions(*parts, "tenant_id", ts)
        .write.mode("append" if batch is None else "overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(path))


def tee(df: DataFrame, main_path: str, llm_path: str, name: str = "name", ts: str = "ts", batch: int | None = None) -> None:
    """SNK5: main sink + filtered LLM sub-stream from one persisted input (foreachBatch body)."""
    df = df.persist()
    try:
        write_telemetry(df, main_path, ts=ts, batch=batch)
        write_telemetry(llm_spans(df, name), llm_path, prefix=LLM_INDEX_PREFIX, ts=ts, batch=batch)
    finally:
        df.unpersist()


def type_ids(df: DataFrame, pattern: str = ID_FIELD_RE, ignore_above: int = ID_IGNORE_ABOVE) -> DataFrame:
    """PRJ10: columns whose name matches the id regex become exact-match strings;
    a ``<col>_keyword`` copy is NULL above ``ignore_above`` characters."""
    rx = re.compile(pattern)
    out = []
    for c in df.columns:
        if rx.search(c):
            s = F.col(c).cast("string")
            out += [s.alias(c), F.when(F.length(s) <= ignore_above, s).alias(f"{c}_keyword")]
        else:
            out.append(F.col(c))
    return df.select(*out)


def attribute_names(df: DataFrame, attrs: str, pattern: str = ID_FIELD_RE) -> list[str]:
    """PRJ10: the attribute names that occur in a JSON column and match the name rule."""
    keys = df.select(F.explode(F.json_object_keys(attrs)).alias("name")).filter(F.col("name").rlike(pattern)).distinct()
    return sorted(r["name"] for r in keys.collect())                   # names that the rule knows, not values


def type_attributes(df: DataFrame, attrs: str = "attributes", pattern: str = ID_FIELD_RE, ignore_above: int = ID_IGNORE_ABOVE) -> DataFrame:
    """PRJ10 for attributes not known beforehand: ``df`` with ``attrs`` as VARIANT and a column per id attribute found.

    An attribute whose name matches ``pattern`` becomes an exact-match string
    column plus its ``_keyword`` copy (NULL above ``ignore_above`` characters);
    all others stay in the VARIANT with their own types, readable by path.
    Text that is no JSON object gives NULLs.  An attribute called like a column
    of ``df`` stays in the VARIANT only.
    """
    taken = {c.lower() for c in df.columns}
    names = [n for n in attribute_names(df, attrs, pattern) if n.lower() not in taken]
    rows = df.withColumn(attrs, F.try_parse_json(F.col(attrs)))
    out = []
    for n in names:
        path = "$['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']"
        s = F.try_variant_get(F.col(attrs), path, "string")
        out += [s.alias(n), F.when(F.length(s) <= ignore_above, s).alias(f"{n}_keyword")]
    return rows.select("*", *out)


def message_raw(message: Column, limit: int = MESSAGE_RAW_IGNORE_ABOVE) -> Column:
    """PRJ10: keyword copy of ``message`` kept only up to ``limit`` characters."""
    return F.when(F.length(message) <= limit, message)


def compact(spark, path: str, out_path: str, target_file_bytes: int = 256 << 20) -> None:
    """DML8: rewrite one folder of files into few large ones elsewhere.

    The file count is derived from the folder's size in the file listing; the
    rewrite is one shuffle into that many files.  ``storage.compact_files``
    merges the small files of partitioned folders in place.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    n = max(1, int(-(-size // target_file_bytes)))
    spark.read.parquet(path).repartition(n).write.mode("overwrite").option("compression", "zstd").parquet(out_path)
