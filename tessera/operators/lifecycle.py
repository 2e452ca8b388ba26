"""Retention, tiering, tenant export/purge/anonymise, integrity checks (DML6-12, AGG17, AGG18).

Rule tables (buckets, lifecycles) are small; Catalyst broadcasts them by
their size.  The data side is filtered where it lies.  When the data is partitioned by day,
expiry drops whole partitions (``operators.storage.drop_expired``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Bucket lifecycle (expire / infrequent-access / archive days),
# object-lock retention, tenant deletion grace, anonymised-audit retention.
# ---------------------------------------------------------------------------
BUCKET_RULES = (
    # bucket, expire_days, ia_days, glacier_days, lock_days
    ("documents", 365, 30, 90, None),
    ("evidence", None, 30, 90, 2555),
    ("exports", 90, None, None, None),
    ("assets", 180, 30, None, None),
    ("alb-logs", 90, 30, None, None),
)
RULES_SCHEMA = "bucket string, expire_days int, ia_days int, glacier_days int, lock_days int"
TENANT_GRACE_DAYS = 30
AUDIT_RETENTION_YEARS = 7
# The other stores: search indices, event files, operations events, audit archive and exports.
STORE_RULES = (
    ("logs", 15, None, None, None),
    ("traces", 14, None, None, None),
    ("bronze", 30, None, None, None),
    ("ops-events", 730, 30, 90, None),
    ("audit-archive", 2555, None, 90, 2555),
    ("audit-archive-nonprod", 2555, None, 90, 90),
    ("audit-exports", 2555, 30, None, None),
)
# ---------------------------------------------------------------------------


def rules_frame(spark, rules=BUCKET_RULES + STORE_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULES_SCHEMA)


def _age_days(ts: str, as_of) -> F.Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col(ts).cast("date"))


def expire(df: DataFrame, rules: DataFrame, as_of, ts: str = "created_at", bucket: str = "bucket",
           locked_until: str | None = "locked_until") -> DataFrame:
    """DML6 + DML9: drop rows older than their bucket's ``expire_days`` unless locked.

    A row is locked (legal hold / object lock) while ``locked_until > as_of``
    or while its age is below the bucket's ``lock_days``.
    """
    j = df.join(rules.select(F.col("bucket").alias(bucket), "expire_days", "lock_days"), bucket, "left")
    age = _age_days(ts, as_of)
    held = F.coalesce(age < F.col("lock_days"), F.lit(False))
    if locked_until and locked_until in df.columns:
        held = held | F.coalesce(F.col(locked_until) > F.lit(as_of).cast("timestamp_ntz"), F.lit(False))
    expired = F.coalesce(age >= F.col("expire_days"), F.lit(False)) & ~held
    return j.withColumn("age_days", age).withColumn("locked", held).filter(~expired).drop("expire_days", "lock_days")


def storage_tier(df: DataFrame, rules: DataFrame, as_of, ts: str = "created_at", bucket: str = "bucket") -> DataFrame:
    """DML7: STANDARD -> STANDARD_IA -> GLACIER by age; EXPIRED past expiry."""
    j = df.join(rules.select(F.col("bucket").alias(bucket), "expire_days", "ia_days", "glacier_days"), bucket, "left")
    age = _age_days(ts, as_of)
    tier = (F.when(F.coalesce(age >= F.col("expire_days"), F.lit(False)), F.lit("EXPIRED"))
            .when(F.coalesce(age >= F.col("glacier_days"), F.lit(False)), F.lit("GLACIER"))
            .when(F.coalesce(age >= F.col("ia_days"), F.lit(False)), F.lit("STANDARD_IA"))
            .otherwise(F.lit("STANDARD")))
    return j.withColumn("tier", tier).drop("expire_days", "ia_days", "glacier_days")


def purge_list_due(purges: DataFrame, as_of, grace_days: int = TENANT_GRACE_DAYS) -> DataFrame:
    """Tenants whose deletion request is past the grace period."""
    due = F.col("requested_at") + F.expr(f"INTERVAL {int(grace_days)} DAYS") <= F.lit(as_of).cast("timestamp_ntz")
    return purges.filter(due).select("tenant_id").distinct()


def purge_tenants(df: DataFrame, purges: DataFrame, as_of, tenant: str = "tenant_id",
                  grace_days: int = TENANT_GRACE_DAYS) -> DataFrame:
    """DML11: rows of tenants not (yet) purged -- anti join on the due purge list."""
    due = purge_list_due(purges, as_of, grace_days).withColumnRenamed("tenant_id", tenant)
    return df.join(due, tenant, "left_anti")


def export_tenant(tables: dict, tenant_value, tenant: str = "tenant_id") -> dict:
    """DML10: all rows of one tenant, per table (filter pushed to each scan)."""
    return {name: df.filter(F.col(tenant) == F.lit(tenant_value)) for name, df in tables.items()}


def write_export(tables: dict, path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/table={name}")


def anonymize(df: DataFrame, columns, salt: str, as_of=None, years: int = AUDIT_RETENTION_YEARS) -> DataFrame:
    """DML12: identifying columns replaced by a salted SHA-256; retention stamp for the audit copy.

    ``salt`` is a secret of the caller: without it, hashes of small keys could be enumerated.
    """
    out = df
    for c in columns:
        out = out.withColumn(c, F.sha2(F.concat(F.lit(f"{salt}:"), F.col(c).cast("string")), 256))
    if as_of is not None:
        out = out.withColumn("retain_until", F.add_months(F.lit(as_of).cast("date"), 12 * years))
    return out


def integrity_checks(tables: dict, specs: dict) -> DataFrame:
    """AGG17: per table ``rows > 0`` and ``NULL keys = 0``, required columns present,
    plus one ``overall`` row (FAILED if any check fails).

    ``specs``: table -> (key columns, required columns).  Column presence is
    answered from the schema (metadata); counts are ONE aggregate per table
    (the scan reads only the key columns), its three check rows come from
    ``explode``, and the verdict is a window over the few check rows.
    """
    from pyspark.sql import Window
    parts = []
    for name, df in tables.items():
        keys, required = specs.get(name, ((), ()))
        null_keys = F.lit(0).cast("long")
        for k in keys:
            null_keys = null_keys + F.count_if(F.col(k).isNull()).cast("long")
        missing = len([c for c in required if c not in df.columns])
        agg = df.agg(F.count(F.lit(1)).alias("rows"), null_keys.alias("null_keys"))

        def chk(label, observed, ok):
            return F.struct(F.lit(label).alias("check"), observed.cast("long").alias("observed"), ok.alias("ok"))
        rows = F.array(chk("rows_present", F.col("rows"), F.col("rows") > 0),
                       chk("keys_not_null", F.col("null_keys"), F.col("null_keys") == 0),
                       chk("columns_present", F.lit(missing), F.lit(missing == 0)))
        parts.append(agg.select(F.lit(name).alias("table_name"), F.explode(rows).alias("c"))
                        .select("table_name", "c.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a handful of rows (3 per table): one global window adds the verdict row
    w = Window.orderBy("table_name", "check")
    out = (out.withColumn("_failed", F.count_if(~F.col("ok")).over(
                    w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
              .withColumn("_rn", F.row_number().over(w)))
    me = F.struct("table_name", "check", "observed", "ok")
    overall = F.struct(F.lit(None).cast("string").alias("table_name"), F.lit("overall").alias("check"),
                       F.col("_failed").cast("long").alias("observed"), (F.col("_failed") == 0).alias("ok"))
    emit = F.when(F.col("_rn") == 1, F.array(me, overall)).otherwise(F.array(me))
    return out.select(F.explode(emit).alias("r")).select("r.*")
