"""Loader bindings: dispatch/projection, file diff, lookback, caps, dedup, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hour_key
from ..operators import load as L
from ..operators import project as P
from ..plans.dispatch import ENVELOPE, FactDispatch, make_registry
from ..session import table
from . import binding
from .common import bronze_files, envelopes, events

# Registry for the test envelopes: four mapped types, ``view`` left unmapped.
TEST_REGISTRY = make_registry([
    FactDispatch("signup", "fact_signup", ("signup_k", "signup_user_id", "signup_type"),
                 ("data.k", "data.userId", "type"), None, ("int", "long", "string")),
    FactDispatch("click", "fact_click", ("click_k",), ("data.k",), None, ("int",)),
    FactDispatch("purchase", "fact_purchase", ("purchase_k", "purchase_amount", "purchase_type"),
                 ("data.k", "data.amount", "type"), None, ("int", "decimal(18,2)", "string")),
    FactDispatch("error", "fact_error", ("error_k",), ("data.k",), None, ("int",)),
])

_ENV_SQL = """
env AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts AS time, event_type AS type,
         't' || CAST(CAST(floor(user_id / 10) AS BIGINT) AS VARCHAR) AS tenantid,
         'u' || CAST(user_id AS VARCHAR) AS caseid,
         value AS amount, user_id AS user_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)
"""

_FILES_SQL = """
files AS (
  SELECT event_type,
         'event_type=' || event_type || strftime(ts, '/year=%Y/month=%m/day=%d/hour=%H/') ||
         'part-' || lpad(CAST(CAST(floor(minute(ts) / 10) AS INTEGER) AS VARCHAR), 2, '0') || '.jsonl' AS s3_key,
         ts
  FROM events),
per_file AS (
  SELECT event_type, s3_key, count(*) AS row_count, date_trunc('hour', min(ts)) AS hour_start,
         day(min(ts)) AS day
  FROM files GROUP BY event_type, s3_key)
"""


@binding("dispatch_project", sql="WITH " + _ENV_SQL + """
SELECT type AS event_type,
       CASE type WHEN 'signup' THEN 'fact_signup' WHEN 'click' THEN 'fact_click'
                 WHEN 'purchase' THEN 'fact_purchase' WHEN 'error' THEN 'fact_error' END AS target_table,
       CASE WHEN type IN ('signup','click','purchase','error') THEN 'INSERT' END AS strategy,
       count(*) AS row_count,
       CAST(sum(CASE WHEN type IN ('signup','click','purchase','error') THEN k END) AS BIGINT) AS sum_k,
       count(DISTINCT tenantid) AS tenants,
       min(time) AS first_event_time, max(time) AS last_event_time
FROM env GROUP BY 1, 2, 3
""")
def dispatch_project(spark, sf_dir):
    """PRJ1-6 + FIL2 + AGG1: route envelopes through the registry, type them, count per type."""
    env = envelopes(spark, sf_dir)
    mapped, unmapped = P.split_mapped(env, TEST_REGISTRY)
    rows = P.project_table(mapped, TEST_REGISTRY.values(), table="all")
    k = F.coalesce(*[F.col(f"{t}_k") for t in TEST_REGISTRY])
    facts = ["event_time", "tenant_id"]
    rows = rows.select(F.col("_event_type").alias("event_type"), k.alias("k"), *facts)
    rest = unmapped.select(F.col("type").alias("event_type"), F.lit(None).cast("int").alias("k"),
                           *[c for c, (name, _, _) in zip(P.envelope_cols(), ENVELOPE) if name in facts])
    rows = P.dispatch_for(rows.unionByName(rest), TEST_REGISTRY)
    return (rows.groupBy("event_type", "target_table", "strategy")
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum("k").cast("long").alias("sum_k"),
                 F.countDistinct("tenant_id").alias("tenants"),
                 F.min("event_time").cast("timestamp_ntz").alias("first_event_time"),
                 F.max("event_time").cast("timestamp_ntz").alias("last_event_time")))


def _derived_log(files):
    """A load log with history: failed first attempts, ok retries, hand-abandoned files."""
    attempts = F.array(
        F.struct(F.lit("failed").alias("status"), F.expr("INTERVAL 1 HOURS").alias("after"),
                 (F.col("day") <= 21).alias("keep")),
        F.struct(F.lit("ok").alias("status"), F.expr("INTERVAL 2 HOURS").alias("after"),
                 (F.col("day") <= 20).alias("keep")),
        F.struct(F.lit("abandoned").alias("status"), F.expr("INTERVAL 1 HOURS").alias("after"),
                 (F.col("day") == 22).alias("keep")))
    a = files.select("event_type", "s3_key", "row_count", "hour_start", F.explode(attempts).alias("a"))
    a = a.filter("a.keep")
    return a.select(
        "event_type", "s3_key",
        (F.col("hour_start") + F.col("a.after")).cast("timestamp").alias("copied_at"),
        F.when(F.col("a.status") == "ok", F.col("row_count")).cast("long").alias("row_count"),
        F.lit(None).cast("long").alias("bytes_loaded"),
        F.lit(None).cast("long").alias("copy_duration_ms"),
        F.col("a.status").alias("status"),
        F.when(F.col("a.status") == "failed", F.lit("load failed")).alias("error_message"),
        F.date_format(F.col("hour_start") + F.col("a.after"), "yyyyMMddHH").alias("tick_id"))


_LOG_SQL = """
log AS (
  SELECT event_type, s3_key, hour_start + INTERVAL 1 HOUR AS copied_at, NULL::BIGINT AS row_count, 'failed' AS status
  FROM per_file WHERE day <= 21
  UNION ALL
  SELECT event_type, s3_key, hour_start + INTERVAL 2 HOUR, row_count, 'ok' FROM per_file WHERE day <= 20
  UNION ALL
  SELECT event_type, s3_key, hour_start + INTERVAL 1 HOUR, NULL::BIGINT, 'abandoned' FROM per_file WHERE day = 22),
state AS (
  SELECT event_type, s3_key, status, copied_at, row_count, attempts FROM (
    SELECT *, count(*) OVER (PARTITION BY event_type, s3_key) AS attempts,
           row_number() OVER (PARTITION BY event_type, s3_key ORDER BY copied_at DESC, status DESC) AS rn
    FROM log) WHERE rn = 1)
"""


@binding("load_diff", sql="WITH " + _FILES_SQL + "," + _LOG_SQL + """
SELECT f.event_type, f.s3_key, f.row_count FROM per_file f
WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.event_type = f.event_type AND s.s3_key = f.s3_key
                  AND s.status IN ('ok', 'abandoned'))
""")
def load_diff(spark, sf_dir):
    """JN2/SET1: files not yet loaded (latest status not ok/abandoned)."""
    files = bronze_files(events(spark, sf_dir))
    state = L.load_state(_derived_log(files))
    return L.new_files(files, state).select("event_type", "s3_key", "row_count")


@binding("load_log_state", sql="WITH " + _FILES_SQL + "," + _LOG_SQL + """
SELECT event_type, s3_key, status, copied_at, row_count, attempts FROM state
""")
def load_log_state(spark, sf_dir):
    """DML2: latest log row per (event_type, file), attempts kept as history."""
    files = bronze_files(events(spark, sf_dir))
    st = L.load_state(_derived_log(files))
    return st.select("event_type", "s3_key", "status", F.col("copied_at").cast("timestamp_ntz").alias("copied_at"),
                     "row_count", "attempts")


@binding("load_metrics", sql="WITH " + _FILES_SQL + "," + _LOG_SQL + """
SELECT event_type,
       count(*) FILTER (WHERE status = 'ok') AS files_ok,
       count(*) FILTER (WHERE status = 'failed') AS files_failed,
       CAST(sum(row_count) FILTER (WHERE status = 'ok') AS BIGINT) AS rows_loaded,
       CAST(CASE WHEN sum(row_count) FILTER (WHERE status = 'ok') > 0
            THEN greatest(1, floor(sum(row_count) FILTER (WHERE status = 'ok') /
                                   count(*) FILTER (WHERE status = 'ok'))) END AS BIGINT) AS est_rows_per_file
FROM log GROUP BY event_type
""")
def load_metrics(spark, sf_dir):
    """AGG1/AGG2: per-type load metrics over the whole log."""
    files = bronze_files(events(spark, sf_dir))
    return L.load_metrics(_derived_log(files)).drop("duration_ms")


AS_OF = "2024-01-15 12:30:00"


@binding("lookback_prune", sql=f"""
SELECT event_id, event_type, ts,
       'event_type=' || event_type || strftime(ts, '/year=%Y/month=%m/day=%d/hour=%H/') AS hour_key
FROM events
WHERE ts >= date_trunc('hour', TIMESTAMP '{AS_OF}') - INTERVAL 2 HOUR
  AND ts < date_trunc('hour', TIMESTAMP '{AS_OF}') + INTERVAL 1 HOUR
""")
def lookback_prune(spark, sf_dir):
    """SRC4/FIL1: the current hour plus ``hours`` previous hour partitions."""
    from ..sources.bronze import lookback_filter
    ev = events(spark, sf_dir)
    return (ev.filter(lookback_filter(F.col("ts"), AS_OF, 2))
              .select("event_id", "event_type", "ts", hour_key("event_type", "ts").alias("hour_key")))


@binding("batch_cap", sql="""
WITH r AS (
  SELECT event_type, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts) DESC, event_id) AS rn,
         count(*) OVER (PARTITION BY event_type) AS total
  FROM events)
SELECT event_type, event_id, rn, greatest(total - 200, 0) AS deferred FROM r WHERE rn <= 200
""")
def batch_cap(spark, sf_dir):
    """WIN4/SRT2: first 200 per type, newest hour first then key order; deferred count."""
    ev = events(spark, sf_dir)
    batch, deferred = L.cap_per_type(ev, 200, "event_type",
                                     [F.date_trunc("hour", "ts").desc(), F.col("event_id")])
    return batch.join(deferred, "event_type").select("event_type", "event_id", "rn", "deferred")


@binding("dedup_events", sql="""
WITH u AS (
  SELECT event_id, ts, user_id, event_type, value, 'a' AS file FROM events
  UNION ALL
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN ts - INTERVAL 1 SECOND ELSE ts + INTERVAL 1 SECOND END,
         user_id, event_type, value, 'b' FROM events),
n AS (SELECT * REPLACE (CASE WHEN event_type <> 'signup' THEN event_id END AS event_id) FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, file) AS rn FROM n)
SELECT event_id, ts, user_id, event_type, value, file FROM r WHERE rn = 1 OR event_id IS NULL
""")
def dedup_events(spark, sf_dir):
    """WIN1: at-least-once redelivery (every event twice) collapsed to the first copy; rows without an id (signups) all stay."""
    ev = events(spark, sf_dir).select(F.when(F.col("event_type") != "signup", F.col("event_id")).alias("event_id"), "ts", "user_id", "event_type", "value")
    again = ev.select("event_id",
                      F.when(F.col("event_type") == "error", F.col("ts") - F.expr("INTERVAL 1 SECOND"))
                      .otherwise(F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"),
                      "user_id", "event_type", "value")
    u = ev.withColumn("file", F.lit("a")).unionByName(again.withColumn("file", F.lit("b")))
    return L.dedup(u, "event_id", ["ts", "file"])


_SHIP_COLS = ["last_ship_date", "last_linenumber", "last_returnflag", "last_linestatus",
              "last_quantity", "last_extendedprice"]


def _ship_source(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_shipdate").alias("event_time"),
        F.lit("ship").alias("_event_type"),
        F.col("l_shipdate").alias("last_ship_date"), F.col("l_linenumber").alias("last_linenumber"),
        F.col("l_returnflag").alias("last_returnflag"), F.col("l_linestatus").alias("last_linestatus"),
        F.col("l_quantity").alias("last_quantity"), F.col("l_extendedprice").alias("last_extendedprice"),
        # full tie-break: (orderkey, linenumber) is not unique in lineitem
        F.struct("l_shipdate", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey").alias("event_id"))


def _order_target(spark, sf_dir, only_final=False):
    o = table(spark, sf_dir, "orders")
    if only_final:
        o = o.filter(F.col("o_orderstatus") == "F")
    li_types = {"last_ship_date": "timestamp_ntz", "last_linenumber": "int", "last_returnflag": "string",
                "last_linestatus": "string", "last_quantity": "double", "last_extendedprice": "double"}
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    *[F.lit(None).cast(t).alias(c) for c, t in li_types.items()])


@binding("merge_finalize", sql="""
WITH src AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC,
             l_returnflag DESC, l_linestatus DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC,
             l_tax DESC, l_partkey DESC, l_suppkey DESC) AS rn
    FROM lineitem) WHERE rn = 1)
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
       s.l_shipdate AS last_ship_date, s.l_linenumber AS last_linenumber, s.l_returnflag AS last_returnflag,
       s.l_linestatus AS last_linestatus, s.l_quantity AS last_quantity, s.l_extendedprice AS last_extendedprice
FROM orders o LEFT JOIN src s ON o.o_orderkey = s.l_orderkey
""")
def merge_finalize(spark, sf_dir):
    """JN1/DML1/Q2: MERGE-update orders from line events; the latest event wins per column."""
    target = _order_target(spark, sf_dir)
    source = _ship_source(spark, sf_dir)
    updated, _ = L.merge_update(target, source, {c: ["ship"] for c in _SHIP_COLS}, "o_orderkey",
                                tenant_scoped=False)
    return updated


@binding("merge_pending", sql="""
SELECT l_orderkey AS o_orderkey, count(*) AS pending_rows, max(l_shipdate) AS last_ship_date
FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')
GROUP BY l_orderkey
""")
def merge_pending(spark, sf_dir):
    """STR12: MERGE rows whose parent row is not (yet) in the target go to pending."""
    target = _order_target(spark, sf_dir, only_final=True)
    source = _ship_source(spark, sf_dir)
    _, unmatched = L.merge_update(target, source, {"last_ship_date": ["ship"]}, "o_orderkey",
                                  tenant_scoped=False)
    return unmatched.select("o_orderkey", F.col("_n_source").alias("pending_rows"), "last_ship_date")


@binding("sparse_union", sql="WITH " + _ENV_SQL + """
SELECT id AS event_id, time AS event_time, tenantid AS tenant_id, caseid AS case_id,
       CASE WHEN type = 'signup' THEN k END AS signup_k,
       CASE WHEN type = 'signup' THEN user_id END AS signup_user_id,
       CASE WHEN type = 'signup' THEN type END AS signup_type,
       CASE WHEN type = 'purchase' THEN k END AS purchase_k,
       CASE WHEN type = 'purchase' THEN CAST(amount AS DECIMAL(18,2)) END AS purchase_amount,
       CASE WHEN type = 'purchase' THEN type END AS purchase_type,
       type AS _event_type
FROM env WHERE type IN ('signup', 'purchase')
""")
def sparse_union(spark, sf_dir):
    """SET5/PRJ4: two event types into one sparse table with a discriminator, in one pass."""
    env = envelopes(spark, sf_dir)
    entries = [TEST_REGISTRY["signup"], TEST_REGISTRY["purchase"]]
    df = P.project_table(env, entries, table="fact_activity")
    return df.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@binding("event_types", sql="""
SELECT DISTINCT event_type FROM events
""")
def event_types(spark, sf_dir):
    """SRC3: distinct event types present (partition values on a bronze layout)."""
    from ..sources.bronze import list_event_types
    return list_event_types(events(spark, sf_dir))


@binding("late_files", sql=f"""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS late_rows
FROM events WHERE ts < date_trunc('hour', TIMESTAMP '{AS_OF}') - INTERVAL 2 HOUR
GROUP BY 1, 2
""")
def late_files(spark, sf_dir):
    """STR2: everything older than the lookback window, reported per type and hour."""
    from ..sources.bronze import late_report
    ev = events(spark, sf_dir)
    return late_report(ev, AS_OF, 2, ts=F.col("ts")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@binding("dispatch_lookup", sql="""
SELECT t.event_type, r.target_table, r.strategy, count(*) AS row_count
FROM events t LEFT JOIN (VALUES ('signup', 'fact_signup', 'INSERT'), ('click', 'fact_click', 'INSERT'),
                                ('purchase', 'fact_purchase', 'INSERT'), ('error', 'fact_error', 'INSERT'))
                        r(event_type, target_table, strategy) ON t.event_type = r.event_type
GROUP BY 1, 2, 3
""")
def dispatch_lookup(spark, sf_dir):
    """JN4: per-row dispatch lookup through the (broadcast) registry table."""
    ev = events(spark, sf_dir).select("event_type")
    return (P.dispatch_for(ev, TEST_REGISTRY).groupBy("event_type", "target_table", "strategy")
            .agg(F.count(F.lit(1)).alias("row_count")))


@binding("loader_roundtrip", sql="WITH " + _ENV_SQL + """
SELECT CASE WHEN type IN ('signup', 'click', 'purchase', 'error') THEN 'fact_' || type ELSE '_unmapped' END AS table_name,
       count(*) AS row_count, count(DISTINCT id) AS events, min(time) AS first_event_time, max(time) AS last_event_time
FROM env GROUP BY 1
""")
def loader_roundtrip(spark, sf_dir):
    """SNK1-2, DML3-5, STR3: three ticks of the loader over all events, one of them replayed; rows per written table."""
    import uuid

    from ..session import shared_path
    from ..streaming.loader import load_tick
    warehouse = shared_path(spark, "loader-roundtrip", uuid.uuid4().hex)
    env = envelopes(spark, sf_dir)
    env = env.select("*", F.col("type").alias("event_type"), F.concat(F.lit("events/"), F.col("type")).alias("s3_key"),
                     F.lit(None).cast("string").alias("_corrupt_record"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("part"))
    for tick in (0, 1, 1, 2):
        load_tick(env.filter(F.col("part") == tick).drop("part"), tick, warehouse, TEST_REGISTRY, strict=True)
    out = None
    for name in (*sorted({e.table for e in TEST_REGISTRY.values()}), "_unmapped"):
        rows = spark.read.parquet(f"{warehouse}/{name}")
        rows = (rows.select(F.col("id").alias("event_id"), F.col("time").cast("timestamp").alias("event_time")) if name == "_unmapped"
                else rows.select("event_id", "event_time")).withColumn("table_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("event_id").alias("events"),
        F.min("event_time").cast("timestamp_ntz").alias("first_event_time"), F.max("event_time").cast("timestamp_ntz").alias("last_event_time"))
