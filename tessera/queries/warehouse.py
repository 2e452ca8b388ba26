"""Warehouse bindings: key-indexed MERGE, snapshots, repeats across ticks, admission per type, live alarms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import slo as S
from ..operators import storage
from ..plans.dispatch import FactDispatch, make_registry
from ..plans.observability import Alarm
from ..session import materialize, shared_path, table
from ..streaming import admission
from ..streaming import store as ST
from ..streaming.alarms import start_alarm_stream
from ..streaming.loader import load_tick
from . import binding
from .common import bronze_files, envelopes, events
from .loader import _ENV_SQL, _FILES_SQL, TEST_REGISTRY

ORDER_REGISTRY = make_registry([
    FactDispatch("order", "fact_order", ("order_key", "customer_key", "price"),
                 ("data.orderKey", "data.customerKey", "data.price"), None, ("string", "long", "double")),
    FactDispatch("shipment", "fact_order", ("order_key", "line", "return_flag", "quantity"),
                 ("data.orderKey", "data.line", "data.returnFlag", "data.quantity"), "order_key", ("string", "int", "string", "double")),
])


def _batch(rows):
    """Envelopes as a tick's batch."""
    return rows.select("id", "time", "type", "tenantid", "caseid", "data", F.col("type").alias("event_type"),
                       F.concat(F.lit("events/"), F.col("type")).alias("s3_key"), F.lit(None).cast("string").alias("_corrupt_record"))


@binding("merge_indexed", sql="""
WITH k AS (SELECT max(o_orderkey) + 1 AS n FROM orders),
l AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem),
s AS (SELECT l_orderkey, arg_max(l_linenumber, (l_shipdate, id)) AS line, arg_max(l_returnflag, (l_shipdate, id)) AS return_flag,
             arg_max(l_quantity, (l_shipdate, id)) AS quantity FROM l GROUP BY 1),
o AS (SELECT *, CAST(floor(o_orderkey * 3 / n) AS INTEGER) AS load_batch FROM orders, k)
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, load_batch, o_custkey AS customer_key, o_totalprice AS price, line, return_flag, quantity,
       CASE WHEN load_batch = 2 THEN '2' ELSE '0,1' END AS opened
FROM o LEFT JOIN s ON l_orderkey = o_orderkey
""")
def merge_indexed(spark, sf_dir):
    """JN1/DML1/STR12: three ticks of orders by key range, then shipments of the newest range, then all others.

    ``opened``: the partitions that the key index lets the shipments' tick read.
    """
    warehouse = shared_path(spark, "merge-indexed", uuid.uuid4().hex)
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = orders.agg(F.max("o_orderkey")).first()[0] + 1

    def band(key):
        return F.floor(F.col(key) * 3 / F.lit(n)).cast("int")
    made = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").cast("string").alias("time"), F.lit("order").alias("type"),
                         F.lit("t").alias("tenantid"), F.lit("c").alias("caseid"), band("o_orderkey").alias("band"),
                         F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("orderKey"), F.col("o_custkey").alias("customerKey"),
                                            F.col("o_totalprice").alias("price"))).alias("data"))
    sent = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("string")).alias("id"), F.col("l_shipdate").cast("string").alias("time"),
                        F.lit("shipment").alias("type"), F.lit("t").alias("tenantid"), F.lit("c").alias("caseid"), band("l_orderkey").alias("band"),
                        F.col("l_orderkey").cast("string").alias("order_key"),
                        F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("orderKey"), F.col("l_linenumber").alias("line"),
                                           F.col("l_returnflag").alias("returnFlag"), F.col("l_quantity").alias("quantity"))).alias("data"))
    for tick in range(3):
        load_tick(_batch(made.filter(F.col("band") == tick)), tick, warehouse, ORDER_REGISTRY, strict=True)
    opened = {}
    for tick, mine in ((3, F.col("band") == 2), (4, F.col("band") < 2)):
        index = f"{warehouse}/_key_index/fact_order/order_key"
        opened[tick] = ",".join(map(str, sorted(ST.partitions_to_open(spark, index, sent.filter(mine), "order_key", {0, 1, 2}))))
        load_tick(_batch(sent.filter(mine)), tick, warehouse, ORDER_REGISTRY, strict=True)
    rows = spark.read.parquet(f"{warehouse}/fact_order")
    return rows.select("order_key", "load_batch", "customer_key", "price", "line", "return_flag", "quantity",
                       F.when(F.col("load_batch") == 2, opened[3]).otherwise(opened[4]).alias("opened"))


@binding("snapshot_roundtrip", sql="WITH " + _ENV_SQL + """,
t AS (SELECT *, CASE WHEN hour(time) < 8 THEN 0 WHEN hour(time) < 16 THEN 1 ELSE 2 END AS tick FROM env WHERE type <> 'view'),
seen(seen_after, last) AS (VALUES ('tick 0', 0), ('tick 1', 1), ('half of tick 2', 1), ('tick 2', 2))
SELECT seen_after, 'fact_' || type AS table_name, count(*) AS row_count, count(DISTINCT id) AS events, max(time) AS last_event_time
FROM t JOIN seen ON tick <= last GROUP BY 1, 2
""")
def snapshot_roundtrip(spark, sf_dir):
    """DML5/STR3: what readers see after every tick, and while a tick stands half-written."""
    warehouse = shared_path(spark, "snapshots", uuid.uuid4().hex)
    hour = F.hour(F.col("time").cast("timestamp"))
    env = envelopes(spark, sf_dir).withColumn("tick", F.when(hour < 8, 0).when(hour < 16, 1).otherwise(2))
    tables, out = sorted({e.table for e in TEST_REGISTRY.values()}), None

    def look(label):
        nonlocal out
        for name in tables:
            rows = ST.read_snapshot(spark, warehouse, name).select("event_id", "event_time").withColumns(
                {"seen_after": F.lit(label), "table_name": F.lit(name)})
            out = rows if out is None else out.unionByName(rows)
    for tick in range(3):
        if tick == 2:
            half = ST.Snapshot(spark, warehouse, tick)
            half.add(ST.read_snapshot(spark, warehouse, "fact_click").drop("load_batch"), "fact_click")
            look("half of tick 2")
        load_tick(_batch(env.filter(F.col("tick") == tick)), tick, warehouse, TEST_REGISTRY, strict=True, atomic=True)
        look(f"tick {tick}")
    return out.groupBy("seen_after", "table_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("event_id").alias("events"),
        F.max("event_time").cast("timestamp_ntz").alias("last_event_time"))


@binding("dedup_across_ticks", sql="""
WITH e AS (SELECT event_type, ts, CASE WHEN event_type <> 'view' THEN event_id END AS id, hour(ts) AS h FROM events),
d AS (SELECT 0 AS tick, * FROM e WHERE h < 12 UNION ALL SELECT 1, * FROM e WHERE h >= 8 AND h < 20
      UNION ALL SELECT 2, * FROM e WHERE h >= 16 UNION ALL SELECT 3, * FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tick) AS rn FROM d)
SELECT tick, event_type, count(*) AS row_count, count(DISTINCT id) AS events, min(ts) AS first_ts, max(ts) AS last_ts
FROM r WHERE id IS NULL OR rn = 1 GROUP BY 1, 2
""")
def dedup_across_ticks(spark, sf_dir):
    """WIN1/STR3: overlapping deliveries and a full redelivery; an event id counts in its first tick only, NULL ids always."""
    path = shared_path(spark, "seen", uuid.uuid4().hex)
    hour = F.hour("ts")
    ev = events(spark, sf_dir).select(F.when(F.col("event_type") != "view", F.col("event_id").cast("string")).alias("id"),
                                      F.col("ts").cast("string").alias("time"), "event_type", "ts")
    out = None
    for tick, part in enumerate((hour < 12, (hour >= 8) & (hour < 20), hour >= 16, F.lit(True))):
        new = ST.drop_seen(ev.filter(part), path, tick).withColumn("tick", F.lit(tick))
        out = new if out is None else out.unionByName(new)
    return out.groupBy("tick", "event_type").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("id").alias("events"),
                                                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@binding("admission_backlog", sql="WITH " + _FILES_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour_start DESC, s3_key) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM per_file)
SELECT CAST(k // 200 AS INTEGER) AS tick, event_type, count(*) AS files, any_value(n) - 200 * (k // 200) - count(*) AS deferred,
       max(hour_start) AS newest_hour, min(hour_start) AS oldest_hour, CAST(sum(row_count) AS BIGINT) AS row_count
FROM r WHERE k < 600 GROUP BY k // 200, event_type
""")
def admission_backlog(spark, sf_dir):
    """SRT2/SNK8/WIN4: three ticks over a backlog, 200 files a type, newest hour first; what stays behind is counted."""
    files = materialize(bronze_files(events(spark, sf_dir)).select("event_type", "hour_start", "s3_key", "row_count"), "backlog")
    log, out = None, None
    for tick in range(3):
        batch, per_type = admission.admit(admission.waiting(files, log))
        batch = materialize(batch, "admitted")
        log = batch if log is None else log.unionByName(batch)
        rows = (batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("files"), F.max("hour_start").alias("newest_hour"),
                                                F.min("hour_start").alias("oldest_hour"), F.sum("row_count").alias("row_count"))
                     .join(per_type.select("event_type", "deferred"), "event_type").withColumn("tick", F.lit(tick)))
        rows = materialize(rows, "admission")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("newest_hour", "oldest_hour")})


@binding("admission_roundtrip", sql="""
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS d, hour(ts) // 12 AS half, event_id % 50 = 0 AS bad FROM events),
f AS (SELECT event_type, d, half, count(*) FILTER (bad) AS bad, count(*) FILTER (NOT bad) AS good FROM e GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY d DESC, half DESC) - 1) // 25 AS tick, count(*) OVER (PARTITION BY event_type) AS n FROM f),
w AS (SELECT event_type, tick, any_value(n) - 25 * tick AS waiting, count(*) AS admitted, sum(good) AS good, sum(bad) AS bad FROM r GROUP BY event_type, tick)
SELECT tick, CAST(sum(waiting) AS BIGINT) AS files_waiting, CAST(sum(admitted) AS BIGINT) AS files_admitted,
       CAST(sum(waiting - admitted) AS BIGINT) AS files_deferred, CAST(sum(admitted) AS BIGINT) AS files_loaded, 0 AS files_failed,
       CAST(coalesce(sum(good) FILTER (event_type <> 'view'), 0) AS BIGINT) AS rows_loaded,
       CAST(coalesce(sum(good) FILTER (event_type = 'view'), 0) AS BIGINT) AS rows_unmapped, CAST(sum(bad) AS BIGINT) AS rows_rejected, true AS has_bytes,
       CAST(sum(admitted) AS BIGINT) AS files_archived, 0 AS files_left
FROM w GROUP BY tick
""")
def admission_roundtrip(spark, sf_dir):
    """STR1/SRT2/SNK2/AGG1: event files listed, admitted 25 a type, loaded tick by tick and moved to the archive; the ticks' totals."""
    root, warehouse = (shared_path(spark, "admission", uuid.uuid4().hex, name) for name in ("events", "warehouse"))
    env = envelopes(spark, sf_dir)
    t = F.col("time").cast("timestamp")
    line = F.to_json(F.struct("id", "time", "type", "tenantid", "caseid", "data"))
    rows = env.select("*", F.col("type").alias("event_type"), F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"),
                      (F.floor(F.hour(t) / 12) * 12).cast("int").alias("hour"))
    rows = rows.select("event_type", "year", "month", "day", "hour",
                       F.when(F.col("id").cast("long") % 50 == 0, F.substr(line, F.lit(1), F.lit(20))).otherwise(line).alias("value"))
    parts = ["event_type", "year", "month", "day", "hour"]
    rows.repartition(*parts).write.partitionBy(*parts).text(root)
    admission.drain(spark, root, warehouse, TEST_REGISTRY, cap=25, pattern="*.txt", strict=True)
    moved = admission.archive_loaded(spark, root, warehouse, shared_path(spark, "admission", uuid.uuid4().hex, "archive"))
    moved = moved.filter("outcome = 'moved'").groupBy("tick").agg(F.count(F.lit(1)).alias("files_archived"))
    left = admission.list_files(spark, root, "*.txt").count()
    total = admission.tick_metrics(spark, warehouse).join(moved, "tick", "left")
    return total.select("tick", "files_waiting", "files_admitted", "files_deferred", "files_loaded", "files_failed", "rows_loaded",
                        "rows_unmapped", "rows_rejected", (F.col("bytes_loaded") > 0).alias("has_bytes"), "files_archived",
                        F.lit(left).alias("files_left"))


STREAM_ALARMS = [Alarm("errors-missing", "errors", "Sum", 3600, ">", 2.0, 3, 2, "missing"),
                 Alarm("errors-breaching", "errors", "SampleCount", 3600, ">=", 3.0, 3, 3, "breaching"),
                 Alarm("clicks-p999", "click_latency", "p99.9", 3600, ">", 40.0, 3, 2, "not_breaching")]


@binding("alarm_stream", sql="""
WITH alarms(alarm_id, metric, stat, op, threshold, n, m, missing) AS (VALUES ('errors-missing', 'errors', 'Sum', '>', 2.0, 3, 2, 'missing'),
       ('errors-breaching', 'errors', 'SampleCount', '>=', 3.0, 3, 3, 'breaching'), ('clicks-p999', 'click_latency', 'p99.9', '>', 40.0, 3, 2, 'not_breaching')),
samples AS (SELECT 'errors' AS metric, ts, 1.0 AS value FROM events WHERE event_type = 'error'
            UNION ALL SELECT 'click_latency', ts, value FROM events WHERE event_type = 'click'),
dp AS (SELECT a.alarm_id, CAST(floor(epoch(s.ts) / 3600) AS BIGINT) AS bucket,
              CASE any_value(stat) WHEN 'Sum' THEN sum(value) WHEN 'SampleCount' THEN count(value) ELSE quantile_cont(value, 0.999) END AS value
       FROM samples s JOIN alarms a USING (metric) GROUP BY 1, 2),
hi AS (SELECT CAST(floor(max(epoch_us(ts)) / 3600000000) AS BIGINT) - 1 AS hi FROM samples),
grid AS (SELECT a.*, unnest(generate_series(r.lo, hi)) AS bucket FROM alarms a JOIN (SELECT alarm_id, min(bucket) AS lo FROM dp GROUP BY 1) r USING (alarm_id), hi),
j AS (SELECT g.*, d.value, CASE WHEN d.value IS NOT NULL THEN CAST(CASE op WHEN '>' THEN d.value > threshold ELSE d.value >= threshold END AS INTEGER)
             WHEN missing = 'breaching' THEN 1 WHEN missing = 'not_breaching' THEN 0 END AS breach FROM grid g LEFT JOIN dp d USING (alarm_id, bucket)),
w AS (SELECT *, CAST(sum(coalesce(breach, 0)) OVER win AS INTEGER) AS n_breach, count(breach) OVER win AS n_counted
      FROM j WINDOW win AS (PARTITION BY alarm_id ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN n_breach >= m THEN 'ALARM' WHEN n_counted > 0 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS state FROM w)
SELECT alarm_id, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(bucket * 3600) AS period_start, CAST(floor(value) AS BIGINT) AS value, breach, n_breach, state,
       coalesce(lag(state) OVER (PARTITION BY alarm_id ORDER BY bucket), 'INSUFFICIENT_DATA') <> state AS changed FROM s
""")
def alarm_stream(spark, sf_dir):
    """STR11/WIN2: the month's samples arrive in three runs of a stream; every period the watermark has closed."""
    base = shared_path(spark, "alarm-stream", uuid.uuid4().hex)
    ev = events(spark, sf_dir)
    clicks = ev.filter("event_type = 'click'").select(F.lit("click_latency").alias("metric"), "ts", "value")
    samples = ev.filter("event_type = 'error'").select(F.lit("errors").alias("metric"), "ts", F.lit(1.0).alias("value")).unionByName(clicks)
    day = F.dayofmonth("ts")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        samples.filter(part).write.mode("append").parquet(f"{base}/samples")
        stream = spark.readStream.schema(samples.schema).parquet(f"{base}/samples")
        start_alarm_stream(spark, stream, STREAM_ALARMS, f"{base}/out", state_path=f"{base}/state", checkpoint=f"{base}/checkpoint",
                           available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch").withColumn("value", F.floor("value"))


@binding("sketch_quantiles", sql="""
WITH s AS (SELECT event_type AS sli, date_trunc('hour', ts) AS hour FROM events),
w AS (SELECT sli, hour - to_hours(CAST(k AS INTEGER)) AS window_start FROM s, (SELECT unnest(range(6)) AS k))
SELECT sli, window_start, count(*) AS n, true AS p50_fits, true AS p95_fits, true AS p99_fits FROM w GROUP BY 1, 2
""")
def sketch_quantiles(spark, sf_dir):
    """AGG7/AGG9: rolling 6-hour quantiles from hourly KLL sketches; every one is held against the exact ranks of its window."""
    samples = events(spark, sf_dir).select(F.col("event_type").alias("sli"), F.col("ts").cast("timestamp").alias("ts"), "value")
    rolled = S.sketch_quantiles(S.rolling_sketches(S.sketch_series(samples, "1 hour"), 360, 60))
    hour = F.date_trunc("hour", "ts")
    back = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")
    wide = samples.select("sli", hour.alias("hour"), "value", back)
    wide = wide.select("sli", (F.col("hour") - F.make_dt_interval(hours=F.col("k"))).alias("window_start"), "value")
    ranks, fits = [], []
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        ranks += [F.count_if(F.col("value") < F.col(name)).alias(f"{name}_below"), F.count_if(F.col("value") <= F.col(name)).alias(f"{name}_upto")]
        slack = q * F.col("n") + F.lit(1) + F.lit(S.SKETCH_RANK_ERROR) * F.col("n")
        least = q * F.col("n") - F.lit(1) - F.lit(S.SKETCH_RANK_ERROR) * F.col("n")
        fits.append(((F.col(f"{name}_below") <= slack) & (F.col(f"{name}_upto") >= least)).alias(f"{name}_fits"))
    held = wide.join(rolled, ["sli", "window_start"]).groupBy("sli", "window_start", "n").agg(*ranks)
    return held.select("sli", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", *fits)


# ------------------------------------------------------------ stored files

def _stored_events(spark, sf_dir):
    """Events written by six runs of the day, so a folder (type, day) holds up to six small files."""
    root = shared_path(spark, "stored-events", uuid.uuid4().hex)
    ev = events(spark, sf_dir).select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "ts", "value")
    for run in range(6):
        part = ev.filter(F.floor(F.hour("ts") / 4) == run).repartition("event_type", "day")
        part.write.mode("append").partitionBy("event_type", "day").parquet(root)
    return root


@binding("compact_stored", sql="""
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS row_count, sum(event_id)::BIGINT AS ids, count(DISTINCT hour(ts) // 4) AS files_before,
       CASE WHEN CAST(ts AS DATE) < DATE '2024-01-25' THEN 1 ELSE count(DISTINCT hour(ts) // 4) END AS files_after
FROM events GROUP BY 1, 2
""")
def compact_stored(spark, sf_dir):
    """DML8: the small files of closed days merged in place; rows and files of every folder."""
    root = _stored_events(spark, sf_dir)

    def files(name):
        return materialize(storage.list_files(spark, root).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias(name)), "listing")
    before = files("files_before")
    storage.compact_files(spark, root, F.col("day") < F.lit("2024-01-25").cast("date"))
    rows = spark.read.parquet(root).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("row_count"), F.sum("event_id").alias("ids"))
    return rows.join(before, ["event_type", "day"]).join(files("files_after"), ["event_type", "day"])


@binding("expire_stored", sql="""
WITH f AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, CASE WHEN day >= DATE '2024-01-31' - 14 THEN 'kept' WHEN event_type = 'error' THEN 'held' ELSE 'dropped' END AS outcome,
       CASE WHEN day >= DATE '2024-01-31' - 14 OR event_type = 'error' THEN n ELSE 0 END AS rows_left FROM f
""")
def expire_stored(spark, sf_dir):
    """DML6/DML9: folders older than 14 days are dropped whole, those under hold (errors) stay."""
    root = _stored_events(spark, sf_dir)
    holds = events(spark, sf_dir).filter("event_type = 'error'").select("event_type").distinct()
    out = storage.drop_expired(spark, root, F.col("day"), 14, "2024-01-31", holds)
    left = spark.read.parquet(root).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("rows_left"))
    return out.join(left, ["event_type", "day"], "left").select("event_type", "day", "outcome", F.coalesce("rows_left", F.lit(0)).alias("rows_left"))


@binding("purge_stored", sql="""
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_totalprice,
                  o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) AS gone FROM orders)
SELECT month, CASE WHEN count_if(gone) = 0 THEN 'kept' WHEN count_if(gone) = count(*) THEN 'dropped' ELSE 'rewritten' END AS outcome,
       count(*) AS row_count, count_if(gone) AS purged, count_if(NOT gone) AS rows_left,
       CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (NOT gone), 0) AS BIGINT) AS cents_left
FROM o GROUP BY month
""")
def purge_stored(spark, sf_dir):
    """DML11: orders stored a file a month; the customers of one nation are purged, orders in progress are held."""
    root = shared_path(spark, "stored-orders", uuid.uuid4().hex)
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyy-MM")).alias("month"), "o_orderkey",
                                                   F.col("o_custkey").alias("tenant_id"), "o_orderstatus", "o_totalprice")
    orders.repartition("month").write.partitionBy("month").parquet(root)
    gone = table(spark, sf_dir, "customer").filter("c_nationkey = 7").select("c_custkey")
    report = storage.purge_files(spark, root, gone, held=F.col("o_orderstatus") == "P")
    left = spark.read.parquet(root).groupBy("month").agg(F.count(F.lit(1)).alias("rows_left"),
                                                         F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents_left"))
    return report.join(left, "month", "left").select(
        F.substring("month", 2, 7).alias("month"), "outcome", F.col("rows").alias("row_count"), "purged",
        F.coalesce("rows_left", F.lit(0)).alias("rows_left"), F.coalesce("cents_left", F.lit(0)).alias("cents_left"))
