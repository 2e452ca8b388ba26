"""SLO, alarm, telemetry and audit bindings over the test ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slo as S
from ..operators import telemetry as TM
from ..plans.observability import SLO, Alarm, burn_threshold, error_budget_minutes
from ..plans.observability import alarm_catalog as alarm_rows
from ..session import table
from . import binding
from .common import events

# events as a gateway request log: path by event type, errors are 5xx.
_PATH_SQL = """CASE event_type WHEN 'click' THEN '/v1/runtime/agents/click'
                      WHEN 'purchase' THEN '/v1/runtime/conversation/turn'
                      WHEN 'view' THEN '/v1/lending/deals/' || CAST(user_id AS VARCHAR)
                      WHEN 'signup' THEN '/v1/auth/signup'
                      ELSE '/v1/runtime/agents/error' END"""


def request_log(spark, sf_dir):
    ev = events(spark, sf_dir)
    path = (F.when(F.col("event_type") == "click", F.lit("/v1/runtime/agents/click"))
            .when(F.col("event_type") == "purchase", F.lit("/v1/runtime/conversation/turn"))
            .when(F.col("event_type") == "view", F.concat(F.lit("/v1/lending/deals/"), F.col("user_id").cast("string")))
            .when(F.col("event_type") == "signup", F.lit("/v1/auth/signup"))
            .otherwise(F.lit("/v1/runtime/agents/error")))
    return ev.select("ts", F.lit("request_completed").alias("message"), path.alias("path"),
                     F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
                     F.col("value").alias("latency_ms"))


@binding("sli_p95", sql=f"""
WITH req AS (SELECT ts, value AS latency_ms, {_PATH_SQL} AS path,
                    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events),
s AS (
  SELECT 'conversation-first-paint' AS sli, ts, latency_ms AS value FROM req
   WHERE starts_with(path, '/v1/runtime/agents') AND status < 400
  UNION ALL
  SELECT 'conversation-end-to-end', ts, latency_ms FROM req
   WHERE starts_with(path, '/v1/runtime/conversation/turn') AND status < 400
  UNION ALL
  SELECT 'deal-progress', ts, latency_ms FROM req
   WHERE starts_with(path, '/v1/lending/deals') AND status < 400)
SELECT sli, date_trunc('hour', ts) AS window_start, count(*) AS n,
       round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95,
       round(quantile_cont(value, 0.99), 4) AS p99
FROM s GROUP BY 1, 2
""")
def sli_p95(spark, sf_dir):
    """FIL5 + AGG7/AGG8: SLI samples -> p50/p95/p99 per SLI per window (1 h here)."""
    samples = S.sli_samples(request_log(spark, sf_dir))
    return S.metric_series(samples, "1 hour")


_FAST = burn_threshold(SLO["availability_target"], SLO["fast_burn_pct_of_budget"], SLO["fast_burn_window_minutes"])
_SLOW = burn_threshold(SLO["availability_target"], SLO["slow_burn_pct_of_budget"], SLO["slow_burn_window_minutes"])
_BUDGET = error_budget_minutes(SLO["availability_target"])

# The same thresholds, stated for the SQL: target 0.9995, 2 over 60 minutes, 5 over 360, 30 days.
_FAST_SQL = "(1 - 0.9995::DOUBLE) * (2::DOUBLE * 30 * 24 / 1)"
_SLOW_SQL = "(1 - 0.9995::DOUBLE) * (5::DOUBLE * 30 * 24 / 6)"
_BUDGET_SQL = "floor((1 - 0.9995::DOUBLE) * 30 * 24 * 60 * 100 + 0.5) / 100"


@binding("error_rate_burn", sql=f"""
WITH w AS (
  SELECT 60 AS window_minutes, date_trunc('hour', ts) AS window_start, event_type FROM events
  UNION ALL
  SELECT 360, date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6) * 6 AS BIGINT)), event_type FROM events),
a AS (SELECT window_minutes, window_start, count(*) AS requests,
             count(*) FILTER (WHERE event_type = 'error') AS errors FROM w GROUP BY 1, 2)
SELECT window_minutes, window_start, requests, errors,
       CASE WHEN requests = 0 THEN 0 ELSE errors / requests END AS error_rate,
       CASE window_minutes WHEN 60 THEN {_FAST_SQL} ELSE {_SLOW_SQL} END AS threshold,
       (CASE WHEN requests = 0 THEN 0 ELSE errors / requests END) >
         (CASE window_minutes WHEN 60 THEN {_FAST_SQL} ELSE {_SLOW_SQL} END) AS burning,
       {_BUDGET_SQL} AS budget_minutes
FROM a
""")
def error_rate_burn(spark, sf_dir):
    """AGG10-12 + JN12: error rate over 60/360-minute windows vs the burn thresholds."""
    ev = events(spark, sf_dir)
    is_err = F.col("event_type") == "error"
    fast = S.error_rate(ev, SLO["fast_burn_window_minutes"], is_err)
    slow = S.coarser_rate(fast, SLO["slow_burn_window_minutes"])
    thr = F.when(F.col("window_minutes") == SLO["fast_burn_window_minutes"], F.lit(_FAST)).otherwise(F.lit(_SLOW))
    return fast.unionByName(slow).select(
        "window_minutes", "window_start", "requests", "errors", "error_rate", thr.alias("threshold"),
        (F.col("error_rate") > thr).alias("burning"), F.lit(_BUDGET).alias("budget_minutes"))


ALARMS = [
    Alarm("errors-not-breaching", "errors", "Sum", 3600, ">", 4.0, 3, 3, "not_breaching"),
    Alarm("errors-breaching", "errors", "Sum", 3600, ">", 4.0, 3, 3, "breaching"),
    Alarm("errors-missing", "errors", "Sum", 3600, ">", 4.0, 3, 3, "missing"),
    Alarm("click-p95", "click_latency", "p95", 3600, ">", 250.0, 3, 2, "not_breaching"),
]


def _alarm_values_sql():
    return ", ".join(f"('{a.alarm_id}', '{a.metric}', '{a.stat}', '{a.op}', {a.threshold}, {a.n}, {a.m}, '{a.missing}')"
                     for a in ALARMS)


@binding("alarm_m_of_n", sql=f"""
WITH alarms(alarm_id, metric, stat, op, threshold, n, m, missing) AS (VALUES {_alarm_values_sql()}),
samples AS (
  SELECT 'errors' AS metric, ts, 1.0 AS value FROM events WHERE event_type = 'error'
  UNION ALL
  SELECT 'click_latency', ts, value FROM events WHERE event_type = 'click'),
dp AS (
  SELECT a.alarm_id, a.stat, CAST(floor(epoch(s.ts) / 3600) AS BIGINT) AS bucket,
         sum(s.value) AS s_sum, quantile_cont(s.value, 0.95) AS s_p95
  FROM samples s JOIN alarms a USING (metric) GROUP BY 1, 2, 3),
dpv AS (SELECT alarm_id, bucket, CASE stat WHEN 'Sum' THEN s_sum WHEN 'p95' THEN s_p95 END AS value FROM dp),
rng AS (SELECT alarm_id, min(bucket) AS lo, max(bucket) AS hi FROM dpv GROUP BY 1),
grid AS (SELECT a.*, unnest(generate_series(r.lo, r.hi)) AS bucket FROM alarms a JOIN rng r USING (alarm_id)),
j AS (
  SELECT g.alarm_id, g.bucket, g.m, d.value,
         CASE WHEN d.value IS NOT NULL THEN CAST(d.value > g.threshold AS INTEGER)
              WHEN g.missing = 'breaching' THEN 1 WHEN g.missing = 'not_breaching' THEN 0 END AS breach
  FROM grid g LEFT JOIN dpv d ON g.alarm_id = d.alarm_id AND g.bucket = d.bucket),
w AS (
  SELECT *, CAST(sum(coalesce(breach, 0)) OVER win AS INTEGER) AS n_breach, count(breach) OVER win AS n_counted
  FROM j WINDOW win AS (PARTITION BY alarm_id ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
s AS (
  SELECT *, CASE WHEN n_breach >= m THEN 'ALARM' WHEN n_counted > 0 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS state
  FROM w)
SELECT alarm_id, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(bucket * 3600) AS period_start,
       round(value, 4) AS value, breach, n_breach, state,
       coalesce(lag(state) OVER (PARTITION BY alarm_id ORDER BY bucket), 'INSUFFICIENT_DATA') <> state AS changed
FROM s
""")
def alarm_m_of_n(spark, sf_dir):
    """WIN2/STR11/WIN5: hourly datapoints on a gap-filled grid, M of N, missing-data rules."""
    ev = events(spark, sf_dir)
    samples = (ev.filter(F.col("event_type") == "error").select(F.lit("errors").alias("metric"), "ts",
                                                                 F.lit(1.0).alias("value"))
               .unionByName(ev.filter(F.col("event_type") == "click")
                            .select(F.lit("click_latency").alias("metric"), "ts", "value")))
    return S.evaluate_alarms(samples, ALARMS)


# Every alarm row of the catalogue, stated again for the SQL.
_CATALOG_SQL = """(VALUES
  ('sli-conversation-first-paint', 'sli/conversation-first-paint/latency-ms', 'p95', 300, '>', 3000.0, 3, 3, 'not_breaching'),
  ('sli-conversation-end-to-end', 'sli/conversation-end-to-end/latency-ms', 'p95', 300, '>', 15000.0, 3, 3, 'not_breaching'),
  ('sli-deal-progress', 'sli/deal-progress/latency-ms', 'p95', 300, '>', 300.0, 3, 3, 'not_breaching'),
  ('burn-fast', 'availability/error-flag', 'Average', 3600, '>', 0.72, 1, 1, 'not_breaching'),
  ('burn-slow', 'availability/error-flag', 'Average', 21600, '>', 0.30, 1, 1, 'not_breaching'),
  ('db-cpu', 'db/cpu', 'Average', 300, '>', 80.0, 3, 3, 'missing'),
  ('db-replica-lag', 'db/replica-lag', 'Average', 300, '>', 1000.0, 2, 2, 'not_breaching'),
  ('search-red', 'search/status-red', 'Maximum', 60, '>=', 1.0, 1, 1, 'not_breaching'),
  ('lb-target-5xx', 'lb/target-5xx', 'Sum', 300, '>', 10.0, 1, 1, 'not_breaching'),
  ('lb-own-5xx', 'lb/own-5xx', 'Sum', 300, '>', 10.0, 1, 1, 'not_breaching'),
  ('queue-age', 'queue/projection-consumer/oldest-age', 'Maximum', 60, '>', 900.0, 3, 3, 'not_breaching'),
  ('cache-cpu', 'cache/cpu', 'Average', 300, '>', 80.0, 3, 3, 'not_breaching'),
  ('cache-memory', 'cache/memory', 'Average', 300, '>', 80.0, 3, 3, 'not_breaching'),
  ('cache-evictions', 'cache/evictions', 'Sum', 300, '>', 0.0, 3, 3, 'not_breaching'),
  ('model-throttles', 'model/throttles', 'Sum', 300, '>=', 1.0, 1, 1, 'not_breaching'),
  ('base-db-cpu', 'base/db-cpu', 'Average', 300, '>=', 80.0, 3, 3, 'missing'),
  ('base-db-connections', 'base/db-connections', 'Average', 300, '>=', 150.0, 2, 2, 'missing'),
  ('base-db-free-storage', 'base/db-free-storage', 'Average', 300, '<', 10737418240.0, 1, 1, 'missing'),
  ('backup-errors', 'backup/errors', 'Sum', 3600, '>=', 1.0, 1, 1, 'missing'),
  ('gateway-cpu', 'service/gateway/cpu', 'Average', 300, '>', 85.0, 3, 3, 'missing'),
  ('gateway-memory', 'service/gateway/memory', 'Average', 300, '>', 85.0, 3, 3, 'missing'),
  ('base-api-cpu', 'base/api/cpu', 'Average', 300, '>=', 85.0, 3, 3, 'missing'),
  ('base-api-memory', 'base/api/memory', 'Average', 300, '>=', 85.0, 3, 3, 'missing'),
  ('projection-consumer-dlq', 'dlq/projection-consumer/visible', 'Maximum', 60, '>=', 1.0, 1, 1, 'missing'),
  ('gateway-unhealthy', 'target/gateway/unhealthy', 'Maximum', 60, '>', 0.0, 3, 3, 'not_breaching'),
  ('running-tasks-low', 'workflow/running-tasks', 'Minimum', 60, '<', 2.0, 5, 5, 'breaching')
)"""


@binding("alarm_catalog", sql=f"""
WITH alarms(alarm_id, metric, stat, period_s, op, threshold, n, m, missing) AS (SELECT * FROM {_CATALOG_SQL}),
scale AS (SELECT metric, max(threshold::DOUBLE) AS t, row_number() OVER (ORDER BY metric) - 1 AS i, count(*) OVER () AS k FROM alarms GROUP BY metric),
samples AS (
  SELECT metric, ts, CASE WHEN t > 0 THEN value * t / 80 ELSE value - 80 END AS value
  FROM events JOIN scale ON (event_id % 97) % k = i),
dp AS (
  SELECT a.alarm_id, CAST(floor(epoch_us(s.ts) / 1000000 / a.period_s) AS BIGINT) AS bucket,
         CASE any_value(a.stat) WHEN 'Average' THEN avg(value) WHEN 'Sum' THEN sum(value) WHEN 'Maximum' THEN max(value)
              WHEN 'Minimum' THEN min(value) ELSE quantile_cont(value, 0.95) END AS value
  FROM samples s JOIN alarms a USING (metric) GROUP BY 1, 2),
grid AS (SELECT a.*, unnest(generate_series(CAST(floor(epoch(TIMESTAMP '2024-01-01') / period_s) AS BIGINT),
                                            CAST(floor(epoch(TIMESTAMP '2024-01-31') / period_s) AS BIGINT))) AS bucket FROM alarms a),
j AS (
  SELECT g.*, d.value, CASE WHEN d.value IS NOT NULL THEN CAST(CASE g.op WHEN '>' THEN d.value > g.threshold WHEN '>=' THEN d.value >= g.threshold
                                                          ELSE d.value < g.threshold END AS INTEGER)
              WHEN g.missing = 'breaching' THEN 1 WHEN g.missing = 'not_breaching' THEN 0 END AS breach
  FROM grid g LEFT JOIN dp d ON g.alarm_id = d.alarm_id AND g.bucket = d.bucket),
w AS (SELECT *, coalesce(list_sum(list_transform(list_reverse(hist)[1:n], lambda x: coalesce(x, 0))), 0) AS n_breach,
             len(list_filter(list_reverse(hist)[1:n], lambda x: x IS NOT NULL)) AS n_counted
      FROM (SELECT *, list(breach) OVER (PARTITION BY alarm_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hist FROM j)),
s AS (SELECT *, CASE WHEN n_breach >= m THEN 'ALARM' WHEN n_counted > 0 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS state FROM w),
c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY alarm_id ORDER BY bucket), 'INSUFFICIENT_DATA') <> state AS changed FROM s)
SELECT alarm_id, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(bucket * period_s) AS period_start,
       CAST(n_breach AS INTEGER) AS n_breach, state FROM c WHERE changed
""")
def alarm_catalog(spark, sf_dir):
    """WIN2/WIN5: the state changes of every catalogue alarm over January; events spread over the metrics."""
    alarms = alarm_rows(services=["gateway"], queues=["projection-consumer"], targets=["gateway"], base_services=["api"], desired_tasks=2)
    scale = {}
    for a in alarms:
        scale[a.metric] = max(scale.get(a.metric, 0.0), a.threshold)
    names = sorted(scale)
    i = F.pmod(F.pmod("event_id", F.lit(97)), F.lit(len(names))).cast("int") + 1
    t = F.element_at(F.array(*[F.lit(scale[n]) for n in names]), i)
    samples = events(spark, sf_dir).select(F.element_at(F.array(*[F.lit(n) for n in names]), i).alias("metric"), "ts",
                                           F.when(t > 0, F.col("value") * t / 80).otherwise(F.col("value") - 80).alias("value"))
    states = S.evaluate_alarms(samples, alarms, start="2024-01-01 00:00:00", end="2024-01-31 00:00:00")
    return S.state_changes(states).select("alarm_id", "period_start", "n_breach", "state")


@binding("stat_switch", sql="""
WITH defs(def_id, metric, stat) AS (VALUES ('click_avg', 'click', 'Average'), ('purchase_sum', 'purchase', 'Sum'),
       ('view_min', 'view', 'Minimum'), ('signup_max', 'signup', 'Maximum'), ('error_p95', 'error', 'p95'),
       ('view_p50', 'view', 'p50'), ('click_p999', 'click', 'p99.9'), ('error_count', 'error', 'SampleCount')),
agg AS (
  SELECT event_type AS metric, date_trunc('hour', ts) AS period_start,
         (sum(CAST(round(value * 100) AS BIGINT)) / count(value)) / 100.0 AS a,
         sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS s,
         min(value) AS mn, max(value) AS mx, round(quantile_cont(value, 0.95), 4) AS p95,
         round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.999), 5) AS p999, CAST(count(value) AS DOUBLE) AS n
  FROM events GROUP BY 1, 2)
SELECT def_id, period_start,
       CASE stat WHEN 'Average' THEN a WHEN 'Sum' THEN s WHEN 'Minimum' THEN mn
                 WHEN 'Maximum' THEN mx WHEN 'p95' THEN p95 WHEN 'p50' THEN p50
                 WHEN 'p99.9' THEN p999 WHEN 'SampleCount' THEN n END AS value
FROM agg JOIN defs USING (metric)
""")
def stat_switch(spark, sf_dir):
    """AGG9/STR4: the statistic each definition row asks for, per hour."""
    ev = events(spark, sf_dir).select(F.col("event_type").alias("metric"), "ts", "value")
    defs = spark.createDataFrame(
        [("click_avg", "click", "Average"), ("purchase_sum", "purchase", "Sum"), ("view_min", "view", "Minimum"),
         ("signup_max", "signup", "Maximum"), ("error_p95", "error", "p95"), ("view_p50", "view", "p50"),
         ("click_p999", "click", "p99.9"), ("error_count", "error", "SampleCount")], "def_id string, metric string, stat string")
    out = S.stat_switch(ev, defs, "1 hour", cents=True)
    # exact sums/averages stay unrounded; the interpolated percentiles are rounded (of 2-decimal values
    # p50 and p99.9 have at most 5 decimals)
    return out.withColumn("value", F.when(F.col("def_id") == "error_p95", F.round("value", 4))
                          .when(F.col("def_id").rlike("_p[0-9]+$"), F.round("value", 5)).otherwise(F.col("value")))


@binding("telemetry_clean", sql="""
WITH e AS (
  SELECT event_id, ts, event_type, json_extract_string(props, '$.k') AS k,
         CASE WHEN event_type <> 'view' THEN 't' || CAST(CAST(floor(user_id / 10) AS BIGINT) AS VARCHAR) END AS tenant
  FROM events)
SELECT event_id, coalesce(tenant, 'unknown') AS tenant_id,
       4 + CASE WHEN k IS NOT NULL THEN 1 ELSE 0 END AS n_attrs,
       'axira.tenant_id,cluster.name,deployment.environment,' || CASE WHEN k IS NOT NULL THEN 'k,' ELSE '' END
         || 'service.namespace' AS attr_keys,
       CASE event_type WHEN 'click' THEN 'axira.llm_call' WHEN 'purchase' THEN 'axira.llm_call:summarize'
                       WHEN 'view' THEN 'axira.llm_callx' WHEN 'signup' THEN 'other' END AS name,
       coalesce(regexp_matches(CASE event_type WHEN 'click' THEN 'axira.llm_call'
                       WHEN 'purchase' THEN 'axira.llm_call:summarize' WHEN 'view' THEN 'axira.llm_callx'
                       WHEN 'signup' THEN 'other' END, '^axira\\.llm_call(:|$)'), false) AS is_llm,
       'axira-logs-' || coalesce(tenant, 'unknown') || '-' || strftime(ts, '%Y.%m.%d') AS index_name
FROM e
""")
def telemetry_clean(spark, sf_dir):
    """PRJ7-9 + FIL3 + FN15: redact, default tenant, upsert resource attributes, LLM flag, index."""
    ev = events(spark, sf_dir)
    tenant = F.when(F.col("event_type") != "view",
                    F.concat(F.lit("t"), F.floor(F.col("user_id") / 10).cast("string")))
    raw = F.map_filter(F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"),
        F.lit("http.request.body"), F.concat(F.lit("body-"), F.col("event_id").cast("string")),
        F.lit("db.statement"), F.lit("select 1"),
        F.lit("axira.tenant_id"), tenant), lambda k, v: v.isNotNull())
    name = (F.when(F.col("event_type") == "click", "axira.llm_call")
            .when(F.col("event_type") == "purchase", "axira.llm_call:summarize")
            .when(F.col("event_type") == "view", "axira.llm_callx")
            .when(F.col("event_type") == "signup", "other"))
    spans = ev.select("event_id", "ts", raw.alias("attributes"), name.alias("name"))
    cleaned = TM.with_index(TM.clean(spans, "staging", "staging-1"))
    return cleaned.select("event_id", "tenant_id", F.size("attributes").alias("n_attrs"),
                          F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("attr_keys"),
                          "name", TM.is_llm_span(F.col("name")).alias("is_llm"), "index_name")


@binding("audit_archive_layout", sql="""
WITH logs AS (
  SELECT ts,
         CASE event_type WHEN 'click' THEN 'am_decision' WHEN 'purchase' THEN 'cap_authz_decision'
                         WHEN 'signup' THEN 'authorization_decision' ELSE 'request_completed' END AS message,
         CASE WHEN user_id < 40 THEN 'axira-gateway' WHEN user_id < 80 THEN 'axira-agent-runtime'
              WHEN user_id < 120 THEN 'axira-workflow-engine' ELSE 'billing' END AS service
  FROM events)
SELECT 'staging' AS env, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
       message, count(*) AS n
FROM logs
WHERE message IN ('am_decision', 'cap_authz_decision', 'authorization_decision')
  AND service IN ('axira-gateway', 'axira-agent-runtime', 'axira-workflow-engine')
GROUP BY 1, 2, 3, 4, 5
""")
def audit_archive_layout(spark, sf_dir):
    """FIL4 + SNK6 layout: decision records per env/year/month/day partition."""
    ev = events(spark, sf_dir)
    message = (F.when(F.col("event_type") == "click", "am_decision")
               .when(F.col("event_type") == "purchase", "cap_authz_decision")
               .when(F.col("event_type") == "signup", "authorization_decision")
               .otherwise("request_completed"))
    service = (F.when(F.col("user_id") < 40, "axira-gateway").when(F.col("user_id") < 80, "axira-agent-runtime")
               .when(F.col("user_id") < 120, "axira-workflow-engine").otherwise("billing"))
    logs = ev.select("ts", message.alias("message"), service.alias("service"))
    laid = TM.archive_layout(TM.audit_decisions(logs), "staging")
    return laid.groupBy("env", "year", "month", "day", "message").agg(F.count(F.lit(1)).alias("n"))


@binding("id_typing", sql="""
SELECT CAST(event_id AS VARCHAR) AS event_id,
       CASE WHEN length(CAST(event_id AS VARCHAR)) <= 1024 THEN CAST(event_id AS VARCHAR) END AS event_id_keyword,
       CAST(user_id AS VARCHAR) AS user_id,
       CASE WHEN length(CAST(user_id AS VARCHAR)) <= 1024 THEN CAST(user_id AS VARCHAR) END AS user_id_keyword,
       event_type, value
FROM events
""")
def id_typing(spark, sf_dir):
    """PRJ10: id columns by name regex -> exact-match strings with a length-capped keyword copy."""
    ev = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    return TM.type_ids(ev, pattern=r"(_id|key)$")


@binding("attribute_typing", sql="""
WITH e AS (SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events),
a AS (SELECT *, '{"' || event_type || 'Id":"' || event_type || '-' || user_id || '","depth":' || coalesce(k, 'null') || '}' AS message FROM e)
SELECT event_id, CASE WHEN event_type = 'click' THEN 'click-' || user_id END AS clickId, CASE WHEN event_type = 'click' THEN 'click-' || user_id END AS clickId_keyword,
       CASE WHEN event_type = 'signup' THEN 'signup-' || user_id END AS signupId, CASE WHEN event_type = 'signup' AND length('signup-' || user_id) <= 9 THEN 'signup-' || user_id END AS signupId_keyword,
       TRY_CAST(k AS BIGINT) AS depth, CASE WHEN length(message) <= 30 THEN message END AS message_raw FROM a
""")
def attribute_typing(spark, sf_dir):
    """PRJ10: ids found by the name rule among attributes that are not known beforehand; the others stay in the VARIANT."""
    ev = events(spark, sf_dir)
    k = F.get_json_object("props", "$.k")
    message = F.concat(F.lit('{"'), "event_type", F.lit('Id":"'), "event_type", F.lit("-"), F.col("user_id").cast("string"),
                       F.lit('","depth":'), F.coalesce(k, F.lit("null")), F.lit("}"))
    rows = ev.select("event_id", message.alias("message"), message.alias("attributes"))
    typed = TM.type_attributes(rows, pattern="^(click|signup|order)Id$", ignore_above=9)
    return typed.select("event_id", "clickId", F.coalesce("clickId_keyword", "clickId").alias("clickId_keyword"), "signupId", "signupId_keyword",
                        F.try_variant_get("attributes", "$.depth", "bigint").alias("depth"), TM.message_raw(F.col("message"), 30).alias("message_raw"))
