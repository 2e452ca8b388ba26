"""Routing, notification, limit and allow-list bindings over ``events``/``customer``."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from ..operators import limits as LM
from ..operators import routing as R
from ..plans.routing import (FIFO_DEDUP_S, KIND_ALLOWLISTS, MAX_RECEIVE_DEFAULT, MAX_RECEIVE_PROD,
                             ORIGIN_ALLOW_V4, ORIGIN_ALLOW_V6, PRIORITY_TOPICS, base_edges, edges_frame,
                             staging_edges)
from ..session import table
from . import binding
from .common import events

_TOPIC = {"signup": "axira-events-user-profile", "click": "axira-events-agent", "view": "axira-events-document",
          "purchase": "axira-events-approval", "error": "axira-events-mission"}
_DOMAIN = {"signup": "events", "click": "agent", "view": "documents", "purchase": "deal", "error": "monitoring"}
_KIND = {"click": "alert.fired", "purchase": "runbook.drafted", "view": "service.unhealthy",
         "signup": "infra.snapshot", "error": "error_group.spike"}
_OPS_TYPE = {"signup": "tenant_provisioned", "click": "deploy_succeeded", "view": "certification_completed",
             "purchase": "release_available", "error": "deploy_failed"}
_URGENCY = {"error": "p1", "purchase": "p2", "signup": "warning"}


def _case_sql(col, mapping, default="NULL"):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


def _case(col, mapping, default=None):
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, F.lit(v)) if out is None else out.when(F.col(col) == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def _values(rows):
    def lit(x):
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, (int, float)):
            return repr(x)
        return "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


@binding("fanout", sql=f"""
WITH edges(topic, consumer, priority) AS (VALUES {_values(base_edges())}),
m AS (SELECT event_id, {_case_sql('event_type', _TOPIC)} AS topic FROM events)
SELECT e.consumer, m.topic, e.priority, count(*) AS n
FROM m JOIN edges e ON m.topic = e.topic GROUP BY 1, 2, 3
""")
def fanout(spark, sf_dir):
    """JN5/STR9: topic -> consumer fan-out over the 58 configured edges; priority lane flag."""
    msgs = events(spark, sf_dir).select("event_id", _case("event_type", _TOPIC).alias("topic"))
    out = R.fan_out(msgs, edges_frame(spark))
    return out.groupBy("consumer", "topic", "priority").agg(F.count(F.lit(1)).alias("n"))


@binding("staging_fanout", sql=f"""
WITH edges(topic, consumer, priority) AS (VALUES {_values(staging_edges())}),
m AS (SELECT event_id, {_case_sql('event_type', _DOMAIN)} AS topic FROM events)
SELECT e.consumer, e.priority, count(*) AS n, count(DISTINCT m.topic) AS topics
FROM m JOIN edges e ON m.topic = e.topic GROUP BY 1, 2
""")
def staging_fanout(spark, sf_dir):
    """JN6: all-to-all domain fan-out (24 topics x 9 queues + 24 priority = 240 edges)."""
    msgs = events(spark, sf_dir).select("event_id", _case("event_type", _DOMAIN).alias("topic"))
    out = R.fan_out(msgs, edges_frame(spark, staging_edges()))
    return out.groupBy("consumer", "priority").agg(F.count(F.lit(1)).alias("n"),
                                                   F.countDistinct("topic").alias("topics"))


@binding("kind_allowlist", sql="WITH m AS (SELECT " + _case_sql("event_type", _KIND) + " AS kind FROM events), "
         + "lists(subscriber, kind) AS (VALUES " + _values([(s, k) for s, ks in KIND_ALLOWLISTS.items() for k in ks])
         + """)
SELECT l.subscriber, m.kind, count(*) AS n FROM m JOIN lists l ON m.kind = l.kind GROUP BY 1, 2
""")
def kind_allowlist(spark, sf_dir):
    """FIL6/FIL7: the messages that each subscription's kind allow-list lets through."""
    msgs = events(spark, sf_dir).select(_case("event_type", _KIND).alias("kind"))
    out = None
    for subscriber, kinds in KIND_ALLOWLISTS.items():               # configuration: a few lists
        rows = R.allow(msgs, "kind", kinds).select(F.lit(subscriber).alias("subscriber"), "kind")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("subscriber", "kind").agg(F.count(F.lit(1)).alias("n"))


def ops_events(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.select(
        "event_id", "ts", "user_id", "value", "event_type",
        _case("event_type", _OPS_TYPE).alias("type"),
        _case("event_type", _URGENCY, "info").alias("urgency"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("tenant_id"))


_SUFFIX = {"deployments": "deploy", "incidents": "incidents", "releases": "releases", "certifications": "certs"}


def tenant_config(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "MACHINERY")   # no configuration
    provider = _case("c_mktsegment", {"AUTOMOBILE": "slack", "BUILDING": "teams", "FURNITURE": "both",
                                      "HOUSEHOLD": "none"})
    k = F.col("c_custkey").cast("string")

    def chans(fmt):
        return F.create_map(*[x for cat, suf in _SUFFIX.items() for x in (F.lit(cat), F.format_string(fmt, k, F.lit(suf)))])
    return c.select(F.concat(F.lit("c"), k).alias("tenant_id"), provider.alias("provider"),
                    chans("#c%s-%s").alias("slack_channels"), chans("teams-c%s-%s").alias("teams_channels"))


_INTERNAL_SQL = ("CASE type WHEN 'deploy_started' THEN '#axira-deployments' WHEN 'deploy_succeeded' THEN '#axira-deployments' "
                 "WHEN 'deploy_failed' THEN '#axira-deployments' WHEN 'release_available' THEN '#axira-releases' "
                 "WHEN 'tenant_provisioned' THEN '#axira-tenants' WHEN 'accuracy_regression' THEN '#axira-incidents' "
                 "ELSE '#axira-deployments' END")
_CATEGORY_SQL = ("CASE type WHEN 'release_available' THEN 'releases' WHEN 'certification_completed' THEN 'certifications' "
                 "WHEN 'accuracy_regression' THEN 'incidents' ELSE 'deployments' END")


@binding("notify_targets", sql=f"""
WITH ev AS (
  SELECT event_id, {_case_sql('event_type', _OPS_TYPE)} AS type,
         {_case_sql('event_type', _URGENCY, "'info'")} AS urgency, 'c' || CAST(user_id AS VARCHAR) AS tenant_id
  FROM events),
cfg AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS tenant_id, CAST(c_custkey AS VARCHAR) AS k,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'slack' WHEN 'BUILDING' THEN 'teams'
                           WHEN 'FURNITURE' THEN 'both' WHEN 'HOUSEHOLD' THEN 'none' END AS provider
  FROM customer WHERE c_mktsegment <> 'MACHINERY'),
internal AS (SELECT event_id, urgency, {_INTERNAL_SQL} AS channel FROM ev)
SELECT event_id, 'internal-slack' AS sink, channel FROM internal
UNION ALL
SELECT event_id, 'internal-slack', '#axira-incidents' FROM internal WHERE urgency = 'p1' AND channel <> '#axira-incidents'
UNION ALL
SELECT e.event_id, s.sink,
       CASE s.sink WHEN 'slack' THEN '#c' ELSE 'teams-c' END || c.k || '-' ||
       CASE {_CATEGORY_SQL} WHEN 'deployments' THEN 'deploy' WHEN 'incidents' THEN 'incidents'
                            WHEN 'releases' THEN 'releases' ELSE 'certs' END
FROM ev e JOIN cfg c ON e.tenant_id = c.tenant_id
JOIN (VALUES ('slack'), ('teams')) s(sink) ON c.provider = s.sink OR c.provider = 'both'
""")
def notify_targets(spark, sf_dir):
    """JN9 + FN10-14: internal channel, p1 escalation, tenant provider fan-out and channel."""
    return R.notification_targets(ops_events(spark, sf_dir), tenant_config(spark, sf_dir))


_EMOJI_SQL = "CASE urgency WHEN 'warning' THEN '⚠️' WHEN 'p2' THEN '\U0001f7e0' WHEN 'p1' THEN '\U0001f534' ELSE 'ℹ️' END"
_COLOR_SQL = "CASE urgency WHEN 'info' THEN 'good' WHEN 'warning' THEN 'warning' WHEN 'p2' THEN 'warning' WHEN 'p1' THEN 'attention' ELSE 'default' END"


@binding("payload_json", sql=f"""
WITH ev AS (
  SELECT event_id, {_case_sql('event_type', _OPS_TYPE)} AS type,
         {_case_sql('event_type', _URGENCY, "'info'")} AS urgency,
         CASE WHEN user_id < 75 THEN 'gateway' END AS service,
         CASE WHEN event_type = 'view' THEN '' ELSE 'value=' || CAST(value AS VARCHAR) END AS message,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS n_details,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS has_action
  FROM events)
SELECT event_id,
       {_EMOJI_SQL} || ' ' || type || ' #' || CAST(event_id AS VARCHAR) AS slack_header,
       2 + CASE WHEN message <> '' THEN 1 ELSE 0 END + has_action AS slack_blocks,
       2 + CASE WHEN service IS NOT NULL THEN 1 ELSE 0 END + n_details AS n_fields,
       {_COLOR_SQL} AS teams_color,
       2 + CASE WHEN service IS NOT NULL THEN 1 ELSE 0 END + n_details AS n_facts,
       has_action = 1 AS teams_actions
FROM ev
""")
def payload_json(spark, sf_dir):
    """PRJ12: Slack and Teams payloads rendered as JSON; fields read back for checking."""
    ev = ops_events(spark, sf_dir).select(
        "event_id", "type", "urgency",
        F.concat("type", F.lit(" #"), F.col("event_id").cast("string")).alias("title"),
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(
            F.concat(F.lit("value="), F.col("value").cast("string"))).alias("message"),
        F.when(F.col("user_id") < 75, F.lit("gateway")).alias("service"),
        F.lit(None).cast("string").alias("version"), F.lit("staging").alias("environment"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("event_type") == "error",
               F.create_map(F.lit("user"), F.col("user_id").cast("string"))).alias("details"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("https://ops.example/e/"), F.col("event_id").cast("string"))).alias("actionUrl"),
        F.lit(None).cast("string").alias("logsUrl"))
    out = ev.select("event_id", R.render_slack(ev).alias("slack"), R.render_teams(ev).alias("teams"))
    gj = F.get_json_object
    return out.select(
        "event_id",
        gj("slack", "$.blocks[0].text.text").alias("slack_header"),
        F.json_array_length(gj("slack", "$.blocks")).alias("slack_blocks"),
        F.json_array_length(gj("slack", "$.blocks[1].fields")).alias("n_fields"),
        gj("teams", "$.attachments[0].content.body[0].color").alias("teams_color"),
        F.json_array_length(gj("teams", "$.attachments[0].content.body[1].facts")).alias("n_facts"),
        gj("teams", "$.attachments[0].content.actions").isNotNull().alias("teams_actions"))


@binding("dlq_split", sql=f"""
WITH m AS (SELECT {_case_sql('event_type', _TOPIC)} AS topic, CAST(floor(second(ts) / 8) AS INTEGER) AS rc FROM events),
t(max_receive) AS (VALUES ({MAX_RECEIVE_DEFAULT}), ({MAX_RECEIVE_PROD}))
SELECT topic, max_receive, CASE WHEN rc > max_receive THEN 'dead' ELSE 'live' END AS lane, count(*) AS n
FROM m, t GROUP BY 1, 2, 3
""")
def dlq_split(spark, sf_dir):
    """STR8: live vs dead-letter per topic at both configured receive limits."""
    msgs = events(spark, sf_dir).select(_case("event_type", _TOPIC).alias("topic"),
                                        F.floor(F.second("ts") / 8).cast("int").alias("receive_count"))
    out = None
    for limit in (MAX_RECEIVE_DEFAULT, MAX_RECEIVE_PROD):
        for lane, rows in zip(("live", "dead"), R.dead_letter(msgs, limit)):
            rows = rows.select("topic", F.lit(limit).alias("max_receive"), F.lit(lane).alias("lane"))
            out = rows if out is None else out.unionByName(rows)
    return out.groupBy("topic", "max_receive", "lane").agg(F.count(F.lit(1)).alias("n"))


@binding("fifo_dedup", sql=f"""
WITH RECURSIVE m AS (SELECT event_id, epoch_us(ts) AS us, sha256(concat_ws(':', CAST(user_id AS VARCHAR), event_type)) AS dedup_id FROM events),
acc AS (SELECT dedup_id, min(us) AS us FROM m GROUP BY 1
        UNION ALL
        SELECT a.dedup_id, (SELECT min(m.us) FROM m WHERE m.dedup_id = a.dedup_id AND m.us >= a.us + 300000000) FROM acc a WHERE a.us IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY dedup_id, us ORDER BY event_id) AS rn FROM m)
SELECT event_id, f.dedup_id, NOT (acc.us IS NOT NULL AND rn = 1) AS is_duplicate
FROM f LEFT JOIN acc ON acc.dedup_id = f.dedup_id AND acc.us = f.us
""")
def fifo_dedup(spark, sf_dir):
    """STR6: content-based dedup id; a repeat within 5 minutes of the last accepted sighting is dropped."""
    ev = events(spark, sf_dir).select("event_id", "ts", R.content_dedup_id("user_id", "event_type").alias("dedup_id"))
    return R.gap_dedup(ev, "dedup_id", "ts", FIFO_DEDUP_S, tiebreak=["event_id"]).select(
        "event_id", "dedup_id", "is_duplicate")


@binding("replay_guard", sql="""
WITH RECURSIVE m AS (
  SELECT event_id, user_id, json_extract_string(props, '$.k') AS nonce, ts AS sent,
         ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS received
  FROM events),
f AS (SELECT *, abs(epoch_us(received) - epoch_us(sent)) <= 300000000 AS fresh FROM m),
g AS (SELECT event_id, coalesce(user_id || '/' || nonce, 'u' || user_id) AS key, epoch_us(received) AS us FROM f WHERE fresh),
acc AS (SELECT key, min(us) AS us FROM g GROUP BY 1
        UNION ALL
        SELECT a.key, (SELECT min(g.us) FROM g WHERE g.key = a.key AND g.us >= a.us + 600000000) FROM acc a WHERE a.us IS NOT NULL),
r AS (SELECT g.event_id, NOT (acc.us IS NOT NULL AND row_number() OVER (PARTITION BY g.key, g.us ORDER BY g.event_id) = 1) AS replay
      FROM g LEFT JOIN acc ON acc.key = g.key AND acc.us = g.us)
SELECT f.event_id, f.fresh, CASE WHEN f.fresh THEN r.replay END AS replay, f.fresh AND NOT coalesce(r.replay, false) AS accepted
FROM f LEFT JOIN r ON f.event_id = r.event_id
""")
def replay_guard(spark, sf_dir):
    """FIL12 + STR7: freshness window 300 s, nonce replay TTL 600 s per customer."""
    ev = events(spark, sf_dir).select(
        "event_id", "user_id", F.get_json_object("props", "$.k").alias("nonce"), F.col("ts").alias("sent"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value").cast("decimal(18,6)")))
        .alias("received"))
    out = LM.replay_guard(ev, "user_id", "nonce", "sent", "received", "event_id")
    return out.select("event_id", "fresh", "replay", "accepted")


@binding("rate_limit", sql="""
WITH x AS (SELECT user_id, date_trunc('hour', ts) - to_hours(t.k) AS window_start FROM events, range(0, 6) t(k))
SELECT user_id, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n
FROM x GROUP BY 1, 2 HAVING count(*) > 2
""")
def rate_limit(spark, sf_dir):
    """AGG13/STR5: trailing 6-hour window sliding by 1 hour, per user, above 2 events."""
    return LM.rate_violations(events(spark, sf_dir), "user_id", "ts", "6 hours", "1 hour", 2)


@binding("rate_limit_minute", sql="""
SELECT event_type, date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end, count(*) AS n
FROM events GROUP BY 1, 2 HAVING count(*) > 1
""")
def rate_limit_minute(spark, sf_dir):
    """AGG14: events per customer (here: type) and minute above the limit."""
    return LM.rate_violations(events(spark, sf_dir), "event_type", "ts", "1 minute", None, 1)


@binding("quota_daily", sql="""
SELECT user_id, date_trunc('day', ts) AS period_start, count(*) AS used, count(*) > 4 AS over
FROM events GROUP BY 1, 2
""")
def quota_daily(spark, sf_dir):
    """AGG15: calls per tenant per day vs a daily quota."""
    out = LM.quota(events(spark, sf_dir), "user_id", "ts", "day", None, 4)
    return out.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@binding("budget_monthly", sql="""
SELECT user_id, date_trunc('month', ts) AS period_start, sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS used,
       sum(CAST(round(value * 100) AS BIGINT)) > 50000 AS over
FROM events GROUP BY 1, 2
""")
def budget_monthly(spark, sf_dir):
    """AGG15: spend per tenant per month vs the 500 USD budget."""
    # money in exact cents: the monthly total does not depend on summation order
    cents = F.round(F.col("value") * 100).cast("long")
    out = LM.quota(events(spark, sf_dir), "user_id", "ts", "month", cents, 50000)
    return out.withColumn("used", F.col("used") / 100.0).withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


TEST_CIDRS = ("10.0.0.0/12", "10.32.0.0/11", "10.100.5.0/24", "10.120.0.0/13", "10.140.0.0/14", "10.140.12.0/22")


def _cidr_values():
    rows = []
    for c in TEST_CIDRS + ORIGIN_ALLOW_V4:
        n = ipaddress.ip_network(c)
        rows.append((c, int(n.network_address), n.prefixlen))
    return _values(rows)


@binding("cidr_match", sql=f"""
WITH ev AS (
  SELECT event_id, least(user_id, 255) AS o2, hour(ts) AS o3, CAST(least(floor(value), 255) AS BIGINT) AS o4 FROM events),
a AS (SELECT event_id, '10.' || o2 || '.' || o3 || '.' || o4 AS ip,
             (CAST(10 AS BIGINT) << 24) + (CAST(o2 AS BIGINT) << 16) + (CAST(o3 AS BIGINT) << 8) + o4 AS ipn FROM ev),
c(cidr, net, len) AS (VALUES {_cidr_values()}),
m AS (SELECT a.event_id, arg_max(c.cidr, c.len) AS matched_cidr
      FROM a JOIN c ON (a.ipn >> (32 - c.len)) = (c.net >> (32 - c.len)) GROUP BY a.event_id)
SELECT a.event_id, a.ip, m.matched_cidr IS NOT NULL AS matched, m.matched_cidr FROM a LEFT JOIN m USING (event_id)
""")
def cidr_match(spark, sf_dir):
    """FIL8/JN11: IPv4/IPv6 allow-list as a prefix equi-join; longest match reported."""
    ev = events(spark, sf_dir)
    ip = F.concat_ws(".", F.lit("10"), F.least(F.col("user_id"), F.lit(255)).cast("string"),
                     F.hour("ts").cast("string"), F.least(F.floor("value"), F.lit(255)).cast("string"))
    reqs = ev.select("event_id", ip.alias("ip"))
    cidrs = spark.createDataFrame([(c,) for c in TEST_CIDRS + ORIGIN_ALLOW_V4 + ORIGIN_ALLOW_V6], "cidr string")
    return LM.match_cidr(reqs, "ip", cidrs).select("event_id", "ip", "matched", "matched_cidr")


AS_OF_QUEUE = "2024-01-31 00:00:00"


@binding("queue_backlog", sql=f"""
SELECT event_type AS topic, count(*) AS depth,
       CAST(floor((epoch_us(TIMESTAMP '{AS_OF_QUEUE}') - epoch_us(min(ts))) / 1000000) AS BIGINT) AS oldest_age_s,
       CAST(floor((epoch_us(TIMESTAMP '{AS_OF_QUEUE}') - epoch_us(min(ts))) / 1000000) AS BIGINT) > 900 AS stale
FROM events WHERE ts >= TIMESTAMP '{AS_OF_QUEUE}' - INTERVAL 4 DAY
GROUP BY 1
""")
def queue_backlog(spark, sf_dir):
    """AGG16/FIL13/STR10: after 4-day retention, depth and oldest-message age per queue."""
    msgs = events(spark, sf_dir).select(F.col("event_type").alias("topic"), F.col("ts").alias("sent_at"))
    kept = R.drop_older_than(msgs, "sent_at", 4, AS_OF_QUEUE)
    return R.backlog(kept, AS_OF_QUEUE)


@binding("priority_split", sql=f"""
WITH m AS (SELECT {_case_sql('event_type', _TOPIC)} AS topic FROM events)
SELECT CASE WHEN topic IN ({', '.join(repr(t) for t in PRIORITY_TOPICS)}) THEN 'priority' ELSE 'normal' END AS lane,
       topic, count(*) AS n FROM m GROUP BY 1, 2
""")
def priority_split(spark, sf_dir):
    """STR9: priority (approval, mission) vs normal lane."""
    msgs = events(spark, sf_dir).select(_case("event_type", _TOPIC).alias("topic"))
    first, rest = R.split_priority(msgs, PRIORITY_TOPICS)
    lanes = first.withColumn("lane", F.lit("priority")).unionByName(rest.withColumn("lane", F.lit("normal")))
    return lanes.groupBy("lane", "topic").agg(F.count(F.lit(1)).alias("n"))
