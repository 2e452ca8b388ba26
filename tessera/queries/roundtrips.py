"""Bindings that write what an operator writes and read it again: files, sinks, streams, the whole registry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evalgate as EG
from ..operators import load as L
from ..operators import project as P
from ..operators import telemetry as TM
from ..plans.dispatch import FACT_TABLES, REGISTRY, load_order
from ..plans.routing import FIFO_DEDUP_S
from ..session import materialize, shared_path, table
from ..sources import bronze as BZ
from ..streaming import stateful as ST
from . import binding
from .common import bronze_files, events
from .governance import _EVAL_SQL, _eval_inputs
from .loader import _FILES_SQL, _LOG_SQL, _derived_log


def _folder(spark, name: str) -> str:
    return shared_path(spark, name, uuid.uuid4().hex)


# ------------------------------------------------------------- whole registry

def _leaf(path: str, typ: str):
    """The value an envelope of this binding carries at a path: text, number, flag or time of its event."""
    last = path.rsplit(".", 1)[-1]
    if typ == "string":
        return F.concat(F.lit(f"{last}-"), F.col("event_id"))
    if typ in ("int", "long"):           # every seventh event has a malformed number
        return F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("event_id").cast("string"))
    if typ in ("double", "decimal(18,2)"):
        return F.col("value").cast("string")
    if typ == "boolean":
        return (F.col("event_id") % 2 == 0).cast("string")
    return F.date_format("ts", "yyyy-MM-dd" if typ == "date" else "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _nested(leaves: dict):
    """A JSON object column from ``{path parts: column}``."""
    fields = {}
    for parts, col in leaves.items():
        fields.setdefault(parts[0], {})[parts[1:]] = col
    return F.struct(*[(sub[()] if () in sub else _nested(sub)).alias(name) for name, sub in fields.items()])


def registry_envelopes(spark, sf_dir):
    """Events dealt over all event types of the registry, with a value at every path."""
    types = sorted(REGISTRY)
    t = F.element_at(F.array(*[F.lit(x) for x in types]), (F.pmod("event_id", F.lit(len(types))) + 1).cast("int"))
    ev = events(spark, sf_dir).withColumn("type", t)
    data = None
    for x in types:
        e = REGISTRY[x]
        leaves = {tuple(p.split(".")[1:]): _leaf(p, typ) for p, typ in zip(e.paths, e.types) if p.startswith("data.")}
        text = F.to_json(_nested(leaves))
        data = F.when(F.col("type") == x, text) if data is None else data.when(F.col("type") == x, text)
    return ev.select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), "type",
                     F.lit("t1").alias("tenantid"), F.lit("c1").alias("caseid"), data.alias("data"))


def _registry_values() -> str:
    rows = []
    for n, x in enumerate(sorted(REGISTRY)):
        e = REGISTRY[x]
        for c, typ in FACT_TABLES[e.table].columns:
            path = e.paths[e.columns.index(c)] if c in e.columns else ""
            rows.append(f"({n}, '{x}', '{e.table}', '{c}', '{path.rsplit('.', 1)[-1]}', '{path.split('.')[0]}', '{typ}')")
    return ", ".join(rows)


@binding("dispatch_all", sql=f"""
WITH r(n, event_type, table_name, column_name, leaf, root, typ) AS (VALUES {_registry_values()}),
v AS (
  SELECT r.event_type, table_name, column_name,
         CASE WHEN root = '' THEN NULL
              WHEN root = 'type' THEN r.event_type
              WHEN typ = 'timestamp' THEN CAST(epoch_us(ts) AS VARCHAR)
              WHEN typ = 'string' THEN leaf || '-' || event_id
              WHEN typ IN ('int', 'long') THEN CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END
              WHEN typ = 'double' THEN CAST(value AS VARCHAR)
              WHEN typ = 'decimal(18,2)' THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
              WHEN typ = 'boolean' THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
              ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS x
  FROM events JOIN r ON event_id % {len(REGISTRY)} = r.n)
SELECT event_type, table_name, column_name, count(*) AS n_rows, count(x) AS n_values, min(x) AS lo, max(x) AS hi
FROM v GROUP BY 1, 2, 3
""")
def dispatch_all(spark, sf_dir):
    """PRJ1-6, SNK1: all event types of the registry through their projections; values per type, table and column."""
    env, out = materialize(registry_envelopes(spark, sf_dir), "registry-envelopes"), None
    for name, ft in FACT_TABLES.items():
        entries = [e for e in REGISTRY.values() if e.table == name]
        rows = P.project_table(env, entries, table=name)
        rows = _column_values(rows, ft.columns, [e.event_type for e in entries]).select("event_type", F.lit(name).alias("table_name"), "v.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _column_values(rows, columns, types):
    """``event_type, v``: rows and values of every column of one table, per type that occurs.

    One aggregate without keys over (type, column): least and greatest strings
    by key would be sorted, all rows and columns of a task at once.
    """
    texts = [(F.unix_micros(c) if typ == "timestamp" else F.col(c)).cast("string").alias(c) for c, typ in columns]
    rows = rows.select("_event_type", *texts)
    sums = []
    for k, x in enumerate(types):
        of_type = F.col("_event_type") == x
        per_column = []
        for c, _ in columns:
            value = F.when(of_type, F.col(c))
            per_column.append(F.struct(F.lit(c).alias("column_name"), F.count_if(of_type).alias("n_rows"), F.count(value).alias("n_values"),
                                       F.min(value).alias("lo"), F.max(value).alias("hi")))
        sums.append(F.struct(F.lit(x).alias("event_type"), F.array(*per_column).alias("values")))
    found = rows.agg(F.array(*sums).alias("types")).select(F.explode("types").alias("t"))
    return found.select("t.event_type", F.explode("t.values").alias("v")).filter("v.n_rows > 0")


@binding("apply_order", sql=f"""
WITH t AS (SELECT DISTINCT event_id % {len(REGISTRY)} AS n FROM events),
r(n, event_type) AS (VALUES {", ".join(f"({n}, '{x}')" for n, x in enumerate(sorted(REGISTRY)))}),
m AS (SELECT event_type, event_type LIKE '%.mission.completed.v1' OR (event_type LIKE '%.agent.task.%' AND event_type NOT LIKE '%.submitted.v1') AS is_merge
      FROM t JOIN r USING (n))
SELECT event_type, row_number() OVER (ORDER BY is_merge, event_type) AS position FROM m
""")
def apply_order(spark, sf_dir):
    """WIN3/SRT1 + SRC3: the event types present, INSERT types before MERGE types, then by name."""
    env = registry_envelopes(spark, sf_dir).select(F.col("type").alias("event_type"))
    present = [r["event_type"] for r in BZ.list_event_types(env).collect()]          # at most the registry's types
    return spark.createDataFrame(list(enumerate(load_order(present), 1)), "position long, event_type string").select("event_type", "position")


# ------------------------------------------------------------------ load log

@binding("forget_files", sql="WITH " + _FILES_SQL + "," + _LOG_SQL + """
SELECT event_type, s3_key, status, copied_at FROM log
WHERE (event_type, s3_key) NOT IN (SELECT event_type, s3_key FROM state WHERE status = 'abandoned')
""")
def forget_files(spark, sf_dir):
    """JN16: the load log without the rows of files named for a new load (here: the abandoned ones)."""
    log = _derived_log(bronze_files(events(spark, sf_dir)))
    gone = L.load_state(log).filter("status = 'abandoned'")
    return L.forget_files(log, gone).select("event_type", "s3_key", "status", F.col("copied_at").cast("timestamp_ntz").alias("copied_at"))


@binding("recent_state", sql="WITH " + _FILES_SQL + "," + _LOG_SQL + """,
recent AS (SELECT *, row_number() OVER (PARTITION BY event_type, s3_key ORDER BY copied_at DESC, status DESC) AS rn,
                  count(*) OVER (PARTITION BY event_type, s3_key) AS tries
           FROM log WHERE copied_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 49 HOUR)
SELECT event_type, s3_key, status, tries AS attempts FROM recent WHERE rn = 1
""")
def recent_state(spark, sf_dir):
    """FIL1: the load log's state over the last 48 hours and the running one."""
    log = _derived_log(bronze_files(events(spark, sf_dir)))
    return L.load_state(log, as_of="2024-01-20 12:00:00", hours=48).select("event_type", "s3_key", "status", "attempts")


@binding("tuple_chunks", sql="""
WITH o AS (SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 50) AS chunk FROM orders)
SELECT CAST(chunk AS INTEGER) AS chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM o GROUP BY 1
""")
def tuple_chunks(spark, sf_dir):
    """WIN4: write batches of 50 in key order, numbered without a global window."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return L.chunk(keys, 50, ["o_orderkey"]).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@binding("staging_union", sql="""
SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n, count(c_mktsegment) AS segments, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents
FROM customer GROUP BY 1, 2
UNION ALL
SELECT 'supplier', s_nationkey, count(*), 0, sum(CAST(round(s_acctbal * 100) AS BIGINT)) FROM supplier GROUP BY 1, 2
""")
def staging_union(spark, sf_dir):
    """SET3 + DML4: two groups and an empty clone of the first united by name; missing columns are NULL."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"),
                                                F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    both = P.unify([P.empty_like(c), c, s])
    return both.groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), F.count("segment").alias("segments"),
                                              F.sum(F.round(F.col("bal") * 100).cast("long")).alias("cents"))


# --------------------------------------------------------------- event files

@binding("bronze_roundtrip", sql="""
WITH e AS (SELECT event_type, ts, event_id % 50 = 0 AS bad FROM events)
SELECT event_type, CASE WHEN bad THEN 'rejected' ELSE 'read' END AS outcome, count(*) AS n,
       count(*) FILTER (WHERE NOT bad AND ts >= TIMESTAMP '2024-01-15 12:00:00' AND ts < TIMESTAMP '2024-01-15 18:00:00') AS in_lookback
FROM e GROUP BY 1, 2
""")
def bronze_roundtrip(spark, sf_dir):
    """SRC1-6, SNK7: all events as partitioned JSON lines (some malformed), read back, split and looked back on."""
    root, rejected = _folder(spark, "bronze"), _folder(spark, "rejects")
    ev = events(spark, sf_dir)
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("string").alias("time"), F.col("event_type").alias("type")))
    lines = ev.select(F.when(F.col("event_id") % 50 == 0, F.lit("{not json")).otherwise(line).alias("value"), "event_type",
                      F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), (F.hour("ts") - F.hour("ts") % 6).alias("hour"))
    # a writer that rolls every six hours: one folder per type and roll, cut over files by size
    lines.repartitionByRange(*BZ.PARTITION_COLS).write.partitionBy(*BZ.PARTITION_COLS).text(root)
    rows = materialize(BZ.read_bronze(spark, root, pattern="*.txt"), "bronze-rows")
    good, bad = BZ.split_corrupt(rows)
    BZ.write_rejects(bad, rejected)
    late = BZ.lookback(good, "2024-01-15 12:30:00", 2).select("id").withColumn("recent", F.lit(True))
    again = spark.read.schema("event_type string").json(rejected)
    good = good.join(late, "id", "left").select("event_type", F.lit("read").alias("outcome"), F.coalesce("recent", F.lit(False)).alias("recent"))
    again = again.select("event_type", F.lit("rejected").alias("outcome"), F.lit(False).alias("recent"))
    return good.unionByName(again).groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("recent").alias("in_lookback"))


# ----------------------------------------------------------------- telemetry

@binding("telemetry_sinks", sql="""
WITH e AS (SELECT ts, event_type, CASE WHEN event_type <> 'view' THEN 't' || CAST(CAST(floor(user_id / 100) AS BIGINT) AS VARCHAR) ELSE 'unknown' END AS tenant
           FROM events)
SELECT 'main' AS sink, tenant AS tenant_id, strftime(ts, '%Y.%m.%d') AS day, count(*) AS n FROM e GROUP BY 1, 2, 3
UNION ALL
SELECT 'llm', tenant, strftime(ts, '%Y.%m.%d'), count(*) FROM e WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2, 3
""")
def telemetry_sinks(spark, sf_dir):
    """SNK4-5, DML8: two batches of spans into both sinks, one batch written twice, then compacted."""
    main, llm, packed = (_folder(spark, f"telemetry-{x}") for x in ("main", "llm", "packed"))
    ev = events(spark, sf_dir)
    tenant = F.when(F.col("event_type") != "view", F.concat(F.lit("t"), F.floor(F.col("user_id") / 100).cast("string")))
    name = F.when(F.col("event_type") == "click", "axira.llm_call").when(F.col("event_type") == "purchase", "axira.llm_call:plan").otherwise("other")
    spans = ev.select("event_id", "ts", name.alias("name"), F.map_filter(F.create_map(F.lit("axira.tenant_id"), tenant), lambda k, v: v.isNotNull()).alias("attributes"))
    for batch in (0, 1, 1):
        TM.tee(spans.filter(F.col("event_id") % 2 == batch), main, llm, batch=batch)
    TM.compact(spark, main, packed)
    out = None
    for sink, path in (("main", packed), ("llm", llm)):
        rows = spark.read.parquet(path).select(F.lit(sink).alias("sink"), "tenant_id", F.col("day").cast("string").alias("day"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("sink", "tenant_id", "day").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- eval report

@binding("eval_report_document", sql="WITH " + _EVAL_SQL + """
SELECT a.agent_id, a.status, a.n_skills, coalesce(n_down, 0) AS n_down, t.total, t.down, t.warned, t.passing, t.down > 0 AS has_regression, t.warned > 0 AS has_warning,
       '2024-02-01T00:00:00.000Z' AS stamp
FROM agents a LEFT JOIN (SELECT agent_id, count(*) FILTER (WHERE status = 'REGRESSION') AS n_down FROM cmp2 GROUP BY 1) s
     ON a.agent_id IS NOT DISTINCT FROM s.agent_id,
     (SELECT count(*) AS total, count(*) FILTER (WHERE regressions > 0) AS down, count(*) FILTER (WHERE warnings > 0) AS warned,
             count(*) FILTER (WHERE regressions = 0 AND warnings = 0) AS passing FROM agents) t
""")
def eval_report_document(spark, sf_dir):
    """SNK9: the written report, read again: agents with their skills, flags, time and totals."""
    base, cur = _eval_inputs(spark, sf_dir)
    path = _folder(spark, "eval-report")
    comparison = EG.compare_eval(base, cur)
    EG.write_report(EG.agent_rollup(comparison, base), comparison, path, "2024-02-01T00:00:00.000Z")
    agents = spark.read.schema("agentId string, status string, skills array<struct<skillId string, status string>>").json(f"{path}/agents")
    report = spark.read.schema("hasRegression boolean, hasWarning boolean, timestamp string, "
                               "summary struct<totalAgents long, regressions long, warnings long, passing long>").json(f"{path}/report")
    head = report.select("summary.*", "hasRegression", "hasWarning", "timestamp").first()                # one row
    n_down = F.size(F.filter("skills", lambda s: s["status"] == "REGRESSION"))
    return agents.select(F.col("agentId").alias("agent_id"), "status", F.size("skills").cast("long").alias("n_skills"), n_down.cast("long").alias("n_down"),
                         F.lit(head[0]).alias("total"), F.lit(head[1]).alias("down"), F.lit(head[2]).alias("warned"), F.lit(head[3]).alias("passing"),
                         F.lit(head[4]).alias("has_regression"), F.lit(head[5]).alias("has_warning"), F.lit(head[6]).alias("stamp"))


# -------------------------------------------------------------------- streams

def _stream(spark, df, name: str):
    """``df`` as a stream of files, and what an operator's output stream writes once all of it is read."""
    path = _folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drained(out, spark, name: str):
    path = _folder(spark, f"{name}-out")
    q = (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", _folder(spark, f"{name}-state"))
            .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@binding("window_counts_stream", sql="""
SELECT event_type, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n
FROM events GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def window_counts_stream(spark, sf_dir):
    """STR4-5: hourly counts per type as a stream; the windows that the watermark has closed."""
    stream = _stream(spark, events(spark, sf_dir).select("event_type", "ts"), "window-counts")
    out = _drained(ST.windowed_counts(stream, "ts", "event_type", "1 hour", watermark="10 minutes"), spark, "window-counts")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@binding("backlog_stream", sql="""
SELECT event_type AS topic, date_trunc('hour', ts) + INTERVAL 1 HOUR AS as_of, count(*) AS depth,
       CAST(epoch(date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR) - floor(epoch(min(ts))) AS BIGINT) AS oldest_age_s
FROM events GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE
""")
def backlog_stream(spark, sf_dir):
    """STR10: depth and age of the oldest message per queue and hour, as a stream."""
    stream = _stream(spark, events(spark, sf_dir).select(F.col("event_type").alias("topic"), "ts"), "backlog")
    out = _drained(ST.backlog_stream(stream, "ts", window="1 hour"), spark, "backlog")
    return out.withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@binding("dedup_stream", sql=f"""
WITH RECURSIVE m AS (SELECT event_id, epoch_us(ts) AS us, event_type FROM events),
acc AS (SELECT event_type, min(us) AS us FROM m GROUP BY 1
        UNION ALL
        SELECT a.event_type, (SELECT min(m.us) FROM m WHERE m.event_type = a.event_type AND m.us >= a.us + {FIFO_DEDUP_S * 36 * 1000000}) FROM acc a WHERE a.us IS NOT NULL)
SELECT event_type, count(us) AS n, min(us) AS first_us, max(us) AS last_us FROM acc GROUP BY 1
""")
def dedup_stream(spark, sf_dir):
    """STR6-7 as a stream: sightings of a type at least three hours after the last accepted one."""
    stream = _stream(spark, events(spark, sf_dir).select("event_type", "ts", "event_id"), "dedup")
    path = _folder(spark, "dedup-out")
    ST.start_dedup_stream(stream, "event_type", "ts", path, _folder(spark, "dedup-state"), FIFO_DEDUP_S * 36, available_now=True).awaitTermination()
    out = spark.read.schema(stream.schema).parquet(path)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return out.groupBy("event_type").agg(F.count("event_id").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@binding("replay_stream", sql="""
WITH RECURSIVE m AS (
  SELECT user_id, json_extract_string(props, '$.k') AS nonce, epoch_us(ts) AS sent,
         epoch_us(ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT))) AS us FROM events),
g AS (SELECT user_id, coalesce(user_id || '/' || nonce, 'u' || user_id) AS key, us FROM m WHERE abs(us - sent) <= 300000000),
acc AS (SELECT user_id, key, min(us) AS us FROM g GROUP BY 1, 2
        UNION ALL
        SELECT a.user_id, a.key, (SELECT min(g.us) FROM g WHERE g.key = a.key AND g.us >= a.us + 600000000) FROM acc a WHERE a.us IS NOT NULL)
SELECT user_id, count(us) AS n, min(us) AS first_us, max(us) AS last_us FROM acc GROUP BY 1
""")
def replay_stream(spark, sf_dir):
    """FIL12/STR7 as a stream: the messages accepted of every user."""
    messages = events(spark, sf_dir).select(
        "event_id", "user_id", F.get_json_object("props", "$.k").alias("nonce"), F.col("ts").alias("sent"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value").cast("decimal(18,6)"))).alias("received"))
    stream, path = _stream(spark, messages, "replay"), _folder(spark, "replay-out")
    ST.start_replay_guard(stream, "user_id", "nonce", "sent", "received", path, _folder(spark, "replay-state"), available_now=True).awaitTermination()
    us = F.unix_micros(F.col("received").cast("timestamp"))
    return spark.read.schema(stream.schema).parquet(path).groupBy("user_id").agg(
        F.count("event_id").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@binding("dead_letter_stream", sql="""
SELECT CAST(user_id AS VARCHAR) AS message_id, count(*) AS receive_count, true AS dead FROM events GROUP BY 1 HAVING count(*) > 5
""")
def dead_letter_stream(spark, sf_dir):
    """STR8: messages received more than five times, counted across micro-batches."""
    receives = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("message_id"), "ts")
    return _drained(ST.dead_letter_stream(_stream(spark, receives, "receives"), 5, "ts"), spark, "receives")
