"""SLIs, metric series, error budgets and M-of-N alarms (FIL5, AGG7-12, WIN2, WIN5, STR4, STR11).

Shape of every job: one scan -> one grouped aggregate on (key, time bucket)
with map-side partial aggregation -> small per-period table.  Alarm
evaluation runs on a period grid generated from the alarm definitions
(``sequence`` + ``explode``), so its size is alarms x periods and does not
grow with the raw data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.observability import SLIS, Alarm  # noqa: F401
from .ordered import exact_quantiles

REQUEST_COMPLETED = "request_completed"


def sli_samples(request_log: DataFrame, slis=SLIS, ts: str = "ts") -> DataFrame:
    """FIL5: ``(sli, ts, value)`` rows for successful requests under each SLI prefix.

    The SLI list is compiled into an array literal and matched per row with
    ``filter(...)`` + ``explode`` -- one pass, no join against the definitions.
    ``startswith`` is used instead of LIKE because ``_`` is a LIKE wildcard.
    """
    defs = F.array(*[F.struct(F.lit(i).alias("sli"), F.lit(p).alias("prefix")) for i, p, *_ in slis])
    ok = (F.col("message") == REQUEST_COMPLETED) & (F.col("status") < 400)
    matched = F.filter(defs, lambda d: F.col("path").startswith(d["prefix"]))
    return (request_log.filter(ok)
            .select(F.col(ts).alias("ts"), F.col("latency_ms").alias("value"),
                    F.explode(matched).alias("_s"))
            .select(F.col("_s.sli").alias("sli"), "ts", "value"))


def metric_series(samples: DataFrame, period: str, key: str = "sli", exact: bool = True,
                  quantiles=(0.5, 0.95, 0.99), digits: int = 4) -> DataFrame:
    """AGG7/AGG8/STR4: count + percentiles per key per tumbling window.

    ``exact=True`` takes the order statistics from ``ordered.exact_quantiles``
    (equals DuckDB ``quantile_cont``): values are counted along range
    partitions, so a hot (key, window) is spread over many tasks instead of
    one task holding all its values.  ``exact=False`` uses ``percentile_approx``,
    whose partial state is a fixed-size sketch per group.
    """
    names = [stat_column(f"p{100 * x:.10g}") for x in quantiles]
    d = samples.select(key, F.window("ts", period).getField("start").alias("window_start"), "value")
    if exact:
        df = exact_quantiles(d, [key, "window_start"], "value", quantiles, names, weighted={"n": lambda v, c: F.sum(c)})
    else:
        q = F.array(*[F.lit(x) for x in quantiles])
        df = (d.groupBy(key, "window_start")
               .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col("value"), q, 10000).alias("_q")))
        df = df.select(key, "window_start", "n", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    return df.select(key, "window_start", "n", *[F.round(F.col(nm).cast("double"), digits).alias(nm) for nm in names])


SKETCH_K = 200                       # size of a KLL sketch
SKETCH_RANK_ERROR = 0.0165           # of its quantiles, in ranks, with 99 % confidence


def sketch_series(samples: DataFrame, period: str = "5 minutes", key: str = "sli", k: int = SKETCH_K) -> DataFrame:
    """AGG7/AGG9: ``key, window_start, n, sketch``: a mergeable KLL sketch of the values per key and window.

    A sketch holds a few hundred numbers whatever its samples are, is combined
    map-side, and adds up over windows, days or re-read files.  Its quantiles
    are off by at most ``SKETCH_RANK_ERROR`` of the ranks; ``metric_series`` is
    the exact path.
    """
    d = samples.select(key, F.window("ts", period).getField("start").alias("window_start"), F.col("value").cast("double").alias("_v"))
    return d.groupBy(key, "window_start").agg(F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def rolling_sketches(series: DataFrame, minutes: int, step_minutes: int = 5, key: str = "sli") -> DataFrame:
    """The sketches of ``minutes`` long windows that begin every ``step_minutes``, merged from a series of that step."""
    steps = minutes // step_minutes
    back = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_k")
    spread = series.select("*", back)
    start = F.col("window_start") - F.make_dt_interval(mins=F.col("_k") * step_minutes)
    return spread.select(key, start.alias("window_start"), "n", "sketch").groupBy(key, "window_start").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(series: DataFrame, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """The quantiles of a series of sketches, named like those of ``metric_series``."""
    names = [stat_column(f"p{100 * x:.10g}") for x in quantiles]
    return series.select(*[c for c in series.columns if c != "sketch"],
                         *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(n) for q, n in zip(quantiles, names)))


def error_rate(requests: DataFrame, window_minutes: int, is_error: Column, ts: str = "ts") -> DataFrame:
    """JN12/AGG10: errors and requests of the same window in ONE aggregate
    (conditional count) -> ``IF(req = 0, 0, errs / req)``; no self-join."""
    w = F.window(ts, f"{int(window_minutes)} minutes")
    df = requests.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("requests"),
                                            F.count_if(is_error).alias("errors"))
    rate = F.when(F.col("requests") == 0, F.lit(0.0)).otherwise(F.col("errors") / F.col("requests"))
    return df.select(F.lit(window_minutes).alias("window_minutes"), F.col("w.start").alias("window_start"),
                     "requests", "errors", rate.alias("error_rate"))


def coarser_rate(rates: DataFrame, window_minutes: int) -> DataFrame:
    """AGG10 over a longer window, added up from ``error_rate`` of a window that divides it: the requests are read once."""
    w = F.window("window_start", f"{int(window_minutes)} minutes")
    df = rates.groupBy(w.alias("w")).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
    rate = F.when(F.col("requests") == 0, F.lit(0.0)).otherwise(F.col("errors") / F.col("requests"))
    return df.select(F.lit(window_minutes).alias("window_minutes"), F.col("w.start").alias("window_start"),
                     "requests", "errors", rate.alias("error_rate"))


def stat_column(stat: str) -> str:
    """Column name of a statistic (``p99.9`` becomes ``p99_9``)."""
    return stat.lower().replace(".", "_")


def _stat(stat: str, cents: bool, v: Column, count: Column) -> Column:
    """One statistic of values ``v`` that occur ``count`` times each.  ``cents=True`` sums exact integer
    hundredths (for 2-decimal money/latency values) so the result does not depend on the
    order in which partial sums are combined."""
    s = stat.lower()
    total = F.sum(F.round(v * 100).cast("long") * count) / 100.0 if cents else F.sum(v * count)
    n = F.sum(F.when(v.isNotNull(), count))
    if s == "average":
        return F.sum(F.round(v * 100).cast("long") * count) / n / 100.0 if cents else total / n
    if s == "sum":
        return total
    if s == "minimum":
        return F.min(v)
    if s == "maximum":
        return F.max(v)
    if s == "samplecount":
        return F.coalesce(n, F.lit(0)).cast("double")
    raise ValueError(stat)


def _with_stats(df: DataFrame, keys: list, stats, cents: bool = False) -> DataFrame:
    """One row per ``keys`` with every requested statistic of ``value``: decomposable ones
    as partial aggregates, ``pNN`` percentiles through ``exact_quantiles``."""
    plain = [x for x in stats if not x.lower().startswith("p")]
    ps = sorted({x.lower() for x in stats if x.lower().startswith("p")})
    if not ps:
        return df.groupBy(*keys).agg(*(_stat(x, cents, F.col("value"), F.lit(1)).alias(stat_column(x)) for x in plain))
    weighted = {stat_column(x): (lambda v, c, x=x: _stat(x, cents, v, c)) for x in plain}
    return exact_quantiles(df, keys, "value", [float(x[1:]) / 100.0 for x in ps], [stat_column(x) for x in ps], weighted=weighted)


def stat_switch(samples: DataFrame, definitions: DataFrame, period: str, cents: bool = False) -> DataFrame:
    """AGG9: per definition row ``(def_id, metric, stat)`` the chosen statistic per period.

    All candidate statistics are computed in one aggregate per (metric, period),
    then the definition table (config rows, broadcast) picks one via CASE.
    """
    stats = [r["s"] for r in definitions.select(F.lower("stat").alias("s")).distinct().orderBy("s").collect()]   # config rows
    d = samples.select("metric", F.window("ts", period).getField("start").alias("period_start"), "value")
    agg = _with_stats(d, ["metric", "period_start"], stats, cents)
    joined = agg.join(definitions, "metric")
    pick = F.lit(None).cast("double")
    for s in stats:
        pick = F.when(F.lower(F.col("stat")) == s, F.col(stat_column(s))).otherwise(pick)
    return joined.select("def_id", "period_start", pick.alias("value"))


def _compare(op: Column, v: Column, thr: Column) -> Column:
    return (F.when(op == ">", v > thr).when(op == ">=", v >= thr)
            .when(op == "<", v < thr).when(op == "<=", v <= thr))


def alarm_table(spark, alarms) -> DataFrame:
    rows = [(a.alarm_id, a.metric, a.stat, a.period_s, a.op, float(a.threshold), a.n, a.m, a.missing)
            for a in alarms]
    return spark.createDataFrame(rows, "alarm_id string, metric string, stat string, period_s int, op string, "
                                       "threshold double, n int, m int, missing string")


def alarm_datapoints(samples: DataFrame, alarms: DataFrame, stats=("average", "sum", "minimum", "maximum")) -> DataFrame:
    """Per alarm and period bucket: the alarm's statistic over its metric.

    ``samples(metric, ts, value)``.  The alarm table is configuration (one
    row per defined alarm) and is broadcast; each distinct statistic is one
    conditional aggregate, so the whole thing is a single grouped pass.
    """
    s = samples.join(F.broadcast(alarms.select("alarm_id", "metric", "stat", "period_s")), "metric")
    s = s.withColumn("bucket", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 / F.col("period_s")))
    # only the statistics some alarm asks for (exact percentiles are costly)
    stat_names = sorted({x.lower() for x in stats})
    g = _with_stats(s.select("alarm_id", "bucket", "stat", "value"), ["alarm_id", "bucket", "stat"], stat_names)   # one stat an alarm
    pick = F.lit(None).cast("double")
    for x in stat_names:
        pick = F.when(F.lower(F.col("stat")) == x, F.col(stat_column(x))).otherwise(pick)
    return g.select("alarm_id", "bucket", pick.alias("value"))


def evaluate_alarms(samples: DataFrame, alarms, start=None, end=None,
                    initial_state: str = "INSUFFICIENT_DATA") -> DataFrame:
    """WIN2 + STR11 + WIN5: M-of-N evaluation on a gap-filled period grid.

    ``alarms`` is a list of :class:`Alarm` (configuration rows).

    * grid: per alarm, every period bucket in [start, end] (``sequence`` +
      ``explode``); default range = the data's first/last bucket per alarm;
    * missing datapoints follow the alarm's rule: ``breaching`` -> breach,
      ``not_breaching`` -> ok, ``missing``/``ignore`` -> not counted;
    * state over the last N periods: ALARM if breaches >= M, OK if any
      datapoint counted, else INSUFFICIENT_DATA (``ignore`` keeps the
      previous state instead);
    * ``changed`` marks state transitions (notify once per change).
    """
    spark = samples.sparkSession
    n_max = max(a.n for a in alarms)
    adf = alarm_table(spark, alarms)
    dp = alarm_datapoints(samples, adf, {a.stat for a in alarms})
    if start is None or end is None:
        rng = dp.groupBy("alarm_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
        grid_src = F.broadcast(adf).join(rng, "alarm_id")
    else:
        lo = F.floor(F.unix_micros(F.lit(start).cast("timestamp")) / 1000000 / F.col("period_s"))
        hi = F.floor(F.unix_micros(F.lit(end).cast("timestamp")) / 1000000 / F.col("period_s"))
        grid_src = adf.withColumn("lo", lo).withColumn("hi", hi)
    grid = grid_src.select("*", F.explode(F.sequence("lo", "hi")).alias("bucket")).drop("lo", "hi")
    g = grid.join(dp, ["alarm_id", "bucket"], "left")
    v = F.col("value")
    g = g.withColumn("breach", breach_of(v))
    return m_of_n(g, n_max, initial_state).select(
        "alarm_id", "period_start", F.round(v, 4).alias("value"), "breach", "n_breach", "state", "changed")


def breach_of(value: Column) -> Column:
    """Breach flag of a datapoint under the alarm's operator and missing-data rule."""
    return (F.when(value.isNotNull(), _compare(F.col("op"), value, F.col("threshold")).cast("int"))
            .when(F.col("missing") == "breaching", F.lit(1))
            .when(F.col("missing") == "not_breaching", F.lit(0)))


def m_of_n(g: DataFrame, n_max: int, initial_state: str = "INSUFFICIENT_DATA",
           prev_state: str | None = None) -> DataFrame:
    """The M-of-N core over ``(alarm_id, bucket, breach, m, n, missing, period_s)`` rows.

    N differs per alarm: look back over the largest N with ``lag`` and mask
    offsets >= the alarm's own N (N is a handful of periods by design).
    ``prev_state`` names a column holding an already-known state (rows carried
    over from an earlier evaluation), which then wins over the recomputation.
    """
    w = Window.partitionBy("alarm_id").orderBy("bucket")
    sums, counted = [], []
    for k in range(n_max):
        b = F.lag("breach", k).over(w) if k else F.col("breach")
        within = F.lit(k) < F.col("n")
        sums.append(F.when(within, F.coalesce(b, F.lit(0))).otherwise(F.lit(0)))
        counted.append(F.when(within & b.isNotNull(), F.lit(1)).otherwise(F.lit(0)))
    g = (g.withColumn("n_breach", sum(sums[1:], sums[0]))
          .withColumn("n_counted", sum(counted[1:], counted[0])))
    raw = (F.when(F.col("n_breach") >= F.col("m"), F.lit("ALARM"))
           .when(F.col("n_counted") > 0, F.lit("OK")))
    g = g.withColumn("_raw", raw)
    kept = F.last("_raw", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("missing") == "ignore", F.coalesce(kept, F.lit(initial_state))) \
             .otherwise(F.coalesce(F.col("_raw"), F.lit(initial_state)))
    if prev_state:
        state = F.coalesce(F.col(prev_state), state)
    g = g.withColumn("state", state)
    prev = F.lag("state").over(w)
    period_start = F.timestamp_seconds(F.col("bucket") * F.col("period_s")).cast("timestamp_ntz")
    return (g.withColumn("changed", F.coalesce(prev, F.lit(initial_state)) != F.col("state"))
             .withColumn("period_start", period_start))


def state_changes(evaluated: DataFrame) -> DataFrame:
    """WIN5: only the rows where the alarm state changed (the notifications)."""
    return evaluated.filter("changed")
