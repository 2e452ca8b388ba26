"""Streaming alarm evaluation (STR11 streaming form of WIN2/WIN5).

``samples(metric, ts, value)`` arrive as a stream.  Each micro-batch
(``foreachBatch``) folds its samples into per-(alarm, period) partial
aggregates, closes the periods the event-time watermark has passed, and
evaluates M-of-N on the gap-filled grid of newly closed periods, carrying
the last N evaluated periods per alarm between batches.

A live stream is united with a clock (a ``rate`` source), whose rows stand in
every micro-batch: time goes on where samples stop, so an alarm that treats
missing data as breaching fires in silence, and on a stream that never had a
sample.  The samples of one alarm are folded by partial aggregates, whatever
share of the stream it holds; a timer per alarm in a stateful operator would
bring them all to one task.  Samples that lie more than ``future_s`` ahead of
the clock (without one: of the machine's time) are written to
``<out_path>_rejected`` and move no watermark; a clocked stream also rejects samples
more than ``horizon_s`` old, so no stray timestamp makes a grid of millions of periods.

State lives in small parquet tables under the shared checkpoint folder
(their size is alarms x open periods and alarms x N, never the event
count): ``open`` partial aggregates, ``tail`` recent evaluated periods,
``meta`` the watermark -- each versioned by batch id.  A batch reads the state
version of the batch before it, so a replayed batch rewrites exactly what its
first attempt wrote.  Samples arriving after the watermark has closed their
period are dropped, as in any watermarked stream.
Sum, Average, Minimum, Maximum and SampleCount fold into partial
aggregates; percentile alarms (``pNN``) keep their open periods' samples in
an ``open_values`` table and take the exact percentile once a period closes.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slo import alarm_table, breach_of, m_of_n, stat_column
from ..session import ensure_checkpoint_dir
from .store import names_in

DECOMPOSABLE = ("sum", "average", "minimum", "maximum", "samplecount")


def _read_state(spark, path, batch_id):
    """State as of the latest version written by an earlier batch (None if none).

    Versions are ``batch=<id>`` partitions, so a replayed batch reads the same
    input state as its first attempt and rewrites its own version.
    """
    older = [int(n[6:]) for n in names_in(spark, path) if n.startswith("batch=") and int(n[6:]) < int(batch_id)]
    return spark.read.parquet(f"{path}/batch={max(older)}") if older else None


def _write_state(df, path, batch_id):
    df.write.mode("overwrite").parquet(f"{path}/batch={int(batch_id)}")


def _is_pct(stat: str) -> bool:
    return stat.lower().startswith("p") and stat[1:].replace(".", "", 1).isdigit()


def _percentile_periods(spark, batch, adf, pct_ids, alarms, state_path, batch_id, wm):
    """Closed-period datapoints of percentile alarms, and the open periods' values.

    Percentiles do not fold into partial aggregates, so an open period keeps
    its samples (``alarm_id, bucket, value``) in the ``open_values`` state
    table: its size is the samples of periods the watermark has not closed,
    not the stream's history.  A closed period's value is its exact
    percentile (``exact_quantiles``, counted along range partitions).
    """
    from ..operators.ordered import exact_quantiles
    from ..session import materialize
    pa = adf.filter(F.col("alarm_id").isin(pct_ids))
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    vals = (batch.join(pa.select("alarm_id", "metric", "period_s"), "metric")
                 .select("alarm_id", F.floor(secs / F.col("period_s")).alias("bucket"), F.col("value").cast("double")))
    prev = _read_state(spark, f"{state_path}/open_values", batch_id)
    if prev is not None:
        vals = vals.unionByName(prev)
    vals = materialize(vals.join(pa.select("alarm_id", "period_s"), "alarm_id"), "alarm-values")
    closed_end = (F.col("bucket") + 1) * F.col("period_s")
    open_values = vals.filter(closed_end > F.lit(wm)).select("alarm_id", "bucket", "value")
    closed = vals.filter(closed_end <= F.lit(wm))
    levels = sorted({a.stat.lower() for a in alarms if a.alarm_id in pct_ids})
    q = exact_quantiles(closed, ["alarm_id", "bucket"], "value", [float(x[1:]) / 100.0 for x in levels], [stat_column(x) for x in levels])
    q = q.join(pa.select("alarm_id", F.lower(F.col("stat")).alias("_st")), "alarm_id")
    pick = F.lit(None).cast("double")
    for x in levels:
        pick = F.when(F.col("_st") == x, F.col(stat_column(x))).otherwise(pick)
    return q.select("alarm_id", "bucket", pick.alias("value")), open_values


def alarm_tick(batch: DataFrame, batch_id: int, alarms, out_path: str, state_path: str,
               delay_s: int = 0, initial_state: str = "INSUFFICIENT_DATA", future_s: int = 300,
               horizon_s: int = 86_400) -> None:
    """Fold, close and evaluate one micro-batch of ``metric, ts, value`` (and ``clock``: rows that only tell the time)."""
    spark = batch.sparkSession
    bad = [a.alarm_id for a in alarms if a.stat.lower() not in DECOMPOSABLE and not _is_pct(a.stat)]
    if bad:
        raise ValueError(f"unknown alarm statistics: {bad}")
    adf = F.broadcast(alarm_table(spark, alarms))          # configuration rows
    pct_ids = [a.alarm_id for a in alarms if _is_pct(a.stat)]
    n_max = max(a.n for a in alarms)
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    now = None
    if "clock" in batch.columns:
        now = batch.filter("clock").agg(F.max(secs)).first()[0]
        batch = batch.filter("NOT clock").drop("clock")
    fits = secs <= F.lit(float((time.time() if now is None else now) + future_s))
    if now is not None:
        fits = fits & (secs >= F.lit(float(now - horizon_s)))
    batch.filter(~fits).write.mode("overwrite").parquet(f"{out_path}_rejected/batch={int(batch_id)}")
    batch = batch.filter(F.col("ts").isNull() | fits)

    # 1. partial aggregates of this batch, folded into the open periods
    #    (percentile alarms keep their open periods' values instead)
    part = (batch.join(adf.filter(~F.col("alarm_id").isin(pct_ids)).select("alarm_id", "metric", "period_s"), "metric")
                 .withColumn("bucket", F.floor(secs / F.col("period_s")))
                 .groupBy("alarm_id", "bucket")
                 .agg(F.sum("value").alias("s"), F.count("value").alias("c"), F.min("value").alias("mn"),
                      F.max("value").alias("mx")))
    prev_open = _read_state(spark, f"{state_path}/open", batch_id)
    if prev_open is not None:
        part = part.unionByName(prev_open)
    allp = part.groupBy("alarm_id", "bucket").agg(F.sum("s").alias("s"), F.sum("c").alias("c"),
                                                  F.min("mn").alias("mn"), F.max("mx").alias("mx"))

    # 2. event-time watermark (one scalar per batch)
    batch_max = batch.agg(F.max(secs)).first()[0]
    meta = _read_state(spark, f"{state_path}/meta", batch_id)
    meta = meta.first() if meta is not None else None
    old_max, started = (meta["max_ts"], meta["started"]) if meta else (None, None)
    started = now if started is None else started
    max_ts = max([x for x in (batch_max if now is None else now, old_max) if x is not None], default=None)
    if max_ts is None:
        return
    wm = max_ts - delay_s

    # 3. periods the watermark has closed, and the grid to evaluate
    allp = allp.join(adf, "alarm_id").checkpoint()
    closed_end = (F.col("bucket") + 1) * F.col("period_s")
    still_open = allp.filter(closed_end > F.lit(wm)).select("alarm_id", "bucket", "s", "c", "mn", "mx")
    st = F.lower(F.col("stat"))
    value = (F.when(st == "sum", F.col("s")).when(st == "average", F.col("s") / F.col("c"))
             .when(st == "minimum", F.col("mn")).when(st == "maximum", F.col("mx"))
             .when(st == "samplecount", F.col("c").cast("double")))
    closed = allp.filter(closed_end <= F.lit(wm)).select("alarm_id", "bucket", value.alias("value"))
    open_values = None
    if pct_ids:
        pct_closed, open_values = _percentile_periods(spark, batch, adf, pct_ids, alarms, state_path, batch_id, wm)
        closed = closed.unionByName(pct_closed)
    tail = _read_state(spark, f"{state_path}/tail", batch_id)
    last = (tail.groupBy("alarm_id").agg(F.max("bucket").alias("last_eval"))
            if tail is not None else spark.createDataFrame([], "alarm_id string, last_eval long"))
    # an alarm starts at its first datapoint, or when its clock does; afterwards every
    # period the watermark has closed is evaluated, empty ones included (gap filling)
    first = closed.select("alarm_id", "bucket")
    if started is not None:
        first = first.unionByName(adf.select("alarm_id", F.ceil(F.lit(float(started)) / F.col("period_s")).alias("bucket")))
    first = first.groupBy("alarm_id").agg(F.min("bucket").alias("first"))
    rng = first.join(last, "alarm_id", "full_outer").withColumn(
        "lo", F.coalesce(F.col("last_eval") + 1, F.col("first")))
    grid = (adf.join(rng, "alarm_id")
               .withColumn("hi", F.floor(F.lit(wm) / F.col("period_s")) - 1)
               .filter(F.col("hi") >= F.col("lo"))
               .select("*", F.explode(F.sequence("lo", "hi")).alias("bucket"))
               .drop("first", "hi", "lo", "last_eval"))
    new = (grid.join(closed, ["alarm_id", "bucket"], "left")
               .withColumn("breach", breach_of(F.col("value")))
               .withColumn("_known", F.lit(None).cast("string")).withColumn("_new", F.lit(True)))
    cols = ["alarm_id", "bucket", "value", "breach", "_known", "_new", "m", "n", "missing", "period_s"]
    hist = (tail.join(adf.select("alarm_id", "m", "n", "missing", "period_s"), "alarm_id")
                .select("alarm_id", "bucket", "value", "breach", F.col("state").alias("_known"),
                        F.lit(False).alias("_new"), "m", "n", "missing", "period_s")) if tail is not None else None
    both = new.select(*cols) if hist is None else hist.select(*cols).unionByName(new.select(*cols))

    # 4. M-of-N over carried + new periods; emit the new ones
    ev = m_of_n(both, n_max, initial_state, prev_state="_known").checkpoint()
    out = ev.filter("_new").select("alarm_id", "period_start", F.round("value", 4).alias("value"), "breach",
                                   "n_breach", "state", "changed")
    (out.withColumn("batch", F.lit(int(batch_id))).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path))

    # 5. carry the last N evaluated periods, the open aggregates and the watermark
    from pyspark.sql import Window
    rk = F.row_number().over(Window.partitionBy("alarm_id").orderBy(F.col("bucket").desc()))
    new_tail = ev.withColumn("_rk", rk).filter(F.col("_rk") <= n_max).select("alarm_id", "bucket", "value",
                                                                            "breach", "state").checkpoint()
    _write_state(new_tail, f"{state_path}/tail", batch_id)
    _write_state(still_open.checkpoint(), f"{state_path}/open", batch_id)
    if open_values is not None:
        _write_state(open_values, f"{state_path}/open_values", batch_id)
    _write_state(spark.createDataFrame([(float(max_ts), started)], "max_ts double, started double"), f"{state_path}/meta", batch_id)


def start_alarm_stream(spark: SparkSession, samples: DataFrame, alarms, out_path: str, state_path: str | None = None,
                       checkpoint: str | None = None, delay_s: int = 0, trigger: str = "1 minute",
                       available_now: bool = False, clock: bool | None = None, future_s: int = 300,
                       horizon_s: int = 86_400):
    """Run :func:`alarm_tick` over a ``samples(metric, ts, value)`` stream.

    ``clock`` (default: unless ``available_now``, which replays history by its
    own timestamps) closes periods by time that passes, with or without samples.
    """
    base = ensure_checkpoint_dir(spark)
    state_path = state_path or os.path.join(base, "alarm_state")
    checkpoint = checkpoint or os.path.join(base, "alarm_stream")
    samples = samples.select("metric", "ts", "value")
    if clock if clock is not None else not available_now:
        types = {f.name: f.dataType for f in samples.schema.fields}
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
        ticks = ticks.select(F.lit(None).cast(types["metric"]).alias("metric"), F.col("timestamp").cast(types["ts"]).alias("ts"),
                             F.lit(None).cast(types["value"]).alias("value"), F.lit(True).alias("clock"))
        samples = samples.withColumn("clock", F.lit(False)).unionByName(ticks)
    w = (samples.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: alarm_tick(df, bid, alarms, out_path, state_path, delay_s, future_s=future_s,
                                                  horizon_s=horizon_s)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()
