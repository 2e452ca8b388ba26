"""Streaming forms of the dedup / window / dead-letter operators (STR4-8, STR10).

All state is keyed and bounded: by a watermark (dedup, windows) or by an
event-time timeout (receive counters), so state size follows the data rate
and the retention horizon, not the total history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.routing import FIFO_DEDUP_S, MAX_CLOCK_SKEW_S, REPLAY_TTL_S


def event_time(df: DataFrame, ts: str, out: str = "_et") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast in the UTC session."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def dedup_within(stream: DataFrame, key, ts: str, window_s: int = FIFO_DEDUP_S) -> DataFrame:
    """STR6/STR7: drop rows less than ``window_s`` after their key's last accepted row.

    The same rule as the batch form (``operators.routing.gap_dedup``), whatever
    the micro-batches are: a batch that spans more than ``window_s`` (a
    catch-up) loses nothing, which ``dropDuplicatesWithinWatermark`` would drop.
    The state is one time per key; it is evicted ``window_s`` after it.  A row
    without a time is kept.  Whole numbers travel as text, so that none is
    rounded on its way through pandas.

    All rows that a key has in one micro-batch stand in one task; where a key
    can be hot, or a batch a whole history, use ``start_dedup_stream``.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout
    key = [key] if isinstance(key, str) else list(key)
    width, names = int(window_s) * 1000000, stream.columns
    whole = {f.name: f.dataType for f in stream.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long")}

    def step(_, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs)).sort_values("_us", kind="stable")
        last = state.get[0] if state.exists else None
        keep = []
        for us in rows["_us"].tolist():
            timed = us > -2**62
            keep.append(not timed or last is None or abs(us - last) >= width)
            if timed and keep[-1]:
                last = us if last is None else max(us, last)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + width) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, names]

    s = event_time(stream, ts).withWatermark("_et", f"{int(window_s)} seconds")
    s = s.withColumn("_us", F.coalesce(F.unix_micros("_et"), F.lit(-2**62)))
    s = s.select(*[F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in names], "_et", "_us")
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name in whole else f.dataType) for f in stream.schema.fields])
    kept = s.groupBy(*key).applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(*[F.col(c).cast(whole[c]).alias(c) if c in whole else F.col(c) for c in names])


def start_dedup_stream(stream: DataFrame, key, ts: str, out_path: str, checkpoint: str, window_s: int = FIFO_DEDUP_S,
                       available_now: bool = False):
    """STR6 for hot keys: every micro-batch goes through ``operators.routing.gap_dedup`` (``foreachBatch``).

    The batch form cuts a hot key into ranges, so no key's rows stand in one
    task.  Between batches only the last accepted time of each live key is
    kept, in a table versioned by batch under ``checkpoint`` (a shared
    folder): rows less than ``window_s`` from it are dropped, of the others
    the first is accepted whatever came before.  A key is live until two
    intervals before the latest accepted time of all.  Rows that arrive late,
    ``window_s`` or more before their key's last accepted one, are swept among
    themselves.  A replayed batch rewrites its own ``dedup_batch=`` folder.
    """
    from ..operators.routing import gap_dedup
    from .loader import _read_version, _write_version
    key = [key] if isinstance(key, str) else list(key)
    width, state_path = int(window_s) * 1000000, f"{checkpoint}/accepted"

    def micros():
        return F.unix_micros(F.col(ts).cast("timestamp"))

    def tick(df, batch_id):
        spark = df.sparkSession
        spark.conf.set("spark.sql.adaptive.enabled", "true")       # a stream's session has it off
        names, target = df.columns, f"{out_path}/dedup_batch={int(batch_id)}"
        state = _read_version(spark, state_path, batch_id)
        if state is not None:
            held = state.toDF(*[f"_k{i}" for i in range(len(key))], "_last")
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
            near = F.abs(micros() - F.col("_last")) < width
            df = df.join(held, same, "left").filter(~F.coalesce(near, F.lit(False))).select(*names)
        gap_dedup(df, key, ts, window_s).filter("NOT is_duplicate").select(*names).write.mode("overwrite").parquet(target)
        kept = spark.read.schema(df.schema).parquet(target)
        last = kept.select(*key, micros().alias("_last")).filter("_last IS NOT NULL")
        last = (last if state is None else last.unionByName(state)).groupBy(*key).agg(F.max("_last").alias("_last"))
        latest = last.agg(F.max("_last")).first()[0]
        _write_version(last.filter(F.col("_last") > (latest or 0) - 2 * width), state_path, batch_id)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(tick)
    return (w.trigger(availableNow=True) if available_now else w).start()


def start_replay_guard(stream: DataFrame, key: str, nonce: str, sent: str, received: str, out_path: str, checkpoint: str,
                       skew_s: int = MAX_CLOCK_SKEW_S, ttl_s: int = REPLAY_TTL_S, available_now: bool = False):
    """STR7: stale messages are left out, then replays of a (key, nonce) within ``ttl_s``; written are the accepted ones.

    The batch form is ``operators.limits.replay_guard``; no key's messages stand
    in one task (see ``start_dedup_stream``).
    """
    apart = F.abs(F.unix_micros(F.col(received).cast("timestamp")) - F.unix_micros(F.col(sent).cast("timestamp")))
    return start_dedup_stream(stream.filter(apart <= skew_s * 1000000), [key, nonce], received, out_path, checkpoint, ttl_s, available_now)


def windowed_counts(stream: DataFrame, ts: str, key, window: str, slide: str | None = None,
                    watermark: str = "10 minutes", limit: int | None = None) -> DataFrame:
    """STR4/STR5: tumbling or sliding window counts per key, emitted when the
    watermark closes the window (append mode); optional ``> limit`` filter."""
    key = [key] if isinstance(key, str) else list(key)
    s = event_time(stream, ts).withWatermark("_et", watermark)
    w = F.window("_et", window, slide) if slide else F.window("_et", window)
    out = s.groupBy(*key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    if limit is not None:
        out = out.filter(F.col("n") > limit)
    return out.select(*key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def backlog_stream(stream: DataFrame, ts: str, topic: str = "topic", window: str = "1 minute",
                   watermark: str = "15 minutes") -> DataFrame:
    """STR10: per-minute depth and oldest age gauges per queue."""
    s = event_time(stream, ts).withWatermark("_et", watermark)
    return (s.groupBy(topic, F.window("_et", window).alias("w"))
             .agg(F.count(F.lit(1)).alias("depth"), F.min("_et").alias("oldest"))
             .select(topic, F.col("w.end").alias("as_of"), "depth",
                     (F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("oldest"))).alias("oldest_age_s")))


DEAD_LETTER_OUT = "message_id string, receive_count long, dead boolean"


def dead_letter_stream(receives: DataFrame, max_receive: int, ts: str, message_id: str = "message_id",
                       ttl: str = "14 days") -> DataFrame:
    """STR8: count receives per message across micro-batches; emit the message
    once with ``dead = true`` when the count first exceeds ``max_receive``.

    ``applyInPandasWithState`` keeps one counter per live message id; an
    event-time timeout (``ttl`` after the watermark) evicts it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        before = n
        for pdf in pdfs:
            n += len(pdf)
        state.update((n,))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + _ms(ttl))
        if before <= max_receive < n:
            yield pd.DataFrame({"message_id": [key[0]], "receive_count": [n], "dead": [True]})

    s = event_time(receives, ts).withWatermark("_et", ttl)
    return s.groupBy(message_id).applyInPandasWithState(
        step, DEAD_LETTER_OUT, "count long", "append", GroupStateTimeout.EventTimeTimeout)


def _ms(interval: str) -> int:
    n, unit = interval.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return int(n) * mult * 1000


TELEMETRY_TRIGGER = "5 seconds"      # SNK8: collector batch interval


def start_telemetry_stream(stream: DataFrame, main_path: str, llm_path: str, checkpoint: str,
                           environment: str, cluster: str, trigger: str = TELEMETRY_TRIGGER,
                           available_now: bool = False):
    """SNK4/SNK5/SNK8 as a stream: clean every micro-batch, then write the
    tenant/day-partitioned main sink and the LLM-span sub-sink from one
    persisted batch (``foreachBatch`` + ``tee``).  A replayed batch rewrites
    its own partitions."""
    from ..operators import telemetry as TM

    def tick(df, batch_id):
        TM.tee(TM.clean(df, environment, cluster), main_path, llm_path, batch=batch_id)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(tick)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()
