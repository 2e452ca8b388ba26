"""Alarms on a stream that goes quiet, stray timestamps, pNN.N alarms, state on a shared file system."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tessera.operators import slo as S
from tessera.plans.observability import Alarm
from tessera.streaming import alarms as A

SAMPLES = "metric string, ts timestamp, value double, clock boolean"
T0 = 1_747_710_000                                            # a full minute
LOW = Alarm("running-tasks-low", "workflow/running-tasks", "Minimum", 60, "<", 2.0, 3, 3, "breaching")
ODD = Alarm("odd", "workflow/running-tasks", "p99.9", 60, ">", 5.0, 1, 1, "missing")


def _at(seconds):
    return dt.datetime.fromtimestamp(T0 + seconds, dt.timezone.utc)


def _batch(spark, now, samples=()):
    rows = [("workflow/running-tasks", _at(s), float(v), False) for s, v in samples]
    return spark.createDataFrame([*rows, (None, _at(now), None, True)], SAMPLES)


def _states(spark, out, alarm="running-tasks-low"):
    rows = spark.read.parquet(out).filter(F.col("alarm_id") == alarm).orderBy("period_start").collect()
    start = dt.datetime.fromtimestamp(T0, dt.timezone.utc).replace(tzinfo=None)
    return {int((r["period_start"] - start).total_seconds()) // 60: r["state"] for r in rows}


def test_alarm_fires_when_samples_stop(spark, tmp_path):
    out, st = str(tmp_path / "out"), str(tmp_path / "state")
    A.alarm_tick(_batch(spark, 125, [(5, 3), (65, 3)]), 0, [LOW, ODD], out, st)
    A.alarm_tick(_batch(spark, 190, [(130, 4)]), 1, [LOW, ODD], out, st)
    assert set(_states(spark, out).values()) == {"OK"}
    for n, now in enumerate((250, 310, 370), 2):              # nothing but the clock
        A.alarm_tick(_batch(spark, now), n, [LOW, ODD], out, st)
    assert _states(spark, out) == {0: "OK", 1: "OK", 2: "OK", 3: "OK", 4: "OK", 5: "ALARM"}
    A.alarm_tick(_batch(spark, 370), 4, [LOW, ODD], out, st)  # a replay
    assert _states(spark, out)[5] == "ALARM"
    A.alarm_tick(_batch(spark, 430, [(365, 9)]), 5, [LOW, ODD], out, st)
    assert _states(spark, out)[6] == "OK"
    assert _states(spark, out, "odd")[6] == "ALARM"           # p99.9 of one sample


def test_alarm_fires_on_a_stream_without_any_sample(spark, tmp_path):
    out, st = str(tmp_path / "out"), str(tmp_path / "state")
    for n, now in enumerate((10, 70, 130, 190, 250)):
        A.alarm_tick(_batch(spark, now), n, [LOW], out, st)
    assert _states(spark, out) == {1: "OK", 2: "OK", 3: "ALARM"} or _states(spark, out) == {1: "INSUFFICIENT_DATA", 2: "INSUFFICIENT_DATA", 3: "ALARM"}


def test_stray_timestamps_close_nothing_and_are_kept_aside(spark, tmp_path):
    out, st = str(tmp_path / "out"), str(tmp_path / "state")
    A.alarm_tick(_batch(spark, 125, [(5, 3), (10**9, 3), (-10**8, 3)]), 0, [LOW], out, st)
    A.alarm_tick(_batch(spark, 190, [(70, 3), (130, 3)]), 1, [LOW], out, st)
    assert _states(spark, out) == {0: "OK", 1: "OK", 2: "OK"}
    assert spark.read.parquet(f"{out}_rejected").count() == 2
    # without a clock the machine's time bounds the future
    plain = spark.createDataFrame([("workflow/running-tasks", _at(5), 3.0), ("workflow/running-tasks", _at(185), 3.0),
                                   ("workflow/running-tasks", dt.datetime(2199, 1, 1), 3.0)], "metric string, ts timestamp, value double")
    A.alarm_tick(plain, 0, [LOW], str(tmp_path / "o2"), str(tmp_path / "s2"))
    assert len(_states(spark, str(tmp_path / "o2"))) == 3


def test_state_is_found_through_the_file_system_of_the_session(spark, tmp_path):
    path = f"file:{tmp_path}/state"
    A._write_state(spark.range(0), path, 3)                   # an empty state is a state
    A._write_state(spark.range(5), path, 1)
    assert A._read_state(spark, path, 4).count() == 0 and A._read_state(spark, path, 3).count() == 5 and A._read_state(spark, path, 1) is None


def test_p999_alarm_in_batch(spark):
    rows = [("workflow/running-tasks", _at(s), float(s % 7)) for s in range(0, 600, 7)]
    got = S.evaluate_alarms(spark.createDataFrame(rows, "metric string, ts timestamp, value double"), [ODD]).collect()
    assert got and all(r["value"] is not None for r in got)


def test_live_stream_goes_quiet(spark, tmp_path):
    """A real stream with its clock: samples for some seconds, then none."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    alarm = Alarm("quiet", "m", "SampleCount", 1, "<", 1.0, 2, 2, "breaching")
    now = dt.datetime.now(dt.timezone.utc)
    spark.createDataFrame([("m", now, 1.0)], "metric string, ts timestamp, value double").write.parquet(src)
    stream = spark.readStream.schema("metric string, ts timestamp, value double").parquet(src)
    q = A.start_alarm_stream(spark, stream, [alarm], out, state_path=str(tmp_path / "st"), checkpoint=str(tmp_path / "ck"), trigger="1 second")
    try:
        end = time.time() + 90
        while time.time() < end:
            time.sleep(3)
            try:
                if spark.read.parquet(out).filter("state = 'ALARM'").count():
                    break
            except Exception:  # noqa: BLE001 - nothing written yet
                continue
        else:
            raise AssertionError(f"no alarm: {q.exception()}")
    finally:
        q.stop()
