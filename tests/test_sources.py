"""Bronze layout scan, lookback pruning, manifest reads, telemetry reader."""

import io
import json
import os
import tempfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tessera.sources.bronze import list_event_types, lookback, read_bronze, read_files, split_corrupt
from tessera.sources.telemetry import read_telemetry


def _layout():
    root = tempfile.mkdtemp(prefix="bronze-")
    for hour in range(0, 6):
        d = os.path.join(root, "event_type=a.b.v1", "year=2026", "month=05", "day=20", f"hour={hour:02d}")
        os.makedirs(d)
        with open(os.path.join(d, f"f{hour}.jsonl"), "w") as f:
            f.write(json.dumps({"id": f"e{hour}", "time": f"2026-05-20T{hour:02d}:10:00Z", "type": "a.b.v1",
                                "tenantid": "t", "data": {"x": hour}}) + "\n")
        with open(os.path.join(d, "skip.txt"), "w") as f:
            f.write("ignored\n")
    return root


def test_lookback_prunes_partitions(spark):
    root = _layout()
    df = read_bronze(spark, root)
    assert df.count() == 6                                   # .txt files are filtered out
    win = lookback(df, "2026-05-20 04:30:00", 2)
    assert sorted(r["id"] for r in win.collect()) == ["e2", "e3", "e4"]
    buf = io.StringIO()
    with redirect_stdout(buf):
        win.explain("formatted")
    plan = buf.getvalue()
    assert "PartitionFilters: [" in plan and "hour" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r["event_type"] for r in list_event_types(df).collect()] == ["a.b.v1"]
    assert df.filter(F.col("s3_key").endswith("f1.jsonl")).count() == 1


def test_manifest_must_exist(spark):
    root = _layout()
    ok = os.path.join(root, "event_type=a.b.v1/year=2026/month=05/day=20/hour=01/f1.jsonl")
    assert read_files(spark, [ok]).count() == 1
    with pytest.raises(Exception):
        read_files(spark, [ok, ok + ".missing"]).count()


def test_corrupt_split(spark):
    d = tempfile.mkdtemp(prefix="bad-")
    p = os.path.join(d, "event_type=x", "year=2026", "month=01", "day=01", "hour=00")
    os.makedirs(p)
    with open(os.path.join(p, "a.jsonl"), "w") as f:
        f.write('{"id":"1","type":"x"}\n{broken\n')
    df = read_bronze(spark, d).persist()
    good, bad = split_corrupt(df)
    assert good.count() == 1 and bad.count() == 1
    df.unpersist()


def test_read_telemetry(spark):
    d = tempfile.mkdtemp(prefix="otel-")
    with open(os.path.join(d, "spans.json"), "w") as f:
        f.write(json.dumps({"timestamp": "2024-01-01T00:00:00Z", "traceId": "t", "spanId": "s", "name": "axira.llm_call",
                            "attributes": {"a": "1"}, "events": [{"name": "e", "attributes": {}}],
                            "links": [{"traceId": "t2", "spanId": "s2"}]}) + "\n")
    df = read_telemetry(spark, d, kind="spans")
    r = df.collect()[0]
    assert r["attributes"]["a"] == "1" and r["links"][0]["traceId"] == "t2" and r["ts"] is not None
