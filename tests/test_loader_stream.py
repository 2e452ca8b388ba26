"""Loader end to end on FIXTURES-style envelopes: batch tick, stream, idempotency."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.plans.dispatch import REGISTRY
from tessera.streaming.loader import load_batch_files, pending_rows, start_loader

T_SUB = "axira.agent.task.submitted.v1"
T_START = "axira.agent.task.started.v1"
T_DONE = "axira.agent.task.completed.v1"


def _env(i, typ, time, data, tenant="t1", case="c1"):
    return {"id": f"e-{i}", "time": time, "type": typ, "tenantid": tenant, "caseid": case, "data": data}


def _write(root, typ, hour, name, lines, raw_lines=()):
    d = os.path.join(root, f"event_type={typ}", "year=2026", "month=05", "day=20", f"hour={hour:02d}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        for o in lines:
            f.write(json.dumps(o) + "\n")
        for r in raw_lines:
            f.write(r + "\n")


def _bronze():
    root = tempfile.mkdtemp(prefix="bronze-")
    _write(root, T_SUB, 3, "a.jsonl", [
        _env(1, T_SUB, "2026-05-20T03:04:05.123Z", {"taskId": "k1", "agentName": "a", "skillId": "s",
                                                   "correlationId": "x", "priority": "high", "productId": "p"}),
        _env(2, T_SUB, "2026-05-20T03:05:00Z", {"taskId": "k2", "agentName": "b"}, tenant="t2"),
    ], raw_lines=["{not json"])
    # same event id delivered twice (at-least-once)
    _write(root, T_SUB, 3, "b.jsonl", [_env(2, T_SUB, "2026-05-20T03:05:00Z", {"taskId": "k2", "agentName": "b"},
                                            tenant="t2")])
    _write(root, T_DONE, 3, "c.jsonl", [
        _env(3, T_DONE, "2026-05-20T03:04:09Z", {"taskId": "k1", "agentName": "a2", "outcome": "ok",
                                                 "durationMs": 4000, "tokensUsed": {"input": 10, "output": 20},
                                                 "estimatedCostUsd": 0.01, "completedAt": "2026-05-20T03:04:09Z"}),
        # completed for a task that was never submitted -> pending, not lost
        _env(4, T_DONE, "2026-05-20T03:06:00Z", {"taskId": "k9", "outcome": "ok"}),
    ])
    _write(root, T_START, 3, "d.jsonl", [
        # started arrives after completed in event time order? no: earlier time -> completed wins on agent_name
        _env(5, T_START, "2026-05-20T03:04:06Z", {"taskId": "k1", "agentName": "a1", "modelUsed": "m"}),
    ])
    _write(root, "axira.unknown.v1", 3, "e.jsonl", [_env(6, "axira.unknown.v1", "2026-05-20T03:04:06Z", {})])
    # non-.jsonl file is ignored
    _write(root, T_SUB, 3, "ignored.json", [_env(7, T_SUB, "2026-05-20T03:04:06Z", {"taskId": "zz"})])
    return root


def _check_warehouse(spark, wh, logged_files=4):
    task = spark.read.parquet(f"{wh}/fact_agent_task")
    got = {r["task_id"]: r for r in task.collect()}
    assert set(got) == {"k1", "k2"}
    k1 = got["k1"]
    assert k1["agent_name"] == "a2"            # completed (03:04:09) is later than started (03:04:06)
    assert k1["task_event_type"] == T_DONE
    assert k1["model_used"] is None            # completed lists model_used and it is absent -> NULL overwrite
    assert k1["tokens_input"] == 10 and k1["tokens_output"] == 20
    assert float(k1["estimated_cost_usd"]) == 0.01
    assert k1["duration_ms"] == 4000
    assert k1["skill_id"] is None              # completed lists skill_id without a value
    assert k1["correlation_id"] == "x"         # not listed by the merges -> untouched
    pend = pending_rows(spark, wh, "fact_agent_task")
    assert [r["task_id"] for r in pend.collect()] == ["k9"]
    log = spark.read.parquet(f"{wh}/_load_log")
    assert log.filter("status = 'ok'").count() == logged_files
    assert log.filter(F.col("s3_key").endswith("ignored.json")).count() == 0
    rej = spark.read.json(f"{wh}/_rejects")
    assert rej.count() == 1
    unm = spark.read.parquet(f"{wh}/_unmapped")
    assert unm.count() == 1


def test_batch_tick(spark):
    root = _bronze()
    wh = tempfile.mkdtemp(prefix="wh-")
    load_batch_files(spark, root, wh, batch_id=0)
    _check_warehouse(spark, wh)
    # replaying the same tick is idempotent
    load_batch_files(spark, root, wh, batch_id=0)
    _check_warehouse(spark, wh)


def test_stream_available_now(spark):
    root = _bronze()
    wh = tempfile.mkdtemp(prefix="wh-")
    ck = tempfile.mkdtemp(prefix="ck-")
    q = start_loader(spark, root, wh, checkpoint=ck, available_now=True)
    q.awaitTermination(300)
    _check_warehouse(spark, wh)
    # a second run reads nothing new: same warehouse
    q = start_loader(spark, root, wh, checkpoint=ck, available_now=True)
    q.awaitTermination(300)
    _check_warehouse(spark, wh)


def test_stream_watermark_dedup_keeps_rejects(spark):
    root = _bronze()
    wh = tempfile.mkdtemp(prefix="wh-")
    ck = tempfile.mkdtemp(prefix="ck-")
    q = start_loader(spark, root, wh, checkpoint=ck, available_now=True, dedup_watermark="3 hours")
    q.awaitTermination(300)
    # the duplicate is dropped before the tick, so its file is tracked by the checkpoint only
    _check_warehouse(spark, wh, logged_files=3)


def test_parent_arrives_later(spark):
    root = tempfile.mkdtemp(prefix="bronze-")
    wh = tempfile.mkdtemp(prefix="wh-")
    _write(root, T_DONE, 3, "a.jsonl", [_env(1, T_DONE, "2026-05-20T03:04:09Z", {"taskId": "k1", "outcome": "ok"})])
    load_batch_files(spark, root, wh, batch_id=0)
    assert pending_rows(spark, wh, "fact_agent_task").count() == 1
    root2 = tempfile.mkdtemp(prefix="bronze-")
    _write(root2, T_SUB, 3, "b.jsonl", [_env(2, T_SUB, "2026-05-20T03:00:00Z", {"taskId": "k1", "agentName": "a"})])
    load_batch_files(spark, root2, wh, batch_id=1)
    task = spark.read.parquet(f"{wh}/fact_agent_task").collect()
    assert len(task) == 1 and task[0]["outcome"] == "ok" and task[0]["agent_name"] is None
    assert pending_rows(spark, wh, "fact_agent_task").count() == 0


def _tick(spark, wh, batch_id, lines, registry=None):
    root = tempfile.mkdtemp(prefix="bronze-")
    for k, (typ, env) in enumerate(lines):
        _write(root, typ, 3, f"{k}.jsonl", [env])
    load_batch_files(spark, root, wh, batch_id=batch_id, registry=registry)
    return root


def test_replay_after_pending_was_applied(spark):
    wh = tempfile.mkdtemp(prefix="wh-")
    _tick(spark, wh, 0, [(T_START, _env(1, T_START, "2026-05-20T03:04:06Z", {"taskId": "k1", "modelUsed": "m1"}))])
    root = _tick(spark, wh, 1, [(T_SUB, _env(2, T_SUB, "2026-05-20T03:00:00Z", {"taskId": "k1"}))])
    for _ in range(2):
        assert [r["model_used"] for r in spark.read.parquet(f"{wh}/fact_agent_task").collect()] == ["m1"]
        load_batch_files(spark, root, wh, batch_id=1)           # the same tick again
    assert pending_rows(spark, wh, "fact_agent_task").count() == 0


def test_failed_table_is_retried(spark, monkeypatch):
    from tessera.streaming import loader
    wh = tempfile.mkdtemp(prefix="wh-")
    real = loader.P.project_table

    def broken(*a, **k):
        raise OSError("store away")
    monkeypatch.setattr(loader.P, "project_table", broken)
    _tick(spark, wh, 0, [(T_SUB, _env(1, T_SUB, "2026-05-20T03:00:00Z", {"taskId": "k1"}))])
    monkeypatch.setattr(loader.P, "project_table", real)
    for batch in (1, 2):
        _tick(spark, wh, batch, [(T_SUB, _env(10 + batch, T_SUB, "2026-05-20T03:01:00Z", {"taskId": f"n{batch}"}))])
    assert sorted(r["task_id"] for r in spark.read.parquet(f"{wh}/fact_agent_task").collect()) == ["k1", "n1", "n2"]
    log = spark.read.parquet(f"{wh}/_load_log").orderBy("tick").collect()
    assert log[0]["status"] == "failed" and all(r["copy_duration_ms"] is not None for r in log)


def test_entry_added_later_loads_unmapped_events_once(spark):
    wh = tempfile.mkdtemp(prefix="wh-")
    few = {k: v for k, v in REGISTRY.items() if k != T_SUB}
    _tick(spark, wh, 0, [(T_SUB, _env(1, T_SUB, "2026-05-20T03:00:00Z", {"taskId": "k1"}))], few)
    for batch in (1, 2, 2):
        _tick(spark, wh, batch, [(T_START, _env(20, T_START, "2026-05-20T03:04:06Z", {"taskId": "k1", "modelUsed": "m"}))])
    rows = spark.read.parquet(f"{wh}/fact_agent_task").collect()
    assert [(r["task_id"], r["model_used"]) for r in rows] == [("k1", "m")]


def test_rows_without_id_or_key(spark):
    wh = tempfile.mkdtemp(prefix="wh-")
    lines = []
    for k in range(5):
        env = _env(0, T_SUB, f"2026-05-20T03:0{k}:00Z", {"taskId": None if k < 2 else f"k{k}"})
        env["id"] = None
        lines.append((T_SUB, env))
    lines.append((T_START, _env(9, T_START, "2026-05-20T03:09:00Z", {"modelUsed": "m"})))
    _tick(spark, wh, 0, lines)
    rows = spark.read.parquet(f"{wh}/fact_agent_task").collect()
    assert len(rows) == 5 and all(r["model_used"] is None for r in rows)
    assert spark.read.parquet(f"{wh}/_keyless/fact_agent_task").count() == 1
    assert pending_rows(spark, wh, "fact_agent_task").count() == 0


def test_registry_shape():
    assert len(REGISTRY) == 38
    assert sum(e.is_merge for e in REGISTRY.values()) == 7


def _facts(spark, wh):
    t = spark.read.parquet(f"{wh}/fact_agent_task")
    cols = [c for c in t.columns if not c.startswith("_v_") and c != "load_batch"]
    return sorted(tuple(r) for r in t.select(*cols).collect())


def test_file_arrival_order_does_not_matter(spark):
    """Property: the same files loaded in different tick orders give the same table."""
    import itertools
    files = {
        "sub": [_env(1, T_SUB, "2026-05-20T03:00:00Z", {"taskId": "k1", "agentName": "a0", "skillId": "s"})],
        "start": [_env(2, T_START, "2026-05-20T03:01:00Z", {"taskId": "k1", "agentName": "a1", "modelUsed": "m1"})],
        "done": [_env(3, T_DONE, "2026-05-20T03:02:00Z", {"taskId": "k1", "agentName": "a2", "outcome": "ok"})],
    }
    types = {"sub": T_SUB, "start": T_START, "done": T_DONE}
    results = set()
    for perm in itertools.permutations(files):
        wh = tempfile.mkdtemp(prefix="wh-")
        for i, name in enumerate(perm):
            root = tempfile.mkdtemp(prefix="bronze-")
            _write(root, types[name], 3, f"{name}.jsonl", files[name])
            load_batch_files(spark, root, wh, batch_id=i)
        results.add(tuple(_facts(spark, wh)))
    assert len(results) == 1
    row = list(results)[0][0]
    cols = [c for c in spark.read.parquet(wh + "/fact_agent_task").columns if not c.startswith("_v_") and c != "load_batch"]
    r = dict(zip(cols, row))
    assert r["agent_name"] == "a2" and r["model_used"] is None and r["outcome"] == "ok"   # completed is latest


def test_more_files_than_one_trigger(spark):
    root = tempfile.mkdtemp(prefix="bronze-")
    for i in range(205):
        _write(root, T_SUB, 3, f"f{i:03d}.jsonl",
               [_env(1000 + i, T_SUB, "2026-05-20T03:00:00Z", {"taskId": f"k{i}", "agentName": "a"})])
    wh = tempfile.mkdtemp(prefix="wh-")
    q = start_loader(spark, root, wh, checkpoint=tempfile.mkdtemp(prefix="ck-"), available_now=True)
    q.awaitTermination(600)
    assert spark.read.parquet(f"{wh}/fact_agent_task").count() == 205
    log = spark.read.parquet(f"{wh}/_load_log")
    assert log.count() == 205 and log.select("tick").distinct().count() == 2      # 200 + 5


def test_merge_horizon_and_deep_merge(spark):
    from tessera.streaming.loader import deep_merge
    wh = tempfile.mkdtemp(prefix="wh-")
    root = tempfile.mkdtemp(prefix="bronze-")
    _write(root, T_SUB, 3, "a.jsonl", [_env(1, T_SUB, "2026-05-20T03:00:00Z", {"taskId": "k1", "agentName": "a"})])
    load_batch_files(spark, root, wh, batch_id=0, merge_horizon=1)
    root2 = tempfile.mkdtemp(prefix="bronze-")
    _write(root2, T_DONE, 5, "b.jsonl", [_env(2, T_DONE, "2026-05-20T05:00:00Z", {"taskId": "k1", "outcome": "ok"})])
    load_batch_files(spark, root2, wh, batch_id=5, merge_horizon=1)       # parent is outside the horizon
    assert spark.read.parquet(f"{wh}/fact_agent_task").collect()[0]["outcome"] is None
    assert pending_rows(spark, wh, "fact_agent_task").count() == 1
    deep_merge(spark, wh, batch_id=1000)
    assert spark.read.parquet(f"{wh}/fact_agent_task").collect()[0]["outcome"] == "ok"
    assert pending_rows(spark, wh, "fact_agent_task").count() == 0


def test_every_bronze_line_is_accounted_for(spark):
    """loaded + pending + unmapped + rejected = bronze, on a seeded random batch with
    duplicate deliveries, orphan MERGE events, unknown types and malformed lines."""
    import random
    rnd = random.Random(23)
    root = tempfile.mkdtemp(prefix="bronze-")
    wh = tempfile.mkdtemp(prefix="wh-")
    submitted, merges, unknown, n_bad, files = {}, {}, set(), 0, {}
    for i in range(300):
        kind = rnd.choices(["sub", "start", "done", "unknown", "bad"], [4, 2, 2, 1, 1])[0]
        minute = rnd.randrange(60)
        t = f"2026-05-20T03:{minute:02d}:{rnd.randrange(60):02d}Z"
        task = f"k{rnd.randrange(120)}"
        tenant = rnd.choice(["t1", "t2"])
        if kind == "bad":
            files.setdefault((T_SUB, "bad.jsonl"), ([], []))[1].append("{broken " + str(i))
            n_bad += 1
            continue
        typ = {"sub": T_SUB, "start": T_START, "done": T_DONE, "unknown": "axira.unknown.v1"}[kind]
        env = _env(i, typ, t, {"taskId": task, "agentName": f"a{i}"}, tenant=tenant)
        copies = 2 if rnd.random() < 0.1 else 1              # at-least-once delivery
        for c in range(copies):
            files.setdefault((typ, f"f{i % 7}-{c}.jsonl"), ([], []))[0].append(env)
        if kind == "sub":
            submitted[env["id"]] = (tenant, task)
        elif kind == "unknown":
            unknown.add(env["id"])
        else:
            merges[env["id"]] = (tenant, task)
    for (typ, name), (lines, raw) in files.items():
        _write(root, typ, 3, name, lines, raw_lines=raw)
    load_batch_files(spark, root, wh, batch_id=0)

    task = spark.read.parquet(f"{wh}/fact_agent_task").select("tenant_id", "task_id").collect()
    assert sorted((r["tenant_id"], r["task_id"]) for r in task) == sorted(submitted.values())
    parents = set(submitted.values())
    pend = pending_rows(spark, wh, "fact_agent_task").select("tenant_id", "task_id").collect()
    assert {(r["tenant_id"], r["task_id"]) for r in pend} == {k for k in merges.values() if k not in parents}
    unm = spark.read.parquet(f"{wh}/_unmapped")
    assert unm.select("id").distinct().count() == len(unknown) == unm.count()
    assert spark.read.json(f"{wh}/_rejects").count() == n_bad
