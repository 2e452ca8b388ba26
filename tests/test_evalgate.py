"""Eval gate cases: thresholds on the unrounded drop, missing results, baseline 0, report, ratchet."""

import json
import os
import tempfile

from tessera.operators import evalgate as EG


def _frames(spark):
    base = spark.createDataFrame([
        ("a1", "s0", 100.0), ("a1", "s2", 100.0), ("a1", "s201", 100.0), ("a1", "s5", 100.0), ("a1", "s501", 100.0),
        ("a1", "up", 0.5), ("a1", "missing", 0.9), ("a1", "zero", 0.0), ("a2", "only", 0.8)],
        "agent_id string, skill_id string, accuracy double").withColumn("updated_at", __import__(
            "pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("timestamp_ntz"))
    res = spark.createDataFrame([
        ("a1", "s0", 100.0), ("a1", "s2", 98.0), ("a1", "s201", 97.99), ("a1", "s5", 95.0), ("a1", "s501", 94.99),
        ("a1", "up", 0.6), ("a1", "zero", 0.3), ("a3", "extra", 0.1)],
        "agent_id string, skill_id string, current double")
    return base, res


def test_compare_statuses(spark):
    base, res = _frames(spark)
    c = {r["skill_id"]: r for r in EG.compare_eval(base, res).collect()}
    assert set(c) == {"s0", "s2", "s201", "s5", "s501", "up", "zero"}      # missing skipped, extra ignored
    assert c["s0"]["status"] == "OK" and c["s2"]["status"] == "OK"
    assert c["s201"]["status"] == "WARNING" and c["s5"]["status"] == "WARNING"
    assert c["s501"]["status"] == "REGRESSION"
    assert c["up"]["status"] == "OK" and c["up"]["drop_pct"] == -20.0
    assert c["zero"]["status"] == "OK" and c["zero"]["drop_pct"] is None
    assert c["s201"]["drop_pct"] == 2.01


def test_rollup_report_ratchet(spark):
    base, res = _frames(spark)
    cmp_ = EG.compare_eval(base, res)
    agents = {r["agent_id"]: r for r in EG.agent_rollup(cmp_, base).collect()}
    assert agents["a1"]["status"] == "REGRESSION" and agents["a2"]["status"] == "OK" and agents["a2"]["n_skills"] == 0
    rep = EG.eval_report(EG.agent_rollup(cmp_, base)).collect()[0]
    assert (rep["total_agents"], rep["regressions"], rep["passing"], rep["gate"]) == (2, 1, 1, "BLOCKED")
    rat = {(r["agent_id"], r["skill_id"]): r for r in EG.ratchet(base, cmp_, "2024-02-01 00:00:00").collect()}
    assert rat[("a1", "up")]["accuracy"] == 0.6 and rat[("a1", "up")]["updated"]
    assert rat[("a1", "s0")]["updated"]                       # equal counts as maintained
    assert rat[("a1", "s501")]["accuracy"] == 100.0 and not rat[("a1", "s501")]["updated"]
    assert rat[("a1", "missing")]["accuracy"] == 0.9


def test_read_files_and_report(spark):
    d = tempfile.mkdtemp(prefix="eval-")
    with open(os.path.join(d, "baselines.json"), "w") as f:
        json.dump({"agents": {"intake": {"extract": {"accuracy": 0.92, "updatedAt": "2024-01-01T00:00:00Z"}},
                              "uw": {"score": {"accuracy": 0.8, "updatedAt": "2024-01-01T00:00:00Z"}}},
                   "lastUpdated": "2024-01-01T00:00:00Z"}, f, indent=2)
    os.makedirs(os.path.join(d, "results", "intake"))
    with open(os.path.join(d, "results", "intake", "extract.json"), "w") as f:
        json.dump({"accuracy": 0.80}, f)
    b = EG.read_baselines(spark, os.path.join(d, "baselines.json"))
    r = EG.read_results(spark, os.path.join(d, "results"))
    assert sorted((x["agent_id"], x["skill_id"]) for x in b.collect()) == [("intake", "extract"), ("uw", "score")]
    assert [(x["agent_id"], x["skill_id"], x["current"]) for x in r.collect()] == [("intake", "extract", 0.8)]
    cmp_ = EG.compare_eval(b, r)
    out = os.path.join(d, "report")
    EG.write_report(EG.agent_rollup(cmp_, b), cmp_, out, "2024-02-01T00:00:00Z")
    top = spark.read.json(f"{out}/report").first()
    assert top["hasRegression"] and not top["hasWarning"] and top["timestamp"] == "2024-02-01T00:00:00Z"
    assert top["summary"].asDict() == {"totalAgents": 2, "regressions": 1, "warnings": 0, "passing": 1}
    rep = {x["agentId"]: x for x in spark.read.json(f"{out}/agents").collect()}
    assert rep["intake"]["status"] == "REGRESSION" and rep["uw"]["skills"] == []


def test_agent_with_a_regressed_and_a_warned_skill_counts_in_both(spark):
    base = spark.createDataFrame([("a", "x", 1.0, None), ("a", "y", 1.0, None), ("b", "x", 1.0, None)],
                                 "agent_id string, skill_id string, accuracy double, updated_at timestamp")
    cur = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.97), ("b", "x", 1.0)], "agent_id string, skill_id string, current double")
    r = EG.eval_report(EG.agent_rollup(EG.compare_eval(base, cur), base)).first()
    assert (r["regressions"], r["warnings"], r["passing"], r["has_warning"]) == (1, 1, 1, True)
