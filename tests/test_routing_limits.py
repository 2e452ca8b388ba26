"""Routing, notifications, gap dedup, CIDR (v4 + v6), replay guard, rate limits."""

import datetime as dt
import ipaddress
import random

import pytest

from pyspark.sql import functions as F

from tessera.operators import limits as LM
from tessera.operators import routing as R
from tessera.plans.routing import ORIGIN_ALLOW_V4, ORIGIN_ALLOW_V6, base_edges, staging_edges


def test_edge_counts():
    assert len(base_edges()) == 58
    assert len(staging_edges()) == 240


def test_notification_targets(spark):
    ev = spark.createDataFrame([
        ("1", "deploy_failed", "p1", "t1"), ("2", "accuracy_regression", "p1", "t2"),
        ("3", "release_available", "info", "t3"), ("4", "tenant_provisioned", "info", None),
        ("5", "certification_failed", "warning", "t9")], "event_id string, type string, urgency string, tenant_id string")
    cfg = spark.createDataFrame([
        ("t1", "both", {"deployments": "#s-dep"}, {"deployments": "teams-dep"}),
        ("t2", "none", {}, {}), ("t3", "slack", {"releases": "#s-rel"}, {})],
        "tenant_id string, provider string, slack_channels map<string,string>, teams_channels map<string,string>")
    got = sorted((r["event_id"], r["sink"], r["channel"]) for r in R.notification_targets(ev, cfg).collect())
    assert got == sorted([
        ("1", "internal-slack", "#axira-deployments"), ("1", "internal-slack", "#axira-incidents"),
        ("1", "slack", "#s-dep"), ("1", "teams", "teams-dep"),
        ("2", "internal-slack", "#axira-incidents"),
        ("3", "internal-slack", "#axira-releases"), ("3", "slack", "#s-rel"),
        ("4", "internal-slack", "#axira-tenants"),
        ("5", "internal-slack", "#axira-deployments")])


def _first_accepted(rows, gap):
    """Brute force: {id: duplicate} of (id, key, time) rows; a row without a time is no duplicate."""
    out, last = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (str(r[1]), r[2] is not None, r[2], r[0])):
        out[i] = t is not None and k in last and (t - last[k]).total_seconds() < gap
        if t is not None and not out[i]:
            last[k] = t
    return out


@pytest.mark.parametrize("ranges,batch", [(1, 10000), (7, 13)])
@pytest.mark.parametrize("step,gap", [(1, 60), (7, 60), (61, 60), (1, 5000)])
def test_gap_dedup_matches_brute_force(spark, ranges, batch, step, gap):
    """Chains within a range, over batches and over many ranges; a hot key, a NULL key, rows without a time."""
    rnd = random.Random(step * gap)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "hot", base + dt.timedelta(seconds=i * step)) for i in range(700)]
    rows += [(i, rnd.choice(["a", "b", None]), base + dt.timedelta(seconds=rnd.randrange(0, 3600), microseconds=rnd.randrange(3)))
             for i in range(700, 1100)]
    rows += [(1100 + i, k, None) for i, k in enumerate(["a", "z", "hot", None])]
    rows += [(1200 + i, "b", base) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(ranges),
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = R.gap_dedup(df, "k", "ts", gap, tiebreak=["id"])
        got = {r["id"]: r["is_duplicate"] for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out.columns == ["id", "k", "ts", "is_duplicate"]
    assert got == _first_accepted(rows, gap)


def _brute_cidr(ip, cidrs):
    best = None
    for c in cidrs:
        n = ipaddress.ip_network(c)
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        if a.version == n.version and a in n and (best is None or n.prefixlen > ipaddress.ip_network(best).prefixlen):
            best = c
    return best


def test_cidr_overlaps_bare_addresses_and_v6(spark):
    cidrs = list(ORIGIN_ALLOW_V4 + ORIGIN_ALLOW_V6) + ["104.16.5.0/24", "0.0.0.0/1", "8.8.8.8"]
    ips = ["173.245.48.1", "173.245.64.1", "104.16.5.9", "104.17.0.1", "8.8.8.8", "200.1.1.1",
           "2606:4700::1111", "2606:4701::1", "2a06:98c7:ffff::1", "2a06:98c8::1", "::1", "2400:cb00:0:0:0:0:0:1",
           "not-an-ip", "300.1.1.1", "2c0f:f248::"]
    df = spark.createDataFrame(list(enumerate(ips)), "id int, ip string")
    odd = ["104.16.5.77/24", "10.0.0.0/x", "10.0.0.0/99", "nonsense"]          # a second spelling, and entries that are none
    cd = spark.createDataFrame([(c,) for c in cidrs + odd], "cidr string")
    exp = {i: _brute_cidr(ip, cidrs) for i, ip in enumerate(ips)}
    got = {r["id"]: r["matched_cidr"] for r in LM.match_cidr(df, "ip", cd).collect()}
    assert got == exp
    assert LM.match_cidr(df, "ip", cd.limit(0)).filter("matched").count() == 0


def test_replay_guard(spark):
    b = dt.datetime(2024, 1, 1)
    rows = [(1, "c", "n1", b, b + dt.timedelta(seconds=10)),
            (2, "c", "n1", b, b + dt.timedelta(seconds=100)),          # replay within 600 s
            (3, "c", "n1", b, b + dt.timedelta(seconds=800)),          # stale (> 300 s skew)
            (4, "c", "n2", b + dt.timedelta(seconds=1000), b + dt.timedelta(seconds=1000)),
            (5, "c", "n1", b + dt.timedelta(seconds=1500), b + dt.timedelta(seconds=1500))]   # TTL passed
    df = spark.createDataFrame(rows, "id int, cust string, nonce string, sent timestamp_ntz, received timestamp_ntz")
    exp = {1: (True, False, True), 2: (True, True, False), 3: (False, None, False),
           4: (True, False, True), 5: (True, False, True)}
    for _ in range(1):
        got = {r["id"]: (r["fresh"], r["replay"], r["accepted"])
               for r in LM.replay_guard(df, "cust", "nonce", "sent", "received", "id").collect()}
        assert got == exp


def test_rate_and_quota(spark):
    b = dt.datetime(2024, 1, 1, 0, 0, 30)
    rows = [("ip1", b + dt.timedelta(seconds=i)) for i in range(5)] + [("ip2", b)]
    df = spark.createDataFrame(rows, "ip string, ts timestamp_ntz")
    got = LM.rate_violations(df, "ip", "ts", "5 minutes", "1 minute", 4).collect()
    assert {r["ip"] for r in got} == {"ip1"} and len(got) == 5          # 5 sliding windows contain the burst
    assert {(r["window_start"].minute, r["window_end"].minute) for r in got} == {(m % 60, (m + 5) % 60) for m in range(-4, 1)}
    assert LM.rate_violations(df, "ip", "ts", "5 minutes", "2 minutes", 4).count() in (2, 3)         # windows that are no multiple of the slide
    assert [r["n"] for r in LM.rate_violations(df, "ip", "ts", "1 minute", None, 4).collect()] == [5]
    q = LM.quota(df, "ip", "ts", "day", None, 4).collect()
    assert {(r["ip"], r["used"], r["over"]) for r in q} == {("ip1", 5, True), ("ip2", 1, False)}


def test_dead_letter_and_priority(spark):
    df = spark.createDataFrame([("a", 3), ("b", 4), ("c", 6)], "topic string, receive_count int")
    live, dead = R.dead_letter(df, 3)
    assert sorted(r["topic"] for r in dead.collect()) == ["b", "c"] and live.count() == 1
    p, n = R.split_priority(df, ["a"])
    assert p.count() == 1 and n.count() == 2


def test_render_payloads(spark):
    import json
    df = spark.createDataFrame([("p1", "Deploy failed", "boom", "gw", None, "prod", "2024-01-01T00:00:00Z",
                                 {"region": "eu"}, "https://x", None)],
                               "urgency string, title string, message string, service string, version string, "
                               "environment string, timestamp string, details map<string,string>, actionUrl string, "
                               "logsUrl string")
    r = df.select(R.render_slack(df).alias("s"), R.render_teams(df).alias("t")).collect()[0]
    s, t = json.loads(r["s"]), json.loads(r["t"])
    assert s["blocks"][0]["text"]["text"] == "\U0001f534 Deploy failed"
    assert [f["text"] for f in s["blocks"][1]["fields"]] == ["*Service:* gw", "*Environment:* prod",
                                                             "*Time:* 2024-01-01T00:00:00Z", "*region:* eu"]
    assert s["blocks"][3]["elements"][0]["url"] == "https://x"
    card = t["attachments"][0]["content"]
    assert card["body"][0]["color"] == "attention" and len(card["body"][1]["facts"]) == 4
    assert card["actions"][0]["title"] == "View Details"
