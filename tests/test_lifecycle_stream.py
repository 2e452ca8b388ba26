"""Lifecycle rules and the streaming stateful helpers."""

import datetime as dt
import os
import tempfile
import time

from pyspark.sql import functions as F

from tessera.operators import lifecycle as LC
from tessera.streaming import stateful as ST


def test_expire_tier_purge(spark):
    df = spark.createDataFrame([
        ("a", "documents", dt.datetime(2020, 1, 1), None), ("b", "documents", dt.datetime(2024, 5, 1), None),
        ("c", "evidence", dt.datetime(2020, 1, 1), None), ("d", "exports", dt.datetime(2020, 1, 1),
                                                             dt.datetime(2030, 1, 1)),
        ("e", "unknown", dt.datetime(2000, 1, 1), None)],
        "key string, bucket string, created_at timestamp_ntz, locked_until timestamp_ntz")
    rules = LC.rules_frame(spark)
    kept = sorted(r["key"] for r in LC.expire(df, rules, "2024-06-01").collect())
    assert kept == ["b", "c", "d", "e"]                # a expired; c object-locked; d on legal hold; e no rule
    tiers = {r["key"]: r["tier"] for r in LC.storage_tier(df, rules, "2024-06-01").collect()}
    assert tiers == {"a": "EXPIRED", "b": "STANDARD_IA", "c": "GLACIER", "d": "EXPIRED", "e": "STANDARD"}
    rows = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, v int")
    purges = spark.createDataFrame([("t1", dt.datetime(2024, 4, 1)), ("t2", dt.datetime(2024, 5, 25))],
                                   "tenant_id string, requested_at timestamp_ntz")
    assert [r["tenant_id"] for r in LC.purge_tenants(rows, purges, "2024-06-01").collect()] == ["t2"]
    an = LC.anonymize(rows, ["tenant_id"], "s", "2024-06-01").collect()[0]
    assert len(an["tenant_id"]) == 64 and an["retain_until"] == dt.date(2031, 6, 1)


def test_integrity(spark):
    t = {"a": spark.createDataFrame([(1,), (None,)], "k int"), "b": spark.createDataFrame([], "k int")}
    out = {(r["table_name"], r["check"]): r["ok"] for r in LC.integrity_checks(t, {"a": (["k"], ["k", "z"]),
                                                                                      "b": (["k"], ["k"])}).collect()}
    assert out[("a", "rows_present")] and not out[("a", "keys_not_null")] and not out[("a", "columns_present")]
    assert not out[("b", "rows_present")] and not out[(None, "overall")]


def _drain(q):
    q.processAllAvailable()
    q.stop()


def test_stream_dedup_and_windows(spark):
    src = tempfile.mkdtemp(prefix="s-")
    b = dt.datetime(2024, 1, 1)
    rows = [("k1", b), ("k1", b + dt.timedelta(seconds=30)), ("k2", b + dt.timedelta(seconds=40)),
            ("k1", b + dt.timedelta(seconds=400))]
    spark.createDataFrame(rows, "k string, ts timestamp_ntz").write.mode("overwrite").parquet(os.path.join(src, "p"))
    stream = spark.readStream.schema("k string, ts timestamp_ntz").parquet(os.path.join(src, "p"))
    q = ST.dedup_within(stream, "k", "ts", 300).writeStream.format("memory").queryName("dd").start()
    _drain(q)
    # one micro-batch longer than the interval: the sighting after 400 s is accepted again
    assert sorted((r["k"], r["ts"]) for r in spark.sql("select * from dd").collect()) == [("k1", b), ("k1", rows[3][1]), ("k2", rows[2][1])]
    q = ST.windowed_counts(stream, "ts", "k", "1 minute", watermark="0 seconds").writeStream \
        .format("memory").queryName("wc").outputMode("append").start()
    _drain(q)
    # the watermark (max event time) closes [00:00, 00:01) only: k1 x2 + k2
    assert sorted((r["k"], r["n"]) for r in spark.sql("select * from wc").collect()) == [("k1", 2), ("k2", 1)]


def test_stream_dedup_over_batches(spark, tmp_path):
    """The state carries over; duplicates do not extend the interval; nulls and big numbers survive."""
    b, big = dt.datetime(2024, 1, 1), 2**53 + 1
    schema = "k string, ts timestamp_ntz, n long, j int"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = []
    for i, seconds in enumerate((0, 200, 350, 500, 640)):
        at = b + dt.timedelta(seconds=seconds)
        spark.createDataFrame([("k", at, big + i, None), (None, at, None, i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (ST.dedup_within(stream, "k", "ts", 300).writeStream.format("parquet").option("path", str(tmp_path / "out"))
               .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
        kept += [seconds] if seconds in (0, 350) else []
    got = sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect() if r["k"])
    # 640 s is 290 s after the last accepted sighting
    assert got == [("k", b + dt.timedelta(seconds=x), big + (0, 2)[i], None) for i, x in enumerate(kept)]


def test_hot_key_dedup_over_batches(spark, tmp_path):
    """A key of all rows is cut into ranges; the accepted time carries over; the result is that of one batch."""
    b, schema = dt.datetime(2024, 1, 1), "k string, ts timestamp_ntz, n long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    at = [7 * i + 400 * (i // 100) for i in range(6000)]           # chains of 100 rows; the first batch ends inside one
    rows = [("hot", b + dt.timedelta(seconds=s), 2**53 + i) for i, s in enumerate(at)] + [(None, b, 1), ("hot", None, 2), ("hot", None, 3)]
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part in (rows[:3970], rows[3970:]):
            spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
            ST.start_dedup_stream(stream, "k", "ts", str(tmp_path / "out"), str(tmp_path / "ck"), 300, available_now=True).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    out = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    last, want = -300, rows[6000:]
    for s, r in zip(at, rows):
        if s - last >= 300:
            last, want = s, [*want, r]
    assert sorted((tuple(r) for r in out.select("k", "ts", "n").collect()), key=str) == sorted(want, key=str)
    first = out.filter("dedup_batch = 0 AND k = 'hot'").select(F.input_file_name().alias("f")).distinct()
    assert first.count() > 1


def test_dead_letter_stream(spark):
    src = tempfile.mkdtemp(prefix="dl-")
    b = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("m1", b), ("m1", b), ("m1", b), ("m1", b), ("m2", b)],
                          "message_id string, ts timestamp_ntz").write.parquet(os.path.join(src, "p"))
    stream = spark.readStream.schema("message_id string, ts timestamp_ntz").parquet(os.path.join(src, "p"))
    q = ST.dead_letter_stream(stream, 3, "ts").writeStream.format("memory").queryName("dlq") \
        .outputMode("append").start()
    _drain(q)
    out = spark.sql("select * from dlq").collect()
    assert [(r["message_id"], r["receive_count"], r["dead"]) for r in out] == [("m1", 4, True)]


def test_compact_and_export(spark, tmp_path):
    src = str(tmp_path / "day")
    spark.range(1000).repartition(20).write.parquet(src)
    out = str(tmp_path / "compacted")
    LC_files_before = len(spark.read.parquet(src).inputFiles())
    from tessera.operators.telemetry import compact
    compact(spark, src, out)
    assert LC_files_before == 20 and len(spark.read.parquet(out).inputFiles()) == 1
    assert spark.read.parquet(out).count() == 1000
    t = {"a": spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, v int")}
    LC.write_export(LC.export_tenant(t, "t1"), str(tmp_path / "export"))
    assert [r["v"] for r in spark.read.parquet(str(tmp_path / "export/table=a")).collect()] == [1]


def test_products_precedence(spark):
    from tessera.functions.scalars import first_nonempty_array, json_or_csv_array
    rows = [(None, None, None), ('["a","b"]', '["x"]', "c"), ("{bad", '["x"]', "c"), (None, None, "lending, compliance ,edd"),
            ("[]", "", "c")]
    df = spark.createDataFrame(rows, "org string, secret string, csv string")
    out = df.select(first_nonempty_array(json_or_csv_array(F.when(F.col("org").startswith("["), F.col("org"))),
                                         json_or_csv_array("secret"), json_or_csv_array("csv")).alias("p")).collect()
    assert [r["p"] for r in out] == [[], ["a", "b"], ["x"], ["lending", "compliance", "edd"], ["c"]]


def test_telemetry_stream(spark, tmp_path):
    import json as _json
    from tessera.streaming.stateful import start_telemetry_stream
    d = tmp_path / "in"
    d.mkdir()
    with open(d / "a.json", "w") as f:
        for name in ("axira.llm_call", "other"):
            f.write(_json.dumps({"name": name, "ts": "2024-01-02T03:00:00", "attributes": {"db.statement": "x"}}) + "\n")
    stream = spark.readStream.schema("name string, ts timestamp, attributes map<string,string>").json(str(d))
    q = start_telemetry_stream(stream, str(tmp_path / "main"), str(tmp_path / "llm"), str(tmp_path / "ck"),
                               "staging", "c1", available_now=True)
    q.awaitTermination(300)
    main = spark.read.parquet(str(tmp_path / "main"))
    assert main.count() == 2 and spark.read.parquet(str(tmp_path / "llm")).count() == 1
    assert all("db.statement" not in r["attributes"] for r in main.collect())
    assert {r["tenant_id"] for r in main.collect()} == {"unknown"}
    from tessera.operators.telemetry import tee                      # the batch written again replaces itself
    again = main.drop("tenant_id", "day", "batch", "index_name").cache()
    again.count()
    tee(again, str(tmp_path / "main"), str(tmp_path / "llm"), batch=0)
    assert spark.read.parquet(str(tmp_path / "main")).count() == 2 and spark.read.parquet(str(tmp_path / "llm")).count() == 1
    tee(again, str(tmp_path / "main"), str(tmp_path / "llm"), batch=7)
    assert spark.read.parquet(str(tmp_path / "main")).count() == 4
