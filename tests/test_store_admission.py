"""Snapshots, key index, repeats across ticks, admission per type."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyfilter
from tessera.operators import load as L
from tessera.plans.dispatch import FactDispatch, make_registry
from tessera.session import SHUFFLE_CLEANUP, ensure_checkpoint_dir
from tessera.streaming import admission, loader, store
from tessera.streaming.loader import load_tick

REG = make_registry([
    FactDispatch("made", "fact_order", ("order_id", "status"), ("data.orderId", "data.status"), None, ("string", "string")),
    FactDispatch("shipped", "fact_order", ("order_id", "status", "carrier"), ("data.orderId", "data.status", "data.carrier"), "order_id", ("string", "string", "string")),
    FactDispatch("paid", "fact_payment", ("order_id", "cents"), ("data.orderId", "data.cents"), None, ("string", "long")),
])
ROW = "id string, time string, type string, tenantid string, caseid string, data string, event_type string, s3_key string, _corrupt_record string"


def event(i, typ, key, hour=1, **data):
    return (i, f"2026-05-20T{hour:02d}:00:00Z", typ, "t", "c", json.dumps({"orderId": key, **data}), typ, f"{typ}-{i}", None)


def batch(spark, rows):
    return spark.createDataFrame(rows, ROW)


def orders(df):
    return sorted((r["order_id"], r["status"], r["carrier"]) for r in df.collect()) if df is not None else []


def ticks_of_orders():
    yield [event(f"m{k}", "made", f"o{k}", status="new") for k in range(6)] + [event("p0", "paid", "o0", cents=5)]
    yield [event(f"n{k}", "made", f"q{k}", status="new") for k in range(6)]
    yield [event("s0", "shipped", "o3", 2, status="gone", carrier="x"), event("s1", "shipped", "later", 2, status="gone", carrier="y"),
           event("p1", "paid", "q1", cents=7), event("u1", "unheard", "q1")]
    yield [event("m9", "made", "later", status="new"), event("bad", "shipped", None, 2, status="lost")]


@pytest.fixture(scope="module")
def plain(spark):
    wh = tempfile.mkdtemp(prefix="wh-")
    for n, rows in enumerate(ticks_of_orders()):
        load_tick(batch(spark, rows), n, wh, REG, strict=True, key_index=False)
    return wh


def test_filters_pass_every_key(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = keyfilter.sized_bits(3000)
    rows = keyfilter.filter_rows(keys.unionByName(spark.createDataFrame([(None,)], "key string")), "key", bits)
    assert keyfilter.may_hold(keys, "key", rows, bits=bits).count() == 3000
    others = spark.range(3000).select(F.concat(F.lit("z"), "id").alias("key"))
    assert keyfilter.may_hold(others, "key", rows, bits=bits).count() < 60


def test_tick_opens_only_partitions_that_may_hold_its_keys(spark, plain, monkeypatch):
    wh, opened = tempfile.mkdtemp(prefix="wh-"), []
    merge = L.merge_update

    def spy(target, *a, **kw):
        files = target.select(F.input_file_name().alias("f")).distinct().collect()
        opened.append({int(r["f"].split("load_batch=")[1].split("/")[0]) for r in files})
        return merge(target, *a, **kw)
    monkeypatch.setattr(loader.L, "merge_update", spy)
    for n, rows in enumerate(ticks_of_orders()):
        load_tick(batch(spark, rows), n, wh, REG, strict=True)
    # o3 stands in tick 0; "later" comes with tick 3, whose MERGE also has the keyless row
    assert opened == [{0}, {3}]
    assert orders(spark.read.parquet(f"{wh}/fact_order")) == orders(spark.read.parquet(f"{plain}/fact_order"))
    keys = spark.createDataFrame([("q2",), ("nowhere",)], "order_id string")
    assert store.partitions_to_open(spark, f"{wh}/_key_index/fact_order/order_id", keys, "order_id", {0, 1, 3, 7}) == {1, 7}    # 7 has no index


def disk_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def test_ticks_leave_nothing_on_disk_but_the_warehouse(spark):
    wh, shared = tempfile.mkdtemp(prefix="wh-"), ensure_checkpoint_dir(spark)
    before, shuffled = disk_bytes(shared), shuffle_files(spark)
    spark._jvm.java.lang.System.gc()
    for n, rows in enumerate(ticks_of_orders()):
        load_tick(batch(spark, rows), n, wh, REG, strict=True)
    keys = spark.createDataFrame([("o3",)], "order_id string")
    assert store.partitions_to_open(spark, f"{wh}/_key_index/fact_order/order_id", keys, "order_id", {0, 1, 3}) == {0}
    assert disk_bytes(shared) == before                         # neither kept tables nor RDD checkpoints
    for _ in range(100):                                        # executors delete them a moment after the query
        if not (left := shuffle_files(spark) - shuffled):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_only_repeated_ids_are_brought_together(spark, tmp_path):
    def keep(df, what):
        path = str(tmp_path / what)
        df.write.parquet(path)
        return spark.read.parquet(path)
    once = [event(f"m{k}", "made", f"o{k}") for k in range(50)] + [event(None, "made", "n"), event(None, "made", "n")]
    path = str(tmp_path / "once")
    batch(spark, once).write.parquet(path)
    df = loader._drop_repeats(spark.read.parquet(path), keep)
    assert df.count() == 52 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    again = once + [event("m7", "made", "later", 5), event("m7", "made", "sooner", 0), event("m8", "made", "o8")]
    df = batch(spark, again)
    (tmp_path / "ids-again").rename(tmp_path / "ids-again-first")
    got = loader._drop_repeats(df, keep)
    cols = df.columns
    want = L.dedup(df, "id", ["time", "s3_key"]).select(*cols)
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.collect()))
    assert got.filter("id = 'm7'").select(F.get_json_object("data", "$.orderId")).collect() == [("sooner",)]


class Stop(Exception):
    pass


def test_readers_see_a_tick_in_all_tables_or_in_none(spark, plain, monkeypatch):
    wh = tempfile.mkdtemp(prefix="wh-")
    rows = list(ticks_of_orders())
    for n in range(2):
        load_tick(batch(spark, rows[n]), n, wh, REG, strict=True, atomic=True)

    def state():
        seen = [store.read_snapshot(spark, wh, name) for name in ("fact_payment", "_load_log", "_unmapped")]
        return (orders(store.read_snapshot(spark, wh, "fact_order")), *(0 if df is None else df.count() for df in seen))
    before, left = state(), [0]

    def counted(name, module):
        fn = getattr(module, name)

        def run(*a, **kw):
            if left[0] == 0:
                raise Stop(name)
            left[0] -= 1
            return fn(*a, **kw)
        return run
    patched = ("_write_batch_partition", loader), ("_write_version", loader), ("add", store.Snapshot), ("rewrite", store.Snapshot), ("commit", store.Snapshot)
    for writes in range(0, 40, 3):
        with monkeypatch.context() as m:
            for name, where in patched:
                m.setattr(where, name, counted(name, where))
            left[0] = writes
            try:
                load_tick(batch(spark, rows[2]), 2, wh, REG, strict=True, atomic=True)
                break
            except Stop:
                assert state() == before
    else:
        raise AssertionError("the tick never ended")
    after = state()
    assert after[0] != before[0] and after[1] == before[1] + 1 and after[2] == before[2] + 3 and after[3] == 1
    assert dict((o, (s, c)) for o, s, c in after[0])["o3"] == ("gone", "x")
    load_tick(batch(spark, rows[2]), 2, wh, REG, strict=True, atomic=True)          # a replay of a committed tick
    assert state() == after
    load_tick(batch(spark, rows[3]), 3, wh, REG, strict=True, atomic=True)
    assert orders(store.read_snapshot(spark, wh, "fact_order")) == orders(spark.read.parquet(f"{plain}/fact_order"))
    assert state()[0] != after[0] and orders(store.read_snapshot(spark, wh, "fact_order", as_of=2)) == after[0]


def test_full_manifests_replace_the_deltas(spark, monkeypatch):
    monkeypatch.setattr(store, "FULL_EVERY", 2)
    wh = tempfile.mkdtemp(prefix="wh-")
    for n in range(5):
        s = store.Snapshot(spark, wh, n)
        s.add(spark.createDataFrame([(n,)], "x int"), "fact_a")
        if n == 3:
            s.rewrite(spark.createDataFrame([(100, 1)], "x int, load_batch long"), "fact_a")
        s.commit()
    assert any(n.endswith("-full") for n in store.snapshot_versions(spark, wh).values())
    assert sorted(r["x"] for r in store.read_snapshot(spark, wh, "fact_a").collect()) == [0, 2, 3, 4, 100]
    assert sorted(r["x"] for r in store.read_snapshot(spark, wh, "fact_a", as_of=2).collect()) == [0, 1, 2]
    assert store.read_snapshot(spark, tempfile.mkdtemp(), "fact_a") is None


def test_repeats_vanish_in_any_later_tick_and_late_events_stay(spark):
    path = tempfile.mkdtemp(prefix="seen-")
    rows = [[("a", "2026-05-20T01:00:00Z"), ("b", "2026-05-20T02:00:00Z"), (None, "2026-05-20T02:00:00Z"), ("a", "2026-05-20T01:00:00Z")],
            [("c", "2026-05-20T02:10:00Z"), (None, "2026-05-20T02:00:00Z"), ("x", "not a time")],
            [("a", "2026-05-20T01:00:00Z"), ("d", "2024-01-01T00:00:00Z"), ("x", "not a time"), (None, None)],
            [("d", "2024-01-01T00:00:00Z"), ("c", "2026-05-20T02:10:00Z"), ("b", "2026-05-20T02:00:00Z")]]
    want = [["a", "b", None], ["c", "x", None], ["d", None], []]
    for n in (0, 1, 2, 2, 1, 3):                     # ticks are replayed too
        got = store.drop_seen(spark.createDataFrame(rows[n], "id string, time string"), path, n)
        assert sorted((r["id"] for r in got.collect()), key=lambda i: (i is None, i)) == want[n], n
    full = tempfile.mkdtemp(prefix="seen-")          # a filter of one or two blocks passes everything: the exact join still decides
    for n in range(4):
        got = store.drop_seen(spark.createDataFrame(rows[n], "id string, time string"), full, n, bits=1)
        assert sorted((r["id"] for r in got.collect()), key=lambda i: (i is None, i)) == want[n], n


def test_loader_drops_repeats_across_ticks(spark):
    wh = tempfile.mkdtemp(prefix="wh-")
    first = [event("m1", "made", "o1", status="new"), event(None, "made", "o2", status="new")]
    for n, rows in enumerate([first, [*first, event("m0", "made", "o0", 0, status="late")]]):
        load_tick(batch(spark, rows), n, wh, REG, strict=True, across_ticks=True)
    assert sorted(r["order_id"] for r in spark.read.parquet(f"{wh}/fact_order").collect()) == ["o0", "o1", "o2", "o2"]


def _file(root, typ, hour, name, lines):
    d = os.path.join(root, f"event_type={typ}", "year=2026", "month=05", "day=20", f"hour={hour:02d}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        f.write("".join(line + "\n" for line in lines))


def _line(i, typ, key):
    return json.dumps({"id": i, "time": "2026-05-20T01:00:00Z", "type": typ, "tenantid": "t", "caseid": "c", "data": {"orderId": key, "status": "new", "cents": 1}})


def test_admission_takes_newest_hours_first_and_types_do_not_delay_each_other(spark):
    root, wh = tempfile.mkdtemp(prefix="bronze-"), tempfile.mkdtemp(prefix="wh-")
    for hour in range(5):
        _file(root, "made", hour, "a.jsonl", [_line(f"m{hour}", "made", f"o{hour}")])
    _file(root, "paid", 0, "p.jsonl", [_line("p", "paid", "o1")])
    _file(root, "unheard", 0, "u.jsonl", [_line("u", "unheard", "o1")])
    _file(root, "made", 4, "empty.jsonl", [])                  # holds no event: never listed
    _file(root, "made", 4, "not-an-event.txt", ["x"])
    assert admission.run_tick(spark, root, wh, REG, cap=2) == 0
    made = spark.read.parquet(f"{wh}/_admitted/tick=0").filter("event_type = 'made'").select("hour_start").collect()
    assert [r["hour_start"].hour for r in made] == [4, 3]
    assert spark.read.parquet(f"{wh}/fact_payment").count() == 1
    deferred = {r["event_type"]: (r["waiting"], r["admitted"], r["deferred"]) for r in spark.read.parquet(f"{wh}/_deferred/tick=0").collect()}
    assert deferred == {"made": (5, 2, 3), "paid": (1, 1, 0), "unheard": (1, 1, 0)}
    _file(root, "made", 9, "fresh.jsonl", [_line("m9", "made", "o9"), "{broken"])
    assert admission.drain(spark, root, wh, REG, cap=2) == [1, 2]
    assert [r["order_id"] for r in spark.read.parquet(f"{wh}/fact_order").orderBy("load_batch", "order_id").collect()] == ["o3", "o4", "o2", "o9", "o0", "o1"]
    assert admission.run_tick(spark, root, wh, REG, cap=2) is None
    total = {r["tick"]: r for r in admission.tick_metrics(spark, wh).collect()}
    assert [total[t]["files_deferred"] for t in range(3)] == [3, 2, 0]
    assert total[0]["rows_unmapped"] == 1 and total[1]["rows_rejected"] == 1 and sum(r["rows_loaded"] for r in total.values()) == 7
    assert all(r["bytes_loaded"] > 0 for r in total.values())


def test_a_stopped_tick_runs_again_with_the_same_files(spark, monkeypatch):
    root, wh = tempfile.mkdtemp(prefix="bronze-"), tempfile.mkdtemp(prefix="wh-")
    _file(root, "made", 1, "a.jsonl", [_line("m1", "made", "o1")])

    def stop(*a, **kw):
        raise Stop
    with monkeypatch.context() as m:
        m.setattr(admission, "load_tick", stop)
        with pytest.raises(Stop):
            admission.run_tick(spark, root, wh, REG)
    _file(root, "made", 2, "b.jsonl", [_line("m2", "made", "o2")])
    assert admission.run_tick(spark, root, wh, REG) == 0
    assert [r["order_id"] for r in spark.read.parquet(f"{wh}/fact_order").collect()] == ["o1"]
    # the archive follows finished ticks; a crash between copy and delete, and a file that cannot be moved, are made good
    archive, target = tempfile.mkdtemp(prefix="archive-"), "event_type=made/year=2026/month=05/day=20/hour=01/a.jsonl"
    move = admission.move_file
    with monkeypatch.context() as m:
        m.setattr(admission, "move_file", stop)
        assert [r["outcome"] for r in admission.archive_loaded(spark, root, wh, archive).collect()] == ["failed"]
    with monkeypatch.context() as m:
        m.setattr(admission, "move_file", lambda s, a, b: (os.makedirs(os.path.dirname(b)), open(b, "w").write(open(os.path.join(root, target)).read()), stop()))
        admission.archive_loaded(spark, root, wh, archive)
    assert os.path.exists(os.path.join(root, target)) and os.path.exists(os.path.join(archive, target)) and move is admission.move_file
    assert [r["outcome"] for r in admission.archive_loaded(spark, root, wh, archive).collect()] == ["moved"]
    assert not os.path.exists(os.path.join(root, target)) and "m1" in open(os.path.join(archive, target)).read()
    assert admission.archive_loaded(spark, root, wh, archive).count() == 0
    assert admission.drain(spark, root, wh, REG) == [1]
