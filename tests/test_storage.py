"""Compaction, expiry and purge of stored files, and swaps that a lost driver left half done."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import storage


def _store(spark, root, runs):
    for rows in runs:
        spark.createDataFrame(rows, "tenant_id string, day string, x long").coalesce(1).write.mode("append").partitionBy("day").parquet(root)


def _rows(spark, root):
    return sorted((r["tenant_id"], str(r["day"]), r["x"]) for r in spark.read.parquet(root).collect())


RUNS = [[("a", "2024-01-01", k), ("b", "2024-01-01", 10 + k), ("c", "2024-01-02", k)] for k in range(4)] + [[("b", "2024-01-03", 99)]]
ALL = sorted(r for run in RUNS for r in run)


@pytest.fixture()
def root(spark, tmp_path):
    path = str(tmp_path / "data")
    _store(spark, path, RUNS)
    return path


def test_small_files_of_closed_days_become_one(spark, root):
    assert storage.compact_files(spark, root, F.col("day") < F.lit("2024-01-02").cast("date")) == 4
    files = {str(r["day"]): r["n"] for r in storage.list_files(spark, root).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert files == {"2024-01-01": 1, "2024-01-02": 4, "2024-01-03": 1} and _rows(spark, root) == ALL
    assert storage.compact_files(spark, root, F.lit(True)) == 4 and _rows(spark, root) == ALL
    assert storage.compact_files(spark, root, F.lit(True)) == 0


def test_bins_stay_near_their_size_and_large_folders_stay(spark, root):
    files = storage.list_files(spark, root)
    size = files.agg(F.max("bytes")).first()[0]
    bins = storage.small_files(files, F.lit(True), target_bytes=2 * size + 2).groupBy("folder", "bin").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["b"] <= 3 * size for r in bins) and {r["n"] for r in bins} <= {1, 2, 3} and len(bins) >= 4
    assert storage.small_files(files, F.lit(True), roll_bytes=3 * size).count() == 0


class Stop(Exception):
    pass


def test_a_swap_is_carried_through_after_a_crash(spark, root, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(storage, "finish", lambda *a: (_ for _ in ()).throw(Stop()) if storage.hadoop(spark, f"{root}/_plans")[0].exists(
            storage.hadoop(spark, f"{root}/_plans")[1]) else 0)
        with pytest.raises(Stop):
            storage.compact_files(spark, root, F.lit(True))
    assert _rows(spark, root) == ALL                          # planned, nothing swapped yet
    assert storage.finish(spark, root) == 1 and _rows(spark, root) == ALL
    assert storage.list_files(spark, root).count() == 3 and storage.finish(spark, root) == 0


def test_expired_folders_go_whole_and_held_ones_stay(spark, root):
    holds = spark.createDataFrame([("2024-01-02",)], "day string").select(F.col("day").cast("date").alias("day"))
    out = storage.drop_expired(spark, root, F.col("day"), 5, "2024-01-08", holds)
    assert {(str(r["day"]), r["outcome"]) for r in out.collect()} == {("2024-01-01", "dropped"), ("2024-01-02", "held"), ("2024-01-03", "kept")}
    assert _rows(spark, root) == [r for r in ALL if r[1] != "2024-01-01"]


def test_purge_rewrites_only_files_that_hold_the_tenant(spark, root):
    before = {r["path"] for r in storage.list_files(spark, root).collect()}
    gone = spark.createDataFrame([("b",), ("nobody",)], "t string")
    report = storage.purge_files(spark, root, gone, held=F.col("x") == 13)
    assert sorted((str(r["day"]), r["outcome"], r["rows"], r["purged"]) for r in report.collect()) == sorted(
        [("2024-01-01", "rewritten", 2, 1)] * 3 + [("2024-01-01", "kept", 2, 0)] + [("2024-01-02", "kept", 1, 0)] * 4 + [("2024-01-03", "dropped", 1, 1)])
    assert _rows(spark, root) == [r for r in ALL if r[0] != "b" or r[2] == 13]
    after = {r["path"] for r in storage.list_files(spark, root).collect()}
    assert len(before & after) == 5
    _store(spark, root, [[("b", "2024-01-04", 1), ("z", "2024-01-04", 2)]])     # the index learns new files
    again = storage.purge_files(spark, root, gone, held=F.col("x") == 13).filter("outcome <> 'kept'").collect()
    assert [(str(r["day"]), r["purged"]) for r in again] == [("2024-01-04", 1)]
    assert storage.purge_files(spark, root, spark.createDataFrame([], "t string")).filter("outcome <> 'kept'").count() == 0
