"""Order statistics on range partitions: positions, group ranks, exact quantiles."""

import random

import duckdb
import pytest

from tessera.operators import ordered as O


@pytest.fixture()
def many_ranges(spark):
    """Keep every range partition (no AQE coalescing) so groups span tasks."""
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)


def _rows(seed=5, n=3000):
    rnd = random.Random(seed)
    # one group holds two thirds of the rows; one group is NULL; values repeat
    return [("hot" if i % 3 else rnd.choice(["a", "b", None]), rnd.randrange(0, 200) / 4.0) for i in range(n)]


def test_global_index_is_a_permutation_in_order(many_ranges):
    spark = many_ranges
    rows = _rows()
    df = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "id int, v double")
    got = sorted((r["_g"], r["v"], r["id"]) for r in O.global_index(df, ["v", "id"]).collect())
    assert [g for g, _, _ in got] == list(range(len(rows)))
    assert [(v, i) for _, v, i in got] == sorted((v, i) for i, (_, v) in enumerate(rows))


def test_exact_quantiles_equal_duckdb(many_ranges):
    """DuckDB's quantile_cont, with one value holding two thirds of the rows."""
    from pyspark.sql import functions as F
    spark = many_ranges
    rows = _rows() + [("hot", 7.5)] * 6000 + [("only_null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.5, 0.95, 0.99, 1.0]
    out = O.exact_quantiles(df, ["k"], "v", qs, [f"q{i}" for i in range(len(qs))],
                            weighted={"n": lambda v, c: F.sum(c), "total": lambda v, c: F.sum(v * c)}).collect()
    assert {r["k"]: r["n"] for r in out} == {k: sum(1 for kk, _ in rows if kk == k) for k in {k for k, _ in rows}}
    assert all(abs((r["total"] or 0) - sum(v or 0 for kk, v in rows if kk == r["k"])) < 1e-6 for r in out)
    assert all(r["q0"] is None for r in out if r["k"] == "only_null")
    got = {r["k"]: tuple(round(r[f"q{i}"], 9) for i in range(len(qs))) for r in out if r["k"] != "only_null"}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(k VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    sel = ", ".join(f"quantile_cont(v, {q})" for q in qs)
    exp = {r[0]: tuple(round(x, 9) for x in r[1:])
           for r in con.execute(f"SELECT k, {sel} FROM t WHERE v IS NOT NULL GROUP BY k").fetchall()}
    assert got == exp
