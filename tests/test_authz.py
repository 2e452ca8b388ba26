"""Tuples: seed size, diff cases, id validity, expansion/check vs brute force."""

from pyspark.sql import functions as F

from tessera.operators import authz as AZ


def test_seed_size(spark):
    t = AZ.build_tuples(spark)
    assert t.count() == 802
    assert AZ.distinct_tuples(t).count() == 802


def test_diff_cases(spark):
    wanted = AZ.build_tuples(spark)
    none = spark.createDataFrame([], "user string, relation string, object string")
    m, s = AZ.diff_tuples(wanted, none)
    assert m.count() == 802 and s.collect()[0]["skipped"] == 0
    m, s = AZ.diff_tuples(wanted, wanted)
    assert m.count() == 0 and s.collect()[0]["skipped"] == 802
    part = wanted.filter("relation LIKE 'can_%'")
    dup = wanted.unionByName(wanted.limit(5))
    m, s = AZ.diff_tuples(dup, part)
    r = s.collect()[0]
    assert (r["total"], r["missing"], r["skipped"]) == (802, 802 - 416, 416)


def test_object_id_validity(spark):
    df = spark.createDataFrame([("user:*", "r", "permission:audit:read"), ("user:*", "r", "product:fabric"),
                                ("user:*", "r", "deal:a#b"), ("user:*", "r", "noseparator")],
                               "user string, relation string, object string")
    ok, bad = AZ.split_valid(df)
    assert [r["object"] for r in ok.collect()] == ["product:fabric"]
    assert bad.count() == 3


def _brute(tuples, requests, members):
    direct = {}
    for u, r, o in tuples:
        direct.setdefault((r, o), set()).add(u)

    def subjects(rel, obj):
        s = set(direct.get((rel, obj), set()))
        if rel in ("editor", "confidential_viewer"):
            s |= direct.get(("team_member", obj), set())
        if rel == "viewer":
            s |= subjects("editor", obj)
            for org in direct.get(("parent_org", obj), set()):
                s |= {u for u, o2 in members if o2 == org}
        return s
    out = {}
    for u, r, o in requests:
        s = subjects(r, o)
        out[(u, r, o)] = u in s or "user:*" in s
    return out


def test_check_matches_brute_force(spark):
    tuples = [("org:1", "parent_org", "deal:1"), ("user:a", "team_member", "deal:1"), ("user:b", "editor", "deal:2"),
              ("user:*", "viewer", "deal:3"), ("user:c", "confidential_viewer", "deal:1"),
              ("org:2", "parent_org", "deal:2")]
    members = [("user:m", "org:1"), ("user:n", "org:2"), ("user:a", "org:2")]
    users = ["user:a", "user:b", "user:c", "user:m", "user:n", "user:z"]
    rels = ["editor", "viewer", "confidential_viewer"]
    reqs = [(u, r, f"deal:{i}") for u in users for r in rels for i in (1, 2, 3, 4)]
    t = spark.createDataFrame(tuples, "user string, relation string, object string")
    m = spark.createDataFrame([(u, "member", o) for u, o in members], "user string, relation string, object string")
    q = spark.createDataFrame(reqs, "user string, relation string, object string")
    got = {(r["user"], r["relation"], r["object"]): r["allowed"]
           for r in AZ.check(q, AZ.expand_record_access(t), m).collect()}
    assert got == _brute(tuples, reqs, members)


def test_capabilities(spark):
    t = spark.createDataFrame([("role:uw#assignee", "holder", "capability:score"), ("user:a", "assignee", "role:uw"),
                               ("user:b", "assignee", "role:other")], "user string, relation string, object string")
    q = spark.createDataFrame([("user:a", "granted", "capability:score"), ("user:b", "granted", "capability:score")],
                              "user string, relation string, object string")
    got = {r["user"]: r["allowed"] for r in AZ.check_capabilities(q, t).collect()}
    assert got == {"user:a": True, "user:b": False}


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    """Expansion deals its tuples over as many tasks as there are rows, with the copies of a tuple in one task."""
    monkeypatch.setattr(AZ, "ROWS_A_TASK", 50)
    rows = [(f"user:{k % 40}", ("team_member", "editor", "parent_org")[k % 3], f"deal:{k % 200}") for k in range(1200)]
    t = spark.createDataFrame(rows, "user string, relation string, object string")
    out = AZ.expand_record_access(t).withColumn("task", F.spark_partition_id()).collect()
    want = {(u + s, d, o) for u, r, o in rows for d, s in AZ.RECORD_RULES[r]}
    assert len(out) == len(want) and {(r["user"], r["relation"], r["object"]) for r in out} == want
    assert len({r["task"] for r in out}) > 12


def test_check_with_repeats_nulls_and_several_ways_in(spark):
    """A request is answered once, whatever repeats; a NULL user passes by the wildcard only, a NULL object never."""
    ddl = "user string, relation string, object string"
    expanded = spark.createDataFrame([("user:a", "viewer", "d:1"), ("user:a", "viewer", "d:1"), ("org:1#member", "viewer", "d:1"), ("org:2#member", "viewer", "d:1"),
                                      ("user:*", "viewer", "d:2"), ("org:1#member", "viewer", "d:2"), ("user:a", "viewer", None)], ddl)
    members = spark.createDataFrame([("user:a", "member", "org:1"), ("user:a", "member", "org:1"), ("user:b", "member", "org:2"),
                                     ("user:c", "owner", "org:1"), (None, "member", "org:1")], ddl)
    asked = [(u, "viewer", o) for u in ("user:a", "user:b", "user:c", None) for o in ("d:1", "d:2", None)] + [("user:a", "viewer", "d:1")]
    got = AZ.check(spark.createDataFrame(asked, ddl), expanded, members).collect()
    assert len(got) == 12
    assert {(r["user"], r["object"]) for r in got if r["allowed"]} == {("user:a", "d:1"), ("user:b", "d:1")} | {(u, "d:2") for u in ("user:a", "user:b", "user:c", None)}
