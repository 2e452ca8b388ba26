"""Relation tuples: seeding diff, userset expansion, checks (PRJ11, JN3, JN13-15, SET2-4, AGG6, AGG19, FN18).

Expansion keeps usersets symbolic (``org:x#member``) instead of multiplying
out every member of every parent -- the output stays linear in the tuple
count.  A check is then a handful of equi-joins: direct subject, wildcard
subject ``user:*`` and membership of a userset subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import valid_object_id
from ..session import materialize

TUPLE_COLS = ["user", "relation", "object"]
ROWS_A_TASK = 500_000                            # tuples that one task takes apart or holds, about

# ---------------------------------------------------------------------------
# V1 seed model (products, actions, role relations, record seeds).
# ---------------------------------------------------------------------------
PRODUCTS = ("fabric", "dashboard", "sponsors", "runtime", "lending", "inbox", "tenant", "admin", "rules", "auth",
            "ops", "deals", "dev", "support", "intake", "connector")
ACTIONS = ("read", "write", "admin", "promote", "approve", "rollback", "test", "simulate", "guidance", "operator",
           "platform", "codepath", "stage", "check", "submit", "draft", "list", "export", "tag", "assign",
           "move-stage", "watchlist", "bulk-tag", "bulk-assign", "bulk-watchlist", "bulk-move-stage")
PERMISSION_ROLE_NAMES = (
    "workspace-admin", "security-admin", "loan-officer", "loan-administrator", "underwriter", "loan-closer",
    "funding-officer", "loan-servicer", "portfolio-manager", "valuations-specialist", "compliance-officer",
    "quality-control-reviewer", "data-engineer", "special-assets-officer", "viewer",
    "operator", "borrower",
    "admin", "senior-underwriter", "credit-analyst", "analyst", "editor",
    "lo", "examiner", "credit_officer",
)
USER_ONLY_ROLES = ("borrower",)
SEED_TUPLES = (
    ("user:v3-admin-dev", "team_member", "deal:dddddddd-0000-4000-8000-000000000001"),
    ("user:v3-admin-dev", "team_member", "party:aaaaaaa1-0000-4000-8000-000000000001"),
)
WILDCARD = "user:*"
WRITE_BATCH = 50
# ---------------------------------------------------------------------------


def role_relations():
    return tuple("role_" + n for n in PERMISSION_ROLE_NAMES if n not in USER_ONLY_ROLES)


def product_grants(products: DataFrame, actions=ACTIONS, roles=None, product_col: str = "product") -> DataFrame:
    """PRJ11 groups (1) and (2) for every product row, generated with ``explode``.

    Each product row expands into its fixed relation list (26 actions, 24
    roles) -- a generator over a literal array, not a join."""
    roles = role_relations() if roles is None else roles
    p = F.col(product_col)
    g1 = products.select(F.lit(WILDCARD).alias("user"),
                         F.explode(F.array(*[F.lit("can_" + a) for a in actions])).alias("relation"),
                         F.concat(F.lit("product:"), p).alias("object"))
    g2 = products.select(F.lit(WILDCARD).alias("user"),
                         F.explode(F.array(*[F.lit(r) for r in roles])).alias("relation"),
                         F.concat(F.lit("permission:"), p).alias("object"))
    return g1.unionByName(g2)


def build_tuples(spark, products=PRODUCTS) -> DataFrame:
    """PRJ11: the V1 seed set (16 x 26 + 16 x 24 + 2 = 802 tuples)."""
    prods = spark.createDataFrame([(p,) for p in products], "product string")
    seeds = spark.createDataFrame(list(SEED_TUPLES), "user string, relation string, object string")
    return product_grants(prods).unionByName(seeds)


def split_valid(tuples: DataFrame) -> tuple:
    """FN18: (valid, rejected) by object-id shape."""
    ok = valid_object_id(F.col("object")) & F.col("user").isNotNull() & F.col("relation").isNotNull()
    return tuples.filter(ok), tuples.filter(~ok | ok.isNull())


def distinct_tuples(df: DataFrame) -> DataFrame:
    """AGG19/SET4: one row per (user, relation, object)."""
    return df.select(*TUPLE_COLS).dropDuplicates(TUPLE_COLS)


def diff_tuples(wanted: DataFrame, existing: DataFrame) -> tuple:
    """JN3/SET2 + AGG6: tuples still to write, plus (total, missing, skipped) counts."""
    w = distinct_tuples(wanted)
    missing = w.join(distinct_tuples(existing), TUPLE_COLS, "left_anti")
    flagged = w.join(distinct_tuples(existing).withColumn("_present", F.lit(True)), TUPLE_COLS, "left")
    stats = flagged.agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col("_present").isNull()).alias("missing"),
                        F.count_if(F.col("_present")).alias("skipped"))
    return missing, stats


def forget(tuples: DataFrame, objects: DataFrame, column: str = "object") -> DataFrame:
    """JN16-style delete by key list (anti join)."""
    return tuples.join(objects.select(column).distinct(), column, "left_anti")


# Userset rewrite rules of the record types: a stored tuple with relation R
# contributes (derived relation, subject suffix) for every entry of RULES[R].
# editor = this U team_member; viewer = this U editor U parent_org->member;
# confidential_viewer = this U team_member.
RECORD_RULES = {
    "team_member": (("editor", ""), ("viewer", ""), ("confidential_viewer", "")),
    "editor": (("editor", ""), ("viewer", "")),
    "viewer": (("viewer", ""),),
    "confidential_viewer": (("confidential_viewer", ""),),
    "parent_org": (("viewer", "#member"),),
}


def dealt(df: DataFrame, rows: int, *cols) -> DataFrame:
    """``df`` dealt by ``cols`` over as many tasks as its ``rows`` need, so what a task holds does not grow with the table."""
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *cols)


def expand_record_access(tuples: DataFrame, rules: dict = RECORD_RULES, rows: int | None = None) -> DataFrame:
    """JN13/JN15/SET4: computed relations of record objects, usersets kept symbolic.

    One pass: each stored tuple is rewritten by ``explode`` into the computed
    relations it contributes to (a parent org becomes the userset
    ``<org>#member``, never its member list), then one ``distinct``.  Tuples are
    dealt by (user, object) first: all that repeats one computed tuple meets in
    one task, and no task keeps the distinct tuples of a whole share of the table.
    ``rows``: how many tuples there are, about; counted where it is not given.
    """
    empty = F.array().cast("array<struct<rel:string,suffix:string>>")
    derived = None
    for r, outs in rules.items():
        arr = F.array(*[F.struct(F.lit(x).alias("rel"), F.lit(sfx).alias("suffix")) for x, sfx in outs])
        derived = F.when(F.col("relation") == r, arr) if derived is None else derived.when(F.col("relation") == r, arr)
    derived = derived.otherwise(empty)
    out = (tuples.select("user", "object", F.explode(derived).alias("d"))
                 .select(F.concat(F.col("user"), F.col("d.suffix")).alias("user"), F.col("d.rel").alias("relation"),
                         "object"))
    return distinct_tuples(dealt(out, tuples.count() if rows is None else rows, "user", "object"))


def check(requests: DataFrame, expanded: DataFrame, memberships: DataFrame) -> DataFrame:
    """Check ``(user, relation, object)`` requests against expanded tuples.

    Allowed when an expanded subject is the user itself, the wildcard
    ``user:*`` (JN15, never expanded), or a userset ``<org>#member`` the user
    belongs to (``memberships(user, relation='member', object=<org>)``).
    Requests and expanded tuples meet once by (user, relation, object): that
    makes requests distinct and settles direct subjects.  What is left meets the
    wildcard and the few usersets of its object, and only those are looked up
    among the user's memberships, so a user in many groups costs no more than
    one in few.  The expanded tuples are written once and read twice; one with a
    NULL grants nothing.
    """
    expanded = materialize(expanded.select(*TUPLE_COLS).dropna(), "expanded")
    n = requests.count() + expanded.count()
    both = (requests.select(*TUPLE_COLS, F.lit(True).alias("_asked"), F.lit(False).alias("_hit"))
                    .unionByName(expanded.withColumn("_asked", F.lit(False)).withColumn("_hit", F.lit(True))))
    asked = dealt(both, n, *TUPLE_COLS).groupBy(*TUPLE_COLS).agg(F.max("_asked").alias("_asked"), F.max("_hit").alias("_hit"))
    asked = asked.filter("_asked").drop("_asked")
    subjects = expanded.filter((F.col("user") == WILDCARD) | F.col("user").contains("#")).select(F.col("user").alias("_us"), "relation", "object").distinct()
    members = memberships.filter(F.col("relation") == "member").select(
        "user", F.concat(F.col("object"), F.lit("#member")).alias("_us"), F.lit(True).alias("_member")).distinct()
    met = asked.join(subjects, ["relation", "object"], "left").join(members, ["user", "_us"], "left")
    hit = F.col("_hit") | F.coalesce(F.col("_us") == WILDCARD, F.lit(False)) | F.coalesce(F.col("_member"), F.lit(False))
    return dealt(met.select(*TUPLE_COLS, hit.alias("allowed")), n, *TUPLE_COLS).groupBy(*TUPLE_COLS).agg(F.max("allowed").alias("allowed"))


def check_capabilities(requests: DataFrame, tuples: DataFrame) -> DataFrame:
    """JN14: ``granted = holder`` where holders are ``role:r#assignee`` usersets.

    request (user, capability) allowed iff user is an assignee of some role r
    and ``role:r#assignee`` holds the capability: two equi-joins."""
    req = requests.select("user", "object").distinct()
    holders = tuples.filter(F.col("relation") == "holder").select(F.col("user").alias("holder"), "object")
    assignees = tuples.filter(F.col("relation") == "assignee").select(
        "user", F.concat(F.col("object"), F.lit("#assignee")).alias("holder"))
    ok = req.join(assignees, "user").join(holders, ["holder", "object"], "left_semi").select("user", "object") \
            .distinct().withColumn("allowed", F.lit(True))
    return req.join(ok, ["user", "object"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
