"""Eval gate, authorization, identity, lifecycle and integrity bindings over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as FN
from ..operators import authz as AZ
from ..operators import evalgate as EG
from ..operators import identity as ID
from ..operators import lifecycle as LC
from ..operators import load as L
from ..session import TABLES, table
from . import binding

# ----------------------------------------------------------------- eval gate
# Two eval runs over all labelled documents: agent = language, skill = source;
# the baseline run scored ``quality``, the current run scores ``1 - toxic``.

_EVAL_SQL = """
j AS (SELECT d.lang AS agent_id, d.source AS skill_id, l.quality, 1 - l.toxic AS clean
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
base AS (SELECT agent_id, skill_id, avg(quality) AS accuracy FROM j GROUP BY 1, 2),
cur AS (SELECT agent_id, skill_id, avg(clean) AS current FROM j GROUP BY 1, 2),
cmp AS (
  SELECT b.agent_id, b.skill_id, b.accuracy AS baseline, c.current,
         CASE WHEN b.accuracy = 0 THEN NULL ELSE (b.accuracy - c.current) / b.accuracy * 100 END AS d
  FROM base b JOIN cur c ON b.agent_id = c.agent_id AND b.skill_id = c.skill_id),
cmp2 AS (
  SELECT agent_id, skill_id, baseline, current, floor(d * 100 + 0.5) / 100 AS drop_pct,
         CASE WHEN d > 5 THEN 'REGRESSION' WHEN d > 2 THEN 'WARNING' ELSE 'OK' END AS status
  FROM cmp),
agents AS (
  SELECT a.agent_id, coalesce(n_skills, 0) AS n_skills, coalesce(regressions, 0) AS regressions,
         coalesce(warnings, 0) AS warnings,
         CASE WHEN coalesce(regressions, 0) > 0 THEN 'REGRESSION' WHEN coalesce(warnings, 0) > 0 THEN 'WARNING'
              ELSE 'OK' END AS status
  FROM (SELECT DISTINCT agent_id FROM base) a
  LEFT JOIN (SELECT agent_id, count(*) AS n_skills, count(*) FILTER (WHERE status = 'REGRESSION') AS regressions,
                    count(*) FILTER (WHERE status = 'WARNING') AS warnings FROM cmp2 GROUP BY 1) s
    ON a.agent_id = s.agent_id)
"""


def _eval_inputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    j = table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("lang").alias("agent_id"), F.col("source").alias("skill_id"), "quality",
        (F.lit(1) - F.col("toxic")).alias("clean"))
    runs = j.groupBy("agent_id", "skill_id").agg(F.avg("quality").alias("accuracy"), F.avg("clean").alias("current"))
    base = runs.select("agent_id", "skill_id", "accuracy",
                       F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    cur = runs.select("agent_id", "skill_id", "current")
    return base, cur


@binding("eval_compare", sql="WITH " + _EVAL_SQL + """
SELECT agent_id, skill_id, baseline, current, drop_pct, status FROM cmp2
""")
def eval_compare(spark, sf_dir):
    """JN7 + FN1: per (agent, skill) drop %, status REGRESSION > 5, WARNING > 2."""
    base, cur = _eval_inputs(spark, sf_dir)
    return EG.compare_eval(base, cur)


@binding("eval_agents", sql="WITH " + _EVAL_SQL + """
SELECT agent_id, n_skills, regressions, warnings, status FROM agents
""")
def eval_agents(spark, sf_dir):
    """AGG4: per-agent roll-up, agents without surviving skills included (OK)."""
    base, cur = _eval_inputs(spark, sf_dir)
    return EG.agent_rollup(EG.compare_eval(base, cur), base)


@binding("eval_report", sql="WITH " + _EVAL_SQL + """
SELECT count(*) AS total_agents, count(*) FILTER (WHERE regressions > 0) AS regressions,
       count(*) FILTER (WHERE warnings > 0) AS warnings,
       count(*) FILTER (WHERE regressions = 0 AND warnings = 0) AS passing,
       count(*) FILTER (WHERE regressions > 0) > 0 AS has_regression,
       count(*) FILTER (WHERE warnings > 0) > 0 AS has_warning,
       CASE WHEN count(*) FILTER (WHERE regressions > 0) > 0 THEN 'BLOCKED' ELSE 'OPEN' END AS gate
FROM agents
""")
def eval_report(spark, sf_dir):
    """AGG5: totals and the production gate."""
    base, cur = _eval_inputs(spark, sf_dir)
    return EG.eval_report(EG.agent_rollup(EG.compare_eval(base, cur), base))


@binding("eval_ratchet", sql="WITH " + _EVAL_SQL + """
SELECT coalesce(b.agent_id, c.agent_id) AS agent_id, coalesce(b.skill_id, c.skill_id) AS skill_id,
       CASE WHEN c.current IS NOT NULL AND c.current >= coalesce(b.accuracy, 0) THEN c.current
            ELSE b.accuracy END AS accuracy,
       CASE WHEN c.current IS NOT NULL AND c.current >= coalesce(b.accuracy, 0) THEN TIMESTAMP '2024-02-01 00:00:00'
            ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at,
       c.current IS NOT NULL AND c.current >= coalesce(b.accuracy, 0) AS updated
FROM base b FULL OUTER JOIN cmp2 c ON b.agent_id = c.agent_id AND b.skill_id = c.skill_id
""")
def eval_ratchet(spark, sf_dir):
    """JN8 + DML13: baselines raised where current >= existing, stamped with the run time."""
    base, cur = _eval_inputs(spark, sf_dir)
    return EG.ratchet(base, EG.compare_eval(base, cur), "2024-02-01 00:00:00")


# ------------------------------------------------------------- authorization

_ACTIONS_VALUES = ", ".join(f"('can_{a}')" for a in AZ.ACTIONS)
_ROLES_VALUES = ", ".join(f"('{r}')" for r in AZ.role_relations())
_SEEDS_VALUES = ", ".join(f"('{u}', '{r}', '{o}')" for u, r, o in AZ.SEED_TUPLES)
_TUPLE_SQL = f"""
brands AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS product FROM part),
g1 AS (SELECT 'user:*' AS "user", a.relation, 'product:' || b.product AS object, b.product
       FROM brands b, (VALUES {_ACTIONS_VALUES}) a(relation)),
g2 AS (SELECT 'user:*' AS "user", r.relation, 'permission:' || b.product AS object
       FROM brands b, (VALUES {_ROLES_VALUES}) r(relation)),
wanted AS (SELECT "user", relation, object FROM g1 UNION ALL SELECT * FROM g2
           UNION ALL SELECT * FROM (VALUES {_SEEDS_VALUES}) s("user", relation, object)),
existing AS (SELECT "user", relation, object FROM g1 WHERE CAST(substr(product, 6) AS INTEGER) <= 12
             UNION ALL SELECT 'user:*', 'can_read', 'product:retired')
"""


def _seed_inputs(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(
        F.lower(F.regexp_replace("p_brand", "#", "")).alias("product")).distinct()
    seeds = spark.createDataFrame(list(AZ.SEED_TUPLES), "user string, relation string, object string")
    wanted = AZ.product_grants(brands).unionByName(seeds)
    early = brands.filter(F.substring("product", 6, 10).cast("int") <= 12)
    existing = (AZ.product_grants(early).filter(F.col("relation").startswith("can_"))
                .unionByName(spark.createDataFrame([("user:*", "can_read", "product:retired")],
                                                   "user string, relation string, object string")))
    return wanted, existing


@binding("tuple_seed_diff", sql="WITH " + _TUPLE_SQL + """
SELECT DISTINCT "user", relation, object FROM wanted
EXCEPT SELECT "user", relation, object FROM existing
""")
def tuple_seed_diff(spark, sf_dir):
    """PRJ11 + JN3/SET2: tuples per product (from part brands) minus those already stored."""
    wanted, existing = _seed_inputs(spark, sf_dir)
    missing, _ = AZ.diff_tuples(wanted, existing)
    return missing


@binding("tuple_seed_stats", sql="WITH " + _TUPLE_SQL + """,
w AS (SELECT DISTINCT "user", relation, object FROM wanted),
e AS (SELECT DISTINCT "user", relation, object FROM existing)
SELECT count(*) AS total, count(*) FILTER (WHERE e.object IS NULL) AS missing,
       count(*) FILTER (WHERE e.object IS NOT NULL) AS skipped
FROM w LEFT JOIN e ON w."user" = e."user" AND w.relation = e.relation AND w.object = e.object
""")
def tuple_seed_stats(spark, sf_dir):
    """AGG6: total / missing / skipped of the seed diff."""
    wanted, existing = _seed_inputs(spark, sf_dir)
    _, stats = AZ.diff_tuples(wanted, existing)
    return stats


_AUTHZ_SQL = """
t AS (
  SELECT 'org:n' || CAST(c.c_nationkey AS VARCHAR) AS "user", 'parent_org' AS relation,
         'deal:' || CAST(o.o_orderkey AS VARCHAR) AS object
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  UNION ALL SELECT 'user:c' || CAST(o_custkey AS VARCHAR), 'team_member', 'deal:' || CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'user:c' || CAST(o_custkey AS VARCHAR), 'editor', 'deal:' || CAST(o_orderkey AS VARCHAR)
            FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'user:*', 'viewer', 'deal:' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'),
editor AS (SELECT "user", object FROM t WHERE relation IN ('editor', 'team_member')),
viewer AS (SELECT "user", object FROM t WHERE relation = 'viewer' UNION ALL SELECT "user", object FROM editor
           UNION ALL SELECT "user" || '#member', object FROM t WHERE relation = 'parent_org'),
conf AS (SELECT "user", object FROM t WHERE relation IN ('confidential_viewer', 'team_member')),
exp AS (SELECT DISTINCT "user", 'editor' AS relation, object FROM editor
        UNION SELECT DISTINCT "user", 'viewer', object FROM viewer
        UNION SELECT DISTINCT "user", 'confidential_viewer', object FROM conf)
"""


def _record_tuples(spark, sf_dir):
    """Record tuples of every order, generated in one scan (orders joined to customer once)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    deal = F.concat(F.lit("deal:"), F.col("o_orderkey").cast("string"))
    cust = F.concat(F.lit("user:c"), F.col("o_custkey").cast("string"))

    def tup(u, r, ok=None):
        t = F.struct(u.alias("user"), F.lit(r).alias("relation"), deal.alias("object"))
        return t if ok is None else F.when(ok, t)
    gen = F.filter(F.array(
        tup(F.concat(F.lit("org:n"), F.col("c_nationkey").cast("string")), "parent_org"),
        tup(cust, "team_member"),
        tup(cust, "editor", F.col("o_orderpriority") == "1-URGENT"),
        tup(F.lit(AZ.WILDCARD), "viewer", F.col("o_orderstatus") == "O")), lambda x: x.isNotNull())
    return o.join(c, o.o_custkey == c.c_custkey).select(F.explode(gen).alias("t")).select("t.*")


def _expanded(spark, sf_dir):
    """Record access of every order, which makes four tuples at most."""
    return AZ.expand_record_access(_record_tuples(spark, sf_dir), rows=4 * table(spark, sf_dir, "orders").count())


@binding("authz_expand", sql="WITH " + _AUTHZ_SQL + """
SELECT "user", relation, object FROM exp
""")
def authz_expand(spark, sf_dir):
    """JN13/JN15/SET4: editor / viewer / confidential_viewer with usersets kept symbolic."""
    return _expanded(spark, sf_dir)


@binding("authz_check", sql="WITH " + _AUTHZ_SQL + """,
members AS (SELECT 'user:s' || CAST(s_suppkey AS VARCHAR) AS "user", 'org:n' || CAST(s_nationkey AS VARCHAR) AS org
            FROM supplier),
req AS (SELECT DISTINCT 'user:s' || CAST(l_suppkey AS VARCHAR) AS "user", 'viewer' AS relation,
               'deal:' || CAST(l_orderkey AS VARCHAR) AS object FROM lineitem
        UNION SELECT DISTINCT 'user:c' || CAST(o_custkey AS VARCHAR), 'editor', 'deal:' || CAST(o_orderkey AS VARCHAR)
        FROM orders)
SELECT r."user", r.relation, r.object,
       EXISTS (SELECT 1 FROM exp e WHERE e.object = r.object AND e.relation = r.relation
                                     AND (e."user" = r."user" OR e."user" = 'user:*'))
       OR EXISTS (SELECT 1 FROM members m JOIN exp e ON e."user" = m.org || '#member'
                  WHERE m."user" = r."user" AND e.object = r.object AND e.relation = r.relation) AS allowed
FROM req r
""")
def authz_check(spark, sf_dir):
    """Checks: can each supplier view the deals it ships; can each customer edit its own deal."""
    expanded = _expanded(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    members = s.select(F.concat(F.lit("user:s"), F.col("s_suppkey").cast("string")).alias("user"),
                       F.lit("member").alias("relation"),
                       F.concat(F.lit("org:n"), F.col("s_nationkey").cast("string")).alias("object"))
    li = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("user:s"), F.col("l_suppkey").cast("string")).alias("user"), F.lit("viewer").alias("relation"),
        F.concat(F.lit("deal:"), F.col("l_orderkey").cast("string")).alias("object"))
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("user:c"), F.col("o_custkey").cast("string")).alias("user"), F.lit("editor").alias("relation"),
        F.concat(F.lit("deal:"), F.col("o_orderkey").cast("string")).alias("object"))
    return AZ.check(li.unionByName(o), expanded, members)


@binding("distinct_tuples", sql="""
WITH a AS (SELECT 'user:c' || CAST(o_custkey AS VARCHAR) AS "user", 'team_member' AS relation,
                  'deal:' || CAST(o_orderkey AS VARCHAR) AS object FROM orders),
b AS (SELECT 'user:c' || CAST(o_custkey AS VARCHAR) AS "user", 'team_member' AS relation,
             'deal:' || CAST(o_orderkey AS VARCHAR) AS object FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'user:*', 'viewer', 'deal:' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'),
d AS (SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT * FROM d
WHERE object NOT IN (SELECT 'deal:' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW')
""")
def distinct_tuples(spark, sf_dir):
    """AGG19/SET3/JN16: union all of overlapping tuple sets, distinct, then forget a key list."""
    o = table(spark, sf_dir, "orders")
    deal = F.concat(F.lit("deal:"), F.col("o_orderkey").cast("string")).alias("object")
    cust = F.concat(F.lit("user:c"), F.col("o_custkey").cast("string")).alias("user")
    a = o.select(cust, F.lit("team_member").alias("relation"), deal)
    f = o.filter(F.col("o_orderstatus") == "F")
    b = f.select(cust, F.lit("team_member").alias("relation"), deal).unionByName(
        f.select(F.lit(AZ.WILDCARD).alias("user"), F.lit("viewer").alias("relation"), deal))
    forget = o.filter(F.col("o_orderpriority") == "5-LOW").select(deal)
    return AZ.forget(AZ.distinct_tuples(a.unionByName(b)), forget)


# ----------------------------------------------------------------- identity

_GROUP_MAP = '{"automobile":["underwriter"],"BUILDING":["loan-officer","underwriter"],"furniture":["viewer"]}'
_ALLOWED_DOMAINS = " @Tessera.Test, partner.com ,,"


def _logins(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nk = F.col("c_nationkey")
    bal = F.col("c_acctbal")
    return c.select(
        F.col("c_custkey").cast("string").alias("login_id"), "c_custkey",
        F.when(nk == 0, "google-oauth2").when(nk == 1, "auth0").when(nk == 2, "email")
         .otherwise("okta-workforce").alias("strategy"),
        F.lit("okta").alias("connection"),
        F.when(nk.isin(3, 4), F.lit(None)).otherwise(F.concat(F.lit("tn"), nk.cast("string"))).alias("conn_tenant_id"),
        F.when(nk < 20, F.lit(_GROUP_MAP)).when(nk == 24, F.lit("not json")).alias("conn_group_role_map"),
        F.when(nk.isin(4, 5, 20, 21, 22), F.lit("viewer")).alias("conn_default_role"),
        F.when(nk < 10, F.lit("internal")).alias("conn_portal_type"),
        F.concat(F.lower(F.regexp_replace("c_name", "Customer#", "cust.")), F.lit("@"),
                 F.when(nk < 12, F.lit("tessera.test")).otherwise(F.lit("example.com"))).alias("email"),
        F.array(F.col("c_mktsegment")).alias("groups"),
        F.when(bal > 8000, F.concat(F.lit("tc"), F.col("c_custkey").cast("string"))).alias("app_tenant_id"),
        F.when(bal.between(9000, 9999), F.array(F.lit("workspace-admin")))
         .otherwise(F.array().cast("array<string>")).alias("app_roles"),
        F.lit(None).cast("string").alias("app_portal_type"),
        (bal < 0).alias("app_disabled"),
        F.lit(None).cast("string").alias("aaid"))


def _q(s):
    return "'" + s.replace("'", "''") + "'"


@binding("role_resolve", sql=f"""
WITH l AS (
  SELECT c_custkey,
         CASE c_nationkey WHEN 0 THEN 'google-oauth2' WHEN 1 THEN 'auth0' WHEN 2 THEN 'email' ELSE 'okta-workforce' END
           AS strategy,
         CASE WHEN c_nationkey IN (3, 4) THEN NULL ELSE 'tn' || CAST(c_nationkey AS VARCHAR) END AS conn_tenant_id,
         CASE WHEN c_nationkey < 20 THEN
           CASE lower(c_mktsegment) WHEN 'automobile' THEN ['underwriter'] WHEN 'building' THEN ['loan-officer', 'underwriter']
                                    WHEN 'furniture' THEN ['viewer'] ELSE []::VARCHAR[] END
           ELSE []::VARCHAR[] END AS mapped,
         CASE WHEN c_nationkey IN (4, 5, 20, 21, 22) THEN 'viewer' END AS default_role,
         CASE WHEN c_nationkey < 10 THEN 'internal' END AS conn_portal_type,
         lower(replace(c_name, 'Customer#', 'cust.')) || '@' || CASE WHEN c_nationkey < 12 THEN 'tessera.test'
                                                                   ELSE 'example.com' END AS email,
         CASE WHEN c_acctbal > 8000 THEN 'tc' || CAST(c_custkey AS VARCHAR) END AS app_tenant_id,
         CASE WHEN c_acctbal BETWEEN 9000 AND 9999 THEN ['workspace-admin'] ELSE []::VARCHAR[] END AS app_roles,
         c_acctbal < 0 AS disabled
  FROM customer),
r AS (
  SELECT *, coalesce(nullif(app_tenant_id, ''), nullif(conn_tenant_id, '')) AS tenant,
         CASE WHEN len(app_roles) > 0 THEN app_roles WHEN len(mapped) > 0 THEN mapped
              WHEN default_role IS NOT NULL THEN [default_role] ELSE []::VARCHAR[] END AS roles
  FROM l),
d AS (
  SELECT *,
         CASE WHEN strategy IN ({', '.join(_q(s) for s in ID.SOCIAL_STRATEGIES)}) THEN {_q(ID.DENY_SOCIAL)}
              WHEN strategy IN ('auth0', 'email') THEN NULL
              WHEN disabled THEN {_q(ID.DENY_DISABLED)}
              WHEN tenant IS NULL THEN {_q(ID.DENY_NOT_SET_UP)}
              WHEN len(roles) = 0 AND default_role IS NULL THEN {_q(ID.DENY_NOT_SET_UP)}
              WHEN len(roles) = 0 THEN {_q(ID.DENY_NOT_PROVISIONED)} END AS deny_reason
  FROM r)
SELECT c_custkey,
       CASE WHEN deny_reason IS NOT NULL THEN 'deny' WHEN strategy IN ('auth0', 'email') THEN 'skip' ELSE 'allow' END
         AS outcome,
       deny_reason,
       CASE WHEN deny_reason IS NULL AND strategy NOT IN ('auth0', 'email') THEN tenant END AS tenant_id,
       CASE WHEN deny_reason IS NULL AND strategy NOT IN ('auth0', 'email') THEN array_to_string(roles, ',') END AS roles,
       CASE WHEN deny_reason IS NULL AND strategy NOT IN ('auth0', 'email') THEN conn_portal_type END AS portal_type,
       split_part(email, '@', 2) IN ('tessera.test', 'partner.com') AS domain_allowed
FROM d
""")
def role_resolve(spark, sf_dir):
    """FIL9-11 + JN10 + FN7-9: sign-in outcome, deny reason, tenant, roles, portal; domain lock."""
    r = ID.resolve_login(_logins(spark, sf_dir), social_enabled=False, allowed_domains_csv=_ALLOWED_DOMAINS)
    return r.select("c_custkey", "outcome", "deny_reason", "tenant_id",
                    F.array_join("roles", ",").alias("roles"), "portal_type", "domain_allowed")


@binding("login_claims", sql="""
WITH l AS (
  SELECT c_custkey, c_nationkey AS nk, c_acctbal AS bal, c_mktsegment AS seg,
         CASE c_nationkey WHEN 0 THEN 'github' WHEN 1 THEN 'email' ELSE 'auth0' END AS strategy,
         CASE WHEN c_nationkey < 15 THEN 'org' || c_nationkey END AS org_id,
         CASE WHEN c_nationkey < 8 THEN 'tn' || c_nationkey WHEN c_nationkey = 8 THEN '' END AS org_tenant,
         CASE WHEN c_nationkey % 3 = 0 THEN 'Org ' || c_nationkey END AS org_name,
         CASE WHEN c_acctbal > 5000 THEN 'app' || c_custkey END AS app_tenant
  FROM customer),
t AS (SELECT *, coalesce(CASE WHEN org_id IS NOT NULL THEN nullif(coalesce(org_tenant, org_id), '') END, app_tenant) AS tenant FROM l),
s AS (SELECT *, strategy = 'github' OR tenant IS NULL AS skip FROM t)
SELECT c_custkey, CASE WHEN skip THEN 'skip' ELSE 'allow' END AS outcome,
       CASE WHEN NOT skip THEN tenant END AS tenant_id,
       CASE WHEN NOT skip THEN coalesce(CASE WHEN org_id IS NOT NULL THEN org_name END, CASE WHEN bal < 0 THEN 'Shown ' || nk END) END AS tenant_name,
       CASE WHEN NOT skip THEN CASE WHEN bal < 1000 THEN 'm' || c_custkey ELSE 'sub|' || c_custkey END END AS aaid,
       CASE WHEN NOT skip THEN CASE seg WHEN 'BUILDING' THEN 'underwriter,viewer' WHEN 'MACHINERY' THEN '' ELSE 'borrower' END END AS roles,
       CASE WHEN NOT skip AND seg = 'FURNITURE' THEN 'customer' END AS portal_type,
       CASE WHEN NOT skip AND seg = 'FURNITURE' THEN 'e' || c_custkey END AS portal_entity_id,
       CASE WHEN NOT skip THEN CASE WHEN org_id IS NOT NULL AND nk % 4 = 0 THEN 'lending,edd' WHEN org_id IS NOT NULL AND nk % 4 = 1 THEN ''
            ELSE 'base,compliance' END END AS products,
       CASE WHEN NOT skip AND nk <> 20 THEN 'mail' || nk || '.example' END AS email_domain
FROM s
""")
def login_claims(spark, sf_dir):
    """FN6-FN9: claims of database and passwordless logins; organisation before app metadata."""
    c = table(spark, sf_dir, "customer")
    nk, bal, seg, ck = F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    logins = c.select(
        ck.alias("login_id"), F.when(nk == 0, "github").when(nk == 1, "email").otherwise("auth0").alias("strategy"),
        F.when(nk < 15, F.concat(F.lit("org"), nk)).alias("org_id"),
        F.when(nk % 3 == 0, F.concat(F.lit("Org "), nk)).alias("org_display_name"),
        F.when(nk < 8, F.concat(F.lit("tn"), nk)).when(nk == 8, "").alias("org_tenant_id"),
        F.when(nk % 4 == 0, '["lending", 7, "edd", null]').when(nk % 4 == 1, "[]").when(nk % 4 == 2, '{"a": 1}').alias("org_products"),
        F.when(seg == "BUILDING", F.array(F.lit("underwriter"), F.lit("viewer"))).otherwise(F.array().cast("array<string>")).alias("org_roles"),
        F.concat(F.lit("sub|"), ck).alias("user_id"),
        F.when(nk == 20, "no address").otherwise(F.concat(F.lit("u@mail"), nk, F.lit(".example"))).alias("email"),
        F.when(bal > 5000, F.concat(F.lit("app"), ck)).alias("app_tenant_id"),
        F.when(bal < 0, F.concat(F.lit("Shown "), nk)).alias("app_org_display_name"),
        F.when(seg != "MACHINERY", F.array(F.lit("borrower"))).alias("app_roles"),
        F.when(seg == "FURNITURE", "customer").otherwise("").alias("app_portal_type"),
        F.when(seg == "FURNITURE", F.concat(F.lit("e"), ck)).alias("app_portal_entity_id"),
        F.when(bal < 1000, F.concat(F.lit("m"), ck)).alias("aaid"))
    out = ID.login_claims(logins, default_products="base, compliance,")
    flat = [F.array_join(n, ",").alias(n) if n in ("roles", "products") else F.col(n) for n in ID.CLAIMS]
    return out.select(F.col("login_id").cast("long").alias("c_custkey"), "outcome", *flat)


# ----------------------------------------------------------------- lifecycle

AS_OF_LIFE = "2001-09-01"
_BUCKET = {"1-URGENT": "evidence", "2-HIGH": "documents", "3-MEDIUM": "assets", "4-NOT SPECIFIED": "exports"}


def _objects(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    b = None
    for k, v in _BUCKET.items():
        b = F.when(F.col("o_orderpriority") == k, F.lit(v)) if b is None else b.when(F.col("o_orderpriority") == k, F.lit(v))
    b = b.otherwise(F.lit("alb-logs"))
    return o.select("o_orderkey", b.alias("bucket"), F.col("o_orderdate").alias("created_at"),
                    F.when(F.col("o_orderstatus") == "P", F.lit("2001-10-01 00:00:00").cast("timestamp_ntz"))
                     .alias("locked_until"))


def _rules_sql():
    def v(x):
        return "NULL" if x is None else (repr(x) if not isinstance(x, str) else f"'{x}'")
    return ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in LC.BUCKET_RULES)


_OBJ_SQL = f"""
o AS (SELECT o_orderkey,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'evidence' WHEN '2-HIGH' THEN 'documents'
                  WHEN '3-MEDIUM' THEN 'assets' WHEN '4-NOT SPECIFIED' THEN 'exports' ELSE 'alb-logs' END AS bucket,
             o_orderdate AS created_at,
             CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2001-10-01 00:00:00' END AS locked_until
      FROM orders),
r(bucket, expire_days, ia_days, glacier_days, lock_days) AS (VALUES {_rules_sql()}),
a AS (SELECT o.*, date_diff('day', CAST(created_at AS DATE), DATE '{AS_OF_LIFE}') AS age_days,
             r.expire_days, r.ia_days, r.glacier_days, r.lock_days
      FROM o LEFT JOIN r ON o.bucket = r.bucket)
"""


@binding("retention_expire", sql="WITH " + _OBJ_SQL + f""",
k AS (SELECT *, coalesce(age_days < lock_days, false)
                OR coalesce(locked_until > TIMESTAMP '{AS_OF_LIFE} 00:00:00', false) AS locked FROM a)
SELECT o_orderkey, bucket, age_days, locked FROM k
WHERE NOT (coalesce(age_days >= expire_days, false) AND NOT locked)
""")
def retention_expire(spark, sf_dir):
    """DML6 + DML9: objects kept after bucket expiry, object lock and legal holds."""
    out = LC.expire(_objects(spark, sf_dir), LC.rules_frame(spark), AS_OF_LIFE)
    return out.select("o_orderkey", "bucket", "age_days", "locked")


@binding("storage_tier", sql="WITH " + _OBJ_SQL + """
SELECT o_orderkey, bucket,
       CASE WHEN coalesce(age_days >= expire_days, false) THEN 'EXPIRED'
            WHEN coalesce(age_days >= glacier_days, false) THEN 'GLACIER'
            WHEN coalesce(age_days >= ia_days, false) THEN 'STANDARD_IA' ELSE 'STANDARD' END AS tier
FROM a
""")
def storage_tier(spark, sf_dir):
    """DML7: storage class by age and bucket lifecycle."""
    return LC.storage_tier(_objects(spark, sf_dir), LC.rules_frame(spark), AS_OF_LIFE).select(
        "o_orderkey", "bucket", "tier")


@binding("retention_rules", sql="""
WITH r(bucket, expire_days, ia_days, glacier_days, lock_days) AS (VALUES
  ('logs', 15, NULL, NULL, NULL), ('traces', 14, NULL, NULL, NULL), ('bronze', 30, NULL, NULL, NULL), ('ops-events', 730, 30, 90, NULL),
  ('audit-archive', 2555, NULL, 90, 2555), ('audit-archive-nonprod', 2555, NULL, 90, 90), ('audit-exports', 2555, 30, NULL, NULL)),
o AS (SELECT CASE l_linenumber WHEN 1 THEN 'logs' WHEN 2 THEN 'traces' WHEN 3 THEN 'bronze' WHEN 4 THEN 'ops-events'
                  WHEN 5 THEN 'audit-archive' WHEN 6 THEN 'audit-archive-nonprod' ELSE 'audit-exports' END AS bucket,
             date_diff('day', CAST(l_shipdate AS DATE), DATE '1998-11-30') AS age FROM lineitem),
a AS (SELECT o.*, expire_days, ia_days, glacier_days, coalesce(age < lock_days, false) AS locked FROM o JOIN r USING (bucket))
SELECT bucket, locked, CASE WHEN age >= expire_days THEN 'EXPIRED' WHEN age >= glacier_days THEN 'GLACIER' WHEN age >= ia_days THEN 'STANDARD_IA'
       ELSE 'STANDARD' END AS tier, count(*) AS n, min(age) AS youngest, max(age) AS oldest
FROM a WHERE NOT (age >= expire_days AND NOT locked) GROUP BY 1, 2, 3
""")
def retention_rules(spark, sf_dir):
    """DML6-7, DML9: logs, traces, event files, operations events and audit stores under their rules."""
    stores = F.array(*[F.lit(r[0]) for r in LC.STORE_RULES])
    rows = table(spark, sf_dir, "lineitem").select(
        F.element_at(stores, F.least("l_linenumber", F.lit(len(LC.STORE_RULES))).cast("int")).alias("bucket"), F.col("l_shipdate").alias("created_at"))
    kept = LC.expire(rows, LC.rules_frame(spark), "1998-11-30")
    kept = LC.storage_tier(kept, LC.rules_frame(spark), "1998-11-30")
    return kept.groupBy("bucket", "locked", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("age_days").alias("youngest"), F.max("age_days").alias("oldest"))


_TENANT_ROWS_SQL = """
rows_ AS (SELECT 'customer' AS table_name, c_custkey AS key, c_name AS name, 'tn' || CAST(c_nationkey AS VARCHAR) AS tenant_id
          FROM customer
          UNION ALL SELECT 'supplier', s_suppkey, s_name, 'tn' || CAST(s_nationkey AS VARCHAR) FROM supplier),
purges AS (SELECT 'tn' || CAST(n_nationkey AS VARCHAR) AS tenant_id,
                  CASE n_regionkey WHEN 0 THEN TIMESTAMP '2001-07-01 00:00:00' ELSE TIMESTAMP '2001-08-20 00:00:00' END
                    AS requested_at
           FROM nation WHERE n_regionkey IN (0, 1)),
due AS (SELECT DISTINCT tenant_id FROM purges WHERE requested_at + INTERVAL 30 DAY <= TIMESTAMP '2001-09-01 00:00:00')
"""


def _tenant_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("key"),
                                                F.col("c_name").alias("name"),
                                                F.concat(F.lit("tn"), F.col("c_nationkey").cast("string")).alias("tenant_id"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("table_name"), F.col("s_suppkey").alias("key"),
                                                F.col("s_name").alias("name"),
                                                F.concat(F.lit("tn"), F.col("s_nationkey").cast("string")).alias("tenant_id"))
    return {"customer": c, "supplier": s}


def _purges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter(F.col("n_regionkey").isin(0, 1))
    return n.select(F.concat(F.lit("tn"), F.col("n_nationkey").cast("string")).alias("tenant_id"),
                    F.when(F.col("n_regionkey") == 0, F.lit("2001-07-01 00:00:00"))
                     .otherwise(F.lit("2001-08-20 00:00:00")).cast("timestamp_ntz").alias("requested_at"))


@binding("tenant_purge", sql="WITH " + _TENANT_ROWS_SQL + """
SELECT table_name, key, tenant_id FROM rows_ WHERE tenant_id NOT IN (SELECT tenant_id FROM due)
""")
def tenant_purge(spark, sf_dir):
    """DML11: rows remaining after purging tenants whose 30-day grace has passed."""
    t = _tenant_rows(spark, sf_dir)
    rows = t["customer"].unionByName(t["supplier"])
    return LC.purge_tenants(rows, _purges(spark, sf_dir), "2001-09-01 00:00:00").select("table_name", "key", "tenant_id")


@binding("tenant_export", sql="WITH " + _TENANT_ROWS_SQL + """
SELECT table_name, key, name, tenant_id FROM rows_ WHERE tenant_id = 'tn7'
""")
def tenant_export(spark, sf_dir):
    """DML10: every row of one tenant across tables."""
    parts = LC.export_tenant(_tenant_rows(spark, sf_dir), "tn7")
    return parts["customer"].unionByName(parts["supplier"])


@binding("audit_anonymize", sql="WITH " + _TENANT_ROWS_SQL + """
SELECT table_name, sha256('test-salt:' || CAST(key AS VARCHAR)) AS key, sha256('test-salt:' || name) AS name, tenant_id,
       CAST(DATE '2001-09-01' + INTERVAL 84 MONTH AS DATE) AS retain_until
FROM rows_ WHERE tenant_id IN (SELECT tenant_id FROM due)
""")
def audit_anonymize(spark, sf_dir):
    """DML12: purged tenants' rows kept for audit with identifying columns hashed."""
    t = _tenant_rows(spark, sf_dir)
    rows = t["customer"].unionByName(t["supplier"])
    due = LC.purge_list_due(_purges(spark, sf_dir), "2001-09-01 00:00:00")
    return LC.anonymize(rows.join(due, "tenant_id", "left_semi"), ["key", "name"], "test-salt", AS_OF_LIFE).select(
        "table_name", "key", "name", "tenant_id", "retain_until")


# ----------------------------------------------------------------- integrity

INTEGRITY_SPECS = {
    "region": (["r_regionkey"], ["r_regionkey", "r_name"]),
    "nation": (["n_nationkey"], ["n_nationkey", "n_regionkey"]),
    "customer": (["c_custkey"], ["c_custkey", "c_nationkey"]),
    "supplier": (["s_suppkey"], ["s_suppkey", "s_nationkey"]),
    "part": (["p_partkey"], ["p_partkey", "p_brand"]),
    "orders": (["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderdate"]),
    "lineitem": (["l_orderkey", "l_linenumber"], ["l_orderkey", "l_shipdate"]),
    "events": (["event_id"], ["event_id", "ts", "event_type"]),
    "documents": (["doc_id"], ["doc_id", "text"]),
    "embeddings": (["vec_id"], ["vec_id", "embedding"]),
    "pages": (["page_id"], ["page_id", "html"]),
    "benchmark": (["item_id"], ["item_id", "text"]),
    "labels": (["doc_id"], ["doc_id", "quality"]),
    "conversations": (["conv_id", "turn"], ["conv_id", "turn", "text"]),
}


def _integrity_sql():
    parts = []
    for t, (keys, _) in INTEGRITY_SPECS.items():
        nulls = " + ".join(f"count(*) FILTER (WHERE {k} IS NULL)" for k in keys)
        parts.append(f"SELECT '{t}' AS table_name, count(*) AS n, CAST({nulls} AS BIGINT) AS nulls FROM {t}")
    return " UNION ALL ".join(parts)


@binding("integrity_checks", sql=f"""
WITH c AS ({_integrity_sql()}),
checks AS (
  SELECT table_name, 'rows_present' AS "check", n AS observed, n > 0 AS ok FROM c
  UNION ALL SELECT table_name, 'keys_not_null', nulls, nulls = 0 FROM c
  UNION ALL SELECT table_name, 'columns_present', CAST(0 AS BIGINT), true FROM c)
SELECT * FROM checks
UNION ALL
SELECT NULL, 'overall', count(*) FILTER (WHERE NOT ok), count(*) FILTER (WHERE NOT ok) = 0 FROM checks
""")
def integrity_checks(spark, sf_dir):
    """AGG17: rows present, keys not null, required columns present, overall verdict."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    return LC.integrity_checks(tables, INTEGRITY_SPECS)


@binding("latest_snapshot", sql="""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1
""")
def latest_snapshot(spark, sf_dir):
    """AGG18/SRT3: newest row per key (max_by, partial aggregation, no sort)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return L.latest(o, "o_custkey", "o_orderdate")


# ----------------------------------------------------------------- scalars

@binding("scalar_cleaning", sql="""
WITH c AS (
  SELECT c_custkey, c_nationkey, c_acctbal, lower(c_mktsegment) AS seg,
         lower(replace(c_name, 'Customer#', 'cust.')) || CASE WHEN c_acctbal < 0 THEN '@legacy@' ELSE '@' END
           || lower(c_mktsegment) || '.example.com' AS email,
         CASE WHEN c_nationkey < 10 THEN ' @' || lower(c_mktsegment) || '.example.com, Corp.COM ,,' ELSE ' Corp.COM,' END
           AS csv,
         CASE WHEN c_acctbal > 5000 THEN '["lending","edd"]' WHEN c_acctbal < 0 THEN 'lending, compliance ,edd'
              WHEN c_acctbal < 100 THEN '[broken' ELSE '' END AS products_raw,
         c_name
  FROM customer),
d AS (
  SELECT *, list_filter(list_transform(string_split(csv, ','), lambda x: regexp_replace(lower(trim(x)), '^@', '')),
                        lambda x: x <> '') AS domains
  FROM c)
SELECT c_custkey, email,
       string_split(email, '@')[-1] AS domain_last,
       string_split(email, '@')[2] AS domain_second,
       array_to_string(domains, ',') AS domains,
       len(domains) = 0 OR list_contains(domains, string_split(email, '@')[-1]) AS domain_allowed,
       array_to_string(CASE WHEN trim(products_raw) = '' THEN []::VARCHAR[]
                            WHEN starts_with(trim(products_raw), '[') AND json_valid(products_raw)
                              THEN from_json(products_raw, '["VARCHAR"]')
                            ELSE list_filter(list_transform(string_split(products_raw, ','), lambda x: trim(x)),
                                             lambda x: x <> '') END, ',') AS products,
       regexp_matches('customer:' || c_name, '^[^:#@]+:[^:#@]+$') AS obj_valid_name,
       regexp_matches('customer:' || CAST(c_custkey AS VARCHAR), '^[^:#@]+:[^:#@]+$') AS obj_valid_key,
       'team-admin,team-' || seg AS roles_prefixed,
       'team-logs-tn' || CAST(c_nationkey AS VARCHAR) || '-2024.01.15' AS index_name
FROM d
""")
def scalar_cleaning(spark, sf_dir):
    """FN4-6, FN9, FN15-18 over customer rows: domains, e-mail domain both ways, JSON-or-CSV, ids."""
    c = table(spark, sf_dir, "customer")
    seg = F.lower("c_mktsegment")
    email = F.concat(F.lower(F.regexp_replace("c_name", "Customer#", "cust.")),
                     F.when(F.col("c_acctbal") < 0, F.lit("@legacy@")).otherwise(F.lit("@")),
                     seg, F.lit(".example.com"))
    csv = F.when(F.col("c_nationkey") < 10, F.concat(F.lit(" @"), seg, F.lit(".example.com, Corp.COM ,,"))) \
           .otherwise(F.lit(" Corp.COM,"))
    raw = (F.when(F.col("c_acctbal") > 5000, F.lit('["lending","edd"]'))
           .when(F.col("c_acctbal") < 0, F.lit("lending, compliance ,edd"))
           .when(F.col("c_acctbal") < 100, F.lit("[broken")).otherwise(F.lit("")))
    d = c.select("c_custkey", "c_name", "c_nationkey", email.alias("email"), csv.alias("csv"), raw.alias("raw"),
                 seg.alias("seg"))
    return d.select(
        "c_custkey", "email",
        FN.email_domain("email", "last").alias("domain_last"),
        FN.email_domain("email", "second").alias("domain_second"),
        F.array_join(FN.parse_domains("csv"), ",").alias("domains"),
        FN.domain_allowed("email", "csv").alias("domain_allowed"),
        F.array_join(FN.json_or_csv_array("raw"), ",").alias("products"),
        FN.valid_object_id(F.concat(F.lit("customer:"), "c_name")).alias("obj_valid_name"),
        FN.valid_object_id(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))).alias("obj_valid_key"),
        F.array_join(FN.roles_with_prefix(F.array(F.lit("team-admin"), F.col("seg"),
                                                  F.concat(F.lit("team-"), F.col("seg"))), "team-"), ",").alias("roles_prefixed"),
        FN.day_index("team-logs", F.concat(F.lit("tn"), F.col("c_nationkey").cast("string")),
                     F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("index_name"))


@binding("capability_check", sql="""
WITH holders AS (SELECT 'role:' || p_type || '#assignee' AS holder, 'capability:p' || CAST(p_partkey AS VARCHAR) AS object
                 FROM part),
assignees AS (SELECT 'user:s' || CAST(s.s_suppkey AS VARCHAR) AS "user", 'role:' || p.p_type || '#assignee' AS holder
              FROM supplier s JOIN part p ON s.s_suppkey = p.p_partkey),
req AS (SELECT DISTINCT 'user:s' || CAST(l_suppkey AS VARCHAR) AS "user",
               'capability:p' || CAST(l_partkey AS VARCHAR) AS object FROM lineitem)
SELECT r."user", r.object,
       EXISTS (SELECT 1 FROM assignees a JOIN holders h ON a.holder = h.holder
               WHERE a."user" = r."user" AND h.object = r.object) AS allowed
FROM req r
""")
def capability_check(spark, sf_dir):
    """JN14: capability granted through a role#assignee holder userset (two equi-joins)."""
    part = table(spark, sf_dir, "part")
    sup = table(spark, sf_dir, "supplier")
    holders = part.select(F.concat(F.lit("role:"), "p_type", F.lit("#assignee")).alias("user"),
                          F.lit("holder").alias("relation"),
                          F.concat(F.lit("capability:p"), F.col("p_partkey").cast("string")).alias("object"))
    assignees = sup.join(part, sup.s_suppkey == part.p_partkey).select(
        F.concat(F.lit("user:s"), F.col("s_suppkey").cast("string")).alias("user"),
        F.lit("assignee").alias("relation"), F.concat(F.lit("role:"), "p_type").alias("object"))
    reqs = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("user:s"), F.col("l_suppkey").cast("string")).alias("user"),
        F.lit("granted").alias("relation"),
        F.concat(F.lit("capability:p"), F.col("l_partkey").cast("string")).alias("object"))
    return AZ.check_capabilities(reqs, holders.unionByName(assignees))
