"""Sign-in resolution over a login table (FIL9-11, JN10, FN4-9, FN17).

The per-login decision chain is an ordered ``when`` chain and the group to
role mapping uses array/map functions on each row, so a sign-in log of any
size is one Project with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import domain_allowed, first_nonempty, json_or_csv_array, json_strings

# ---------------------------------------------------------------------------
# Strategies and denial messages.
# ---------------------------------------------------------------------------
SOCIAL_STRATEGIES = ("google-oauth2", "github", "facebook", "linkedin", "twitter", "apple", "windowslive")
SKIP_STRATEGIES = ("auth0", "email")
DENY_SOCIAL = "Social sign-in is not available for this workspace."
DENY_DISABLED = "your Axira account is disabled — contact your admin to re-enable you"
DENY_NOT_SET_UP = "your workspace is not finished setting up — ask your admin to complete Identity setup"
DENY_NOT_PROVISIONED = "not provisioned in Axira — ask your admin to provision you in Identity setup"
CLAIM_NAMESPACE = "https://axira.ai/"
# ---------------------------------------------------------------------------

LOGIN_SCHEMA = ("login_id string, strategy string, connection string, conn_tenant_id string, "
                "conn_group_role_map string, conn_default_role string, conn_portal_type string, email string, "
                "groups array<string>, app_tenant_id string, app_roles array<string>, app_portal_type string, "
                "app_disabled boolean, aaid string")


def map_groups_to_roles(groups: Column, map_json: Column) -> Column:
    """JN10: IdP groups -> roles through a JSON map, case-insensitive, de-duplicated in order.

    Keys are compared lower-cased; if two keys collide after lower-casing
    the later one wins.  A malformed or non-object map, a missing map, an
    empty or non-array groups value all give ``[]``.
    """
    m = F.from_json(map_json, "map<string, string>")          # values as JSON text: one bad value spoils no other
    entries = F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))),
                          lambda e: F.struct(F.lower(e["key"]).alias("k"),
                                             F.coalesce(json_strings(e["value"]), F.array().cast("array<string>")).alias("v")))
    empty = F.array().cast("array<string>")
    per_group = F.transform(
        F.coalesce(groups, empty),
        lambda g: F.coalesce(F.try_element_at(F.filter(entries, lambda e: (e["k"] == F.lower(g)) & (g != "")), F.lit(-1))["v"],
                             empty))
    roles = F.filter(F.flatten(per_group), lambda r: r.isNotNull() & (r != ""))
    return F.when(map_json.isNull() | (map_json == "") | m.isNull(), empty).otherwise(F.array_distinct(roles))


def resolve_login(logins: DataFrame, social_enabled: bool = False, allowed_domains_csv: str | None = None) -> DataFrame:
    """FIL10/FIL11 + FN7/FN8/FN9: outcome, deny reason, tenant, roles, portal type.

    Order: social gate -> skip native/passwordless -> disabled -> tenant
    (app metadata, then connection) -> roles (per-user, then group map,
    then connection default) -> portal type.  Optional FIL9 domain lock.
    """
    strategy = F.coalesce(F.col("strategy"), F.lit(""))
    empty = F.array().cast("array<string>")
    tenant = first_nonempty("app_tenant_id", "conn_tenant_id")
    app_roles = F.coalesce(F.col("app_roles"), empty)
    mapped = map_groups_to_roles(F.col("groups"), F.col("conn_group_role_map"))
    default_role = F.nullif(F.col("conn_default_role"), F.lit(""))
    roles = (F.when(F.size(app_roles) > 0, app_roles)
             .when(F.size(mapped) > 0, mapped)
             .when(default_role.isNotNull(), F.array(default_role))
             .otherwise(empty))
    social = strategy.isin(*SOCIAL_STRATEGIES)
    deny_reason = (F.when(social & F.lit(not social_enabled), F.lit(DENY_SOCIAL))
                   .when(social | strategy.isin(*SKIP_STRATEGIES), F.lit(None))
                   .when(F.coalesce(F.col("app_disabled"), F.lit(False)), F.lit(DENY_DISABLED))
                   .when(tenant.isNull(), F.lit(DENY_NOT_SET_UP))
                   .when((F.size(roles) == 0) & default_role.isNull(), F.lit(DENY_NOT_SET_UP))
                   .when(F.size(roles) == 0, F.lit(DENY_NOT_PROVISIONED)))
    outcome = (F.when(deny_reason.isNotNull(), F.lit("deny"))
               .when(social | strategy.isin(*SKIP_STRATEGIES), F.lit("skip"))
               .otherwise(F.lit("allow")))
    allowed = outcome == "allow"
    out = logins.select(
        "*", outcome.alias("outcome"), deny_reason.alias("deny_reason"),
        F.when(allowed, tenant).alias("tenant_id"),
        F.when(allowed, roles).alias("roles"),
        F.when(allowed, first_nonempty("app_portal_type", "conn_portal_type")).alias("portal_type"),
        F.when(allowed, F.nullif(F.col("aaid"), F.lit(""))).alias("member_id"))
    if allowed_domains_csv is not None:
        out = out.withColumn("domain_allowed", domain_allowed(F.col("email"), F.lit(allowed_domains_csv)))
    return out


CLAIMS_SCHEMA = ("login_id string, strategy string, org_id string, org_display_name string, org_tenant_id string, "
                 "org_products string, org_roles array<string>, user_id string, email string, app_tenant_id string, "
                 "app_org_display_name string, app_roles array<string>, app_portal_type string, "
                 "app_portal_entity_id string, aaid string")
CLAIMS = ("tenant_id", "tenant_name", "aaid", "roles", "portal_type", "portal_entity_id", "products", "email_domain")


def login_claims(logins: DataFrame, default_products: str | None = None) -> DataFrame:
    """FN6-FN9 for the logins that are not federated (database and passwordless).

    ``outcome`` is ``skip`` for the social strategies and for logins without
    any tenant, else ``allow`` with the claim columns set.  Tenant:
    organisation metadata, organisation id, app metadata.  Roles: the
    organisation's, else app metadata's.  Products: the organisation's JSON
    array (an empty one counts), else the deployment's list, else none.
    """
    c, empty = F.col, F.array().cast("array<string>")
    in_org = c("org_id").isNotNull()
    tenant = first_nonempty(F.when(in_org, F.coalesce("org_tenant_id", "org_id")), "app_tenant_id")
    roles = F.when(F.size(F.coalesce("org_roles", empty)) > 0, c("org_roles")).otherwise(F.coalesce("app_roles", empty))
    products = F.coalesce(F.when(in_org, json_strings("org_products")), json_or_csv_array(F.lit(default_products).cast("string")))
    values = {"tenant_id": tenant, "tenant_name": first_nonempty(F.when(in_org, c("org_display_name")), "app_org_display_name"),
              "aaid": F.coalesce("aaid", "user_id"), "roles": roles, "portal_type": first_nonempty("app_portal_type"),
              "portal_entity_id": first_nonempty("app_portal_entity_id"), "products": products,
              "email_domain": F.when(c("email").contains("@"), F.get(F.split("email", "@"), 1))}
    skip = F.coalesce(c("strategy").isin(*SOCIAL_STRATEGIES), F.lit(False)) | tenant.isNull()
    return logins.select("login_id", F.when(skip, "skip").otherwise("allow").alias("outcome"),
                         *[F.when(~skip, values[n]).alias(n) for n in CLAIMS])


def claims(resolved: DataFrame, namespace: str = CLAIM_NAMESPACE) -> DataFrame:
    """Namespaced token claims of the allowed logins, of either kind (a map column, lists as JSON)."""
    have = [n for n in CLAIMS if n in resolved.columns]
    lists = {f.name for f in resolved.schema.fields if f.dataType.typeName() == "array"}
    pairs = [x for n in have for x in (F.lit(namespace + n), F.to_json(n) if n in lists else F.col(n))]
    m = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return resolved.filter(F.col("outcome") == "allow").select("login_id", m.alias("claims"))
