"""Column helpers.  All JVM-side, codegen-friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hour_key(event_type, ts) -> Column:
    """FN2: ``event_type=X/year=YYYY/month=MM/day=DD/hour=HH/`` (UTC)."""
    ts = _c(ts)
    return F.concat(F.lit("event_type="), _c(event_type),
                    F.date_format(ts, "'/year='yyyy'/month='MM'/day='dd'/hour='HH'/'"))


def minus_hours(ts, hours: int) -> Column:
    """FN16: ``ts - INTERVAL n HOURS``."""
    return _c(ts) - F.expr(f"INTERVAL {int(hours)} HOURS")


def day_index(prefix: str, tenant, ts) -> Column:
    """FN15: ``<prefix>-<tenant>-yyyy.MM.dd`` (tenant/day index name)."""
    return F.concat_ws("-", F.lit(prefix), _c(tenant), F.date_format(_c(ts), "yyyy.MM.dd"))


def parse_domains(csv) -> Column:
    """FN4: split on ',', trim, lower-case, strip one leading '@', drop empties."""
    items = F.transform(F.split(F.coalesce(_c(csv), F.lit("")), ","),
                        lambda x: F.regexp_replace(F.lower(F.trim(x)), "^@", ""))
    return F.filter(items, lambda x: x != "")


def email_domain(email, mode: str = "last") -> Column:
    """FN5: domain after the **last** '@' (lock) or the second '@'-part (claims)."""
    e = F.lower(F.trim(_c(email)))
    if mode == "last":
        return F.when(e.contains("@"), F.substring_index(e, "@", -1))
    return F.get(F.split(e, "@"), 1)


def domain_allowed(email, allowed_csv) -> Column:
    """FIL9: allowed when the list is empty (inert) or contains the domain."""
    allowed = parse_domains(allowed_csv)
    return F.when(F.size(allowed) == 0, F.lit(True)).otherwise(
        F.coalesce(F.array_contains(allowed, email_domain(email, "last")), F.lit(False)))


def json_strings(text) -> Column:
    """The string elements of a JSON array text, in order; NULL if the text is no JSON array."""
    parts = F.from_json(_c(text), "array<variant>")
    strings = F.filter(parts, lambda x: F.schema_of_variant(x) == "STRING")
    return F.when(F.trim(_c(text)).startswith("["), F.transform(strings, lambda x: F.try_variant_get(x, "$", "string")))


def json_or_csv_array(text) -> Column:
    """FN6: the strings of a JSON array if it parses as one, else CSV."""
    t = _c(text)
    csv = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    return (F.when(t.isNull() | (F.trim(t) == ""), F.array().cast("array<string>"))
            .otherwise(F.coalesce(json_strings(t), csv)))


def first_nonempty_array(*arrays) -> Column:
    """FN6/FN9: the first source whose list is non-empty (a bad or empty source
    falls through to the next); ``[]`` when none has items."""
    out = F.array().cast("array<string>")
    for a in reversed(arrays):
        a = _c(a)
        out = F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(out)
    return out


def first_nonempty(*cols) -> Column:
    """FN7/FN9: precedence chain, empty strings count as absent."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def roles_with_prefix(roles, prefix: str) -> Column:
    """FN17: keep roles starting with ``prefix``."""
    return F.filter(_c(roles), lambda r: r.startswith(prefix))


# Object ids may not carry the structural separators ':', '#', '@' inside a part.
VALID_OBJECT_RE = "^[^:#@]+:[^:#@]+$"


def valid_object_id(obj) -> Column:
    """FN18: ``type:id`` with no separator inside either part."""
    return _c(obj).rlike(VALID_OBJECT_RE)


def round_half_up(x, places: int = 2) -> Column:
    """``Math.round(x * 10^p) / 10^p`` (half rounds towards +infinity)."""
    s = 10 ** places
    return F.floor(_c(x) * s + 0.5) / s


def lookup(mapping: dict, key, default=None) -> Column:
    """FN10-12: small fixed map literal with a default (compiled into the plan)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.try_element_at(m, _c(key))
    return F.coalesce(out, F.lit(default)) if default is not None else out


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "F")]
