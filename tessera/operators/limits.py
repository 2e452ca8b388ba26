"""Rate limits, quotas, IP allow-lists, replay guard (AGG13-15, FIL8, FIL12, JN11, STR5, STR7).

IP allow-list matching is an **equi-join**, not a range/theta join: every
address is expanded into its candidate prefixes for the (few) prefix
lengths present in the CIDR table and joined on (family, length, prefix).
The expansion is bounded by the number of distinct prefix lengths (<= 33
for v4, <= 129 for v6), independent of the table sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.routing import MAX_CLOCK_SKEW_S, REPLAY_TTL_S
from .routing import gap_dedup


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def rate_violations(df: DataFrame, key, ts: str, window: str, slide: str | None, limit: int) -> DataFrame:
    """AGG13/AGG14/STR5: count per key per (sliding) window; keep counts above ``limit``.

    Rows are counted once per key and slide; the counts, not the rows, are then
    added up over the windows that hold them.  A hot key is a few rows a task.
    """
    key = [key] if isinstance(key, str) else list(key)
    out = [*key, "window_start", "window_end", "n"]
    if slide is None or _seconds(window) % _seconds(slide):
        w = F.window(ts, window, slide) if slide else F.window(ts, window)
        return (df.groupBy(*key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
                  .select(*key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))
    step, steps = _seconds(slide), _seconds(window) // _seconds(slide)
    part = df.groupBy(*key, F.window(ts, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    back = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")
    part = part.select(*key, F.col("w.start").alias("at"), "n", back)
    start = F.col("at") - F.make_dt_interval(secs=(F.col("k") * step).cast("decimal(18,6)"))
    total = part.select(*key, start.alias("window_start"), "n").groupBy(*key, "window_start").agg(F.sum("n").alias("n"))
    end = F.col("window_start") + F.make_dt_interval(secs=F.lit(step * steps).cast("decimal(18,6)"))
    return total.filter(F.col("n") > limit).withColumn("window_end", end).select(*out)


def quota(df: DataFrame, tenant: str, ts: str, period: str, measure: Column | None, limit: float) -> DataFrame:
    """AGG15: usage per tenant per period (``day``/``month``) vs its limit."""
    m = F.count(F.lit(1)) if measure is None else F.sum(measure)
    return (df.groupBy(tenant, F.date_trunc(period, F.col(ts)).alias("period_start"))
              .agg(m.alias("used"))
              .withColumn("over", F.col("used") > F.lit(limit)))


# ----------------------------------------------------------------- addresses

def _hex_groups_to_bits(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")


def ip_bits(ip) -> Column:
    """Address -> ``struct(family, bits)`` with bits as a '0'/'1' string (32 or 128).

    IPv6 ``::`` compression is expanded with array functions, so the whole
    conversion stays in the JVM (no Python UDF).  Malformed input -> NULL.
    """
    s = F.lower(F.trim(F.col(ip) if isinstance(ip, str) else ip))
    v4 = s.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    octets = F.split(s, r"\.")
    v4_ok = v4 & F.forall(octets, lambda o: o.cast("int") <= 255)
    v4_bits = F.array_join(F.transform(octets, lambda o: F.lpad(F.conv(o, 10, 2), 8, "0")), "")
    v6 = s.rlike(r"^[0-9a-f:]+$") & s.contains(":")
    halves = F.split(s, "::")
    left = F.when(F.get(halves, 0) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, 0), ":"))
    right = F.when((F.size(halves) < 2) | (F.get(halves, 1) == ""), F.array().cast("array<string>")) \
             .otherwise(F.split(F.get(halves, 1), ":"))
    fill = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    groups = F.when(F.size(halves) == 2, F.concat(left, fill, right)).otherwise(F.split(s, ":"))
    v6_ok = v6 & (F.size(halves) <= 2) & (F.size(groups) == 8) & F.forall(groups, lambda g: F.length(g).between(1, 4))
    return (F.when(v4_ok, F.struct(F.lit(4).alias("family"), v4_bits.alias("bits")))
            .when(v6_ok, F.struct(F.lit(6).alias("family"), _hex_groups_to_bits(groups).alias("bits"))))


def cidr_table(cidrs: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``cidr`` text -> (family, len, prefix bits)."""
    parts = F.split(F.col(cidr), "/")
    b = ip_bits(F.get(parts, 0))
    whole = F.length(b["bits"])                    # a bare address stands for itself
    ln = F.when(F.size(parts) == 1, whole).otherwise(F.expr(f"try_cast(split({cidr}, '/')[1] AS int)"))
    rows = (cidrs.select(F.col(cidr).alias("cidr"), b.alias("_b"), ln.alias("len"))
                 .filter(F.col("_b").isNotNull() & F.col("len").between(0, whole))
                 .select("cidr", F.col("_b.family").alias("family"), "len",
                         F.substring(F.col("_b.bits"), 1, F.col("len")).alias("prefix")))
    # spellings of one range ("10.1.0.0/8", "10.0.0.0/8") are one entry, shown by the first in text order
    return rows.groupBy("family", "len", "prefix").agg(F.min("cidr").alias("cidr"))


def match_cidr(df: DataFrame, ip_col: str, cidrs: DataFrame, cidr: str = "cidr") -> DataFrame:
    """FIL8/JN11: add ``matched`` and the longest matching ``matched_cidr``.

    One path at every size: each distinct address is expanded into one
    candidate per prefix length that occurs (at most 162) and equi-joined on
    (family, length, prefix); its longest hit is joined back to the rows.  AQE
    picks broadcast or shuffle at runtime.
    """
    ct = cidr_table(cidrs, cidr)
    lengths = sorted({(r["family"], r["len"]) for r in ct.select("family", "len").distinct().collect()})
    if not lengths:
        return df.withColumn("matched_cidr", F.lit(None).cast("string")).withColumn("matched", F.lit(False))
    cand = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("len")) for f, n in lengths])
    addr = df.select(F.col(ip_col).alias("_ip")).distinct().select("_ip", ip_bits(F.col("_ip")).alias("_b"))
    exp = (addr.filter(F.col("_b").isNotNull())
               .select("_ip", "_b", F.explode(F.filter(cand, lambda c: c["family"] == F.col("_b.family"))).alias("_c"))
               .select("_ip", F.col("_c.family").alias("family"), F.col("_c.len").alias("len"),
                       F.substring(F.col("_b.bits"), 1, F.col("_c.len")).alias("prefix")))
    hits = exp.join(ct, ["family", "len", "prefix"]).groupBy("_ip").agg(F.max_by("cidr", "len").alias("matched_cidr"))
    return (df.join(hits, F.col(ip_col) == F.col("_ip"), "left").drop("_ip")
              .withColumn("matched", F.col("matched_cidr").isNotNull()))


def replay_guard(df: DataFrame, key: str, nonce: str, sent: str, received: str, id_col: str,
                 skew_s: int = MAX_CLOCK_SKEW_S, ttl_s: int = REPLAY_TTL_S) -> DataFrame:
    """FIL12 + STR7: reject stale messages (|received - sent| > skew) and replays
    of a (key, nonce) seen within the TTL.  Stale messages never register
    their nonce (checked first), replays are detected among fresh ones."""
    diff = F.abs(F.unix_micros(F.col(received).cast("timestamp")) - F.unix_micros(F.col(sent).cast("timestamp")))
    d = df.withColumn("fresh", diff <= skew_s * 1000000)
    fresh = gap_dedup(d.filter("fresh"), [key, nonce], received, ttl_s, tiebreak=[id_col])
    stale = d.filter(~F.col("fresh")).withColumn("is_duplicate", F.lit(None).cast("boolean"))
    out = fresh.unionByName(stale)
    return (out.withColumnRenamed("is_duplicate", "replay")
               .withColumn("accepted", F.col("fresh") & ~F.coalesce(F.col("replay"), F.lit(False))))
