"""Sharding by histogram sort: exact byte counts below probes, one exchange.

Documents are ordered by (hash of the text, doc_id), so equal texts stand
together.  The splitters between shards are found by rounds of probes: each
round counts, over all partitions, the exact bytes below a set of candidate
boundaries, and narrows the bracket of every splitter, until the best
candidate is within tolerance.  Only probes and counts (some hundred numbers)
reach the driver.  Rows then move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .shared import cleared

LOW, HIGH = -2**63, 2**63 - 1


def _below(key: tuple) -> Column:
    h, d = key
    return (F.col("_h") < F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col("_d") < F.lit(d)))


def _bucket(cuts: list[tuple], first: int = 0) -> Column:
    """How many of the sorted ``cuts`` are not above a row's key, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(_below(cuts[mid]), _bucket(cuts[:mid], first)).otherwise(_bucket(cuts[mid + 1:], first + mid + 1))


def _between(lo: tuple, hi: tuple, probes: int, least: int, most: int) -> list[tuple]:
    """Evenly spaced candidates strictly between two keys: over hashes, or over ids (least to most) within one hash."""
    (h0, d0), (h1, d1) = lo, hi
    if h1 - h0 > 1:
        inner = {h0 + (h1 - h0) * k // (probes + 1) for k in range(1, probes + 1)} - {h0}
        return sorted((h, LOW) for h in inner)
    if h1 > h0:                                  # the splitter stands inside the texts of hash h0
        if d1 > LOW:
            return [(h1, LOW)]
        d1 = HIGH
    d0, d1 = max(d0, least), min(d1, most + 1)
    inner = {d0 + (d1 - d0) * k // (probes + 1) for k in range(1, probes + 1)} - {d0}
    return sorted((h0, d) for d in inner | ({d1 - 1, d0 + 1} if d1 - d0 <= probes else set()) if d0 < d < d1)


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 24, rounds: int = 40) -> list[tuple]:
    """``shards - 1`` keys so that the bytes below the k-th are near ``k / shards`` of all.

    ``keys``: ``_h`` (hash), ``_d`` (id), ``size``.  A splitter is settled once
    its bytes are within ``tolerance`` of a shard's share, or no key is left
    between its bracket's ends (one document is larger than that).
    """
    total, rows, least, most = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.min("_d"), F.lit(0)),
                                        F.coalesce(F.max("_d"), F.lit(0))).first()
    goals = [total * k / shards for k in range(1, shards)]
    ends = [((LOW, LOW), 0, (HIGH, HIGH), rows) for _ in goals]          # bracket: key, rows below it
    best = [min(((LOW, LOW), 0), ((HIGH, HIGH), total), key=lambda x, g=g: abs(x[1] - g)) for g in goals]
    slack = tolerance * total / shards
    for _ in range(rounds):
        asked: set[tuple] = set()
        for (lo, below, hi, above), (_, n), g in zip(ends, best, goals):
            if abs(n - g) > slack and above - below > 1:
                asked |= set(_between(lo, hi, probes, least, most))
        if not asked:
            break
        cuts = sorted(asked)
        counts = {r["b"]: (r["n"], r["c"]) for r in keys.groupBy(_bucket(cuts).alias("b")).agg(
            F.sum("size").alias("n"), F.count(F.lit(1)).alias("c")).collect()}
        known, n, c = [], 0, 0
        for b, cut in enumerate(cuts):
            n, c = n + counts.get(b, (0, 0))[0], c + counts.get(b, (0, 0))[1]
            known.append((cut, n, c))
        for i, g in enumerate(goals):
            lo, below, hi, above = ends[i]
            for cut, n, rows in known:
                if ends[i][0] < cut < ends[i][2]:
                    if abs(n - g) < abs(best[i][1] - g):
                        best[i] = (cut, n)
                    if n <= g:
                        lo, below = cut, rows
                    else:
                        hi, above = cut, rows
                        break
            ends[i] = (lo, below, hi, above)
    return sorted(cut for cut, _ in best)


def shard_by_bytes(docs: DataFrame, shards: int = 8, blocks: int = 64, tolerance: float = 0.001) -> DataFrame:
    """``docs`` plus ``size``, ``text_crc32``, ``shard`` and ``slot``; shards hold near equal bytes.

    ``size`` is the UTF-8 bytes of the text plus 1 (1 for NULL).  Equal texts
    are neighbours in the order, so a group of copies is cut only where a
    splitter falls into it.  ``slot`` counts from 0 in each shard without gaps;
    it is numbered in ``blocks`` blocks a shard, so no task holds a whole
    shard.  Every row stays, repeated rows too; a NULL doc_id sorts first;
    other columns are carried, but a computed column
    replaces one of the same name.  An empty table gives no rows.
    """
    docs = cleared(docs, "size", "text_crc32", "shard", "slot", "_h", "_d", "_b", "_i", "_from")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("*", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_h"),
                       F.coalesce(F.col("doc_id"), F.lit(LOW)).alias("_d"))
    keys = materialize(rows.select("_h", "_d", "size"), "shard-keys")
    cuts = splitters(keys, shards, tolerance)
    shard = _bucket(cuts).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("_b", F.pmod(F.xxhash64("_d", F.lit(11)), F.lit(blocks)))
    sizes = (keys.withColumn("shard", shard).withColumn("_b", F.pmod(F.xxhash64("_d", F.lit(11)), F.lit(blocks)))
                 .groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    inner = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_h", "_d", "text_crc32", "size"))
    # at most shards * blocks rows: a bound that no input changes
    numbered = rows.withColumn("_i", inner - 1).join(F.broadcast(starts), ["shard", "_b"])
    return numbered.select(*docs.columns, "size", "text_crc32", "shard", (F.col("_from") + F.col("_i")).cast("long").alias("slot"))
