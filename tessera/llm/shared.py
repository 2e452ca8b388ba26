"""Spark helpers of the training-data operators: bitmaps, written tables, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BITS = 26                                        # 2**26 bits: 8 MB, whatever the data


def cleared(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns called like a computed one (which replaces them)."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def short_batches(spark, rows: int = 1024) -> None:
    """Fewer rows per Arrow batch: whole texts are long, and a batch of them stands in memory several times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bitmap(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A fixed-size bit table of the top ``bits`` bits of a 64-bit hash column.

    Bits are OR-ed by Spark into 4 KB blocks, so the driver receives at most
    ``2**bits / 8`` bytes at any input size.  A hash whose bit is unset is
    certainly absent; a set bit may be shared by several hashes.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    blocks = (values.select((F.floor(slot / 32768)).cast("int").alias("b"), (slot % 32768).alias("p"))
                    .groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("m")))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in blocks.collect():
        out[r["b"] * 4096:(r["b"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def has_bit(table: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(v, root)``: the smallest vertex reachable from every vertex that has an edge.

    Alternates large-star and small-star steps on the edge table ``(a, b)``;
    each needs one partial minimum per vertex and one join, so a hub costs a
    row per task.  Every step is written to the shared folder, which cuts the
    lineage; the loop ends when the table stops changing.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        state = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
