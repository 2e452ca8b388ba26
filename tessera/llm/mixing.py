"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target of words by water-filling: shares by weight, no
target above ``most`` times the source's size, the excess shared again.  A
source whose target is ``r`` times its size takes every document ``floor(r)``
times; the remaining words come from a Pareto sample: documents are ranked by
the odds of a uniform number divided by the odds of inclusion, and the lowest
ranks are taken until their words are nearest to what is left.

A source is ranked in ``blocks`` equal slices of its uniform numbers, so a
source with a third of all rows is spread over many tasks: only the sums of
slices meet, and the cut falls into one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .shared import cleared

WEIGHTS = (5.0, 2.0, 1.0)
WORDS = r"[^\x20\x09-\x0D]+"
LENGTH_ODDS = "1D + least(size, 1000) / 1000D"      # longer documents are likelier, up to twice from 1,000 words on


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources in code point order, NULL last, take the weights in turn.  The
    common level ``v`` (words per unit of weight) solves
    ``sum(min(most * size, v * weight)) = share * sum(size)``.  With sources
    sorted by the level that fills them, the rest divided by the weights still
    open rises while sources fill and falls after; the level is its largest value.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("full", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    sorted_ = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = sorted_.rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
                .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("level", F.max(F.col("rest") / F.col("open")).over(everything))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def uniform(seed: str) -> Column:
    """A number in (0, 1) from the document id: the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def plan_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, odds: str | None = None,
             seed: str = "mix", blocks: int = 1024) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, cut``.

    Documents of a source are taken ``whole`` times, and once more up to
    ``cut``, the (rank, doc_id, size) of the last one of the Pareto sample.
    """
    sized = docs.withColumn("size", word_count(F.col("text")))
    rows = materialize(sized.select("doc_id", "source", "size", uniform(seed).alias("u"), odds_of(odds).alias("odds")), "mix-rows")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    ratio = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    part = F.least(F.greatest(ratio - F.col("whole"), F.lit(1e-12)), F.lit(1 - 1e-12))
    goal = materialize(goal.withColumn("part_odds", part / (1 - part)), "mix-goals")
    rows = rows.join(goal.select(F.col("source").alias("s"), "part_odds", "left"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("q", rank_value())
    # slices in the order of q, of equal size where the odds are equal
    x = F.col("q") * F.col("part_odds")
    rows = rows.withColumn("b", F.least(F.floor(x / (1 + x) * blocks), F.lit(blocks - 1)).cast("int"))
    slices = rows.groupBy("source", "b").agg(F.sum("size").alias("words"))
    below = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("ss"), F.col("b").alias("sb"), F.coalesce(F.sum("words").over(below), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "b").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(slices, F.col("source").eqNullSafe(F.col("ss")) & (F.col("b") == F.col("sb")))
    # nearest cut: a document belongs to the sample if at least half of it still fits
    picked = rows.filter((F.col("size") > 0) & (F.col("before") + F.col("inside") + F.col("size") / 2.0 <= F.col("left")))
    cut = picked.groupBy(F.col("source").alias("cs")).agg(F.max(rank_key("q")).alias("cut"))
    return (goal.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
                .select("source", "source_size", "target", F.col("whole").cast("long").alias("whole"), "part_odds", "cut"))


def odds_of(odds: str | None) -> Column:
    return F.expr(odds).cast("double") if odds else F.lit(1.0)


def rank_value() -> Column:
    """Pareto rank: odds of the document's uniform number over its odds of inclusion."""
    return F.col("u") / (1 - F.col("u")) / (F.col("part_odds") * F.col("odds"))


def rank_key(q: str) -> Column:
    return F.struct(F.col(q).alias("q"), F.coalesce("doc_id", F.lit(-2**63)).alias("d"), F.col("size").alias("n"))


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, odds: str | None = None,
                seed: str = "mix", blocks: int = 1024) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies * size).

    ``odds`` is a column, or an SQL expression over ``size`` and the columns of
    ``docs``, that multiplies a document's odds of inclusion (unequal
    probabilities inside a source); by default they differ by source only.  NULL texts have size 0 and take no words; NULL is a source of its
    own, sorted last; repeated rows are documents of their own (rows alike in
    id and size go together); a computed column replaces one of the same name.
    No source gives no rows.
    """
    made = ("size", "source_size", "target", "copies", "taken", "u", "q", "whole", "part_odds", "cut", "plan_source")
    docs = cleared(docs, *[m for m in made if m != odds])
    plan = materialize(plan_mix(docs, share, most, weights, odds, seed, blocks), "mix-plan")
    kept = docs.columns
    rows = docs.withColumn("size", word_count(F.col("text"))).withColumn("u", uniform(seed))
    rows = rows.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
    rows = rows.withColumn("q", F.col("u") / (1 - F.col("u")) / (F.col("part_odds") * odds_of(odds)))
    more = (F.col("size") > 0) & F.coalesce(rank_key("q") <= F.col("cut"), F.lit(False))
    return (rows.withColumn("copies", F.least(F.col("whole") + more.cast("long"), F.lit(int(most))))
                .withColumn("taken", F.col("copies") * F.col("size"))
                .select(*kept, "size", "source_size", "target", "copies", "taken"))
