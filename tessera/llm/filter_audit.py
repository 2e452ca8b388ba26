"""Filter interaction audit: what each filter of a chain removes, in every order, and its fair share.

Every document becomes one bit mask of the filters it fails.  Masks are
counted per part, so all that follows works on at most ``2**k`` numbers a
part, whatever the number of documents:

- The removal game: the worth ``v(S)`` of a coalition of filters is the number
  of documents that at least one of them removes.
- Hart-Mas-Colell potential: ``P(S) = (v(S) + sum of P(S without i)) / |S|``,
  computed recursively over the coalitions.  A filter's Shapley value is
  ``P(all) - P(all without it)``.  The recursion runs on ``|S|! * P(S)``, which
  is a whole number: ``(|S|-1)! * v(S) + sum of (|S|-1)! * P(S without i)``.
- Steps of an order are coalition differences: the filter at a step removes
  ``v(before and it) - v(before)``.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The maximal runs without white space, case-sensitive."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def text_failures(docs: DataFrame) -> DataFrame:
    """``docs`` plus the failure conditions ``A`` to ``D`` of a text (NULL is empty) and its ``text_key``.

    A: under 200 words; B: under half of the words distinct; C: over 2 % of the
    code points are capitals A-Z; D: holds one of ``#$%&*|``.
    """
    t = F.coalesce("text", F.lit(""))
    some = docs.select("*", words(t).alias("_words"))
    some = some.select("*", F.size("_words").alias("_n"), F.size(F.array_distinct("_words")).alias("_distinct")).drop("_words")
    capitals = F.char_length(F.regexp_replace(t, "[^A-Z]+", ""))
    return some.select(*docs.columns,
                       (F.col("_n") < 200).alias("A"), (100 * F.col("_distinct") < 50 * F.col("_n")).alias("B"),
                       (100 * capitals > 2 * F.char_length(t)).alias("C"), t.rlike("[#$%&*|]").alias("D"),
                       F.unhex(F.sha2(t, 256)).alias("text_key"))


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``E``: a smaller doc_id has the same text.  A row without a doc_id never fails it.

    The smallest doc_id of every text is a partial minimum; rows are matched to
    it by (doc_id, text), so a text that a third of all rows share is no hot key.
    """
    first = (rows.filter("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
                 .select("doc_id", "text_key", F.lit(True).alias("_first")))
    joined = rows.join(first, ["doc_id", "text_key"], "left")
    return joined.select(*rows.columns, (F.col("doc_id").isNotNull() & F.col("_first").isNull()).alias("E"))


def mask_counts(rows: DataFrame, filters: list[str], measures: list[str]) -> DataFrame:
    """``part, cells``: per part the list of (mask, n, measures...), one entry per mask that occurs."""
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    sums = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in measures)]
    counted = rows.withColumn("mask", mask).groupBy("part", "mask").agg(*sums)
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *measures)).alias("cells"))


def _worth(measure: str, k: int) -> Column:
    """v(S) for all coalitions S: documents (of the measure) that fail any filter of S."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda s: F.aggregate(
        "cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["mask"].bitwiseAND(s) != 0, c[measure]).otherwise(0)))


def _potential(k: int) -> Column:
    """``|S|! * P(S)`` for all coalitions S, from ``v``; subsets come first as S counts up."""
    factorial = F.array(*(F.lit(math.factorial(i)).cast("long") for i in range(k)))

    def extend(done, s):
        without = [F.when(s.bitwiseAND(1 << i) != 0, F.get(done, s.bitwiseXOR(1 << i))).otherwise(0) for i in range(k)]
        own = F.get(factorial, F.bit_count(s) - 1) * F.get(F.col("v_n"), s)
        return F.concat(done, F.array(sum(without, own)))
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.array(F.lit(0).cast("long")), extend)


def audit_masks(cells: DataFrame, filters: list[str], measures: dict[str, str]) -> DataFrame:
    """All orders and steps of every part, from ``part, cells`` (see ``mask_counts``).

    ``measures`` maps a measure to the output column that counts what a step loses of it.
    """
    k = len(filters)
    full = (1 << k) - 1
    worth = cells.select("part", F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + c["n"]).alias("total"),
                         *(_worth(m, k).alias(f"v_{m}") for m in ("n", *measures)))
    game = worth.withColumn("potential", _potential(k))
    orders = F.array(*(F.array(*map(F.lit, o)) for o in itertools.permutations(range(k))))
    rows = game.withColumn("ordered", F.explode(orders))
    rows = rows.select("*", F.posexplode("ordered").alias("pos", "i"))
    rows = rows.withColumn("before", F.expr("aggregate(slice(ordered, 1, pos), 0, (a, b) -> a | shiftleft(1, b))"))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, i)"))
    names = F.array(*map(F.lit, filters))

    def v(m, s):
        return F.get(F.col(f"v_{m}"), s)
    before, after, bit = F.col("before"), F.col("before").bitwiseOR(F.col("bit")), F.col("bit")
    removed = v("n", after) - v("n", before)
    return rows.select(
        "part", F.array_join(F.transform("ordered", lambda i: F.get(names, i)), "").alias("filter_order"),
        (F.col("pos") + 1).cast("int").alias("step"),
        (F.col("total") - v("n", after)).alias("kept"), removed.alias("removed"), (v("n", bit) - removed).alias("redundant"),
        (v("n", F.lit(full)) - v("n", F.lit(full).bitwiseXOR(bit))).alias("unique_fails"),
        *((v(m, after) - v(m, before)).alias(name) for m, name in measures.items()),
        (F.get("potential", F.lit(full)) - k * F.get("potential", F.lit(full).bitwiseXOR(bit))).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E per source: a row per part, order of the filters and step.

    ``part``: the source (NULL: empty string, counted together with it).  Labels
    of a doc_id that repeats count as set where any row sets them.  A document
    without a doc_id has no label and never fails E; repeated rows count each,
    and neither makes the other a repeat (their doc_id is no smaller).  Other
    columns are ignored.  Without documents there is no part and no row.
    """
    docs = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    rows = text_failures(docs).drop("text").groupBy("doc_id", "part", "text_key", "A", "B", "C", "D").agg(F.count(F.lit(1)).alias("n"))
    rows = repeats(materialize(rows, "failures"))
    flags = (labels.filter("doc_id IS NOT NULL").groupBy("doc_id")
                   .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    # Rows without a doc_id get a key of their own each, so they do not meet in one task.
    named = rows.select("*", F.coalesce("doc_id", F.xxhash64("text_key", "part")).alias("_k"), F.col("doc_id").isNotNull().alias("_named")).drop("doc_id")
    labelled = named.join(flags.select(F.col("doc_id").alias("_k"), F.lit(True).alias("_named"), "good", "toxic"), ["_k", "_named"], "left")
    cells = mask_counts(labelled, list("ABCDE"), ["good", "toxic"])
    return audit_masks(cells, list("ABCDE"), {"good": "good_lost", "toxic": "toxic_lost"})
