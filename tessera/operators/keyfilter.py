"""Blocked Bloom filters kept as tables (JN1, WIN1): may a stored set hold a key?

A filter is a set of rows, one per 256-bit block: eight words of 32 bits, in
each of which a key sets one bit.  Built with ``bit_or`` (a partial aggregate),
probed by an equi-join on the block number, all with SQL functions.  A key that
was stored always passes; one that was not passes now and then, so whoever asks
follows up with an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(8)]
KEYS_PER_BLOCK = 4                  # 256 bits for 2 to 4 keys: less than one false hit in ten million probes
MAX_BITS = 24                       # blocks of one filter: at most 2**24, which fuller ones share (more false hits, no lost key)


def sized_bits(n_keys: int) -> int:
    """log2 of the number of blocks for ``n_keys`` keys."""
    return min(max(n_keys // KEYS_PER_BLOCK, 1).bit_length(), MAX_BITS)


def _block(key: Column, bits: Column) -> Column:
    # The leading bits, so one hash serves filters of every size.
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit("block"), key), F.lit(64) - bits)


def _mark(i: int) -> Column:
    return F.expr(f"shiftleft(1, cast(shiftrightunsigned(_marks, {5 * i}) & 31 as int))")


def filter_rows(rows: DataFrame, key: str, bits: int, by: tuple = ()) -> DataFrame:
    """``*by, block, w0 .. w7``: the filter (one per value of ``by``) of the keys of ``rows``; NULL keys are left out."""
    known = rows.filter(F.col(key).isNotNull())
    marked = known.select(*by, _block(F.col(key), F.lit(bits)).alias("block"), F.xxhash64(F.lit("marks"), key).alias("_marks"))
    return marked.select(*by, "block", *(_mark(i).alias(w) for i, w in enumerate(WORDS))).groupBy(*by, "block").agg(
        *(F.bit_or(w).alias(w) for w in WORDS))


def may_hold(keys: DataFrame, key: str, filters: DataFrame, on: tuple = (), bits: int | None = None) -> DataFrame:
    """``keys`` joined with the filters that may hold them.

    ``filters``: ``block, w0 .. w7``, the columns ``on`` that keys must share with
    a filter, and whatever else describes it.  Without ``bits`` every filter
    states its own size in a column ``bits`` that ``keys`` has too.
    """
    size = F.col("bits") if bits is None else F.lit(bits)
    asked = keys.select("*", _block(F.col(key), size).alias("block"), F.xxhash64(F.lit("marks"), key).alias("_marks"))
    asked = asked.select(*keys.columns, "block", *(_mark(i).alias(f"_m{i}") for i in range(8)))
    shared = [*on, "block"] + ([] if bits is not None else ["bits"])
    all_set = " AND ".join(f"{w} & _m{i} = _m{i}" for i, w in enumerate(WORDS))
    return asked.join(filters, shared).filter(all_set).drop("block", *WORDS, *(f"_m{i}" for i in range(8)))
