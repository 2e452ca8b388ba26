"""Source divergence audit: how far the sources of a language differ in their terms.

Iceberg prefix refinement finds the vocabulary without counting every term that
ever occurs.  A prefix stands in at least as many documents as any term that
begins with it, so the texts are read level by level (prefixes of 4, then of 8
bytes): prefixes that too few documents hold are discarded, and the next level
only counts what extends a prefix that is left.  What the last level leaves is
counted as complete terms, exactly.  Prefixes left stand in a bit table of
fixed size; where it is full, more terms are counted, never fewer.

Counts are added up inside a task (up to a fixed number of keys at a time) and
then per key, so a term that stands in every document costs a row a task.  The divergence of each pair of
sources is summed in cells (a block of sources, another block, a slice of the
terms), whose size does not grow with the data.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .shared import bitmap, has_bit, short_batches
from .textkit import LOWER, mix64, pieces, _powers

LEVELS = (4, 8)
AT_LEAST = 3                                     # documents that hold a kept term
SCALE = 1_000_000_000
TOP = 200
BLOCK = 64                                       # sources a cell holds on each side, about
CELL = 100_000                                   # term counts a cell holds on each side, about
PIECE = 2 << 20
HELD = 1_000_000                                 # keys a task holds before it adds them up and passes them on

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@contextlib.contextmanager
def few_rows_a_batch(spark):
    """Short Arrow batches for the jobs run inside; the caller's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    short_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def term_spans(data: np.ndarray, off: np.ndarray):
    """Byte starts and ends of the terms (runs of ASCII letters and non-ASCII bytes) and each term's row."""
    inside = LETTER[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[off] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[off] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def grouped(keys: np.ndarray):
    """The distinct keys, a place of each, and the number of its key at every place (``np.unique`` sorts slowly where it gives first places)."""
    found, code = np.unique(keys, return_inverse=True)
    at = np.empty(len(found), np.int64)
    at[code] = np.arange(len(keys))
    return found, at, code


def documents(code: np.ndarray, rows: np.ndarray, n_rows: int, n_codes: int) -> np.ndarray:
    """Of every code, in how many distinct rows it stands."""
    pairs = np.sort(code.astype(np.int64) * n_rows + rows)
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    return np.bincount(pairs[first] // n_rows, minlength=n_codes)


class Held:
    """Rows of a 64-bit key, sums and names, added up per key once ``HELD`` of them are there."""

    def __init__(self, names: list[str], sums: list[str]):
        self.columns, self.n_names = [*names, *sums], len(names)
        self.keys, self.rows, self.size = [], [], 0

    def add(self, keys: np.ndarray, rows: list) -> None:
        self.keys.append(keys)
        self.rows.append([x if isinstance(x, pa.Array) else np.asarray(x, np.int64) for x in rows])
        self.size += len(keys)

    def batch(self) -> pa.RecordBatch:
        """What is held, one row per key; then nothing is held."""
        _, at, code = grouped(np.concatenate(self.keys))
        parts = list(zip(*self.rows))
        names = [pa.concat_arrays(p).take(pa.array(at)) for p in parts[:self.n_names]]
        sums = [pa.array(np.bincount(code, np.concatenate(p), len(at)).astype(np.int64)) for p in parts[self.n_names:]]
        self.keys, self.rows, self.size = [], [], 0
        return pa.record_batch([*names, *sums], names=self.columns)


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    where = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[where].tobytes()))


class Hasher:
    """64-bit hashes of the terms of one piece, or of their first bytes, together with their row's group."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        up, self.down = _powers(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.total[1:])
        self.starts, self.ends = starts, ends

    def prefixes(self, length: int, group: np.ndarray) -> np.ndarray:
        """A term shorter than ``length`` is marked complete: it is no prefix of a longer one."""
        stop = np.minimum(self.ends, self.starts + length)
        h = (self.total[stop] - self.total[self.starts]) * self.down[self.starts]
        done = (self.ends - self.starts < length).astype(np.uint64)
        return mix64(mix64(h + done) ^ group)

    def terms(self, group: np.ndarray) -> np.ndarray:
        h = (self.total[self.ends] - self.total[self.starts]) * self.down[self.starts]
        return mix64(mix64(h + (self.ends - self.starts).astype(np.uint64)) ^ group)


def name_hash(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of every name, the same in all tasks."""
    import hashlib
    codes = names.dictionary_encode()
    of = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little")
                   for n in codes.dictionary.to_pylist()], np.uint64)
    return of[codes.indices.to_numpy()] if len(of) else np.zeros(len(names), np.uint64)


def prefix_counts(texts: DataFrame, length: int, before: tuple | None) -> DataFrame:
    """``token, n``: a (language, prefix) hash and its distinct documents, added up inside a task.

    ``before``: the length and broadcast bit table of the level above, whose
    discarded prefixes are not extended.
    """
    def run(batches):
        held = Held(["token"], ["n"])
        for b in batches:
            langs = name_hash(b.column("lang"))
            for first, off, data in pieces(b.column("text"), PIECE):
                starts, ends, rows = term_spans(data, off)
                if not len(starts):
                    continue
                hasher = Hasher(data, starts, ends)
                if before is not None:
                    left = has_bit(before[1].value, hasher.prefixes(before[0], langs[first + rows]))
                    hasher.starts, hasher.ends, rows = starts[left], ends[left], rows[left]
                token = hasher.prefixes(length, langs[first + rows])
                found, code = np.unique(token, return_inverse=True)
                n = documents(code, rows, len(off) - 1, len(found))
                held.add(found, [pa.array(found.view(np.int64)), n])
                if held.size > HELD:
                    yield held.batch()
        if held.size:
            yield held.batch()
    return texts.select("lang", "text").mapInArrow(run, "token long, n long")


def term_counts(texts: DataFrame, last: tuple) -> DataFrame:
    """``lang, source, term, docs, n`` of the terms whose last prefix is left, added up inside a task."""
    def run(batches):
        held = Held(["lang", "source", "term"], ["docs", "n"])
        for b in batches:
            langs, sources = b.column("lang"), b.column("source")
            of_lang, of_both = name_hash(langs), name_hash(langs) * np.uint64(3) + name_hash(sources)
            for first, off, data in pieces(b.column("text"), PIECE):
                starts, ends, rows = term_spans(data, off)
                if not len(starts):
                    continue
                hasher = Hasher(data, starts, ends)
                left = has_bit(last[1].value, hasher.prefixes(last[0], of_lang[first + rows]))
                hasher.starts, hasher.ends, rows = starts[left], ends[left], rows[left]
                token = hasher.terms(mix64(of_both[first + rows]))
                found, at, code = grouped(token)
                n = np.bincount(code, minlength=len(at))
                docs = documents(code, rows, len(off) - 1, len(at))
                where = pa.array(first + rows[at])
                terms = slices(LOWER[data], hasher.starts[at], hasher.ends[at])
                held.add(found, [langs.take(where), sources.take(where), terms, docs, n])
                if held.size > HELD:
                    yield held.batch()
        if held.size:
            yield held.batch()
    return texts.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, docs long, n long")


def frequent_terms(texts: DataFrame, at_least: int = AT_LEAST, levels: tuple = LEVELS) -> DataFrame:
    """``lang, source, term, n``: counts of the terms that at least ``at_least`` documents of the language hold.

    And of each term, alike in all its rows: ``lang_n`` its count in the
    language, ``term_id`` a number of its own; ``head`` marks one of its rows.
    """
    spark, above = texts.sparkSession, None
    with few_rows_a_batch(spark):
        for length in levels:
            counted = prefix_counts(texts, length, above).groupBy("token").agg(F.sum("n").alias("n"))
            left = bitmap(counted.filter(F.col("n") >= at_least), "token")
            above = (length, spark.sparkContext.broadcast(left))
        # Added up per task already: one exchange by term serves the sums and the window.
        dealt = term_counts(texts, above).repartition("lang", "term")
        counts = dealt.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        of_term = Window.partitionBy("lang", "term")                        # at most a row a source
        rows = counts.withColumn("_row", F.monotonically_increasing_id())
        rows = rows.select("*", F.sum("docs").over(of_term).alias("_docs"), F.sum("n").over(of_term).alias("lang_n"), F.min("_row").over(of_term).alias("term_id"))
        kept = rows.filter(F.col("_docs") >= at_least).select("lang", "source", "term", "n", "lang_n", "term_id", (F.col("_row") == F.col("term_id")).alias("head"))
        return materialize(kept, "terms")


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + terms))``; in 128 bits where 64 do not hold the product."""
    wide = ((n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    exact = F.call_function("div", wide, (total + terms).cast("decimal(38,0)"))
    return 1 + F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * F.lit(SCALE).cast("long"), total + terms)).otherwise(exact)


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_report(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The terms that a source uses more than its language, by their share of the divergence; ``top`` a source.

    Cut in 16 salted parts first, then over what they leave: a source that holds
    a third of all counts is not ranked in one task.
    """
    found = (rows.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).filter("p > q")
                 .select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")))
    best = (F.col("value").desc(), F.col("item").asc())
    part = Window.partitionBy("lang", "source", "_salt").orderBy(*best)
    found = found.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(16)))
    found = found.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= top).drop("_r", "_salt")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


CELL_OUT = "lang string, source string, item string, part_sum long, present long"


def _cell(table: pa.Table) -> pa.Table:
    """Sums over one slice of the terms, for every ordered pair of sources across two blocks.

    A row without a term names a source of the block and the share of a term it never uses.
    """
    lang = table.column("lang")[0].as_py()
    names = table.column("source").combine_chunks().dictionary_encode()
    source, blocks = names.indices.to_numpy(), table.column("block").to_numpy()
    two_blocks = table.column("block")[0] != table.column("other")[0]
    is_term = table.column("term_id").is_valid().to_numpy()
    p = table.column("p").to_numpy()
    s = len(names.dictionary)
    unused, block = np.zeros(s, np.int64), np.zeros(s, np.int64)
    unused[source[~is_term]], block[source[~is_term]] = p[~is_term], blocks[~is_term]
    found, code = np.unique(table.column("term_id").drop_null().to_numpy(), return_inverse=True)
    n_terms = len(found)
    source, p = source[is_term], p[is_term]
    order = np.argsort(code, kind="stable")
    code, source, p = code[order], source[order], p[order]
    sums = np.zeros((s, s), np.int64)
    step = max(1, 2_000_000 // max(s, 1))
    for lo in range(0, n_terms, step):
        hi = min(lo + step, n_terms)
        a, b = np.searchsorted(code, [lo, hi])
        dense = np.tile(unused, (hi - lo, 1))
        dense[code[a:b] - lo, source[a:b]] = p[a:b]
        for i in range(s):
            d = dense[:, i:i + 1] - dense
            sums[i] += (d * d // dense).sum(axis=0)
    across = ~np.eye(s, dtype=bool)
    if two_blocks:                                                         # pairs inside one block have a cell of their own
        across &= block[:, None] != block[None, :]
    i, j = np.nonzero(across)
    of = names.dictionary
    return pa.table([pa.array([lang] * len(i), pa.string()), of.take(pa.array(i)), of.take(pa.array(j)),
                     pa.array(sums[i, j], pa.int64()), pa.array(np.full(len(i), n_terms), pa.int64())],
                    names=["lang", "source", "item", "part_sum", "present"])


def pair_report(rows: DataFrame, groups: DataFrame, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """The divergence of every source from every other source of its language, over all kept terms.

    ``groups``: ``lang, source, v, total, terms, unused`` (``unused``: the share of a term that the source never uses).
    Terms that neither source of a pair's blocks uses add one equal summand each.
    """
    by_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.sum("terms").alias("terms"))
    most, counts = by_lang.agg(F.coalesce(F.max("s"), F.lit(1)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    blocks, slices = -(-most // block), max(1, -(-counts // cell))
    at = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    entries = rows.select("lang", "source", "term_id", "p", at.alias("block"), F.pmod(F.xxhash64("term_id"), F.lit(slices)).cast("int").alias("slice"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    marks = groups.select("lang", "source", F.lit(None).cast("long").alias("term_id"), F.col("unused").alias("p"), at.alias("block"), every.alias("slice"))
    sent = entries.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = sent.groupBy("lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "slice")
    sums = (cells.applyInArrow(_cell, CELL_OUT).groupBy("lang", "source", "item")
                 .agg(F.sum("part_sum").alias("part_sum"), F.sum("present").alias("present")))
    mine = groups.select("lang", "source", "v", F.col("unused").alias("p"))
    its = groups.select("lang", F.col("source").alias("item"), F.col("unused").alias("q"))
    pairs = sums.join(mine, ["lang", "source"]).join(its, ["lang", "item"])
    value = F.col("part_sum") + (F.col("v") - F.col("present")) * gap(F.col("p"), F.col("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc()))
    return pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", rank)


def audit_sources(docs: DataFrame, at_least: int = AT_LEAST, top: int = TOP, levels: tuple = LEVELS,
                  block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of every language.

    NULL in ``text``, ``lang`` or ``source`` reads as the empty string.  Every row
    is a document, also where doc_ids repeat or are NULL; other columns are
    ignored.  A source without terms has its pairs (against the share of unused
    terms) and no terms; a language without kept terms has pairs of value 0.  A
    language with one source has no pair.
    """
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = frequent_terms(texts, at_least, levels)
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    langs = kept.filter("head").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = texts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "v", "lang_total")))
    none = F.lit(0).cast("long")
    groups = materialize(groups.withColumn(
        "unused", F.when(F.col("v") > 0, share(none, F.col("total"), F.col("v"))).otherwise(F.lit(1).cast("long"))), "sources")
    rows = kept.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"]).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("v")))
    out = ("lang", "source", "part", "item", "value", "rank")
    pairs = pair_report(rows, groups, block, cell).withColumn("part", F.lit("pair")).select(*out)
    return pairs.unionByName(term_report(rows, top).withColumn("part", F.lit("term")).select(*out))
