"""Document fingerprints: I-Match over randomised lexicon subsets (DataFrame functions only).

Terms are kept when their inverse document frequency lies in a band.  The
lexicon is cut at random (by a hash of the term) into ``subsets`` subsets of
``1 / (subsets * 2**level)`` of its terms each; a level's subsets contain the
next level's.  A document takes the level at which a subset holds one or two
of its terms, by its number of distinct terms, so that in short and long texts
alike a subset's hash changes only when one of few terms changes.  The
fingerprint is the level and, for it and the next one, the hash of the sorted
distinct kept terms in every subset.  Likeness is the share of equal hashes at
the deepest level that two fingerprints have in common.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import global_index
from ..session import materialize

SUBSETS = 24
IDF_LOW, IDF_HIGH = math.log(20), math.log(2000)
BAND_SHARE = 0.5                                 # rough share of a text's terms in the band, for the level only
MOST_SENT = 2_000_000                            # lexicon terms up to which it is sent to every task
WIDE = 6                                         # hex digits of a subset's hash
EMPTY = "0" * WIDE


def terms(text: Column) -> Column:
    """The distinct lower-cased words of a text without the marks at their ends."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def lexicon(docs: DataFrame, low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """``term, h``: the terms whose idf lies in the band, over all documents.

    A kept term stands in ``exp(-high)`` of the documents at least, so there
    are at most ``exp(high) *`` (mean distinct terms a document) of them,
    however many documents there are.
    """
    seen = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.count()
    # fewer documents than exp(high) have no term that rare: then every term in one document counts
    least, most = total * math.exp(-high), max(total * math.exp(-low), 2)
    return seen.filter((F.col("df") >= least) & (F.col("df") <= most)).select("term", F.xxhash64("term").alias("h"))


def prints(rows: DataFrame, words: DataFrame, subsets: int = SUBSETS) -> DataFrame:
    """``doc_id, edited, level, marks, whole, meta`` of rows (doc_id, edited, text, meta).

    The terms of a row outside its level's subsets are left out before the
    lookup, so about ``2 * subsets / BAND_SHARE`` terms a row meet the lexicon.
    ``meta`` travels on a row of its own beside the terms.  A lexicon of more
    than ``MOST_SENT`` terms (very long documents) is joined by a shuffle.
    """
    if words.count() <= MOST_SENT:
        words = F.broadcast(words)
    rows = rows.withColumn("ts", terms(F.col("text")))
    size = F.size("ts") * F.lit(BAND_SHARE / subsets)
    rows = rows.withColumn("level", F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1.0)))), F.lit(0)).cast("int"))
    rows = rows.withColumn("wide", F.expr(f"shiftleft({subsets}L, level)"))
    some = F.filter("ts", lambda t: F.pmod(F.xxhash64(t), F.col("wide")) < subsets)
    side = F.concat_ws("|", F.lit(""), F.hex(F.xxhash64("text")), F.col("meta"))
    flat = rows.select("doc_id", "edited", "level", F.explode(F.concat(some, F.array(side))).alias("term"))
    told = flat.join(words, "term", "left").filter(F.col("h").isNotNull() | F.startswith("term", F.lit("|")))
    told = told.groupBy("doc_id", "edited").agg(F.max("level").alias("level"), F.array_sort(F.collect_list("h")).alias("hs"),
                                                F.max(F.when(F.col("h").isNull(), F.col("term"))).alias("side"))

    def mark(k, step):
        mine = F.filter("hs", lambda h: F.pmod(h, F.expr(f"shiftleft({subsets}L, level + {step})")) == k)
        return F.when(F.size(mine) > 0, F.right(F.lpad(F.lower(F.hex(F.xxhash64(mine))), 16, "0"), F.lit(WIDE))).otherwise(F.lit(EMPTY))
    marks = F.concat(*[mark(k, step) for step in (0, 1) for k in range(subsets)])
    part = F.split("side", r"\|", 3)
    return told.select("doc_id", "edited", "level", marks.alias("marks"),
                       F.when(F.size("hs") == 0, F.lower(part[1])).otherwise(F.lit("")).alias("whole"), part[2].alias("meta"))


def likeness(a: str, b: str, subsets: int = SUBSETS) -> Column:
    """Share of equal subset hashes at the deepest level both have; subsets empty in both do not count.

    ``a`` and ``b`` name struct columns (level, marks, whole).  Without a
    counted subset: 1 for equal whole texts, else 0.
    """
    top = f"greatest({a}.level, {b}.level)"

    def at(x):
        return f"substring({x}.marks, ({top} - {x}.level) * {subsets * WIDE} + k * {WIDE} + 1, {WIDE})"
    pairs = f"""filter(transform(sequence(0, {subsets - 1}), k ->
        CASE WHEN {at(a)} = '{EMPTY}' AND {at(b)} = '{EMPTY}' THEN NULL ELSE {at(a)} = {at(b)} END), p -> p IS NOT NULL)"""
    return F.expr(f"""CASE WHEN {a}.whole <> '' OR {b}.whole <> '' THEN double({a}.whole = {b}.whole)
        WHEN abs({a}.level - {b}.level) > 1 THEN 0D
        ELSE coalesce(size(filter({pairs}, p -> p)) / nullif(size({pairs}), 0), 0D) END""")


def next_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id, n``: each document's successor in descending doc_id (after the last, the first)."""
    ids = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    g = materialize(global_index(ids, [F.col("doc_id").desc_nulls_last(), F.col("n")]), "order")
    total = g.count()
    after = g.select(F.col("doc_id").alias("next_id"), F.pmod(F.col("_g") - 1, F.lit(max(total, 1))).alias("_g"))
    return g.join(after, "_g").select("doc_id", "next_id", "n")


def with_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id, n, text, edited``: the last third replaced by the head of the next document."""
    order = materialize(next_ids(docs), "next")
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own, after = plain.alias("own"), plain.alias("after")       # one exchange of the texts serves both joins
    third = F.floor(F.col("n") / 3).cast("int")
    heads = (order.withColumnRenamed("doc_id", "owner").join(after, F.col("next_id") == F.col("after.doc_id"))
                  .select("owner", "next_id", "n", F.substring("text", F.lit(1), third).alias("head")))
    return (own.join(heads, F.col("own.doc_id") == F.col("owner"))
               .select("doc_id", "next_id", "n", "text",
                       F.concat(F.substring("text", F.lit(1), (F.col("n") - third).cast("int")), "head").alias("edited")))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A NULL text is empty.  A text without a kept term has a fingerprint with a
    hash of the whole text, so equal texts always have equal fingerprints.
    Rows with a NULL doc_id give no row; where a doc_id repeats, the text that
    sorts last counts.  A single document is its own next one.  Other columns
    are ignored.
    """
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    words = materialize(lexicon(docs), "lexicon")
    rows = with_edits(docs)
    meta = F.concat_ws("|", F.col("n").cast("string"), F.col("next_id").cast("string"), F.sha2("edited", 256))
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("edited"), F.col("text").alias("text"), meta.alias("meta")),
                              F.struct(F.lit(True).alias("edited"), F.col("edited").alias("text"), F.lit("").alias("meta"))))
    told = prints(rows.select("doc_id", kinds.alias("v")).select("doc_id", "v.*"), words)
    one = F.struct("level", "marks", "whole")
    told = told.groupBy("doc_id").agg(F.max(F.when(~F.col("edited"), one)).alias("f"), F.max(F.when(F.col("edited"), one)).alias("e"),
                                      F.max(F.when(~F.col("edited"), F.col("meta"))).alias("meta"))
    told = materialize(told.select("doc_id", "f", "e", F.split("meta", r"\|").alias("m")), "fingerprints")
    after = told.select(F.col("doc_id").alias("next_id"), F.col("f").alias("g"))

    def as_text(x):
        return F.concat_ws("-", F.lpad(F.col(f"{x}.level").cast("string"), 2, "0"), F.col(f"{x}.marks"), F.col(f"{x}.whole"))
    return (told.withColumn("next_id", F.col("m")[1].cast("long")).join(after, "next_id")
                .select("doc_id", F.col("m")[0].cast("long").alias("n_chars"), F.col("m")[2].alias("edited_sha256"),
                        as_text("f").alias("fingerprint"), as_text("e").alias("edited_fingerprint"),
                        likeness("f", "e").alias("near_edited"), likeness("f", "g").alias("near_next")))
