"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two documents link when their sets of distinct five-word shingles have a
Jaccard similarity of ``percent`` / 100 or more.  Exact:

1. Documents with equal sets form one class; only its smallest doc_id (the
   representative) is joined.
2. Shingles are ordered by (frequent, hash).  Sets of ``n`` shingles that
   match keep at least ``ceil(percent * n / 100)`` shingles, so two matching
   sets share a shingle among their first ``n - need + 1``, and two shingles
   among their first ``n - need + 2``.
3. Small sets (up to a boundary size) enumerate the 2-subsets of the longer
   prefix: a bucket is a pair of shingles.  Large sets scan inverted lists:
   a bucket is one shingle, holding large sets and the small ones that are
   long enough to match one.  The boundary is the size at which the number of
   subsets passes the expected length of the lists the set would scan.
4. In a bucket, pivots are compared with all other members of other
   components, then leave it.  A bucket within one component is done, so a
   group of thousands of near copies costs a few comparisons per member
   instead of all pairs; sets that stay apart are all compared.
5. Size, position, unique-shingle and signature bounds discard candidates
   before any text is fetched; the rest are verified on their whole texts, each
   pair once.  A signature holds, for each of 256 classes of shingles, whether
   the set has an odd number of them: where two signatures differ, a shingle
   stands in one set only, so the differing bits never exceed the symmetric
   difference and no true link is lost.  Pairs that pass are compared by sketches
   of the same kind, whose width grows with the set (a quarter byte a shingle).

Which shingles count as frequent, and the boundary, only steer the cost: both
come from counts over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .shared import bitmap, components, has_bit, short_batches
from .textkit import mix64, shingle_sets

FREQUENT = 64           # repeats inside task batches from which a shingle is ordered last


def min_size(percent: int) -> int:
    """Smallest set that can match an unequal one: ``n`` of ``n + 1`` shingles must reach the similarity."""
    return -(-percent // (100 - percent)) if percent < 100 else 2**31 - 1


MIN_SIZE = min_size(80)


def need(n: int, percent: int) -> int:
    """Fewest shingles that a set of ``n`` shares with any match."""
    return -(-percent * n // 100)


SIGNATURE = ("s0", "s1", "s2", "s3")            # 256 parity bits of a set
SCAN = "kind int, id long, n long, k1 long, k2 long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", sketch binary"
DOCUMENT, REPEAT, SLICE = range(3)


def signature(s: np.ndarray) -> np.ndarray:
    """Four longs: the parity of how many shingles fall into each of 256 classes."""
    odd = np.bincount((s >> np.uint64(16)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set in a power of two of at least two classes a shingle."""
    width = max(256, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 256
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the wider one folded to the other's width: at most the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def scan_sets(texts: DataFrame, width: int) -> DataFrame:
    """One pass over all texts, three kinds of rows.

    ``DOCUMENT``: id, set size, 128-bit key, signature and sketch of the set.  ``REPEAT``: a shingle
    and how many sets of a task's batch hold it, two or more.  ``SLICE``: the
    same for every shingle of one hash slice in 256, for the cost estimate.
    """
    def run(batches):
        held, size = [], 0

        def counts():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            for kind, some in ((REPEAT, times > 1), (SLICE, tokens & np.uint64(255) == 0)):
                m = int(some.sum())
                yield _scan_batch(np.full(m, kind), tokens[some].view(np.int64), times[some], np.zeros(m, np.int64), np.zeros(m, np.int64),
                                  np.zeros((m, 4), np.int64), [None] * m)
        for b in batches:
            n, k1, k2, marks, sketches = [], [], [], [], []
            for s in shingle_sets(b.column("text"), width):
                n.append(len(s))
                k1.append(int(mix64(s).sum(dtype=np.uint64)))
                marks.append(signature(s))
                sketches.append(sketch(s))
                k2.append(int(np.bitwise_xor.reduce(mix64(s + np.uint64(0x632BE59BD9B4E019)))) if len(s) else 0)
                held.append(s)
                size += len(s)
                if size > 1_000_000:
                    yield from counts()
                    held, size = [], 0
            yield _scan_batch(np.full(len(n), DOCUMENT), b.column("doc_id"), n, np.array(k1, np.uint64).view(np.int64),
                              np.array(k2, np.uint64).view(np.int64), np.array(marks, np.int64).reshape(-1, 4), sketches)
        if size:
            yield from counts()
    return texts.select("doc_id", "text").mapInArrow(run, SCAN)


def _scan_batch(kind, id_, n, k1, k2, marks, sketches) -> pa.RecordBatch:
    return pa.record_batch([pa.array(kind, pa.int32()), id_ if isinstance(id_, pa.Array) else pa.array(id_), pa.array(n, pa.int64()),
                            pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), *(pa.array(marks[:, i], pa.int64()) for i in range(4)), pa.array(sketches, pa.binary())],
                           names=["kind", "id", "n", "k1", "k2", *SIGNATURE, "sketch"])


def frequent_bits(scan: DataFrame) -> np.ndarray:
    """Bit table of the shingles that repeat often inside task batches (over all documents)."""
    repeats = scan.filter(F.col("kind") == REPEAT).groupBy(F.col("id").alias("token")).agg(F.sum("n").alias("n"))
    return bitmap(repeats.filter(F.col("n") >= FREQUENT), "token")


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    late = has_bit(frequent, tokens)
    return np.concatenate([tokens[~late], tokens[late]])


def postings(texts: DataFrame, reps: DataFrame, width: int, percent: int, frequent, boundary: int) -> DataFrame:
    """``key, doc_id, n, pos``: a row per bucket that a representative's set enters.

    Odd keys are 2-subsets of small sets, even keys inverted lists.
    """
    send = texts.sparkSession.sparkContext.broadcast
    shared, wanted = send(frequent), send(bitmap(reps.select(F.xxhash64("doc_id").alias("h")), "h"))
    lowest, least, one = need(boundary + 1, percent), min_size(percent), np.uint64(1)

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(has_bit(wanted.value, b.column("h").to_numpy().view(np.uint64))))
            out = [[], [], [], []]

            def add(doc, keys, n, pos):
                for col, x in zip(out, (keys, np.full(len(keys), doc, np.int64), np.full(len(keys), n, np.int32), pos.astype(np.int32))):
                    col.append(x)
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"), width)):
                n = len(s)
                if n < least:
                    continue
                s = ordered(s, shared.value)
                if n >= lowest:
                    p = s[:n - need(n, percent) + 1]
                    add(doc, p & ~one, n, np.arange(len(p)))
                if n <= boundary:
                    p = s[:n - need(n, percent) + 2]
                    i, j = np.triu_indices(len(p), 1)
                    add(doc, mix64(p[i] * np.uint64(3) + mix64(p[j])) | one, n, i)
                if sum(map(len, out[0])) > 200_000:
                    yield _batch(out)
                    for col in out:
                        col.clear()
            if out[0]:
                yield _batch(out)
    rows = texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    return rows.mapInArrow(run, "key long, doc_id long, n int, pos int")


def _batch(out) -> pa.RecordBatch:
    key, doc, n, pos = (np.concatenate(c) for c in out)
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array(doc), pa.array(n), pa.array(pos)], names=["key", "doc_id", "n", "pos"])


def cost_boundary(scan: DataFrame, percent: int) -> int:
    """The largest set size whose 2-subsets are no more than the list entries it would scan.

    The expected list length is ``sum(df^2) / sum(df)`` over the shingles that
    are not frequent, from one hash slice of the shingles of all documents.
    Up to 50 percent two matching sets may share a single shingle, which no
    2-subset holds: the boundary is 0 and all sets go to the lists.
    """
    if percent <= 50:
        return 0
    lists = scan.filter(F.col("kind") == SLICE).groupBy("id").agg(F.sum("n").cast("double").alias("df")).filter(F.col("df") < FREQUENT)
    r = lists.agg(F.sum(F.col("df") * F.col("df")).alias("sq"), F.sum("df").alias("n")).first()
    length = (r["sq"] / r["n"]) if r["n"] else 1.0
    n = min_size(percent)
    while n < 100_000:
        p = n + 1 - need(n + 1, percent) + 1
        if (p + 1) * p / 2 > p * max(length, 1.0):
            break
        n += 1
    return n


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole texts reach the similarity."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        last, mine = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, keep = batch.column("ta"), []
            for i, other in enumerate(shingle_sets(batch.column("tb"), width)):
                if a[i] != last:
                    last, mine = a[i], next(iter(shingle_sets(ta.slice(i, 1), width)))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    keep.append(i)
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())],
                                  names=["a", "b"])
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that their sketches (``doc_id, n, sketch``) leave possible."""
    left = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))

    def run(batches):
        for batch in batches:
            na, nb, ka, kb = (batch.column(c).to_pylist() for c in ("na", "nb", "ka", "kb"))
            fits = [(100 + percent) * differing(x, y) <= (100 - percent) * (n + m) for n, m, x, y in zip(na, nb, ka, kb)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def candidate_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of (at least) the documents in ``ids``: a fixed-size bit table filters the scan."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("doc_id").alias("h")), "h"))

    def run(batches):
        for b in batches:
            kept = has_bit(bits.value, b.column("h").to_numpy().view(np.uint64))
            yield b.select(["doc_id", "text"]).filter(pa.array(kept))
    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "doc_id long, text string")


def fits(percent: int):
    """Bounds that every matching pair meets: size, unique shingles, position, signature.

    A prefix shingle that stands in no other prefix may still stand in the rest
    of a set whose prefix ends earlier, so only the side whose own prefix ends
    first is bounded by its unique shingles: the weaker of the two bounds holds.
    """
    need_both = f"{percent} * (o.n + p.n)"
    some = "greatest(o.n - o.solo, p.n - p.solo)"
    place = "(least(o.pos, p.pos) + least(o.n - o.pos, p.n - p.pos))"
    differ = " + ".join(f"bit_count(o.{s} ^ p.{s})" for s in SIGNATURE)
    return F.expr(f"100 * least(o.n, p.n) >= {percent} * greatest(o.n, p.n) "
                  f"AND (100 + {percent}) * {some} >= {need_both} AND (100 + {percent}) * {place} >= {need_both} "
                  f"AND (100 + {percent}) * ({differ}) <= (100 - {percent}) * (o.n + p.n)")


def one_text_each(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with one row per doc_id; the text that sorts last counts where ids repeat."""
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    if texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
        return texts
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"))


def membership(scan: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, rep``: the smallest doc_id with an equal (not empty) set."""
    rows = scan.filter(F.col("kind") == DOCUMENT).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "k1", "k2")
    first = rows.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    member = rows.join(first, ["n_shingles", "k1", "k2"])
    member = member.select("doc_id", "n_shingles",
                           F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    return materialize(member, "membership")


def link_classes(texts: DataFrame, scan: DataFrame, member: DataFrame, width: int = 5, percent: int = 80) -> DataFrame | None:
    """``(v, root)``: the smallest document reachable from every representative that has a link."""
    spark = texts.sparkSession
    boundary = cost_boundary(scan, percent)
    reps = member.filter("doc_id = rep").select("doc_id")
    rows = materialize(postings(texts, reps, width, percent, frequent_bits(scan), boundary), "postings")
    twice = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    signed = scan.filter(F.col("kind") == DOCUMENT).select(F.col("id").alias("doc_id"), *SIGNATURE).join(reps, "doc_id", "left_semi")
    open_ = rows.join(twice, "key", "left_semi").join(signed, "doc_id")
    open_ = materialize(open_.withColumn("pairs", F.col("key").bitwiseAND(1) == 1), "buckets")
    shared_lists = open_.filter("NOT pairs").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    open_ = open_.join(shared_lists, "doc_id", "left").select(
        "key", "doc_id", "n", "pos", "pairs", *SIGNATURE, F.col("doc_id").alias("comp"),
        F.when(F.col("pairs") | F.col("c").isNull(), 0).otherwise(prefix - F.col("c")).cast("int").alias("solo"),
        (F.col("pairs") | (F.col("n") > boundary)).alias("leads"))
    sketches = scan.filter(F.col("kind") == DOCUMENT).select(F.col("id").alias("doc_id"), "n", "sketch")
    edges, label, pivots = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b")), None, 1
    tried = edges
    while True:
        mixed = (open_.groupBy("key")
                      .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("leads").alias("led"))
                      .filter("lo <> hi AND led").select("key"))
        open_ = materialize(open_.join(mixed, "key", "left_semi"), "buckets")
        if open_.isEmpty():
            return label
        rank = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
        lead = open_.filter("leads").withColumn("r", rank).filter(F.col("r") <= pivots).drop("r")
        lead = materialize(lead, "pivots")
        found = (open_.alias("o").join(lead.alias("p"), (F.col("o.key") == F.col("p.key")) & (F.col("o.comp") != F.col("p.comp")) & fits(percent))
                      .select(F.col("p.doc_id").alias("a"), F.col("o.doc_id").alias("b"))
                      .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = materialize(found.join(tried, ["a", "b"], "left_anti"), "candidates")
        tried = tried.unionByName(found)
        likely = materialize(plausible(found, sketches, percent), "likely")
        ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
        links = materialize(verify(likely, candidate_texts(texts, ids), width, percent), "links")
        open_ = open_.join(lead.select("key", "doc_id"), ["key", "doc_id"], "left_anti")
        if not links.isEmpty():
            edges = edges.unionByName(links)
            label = components(edges)
            open_ = (open_.drop("comp").join(label, F.col("doc_id") == F.col("v"), "left")
                          .select("key", "doc_id", "n", "pos", "pairs", *SIGNATURE, F.coalesce("root", "doc_id").alias("comp"), "solo", "leads"))
        pivots *= 8


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of every document.

    ``class_id`` is the smallest doc_id with an equal shingle set;
    ``component_id`` the smallest doc_id reachable by links.  A NULL or
    wordless text has the empty set and is linked with nothing.  Rows with a
    NULL doc_id are no documents here and give no row; rows that repeat a
    doc_id count once, by the text that sorts last.  Other columns are ignored.
    """
    short_batches(docs.sparkSession)
    texts = one_text_each(docs)
    scan = materialize(scan_sets(texts, width), "sets")
    member = membership(scan)
    label = link_classes(texts, scan, member, width, percent)
    if label is None:
        return member.select("doc_id", "n_shingles", F.col("rep").alias("component_id"), F.col("rep").alias("class_id"))
    return (member.join(label, F.col("rep") == F.col("v"), "left")
                  .select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"), F.col("rep").alias("class_id")))
