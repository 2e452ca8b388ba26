"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

``LineIndex`` keeps, in a shared folder and one version per update:

* ``holds``: (slot, key, doc_id), each document's line keys (a 128-bit hash);
* ``counts``: (slot, key, n_docs, keeper), the exact reference counts;
* ``filters``: (shard, blob), a cuckoo filter of the keys held by two
  documents or more.  A key enters when its count passes from 1 to 2 and
  leaves when it falls back, which a cuckoo filter supports.

A slot is fixed by the key, a shard is the slot modulo the number of shards.
That number follows the lines held (``PER_SHARD`` a shard, in doublings), so
a filter and the task that builds it stay small at any size; when it doubles,
the filters are built anew from the exact counts.

``insert`` and ``delete`` move the index by a batch of documents; inserting
and deleting the same batch gives the counts of before.  ``shared`` streams the
lines of documents past their shard's filter: a miss certainly stays, so only
hits are joined with the exact counts.  Lines of a large shard are salted by
document, with as many salts as its lines need, and its filter is sent to each
salt, so a line that most documents hold is spread over tasks.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .shared import cleared, short_batches
from .textkit import ascii_lower

WHITE = " \t\n\v\f\r"
HOLD = "slot int, key binary, doc_id long"
SLOT_BYTES = 3                                   # 2**24 slots bound the number of shards
FIRST_SHARDS, PER_SHARD = 64, 500_000            # held lines that a shard is made for
FULL, OPEN = 0.85, b""                           # most of a filter's places in use; no filter: every key may be shared
PER_TASK, OVER = 2_000_000, 1.5                  # held lines of a shard, or share of the mean shard, from which it is salted
LAST = 2**63 - 1                                 # stands for a NULL doc_id: the largest id


def key_of(line: str, least: int) -> bytes | None:
    k = ascii_lower(line.strip(WHITE))
    return hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16).digest() if len(k) >= least else None


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, two buckets a key."""

    SLOTS, KICKS = 4, 200

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        buckets = 16
        while buckets * cls.SLOTS * FULL < len(keys):
            buckets *= 2
        while True:
            out = cls(np.zeros((buckets, cls.SLOTS), np.uint16))
            if all(out.add(k) for k in keys):
                return out
            buckets *= 2

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, keys: list[bytes]):
        raw = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        mark = (raw[:, 0] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (raw[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        mark, one, two = self.places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def _put(self, bucket: int, mark) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return len(free) > 0

    def add(self, key: bytes) -> bool:
        """False when no place was found; the filter must then be built anew with more buckets."""
        mark, one, two = (x[0] for x in self.places([key]))
        if self._put(one, mark) or self._put(two, mark):
            return True
        bucket = two
        for kick in range(self.KICKS):
            slot = (int(mark) + kick) % self.SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self.other(np.int64(bucket), np.uint16(mark)))
            if self._put(bucket, mark):
                return True
        return False

    def remove(self, key: bytes) -> None:
        mark, one, two = (x[0] for x in self.places([key]))
        for bucket in (one, two):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                return


class LineIndex:
    """The versioned state of incremental line dedup in ``folder`` (shared storage)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None, least: int = 10,
                 version: str | None = None, per_shard: int = PER_SHARD, per_task: int = PER_TASK):
        self.spark, self.shards, self.least, self.per_shard, self.per_task = spark, shards, least, per_shard, per_task
        self.folder = folder or shared_path(spark, "line-index", uuid.uuid4().hex)
        self.version = version

    def table(self, name: str, schema: str) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{self.version}/{name}")

    @property
    def holds(self) -> DataFrame:
        return self.table("holds", HOLD)

    @property
    def counts(self) -> DataFrame:
        return self.table("counts", "slot int, key binary, n_docs long, keeper long")

    @property
    def filters(self) -> DataFrame:
        return self.table("filters", "shard int, blob binary")

    def shard(self):
        return F.pmod("slot", F.lit(self.shards)).cast("int").alias("shard")

    def lines(self, docs: DataFrame) -> DataFrame:
        """``slot, key, doc_id``: the distinct line keys of every document row."""
        least = self.least

        def run(batches):
            for b in batches:
                slot, key, doc = [], [], []
                for d, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    found = {key_of(x, least) for x in (text.as_py() or "").split("\n")} - {None}
                    key += found
                    slot += [int.from_bytes(k[:SLOT_BYTES], "little") for k in found]
                    doc += [LAST if d is None else d] * len(found)
                yield pa.record_batch([pa.array(slot, pa.int32()), pa.array(key, pa.binary()), pa.array(doc, pa.int64())],
                                      names=["slot", "key", "doc_id"])
        return docs.select("doc_id", "text").mapInArrow(run, HOLD)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the lines of ``docs``; documents already in it add only new lines."""
        new = self.lines(docs)
        return self._next((self.holds.unionByName(new) if self.version else new).distinct())

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id is in ``docs``."""
        gone = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id")).distinct()
        return self._next(self.holds.join(gone, "doc_id", "left_anti").select("slot", "key", "doc_id"))

    def _next(self, holds: DataFrame) -> LineIndex:
        out = LineIndex(self.spark, self.folder, self.shards, self.least, f"v-{uuid.uuid4().hex}", self.per_shard, self.per_task)
        at = f"{out.folder}/{out.version}"
        holds.write.parquet(f"{at}/holds")
        out.shards = self.shards or FIRST_SHARDS
        held = out.holds.count()                 # from the files' footers
        while out.shards * self.per_shard < held and out.shards < 256 ** SLOT_BYTES:
            out.shards *= 2
        (out.holds.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("keeper"))
            .write.parquet(f"{at}/counts"))
        full = out.counts.filter("n_docs > 1").select(out.shard(), "key")
        if self.version is None or out.shards != self.shards:
            work, kept = full.withColumn("now", F.lit(True)), self.spark.createDataFrame([], "shard int, blob binary")
        else:
            old = self.counts.select("slot", "key", F.col("n_docs").alias("before"))
            moved = (out.counts.join(old, ["slot", "key"], "full")
                        .select(out.shard(), "key", (F.coalesce("n_docs", F.lit(0)) > 1).alias("now"),
                                (F.coalesce("before", F.lit(0)) > 1).alias("then"))
                        .filter("now <> then").select("shard", "key", "now"))
            # the keys of a filter that would be too full come from the exact counts
            sizes = full.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
            sized = (moved.select("shard").distinct().join(sizes, "shard", "left").join(self.filters, "shard", "left")
                          .select("shard", (F.col("blob").isNull() | (F.coalesce("n", F.lit(0)) > F.length("blob") / 2 * FULL)).alias("anew")))
            anew = full.join(sized.filter("anew"), "shard", "left_semi").withColumn("now", F.lit(True))
            work = moved.join(sized.filter("NOT anew"), "shard", "left_semi").unionByName(anew)
            kept = self.filters.join(sized.filter("anew"), "shard", "left_anti")

        def build(left: pa.Table, right: pa.Table) -> pa.Table:
            shard = (left if left.num_rows else right).column("shard")[0].as_py()
            keys, now = left.column("key").to_pylist(), left.column("now").to_pylist()
            old = right.column("blob")[0].as_py() if right.num_rows else None
            blob = OPEN
            if old is None:
                blob = Cuckoo.of(keys).dump()
            elif old != OPEN:
                f = Cuckoo.load(old)
                for k in (k for k, add in zip(keys, now) if not add):
                    f.remove(k)
                if all(f.add(k) for k, add in zip(keys, now) if add):
                    blob = f.dump()
            return pa.table({"shard": pa.array([shard], pa.int32()), "blob": pa.array([blob], pa.binary())})
        (work.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(build, "shard int, blob binary")
             .write.parquet(f"{at}/filters"))
        return out

    def maybe_shared(self, lines: DataFrame) -> DataFrame:
        """``key, doc_id`` of the ``lines`` (slot, key, doc_id) that their shard's filter does not rule out."""
        # one row a shard, and there is a shard for every per_shard held lines only
        most = max(min(self.per_task, OVER * self.holds.count() / self.shards), 1.0)
        salts = F.broadcast(self.holds.groupBy(self.shard()).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("salts")))
        lines = (lines.select(self.shard(), "key", "doc_id").join(salts, "shard", "left")
                      .select("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
                              "key", "doc_id", F.lit(None).cast("binary").alias("blob")))
        blobs = (self.filters.join(salts, "shard", "left")
                     .select("shard", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"),
                             F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), "blob"))
        rows = (blobs.unionByName(lines).repartition("shard", "salt")
                     .sortWithinPartitions("shard", "salt", F.col("blob").isNull()))

        def run(batches):
            at, held = None, None
            for b in batches:
                shard, keys, blob = b.column("shard").to_numpy(), b.column("key"), b.column("blob")
                keep = np.zeros(b.num_rows, bool)
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    if shard[lo] != at:
                        at, held = shard[lo], None
                    loads = np.flatnonzero(np.array(blob.slice(lo, hi - lo).is_valid()))
                    for i in loads[:1]:
                        held = blob[lo + int(i)].as_py()
                        held = held if held == OPEN else Cuckoo.load(held)
                    mine = np.array(keys.slice(lo, hi - lo).is_valid())
                    if held == OPEN:
                        keep[lo:hi] = mine
                    elif held is not None and mine.any():
                        at_rows = lo + np.flatnonzero(mine)
                        keep[at_rows] = held.has(keys.take(pa.array(at_rows)).to_pylist())
                yield b.filter(pa.array(keep)).select(["key", "doc_id"])
        return rows.mapInArrow(run, "key binary, doc_id long")

    def dropped(self, lines: DataFrame) -> DataFrame:
        """``doc_id, keys``: the line keys that each document loses to an earlier one."""
        exact = self.counts.filter("n_docs > 1").select("key", "keeper")
        lost = self.maybe_shared(lines).join(exact, "key").filter("doc_id <> keeper")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def kept(self, docs: DataFrame, held: bool = False) -> DataFrame:
        """``docs`` with ``kept`` (the text left), ``n_lines`` and ``n_dropped`` per row.

        ``held``: all of ``docs`` are in the index, whose line keys are then read instead of the texts.
        """
        docs = cleared(docs, "kept", "n_lines", "n_dropped", "_doc", "_keys")
        names = docs.columns
        lost = self.dropped(self.holds if held else self.lines(docs)).select(F.col("doc_id").alias("_doc"), F.col("keys").alias("_keys"))
        rows = docs.join(lost, F.coalesce(docs["doc_id"], F.lit(LAST)) == F.col("_doc"), "left").drop("_doc")
        least = self.least

        def run(batches):
            for b in batches:
                texts, lines, gone = [], [], []
                for text, keys in zip(b.column("text"), b.column("_keys")):
                    all_ = (text.as_py() or "").split("\n")
                    drop = set(keys.as_py() or ())
                    stay = [x for x in all_ if key_of(x, least) not in drop] if drop else all_
                    texts.append("\n".join(stay))
                    lines.append(len(all_))
                    gone.append(len(all_) - len(stay))
                cols = [b.column(c) for c in names]
                yield pa.record_batch(cols + [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                                      names=[*names, "kept", "n_lines", "n_dropped"])
        from pyspark.sql.types import LongType, StringType, StructType
        schema = StructType(list(docs.schema.fields)).add("kept", StringType()).add("n_lines", LongType()).add("n_dropped", LongType())
        return rows.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = 10, shards: int | None = None) -> DataFrame:
    """``doc_id, text, kept, n_lines, n_dropped``: repeated lines stay only in their smallest document.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least ``least`` code points held by two documents or more lose
    all their lines but those of the smallest doc_id that holds them.  NULL and
    empty texts are one empty line.  Rows of one doc_id are one document and
    each gives its row; a NULL doc_id is one document after all others.
    """
    short_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    return LineIndex(docs.sparkSession, shards=shards, least=least).insert(docs).kept(docs, held=True)
