"""The corpus pipeline: documents to shards in five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, mixing, ngram_join, sharding
from tessera.session import materialize


OWN = ("doc_id", "text", "lang", "source")


def set_aside(docs: DataFrame):
    """``docs`` with every other column under a neutral name, and a function that gives the names back.

    A column that happens to be called like an operator's result keeps its values.
    """
    names = [c if c in OWN else f"_carried_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of; the rejected ones go."""
    plain, restore = set_aside(docs)
    model = language.train(plain.filter(~language.held_out("doc_id")))
    return restore(language.identify(plain, model).filter("NOT rejected"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` plus a ``_row`` that names each row: its doc_id, or a number written down with it where doc_ids repeat or are NULL."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of linked texts.

    Rows are told apart by their own number, not by doc_id: rows that repeat a
    doc_id or have none stay or go by their own text.  A NULL doc_id comes last
    in its group; of rows with an equal doc_id any one stays.
    """
    plain, restore = set_aside(docs)
    rows = numbered(plain)
    groups = ngram_join.ngram_jaccard_join(rows.select(F.col("_row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    gone = groups.join(first.select("_row"), "_row", "left_anti").select("_row")
    return restore(rows.join(gone, "_row", "left_anti"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose own text no benchmark item stands, whatever their doc_id."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: a row per copy."""
    plain, restore = set_aside(docs)
    mixed = mixing.mix_sources(plain, odds=mixing.LENGTH_ODDS).filter("copies > 0")
    return restore(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its shard and slot; shards hold near equal bytes."""
    return sharding.shard_by_bytes(docs, shards=8)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

# The n-gram join, the edit matching and the model have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
