"""Model-eval regression gate (SRC8, JN7, JN8, AGG4, AGG5, FN1, DML13, SNK9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import round_half_up

# Percent drop that blocks / warns.
REGRESSION_PCT = 5
WARNING_PCT = 2

BASELINES_SCHEMA = ("agents map<string, map<string, struct<accuracy: double, updatedAt: string>>>, "
                    "lastUpdated string")


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: nested baselines document -> (agent_id, skill_id, accuracy, updated_at)."""
    doc = spark.read.schema(BASELINES_SCHEMA).option("multiLine", "true").json(path)
    a = doc.select(F.explode("agents").alias("agent_id", "skills"))
    return a.select("agent_id", F.explode("skills").alias("skill_id", "b")).select(
        "agent_id", "skill_id", F.col("b.accuracy").alias("accuracy"),
        F.try_to_timestamp(F.col("b.updatedAt")).alias("updated_at"))


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """SRC8: ``<root>/<agent>/<skill>.json`` files with ``{"accuracy": x}``."""
    df = (spark.read.schema("accuracy double").option("multiLine", "true")
          .option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(root))
    p = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(p, r"([^/]+)/[^/]+\.json$", 1).alias("agent_id"),
                     F.regexp_extract(p, r"([^/]+)\.json$", 1).alias("skill_id"),
                     F.col("accuracy").alias("current"))


def compare_eval(baselines: DataFrame, results: DataFrame, fail_pct: float = REGRESSION_PCT,
                 warn_pct: float = WARNING_PCT) -> DataFrame:
    """JN7 + FN1: baseline-driven inner join; status on the unrounded drop.

    A missing result skips the pair; a result without baseline is ignored;
    baseline 0 gives a NULL drop (``try_divide``) and status OK (Q12).
    """
    j = baselines.select("agent_id", "skill_id", F.col("accuracy").alias("baseline")).join(
        results.select("agent_id", "skill_id", "current"), ["agent_id", "skill_id"])
    drop = F.try_divide(F.col("baseline") - F.col("current"), F.col("baseline")) * 100
    status = (F.when(drop > fail_pct, F.lit("REGRESSION")).when(drop > warn_pct, F.lit("WARNING"))
              .otherwise(F.lit("OK")))
    return j.select("agent_id", "skill_id", "baseline", "current",
                    round_half_up(drop, 2).alias("drop_pct"), status.alias("status"))


def agent_rollup(comparison: DataFrame, agents: DataFrame) -> DataFrame:
    """AGG4: per agent (every baseline agent, even with no surviving skill)."""
    per = comparison.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("n_skills"),
        F.count_if(F.col("status") == "REGRESSION").alias("regressions"),
        F.count_if(F.col("status") == "WARNING").alias("warnings"))
    out = agents.select("agent_id").distinct().join(per, "agent_id", "left").fillna(0, ["n_skills", "regressions",
                                                                                         "warnings"])
    status = (F.when(F.col("regressions") > 0, F.lit("REGRESSION")).when(F.col("warnings") > 0, F.lit("WARNING"))
              .otherwise(F.lit("OK")))
    return out.withColumn("status", status)


def eval_report(agent_rows: DataFrame) -> DataFrame:
    """AGG5: totals and the production gate (one row).

    An agent with a regressed and a warned skill counts in both totals;
    ``passing`` are those with neither.
    """
    down, warned = F.col("regressions") > 0, F.col("warnings") > 0
    return agent_rows.agg(
        F.count(F.lit(1)).alias("total_agents"), F.count_if(down).alias("regressions"),
        F.count_if(warned).alias("warnings"), F.count_if(~down & ~warned).alias("passing"),
    ).withColumn("has_regression", F.col("regressions") > 0) \
     .withColumn("has_warning", F.col("warnings") > 0) \
     .withColumn("gate", F.when(F.col("regressions") > 0, F.lit("BLOCKED")).otherwise(F.lit("OPEN")))


def ratchet(baselines: DataFrame, comparison: DataFrame, as_of) -> DataFrame:
    """JN8 + DML13: raise a baseline when ``current >= coalesce(existing, 0)``; stamp time."""
    b = baselines.select("agent_id", "skill_id", F.col("accuracy").alias("old"), F.col("updated_at").alias("old_at"))
    c = comparison.select("agent_id", "skill_id", "current")
    j = b.join(c, ["agent_id", "skill_id"], "full_outer")
    up = F.col("current").isNotNull() & (F.col("current") >= F.coalesce(F.col("old"), F.lit(0.0)))
    return j.select("agent_id", "skill_id",
                    F.when(up, F.col("current")).otherwise(F.col("old")).alias("accuracy"),
                    F.when(up, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("old_at")).alias("updated_at"),
                    up.alias("updated"))


def write_report(agent_rows: DataFrame, comparison: DataFrame, path: str, timestamp: str | None = None) -> None:
    """SNK9: the report as JSON lines under ``path``.

    ``agents/``: one object per agent with its skills (nested per agent,
    bounded by that agent's skills); ``report/``: one object with the flags,
    the time and the summary totals.
    """
    t = eval_report(agent_rows)
    stamp = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    t.select(F.col("has_regression").alias("hasRegression"), F.col("has_warning").alias("hasWarning"), stamp.alias("timestamp"),
             F.struct(F.col("total_agents").alias("totalAgents"), "regressions", "warnings", "passing").alias("summary"),
             ).write.mode("overwrite").json(f"{path}/report")
    skills = comparison.groupBy("agent_id").agg(F.collect_list(F.struct(
        F.col("skill_id").alias("skillId"), "baseline", "current", F.col("drop_pct").alias("dropPct"),
        "status")).alias("skills"))
    out = agent_rows.join(skills, "agent_id", "left").select(
        F.col("agent_id").alias("agentId"), "status",
        F.coalesce("skills", F.array().cast(skills.schema["skills"].dataType)).alias("skills"))
    out.write.mode("overwrite").json(f"{path}/agents")
