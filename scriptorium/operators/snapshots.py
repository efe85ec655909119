"""Snapshots of scores over time: an append-only dataset keyed by the time of measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCORES = ("overall", "schema", "vocab", "lifecycle", "distribution")
SCHEMA = "measured_at timestamp, schema_version int, " + ", ".join(f"{s} long" for s in SCORES)


def write(report: DataFrame, path: str, dry_run: bool = False) -> str | None:
    """Appends the report; nothing is written, and None returned, in a dry run."""
    if dry_run:
        return None
    report.withColumn("schema_version", F.lit(1)).select("measured_at", "schema_version", *SCORES).write.mode("append").json(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots in order of time; malformed lines are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where("measured_at is not null").orderBy("measured_at")


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot as one row; no row where there is none."""
    return snapshots.agg(F.max_by(F.struct(*snapshots.columns), "measured_at").alias("s")).where("s is not null").select("s.*")


def deltas(snapshots: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Each snapshot against the one before: d_<score> (null where either is null) and days (whole days between them).

    Without a key the series is one sequence of a few rows; with a key, one per key. Snapshots of one time follow each other by their scores, so
    that the result does not depend on how the table lies in its files."""
    w = Window.partitionBy(*(key or [])).orderBy("measured_at", *(s for s in SCORES if s in snapshots.columns))
    rows = snapshots
    for s in (x for x in SCORES if x in snapshots.columns):
        rows = rows.withColumn(f"d_{s}", F.col(s) - F.lag(s).over(w))
    at = F.unix_millis(F.col("measured_at").cast("timestamp"))
    return rows.withColumn("days", F.floor((at - F.lag(at).over(w)) / 86_400_000))


def verdict(score: Column) -> Column:
    return F.when(score >= 80, "healthy").when(score >= 60, "moderate").when(score.isNotNull(), "degraded")
