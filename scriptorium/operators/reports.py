"""From issues to results, and from results to summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def results(docs: DataFrame, issues: DataFrame, key: str = "path") -> DataFrame:
    """One row per document, clean ones too: n_errors, n_warnings, valid (no errors). Levels other than these count as neither."""
    counts = issues.groupBy(key).agg(F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warning").alias("n_warnings"))
    out = docs.join(counts, key, "left").fillna(0, ["n_errors", "n_warnings"])
    return out.withColumn("valid", F.col("n_errors") == 0)


def summary(found: DataFrame) -> DataFrame:
    """One row of totals over results with columns skipped, valid, n_errors and n_warnings."""
    live = ~F.col("skipped")
    return found.agg(F.count("*").alias("total"), F.count_if("skipped").alias("skipped"), F.count_if(live & F.col("valid")).alias("valid"), F.count_if(live & ~F.col("valid")).alias("invalid"), F.coalesce(F.sum("n_errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("n_warnings"), F.lit(0)).alias("warnings"))


def grouped(found: DataFrame, doc_type: Column, path: Column) -> DataFrame:
    """Totals by document type and by folder (the first three segments), in one pass: dimension, name, total, valid, invalid."""
    folder = F.array_join(F.slice(F.split(text.folder_of(path), "/"), 1, 3), "/")
    rows = found.select(F.coalesce(doc_type, F.lit("unknown")).alias("doc_type"), folder.alias("folder"), "valid")
    sets = rows.groupingSets([["doc_type"], ["folder"]], "doc_type", "folder").agg(F.grouping("doc_type").alias("g"), F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    by_folder = F.col("g") == 1
    return sets.select(F.when(by_folder, "folder").otherwise("doc_type").alias("dimension"), F.when(by_folder, F.col("folder")).otherwise(F.col("doc_type")).alias("name"), "total", "valid", "invalid")


def common_issues(issues: DataFrame, top: int = 5, order: list[str] | None = None) -> DataFrame:
    """The most frequent issue kinds: field and message up to its first colon; of equals, the one seen first."""
    kind = F.concat_ws(": ", "field", F.split_part(F.col("message"), F.lit(":"), F.lit(1)))
    seen = F.struct(*(order or ["seq"]))
    return issues.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min(seen).alias("_first")).orderBy(F.desc("n"), "_first", "kind").limit(top).select("kind", "n")


def exit_code(total: dict, strict: bool = False) -> int:
    """1 where something is invalid, or, in strict mode, where there are warnings."""
    return int(total["invalid"] > 0 or (strict and total["warnings"] > 0))


def render(total: dict, top: list[dict]) -> str:
    """A short report for people; reads totals and at most a handful of rows."""
    lines = [f"{total['total']} documents: {total['valid']} valid, {total['invalid']} invalid, {total['skipped']} skipped", f"{total['errors']} errors, {total['warnings']} warnings"]
    return "\n".join([*lines, *(f"  {r['n']:>6}  {r['kind']}" for r in top)])


def report_json(total: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of JSON text: the summary first, then each result; written as they are by a text sink."""
    head = total.select(F.lit(0).alias("o"), F.lit("").alias("k"), F.to_json(F.struct("*")).alias("value"))
    rows = found.select(F.lit(1).alias("o"), F.col("path").alias("k"), F.to_json(F.struct("*")).alias("value"))
    return head.unionByName(rows).orderBy("o", "k").select("value")
