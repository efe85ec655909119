"""The link graph as an edge table: links, incoming counts, backlinks, look-ups, search and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

LINK = r"\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"


def markdown_links(docs: DataFrame, source: str = "text") -> DataFrame:
    """Edges of documents (path and raw text, front matter and code included): src, target_raw, target (path from the root),
    line. Targets that are no paths, or leave the root, have no edge."""
    lines = docs.select("path", F.posexplode(F.split(F.coalesce(source, F.lit("")), "\n")).alias("line", "l")).where(F.col("l").contains("]("))
    found = lines.select(F.col("path").alias("src"), (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("l", F.lit(LINK), F.lit(1))).alias("target_raw"))
    return resolved(found)


def resolved(found: DataFrame) -> DataFrame:
    out = found.withColumn("target", text.resolve_path(text.folder_of(F.col("src")), text.link_path(F.col("target_raw"))))
    return out.where(F.col("target").isNotNull() & (F.col("target") != "")).select("src", "target_raw", "target", "line")


def incoming_counts(links: DataFrame, documents_only: bool = True) -> DataFrame:
    """path, incoming: links to each target. Partial sums before the shuffle, so a page that everything links to is no hot key."""
    rows = links.where(F.col("target").endswith(".md")) if documents_only else links
    return rows.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("incoming"))


def backlinks(links: DataFrame, target: str | Column | None = None) -> DataFrame:
    """(target, src, line) rows in order; of one target where it is given."""
    rows = links if target is None else links.where(F.col("target") == target)
    return rows.select("target", "src", "line").orderBy("target", "src", "line")


def references(links: DataFrame, docs: DataFrame, target: str, with_self: bool = False) -> DataFrame:
    out = links.where(F.col("target") == target).select("src", "line")
    return out.unionByName(docs.where(F.col("path") == target).select(F.col("path").alias("src"), F.lit(0).alias("line"))) if with_self else out


def broken(links: DataFrame, paths: DataFrame) -> DataFrame:
    return links.join(paths.select(F.col("path").alias("target")).distinct(), "target", "left_anti").select("src", "target", "line")


def index_entries(docs: DataFrame) -> DataFrame:
    """id (from the file name), title (front matter, else first H1, else file name), template, status, owner, phase."""
    get = lambda k: F.nullif(F.try_element_at("fm", F.lit(k))["s"], F.lit(""))
    name = F.regexp_replace(text.basename(F.col("path")), r"\.md\z", "")
    made = F.regexp_extract(name, r"^(?:\d{4}-\d{2}-\d{2}-)?([A-Za-z]+-\d+)", 1)
    first = F.nullif(F.regexp_extract("body", r"(?m)^#[ \t]+(.+?)[ \t]*$", 1), F.lit(""))
    return docs.select("path", F.nullif(made, F.lit("")).alias("id"), F.coalesce(get("title"), first, name).alias("title"), "template", get("status").alias("status"), get("owner").alias("owner"), get("phase").alias("phase"))


def search(entries: DataFrame, query: str, columns: list[str], order: list[str], cap: int = 50) -> DataFrame:
    """Rows any of whose columns contains the query, whatever its case; an empty query finds nothing."""
    if not query.strip():
        return entries.where("false")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return entries.where(hit).orderBy(*order).limit(cap)


def resolve_id(entries: DataFrame, wanted: str, order: str = "path") -> DataFrame:
    """The entry of an id: equal id first, else a file name that begins with it or holds it as a part; one row or none."""
    name = text.basename(F.col("path"))
    rank = F.when(F.col("id") == wanted, 0).when(name.startswith(f"{wanted}-") | name.startswith(f"{wanted}."), 1).when(name.contains(f"-{wanted}-") | name.contains(f"-{wanted}."), 1)
    return entries.withColumn("_r", rank).where("_r is not null").orderBy("_r", order).limit(1).drop("_r")


def complete(paths: DataFrame, folder: str, typed: str = "", cap: int = 200) -> DataFrame:
    """Link completion: paths of the folder first, then by lower-case path."""
    rows = paths.where(F.lower("path").contains(typed.lower())) if typed else paths
    near = text.folder_of(F.col("path")) == folder
    return rows.select("path", near.alias("same_folder")).orderBy(F.desc("same_folder"), F.lower("path"), "path").limit(cap)


def anchors(sections: DataFrame) -> DataFrame:
    """Anchors of headings, in order; a repeated one gets its number."""
    slug = text.anchor_slug(F.col("text"))
    n = F.row_number().over(Window.partitionBy("path", "slug").orderBy("line")) - 1
    rows = sections.withColumn("slug", slug)
    return rows.select("path", "line", "text", F.when(n > 0, F.concat("slug", F.lit("-"), n)).otherwise(F.col("slug")).alias("anchor"))


def symbols(docs: DataFrame) -> DataFrame:
    """Front-matter keys and headings with their depth and line; headings inside fences count too."""
    lines = docs.select("path", "body_line", F.posexplode(F.split("body", "\n")).alias("i", "l"))
    m = F.regexp_extract("l", r"^(#{1,6})\s+(.+?)\s*$", 1)
    heads = lines.where(F.col("l").rlike(r"^#{1,6}\s+\S")).select("path", F.lit("heading").alias("kind"), F.regexp_extract("l", r"^#{1,6}\s+(.+?)\s*$", 1).alias("name"), F.length(m).alias("depth"), (F.col("i") + F.col("body_line") + 1).alias("line"))
    keys = docs.select("path", F.explode(F.filter(F.map_keys("fm"), lambda k: ~k.contains("."))).alias("name"))
    return heads.unionByName(keys.select("path", F.lit("key").alias("kind"), "name", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("line")))


def code_lens(docs: DataFrame, counts: DataFrame, today: Column) -> DataFrame:
    """path, incoming, days since updated_at or updated."""
    date = F.coalesce(F.try_element_at("fm", F.lit("updated_at"))["s"], F.try_element_at("fm", F.lit("updated"))["s"])
    out = docs.select("path", F.datediff(today, F.try_to_timestamp(date).cast("date")).alias("days_since_update")).join(counts, "path", "left")
    return out.select("path", F.coalesce("incoming", F.lit(0)).alias("incoming"), "days_since_update")


def replace_documents(entries: DataFrame, links: DataFrame, changed: DataFrame, new_entries: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index after some documents changed: their entries and outgoing edges are replaced; a document that can't be read any more
    has no new entry and drops out."""
    keys = changed.select("path").distinct()
    e = entries.join(keys, "path", "left_anti").unionByName(new_entries)
    kept = links.join(keys.withColumnRenamed("path", "src"), "src", "left_anti")
    return e, kept.unionByName(new_links)
