"""Health measures of a corpus: schema drift, vocabulary drift, lifecycle decay, distribution, emergence, and the score.

Inputs are long tables, so each measure is one or two grouped aggregations over (template, field) or terms, with map-side
partial sums; no measure gathers documents. Chaos scores run from 0 to 1; health is 100 minus 100 times chaos.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from copy import deepcopy

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text
from ..functions.values import Fields

DEFAULTS = {
    "weights": {"schema": 0.30, "vocab": 0.25, "lifecycle": 0.30, "distribution": 0.15},
    "vocab": {"distance_threshold": 0.2, "ignore": []},
    "lifecycle": {"default": {"stale_after_days": 90, "zombie_after_days": 30, "orphan_grace_days": 14, "zombie_status_set": ["in-progress", "draft", "wip"]}, "perTemplate": {}},
    "emergence": {"candidate_threshold": 0.30, "min_template_docs": 10},
}


def settings(user: dict | None = None) -> dict:
    """The defaults with a user's settings merged in, section by section."""
    out = deepcopy(DEFAULTS)
    user = user if isinstance(user, dict) else {}
    for k in ("weights", "vocab", "emergence"):
        out[k] |= user.get(k) or {}
    cycle = user.get("lifecycle") or {}
    out["lifecycle"]["default"] |= cycle.get("default") or {}
    out["lifecycle"]["perTemplate"] |= cycle.get("perTemplate") or {}
    return out


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def health(chaos: Column) -> Column:
    return half_up(100 - chaos * 100).cast("long")


def overall_score(chaos: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean health over the measures that are not null, rounded half up; null where none is left."""
    total = used = F.lit(0.0)
    for name, c in chaos.items():
        w = F.lit(float(weights[name]))
        total = total + F.when(c.isNotNull(), (100 - c * 100) * w).otherwise(0.0)
        used = used + F.when(c.isNotNull(), w).otherwise(0.0)
    return F.when(used > 0, half_up(total / F.when(used > 0, used)).cast("long"))


# --- schema drift --------------------------------------------------------------------------------------------------


def field_values(docs: DataFrame, schemas: dict[str, dict], fields: Fields, template: str = "template") -> DataFrame:
    """Long form of all declared fields: template, field, kind (enum, required, other), allowed, t, s; t and s are null where the value is
    missing or empty. Only documents of known templates. One projection and one generate."""
    rows = []
    for name, schema in schemas.items():
        for f, spec in (schema or {}).items():
            spec = spec if isinstance(spec, dict) else {}
            allowed = [str(x).lower() if isinstance(x, bool) else str(x) for x in spec["enum"]] if isinstance(spec.get("enum"), list) and spec["enum"] else None
            kind = "enum" if allowed else "required" if spec.get("required") is True else "other"
            v = fields.value(f)
            there = v.isNotNull() & ~F.coalesce((v["t"] == "string") & (v["s"] == ""), F.lit(False))
            listed = F.array(*(F.lit(x) for x in allowed)) if allowed else F.array().cast("array<string>")
            rows.append(F.when(F.col(template) == name, F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), listed.alias("allowed"), F.when(there, v["t"]).alias("t"), F.when(there, v["s"]).alias("s"))))
    if not rows:
        return docs.where("false").select(F.lit("").alias("template"), F.lit("").alias("field"), F.lit("").alias("kind"), F.array().cast("array<string>").alias("allowed"), F.lit("").alias("t"), F.lit("").alias("s"))
    long = docs.select(F.col(template).alias("template"), F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("v"))
    return long.select("template", "v.*")


def value_histogram(values: DataFrame) -> DataFrame:
    """template, field, value, n: how often each present value occurs."""
    return values.where("s is not null").groupBy("template", "field", F.col("s").alias("value")).agg(F.count("*").alias("n"))


def schema_drift(values: DataFrame) -> DataFrame:
    """One row per (template, field): total, present, distinct_values, drift_score, entropy_norm, orphan_values.

    Enums: share of documents with a value outside the enum. Required fields: share without a value. Others: share of the present
    values that are not of the most frequent type. Two aggregation levels, the first by value and type."""
    each = values.groupBy("template", "field", "kind", "allowed", "t", "s").agg(F.count("*").alias("n"))
    kinds = each.withColumn("by_type", F.sum("n").over(Window.partitionBy("template", "field", "t")))
    here = F.col("s").isNotNull()
    stray = here & ~F.array_contains("allowed", F.col("s"))
    grouped = kinds.groupBy("template", "field", "kind").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("present"),
        F.count_distinct(F.when(here, F.col("s"))).alias("distinct_values"),
        F.coalesce(F.sum(F.when(stray, F.col("n"))), F.lit(0)).alias("invalid"),
        F.max(F.when(here, F.col("by_type"))).alias("dominant"),
        F.coalesce(F.sum(F.when(here, F.col("n") * F.log2("n"))), F.lit(0.0)).alias("nlogn"),
        F.array_sort(F.collect_set(F.when(stray & (F.col("kind") == "enum"), F.col("s")))).alias("orphan_values"),
    )
    p = F.col("present")
    mixed = F.when(p <= 1, 0.0).otherwise(1 - F.col("dominant") / F.when(p > 0, p))
    drift = F.when(F.col("kind") == "enum", F.col("invalid") / F.col("total")).when(F.col("kind") == "required", 1 - p / F.col("total")).otherwise(mixed)
    # the entropy of counts c with sum N is log2 N - sum(c log2 c) / N
    entropy = (F.log2(p) - F.col("nlogn") / F.when(p > 0, p)) / F.log2(F.when(F.col("distinct_values") >= 2, F.col("distinct_values")))
    return grouped.select("template", "field", "total", "present", "distinct_values", drift.alias("drift_score"), F.when((F.col("kind") == "enum") & (F.col("distinct_values") >= 2), entropy).alias("entropy_norm"), "orphan_values")


def global_schema_drift(drift: DataFrame) -> DataFrame:
    return drift.agg(F.coalesce(F.avg("drift_score"), F.lit(0.0)).alias("global_drift_score"))


# --- vocabulary ----------------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def canonical_term(terms: pd.Series) -> pd.Series:
    """NFKC, lower case. Applied to distinct terms only."""
    return terms.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def term_uses(terms: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """kind, term, uses from rows (kind, term)."""
    rows = terms.where(F.col("term").isNotNull())
    if ignore:
        rows = rows.where(~text.matches_glob(F.col("term"), ignore))
    return rows.groupBy("kind", "term").agg(F.count("*").alias("uses"))


def document_terms(docs: DataFrame) -> DataFrame:
    """kind (tag, link) and term of parsed documents: string items of an array ``tags``, and the trimmed inner texts of [[...]]."""
    tags = F.try_element_at("fm", F.lit("tags"))
    listed = docs.select(F.lit("tag").alias("kind"), F.explode(F.when(tags["t"] == "array", tags["a"])).alias("term"))
    found = F.transform(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+?)\]\]"), F.lit(1)), F.trim)
    links = docs.select(F.lit("link").alias("kind"), F.explode(F.filter(found, lambda x: x != "")).alias("term"))
    return listed.unionByName(links)


def vocabulary_clusters(uses: DataFrame, key: Column | None = None) -> DataFrame:
    """Terms that are one but for case and width: kind, key, canonical (most used, then shortest, then first), members, total_uses,
    redundant_uses, fragmentation; only where there are several."""
    keyed = uses.withColumn("key", canonical_term("term") if key is None else key)
    best = F.min_by("term", F.struct(-F.col("uses"), F.length("term"), F.col("term")))
    grouped = keyed.groupBy("kind", "key").agg(best.alias("canonical"), F.array_sort(F.collect_set("term")).alias("members"), F.sum("uses").alias("total_uses"), F.max("uses").alias("_top"), F.count("*").alias("_n"))
    return grouped.where("_n >= 2").select("kind", "key", "canonical", "members", "total_uses", (F.col("total_uses") - F.col("_top")).alias("redundant_uses"), (F.col("_n") - 1).alias("fragmentation"))


def vocabulary_drift(uses: DataFrame, key: Column | None = None) -> DataFrame:
    """One row: total_uses, redundant_uses, drift_score."""
    keyed = uses.withColumn("key", canonical_term("term") if key is None else key)
    by_key = keyed.groupBy("kind", "key").agg(F.sum("uses").alias("u"), F.max("uses").alias("top"))
    total, extra = F.coalesce(F.sum("u"), F.lit(0)), F.coalesce(F.sum(F.col("u") - F.col("top")), F.lit(0))
    return by_key.agg(total.alias("total_uses"), extra.alias("redundant_uses")).withColumn("drift_score", F.when(F.col("total_uses") > 0, F.col("redundant_uses") / F.col("total_uses")).otherwise(0.0))


def fuzzy_pairs(terms: DataFrame, threshold: float, column: str = "term") -> DataFrame:
    """Pairs a < b of distinct terms within the normalised distance, with different keys: term_a, term_b, distance.

    A pair within distance d agrees in one of d + 1 stretches of the shorter term, up to a shift; so terms meet in buckets
    of (length, stretch number, text), as in partition-based joins, never all with all. Terms too short to cut
    meet in the bucket of their length, of which there are few."""
    keyed = terms.select(F.col(column).alias("term")).distinct().withColumn("key", canonical_term("term"))
    size = F.length("key")
    # edits allowed for a pair whose longer term has n characters
    allowed = lambda n: F.floor(n * threshold + 1e-9).cast("int")
    # the shorter term of a pair has at least n - allowed(n) characters; so the most edits it can take part in:
    most = F.floor(size * threshold / (1 - min(threshold, 0.99)) + 1e-9).cast("int")
    cuts = F.least(most + 1, F.greatest(size, F.lit(1)))
    width = lambda i: F.floor(size * (i + 1) / cuts).cast("int") - F.floor(size * i / cuts).cast("int")
    start = lambda i: F.floor(size * i / cuts).cast("int")
    short = cuts <= most  # not enough stretches: such terms are a few characters long
    pieces = F.when(short, F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("p")))).otherwise(F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.struct(i.cast("int").alias("i"), F.substr("key", start(i) + 1, width(i)).alias("p"))))
    left = keyed.select("term", "key", size.cast("int").alias("n"), F.explode(pieces).alias("s")).select("term", "key", "n", "s.i", "s.p")

    def probes():
        """For each length a shorter partner may have, the substrings where its stretches may lie."""
        lengths = F.sequence(F.greatest(size - allowed(size), F.lit(1)), size)
        rows = keyed.select("term", "key", size.cast("int").alias("n"), allowed(size).alias("e"), F.explode(lengths).alias("m"))
        most_m = F.floor(F.col("m") * threshold / (1 - min(threshold, 0.99)) + 1e-9).cast("int")
        cuts_m = F.least(most_m + 1, F.greatest(F.col("m"), F.lit(1)))
        rows = rows.withColumns({"c": cuts_m, "few": cuts_m <= most_m})
        rows = rows.withColumn("i", F.explode(F.when(F.col("few"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("c") - 1))))
        at = F.floor(F.col("m") * F.col("i") / F.col("c")).cast("int")
        w = F.floor(F.col("m") * (F.col("i") + 1) / F.col("c")).cast("int") - at
        shifts = F.filter(F.sequence(F.greatest(at - F.col("e"), F.lit(0)), at + F.col("e")), lambda s: s + w <= F.col("n"))
        found = F.when(F.col("i") == -1, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(shifts, lambda s: F.substr("key", (s + 1).cast("int"), w))))
        return rows.select(F.col("term").alias("other"), F.col("key").alias("other_key"), "m", "i", F.explode(found).alias("p"))

    right = probes()
    met = left.join(right, (left["n"] == right["m"]) & (left["i"] == right["i"]) & (left["p"] == right["p"])).where("key <> other_key").select("key", "other_key", "term", "other").distinct()
    near = met.withColumn("distance", text.normalised_distance(F.col("key"), F.col("other_key"))).where(F.col("distance") <= threshold)
    return near.select(F.least("term", "other").alias("term_a"), F.greatest("term", "other").alias("term_b"), "distance").distinct()


def fuzzy_groups(uses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy complete-linkage groups within each connected set of pairs: canonical_hint, members, max_pairwise_distance.
    Sequential by nature, so it runs per connected set, on pairs alone (the terms of a set that are near each other)."""
    pairs = pairs.persist()
    roots = _components(pairs)
    labelled = pairs.join(roots, pairs["term_a"] == roots["term"]).select("root", "term_a", "term_b", "distance")
    counts = uses.groupBy("term").agg(F.sum("uses").alias("uses"))
    labelled = labelled.join(counts.select(F.col("term").alias("term_a"), F.col("uses").alias("uses_a")), "term_a").join(counts.select(F.col("term").alias("term_b"), F.col("uses").alias("uses_b")), "term_b")

    def group(f: pd.DataFrame) -> pd.DataFrame:
        near = {(a, b): d for a, b, d in zip(f["term_a"], f["term_b"], f["distance"], strict=True)}
        near |= {(b, a): d for (a, b), d in near.items()}
        n = dict(zip(f["term_a"], f["uses_a"], strict=True)) | dict(zip(f["term_b"], f["uses_b"], strict=True))
        order = sorted(n)
        done: set[str] = set()
        out = []
        for seed in order:
            if seed in done:
                continue
            members = [seed]
            for c in order:
                if c != seed and c not in done and all((c, m) in near for m in members):
                    members.append(c)
            if len(members) > 1:
                done.update(members)
                best = min(members, key=lambda t: (-n[t], len(t), t))
                out.append((best, sorted(members), max(near[a, b] for i, a in enumerate(members) for b in members[i + 1 :])))
        return pd.DataFrame(out, columns=["canonical_hint", "members", "max_pairwise_distance"])

    return labelled.groupBy("root").applyInPandas(group, "canonical_hint string, members array<string>, max_pairwise_distance double")


def _components(pairs: DataFrame) -> DataFrame:
    """term, root: the first term of each connected set; label propagation, each round cut by a checkpoint or a count of changes."""
    both = pairs.select(F.col("term_a").alias("term"), F.col("term_b").alias("other")).unionByName(pairs.select(F.col("term_b").alias("term"), F.col("term_a").alias("other")))
    both = both.cache()
    labels = both.groupBy("term").agg(F.least(F.min("other"), F.col("term")).alias("root")).cache()
    while True:
        spread = both.join(labels.withColumnRenamed("term", "other"), "other").groupBy("term").agg(F.min("root").alias("r"))
        new = labels.join(spread, "term").select("term", F.least("root", "r").alias("root"))
        jump = new.select(F.col("term").alias("root"), F.col("root").alias("up"))
        new = new.join(jump, "root", "left").select("term", F.coalesce(F.least("root", "up"), "root").alias("root")).cache()
        changed = new.join(labels.withColumnRenamed("root", "old"), "term").where("root <> old").limit(1).count()
        labels.unpersist()
        labels = new
        if not changed:
            return labels


# --- lifecycle -----------------------------------------------------------------------------------------------------


def lifecycle(docs: DataFrame, config: dict, now: Column, incoming: DataFrame | None = None) -> DataFrame:
    """One row per document (path, template, status, mtime, created_at): days_idle, days_since_created, incoming, stale, orphan,
    zombie, decayed. Thresholds of a template override the defaults key by key; incoming has (path, incoming)."""
    default = config["default"]

    def limit(key: str) -> Column:
        own = [F.when(F.col("template") == t, F.lit(o[key])) for t, o in config.get("perTemplate", {}).items() if o.get(key) is not None]
        return F.coalesce(*own, F.lit(default[key]))

    def statuses() -> Column:
        listed = lambda xs: F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")
        own = [F.when(F.col("template") == t, listed(o["zombie_status_set"])) for t, o in config.get("perTemplate", {}).items() if o.get("zombie_status_set") is not None]
        return F.coalesce(*own, listed(default["zombie_status_set"]))

    def days(c: str) -> Column:
        return F.floor((F.unix_millis(now) - F.unix_millis(F.col(c).cast("timestamp"))) / 86_400_000)

    if incoming is not None:
        docs = docs.drop("incoming").join(incoming, "path", "left")
    else:
        docs = docs.withColumn("incoming", F.lit(0).cast("long"))
    out = docs.withColumns({"incoming": F.coalesce("incoming", F.lit(0)), "days_idle": days("mtime"), "days_since_created": days("created_at")})
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({
        "stale": flag(F.col("days_idle") > limit("stale_after_days")),
        "orphan": flag((F.col("incoming") == 0) & (F.col("days_since_created") > limit("orphan_grace_days"))),
        "zombie": flag(F.array_contains(statuses(), F.col("status")) & (F.col("days_idle") > limit("zombie_after_days"))),
    })
    return out.withColumn("decayed", F.col("stale") | F.col("orphan") | F.col("zombie"))


def decay_score(found: DataFrame) -> DataFrame:
    """One row: documents, n_stale, n_orphan, n_zombie, decay_score (documents that decay in any way, each once)."""
    counts = [F.count_if(c).alias(f"n_{c}") for c in ("stale", "orphan", "zombie")]
    return found.agg(F.count("*").alias("documents"), *counts, F.count_if("decayed").alias("_d")).select("documents", "n_stale", "n_orphan", "n_zombie", F.when(F.col("documents") > 0, F.col("_d") / F.col("documents")).otherwise(0.0).alias("decay_score"))


# --- distribution --------------------------------------------------------------------------------------------------


def gini(counts: DataFrame, column: str) -> DataFrame:
    """One row: groups, total, gini (null for fewer than two groups, 0 for a total of 0). Sorted counts in closed form; equal counts
    are added up first, so the ordered pass sees distinct counts only."""
    sizes = counts.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("k"))
    below = F.sum("k").over(Window.orderBy("x")) - F.col("k")
    # k equal counts at ranks below+1..below+k: the sum of 2i - n - 1 over them is k (2 below + k - n)
    ranked = sizes.select("x", "k", below.alias("b"))
    agg = ranked.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("groups"), F.coalesce(F.sum(F.col("x") * F.col("k")), F.lit(0.0)).alias("total"), F.sum(F.col("x") * F.col("k") * (2 * F.col("b") + F.col("k"))).alias("w"))
    value = (F.col("w") - F.col("groups") * F.col("total")) / (F.col("groups") * F.when(F.col("total") > 0, F.col("total")))
    return agg.select("groups", "total", F.when(F.col("groups") > 1, F.coalesce(value, F.lit(0.0))).alias("gini"))


def usage(docs: DataFrame, column: str) -> DataFrame:
    """value, n of the rows where the column holds something."""
    return docs.where(F.col(column).cast("string") != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def usage_verdict(groups: Column, g: Column) -> Column:
    return F.when(groups == 0, "empty").when(groups == 1, "single_template").when(g.isNull(), "unknown").when(g < 0.3, "flat").when(g > 0.7, "monoculture").otherwise("healthy_pareto")


def compression(docs: DataFrame, column: str, order: str) -> DataFrame:
    """One row: raw_bytes, gzip_bytes, global_ratio (null under 100 characters) of the texts joined by newlines in order.

    Range-partitioned by the order; each task compresses its range as a stream, and the sizes add up: the window of
    the compressor, 32 KB, is far less than a range, so the ratio is that of one stream but for the seams."""
    import zlib

    ranged = docs.select(order, F.coalesce(F.col(column), F.lit("{}")).alias("x")).repartitionByRange(order).sortWithinPartitions(order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw = size = chars = rows = 0
        for f in frames:
            for x in f["x"]:
                b = (("\n" if rows else "") + x).encode()
                raw, chars, rows = raw + len(b), chars + len(x) + bool(rows), rows + 1
                size += len(z.compress(b))
        size += len(z.flush())
        yield pd.DataFrame({"raw": [raw], "size": [size if rows else 0], "chars": [chars], "rows": [int(rows > 0)]})

    parts = ranged.mapInPandas(run, "raw long, size long, chars long, rows long").agg(F.sum("raw").alias("raw"), F.sum("size").alias("size"), F.sum("chars").alias("chars"), F.sum("rows").alias("rows"))
    joints = F.greatest(F.coalesce("rows", F.lit(0)) - 1, F.lit(0))
    enough = F.coalesce(F.col("chars") + joints >= 100, F.lit(False))
    raw = F.col("raw") + joints
    return parts.select(F.when(enough, raw).otherwise(0).alias("raw_bytes"), F.when(enough, F.col("size")).otherwise(0).alias("gzip_bytes"), F.when(enough, F.col("size") / raw).alias("global_ratio"))


def distribution_score(g: Column, untemplated_ratio: Column, compression_ratio: Column) -> Column:
    zero = F.lit(0.0)
    band = F.coalesce(F.greatest(zero, 0.3 - g) + F.greatest(zero, g - 0.7), zero)
    return F.least(F.lit(1.0), F.greatest(zero, band + untemplated_ratio + F.coalesce(F.greatest(zero, compression_ratio - 0.4), zero)))


# --- emergence -----------------------------------------------------------------------------------------------------


def field_candidates(entries: DataFrame, totals: DataFrame, declared: DataFrame, threshold: float, least: int, samples: int = 10) -> DataFrame:
    """Fields that documents use without their template declaring them. entries: template, field, value (text, not empty), ord (where
    first seen); totals: template, total_docs; declared: template, field."""
    free = entries.join(declared, ["template", "field"], "left_anti")
    by_value = free.groupBy("template", "field", "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    # of each field's values only the first ones are kept, by a window the planner turns into a limit per group
    rank = F.row_number().over(Window.partitionBy("template", "field").orderBy("first", "value"))
    head = by_value.withColumn("r", rank).where(F.col("r") <= samples).groupBy("template", "field").agg(F.array_sort(F.collect_list(F.struct("r", "value"))).alias("s"))
    stats = by_value.groupBy("template", "field").agg(F.sum("n").alias("appearances"), F.count("*").alias("distinct_values"))
    out = stats.join(totals.where(F.col("total_docs") >= least), "template").withColumn("promote_confidence", F.col("appearances") / F.col("total_docs"))
    out = out.where(F.col("promote_confidence") > threshold).join(head, ["template", "field"])
    primitive = F.when(F.col("distinct_values") / F.col("appearances") < 0.5, "enum").otherwise("string")
    return out.select("template", "field", "appearances", "total_docs", F.transform("s", lambda x: x["value"]).alias("value_samples"), "promote_confidence", primitive.alias("suggested_primitive"))


def section_candidates(headings: DataFrame, totals: DataFrame, declared: DataFrame, threshold: float, least: int) -> DataFrame:
    """Headings (template, heading; one row per occurrence) beyond a template's sections: appearances may exceed the documents."""
    free = headings.join(declared, ["template", "heading"], "left_anti").groupBy("template", "heading").agg(F.count("*").alias("appearances"))
    out = free.join(totals.where(F.col("total_docs") >= least), "template").withColumn("promote_confidence", F.col("appearances") / F.col("total_docs"))
    return out.where(F.col("promote_confidence") > threshold).select("template", "heading", "appearances", "total_docs", "promote_confidence")


def too_small(totals: DataFrame, least: int) -> DataFrame:
    return totals.where(F.col("total_docs") < least).select("template")


def document_entries(docs: DataFrame) -> DataFrame:
    """Front-matter entries of parsed documents for field_candidates()."""
    rows = docs.where("template is not null").select("template", F.col("path").alias("ord"), F.explode("fm").alias("field", "v"))
    return rows.where(F.col("v").isNotNull() & ~F.col("field").contains(".") & ~F.coalesce((F.col("v.t") == "string") & (F.col("v.s") == ""), F.lit(False))).select("template", "field", F.col("v.s").alias("value"), "ord")


# --- the whole report ----------------------------------------------------------------------------------------------


def measure(docs: DataFrame, schemas: dict[str, dict], now: Column, incoming: DataFrame | None = None, config: dict | None = None) -> DataFrame:
    """One row: chaos scores and health of the four measures, and the overall score, of parsed documents with mtime and created_at."""
    cfg = settings(config)
    values = field_values(docs, schemas, Fields(map_column="fm"))
    schema = global_schema_drift(schema_drift(values))
    vocab = vocabulary_drift(term_uses(document_terms(docs), cfg["vocab"]["ignore"])).select(F.col("drift_score").alias("vocab"))
    status = F.when(F.try_element_at("fm", F.lit("status"))["t"] == "string", F.try_element_at("fm", F.lit("status"))["s"])
    cycle = decay_score(lifecycle(docs.select("path", "template", status.alias("status"), "mtime", "created_at"), cfg["lifecycle"], now, incoming)).select(F.col("decay_score").alias("lifecycle"))
    g = gini(usage(docs, "template"), "n").select("gini", "groups")
    bare = docs.agg(F.coalesce(F.count_if(F.col("template").isNull() | (F.col("template") == "")) / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0)).alias("bare"))
    packed = compression(docs, "fm_json", "path").select("global_ratio")
    # six single rows side by side
    one = schema.select(F.col("global_drift_score").alias("schema"))
    for other in (vocab, cycle, g, bare, packed):
        one = one.join(other, F.lit(True))
    one = one.withColumn("distribution", distribution_score(F.col("gini"), F.col("bare"), F.col("global_ratio")))
    chaos = {k: F.col(k) for k in ("schema", "vocab", "lifecycle", "distribution")}
    return one.select(*chaos.values(), *(health(c).alias(f"{k}_health") for k, c in chaos.items()), overall_score(chaos, cfg["weights"]).alias("overall_score"), usage_verdict(F.col("groups"), F.col("gini")).alias("template_usage"))
