"""Whole documents against their templates: every check, one table of issues, one row of results per document."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Fields
from ..sources import crossing, markdown
from . import body, fields, validators
from .issues import ISSUE_SQL, gathered, issue
from .reports import results


def load_templates(raw: DataFrame) -> dict[str, body.Template]:
    """Templates by path from the rows (path, text) of the template folder: a small, hand-written set, compiled on the driver."""
    out = {}
    for r in raw.select("path", "text").collect():
        if (t := body.load_template(r["path"], r["text"])) is not None:
            out[r["path"]] = t
    return out


#: What the checks of this module read of a document.
CHECKED = ("path", "template", "fm", "body", "parse_error")


def parsed(raw: DataFrame, templates: dict[str, body.Template], path: str = "path", source: str = "text", columns: Iterable[str] | None = None) -> DataFrame:
    """Documents as markdown.parse_documents() gives them, with the issues of their bodies (body_issues) from the same crossing: front matter and body
    are parsed once, whatever is asked of them later."""
    rules = body.usable(templates)
    names = [n for n in markdown.DOCUMENT.names if columns is None or n in columns]
    read = {*names, "template"}

    def each(p, text):
        d = markdown.parse_one(p, text, read)
        found = [] if d["parse_error"] is not None else body.found_in(d["template"], markdown.plain_values(d["_fm"]), d["body"], rules)
        yield *(d[k] for k in names), found

    schema = pa.schema([*(markdown.DOCUMENT.field(n) for n in names), pa.field("body_issues", pa.list_(crossing.ISSUE))])
    return crossing.crossed(raw, [F.col(path).cast("string").alias("path"), F.col(source).alias("text")], each, schema, f"{markdown.document_sql(names)}, body_issues array<{ISSUE_SQL}>")


def front_issues(templates: dict[str, body.Template]):
    """Array of the issues of front matter, path and links, as a column over parsed documents: the rules of all templates are one projection."""
    path, template = F.col("path"), F.col("template")
    source = Fields(map_column="fm", synthetic={"$path": "path"})
    unread = F.col("parse_error").isNotNull()
    common = [F.when(~unread, validators.template_field_issue(F.try_element_at("fm", F.lit("template"))["s"]))]
    declared = F.try_element_at("fm", F.lit("template"))["s"]
    unresolved = declared.isNotNull() & (declared != "") & (~declared.isin(*templates) if templates else F.lit(True))
    common.append(F.when(~unread & unresolved, issue("error", "template", F.concat(F.lit("The template can't be loaded: "), declared), None, "Correct the template path")))
    lists = [validators.leaked_keys(path, source.keys()), validators.slug_issues(path)]
    per_template = []
    for name, t in templates.items():
        own = template == F.lit(name)
        if t.problems:
            made = F.array(*(issue("error", p["field"], p["message"], p["error_type"]) for p in t.problems))
            per_template.append(F.when(own, made))
            continue
        found, extra = fields.field_issues(t.fields or {}, source, t.strict)
        per_template.append(F.when(own & ~unread, gathered(found, extra)))
    failed = F.when(unread, issue("error", F.lit(None).cast("string"), F.concat(F.lit("The document can't be read: "), F.col("parse_error"))))
    return gathered([failed, *common, F.when(~unread, validators.relative_reference_issue(F.col("body")))], [F.when(~unread, x) for x in lists] + per_template)


def document_issues(docs: DataFrame, templates: dict[str, body.Template], known_paths: DataFrame | None = None) -> DataFrame:
    """All issues of parsed documents: path, seq, level, field, message, error_type, fix, body_line. Template files have none.

    Documents from parsed() take one scan; from markdown.parse_documents() a second crossing judges the bodies. Paths that must exist are
    an anti join. Only that join shuffles."""
    docs = docs.where(~validators.is_template_file(F.col("path")))
    template = F.col("template")
    source = Fields(map_column="fm", synthetic={"$path": "path"})
    front = front_issues(templates)
    if "body_issues" in docs.columns:
        numbered = F.concat(F.transform(front, lambda x, i: F.struct(i.alias("seq"), x.alias("i"))), F.transform("body_issues", lambda x, i: F.struct((i + 100_000).alias("seq"), x.alias("i"))))
        parts = [docs.select("path", F.explode(numbered).alias("x")).select("path", "x.seq", "x.i.*")]
    else:
        bodies = body.body_issues(docs.where("parse_error is null"), templates).withColumn("seq", F.col("seq") + 100_000)
        parts = [docs.select("path", F.posexplode(front).alias("seq", "i")).select("path", "seq", "i.*"), bodies]
    if known_paths is not None:
        for name, t in templates.items():
            for f, spec in ((t.fields or {}) if not t.problems else {}).items():
                if isinstance(spec, dict) and "exists" in spec and (c := fields.constraint("exists", spec["exists"])).get("value"):
                    v = source.value(f)
                    refs = docs.where((template == name) & fields._gate(c, source)).select("path", F.when(v["t"] == "string", v["s"]).alias("ref"))
                    gone = fields.missing_paths(refs, known_paths, "ref")
                    parts.append(gone.select("path", F.lit(200_000).alias("seq"), issue(c.get("severity") or "error", f, c.get("message") or F.concat(F.col("ref"), F.lit(" does not exist")), "exists-missing").alias("i")).select("path", "seq", "i.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _described(docs: DataFrame, *more) -> DataFrame:
    get = lambda k: F.try_element_at("fm", F.lit(k))["s"]
    skipped = validators.is_template_file(F.col("path"))
    return docs.select("path", "template", F.when(skipped, "template").otherwise(validators.document_type(get("document_type"), F.col("template"))).alias("doc_type"), get("status").alias("status"), get("owner").alias("owner"), skipped.alias("skipped"), *more)


def checked_results(docs: DataFrame, templates: dict[str, body.Template]) -> DataFrame:
    """document_results() of documents from parsed(), where no path must be looked up: every issue of a document is in its row, so one scan gives the
    results, without a join or a shuffle."""
    skipped = validators.is_template_file(F.col("path"))
    found = F.when(~skipped, F.concat(front_issues(templates), "body_issues")).otherwise(F.array().cast(f"array<{ISSUE_SQL}>"))
    count = lambda level: F.size(F.filter("_found", lambda x: x["level"] == level)).cast("long")
    out = _described(docs, found.alias("_found"))
    return out.withColumns({"n_errors": count("error"), "n_warnings": count("warning")}).withColumn("valid", F.col("n_errors") == 0).drop("_found")


def document_results(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per document: path, doc_type, status, owner, skipped, n_errors, n_warnings, valid."""
    return results(_described(docs), issues)


def asset_results(paths: DataFrame) -> DataFrame:
    """Files that are no Markdown and whose path is no slug: rows like document_results with doc_type asset."""
    rows = paths.where(~F.lower("path").endswith(".md")).select("path", validators.slug_issues(F.col("path")).alias("i")).where("size(i) > 0")
    none = F.lit(None).cast("string")
    return rows.select("path", none.alias("template"), F.lit("asset").alias("doc_type"), none.alias("status"), none.alias("owner"), F.lit(False).alias("skipped"), F.size("i").cast("long").alias("n_errors"), F.lit(0).cast("long").alias("n_warnings"), F.lit(False).alias("valid"))
