"""Queries over the standard tables, one or more per operator, each with the SQL that says what it should give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions, text
from ..functions.values import Fields
from ..operators import body, entropy, fields, graph, issues, reports, rewrite, snapshots, validate, validators
from ..sources import markdown
from ..streaming import buffers
from . import testbed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _issues(df: DataFrame, key: str, schema: dict, strict: bool = False, known=None, columns: list[str] | None = None) -> DataFrame:
    source = Fields({c: k for c, k in ((f.name, f.dataType) for f in df.schema.fields) if columns is None or c in columns})
    found, lists = fields.field_issues(schema, source, strict, known)
    return issues.exploded(df, [key], issues.gathered(found, lists)).select(key, "field", "error_type", "level")


# --- field rules -----------------------------------------------------------------------------------------------------

ORDER_SCHEMA = {
    "o_orderstatus": {"required": True, "type": "string", "enum": {"value": ["O", "F"], "when": "o_orderpriority in ['1-URGENT', '2-HIGH']", "severity": "warning"}},
    "o_totalprice": {"type": "number", "min": 50000, "max": 400000},
    "clerk": {"required": {"when": "o_orderstatus in ['F'] or o_orderpriority not in ['1-URGENT']"}},
    "o_orderdate": {"type": "date", "after": "1995-06-01", "before": "2001-01-01"},
    "o_orderpriority": {"pattern": "^[1-3]-"},
}
_ORDER_ISSUES = """
  SELECT o_orderkey, 'o_orderstatus' AS field, 'enum-violation' AS error_type, 'warning' AS level FROM orders WHERE o_orderstatus NOT IN ('O','F') AND o_orderpriority IN ('1-URGENT','2-HIGH')
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'min-violation', 'error' FROM orders WHERE o_totalprice < 50000
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'max-violation', 'error' FROM orders WHERE o_totalprice > 400000
  UNION ALL SELECT o_orderkey, 'clerk', 'required-missing', 'error' FROM orders WHERE o_orderpriority = '5-LOW' AND (o_orderstatus = 'F' OR o_orderpriority <> '1-URGENT')
  UNION ALL SELECT o_orderkey, 'o_orderdate', 'after-violation', 'error' FROM orders WHERE NOT o_orderdate > TIMESTAMP '1995-06-01'
  UNION ALL SELECT o_orderkey, 'o_orderdate', 'before-violation', 'error' FROM orders WHERE NOT o_orderdate < TIMESTAMP '2001-01-01'
  UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern-mismatch', 'error' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')"""


def _order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").withColumn("clerk", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return _issues(orders, "o_orderkey", ORDER_SCHEMA)


@query(_ORDER_ISSUES)
def field_issues(spark, sf_dir):
    return _order_issues(spark, sf_dir)


@query("SELECT o_orderkey, 'note' AS field, 'required-missing' AS error_type, 'error' AS level FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT')")
def field_required(spark, sf_dir):
    """Null and empty values are missing; zero is not."""
    note = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).when(F.col("o_orderpriority") == "1-URGENT", "").otherwise("x")
    df = _t(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), F.lit(0).alias("zero"))
    return _issues(df, "o_orderkey", {"note": {"required": True, "pattern": "x"}, "zero": {"required": True}})


@query("""
  SELECT l_orderkey, l_linenumber, 'price' AS field, 'type-mismatch' AS error_type FROM lineitem WHERE l_extendedprice <> floor(l_extendedprice)
  UNION ALL SELECT l_orderkey, l_linenumber, 'flag', 'type-mismatch' FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'at', 'type-mismatch' FROM lineitem WHERE l_linenumber > 3
  UNION ALL SELECT l_orderkey, l_linenumber, 'stamp', 'type-mismatch' FROM lineitem WHERE l_linenumber = 2""")
def field_types(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"),
        F.format_string("%02d:30", F.col("l_linenumber") + 20).alias("at"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.when(F.col("l_linenumber") == 2, "").otherwise("T10:00:00Z")).alias("stamp"), F.col("l_shipdate").alias("ship"),
    )
    source = Fields.of_table(df)
    schema = {"price": {"type": "integer"}, "flag": {"type": "boolean"}, "qty": {"type": "integer"}, "at": {"type": "time"}, "stamp": {"type": "datetime"}, "ship": {"type": "date"}}
    found, _ = fields.field_issues(schema, source)
    return issues.exploded(df, ["l_orderkey", "l_linenumber"], issues.gathered(found)).select("l_orderkey", "l_linenumber", "field", "error_type")


@query("SELECT p_type, 'brands' AS field, 'unique-violation' AS error_type, 'error' AS level FROM part GROUP BY p_type HAVING count(*) > count(DISTINCT p_brand)")
def field_unique_items(spark, sf_dir):
    df = _t(spark, sf_dir, "part").groupBy("p_type").agg(F.collect_list("p_brand").alias("brands"))
    return _issues(df, "p_type", {"brands": {"type": "array", "uniqueItems": True}})


@query("SELECT l_orderkey, l_linenumber, 'parts/part-' || l_partkey || '.md' AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def field_exists(spark, sf_dir):
    """References to paths that are not in the inventory: an anti join."""
    known = _t(spark, sf_dir, "part").where("p_size > 10").select(F.format_string("parts/part-%d.md", "p_partkey").alias("path"))
    refs = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("parts/part-%d.md", "l_partkey").alias("ref"))
    return fields.missing_paths(refs, known, "ref").select("l_orderkey", "l_linenumber", "ref")


@query("""SELECT event_id, f.field, 'undeclared-field' AS error_type, 'error' AS level FROM events,
  LATERAL (SELECT unnest(CASE WHEN event_type = 'error' THEN ['code'] WHEN event_type = 'purchase' THEN ['k', 'amount'] ELSE ['k'] END) AS field) f WHERE f.field NOT IN ('k')""")
def field_strict(spark, sf_dir):
    """Keys of a JSON object that the schema does not declare."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    df = _t(spark, sf_dir, "events").select("event_id", F.when(kind != "error", k).alias("k"), F.when(kind == "error", k).alias("code"), F.when(kind == "purchase", F.col("value")).alias("amount"))
    return _issues(df, "event_id", {"k": {"type": "string"}}, strict=True, columns=["k", "code", "amount"])


@query("SELECT l_orderkey, l_linenumber, 'formula-violation' AS error_type FROM lineitem WHERE NOT (l_extendedprice * (1 - l_discount) / (l_quantity - 7.0) >= 2000) OR l_quantity - 7.0 = 0 AND l_extendedprice * (1 - l_discount) = 0")
def formula_rule(spark, sf_dir):
    """Arithmetic over fields; a division by zero gives an infinity, which is at least any bound."""
    df = _t(spark, sf_dir, "lineitem")
    node = expressions.parse_formula("l_extendedprice * (1 - l_discount) / (l_quantity - 7) >= 2000")
    return df.where(expressions.formula_violated(node, Fields.of_table(df).value)).select("l_orderkey", "l_linenumber", F.lit("formula-violation").alias("error_type"))


ORACLES["formula_rule"] = "SELECT l_orderkey, l_linenumber, 'formula-violation' AS error_type FROM lineitem WHERE CASE WHEN l_quantity = 7 THEN l_extendedprice * (1 - l_discount) <= 0 ELSE l_extendedprice * (1 - l_discount) / (l_quantity - 7) < 2000 END"


@query("SELECT o_orderkey, (o_orderstatus IN ('F','P') AND o_orderpriority NOT IN ('1-URGENT')) OR o_orderpriority IN ('5-LOW') AS holds FROM orders")
def condition_gate(spark, sf_dir):
    df = _t(spark, sf_dir, "orders")
    node = expressions.parse_condition("""o_orderstatus in ['F', "P"] and o_orderpriority not in ['1-URGENT'] or o_orderpriority in ['5-LOW'] or missing.field in ['x'] or o_totalprice in ['1']""")
    return df.select("o_orderkey", expressions.condition_column(node, Fields.of_table(df).value).alias("holds"))


@query("SELECT * FROM (VALUES ('a', 1), ('b', 1), ('c', 1), ('d', 1), ('e', 1), ('f', 2), ('g', 1)) t(field, n)")
def schema_check(spark, sf_dir):
    """Problems of a schema itself."""
    schema = {"a": {"typ": "string"}, "b": {"type": "strin"}, "c": {"min": 3}, "d": {"pattern": "("}, "e": {"required": {"when": "x = 3"}}, "f": {"enum": "x", "before": "2020-01-01"}, "g": "x", "h": {"type": "date", "before": {"value": "2020-01-01", "severity": "warning"}}}
    rows = [(p["field"],) for p in fields.check_schema(schema)]
    return spark.createDataFrame(rows, "field string").groupBy("field").agg(F.count("*").cast("int").alias("n"))


# --- checks of any document ----------------------------------------------------------------------------------------


@query("""SELECT c_custkey, 'filename' AS field FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'folder' FROM customer WHERE c_custkey % 3 = 0""")
def slug_issues(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("customer-"), F.col("c_custkey")))
    path = F.concat(F.when(F.col("c_custkey") % 3 == 0, "My People/").otherwise("people/"), name, F.lit(".md"))
    df = _t(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
    return issues.exploded(df, ["c_custkey"], validators.slug_issues(F.col("path"))).select("c_custkey", "field")


@query("""SELECT c_custkey, 'customer' || substr(c_name, 10) || '-' || lower(c_mktsegment) AS slug FROM customer""")
def slug_suggestions(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", text.suggest_slug(F.concat("c_name", F.lit("_"), "c_mktsegment")).alias("slug"))


@query("SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS heading, replace(p_name, ' ', '-') AS slug FROM part")
def heading_slugs(spark, sf_dir):
    slug = text.heading_to_slug(F.col("p_name"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.slug_to_heading(slug).alias("heading"), slug.alias("slug"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'gone' WHEN o_orderstatus = 'F' THEN 'prefix' ELSE 'suffix' END AS problem FROM orders WHERE o_orderkey % 4 <> 0")
def template_field(spark, sf_dir):
    good = F.col("o_orderkey") % 4 == 0
    template = F.when(good, "templates/x.md").when(F.col("o_orderstatus") == "O", F.lit(None)).when(F.col("o_orderstatus") == "F", "x.md").otherwise("templates/x.txt")
    found = _t(spark, sf_dir, "orders").select("o_orderkey", validators.template_field_issue(template).alias("i")).where("i is not null")
    m = F.col("i.message")
    return found.select("o_orderkey", F.when(m.contains("missing"), "gone").when(m.contains("Not below"), "prefix").otherwise("suffix").alias("problem"))


@query("SELECT o_orderkey, k.field FROM orders, LATERAL (SELECT unnest(CASE WHEN o_orderstatus = 'F' THEN ['strict', 'tier'] WHEN o_orderstatus = 'O' THEN ['fields'] ELSE [] END) AS field) k WHERE o_orderkey % 2 = 0")
def leaked_keys(spark, sf_dir):
    keys = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("tier"), F.lit("title"), F.lit("strict"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("fields"))).otherwise(F.array(F.lit("title")))
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "docs/").otherwise("a/templates/"), F.col("o_orderkey"), F.lit(".md"))
    df = _t(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), keys.alias("keys"))
    return issues.exploded(df, ["o_orderkey"], validators.leaked_keys(F.col("path"), F.col("keys"))).select("o_orderkey", "field")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END || ' relative path(s) in the body' AS message FROM orders WHERE o_orderkey % 2 = 0")
def relative_references(spark, sf_dir):
    """Quoted relative paths outside code, counted."""
    k = F.col("o_orderkey")
    source = F.concat(F.lit("`'../inline'`\n```\n\"./fenced\"\n```\n    './indented'\nText "), F.when(k % 2 == 0, "\"../a.md\" ").otherwise("'/a.md' "), F.when((k % 2 == 0) & (k % 3 == 0), "'./b.md'").otherwise(""))
    df = _t(spark, sf_dir, "orders").select("o_orderkey", validators.relative_reference_issue(source).alias("i"))
    return df.where("i is not null").select("o_orderkey", F.col("i.message").alias("message"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'order' WHEN o_orderstatus = 'F' THEN 'invoice' ELSE 'unknown' END AS doc_type FROM orders")
def document_types(spark, sf_dir):
    s = F.col("o_orderstatus")
    return _t(spark, sf_dir, "orders").select("o_orderkey", validators.document_type(F.when(s == "O", "order"), F.when(s == "F", "templates/finance/invoice-template.md")).alias("doc_type"))


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS matched FROM orders")
def glob_match(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    path = F.when(k == 0, "archive/x/y.md").when(k == 1, "notes/a.draft.md").when(k == 2, "notes/deep/a.draft.md").when(k == 3, "notes/a.md").otherwise("archives/x.md")
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.matches_glob(path, ["archive/**", "notes/*.draft.md"]).alias("matched"))


# --- results and summaries -----------------------------------------------------------------------------------------

_COUNTS = f"SELECT o.o_orderkey, o_orderstatus, o.o_orderkey % 10 = 0 AS skipped, count(*) FILTER (WHERE level = 'error') AS n_errors, count(*) FILTER (WHERE level = 'warning') AS n_warnings FROM orders o LEFT JOIN ({_ORDER_ISSUES}) i ON o.o_orderkey = i.o_orderkey GROUP BY o.o_orderkey, o_orderstatus"


def _results(spark, sf_dir):
    docs = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 10 == 0).alias("skipped"))
    return reports.results(docs, _order_issues(spark, sf_dir), "o_orderkey")


@query(f"SELECT o_orderkey, n_errors, n_warnings, n_errors = 0 AS valid FROM ({_COUNTS})")
def validation_results(spark, sf_dir):
    return _results(spark, sf_dir).select("o_orderkey", "n_errors", "n_warnings", "valid")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE NOT skipped AND n_errors = 0) AS valid, count(*) FILTER (WHERE NOT skipped AND n_errors > 0) AS invalid, CAST(sum(n_errors) AS BIGINT) AS errors, CAST(sum(n_warnings) AS BIGINT) AS warnings FROM ({_COUNTS})")
def validation_summary(spark, sf_dir):
    return reports.summary(_results(spark, sf_dir))


@query(f"""WITH r AS ({_COUNTS}) SELECT 'doc_type' AS dimension, o_orderstatus AS name, count(*) AS total, count(*) FILTER (WHERE n_errors = 0) AS valid, count(*) FILTER (WHERE n_errors > 0) AS invalid FROM r GROUP BY o_orderstatus
  UNION ALL SELECT 'folder', 'docs/' || lower(o_orderstatus) || '/' || o_orderkey % 2, count(*), count(*) FILTER (WHERE n_errors = 0), count(*) FILTER (WHERE n_errors > 0) FROM r GROUP BY 2""")
def summary_groups(spark, sf_dir):
    path = F.concat(F.lit("docs/"), F.lower("o_orderstatus"), F.lit("/"), (F.col("o_orderkey") % 2).cast("string"), F.lit("/deep/x.md"))
    return reports.grouped(_results(spark, sf_dir), F.col("o_orderstatus"), path)


@query(f"SELECT field || ': ' || error_type AS kind, count(*) AS n FROM ({_ORDER_ISSUES}) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def common_issues(spark, sf_dir):
    found = _order_issues(spark, sf_dir).withColumns({"message": F.concat("error_type", F.lit(": more")), "seq": F.concat("field", F.lit(": "), "error_type")})
    return reports.common_issues(found, 5)


# --- measures ------------------------------------------------------------------------------------------------------

_TEMPLATES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
_DRIFT_SCHEMAS = {t: {"status": {"enum": ["O", "F"]}, "clerk": {"required": True}, "mixed": {"type": "string"}} for t in _TEMPLATES}
_DRIFT_ROWS = "SELECT o_orderpriority AS template, o_orderstatus AS status, CASE WHEN o_custkey % 5 > 0 THEN 'c' END AS clerk, o_orderkey % 4 AS mixed FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM')"
_DRIFT_SQL = f"""WITH d AS ({_DRIFT_ROWS}), t AS (SELECT template, count(*) AS n FROM d GROUP BY 1),
  s AS (SELECT template, status, count(*) AS c FROM d GROUP BY 1, 2)
  SELECT template, 'status' AS field, n AS total, n AS present, (SELECT count(*) FROM s WHERE s.template = t.template) AS distinct_values,
    round((SELECT sum(c) FROM s WHERE s.template = t.template AND status NOT IN ('O','F')) / n, 9) AS drift_score,
    round((SELECT -sum(c / n * log2(c / n)) / log2(count(*)) FROM s WHERE s.template = t.template), 9) AS entropy_norm FROM t
  UNION ALL SELECT template, 'clerk', count(*), count(clerk), count(DISTINCT clerk), round(1 - count(clerk) / count(*), 9), NULL FROM d GROUP BY 1
  UNION ALL SELECT template, 'mixed', count(*), count(*) FILTER (WHERE mixed < 3), count(DISTINCT mixed) FILTER (WHERE mixed < 3),
    round(1 - greatest(count(*) FILTER (WHERE mixed < 2), count(*) FILTER (WHERE mixed = 2)) / count(*) FILTER (WHERE mixed < 3), 9), NULL FROM d GROUP BY 1"""


def _drift(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    value = lambda t, s, n: F.struct(F.lit(t).alias("t"), s.alias("s"), n.alias("n"), F.lit(None).cast("array<string>").alias("a"))
    none = F.lit(None).cast("double")
    fm = F.map_from_arrays(
        F.array(F.lit("status"), F.lit("clerk"), F.lit("mixed")),
        F.array(value("string", F.col("o_orderstatus"), none), F.when(F.col("o_custkey") % 5 > 0, value("string", F.lit("c"), none)), F.when(k < 2, value("string", k.cast("string"), none)).when(k == 2, value("number", F.lit("2"), F.lit(2.0)))),
    )
    docs = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("template"), fm.alias("fm"))
    return entropy.field_values(docs, _DRIFT_SCHEMAS, Fields(map_column="fm"))


@query(_DRIFT_SQL)
def schema_drift(spark, sf_dir):
    found = entropy.schema_drift(_drift(spark, sf_dir))
    return found.select("template", "field", "total", "present", "distinct_values", F.round("drift_score", 9).alias("drift_score"), F.round("entropy_norm", 9).alias("entropy_norm"))


@query(f"SELECT round(avg(drift_score), 7) AS global_drift_score FROM ({_DRIFT_SQL})")
def global_schema_drift(spark, sf_dir):
    return entropy.global_schema_drift(entropy.schema_drift(_drift(spark, sf_dir))).select(F.round("global_drift_score", 7).alias("global_drift_score"))


@query("SELECT o_orderpriority AS template, 'status' AS field, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') GROUP BY ALL")
def value_histogram(spark, sf_dir):
    return entropy.value_histogram(_drift(spark, sf_dir)).where("field = 'status'")


_TERMS = """SELECT CASE p_partkey % 4 WHEN 0 THEN upper(w) WHEN 1 THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END AS term
  FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)"""
_USES = f"SELECT term, lower(term) AS key, count(*) AS uses FROM ({_TERMS}) GROUP BY ALL"


def _terms(spark, sf_dir):
    words = _t(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    k = F.col("p_partkey") % 4
    term = F.when(k == 0, F.upper("w")).when(k == 1, F.concat(F.upper(F.substring("w", 1, 1)), F.substr("w", F.lit(2)))).otherwise(F.col("w"))
    return entropy.term_uses(words.select(F.lit("tag").alias("kind"), term.alias("term")))


@query(f"""SELECT key, (SELECT term FROM ({_USES}) x WHERE x.key = u.key ORDER BY uses DESC, length(term), term LIMIT 1) AS canonical,
  CAST(sum(uses) AS BIGINT) AS total_uses, CAST(sum(uses) - max(uses) AS BIGINT) AS redundant_uses, count(*) - 1 AS fragmentation FROM ({_USES}) u GROUP BY key HAVING count(*) > 1""")
def vocabulary_clusters(spark, sf_dir):
    return entropy.vocabulary_clusters(_terms(spark, sf_dir)).select("key", "canonical", "total_uses", "redundant_uses", "fragmentation")


@query(f"SELECT CAST(sum(u) AS BIGINT) AS total_uses, CAST(sum(u - m) AS BIGINT) AS redundant_uses, round(sum(u - m) / sum(u), 9) AS drift_score FROM (SELECT sum(uses) AS u, max(uses) AS m FROM ({_USES}) GROUP BY key)")
def vocabulary_drift(spark, sf_dir):
    return entropy.vocabulary_drift(_terms(spark, sf_dir)).withColumn("drift_score", F.round("drift_score", 9))


@query("""WITH n AS (SELECT DISTINCT p_name AS t FROM part)
  SELECT a.t AS term_a, b.t AS term_b, round(levenshtein(lower(a.t), lower(b.t)) / greatest(length(a.t), length(b.t)), 9) AS distance FROM n a JOIN n b ON a.t < b.t
  WHERE lower(a.t) <> lower(b.t) AND levenshtein(lower(a.t), lower(b.t)) / greatest(length(a.t), length(b.t)) <= 0.2""")
def fuzzy_pairs(spark, sf_dir):
    """Near terms of part names."""
    names = _t(spark, sf_dir, "part").select(F.col("p_name").alias("term"))
    return entropy.fuzzy_pairs(names, 0.2).withColumn("distance", F.round("distance", 9))


@query()
def fuzzy_groups(spark, sf_dir):
    uses = entropy.term_uses(_t(spark, sf_dir, "part").select(F.lit("tag").alias("kind"), F.col("p_name").alias("term")))
    return entropy.fuzzy_groups(uses, entropy.fuzzy_pairs(uses, 0.2))


_NOW = "2024-02-15 12:00:00"
_CYCLE = {"default": {"stale_after_days": 17, "zombie_after_days": 16, "orphan_grace_days": 40, "zombie_status_set": ["purchase", "error"]}, "perTemplate": {"u1": {"stale_after_days": 20, "zombie_status_set": []}}}
_CYCLE_SQL = f"""WITH u AS (SELECT user_id, max(ts) AS mtime, min(ts) AS created_at, arg_max(event_type, event_id) AS status, count(*) FILTER (WHERE event_type = 'click') // 40 AS incoming FROM events GROUP BY user_id),
  d AS (SELECT *, floor((epoch_ms(TIMESTAMP '{_NOW}') - epoch_ms(mtime)) / 86400000) AS idle, floor((epoch_ms(TIMESTAMP '{_NOW}') - epoch_ms(created_at)) / 86400000) AS age, user_id % 2 = 1 AS own FROM u)
  SELECT user_id, CAST(idle AS BIGINT) AS days_idle, CAST(age AS BIGINT) AS days_since_created, idle > CASE WHEN own THEN 20 ELSE 17 END AS stale, incoming = 0 AND age > 40 AS orphan, NOT own AND status IN ('purchase','error') AND idle > 16 AS zombie FROM d"""


def _cycle(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    users = e.groupBy("user_id").agg(F.max("ts").alias("mtime"), F.min("ts").alias("created_at"), F.max_by("event_type", "event_id").alias("status"), F.floor(F.count_if(F.col("event_type") == "click") / 40).cast("long").alias("incoming"))
    docs = users.select("user_id", F.col("user_id").cast("string").alias("path"), F.when(F.col("user_id") % 2 == 1, "u1").otherwise("u0").alias("template"), "status", "mtime", "created_at", "incoming")
    counts = docs.where("incoming > 0").select("path", "incoming")
    return entropy.lifecycle(docs.drop("incoming"), _CYCLE, F.lit(_NOW).cast("timestamp"), counts)


@query(_CYCLE_SQL)
def lifecycle(spark, sf_dir):
    return _cycle(spark, sf_dir).select("user_id", F.col("days_idle").cast("long").alias("days_idle"), F.col("days_since_created").cast("long").alias("days_since_created"), "stale", "orphan", "zombie")


@query(f"SELECT count(*) AS documents, count(*) FILTER (WHERE stale) AS n_stale, count(*) FILTER (WHERE orphan) AS n_orphan, count(*) FILTER (WHERE zombie) AS n_zombie, round(count(*) FILTER (WHERE stale OR orphan OR zombie) / count(*), 9) AS decay_score FROM ({_CYCLE_SQL})")
def decay_score(spark, sf_dir):
    return entropy.decay_score(_cycle(spark, sf_dir)).withColumn("decay_score", F.round("decay_score", 9))


_GINI = "SELECT count(*) AS groups, CAST(sum(n) AS DOUBLE) AS total, sum(n * (2 * r - k - 1)) / (k * sum(n)) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS k FROM (SELECT {c} AS value, count(*) AS n FROM {t} GROUP BY 1)) GROUP BY k"


@query("SELECT groups, total, round(gini, 9) AS gini FROM (" + _GINI.format(c="o_custkey", t="orders") + ")")
def gini(spark, sf_dir):
    return entropy.gini(entropy.usage(_t(spark, sf_dir, "orders"), "o_custkey"), "n").select("groups", "total", F.round("gini", 9).alias("gini"))


@query("SELECT " + ", ".join(f"(SELECT CASE WHEN gini < 0.3 THEN 'flat' WHEN gini > 0.7 THEN 'monoculture' ELSE 'healthy_pareto' END FROM ({_GINI.format(c=c, t=t)})) AS {n}" for c, t, n in (("source", "documents", "sources"), ("lang", "documents", "langs"), ("o_custkey", "orders", "customers"))))
def usage_verdicts(spark, sf_dir):
    out = None
    for c, t, n in (("source", "documents", "sources"), ("lang", "documents", "langs"), ("o_custkey", "orders", "customers")):
        one = entropy.gini(entropy.usage(_t(spark, sf_dir, t), c), "n").select(entropy.usage_verdict(F.col("groups"), F.col("gini")).alias(n))
        out = one if out is None else out.join(one, F.lit(True))  # single rows
    return out


@query("WITH g AS (" + _GINI.format(c="lang", t="documents") + ") SELECT round(least(1.0, greatest(0.0, greatest(0.0, 0.3 - gini) + greatest(0.0, gini - 0.7) + (SELECT count(*) FILTER (WHERE doc_id % 10 = 0) / count(*) FROM documents) + greatest(0.0, 0.55 - 0.4))), 9) AS distribution_score FROM g")
def distribution_score(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    bare = docs.agg((F.count_if(F.col("doc_id") % 10 == 0) / F.count("*")).alias("bare"))
    g = entropy.gini(entropy.usage(docs, "lang"), "n")
    return g.join(bare, F.lit(True)).select(F.round(entropy.distribution_score(F.col("gini"), F.col("bare"), F.lit(0.55)), 9).alias("distribution_score"))


@query()
def compression_ratio(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return entropy.compression(orders.select("o_orderkey", F.to_json(F.struct("*")).alias("j")), "j", "o_orderkey")


_ENTRIES = "SELECT event_type AS template, f.field, CASE f.field WHEN 'band' THEN CAST(event_id % 3 AS VARCHAR) ELSE 'v' || event_id END AS value, event_id AS ord FROM events, LATERAL (SELECT unnest(['k', CASE WHEN event_id % 2 = 0 THEN 'band' ELSE 'tag' END]) AS field) f"


def _entries(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    f = F.explode(F.array(F.lit("k"), F.when(F.col("event_id") % 2 == 0, "band").otherwise("tag")))
    rows = e.select(F.col("event_type").alias("template"), f.alias("field"), F.col("event_id").alias("ord"))
    value = F.when(F.col("field") == "band", (F.col("ord") % 3).cast("string")).otherwise(F.concat(F.lit("v"), F.col("ord")))
    totals = e.groupBy(F.col("event_type").alias("template")).agg(F.count("*").alias("total_docs"))
    declared = e.select(F.col("event_type").alias("template"), F.lit("k").alias("field")).distinct()
    return rows.withColumn("value", value), totals, declared


@query(f"""WITH e AS (SELECT * FROM ({_ENTRIES}) WHERE field <> 'k'), t AS (SELECT event_type AS template, count(*) AS total_docs FROM events GROUP BY 1),
  v AS (SELECT template, field, value, count(*) AS n, min(ord) AS first FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY template, field ORDER BY first) AS r FROM v)
  SELECT r.template, field, CAST(sum(n) AS BIGINT) AS appearances, total_docs, string_agg(value, ',' ORDER BY r) FILTER (WHERE r <= 10) AS samples, round(sum(n) / total_docs, 9) AS promote_confidence,
    CASE WHEN count(*) / sum(n) < 0.5 THEN 'enum' ELSE 'string' END AS suggested_primitive FROM r JOIN t ON r.template = t.template WHERE total_docs >= 300 GROUP BY r.template, field, total_docs HAVING sum(n) / total_docs > 0.3""")
def field_emergence(spark, sf_dir):
    rows, totals, declared = _entries(spark, sf_dir)
    out = entropy.field_candidates(rows, totals, declared, 0.3, 300)
    return out.select("template", "field", "appearances", "total_docs", F.array_join("value_samples", ",").alias("samples"), F.round("promote_confidence", 9).alias("promote_confidence"), "suggested_primitive")


@query("""WITH t AS (SELECT o_orderpriority AS template, count(*) AS total_docs FROM orders GROUP BY 1)
  SELECT t.template, l_returnflag AS heading, count(*) AS appearances, total_docs, round(count(*) / total_docs, 9) AS promote_confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN t ON o_orderpriority = t.template
  WHERE l_returnflag <> 'N' GROUP BY t.template, l_returnflag, total_docs HAVING count(*) / total_docs > 0.3""")
def section_emergence(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("template"))
    headings = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("heading")).join(orders, "o_orderkey").select("template", "heading")
    totals = orders.groupBy("template").agg(F.count("*").alias("total_docs"))
    declared = totals.select("template", F.lit("N").alias("heading"))
    return entropy.section_candidates(headings, totals, declared, 0.3, 10).withColumn("promote_confidence", F.round("promote_confidence", 9))


_SCORES = "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 100) / 100.0::DOUBLE END AS s, CASE WHEN c_custkey % 4 > 1 THEN (c_custkey % 37) / 37.0::DOUBLE END AS v, CASE WHEN c_custkey % 4 > 2 THEN 0.5::DOUBLE END AS l FROM customer"


@query(f"SELECT c_custkey, CAST(floor(100 - s * 100 + 0.5) AS BIGINT) AS schema_health, CASE WHEN c_custkey % 4 > 0 THEN CAST(floor((coalesce((100 - s * 100) * 0.3, 0) + coalesce((100 - v * 100) * 0.25, 0) + coalesce((100 - l * 100) * 0.3, 0)) / (CASE WHEN s IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN v IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN l IS NULL THEN 0 ELSE 0.3::DOUBLE END) + 0.5) AS BIGINT) END AS overall FROM ({_SCORES})")
def overall_scores(spark, sf_dir):
    k = F.col("c_custkey")
    df = _t(spark, sf_dir, "customer").select(k, F.when(k % 4 > 0, (k % 100) / 100.0).alias("s"), F.when(k % 4 > 1, (k % 37) / 37.0).alias("v"), F.when(k % 4 > 2, F.lit(0.5)).alias("l"), F.lit(None).cast("double").alias("d"))
    chaos = {"schema": F.col("s"), "vocab": F.col("v"), "lifecycle": F.col("l"), "distribution": F.col("d")}
    return df.select("c_custkey", entropy.health(F.col("s")).alias("schema_health"), entropy.overall_score(chaos, entropy.settings()["weights"]).alias("overall"))


@query("""SELECT user_id, ts, event_id - lag(event_id) OVER w AS d_overall, CAST(floor((epoch_ms(ts) - lag(epoch_ms(ts)) OVER w) / 86400000) AS BIGINT) AS days,
  CASE WHEN value >= 80 THEN 'healthy' WHEN value >= 60 THEN 'moderate' ELSE 'degraded' END AS verdict FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def snapshot_deltas(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("ts").alias("measured_at"), F.col("event_id").alias("overall"), "value")
    return snapshots.deltas(e, ["user_id"]).select("user_id", F.col("measured_at").alias("ts"), "d_overall", F.col("days").cast("long").alias("days"), snapshots.verdict(F.col("value")).alias("verdict"))


# --- links and look-ups --------------------------------------------------------------------------------------------


def _hrefs(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href"))
    return pages.select(F.concat(F.lit("site/pages/"), F.col("page_id"), F.lit(".md")).alias("src"), F.col("href").alias("target_raw"), F.lit(1).alias("line"))


_HREFS = """SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages"""


@query(f"SELECT substr(href, 2) AS path, count(*) AS incoming FROM ({_HREFS}) WHERE length(href) > 1 GROUP BY 1")
def incoming_links(spark, sf_dir):
    return graph.incoming_counts(graph.resolved(_hrefs(spark, sf_dir)), documents_only=False)


@query(f"""SELECT target, src, count(*) AS n FROM (SELECT substr(href, 2) AS target, 'site/pages/' || page_id || '.md' AS src FROM ({_HREFS}) WHERE length(href) > 1) GROUP BY ALL""")
def backlinks(spark, sf_dir):
    return graph.backlinks(graph.resolved(_hrefs(spark, sf_dir))).groupBy("target", "src").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT 'site/pages/' || page_id || '.md' AS src, substr(href, 2) AS target FROM ({_HREFS}) WHERE length(href) > 1 AND lower(substr(href, 2)) NOT IN (SELECT DISTINCT lower(w) FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark))")
def broken_links(spark, sf_dir):
    links = graph.resolved(_hrefs(spark, sf_dir)).withColumn("target", F.lower("target"))
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(F.lower("w").alias("path"))
    return graph.broken(links, words).select("src", "target").distinct()


ORACLES["broken_links"] = ORACLES["broken_links"].replace("substr(href, 2) AS target FROM", "lower(substr(href, 2)) AS target FROM")


@query("SELECT o_orderkey, '../customers/customer-' || o_custkey || '.md' AS target_raw, 'docs/customers/customer-' || o_custkey || '.md' AS target FROM orders")
def markdown_links(spark, sf_dir):
    links = graph.markdown_links(testbed.order_documents(spark, sf_dir))
    return links.select(F.regexp_extract("src", r"order-(\d+)", 1).cast("long").alias("o_orderkey"), "target_raw", "target")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%r#00000001%' OR lower(c_mktsegment) LIKE '%r#00000001%' ORDER BY c_custkey LIMIT 50")
def search(spark, sf_dir):
    return graph.search(_t(spark, sf_dir, "customer"), "R#00000001", ["c_name", "c_mktsegment"], ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT 'docs/prd-12-x.md' AS path, 'prd-12' AS id")
def resolve_id(spark, sf_dir):
    parts = _t(spark, sf_dir, "part")
    entries = parts.select(F.concat(F.lit("docs/prd-"), F.col("p_partkey"), F.lit("-x.md")).alias("path"), F.concat(F.lit("prd-"), F.col("p_partkey")).alias("id"))
    return graph.resolve_id(entries, "prd-12").select("path", "id")


@query("SELECT 'parts/' || lower(p_type) || '/' || p_partkey || '.md' AS path, p_type = 'SMALL' AS same_folder FROM part ORDER BY p_type = 'SMALL' DESC, 'parts/' || lower(p_type) || '/' || p_partkey || '.md' LIMIT 200")
def link_completion(spark, sf_dir):
    paths = _t(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey"), F.lit(".md")).alias("path"))
    return graph.complete(paths, "parts/small")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/' || p_partkey || '.md' WHEN 1 THEN 'a/b/c/' || p_partkey || '.md' WHEN 2 THEN p_partkey || '.md' END AS resolved FROM part")
def path_resolution(spark, sf_dir):
    k = F.col("p_partkey") % 4
    ref = F.concat(F.when(k == 0, "../../").when(k == 1, "./c/").when(k == 2, "/").otherwise("../../../../"), F.col("p_partkey"), F.lit(".md"))
    folder = F.when(k == 0, "a/x/y").otherwise("a/b")
    return _t(spark, sf_dir, "part").select("p_partkey", text.resolve_path(folder, ref).alias("resolved"))


# --- rendered documents --------------------------------------------------------------------------------------------


def _raw(spark, sf_dir):
    return testbed.order_documents(spark, sf_dir)


def _templates():
    return {testbed.TEMPLATE_PATH: body.load_template(testbed.TEMPLATE_PATH, testbed.TEMPLATE)}


def _key(path="path"):
    return F.regexp_extract(path, r"order-(\d+)", 1).cast("long").alias("o_orderkey")


_ITEMS = "(SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'partial' END AS status, round(o_totalprice, 2) AS total, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS placed, CASE WHEN o_custkey % 3 <> 0 THEN 'person-' || o_custkey END AS reviewer FROM orders")
def parse_front_matter(spark, sf_dir):
    get = lambda k: F.try_element_at("fm", F.lit(k))
    return markdown.parse_documents(_raw(spark, sf_dir), columns=("path", "fm")).select(_key(), get("status")["s"].alias("status"), F.round(get("total")["n"], 2).alias("total"), get("placed")["s"].alias("placed"), get("reviewer")["s"].alias("reviewer"))


@query(f"""WITH d AS (SELECT o_orderkey, n, o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AS out FROM orders LEFT JOIN {_ITEMS} ON l_orderkey = o_orderkey)
  SELECT o_orderkey, '# Order' AS heading_path, 1 AS depth FROM d UNION ALL SELECT o_orderkey, '# Order › ## Summary', 2 FROM d UNION ALL SELECT o_orderkey, '# Order › ## Items', 2 FROM d WHERE n IS NOT NULL
  UNION ALL SELECT o_orderkey, '# Order › ## Parts', 2 FROM d WHERE n IS NOT NULL UNION ALL SELECT o_orderkey, '# Order › ## Outcome', 2 FROM d WHERE out""")
def section_tree(spark, sf_dir):
    return body.sections(_raw(spark, sf_dir)).select(_key(), "heading_path", "depth")


@query("SELECT l_orderkey AS o_orderkey, 'line' AS header, CAST(l_linenumber AS VARCHAR) AS cell FROM lineitem UNION ALL SELECT l_orderkey, 'quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem UNION ALL SELECT l_orderkey, 'flag', l_returnflag FROM lineitem")
def table_cells(spark, sf_dir):
    return body.table_cells(body.blocks(_raw(spark, sf_dir), ("table",))).select(_key(), "header", "cell")


@query("SELECT o_orderkey, 'json' AS lang, '# {}' AS value FROM orders")
def code_fences(spark, sf_dir):
    return body.blocks(_raw(spark, sf_dir), ("code",)).select(_key(), "lang", "value")


_BODY_SQL = f"""
  WITH d AS (SELECT * FROM orders LEFT JOIN {_ITEMS} ON l_orderkey = o_orderkey),
  s AS (SELECT l_orderkey, l_suppkey % 10 AS p, count(*) AS c FROM lineitem GROUP BY ALL), q AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)
  SELECT o_orderkey, 'required-missing' AS error_type, CAST(CASE WHEN n IS NULL THEN 1 ELSE 0 END + CASE WHEN o_orderstatus IN ('F','P') AND NOT (o_orderstatus = 'F' AND o_orderkey % 5 <> 0) THEN 1 ELSE 0 END AS BIGINT) AS k FROM d
  UNION ALL SELECT o_orderkey, 'table-shape', CASE WHEN n < 2 OR n > 6 THEN 1 ELSE 0 END FROM d WHERE n IS NOT NULL
  UNION ALL SELECT o_orderkey, 'formula-violation', CASE WHEN o_totalprice < 40000 THEN 1 ELSE 0 END FROM d WHERE n IS NOT NULL
  UNION ALL SELECT l_orderkey, 'table-cell', CAST(sum(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END + CASE WHEN l_returnflag NOT IN ('A','N') THEN 1 ELSE 0 END) + (SELECT coalesce(sum(c - 1), 0) FROM q WHERE q.l_orderkey = lineitem.l_orderkey) AS BIGINT) FROM lineitem GROUP BY 1
  UNION ALL SELECT l_orderkey, 'unique-violation', CAST(sum(c - 1) AS BIGINT) FROM s GROUP BY 1"""


@query(f"SELECT * FROM ({_BODY_SQL}) WHERE k > 0")
def body_rules(spark, sf_dir):
    """Sections, tables, lists, code and formulas of rendered documents, judged by the template's rules."""
    template = body.load_template(testbed.TEMPLATE_PATH, testbed.TEMPLATE)
    found = body.body_issues(_raw(spark, sf_dir), {testbed.TEMPLATE_PATH: template})
    return found.groupBy(_key(), "error_type").agg(F.count("*").alias("k"))


_FRONT_SQL = """SELECT o_orderkey, 'min-violation' AS error_type, 'error' AS level FROM orders WHERE round(o_totalprice, 2) < 50000
  UNION ALL SELECT o_orderkey, 'after-violation', 'error' FROM orders WHERE NOT o_orderdate > TIMESTAMP '1995-06-01'
  UNION ALL SELECT o_orderkey, 'pattern-mismatch', 'error' FROM orders WHERE o_orderpriority > '4'
  UNION ALL SELECT o_orderkey, 'required-missing', 'warning' FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'undeclared-field', 'error' FROM orders WHERE o_orderkey % 7 = 0"""


@query(f"""SELECT o_orderkey, CAST(sum(CASE WHEN level = 'error' THEN k ELSE 0 END) AS BIGINT) AS n_errors, CAST(sum(CASE WHEN level = 'warning' THEN k ELSE 0 END) AS BIGINT) AS n_warnings, sum(CASE WHEN level = 'error' THEN k ELSE 0 END) = 0 AS valid
  FROM (SELECT o_orderkey, 'error' AS level, k FROM ({_BODY_SQL}) UNION ALL SELECT o_orderkey, level, 1 FROM ({_FRONT_SQL})) GROUP BY 1""")
def validate_documents(spark, sf_dir):
    """Every check on whole documents: front matter, body, path and links, one result row per document."""
    docs = validate.parsed(_raw(spark, sf_dir), _templates(), columns=validate.CHECKED)
    return validate.checked_results(docs, _templates()).select(_key(), "n_errors", "n_warnings", "valid")


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS changed FROM orders")
def format_documents(spark, sf_dir):
    """Canonical formatting: untidy documents change, formatted ones do not."""
    docs = testbed.order_documents(spark, sf_dir).withColumn("template", F.lit(testbed.TEMPLATE_PATH))
    first = rewrite.format_documents(docs, {testbed.TEMPLATE_PATH: ["summary", "items", "parts"]})
    untidy = first.select("path", F.lit(testbed.TEMPLATE_PATH).alias("template"), F.when(_key() % 2 == 0, F.concat("formatted", F.lit("\n\n\n\nx  \n"))).otherwise(F.col("formatted")).alias("text"))
    return rewrite.format_documents(untidy, {testbed.TEMPLATE_PATH: ["summary", "items", "parts"]}).select(_key(), "changed")


@query("SELECT o_orderkey, 'reviewer' AS field, 'insert_key' AS edit FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0")
def quick_fixes(spark, sf_dir):
    docs = validate.parsed(_raw(spark, sf_dir), _templates(), columns=validate.CHECKED)
    return rewrite.quick_fixes(validate.document_issues(docs, _templates())).select(_key(), "field", "edit")


@query("SELECT o_orderkey, 'seen @anna.x and @ann-x and @bob, @bob' AS new_text FROM orders WHERE o_orderkey % 3 = 0")
def rename_handle(spark, sf_dir):
    docs = _t(spark, sf_dir, "orders").select(F.format_string("order-%d.md", "o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 3 == 0, "seen @anna.x and @ann-x and @ann, @ann").otherwise("@anna").alias("text"))
    return rewrite.rename_handle(docs, "ann", "@bob").select(_key(), "new_text")


@query("SELECT o_orderkey, 'See [prd-77] and PRD-70; prd-77.' AS new_text FROM orders WHERE o_orderkey % 3 = 0")
def rename_id(spark, sf_dir):
    docs = _t(spark, sf_dir, "orders").select(F.format_string("order-%d.md", "o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 3 == 0, "See [PRD-7] and PRD-70; prd-7.").otherwise("PRD-71").alias("text"))
    return rewrite.rename_id(docs, "prd-7", "prd-77").select(_key(), "new_text")


@query("SELECT o_orderkey, '../people/c-1.md' AS link FROM orders WHERE o_custkey = 1")
def move_document(spark, sf_dir):
    """Links of all documents to one that moves."""
    docs = testbed.order_documents(spark, sf_dir)
    changed = rewrite.move_document(docs, graph.markdown_links(docs), "docs/customers/customer-1.md", "docs/people/c-1.md")
    return changed.select(_key(), F.regexp_extract("new_text", r"\]\(([^)]*)\)", 1).alias("link"))


@query(f"""SELECT o_orderkey, 'order' AS anchor FROM orders UNION ALL SELECT o_orderkey, 'summary' FROM orders
  UNION ALL SELECT l_orderkey, 'items' FROM {_ITEMS} UNION ALL SELECT l_orderkey, 'parts' FROM {_ITEMS} UNION ALL SELECT o_orderkey, 'outcome' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0""")
def heading_anchors(spark, sf_dir):
    return graph.anchors(body.sections(_raw(spark, sf_dir))).select(_key(), "anchor")


@query("""SELECT o_orderkey, 'order-' || o_orderkey AS id, 'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'partial' END AS status FROM orders""")
def index_entries(spark, sf_dir):
    return graph.index_entries(markdown.parse_documents(_raw(spark, sf_dir), columns=("path", "template", "fm", "body"))).select(_key(), "id", "title", "status")


@query("""SELECT l_orderkey, l_linenumber, 'relationships.uses[' || l_linenumber || '].path' AS field FROM lineitem WHERE l_partkey % 3 < 2""")
def relationship_issues(spark, sf_dir):
    """Relationships by relative paths."""
    start = F.when(F.col("l_partkey") % 3 == 0, "../parts/").when(F.col("l_partkey") % 3 == 1, "./").otherwise("/parts/")
    links = F.array(F.struct(F.lit("uses").alias("kind"), F.col("l_linenumber").alias("index"), F.concat(start, F.col("l_partkey"), F.lit(".md")).alias("path")))
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", links.alias("links"))
    return issues.exploded(df, ["l_orderkey", "l_linenumber"], validators.relationship_issues(F.col("links"))).select("l_orderkey", "l_linenumber", "field")


@query("SELECT 'img/' || CASE WHEN p_partkey % 2 = 0 THEN 'Part ' ELSE 'part-' END || p_partkey || '.png' AS path, CAST(1 AS BIGINT) AS n_errors, 'asset' AS doc_type FROM part WHERE p_partkey % 2 = 0")
def asset_results(spark, sf_dir):
    """Files that are no documents and whose names are no slugs."""
    name = F.concat(F.lit("img/"), F.when(F.col("p_partkey") % 2 == 0, "Part ").otherwise("part-"), F.col("p_partkey"), F.lit(".png"))
    return validate.asset_results(_t(spark, sf_dir, "part").select(name.alias("path"))).select("path", "n_errors", "doc_type")


# --- streams -------------------------------------------------------------------------------------------------------


@query("SELECT user_id AS key, max(event_id) AS version, arg_max(event_type, event_id) AS event FROM events GROUP BY 1")
def latest_events(spark, sf_dir):
    """The last event of each key, as a micro-batch reduces them."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("event"), F.col("props").alias("text"))
    return buffers.latest(e).select("key", "version", "event")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


