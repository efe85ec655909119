"""Markdown parsing, templates and whole-document checks."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import body, entropy, fences, fields, graph, rewrite, snapshots, validate
from scriptorium.plans import queries
from scriptorium.sources import markdown as m

TEMPLATE = """---
fields:
  title: {required: true, type: string, min: 3}
  status: {required: true, enum: [open, done]}
  rice.reach: {type: integer, min: 1}
  due: {type: date, required: {when: 'status in ["done"]', severity: warning}}
  at: {type: time, after: "09:00"}
  tags: {type: array, uniqueItems: true, max: 3}
  design: {exists: true}
---
# T
## Goals
```yaml section-rules
required: true
list: {min: 2, unique: true, items: {pattern: "^[A-Z]"}}
```
## Diagram
```yaml section-rules
mermaid: {min: 1}
gherkin: {min: 1}
```
### Case
```yaml section-rules
repeatable: true
min: 2
heading: {pattern: "^AC[0-9]+"}
```
"""
GOOD = """---
title: Good
template: templates/t-template.md
status: done
due: 2024-01-02
at: 10:30
tags: [a, b]
rice: {reach: 5}
design: docs/good.md
---
# T
## Goals
- One
- Two
## Diagram
```mermaid
graph TD
  A --> B
```
```gherkin
Feature: x
  Scenario: y
    Given z
```
### AC1 one
### AC2 two
"""
BAD = """---
title: x
template: templates/t-template.md
status: shut
at: 08:00
tags: [a, a, b, c]
rice: {reach: 0.5}
design: docs/none.md
tier: x
---
# T
## Goals
- One
- one
- One
## Diagram
```mermaid
grph TD
```
### Wrong
"""


@pytest.fixture(scope="module")
def templates():
    return {"templates/t-template.md": body.load_template("templates/t-template.md", TEMPLATE)}


def test_template_is_sound(templates):
    assert templates["templates/t-template.md"].problems == []


def test_document_checks(spark, templates):
    raw = spark.createDataFrame([("docs/good.md", GOOD), ("docs/Bad Name.md", BAD), ("docs/broken.md", "---\na: [\n---\n"), ("docs/empty.md", None), ("templates/t-template.md", TEMPLATE)], "path string, text string")
    docs = m.parse_documents(raw)
    paths = raw.select("path")
    found = validate.document_issues(docs, templates, paths)
    by = {}
    for r in found.collect():
        by.setdefault(r["path"], []).append((r["field"], r["error_type"], r["level"]))
    assert "docs/good.md" not in by
    bad = by["docs/Bad Name.md"]
    for want in [("title", "min-violation"), ("status", "enum-violation"), ("at", "after-violation"), ("tags", "unique-violation"), ("tags", "max-violation"), ("rice.reach", "type-mismatch"), ("rice.reach", "min-violation"), ("design", "exists-missing"), ("filename", None)]:
        assert any((f, t) == want for f, t, _ in bad), want
    kinds = [t for _, t, _ in bad]
    assert ("tier", None, "warning") in bad
    assert kinds.count("list-item") == 1 and "mermaid-syntax" in kinds and "gherkin-missing" in kinds and "cardinality" in kinds and "heading-mismatch" in kinds
    assert [f for f, _, _ in by["docs/broken.md"]] == [None]
    assert ("template", None, "error") in by["docs/empty.md"]
    results = {r["path"]: r for r in validate.document_results(docs, found).collect()}
    assert results["docs/good.md"]["valid"] and not results["docs/broken.md"]["valid"] and results["templates/t-template.md"]["skipped"]


def test_yaml_scalars():
    fm = m.load_yaml("a: yes\nb: 12:30\nc: 2024-01-02\nd: '2024-01-02'\ne: 5.0\nf: true\ng: ~\nh: 0x1F\ni: 1e3\nj: |\n  x\n  y\nk: '50'")
    t = {k: m.typed(v) for k, v in fm.items()}
    assert t["a"]["t"] == t["b"]["t"] == t["d"]["t"] == t["k"]["t"] == "string"
    assert t["c"]["t"] == "date" and t["e"]["s"] == "5" and t["f"]["s"] == "true" and t["g"] is None and t["h"]["n"] == 31 and t["i"]["n"] == 1000


def test_blocks():
    text = "Title\n=====\n\n# in `code` *x*\n\n```py\n# no heading\n```\n\n| A | B |\n|---|:-:|\n| 1 | a\\|b |\n| 2 |\n\n1. one\n2. two\n   - in\n\n- x\n\n> ## quoted\n"
    blocks = m.blocks_of(text)
    assert [(b.kind, b.depth, b.text) for b in blocks if b.kind == "heading"] == [("heading", 1, "Title"), ("heading", 1, "in code x")]
    table = next(b for b in blocks if b.kind == "table")
    assert table.headers == ["a", "b"] and table.rows == [["1", "a|b"], ["2"]] and table.line == 10
    assert [len(b.items) for b in blocks if b.kind == "list"] == [2, 1]
    assert m.rule_fences("> ```yaml section-rules\n> a: 1\n> ```\n\n```yaml  section-rules\n```\n```yaml\n```")[0][0] == 1


def test_sections_claimed_in_order():
    rules = body.body_rules("## A\n```yaml section-rules\nrequired: true\n```\n## A\n```yaml section-rules\nrequired: true\nlist: {min: 1}\n```\n")
    assert [i["error_type"] for i in body.judge(rules, "## a\n\n## A \n- x\n", {})] == []
    assert [i["error_type"] for i in body.judge(rules, "## A\n", {})] == ["required-missing"]


@pytest.mark.parametrize("spec,field", [({"a": 1}, "a"), ({"a": {"typo": 1}}, "a"), ({"$path": {"type": "string"}}, "$path"), ({"a": {"type": "date", "before": "x"}}, "a"), ({"a": {"type": "string", "min": "x"}}, "a"), ({"a": {"required": {"whn": 1}}}, "a")])
def test_schema_problems(spec, field):
    assert [p["field"] for p in fields.check_schema(spec)] == [field]


@pytest.mark.parametrize("rules", ["table: {columns: [a, {name: b}]}", "table: {columns: [{nam: b}]}", "list: {items: {pattern: '['}}", "formula: 'a +'", "colour: red", "heading: {enum: []}\nmin: x", "mermaid: {lang: 3}", "code: [1]"])
def test_section_rule_problems(rules):
    assert body.check_body_rules(body.body_rules(f"## A\n```yaml section-rules\n{rules}\n```\n"))


def test_grammars():
    assert not fences.feature_problems("Feature: a\n  Scenario Outline: b\n    Given <x>\n    Examples:\n      | x |\n      | 1 |\n")
    assert fences.feature_problems("Given x") and fences.feature_problems("Feature: a\nScenario: b\nGiven c\n|a|b|\n|1|\n")
    assert not fences.diagram_problems("sequenceDiagram\nA->>B: x") and fences.diagram_problems("flowchart LR\nA[x --> B") and fences.diagram_problems("")


def test_formatting(spark):
    source = "---\nzeta: 1\ntitle: x\n---\n\n\n# T\n## B\n- rel: [a](b) — why  \n### ac 1: works\n```\nx  \n```\n## A\n\n\n\ntext\n"
    once = rewrite.format_text(source, ["a", "*"])
    assert once.startswith("---\ntitle: x\nzeta: 1\n---\n# T\n## A") and "- **rel** [a](b) — why\n" in once and "### AC1 — Works" in once and "x  \n" in once
    assert rewrite.format_text(once, ["a", "*"]) == once
    two = "## A\n1\n## A\n2\n## B\n"
    out = rewrite.format_text(two, ["b", "a"])
    assert out.startswith("## B\n") and "## A\n1\n## A\n2\n" in out  # no section of a repeated name is lost


@given(st.lists(st.sampled_from(["## A", "## B", "text  ", "", "```", "### AC 2 - x", "- dep: [a](b)", "---", "~~~", "a: 1"]), max_size=14))
def test_formatting_twice_is_once(lines):
    once = rewrite.format_text("\n".join(lines), ["b"])
    assert rewrite.format_text(once, ["b"]) == once


def test_quick_fixes_apply(spark):
    df = spark.createDataFrame([("---\na: 1\ntier:\n  - x\n\n  - y\nb: 2\n---\ntier: stays\n",)], "t string")
    row = df.select(rewrite.remove_key(F.col("t"), "tier").alias("r"), rewrite.insert_key(F.col("t"), "owner").alias("i")).first()
    assert row["r"] == "---\na: 1\nb: 2\n---\ntier: stays\n"
    assert "b: 2\nowner: \n---" in row["i"]


def test_links_and_moves(spark):
    docs = spark.createDataFrame([("a/x.md", "See [y](../b/y.md#top) and [u](https://u.example/y.md) [r](/b/y.md)"), ("b/y.md", "[x](../a/x.md) [n](none.md)"), ("c.md", None)], "path string, text string")
    links = graph.markdown_links(docs)
    assert {(r["src"], r["target"]) for r in links.collect()} == {("a/x.md", "b/y.md"), ("b/y.md", "a/x.md"), ("b/y.md", "b/none.md")}
    assert {r["path"]: r["incoming"] for r in graph.incoming_counts(links).collect()}["b/y.md"] == 2
    moved = rewrite.move_document(docs, links, "b/y.md", "z/y2.md").collect()
    assert [r["new_text"] for r in moved] == ["See [y](../z/y2.md#top) and [u](https://u.example/y.md) [r](/z/y2.md)"]


@given(st.lists(st.integers(0, 50), min_size=2, max_size=30))
def test_gini_closed_form(values):
    n, total = len(values), sum(values)
    pairwise = sum(abs(a - b) for a in values for b in values) / (2 * n * total) if total else 0.0
    ordered = sorted(values)
    closed = sum((2 * i - n + 1) * x for i, x in enumerate(ordered)) / (n * total) if total else 0.0
    assert abs(pairwise - closed) < 1e-9


def test_gini_plan(spark):
    df = spark.createDataFrame([(3,), (1,), (10,), (2,)], "n long")
    assert abs(entropy.gini(df, "n").first()["gini"] - 0.4375) < 1e-12
    assert entropy.gini(df.limit(1), "n").first()["gini"] is None


def test_fuzzy_pairs_are_complete(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(150)}
    got = {(r["term_a"], r["term_b"]) for r in entropy.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "term string"), 0.2).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if edits(a, b) / max(len(a), len(b)) <= 0.2}


def test_measure_runs(spark):
    docs = m.parse_documents(spark.createDataFrame([(f"docs/d{i}.md", GOOD.replace("Good", f"Good {i}")) for i in range(12)], "path string, text string"))
    docs = docs.withColumns({"mtime": F.lit("2024-01-01").cast("timestamp"), "created_at": F.lit("2023-01-01").cast("timestamp")})
    row = entropy.measure(docs, {"templates/t-template.md": {"status": {"enum": ["open", "done"]}}}, F.lit("2024-06-01").cast("timestamp")).first()
    assert row["schema"] == 0 and row["lifecycle"] == 1 and row["lifecycle_health"] == 0 and row["template_usage"] == "single_template" and 0 <= row["overall_score"] <= 100


def test_reading_files(spark, tmp_path):
    for p, t in {"docs/a.md": "x", "docs/.hidden/b.md": "x", "node_modules/c.md": "x", ".specify/d.md": "x", "docs/e.txt": "x", "old/f.md": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    found = {r["path"] for r in m.read_markdown(spark, str(tmp_path), ["old/**"]).collect()}
    assert {"docs/a.md"} <= found <= {"docs/a.md", ".specify/d.md"}
    assert "docs/e.txt" in {r["path"] for r in m.inventory(spark, str(tmp_path)).collect()}


def test_snapshots_of_one_time_have_one_order(spark):
    rows = [(i % 3, f"2024-01-0{1 + i % 2}", i) for i in range(60)]
    got = set()
    for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
        made = spark.createDataFrame(order, "k int, at string, overall long").withColumn("measured_at", F.col("at").cast("timestamp"))
        got.add(tuple(sorted((r["k"], r["overall"], r["d_overall"]) for r in snapshots.deltas(made, ["k"]).collect() if r["d_overall"] is not None)))
    assert len(got) == 1
    assert {d for _, _, d in got.pop()} == {6, -51, -57}


@pytest.mark.parametrize("name", ["section_tree", "heading_anchors", "table_cells", "code_fences", "body_rules", "parse_front_matter", "index_entries", "validate_documents", "quick_fixes"])
def test_one_crossing_a_document(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_sections_need_no_front_matter(spark):
    raw = spark.createDataFrame([("a.md", "---\nx: [\n---\n# A\n## B\n")], "path string, text string")
    got = [tuple(r) for r in body.sections(raw).collect()]
    assert got == [tuple(r) for r in body.sections(m.parse_documents(raw)).collect()] and len(got) == 2
    assert m.parse_documents(raw, columns=("path", "body")).columns == ["path", "body"]


PLAIN = ["x", "Order 5", "12", "0", "007", "1.50", "1e3", "0x1F", "2024-01-02", "2024-13-02", "true", "no", "Null", "nan", "12:30", "1-URGENT", "463500.23", "a (b) - c", "1_000", "12345678901234567890", "0.00001", "1e17", "y"]


@given(st.dictionaries(st.sampled_from(["title", "a", "b-c", "true", "Null", "_k", "id"]), st.sampled_from(PLAIN), min_size=1))
def test_plain_front_matter_reads_and_writes_as_the_library_does(entries):
    import yaml

    source = "\n".join(f"{k}: {v}" for k, v in entries.items())
    try:
        want = yaml.load(source, Loader=m.yaml_loader())
    except ValueError:
        with pytest.raises(ValueError):
            m.load_yaml(source)
        return
    assert repr(m.load_yaml(source)) == repr(want)
    assert rewrite.dumped_yaml(want) == yaml.safe_dump(want, sort_keys=False, width=10**9, allow_unicode=True)


def test_formatting_words_does_without_the_library(monkeypatch):
    """The library takes some 0.5 ms a document."""
    import yaml

    monkeypatch.setattr(yaml, "load", None)
    monkeypatch.setattr(yaml, "safe_dump", None)
    assert rewrite.format_text("---\ntotal: 2.50\nplaced: 2024-01-02\ntitle: A b\nn: 3\n---\n# A\n") == "---\ntitle: A b\nn: 3\nplaced: 2024-01-02\ntotal: 2.5\n---\n# A\n"


def test_long_blank_runs_in_lists_take_linear_time():
    import time

    began = time.perf_counter()
    assert len(m.blocks_of("- a\n" + "\n" * 40_000 + "  b\n")) == 1
    assert time.perf_counter() - began < 5
