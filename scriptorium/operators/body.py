"""Body schemas: sections a document must have, and rules for their headings, tables, lists, code and formulas.

A body is parsed and judged in one Python crossing per document; nothing is shuffled, since section matching is a matter
within one document. Rules are small and compiled on the driver. Non-repeatable sections claim the first unclaimed
heading of equal depth and text (case and outer blanks aside) below the matched parent, in schema order; then
the first repeatable section claims all other headings of its depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection
from dataclasses import dataclass, field
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions, text
from ..sources import crossing
from ..sources.markdown import Block, Section, load_yaml, parse_one, plain_values, rule_fences, section_tree, split_front
from . import fences, fields

ISSUE_COLUMNS = "path string, seq int, level string, field string, message string, error_type string, fix string, body_line int"
CONTENT = ("table", "list", "code", "mermaid", "gherkin", "formula")
SECTION_KEYS = ("required", "repeatable", "heading", *CONTENT, "min", "max", "severity", "message")
INNER_KEYS = {
    "heading": ("pattern", "enum"), "table": ("columns", "rows", "strict"), "list": ("items", "min", "max", "unique"),
    "code": ("lang", "min", "max", "content"), "mermaid": ("lang", "min", "max"), "gherkin": ("lang", "min", "max", "defaultDialect"),
}
COLUMN_KEYS, VALUE_KEYS = ("name", "required", "values"), ("required", "pattern", "enum", "unique", "type", "min", "max")
JOINT = " › "


@dataclass
class Rule:
    """A section of a template: heading, rules (None where it has none), sections below."""

    depth: int
    text: str
    rules: dict | None
    children: list[Rule] = field(default_factory=list)


@dataclass
class Template:
    path: str
    fields: dict | None = None
    strict: bool = False
    sections: list[str] = field(default_factory=list)
    tier: str | None = None
    body: list[Rule] = field(default_factory=list)
    problems: list[dict] = field(default_factory=list)


def body_rules(body: str) -> list[Rule]:
    """The section rules of a template's body: of each section, its first fence marked yaml section-rules."""

    def convert(s: Section) -> Rule:
        rules = None
        for b in s.blocks:
            if b.kind == "code" and b.lang == "yaml" and b.meta == "section-rules":
                try:
                    loaded = load_yaml(b.text)
                except Exception:  # unreadable rules count as none
                    loaded = None
                rules = loaded if isinstance(loaded, dict) and loaded else None
                break
        return Rule(s.depth, s.text, rules, [convert(c) for c in s.children])

    return [convert(s) for s in section_tree(body).children]


def load_template(path: str, source: str | None) -> Template | None:
    """A template from its text; None where it can't be read as one."""
    if source is None:
        return None
    front, body, _ = split_front(source)
    try:
        fm = load_yaml(front) if front else {}
    except Exception:
        return None
    if fm is None:
        fm = {}
    if not isinstance(fm, dict):
        return None
    declared = fm.get("fields")
    t = Template(path, declared if isinstance(declared, dict) else None, fm.get("strict") is True, list(fm["sections"]) if isinstance(fm.get("sections"), list) else [], fm["tier"] if isinstance(fm.get("tier"), str) else None, body_rules(body))
    t.problems = [*fields.check_schema(t.fields), *check_body_rules(t.body)]
    return t


def label(depth: int, heading: str) -> str:
    return "#" * depth + " " + heading


def _bad_regex(p: object) -> bool:
    try:
        fields.java_regex(str(p))
        return False
    except re.error:
        return True


def check_body_rules(rules: list[Rule], above: tuple[str, ...] = ()) -> list[dict]:
    """Problems of a template's section rules; never raises."""
    out: list[dict] = []
    for r in rules:
        path = JOINT.join([*above, label(r.depth, r.text)])
        bad = lambda m, path=path: out.append(fields._problem(path, m))
        spec = r.rules or {}

        def unknown(found: object, known: tuple[str, ...], where: str, bad=bad):
            for k in found if isinstance(found, dict) else ():
                if k not in known:
                    bad(f"Unknown key '{k}' in {where}{fields._hint(str(k), known)}")

        unknown(spec, SECTION_KEYS, "section-rules")
        for name in ("heading", *CONTENT):
            if name not in spec:
                continue
            p = spec[name]
            if name == "formula":
                if not isinstance(p, str):
                    bad("'formula' must be an expression")
                    continue
                try:
                    expressions.parse_formula(p)
                except expressions.SyntaxProblem as e:
                    bad(f"The formula can't be read: {e}")
                continue
            if not isinstance(p, dict):
                if name != "heading":
                    bad(f"'{name}' must be a mapping")
                continue
            if name != "heading":
                unknown(p, INNER_KEYS[name], f"'{name}'")
            if name == "heading":
                if p.get("pattern") and _bad_regex(p["pattern"]):
                    bad("heading.pattern is malformed")
                if p.get("enum") and not isinstance(p["enum"], list):
                    bad("heading.enum must be a list that is not empty")
            elif name == "table":
                _check_columns(p, bad, unknown)
            elif name == "list" and isinstance(p.get("items"), dict):
                unknown(p["items"], ("required", "pattern", "enum"), "'list.items'")
                if p["items"].get("pattern") and _bad_regex(p["items"]["pattern"]):
                    bad("list.items.pattern is malformed")
                if "enum" in p["items"] and not isinstance(p["items"]["enum"], list):
                    bad("list.items.enum must be a list")
            elif name == "code" and isinstance(p.get("content"), dict):
                unknown(p["content"], ("pattern",), "'code.content'")
                if p["content"].get("pattern") and _bad_regex(p["content"]["pattern"]):
                    bad("code.content.pattern is malformed")
            elif name in ("mermaid", "gherkin"):
                if "lang" in p and not isinstance(p["lang"], (str, list)):
                    bad(f"'{name}.lang' must be a word or a list of words")
                if "defaultDialect" in p and not isinstance(p["defaultDialect"], str):
                    bad("'gherkin.defaultDialect' must be a word")
        for k in ("min", "max"):
            if k in spec and (isinstance(spec[k], bool) or not isinstance(spec[k], (int, float))):
                bad(f"'{k}' must be a number")
        out += check_body_rules(r.children, (*above, label(r.depth, r.text)))
    return out


def _check_columns(p: dict, bad, unknown) -> None:
    if "columns" in p:
        if not isinstance(p["columns"], list):
            bad("'table.columns' must be a list")
        else:
            kinds = set()
            for i, c in enumerate(p["columns"]):
                if isinstance(c, str):
                    kinds.add("word")
                elif isinstance(c, dict):
                    kinds.add("mapping")
                    if not isinstance(c.get("name"), str) or not c["name"].strip():
                        bad(f"'table.columns[{i}]' needs a name")
                        continue
                    unknown(c, COLUMN_KEYS, f"'table.columns[{i}]'")
                    v = c.get("values")
                    if isinstance(v, dict):
                        unknown(v, VALUE_KEYS, f"'table.columns[{i}].values'")
                        if v.get("pattern") and _bad_regex(v["pattern"]):
                            bad(f"'table.columns[{i}].values.pattern' is malformed")
                        if "enum" in v and not isinstance(v["enum"], list):
                            bad(f"'table.columns[{i}].values.enum' must be a list")
                        if "type" in v and v["type"] not in fields.TYPES:
                            bad(f"'table.columns[{i}].values.type' is no type{fields._hint(str(v['type']), fields.TYPES)}")
                else:
                    bad(f"'table.columns[{i}]' must be a word or a mapping")
            if len(kinds) == 2:
                bad("'table.columns' mixes words and mappings")
    if isinstance(p.get("rows"), dict):
        unknown(p["rows"], ("min", "max"), "'table.rows'")


# --- judging a body ------------------------------------------------------------------------------------------------


def _regex(p: object) -> re.Pattern | None:
    return _compiled(str(p))


@lru_cache(1024)
def _compiled(p: str) -> re.Pattern | None:
    try:
        return re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", p).replace("$", "\\Z") if not re.search(r"\[[^\]]*\$|\\\$", p) else p)
    except re.error:
        return None


# rules recur in every document: what they compile to is kept
_condition = lru_cache(1024)(expressions.parse_condition)
_expression = lru_cache(1024)(expressions.parse_formula)


def _holds(when: object, fm: dict) -> bool:
    if not when:
        return True
    try:
        return expressions.evaluate_condition(_condition(str(when)), fm)
    except expressions.SyntaxProblem:
        return False


def _required(rules: dict, fm: dict) -> dict | None:
    """The expanded required constraint where it applies."""
    if rules.get("required") is None:
        return None
    c = fields.constraint("required", rules["required"])
    return c if (c.get("value") is True or c.get("value") is None) and _holds(c.get("when"), fm) else None


def judge(rules: list[Rule], body: str | None, fm: dict) -> list[dict]:
    """Issues of a body against section rules."""
    if not rules:
        return []
    nodes = section_tree(body).children
    if len(rules) == 1 and rules[0].depth == 1 and len(nodes) == 1 and nodes[0].depth == 1:
        rules, nodes = rules[0].children, nodes[0].children
    out: list[dict] = []
    _children(rules, nodes, (), out, fm)
    return out


def _issue(level, where, message, kind, line=None, fix=None) -> dict:
    return {"level": level, "field": where, "message": message, "error_type": kind, "fix": fix, "body_line": line}


def _same(a: str, b: str) -> bool:
    return a.lower().strip() == b.lower().strip()


def _children(rules: list[Rule], nodes: list[Section], above: tuple[str, ...], out: list[dict], fm: dict) -> None:
    claimed: set[int] = set()
    for r in (r for r in rules if not (r.rules or {}).get("repeatable")):
        spec = r.rules or {}
        name = label(r.depth, r.text)
        path = JOINT.join((*above, name))
        hit = next((i for i, n in enumerate(nodes) if i not in claimed and n.depth == r.depth and _same(n.text, r.text)), None)
        if hit is None:
            if c := _required(spec, fm):
                out.append(_issue(c.get("severity") or spec.get("severity") or "error", path, c.get("message") or spec.get("message") or f"Required section '{name}' is missing", "required-missing"))
            continue
        claimed.add(hit)
        _content(spec, nodes[hit], path, out, fm)
        if r.children:
            _children(r.children, nodes[hit].children, (*above, name), out, fm)
    for r in (r for r in rules if (r.rules or {}).get("repeatable")):
        spec = r.rules
        name = label(r.depth, r.text)
        mine = [i for i, n in enumerate(nodes) if i not in claimed and n.depth == r.depth]
        claimed.update(mine)
        level = spec.get("severity") or "error"
        low = spec["min"] if spec.get("min") is not None else 1 if _required(spec, fm) else 0
        high = spec["max"] if spec.get("max") is not None else float("inf")
        line = nodes[mine[0]].line if mine else None
        for wrong, word, bound in ((len(mine) < low, "least", low), (len(mine) > high, "most", high)):
            if wrong:
                out.append(_issue(level, JOINT.join((*above, name)), spec.get("message") or f"At {word} {bound} sections like '{name}', found {len(mine)}", "cardinality", line))
        for i in mine:
            n = nodes[i]
            path = JOINT.join((*above, label(n.depth, n.text)))
            if spec.get("heading"):
                if m := _heading(spec["heading"], n.text):
                    out.append(_issue(level, path, spec.get("message") or m, "heading-mismatch", n.line))
            if r.children:
                _children(r.children, n.children, (*above, label(n.depth, n.text)), out, fm)
            _content(spec, n, path, out, fm)


def _heading(p: dict, heading: str) -> str | None:
    if p.get("pattern"):
        rule = _regex(p["pattern"])
        if rule is None:
            return None
        if not rule.search(heading):
            return f"Heading does not match {p['pattern']}"
    if p.get("enum") and not any(_same(str(x), heading) for x in p["enum"]):
        return "Heading is not among the allowed ones"
    return None


def _content(spec: dict, node: Section, path: str, out: list[dict], fm: dict) -> None:
    level = spec.get("severity") or "error"
    for name in CONTENT:
        if spec.get(name) is None:
            continue
        found, anchor = _CHECKS[name](spec[name], node, fm)
        for message, kind, line, where in found:
            out.append(_issue(level, path + where, spec.get("message") or message, kind, anchor if line is None else line))


Found = list[tuple[str, str, int | None, str]]


def _unread(s: str) -> bool:
    try:
        datetime.fromisoformat(s.replace("Z", "+00:00"))
        return False
    except ValueError:
        return True


_CELLS = {
    "integer": lambda cell: not re.fullmatch(r"-?\d+", cell), "number": lambda cell: not re.fullmatch(r"-?\d+(?:\.\d+)?", cell),
    "boolean": lambda cell: cell.lower() not in ("true", "false"), "date": lambda cell: _unread(cell) or not re.match(r"\d{4}-\d{2}-\d{2}", cell),
    "datetime": lambda cell: _unread(cell) or not re.match(fields.DATETIME.replace(r"\z", r"\Z"), cell), "time": lambda cell: not re.match(fields.TIME.replace(r"\z", r"\Z"), cell),
}


def _cell_mistyped(cell: str, kind: str) -> bool:
    return _CELLS[kind](cell) if kind in _CELLS else False


def _number(s: str) -> float | None:
    try:
        n = float(s)
    except ValueError:
        return None
    return n if n == n and abs(n) != float("inf") else None


def _table(p: dict, node: Section, fm: dict) -> tuple[Found, int | None]:
    table = next((b for b in node.blocks if b.kind == "table"), None)
    if table is None:
        return [("A table is missing", "table-shape", None, "")], None
    out: Found = []
    columns = [{"name": c, "required": True} if isinstance(c, str) else c for c in p.get("columns") or [] if isinstance(c, str) or (isinstance(c, dict) and isinstance(c.get("name"), str))]
    for c in columns:
        key = c["name"].lower().strip()
        if key not in table.headers:
            if c.get("required") is not False:
                out.append((f"The table has no column '{c['name']}'", "table-shape", None, ""))
            continue
        v = c.get("values")
        if not isinstance(v, dict):
            continue
        at = table.headers.index(key)
        rule = _regex(v["pattern"]) if v.get("pattern") else None
        allowed = [str(x) for x in v["enum"]] if isinstance(v.get("enum"), list) else None
        kind, low, high, unique = (v.get(k) for k in ("type", "min", "max", "unique"))
        seen: set[str] = set()
        for i, row in enumerate(table.rows, 1):
            cell = row[at].strip() if at < len(row) else ""
            wrong = []
            if not cell:
                if v.get("required"):
                    wrong.append("The cell is empty")
            elif kind and _cell_mistyped(cell, kind):
                wrong.append(f"'{cell}' is no {kind}")
            else:
                if allowed is not None and cell not in allowed:
                    wrong.append(f"'{cell}' is not among the allowed values")
                if rule and not rule.search(cell):
                    wrong.append(f"'{cell}' does not match {v['pattern']}")
                if low is not None or high is not None:
                    size = float(len(cell)) if kind == "string" else _number(cell) if kind in (None, "integer", "number") else None
                    if kind is None and size is None:
                        size = float(len(cell))
                    if size is not None and low is not None and size < low:
                        wrong.append(f"'{cell}' is below {low}")
                    if size is not None and high is not None and size > high:
                        wrong.append(f"'{cell}' is above {high}")
                if unique:
                    if cell in seen:
                        wrong.append(f"'{cell}' repeats")
                    seen.add(cell)
            out += [(m, "table-cell", None, f" [col '{c['name']}' row {i}]") for m in wrong]
    if isinstance(p.get("rows"), dict):
        n = len(table.rows)
        if p["rows"].get("min") is not None and n < p["rows"]["min"]:
            out.append((f"{n} rows, at least {p['rows']['min']} are expected", "table-shape", None, ""))
        if p["rows"].get("max") is not None and n > p["rows"]["max"]:
            out.append((f"{n} rows, at most {p['rows']['max']} are expected", "table-shape", None, ""))
    if p.get("strict") is True:
        known = {c["name"].lower().strip() for c in columns}
        out += [(f"The column '{h}' is not declared", "table-shape", None, "") for h in table.headers if h not in known]
    return out, table.line


def _list(p: dict, node: Section, fm: dict) -> tuple[Found, int | None]:
    block = next((b for b in node.blocks if b.kind == "list"), None)
    if block is None:
        return [("A list is missing", "list-item", None, "")], None
    out: Found = []
    n = len(block.items)
    if p.get("min") is not None and n < p["min"]:
        out.append((f"{n} items, at least {p['min']} are expected", "list-item", None, ""))
    if p.get("max") is not None and n > p["max"]:
        out.append((f"{n} items, at most {p['max']} are expected", "list-item", None, ""))
    if p.get("unique"):
        seen: set[str] = set()
        for t, line in block.items:
            if t in seen:
                out.append((f"'{t}' repeats", "unique-violation", line, ""))
            seen.add(t)
    items = p.get("items")
    if isinstance(items, dict):
        rule = _regex(items["pattern"]) if items.get("pattern") else None
        allowed = [str(x) for x in items["enum"]] if isinstance(items.get("enum"), list) else None
        for t, line in block.items:
            if items.get("required") and not t.strip():
                out.append(("The item is empty", "list-item", line, ""))
                continue
            if rule and not rule.search(t):
                out.append((f"'{t}' does not match {items['pattern']}", "list-item", line, ""))
            if allowed is not None and t not in allowed:
                out.append((f"'{t}' is not among the allowed items", "list-item", line, ""))
    return out, block.line


def _fences(node: Section) -> tuple[list[Block], int | None]:
    found = [b for b in node.blocks if b.kind == "code"]
    return found, found[0].line if found else node.line


def _counted(n: int, p: dict, missing: str, beyond: str) -> Found:
    low = p["min"] if p.get("min") is not None else 1
    out: Found = []
    if n < low:
        out.append((f"{n} code fences of the kind, at least {low} are expected", missing, None, ""))
    if p.get("max") is not None and n > p["max"]:
        out.append((f"{n} code fences of the kind, at most {p['max']} are expected", beyond, None, ""))
    return out


def _code(p: dict, node: Section, fm: dict) -> tuple[Found, int | None]:
    found, anchor = _fences(node)
    mine = [b for b in found if b.lang and b.lang.lower() == str(p["lang"]).lower()] if p.get("lang") else found
    out = _counted(len(mine), p, "code-missing", "code-missing")
    if isinstance(p.get("content"), dict) and p["content"].get("pattern") and (rule := _regex(p["content"]["pattern"])):
        out += [(f"The code does not match {p['content']['pattern']}", "code-content-mismatch", b.line, "") for b in mine if not rule.search(b.text)]
    return out, anchor


def _parsed(name: str, langs: tuple[str, ...], problems, first_only: bool):
    def run(p: dict, node: Section, fm: dict) -> tuple[Found, int | None]:
        found, anchor = _fences(node)
        wanted = [str(x).lower() for x in p["lang"]] if isinstance(p.get("lang"), list) else [p["lang"].lower()] if isinstance(p.get("lang"), str) else langs
        mine = [b for b in found if b.lang and b.lang.lower() in wanted]
        out = _counted(len(mine), p, f"{name}-missing", f"{name}-cardinality")
        for b in mine:
            out += [(f"{m}", f"{name}-syntax", b.line + line if first_only else b.line + line - 1, "") for line, m in problems(b.text)]
        return out, anchor

    return run


def _formula(p: object, node: Section, fm: dict) -> tuple[Found, int | None]:
    try:
        held = expressions.evaluate_formula(_expression(str(p)), fm) is not False
    except (expressions.SyntaxProblem, KeyError):
        held = False
    return ([] if held else [(f"{p} does not hold", "formula-violation", None, "")]), node.line


_CHECKS = {"table": _table, "list": _list, "code": _code, "mermaid": _parsed("mermaid", ("mermaid", "mmd"), fences.diagram_problems, True), "gherkin": _parsed("gherkin", ("gherkin", "feature"), fences.feature_problems, False), "formula": _formula}


def found_in(template: str | None, fm: dict, body: str | None, rules: dict[str, list[Rule]]) -> list[dict]:
    """Issues of one body: leaked rule fences, then what the rules of its template find."""
    leaks = rule_fences(body) if body and "section-rules" in body else []
    found = [_issue("error", "body", "A fence of section rules belongs to templates only", "section-rules-leak", line, "Remove the fence") for line, _ in leaks]
    return found + judge(rules[template], body, fm) if template in rules else found


def usable(templates: dict[str, Template]) -> dict[str, list[Rule]]:
    """Section rules by template, of the templates that have no problem."""
    return {k: t.body for k, t in templates.items() if not t.problems}


def body_issues(docs: DataFrame, templates: dict[str, Template]) -> DataFrame:
    """One row per body issue of docs (path, template, fm_json, body): section rules, and leaked rule fences. Documents that
    validate.parsed() made carry their issues already and are not parsed again; raw ones (path, text) are parsed in the same crossing."""
    if "body_issues" in docs.columns:
        return docs.select("path", F.posexplode("body_issues").alias("seq", "i")).select("path", "seq", "i.*")
    rules = usable(templates)

    def each(path, template, fm, body):
        for i, x in enumerate(found_in(template, json.loads(fm) if fm else {}, body, rules)):
            yield path, i, *(x[k] for k in ("level", "field", "message", "error_type", "fix", "body_line"))

    def whole(path, source):
        d = parse_one(path, source, ("template",))
        for i, x in enumerate(found_in(d["template"], plain_values(d["_fm"]), d["body"], rules)):
            yield path, i, *x.values()

    schema = pa.schema([("path", pa.string()), ("seq", pa.int32()), *crossing.ISSUE])
    if "body" not in docs.columns:
        return crossing.crossed(docs, ["path", "text"], whole, schema, ISSUE_COLUMNS)
    return crossing.crossed(docs, ["path", "template", "fm_json", "body"], each, schema, ISSUE_COLUMNS)


def _trees(docs: DataFrame):
    """The columns to take across, and what makes a section tree of the second: of raw documents (path, text) the front matter is left out
    without being read."""
    if "body" in docs.columns:
        return ["path", "body"], section_tree
    return ["path", "text"], lambda source: section_tree(split_front(source or "")[1])


def sections(docs: DataFrame) -> DataFrame:
    """One row per heading: path, section_id, parent_id, depth, text, norm_text, line, heading_path. Raw documents (path, text) take one crossing."""
    columns, tree = _trees(docs)

    def walk(path: str, node: Section, parent: int | None, above: tuple[str, ...], out: list[tuple]) -> list[tuple]:
        for c in node.children:
            number, trail = len(out), (*above, label(c.depth, c.text))
            out.append((path, number, parent, c.depth, c.text, c.text.lower().strip(), c.line, JOINT.join(trail)))
            walk(path, c, number, trail, out)
        return out

    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
    schema = pa.schema(list(zip(("path", "section_id", "parent_id", "depth", "text", "norm_text", "line", "heading_path"), kinds, strict=True)))
    return crossing.crossed(docs, columns, lambda path, source: walk(path, tree(source), None, (), []), schema, "path string, section_id int, parent_id int, depth int, text string, norm_text string, line int, heading_path string")


def blocks(docs: DataFrame, wanted: Collection[str] = ("table", "list", "code")) -> DataFrame:
    """One row per table, list and code fence (those wanted) at the top level of a section: path, heading, kind, ix (of its kind in the section),
    line, lang, value, headers, rows, items. Raw documents (path, text) take one crossing."""
    columns, tree = _trees(docs)

    def walk(path: str, node: Section):
        seen: dict[str, int] = {}
        for b in node.blocks:
            if b.kind in wanted:
                ix = seen[b.kind] = seen.get(b.kind, -1) + 1
                yield path, node.text, b.kind, ix, b.line, b.lang, b.text if b.kind == "code" else None, b.headers, b.rows, [t for t, _ in b.items]
        for c in node.children:
            yield from walk(path, c)

    texts = pa.list_(pa.string())
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), texts, pa.list_(texts), texts)
    schema = pa.schema(list(zip(("path", "heading", "kind", "ix", "line", "lang", "value", "headers", "rows", "items"), kinds, strict=True)))
    return crossing.crossed(docs, columns, lambda path, source: walk(path, tree(source)), schema, "path string, heading string, kind string, ix int, line int, lang string, value string, headers array<string>, rows array<array<string>>, items array<string>")


def table_cells(found: DataFrame) -> DataFrame:
    """One row per table cell of blocks(): path, heading, table_ix, row, col, header, cell."""
    rows = found.where("kind = 'table'").select("path", "heading", F.col("ix").alias("table_ix"), "headers", F.posexplode("rows").alias("row", "cells"))
    cells = rows.select("path", "heading", "table_ix", (F.col("row") + 1).alias("row"), "headers", F.posexplode("cells").alias("col", "cell"))
    return cells.select("path", "heading", "table_ix", "row", "col", F.get("headers", F.col("col")).alias("header"), "cell")


def suggestions(words: list[str], known: list[str]) -> dict[str, str | None]:
    return {w: text.nearest(w, known) for w in words}
