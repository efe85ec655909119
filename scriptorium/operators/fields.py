"""Field schemas: declarative constraints compiled to one array of optional issues per row.

A field's specification maps constraint names to a bare value or to {value, when, severity, message}. Constraints run in the order
written; a missing required field stops its other constraints; null values skip them. Nothing here shuffles:
all rules of a template are one projection over one scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions, text
from ..functions.values import Fields
from .issues import issue

TYPES = ("string", "integer", "number", "boolean", "date", "datetime", "time", "array")
MODIFIERS = ("value", "when", "severity", "message")
TIME = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?\z"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2})?(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?\z"


def constraint(name: str, raw) -> dict:
    """The expanded form of a constraint."""
    if isinstance(raw, dict) and ("value" in raw or name == "required"):
        return {"value": True, **raw} if name == "required" else raw
    return {"value": raw}


def java_regex(pattern: str) -> str:
    """A pattern with $ meaning the very end, as in the language the schemas were written in; raises re.error if malformed."""
    re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern))
    out, escaped, inside = "", False, False
    for c in pattern:
        if not escaped and c == "[":
            inside = True
        elif not escaped and c == "]":
            inside = False
        out += "\\z" if c == "$" and not escaped and not inside else c
        escaped = c == "\\" and not escaped
    return out


def comparable(v: Column, kind: str) -> Column:
    """Milliseconds since the epoch, or seconds of the day for times; null where it can't be read."""
    if kind == "time":
        parts = F.split(v["s"], ":")
        seconds = parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0))
        return F.when(v["t"] == "date", v["n"]).when((v["t"] == "string") & v["s"].rlike(TIME), seconds.cast("double"))
    read = F.unix_millis(F.try_to_timestamp(v["s"])).cast("double")
    return F.when(v["t"] == "date", v["n"]).when(v["t"] == "string", read)


def _size(v: Column, kind: str | None) -> Column:
    """What min and max compare, by declared type; null skips them."""
    if kind == "string":
        return F.when(v["t"] == "string", F.length(v["s"]).cast("double"))
    if kind == "array":
        return F.when(v["t"] == "array", F.size(v["a"]).cast("double"))
    if kind in ("number", "integer", None):
        return F.when(v["t"] == "number", v["n"])
    return F.lit(None).cast("double")


def type_fails(v: Column, kind: str) -> Column:
    t = v["t"]
    ok = {
        "string": t.isin("string", "date"),
        "integer": (t == "number") & (v["n"] == F.floor(v["n"])),
        "number": (t == "number") & ~F.isnan(v["n"]),
        "boolean": t == "boolean",
        "date": (t == "date") & v["n"].isNotNull(),
        "datetime": ((t == "date") & v["n"].isNotNull()) | ((t == "string") & v["s"].rlike(DATETIME) & F.try_to_timestamp(v["s"]).isNotNull()),
        "time": (t == "string") & v["s"].rlike(TIME),
        "array": t == "array",
    }.get(kind, F.lit(True))
    return ~F.coalesce(ok, F.lit(False))


def _typed_in(v: Column, allowed: Iterable) -> Column:
    """Strict membership: a number is never equal to its text."""
    texts = [x for x in allowed if isinstance(x, str)]
    numbers = [float(x) for x in allowed if isinstance(x, (int, float)) and not isinstance(x, bool)]
    flags = [str(x).lower() for x in allowed if isinstance(x, bool)]
    ok = F.lit(False)
    for kind, column, values in (("string", v["s"], texts), ("number", v["n"], numbers), ("boolean", v["s"], flags)):
        if values:
            ok = ok | ((v["t"] == kind) & column.isin(values))
    return F.coalesce(ok, F.lit(False))


#: name -> (violated, message, error type, fix); each gets the value, the parameter, the declared type.
Primitive = Callable[[Column, object, str | None, Column | None], tuple[Column, Column | str, str, str | None] | None]


def _type(v, p, kind, known):
    return (type_fails(v, p), F.concat(F.lit(f"Not a {p}: "), v["t"]), "type-mismatch", None)


def _enum(v, p, kind, known):
    if not isinstance(p, (list, tuple)):
        return None
    listed = ", ".join(map(str, p))
    return (~_typed_in(v, p), F.concat(F.lit("Not among the allowed values: "), v["s"]), "enum-violation", f"One of: {listed}")


def _pattern(v, p, kind, known):
    try:
        regex = java_regex(str(p))
    except re.error:
        return None
    return (~v["s"].rlike(regex), F.concat(v["s"], F.lit(f" does not match {p}")), "pattern-mismatch", f"Must match {p}")


def _bound(low: bool):
    def run(v, p, kind, known):
        n = _size(v, kind)
        beyond = (n < float(p)) if low else (n > float(p))
        word = "min" if low else "max"
        return (beyond, f"Beyond the {word}imum of {p}", f"{word}-violation", None)

    return run


def _order(before: bool):
    def run(v, p, kind, known):
        other = F.struct(F.lit("string").alias("t"), F.lit(str(p)).alias("s"), F.lit(None).cast("double").alias("n"))
        a, b = comparable(v, kind), comparable(other, kind)
        word = "before" if before else "after"
        return (~((a < b) if before else (a > b)), F.concat(v["s"], F.lit(f" is not {word} {p}")), f"{word}-violation", None)

    return run


def _unique(v, p, kind, known):
    if not p:
        return None
    return ((v["t"] == "array") & (F.size(F.array_distinct(v["a"])) < F.size(v["a"])), "Items repeat", "unique-violation", None)


def _exists(v, p, kind, known):
    if not p or known is None:
        return None  # nothing to look the path up in: every path counts as existing
    return ((v["t"] == "string") & ~F.array_contains(known, v["s"]), F.concat(v["s"], F.lit(" does not exist")), "exists-missing", "Create it, or correct the path")


PRIMITIVES: dict[str, Primitive] = {"type": _type, "enum": _enum, "pattern": _pattern, "min": _bound(True), "max": _bound(False), "before": _order(True), "after": _order(False), "uniqueItems": _unique, "exists": _exists}
PASSIVE = ("required", "description", "heading", "table", "list", "code", "repeatable", "formula")


def register(name: str, primitive: Primitive) -> None:
    """Adds a constraint of one's own."""
    PRIMITIVES[name] = primitive


def _gate(spec: dict, fields: Fields) -> Column:
    if not spec.get("when"):
        return F.lit(True)
    try:
        return expressions.condition_column(expressions.parse_condition(spec["when"]), fields.value)
    except expressions.SyntaxProblem:
        return F.lit(False)


def field_issues(schema: dict[str, dict], fields: Fields, strict: bool = False, known_paths: Column | None = None) -> tuple[list[Column], list[Column]]:
    """Columns of optional issues, and arrays of issues (strict mode), for a template's fields."""
    found: list[Column] = []
    for name, spec in (schema or {}).items():
        if not isinstance(spec, dict):
            continue
        v = fields.value(name)
        empty = v.isNull() | F.coalesce((v["t"] == "string") & (v["s"] == ""), F.lit(False))
        stopped = F.lit(False)
        if "required" in spec:
            c = constraint("required", spec["required"])
            if c["value"] is True or c["value"] is None:
                stopped = _gate(c, fields) & empty
                found.append(F.when(stopped, issue(c.get("severity") or "error", name, c.get("message") or f"Required field '{name}' is missing", "required-missing", f"Add '{name}'")))
        kind = constraint("type", spec["type"])["value"] if "type" in spec else None
        for key, raw in spec.items():
            if key not in PRIMITIVES:
                continue
            c = constraint(key, raw)
            made = PRIMITIVES[key](v, c.get("value"), kind, known_paths)
            if made is None:
                continue
            violated, message, error_type, fix = made
            hit = ~stopped & v.isNotNull() & _gate(c, fields) & F.coalesce(violated, F.lit(False))
            found.append(F.when(hit, issue(c.get("severity") or "error", name, c.get("message") or message, error_type, fix)))
    lists = []
    if strict:
        declared = F.array(*(F.lit(k) for k in schema)) if schema else F.array().cast("array<string>")
        lists.append(F.transform(F.array_except(fields.keys(), declared), lambda k: issue("error", k, F.concat(F.lit("Field is not declared: "), k), "undeclared-field", F.concat(F.lit("Remove or declare "), k))))
    return found, lists


def missing_paths(refs: DataFrame, inventory: DataFrame, column: str) -> DataFrame:
    """Rows whose non-null path is not in the inventory's column ``path``: an anti join, for inventories of any size."""
    return refs.where(F.col(column).isNotNull()).join(inventory.select(F.col("path").alias(column)).distinct(), column, "left_anti")


# --- checks of the schemas themselves ---------------------------------------------------------------------------

INVALID = "template-schema-invalid"


def _problem(field: str, message: str) -> dict:
    return {"level": "error", "field": field, "message": message, "error_type": INVALID}


def _hint(word: str, known: Iterable[str]) -> str:
    near = text.nearest(word, list(known))
    return f" (did you mean '{near}'?)" if near else ""


def check_schema(schema: object) -> list[dict]:
    """Problems of a template's field schema; never raises."""
    if schema is None:
        return []
    if not isinstance(schema, dict):
        return [_problem("fields", "The fields must be a mapping")]
    out = []
    known = [*PRIMITIVES, *PASSIVE]
    for name, spec in schema.items():
        if not isinstance(spec, dict):
            out.append(_problem(name, f"The specification of '{name}' must be a mapping"))
            continue
        kind = constraint("type", spec["type"]).get("value") if "type" in spec else None
        for key, raw in spec.items():
            if key not in known:
                out.append(_problem(name, f"Unknown constraint '{key}' on '{name}'{_hint(key, known)}"))
                continue
            if name.startswith("$") and key not in ("pattern", "enum", "description"):
                out.append(_problem(name, f"'{key}' can't be used on '{name}'"))
                continue
            c = constraint(key, raw)
            value = c.get("value")
            if c is raw or (isinstance(raw, dict) and key == "required"):
                for m in raw:
                    if m not in MODIFIERS:
                        out.append(_problem(name, f"Unknown modifier '{m}' on '{key}' of '{name}'{_hint(m, MODIFIERS)}"))
                if raw.get("when") is not None:
                    try:
                        expressions.parse_condition(str(raw["when"]))
                    except expressions.SyntaxProblem as e:
                        out.append(_problem(name, f"The condition of '{key}' on '{name}' can't be read: {e}"))
            if key == "type" and value not in TYPES:
                out.append(_problem(name, f"Unknown type '{value}' on '{name}'{_hint(str(value), TYPES)}"))
            elif key == "pattern":
                try:
                    java_regex(str(value))
                except re.error:
                    out.append(_problem(name, f"The pattern of '{name}' is malformed: {value}"))
            elif key == "enum" and not isinstance(value, list):
                out.append(_problem(name, f"The enum of '{name}' must be a list"))
            elif key in ("min", "max"):
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    out.append(_problem(name, f"The {key} of '{name}' must be a number"))
                elif kind is None:
                    out.append(_problem(name, f"{key} on '{name}' needs a declared type"))
            elif key in ("before", "after"):
                if kind not in ("date", "datetime", "time"):
                    out.append(_problem(name, f"'{key}' on '{name}' needs the type date, datetime or time"))
                elif not _readable(value, kind):
                    out.append(_problem(name, f"The bound of '{key}' on '{name}' is no {kind}: {value}"))
    return out


def _readable(value: object, kind: str) -> bool:
    from datetime import date, datetime

    if isinstance(value, (date, datetime)):
        return True
    if not isinstance(value, str):
        return False
    if kind == "time":
        return re.match(TIME.replace(r"\z", "$"), value) is not None
    try:
        datetime.fromisoformat(value.replace("Z", "+00:00"))
        return True
    except ValueError:
        return False
