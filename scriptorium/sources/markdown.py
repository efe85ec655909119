"""Markdown: a block parser, front matter, and readers that turn files or text columns into documents.

parse_documents() crosses into Python once per document and returns what later stages need as columns. The parser looks at the first
character of a line before it tries a pattern, and reads front matter of plain scalars without the YAML library. It
covers the block structure of GitHub-flavoured Markdown: ATX and setext headings, fenced and indented code,
tables, lists, quotes, breaks and paragraphs; inline markup is reduced to its text.
"""

from __future__ import annotations

import datetime
import functools
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import VALUE_SQL
from . import crossing

SKIPPED_FOLDERS = ("node_modules", "dist", "build", "coverage", "vendor")
_KINDS = {"fm": f"map<string,{VALUE_SQL}>", "body_line": "int", "headings": "array<string>"}
DOCUMENT = pa.schema([
    ("path", pa.string()), ("folder", pa.string()), ("template", pa.string()), ("fm", crossing.VALUES), ("fm_json", pa.string()),
    ("body", pa.string()), ("body_line", pa.int32()), ("parse_error", pa.string()), ("headings", pa.list_(pa.string())),
])


def document_sql(names: Iterable[str]) -> str:
    return ", ".join(f"{n} {_KINDS.get(n, 'string')}" for n in names)


@dataclass(slots=True)
class Block:
    kind: str
    line: int
    depth: int = 0
    text: str = ""
    lang: str | None = None
    meta: str | None = None
    headers: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    items: list[tuple[str, int]] = field(default_factory=list)


@dataclass(slots=True)
class Section:
    depth: int
    text: str
    line: int
    blocks: list[Block] = field(default_factory=list)
    children: list[Section] = field(default_factory=list)


_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*(.*)$")
_BREAK = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*))?$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_MARKED = re.compile(r"[`\\<\[*~_]")
_INDENTED = re.compile(r"^(?: {4}|\t)")
_MARKS = "`~#=-+*_>"  # with digits, what the blocks begin with that are neither indented, paragraphs nor tables


def inline_text(s: str) -> str:
    """Text without emphasis, code marks, links, images and escapes."""
    if not _MARKED.search(s):
        return s
    kept: list[str] = []

    def keep(x: str) -> str:
        kept.append(x)
        return f"\0{len(kept) - 1}\0"

    if "`" in s:
        s = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(m[2][1:-1] if m[2][:1] == m[2][-1:] == " " and m[2].strip() else m[2]), s, flags=re.S)
    if "\\" in s:
        s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), s)
    if "<" in s:
        s = re.sub(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*)>", r"\1", s)
    if "](" in s:
        s = re.sub(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:<[^>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)", r"\1", s)
    for sign, marks in (("*", (r"\*\*\*", r"\*\*", r"\*")), ("~~", ("~~",))):
        for mark in marks if sign in s else ():
            s = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", s, flags=re.S)
    for mark in ("__", "_") if "_" in s else ():
        s = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", s, flags=re.S)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], s) if kept else s


def _cells(line: str) -> list[str]:
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    if s.endswith("|") and not s.endswith("\\|"):
        s = s[:-1]
    if not _MARKED.search(s):
        return [c.strip() for c in s.split("|")]
    return [inline_text(c.replace("\\|", "|")).strip() for c in re.split(r"(?<!\\)\|", s)]


def _marked(line: str) -> bool:
    """Whether the line may begin a block of its own: no pattern above but that of indented code and of a table's delimiter matches others."""
    c = line.lstrip(" ")[:1]
    return c != "" and (c in _MARKS or c.isdecimal())


def _interrupts(line: str) -> bool:
    """Whether the line begins a block that ends a table."""
    c = line.lstrip(" ")[:1]
    if not c or not (c in _MARKS or c.isdecimal()):
        return False
    if c in "-*":
        return bool(_ITEM.match(line) or _BREAK.match(line))
    return bool(_STARTS.get(c, _ITEM).match(line))


_STARTS = {"#": _ATX, "`": _FENCE, "~": _FENCE, ">": _QUOTE, "_": _BREAK}


@functools.lru_cache(64)
def _fence_end(mark: str) -> re.Pattern:
    return re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")


def blocks_of(body: str) -> list[Block]:
    """The top-level blocks of a body, in order, with their 1-based lines."""
    lines = body.split("\n")
    out: list[Block] = []
    paragraph: list[str] = []
    began = 0

    def close():
        nonlocal paragraph
        if paragraph:
            out.append(Block("paragraph", began, text=inline_text("\n".join(x.strip() for x in paragraph))))
            paragraph = []

    i = 0
    while i < len(lines):
        line = lines[i].rstrip("\r")
        bare = line.strip()
        if not bare:
            if paragraph:
                close()
            i += 1
            continue
        first = bare[0]
        marked = first in _MARKS or first.isdecimal()
        if not marked and paragraph:  # nothing but its next line
            paragraph.append(line)
            i += 1
            continue
        if first in "`~" and (m := _FENCE.match(line)):
            mark, info = m[2], m[3].strip()
            if mark[0] == "~" or "`" not in info:
                close()
                start, value = i, []
                i += 1
                end = _fence_end(mark)
                while i < len(lines) and not (mark[0] in lines[i] and end.match(lines[i].rstrip("\r"))):
                    value.append(re.sub(rf"^ {{0,{len(m[1])}}}", "", lines[i].rstrip("\r")) if m[1] else lines[i].rstrip("\r"))
                    i += 1
                i += 1
                lang, _, meta = info.partition(" ")
                out.append(Block("code", start + 1, text="\n".join(value), lang=lang or None, meta=meta.strip() or None))
                continue
        if first == "#" and (m := _ATX.match(line)):
            close()
            out.append(Block("heading", i + 1, depth=len(m[1]), text=inline_text((m[2] or "").strip())))
            i += 1
            continue
        if paragraph and first in "=-" and (m := _UNDERLINE.match(line)):
            out.append(Block("heading", began, depth=1 if m[1][0] == "=" else 2, text=inline_text("\n".join(x.strip() for x in paragraph))))
            paragraph = []
            i += 1
            continue
        if first in "-*_" and _BREAK.match(line):
            close()
            out.append(Block("break", i + 1))
            i += 1
            continue
        if not paragraph and line[0] in " \t" and _INDENTED.match(line):
            start, value = i, []
            while i < len(lines) and (_INDENTED.match(lines[i]) or not lines[i].strip()):
                value.append(_INDENTED.sub("", lines[i]))
                i += 1
            out.append(Block("code", start + 1, text="\n".join(value).rstrip("\n")))
            continue
        if first == ">" and _QUOTE.match(line):
            close()
            start = i
            while i < len(lines) and lines[i].strip() and (_QUOTE.match(lines[i]) or not (_ATX.match(lines[i]) or _FENCE.match(lines[i]) or _ITEM.match(lines[i]) or _BREAK.match(lines[i]))):
                i += 1
            out.append(Block("quote", start + 1, text="\n".join(_QUOTE.sub("", x) for x in lines[start:i])))
            continue
        m = _ITEM.match(line) if marked else None
        if m and (not paragraph or (m[4] and (m[2] in "-+*" or m[2][:-1] == "1"))):
            close()
            block, i = _list(lines, i)
            out.append(block)
            continue
        if not paragraph and "|" in line and i + 1 < len(lines) and _DELIMITER.match(lines[i + 1]):
            heads = _cells(line)
            if len(heads) == len(_cells(lines[i + 1])):
                start, rows = i, []
                i += 2
                while i < len(lines) and lines[i].strip() and not _interrupts(lines[i]):
                    rows.append(_cells(lines[i])[: len(heads)])
                    i += 1
                out.append(Block("table", start + 1, headers=[c.lower() for c in heads], rows=rows))
                continue
        if not paragraph:
            began = i + 1
        paragraph.append(line)
        i += 1
    close()
    return out


def _list(lines: list[str], i: int) -> tuple[Block, int]:
    first = _ITEM.match(lines[i])
    kind = first[2][-1]
    block = Block("list", i + 1)
    count = len(lines)
    while i < count:
        m = _ITEM.match(lines[i])
        if not m or m[2][-1] != kind or (kind in "-*" and _BREAK.match(lines[i])):
            break
        width = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] and len(m[3]) <= 4 and m[4] else 1)
        start = i
        inner = [m[4] or ""]
        i += 1
        while i < count:
            s = lines[i].rstrip("\r")
            if not s.strip():
                at = i + 1
                while at < count and not lines[at].strip():
                    at += 1
                nxt = lines[at] if at < count else ""
                if len(nxt) - len(nxt.lstrip(" ")) < width:
                    break
                inner += [""] * (at - i)
                i = at
                continue
            if s[0] == " " and len(s) - len(s.lstrip(" ")) >= width:
                inner.append(s[width:])
            elif _interrupts(s) or not inner[-1].strip():
                break
            else:
                inner.append(s.strip())
            i += 1
        block.items.append((_item_text("\n".join(inner)), start + 1))
        at = i
        while i < count and not lines[i].strip():
            i += 1
        if i >= count or not (n := _ITEM.match(lines[i])) or n[2][-1] != kind:
            i = at
            break
    return block, i


def _item_text(inner: str) -> str:
    if inner[:1] == "[":
        inner = re.sub(r"^\[[ xX]\][ \t]+", "", inner)
    if "\n" not in inner and inner[:1] not in ("", " ", "\t") and inner.strip() and not _marked(inner):
        return inline_text(inner.strip()).strip()  # one line of a paragraph
    return "".join("".join(t for t, _ in b.items) if b.kind == "list" else "".join(h for h in b.headers) + "".join("".join(r) for r in b.rows) if b.kind == "table" else b.text for b in blocks_of(inner)).strip()


def section_tree(body: str | None) -> Section:
    """Headings as a tree below a root of depth 0; a section's blocks end at the next heading of any depth."""
    root = Section(0, "", 1)
    stack = [root]
    for b in blocks_of(body or ""):
        if b.kind == "heading":
            while len(stack) > 1 and stack[-1].depth >= b.depth:
                stack.pop()
            s = Section(b.depth, b.text, b.line)
            stack[-1].children.append(s)
            stack.append(s)
        else:
            stack[-1].blocks.append(b)
    return root


def rule_fences(body: str | None) -> list[tuple[int, str]]:
    """(line, text) of every fence marked exactly ``yaml section-rules``, nested ones included."""
    out = []
    lines = (body or "").split("\n")
    i = 0
    while i < len(lines):
        bare = re.sub(r"^(?:[ \t]*(?:>|[-+*](?=[ \t])|\d{1,9}[.)](?=[ \t])))*[ \t]*", "", lines[i])
        if m := re.match(r"^(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$", bare):
            start, value = i, []
            i += 1
            while i < len(lines) and not re.match(rf"^[ \t>]*{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[i]):
                value.append(lines[i])
                i += 1
            if re.split(r"[ \t]+", m[2], maxsplit=1) == ["yaml", "section-rules"]:
                out.append((start + 1, "\n".join(value)))
        i += 1
    return out


# --- front matter --------------------------------------------------------------------------------------------------

_loader = None


def yaml_loader():
    """A loader whose scalars are plain: true/false, decimal numbers, null and dates; 12:30 and yes stay text."""
    global _loader
    if _loader is None:
        import yaml

        class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            pass

        Loader.yaml_implicit_resolvers = {}
        rules = [
            ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
            ("tag:yaml.org,2002:int", r"^[-+]?(?:0|[1-9][0-9]*|0x[0-9a-fA-F]+|0o?[0-7]+)$", "-+0123456789"),
            ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
            ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
            ("tag:yaml.org,2002:timestamp", r"^\d{4}-\d{2}-\d{2}$|^\d{4}-\d{1,2}-\d{1,2}(?:[Tt]|[ \t]+)\d{1,2}:\d{2}:\d{2}(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d{1,2}(?::?\d{2})?))?$", "0123456789"),
            ("tag:yaml.org,2002:merge", r"^<<$", "<"),
        ]
        for tag, pattern, first in rules:
            Loader.add_implicit_resolver(tag, re.compile(pattern), list(first))
        Loader.add_constructor("tag:yaml.org,2002:int", lambda self, node: int(node.value.replace("0o", "0"), 8) if re.match(r"^[-+]?0o?[0-7]+$", node.value) and node.value.strip("+-") != "0" else int(node.value, 0))
        Loader.add_constructor("tag:yaml.org,2002:float", lambda self, node: float(node.value.replace(".inf", "inf").replace(".Inf", "inf").replace(".INF", "inf").replace(".nan", "nan").replace(".NaN", "nan").replace(".NAN", "nan")))
        _loader = Loader
    return _loader


_ENTRY = re.compile(r"([A-Za-z_][A-Za-z0-9_-]{0,99}): ([A-Za-z0-9/](?:[A-Za-z0-9 _./()-]{0,800}[A-Za-z0-9_./()-])?)")
_INTEGER, _DECIMAL = re.compile(r"0|[1-9][0-9]{0,17}"), re.compile(r"[0-9]{1,17}\.[0-9]{1,17}")


@functools.lru_cache(4096)
def plain_text(word: str, resolvers: type) -> bool:
    """Whether a plain scalar is text to a loader or dumper (resolvers: its class)."""
    found = resolvers.yaml_implicit_resolvers
    return not any(pattern.match(word) for _, pattern in (*found.get(word[0], ()), *found.get(None, ())))


def plain_mapping(source: str) -> dict | None:
    """What load_yaml() gives for lines of a key and a plain scalar on one line each; None where anything else occurs."""
    loader, out = yaml_loader(), {}
    for line in source.split("\n"):
        m = _ENTRY.fullmatch(line)
        if m is None or not plain_text(m[1], loader):
            return None
        v = m[2]
        first = v[0]
        if first.isdigit():
            if _DECIMAL.fullmatch(v):
                v = float(v)
            elif _INTEGER.fullmatch(v):
                v = int(v)
            elif len(v) == 10 and v[4] == v[7] == "-" and (v[:4] + v[5:7] + v[8:]).isdigit():
                try:
                    v = datetime.date(int(v[:4]), int(v[5:7]), int(v[8:]))
                except ValueError:
                    return None
            elif not plain_text.__wrapped__(v, loader):
                return None
        elif first in "tTfFnN" and not plain_text(v, loader):
            return None
        out[m[1]] = v
    return out


def load_yaml(source: str):
    plain = plain_mapping(source)
    if plain is not None:
        return plain
    import yaml

    return yaml.load(source, Loader=yaml_loader())  # noqa: S506 - a SafeLoader


_FRONT = re.compile(r"^---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|$)", re.S)


def split_front(source: str) -> tuple[str | None, str, int]:
    """Front matter (null without one), body, and the number of lines before the body."""
    m = _FRONT.match(source)
    if not m:
        return None, source, 0
    return m[1], source[m.end() :], source[: m.end()].count("\n")


def js_text(v: object) -> str:
    """A value as a template string shows it."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:10]
    if isinstance(v, list):
        return ",".join(js_text(x) for x in v)
    return "[object Object]" if isinstance(v, dict) else str(v)


def typed(v: object) -> dict | None:
    """A parsed value as a value struct."""
    if v is None:
        return None
    if isinstance(v, str):
        return {"t": "string", "s": v, "n": None, "a": None}
    out = {"t": "object", "s": js_text(v), "n": None, "a": None}
    if isinstance(v, bool):
        out["t"] = "boolean"
    elif isinstance(v, (int, float)):
        out["t"], out["n"] = "number", float(v)
    elif isinstance(v, (datetime.datetime, datetime.date)):
        at = v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day)
        at = at if at.tzinfo else at.replace(tzinfo=datetime.UTC)
        out["t"], out["n"] = "date", at.timestamp() * 1000
    elif isinstance(v, list):
        out["t"], out["a"] = "array", [json.dumps(x, default=str, ensure_ascii=False) if isinstance(x, (dict, list)) else js_text(x) for x in v]
    return out


def flattened(fm: dict, prefix: str = "") -> dict[str, dict | None]:
    """Values by key, nested ones by dotted path as well."""
    out = {}
    for k, v in fm.items():
        out[f"{prefix}{k}"] = typed(v)
        if isinstance(v, dict):
            out |= flattened(v, f"{prefix}{k}.")
    return out


_json = json.JSONEncoder(default=lambda d: d.isoformat(), ensure_ascii=False, separators=(",", ":")).encode
_H2 = re.compile(r"(?m)^##[^\S\n]+(\S.*?)\s*$")


def parse_one(path: str | None, source: str | None, columns: Iterable[str] = DOCUMENT.names) -> dict:
    """The columns asked for, of one document; _fm is its front matter as a dict."""
    front, body, lines = split_front(source or "")
    out = {"path": path, "body": body, "body_line": lines}
    if any(c not in ("path", "folder", "body", "body_line", "headings") for c in columns):
        error, fm = None, {}
        if front is not None:
            try:
                fm = load_yaml(front)
                fm = {} if fm is None else fm
                if not isinstance(fm, dict):
                    error, fm = "front matter is no mapping", {}
            except Exception as e:  # what the YAML library raises is a value here, never a failure
                error = str(e).split("\n", 1)[0]
        template = fm.get("template")
        out |= {"template": template if isinstance(template, str) else None, "parse_error": error, "_fm": fm}
        if "fm" in columns:
            out["fm"] = flattened(fm)
        if "fm_json" in columns:
            out["fm_json"] = _json(fm)
    if "folder" in columns:
        out["folder"] = path.rpartition("/")[0] if path else None
    if "headings" in columns:
        out["headings"] = _H2.findall(body)
    return out


def plain_values(fm: dict) -> dict:
    """Front matter as its JSON reads, with dates as texts."""
    kinds = (str, int, float, type(None))
    if all(isinstance(k, str) and isinstance(v, (*kinds, datetime.date)) for k, v in fm.items()):
        return {k: v if isinstance(v, kinds) else v.isoformat() for k, v in fm.items()}
    return json.loads(_json(fm))


def parse_documents(raw: DataFrame, path: str = "path", source: str = "text", columns: Iterable[str] | None = None) -> DataFrame:
    """Documents from a path and a text column; a null text is an empty document. Nothing is shuffled. Only the columns asked for are made;
    without fm, fm_json, template and parse_error front matter is not read."""
    names = [n for n in DOCUMENT.names if columns is None or n in columns]

    def each(p, text):
        d = parse_one(p, text, names)
        yield tuple(d[k] for k in names)

    return crossing.crossed(raw, [F.col(path).cast("string").alias("path"), F.col(source).alias("text")], each, pa.schema([DOCUMENT.field(n) for n in names]), document_sql(names))


def relative_path(root: str) -> Column:
    uri = root.rstrip("/")
    return F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), "^" + re.escape(uri.removeprefix("file://")) + "/", "")


def wanted(path: Column, exclude: list[str] | None = None) -> Column:
    """Paths outside dot folders (but for .specify), skipped folders and excluded globs; README.md is left out."""
    hidden = path.rlike(r"(^|/)\.(?!specify(/|$))")
    skipped = path.rlike(r"(^|/)(" + "|".join(map(re.escape, SKIPPED_FOLDERS)) + ")/")
    out = ~hidden & ~skipped
    return out & ~T.matches_glob(path, exclude) if exclude else out


def read_markdown(spark: SparkSession, root: str, exclude: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
    """path (relative), text and mtime of every Markdown file below root."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root)
    rows = rows.select(relative_path(root).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"))
    rows = rows.where(wanted(F.col("path"), exclude))
    for_folders = F.lit(False)
    for f in folders or []:
        for_folders = for_folders | F.col("path").startswith(f.rstrip("/") + "/")
    return rows.where(for_folders) if folders else rows


def inventory(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """Paths of all files below root; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(relative_path(root).alias("path")).where(wanted(F.col("path"), exclude))


def commit_dates(commits: DataFrame, docs: DataFrame) -> DataFrame:
    """docs with mtime and created_at: newest and oldest commit time of the path in (path, committed_at), else the file's own."""
    seen = commits.groupBy("path").agg(F.max("committed_at").alias("_new"), F.min("committed_at").alias("_old"))
    out = docs.join(seen, "path", "left")
    return out.withColumns({"created_at": F.coalesce("_old", "mtime"), "mtime": F.coalesce("_new", "mtime")}).drop("_new", "_old")
