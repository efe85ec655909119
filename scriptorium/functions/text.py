"""Text functions as columns: slugs, code stripping, paths, globs, distances."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
TASK_ID = r"^[a-z]+-\d+-[a-z0-9]+(?:-[a-z0-9]+)*\z"


def suggest_slug(name: Column) -> Column:
    """A kebab-case form: camel case is parted, blanks and underscores become hyphens, the rest is dropped."""
    out = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1-$2")
    out = F.lower(F.regexp_replace(out, r"[_\s]+", "-"))
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9-]", ""), "-+", "-")
    return F.coalesce(F.regexp_replace(out, r"^-|-\z", ""), F.lit(""))


def slug_to_heading(slug: Column) -> Column:
    """Hyphenated words with capital first letters; the rest of each word stays."""
    words = F.split(slug, "-")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def heading_to_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")


def anchor_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s-]", ""), r"\s+", "-")


def strip_code(text: Column) -> Column:
    """Text without fenced blocks, inline code and indented lines, in that order."""
    out = F.coalesce(text, F.lit(""))
    for pattern in ("(?s)```.*?```", "(?s)~~~.*?~~~", "`[^`\\n]*`", "(?m)^( {4,}|\\t)[^\\n]*$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def link_path(raw: Column) -> Column:
    """A link target without its anchor; null for URLs, bracketed placeholders and source-line references."""
    unusable = raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | raw.rlike(r"\[[^\]]*\]") | raw.rlike(r"^#") | raw.rlike(r":\d+(-\d+)?\z")
    return F.when(~unusable, F.nullif(F.split_part(raw, F.lit("#"), F.lit(1)), F.lit("")))


def resolve_path(folder: Column, target: Column) -> Column:
    """target from folder with . and .. taken away; a leading slash means the root. Null where it leaves the root, or is null."""
    joined = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", folder, target))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))

    def step(acc, p):
        up = p == ".."
        return F.struct(
            F.when(up, F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).otherwise(F.concat(acc["p"], F.array(p))).alias("p"),
            (acc["out"] | (up & (F.size(acc["p"]) == 0))).alias("out"),
        )

    done = F.aggregate(parts, start, step)
    return F.when(target.isNotNull() & ~done["out"], F.array_join(done["p"], "/"))


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*\\z", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: * and ? within a segment, ** across segments, [...] and {a,b}."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
        elif c == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return "^" + out + r"\z"


def matches_glob(text: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | text.rlike(glob_regex(g))
    return found


def normalised_distance(a: Column, b: Column) -> Column:
    """Edits over the longer length; 0 for equal texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def nearest(word: str, known: list[str]) -> str | None:
    """The known word within a distance scaled to its length: one equal but for case, else the nearest, shortest, earliest."""
    for k in known:
        if k.lower() == word.lower():
            return k
    best = None
    for i, k in enumerate(known):
        limit = 0 if len(k) <= 1 else 1 if len(k) <= 3 else min(2, len(k) // 3 + 1)
        d = _edits(word.lower(), k.lower())
        if d <= limit and (best is None or (d, len(k), i) < best[0]):
            best = ((d, len(k), i), k)
    return best[1] if best else None


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]
