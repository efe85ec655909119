"""Honest subset grammars for diagram and feature fences: (line within the fence, problem) pairs; none when it reads well.

Diagrams: the first word must be a known diagram kind; flowchart lines may not leave brackets or quotes open, and need their
subgraphs ended. Features: a Feature line, then steps only inside scenarios or backgrounds; tables may not be ragged,
doc strings must close; Examples belong to outlines.
"""

from __future__ import annotations

import re

DIAGRAMS = ("graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "stateDiagram-v2", "erDiagram", "journey", "gantt", "pie", "quadrantChart", "requirementDiagram", "gitGraph", "mindmap", "timeline", "sankey-beta", "xychart-beta", "block-beta", "C4Context")
_STEP = re.compile(r"^(?:Given|When|Then|And|But|\*)(?:\s|$)")
_KEYWORD = re.compile(r"^(Feature|Rule|Background|Scenario Outline|Scenario Template|Scenario|Example|Examples|Scenarios):")


def diagram_problems(text: str) -> list[tuple[int, str]]:
    lines = [(i, re.sub(r"%%.*$", "", s).strip()) for i, s in enumerate(text.split("\n"), 1)]
    if lines and lines[0][1] == "---":
        end = next((k for k in range(1, len(lines)) if lines[k][1] == "---"), None)
        lines = lines[end + 1 :] if end else []
    lines = [(i, s) for i, s in lines if s]
    if not lines:
        return [(1, "the diagram is empty")]
    kind = re.split(r"[\s:;]", lines[0][1])[0]
    if kind not in DIAGRAMS:
        return [(lines[0][0], f"no diagram kind: {kind}")]
    if kind not in ("graph", "flowchart"):
        return []
    m = re.match(r"^(?:graph|flowchart)(?:\s+(\w+))?\s*;?", lines[0][1])
    if m and m[1] and m[1] not in ("TB", "TD", "BT", "RL", "LR"):
        return [(lines[0][0], f"no direction: {m[1]}")]
    depth = 0
    for i, s in lines[1:]:
        bare = re.sub(r'"[^"]*"', "", s)
        if '"' in bare:
            return [(i, "a quote stays open")]
        shapes = re.sub(r"[-=.]+>|[<>]", "", bare)
        if any(shapes.count(a) != shapes.count(b) for a, b in ("[]", "{}", "()")) and not re.search(r"[/\\]", shapes):
            return [(i, "a bracket stays open")]
        if re.search(r"(?:-->|---|-\.->|==>)\s*$", bare):
            return [(i, "an edge leads nowhere")]
        if re.match(r"^(?:-->|---|-\.->|==>)", bare):
            return [(i, "an edge comes from nowhere")]
        depth += bare.startswith("subgraph")
        depth -= bare == "end"
        if depth < 0:
            return [(i, "end without subgraph")]
    return [(lines[-1][0], "a subgraph stays open")] if depth else []


def feature_problems(text: str) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    feature = scenario = steps = outline = False
    doc: str | None = None
    width: int | None = None
    for i, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if doc:
            doc = None if s.startswith(doc) else doc
            continue
        if not s or s.startswith("#"):
            continue
        if s[:3] in ('"""', "```"):
            if not steps:
                out.append((i, "a doc string without a step"))
            doc = s[:3]
            continue
        if s.startswith("|"):
            cells = s.count("|") - s.count("\\|")
            if width is not None and cells != width:
                out.append((i, "the table is ragged"))
            width = cells
            continue
        width = None
        if s.startswith("@"):
            continue
        if m := _KEYWORD.match(s):
            word = m[1]
            if word == "Feature":
                if feature:
                    out.append((i, "a second feature"))
                feature = True
            elif not feature:
                out.append((i, f"{word} before a feature"))
            elif word in ("Examples", "Scenarios"):
                if not outline:
                    out.append((i, "examples without an outline"))
            else:
                scenario = word != "Rule"
                outline = word in ("Scenario Outline", "Scenario Template", "Scenario", "Example")
            steps = False
        elif _STEP.match(s):
            if not scenario:
                out.append((i, "a step outside a scenario"))
            steps = True
        elif steps or not feature:
            out.append((i, f"unexpected: {s[:40]}"))
    if doc:
        out.append((text.count("\n") + 1, "a doc string stays open"))
    return out
