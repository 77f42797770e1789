"""Parsers that the JVM has no equivalent of: Python sources, YAML, JSON in free text. All work on Arrow batches."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFINITIONS = "array<struct<symbol: string, kind: string, start: int, end: int>>"
CALLS = "array<struct<line: int, name: string, resolved: string>>"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def definitions(text: str | None, module: str) -> list[dict]:
    """Classes and functions, nested ones too, found through class and function bodies; none if the text is no Python."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    out: list[dict] = []
    waiting = [(node, module) for node in reversed(tree.body)]
    while waiting:
        node, owner = waiting.pop()
        if isinstance(node, (ast.ClassDef, *FUNCTIONS)):
            name = f"{owner}.{node.name}" if owner else node.name
            out.append({"symbol": name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "start": node.lineno, "end": node.end_lineno or node.lineno})
            waiting += [(child, name) for child in reversed(node.body)]
    return out


def import_aliases(text: str | None, module: str, package: bool = False, local: bool = False) -> dict[str, str]:
    """Names that top-level imports bind, with what they stand for; ``local`` adds the module's own definitions."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return {}
    found: dict[str, str] = {}
    for node in tree.body:
        if isinstance(node, ast.Import):
            for name in node.names:
                found[name.asname or name.name.split(".")[0]] = name.name if name.asname else name.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = module.split(".") if module else []
            if node.level:
                base = base[: len(base) - node.level + (1 if package else 0)]
                source = ".".join([*base, *([node.module] if node.module else [])])
            else:
                source = node.module or ""
            found |= {n.asname or n.name: f"{source}.{n.name}".strip(".") for n in node.names if n.name != "*"}
        elif local and isinstance(node, (ast.ClassDef, *FUNCTIONS)):
            found[node.name] = f"{module}.{node.name}".strip(".")
    return found


def target_node(tree: ast.AST, target: str, kind: str) -> ast.AST | None:
    """The first definition in line order that bears the target's last name, inside its class for methods."""
    parts = target.split(".")
    owner = parts[-2] if kind in ("method", "constructor") and len(parts) > 1 else None
    found = []
    waiting: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while waiting:
        node, inside = waiting.pop()
        if isinstance(node, (ast.ClassDef, *FUNCTIONS)) and node.name == parts[-1] and (owner is None or inside == owner):
            found.append(node)
        within = node.name if isinstance(node, ast.ClassDef) else inside
        waiting += [(child, within) for child in ast.iter_child_nodes(node)]
    return min(found, key=lambda n: n.lineno, default=None)


def direct_calls(text: str | None, target: str, kind: str, module: str) -> list[dict]:
    """Calls in the target's own body, not in nested definitions or lambdas, with names resolved through imports."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    node = target_node(tree, target, kind)
    if node is None:
        return []
    known = import_aliases(text, module, local=True)
    parent = target.rpartition(".")[0]
    out = []
    waiting = list(reversed(node.body))
    while waiting:
        item = waiting.pop()
        if isinstance(item, (ast.ClassDef, ast.Lambda, *FUNCTIONS)):
            continue
        if isinstance(item, ast.Call) and (name := _dotted(item.func)):
            root, _, rest = name.partition(".")
            if root in ("self", "cls") and rest:
                resolved = f"{parent}.{rest}"
            else:
                resolved = f"{known[root]}.{rest}".rstrip(".") if root in known else name
            out.append({"line": item.lineno, "name": name, "resolved": resolved})
        waiting += reversed(list(ast.iter_child_nodes(item)))
    return sorted(out, key=lambda c: (c["line"], c["name"]))


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _series(function, kind: str, *columns: Column) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([function(*row) for row in zip(*(batch[c] for c in batch), strict=True)], dtype=object)

    return run(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]))


def definition_spans(text: Column, module: Column) -> Column:
    return _series(definitions, DEFINITIONS, text, module)


def alias_map(text: Column, module: Column) -> Column:
    return _series(lambda t, m: json.dumps(import_aliases(t, m, local=True)), "string", text, module).try_cast("string")


def call_sites(text: Column, target: Column, kind: Column, module: Column) -> Column:
    return _series(direct_calls, CALLS, text, target, kind, module)


# ---------------------------------------------------------------- payloads in answers


def _fences(text: str) -> list[str]:
    bare = re.sub(r"(?is)^\s*```(?:yaml|yml|json)?\s*|\s*```\s*$", "", text)
    return [bare, *reversed(re.findall(r"(?is)```(?:yaml|yml|json)?\s*(.*?)```", text)), text]


def repaired_yaml(text: str) -> str:
    """Plain values with a colon inside or a leading sign that YAML reserves, put in quotes."""

    def quote(m: re.Match) -> str:
        value = m[3].strip()
        plain = value and value[0] not in "\"'[{|>" and (": " in value or value[0] in "@`%&*!" or " #" in value)
        return f"{m[1]}{m[2]} {json.dumps(value)}" if plain else m[0]

    return re.sub(r"(?m)^(\s*(?:-\s+)?)([A-Za-z_]\w*:)[ \t]+(\S.*)$", quote, text)


def payload(text: str | None) -> Any:
    """The mapping or list in an answer: from fenced blocks, the last first, else the whole; repaired if need be."""
    import yaml

    for part in _fences(text or ""):
        for candidate in (part, repaired_yaml(part)):
            try:
                found = yaml.safe_load(candidate)
            except (yaml.YAMLError, ValueError):
                continue
            if isinstance(found, (dict, list)):
                return found
    return None


def json_objects(text: str | None) -> list[dict]:
    decode, out, at = json.JSONDecoder().raw_decode, [], 0
    text = text or ""
    while (at := text.find("{", at)) >= 0:
        try:
            found, end = decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(found, dict):
            out.append(found)
        at = max(end, at + 1)
    return out


def action_object(text: str | None) -> dict | None:
    """The last object that is an action or a prediction, else the last of all."""
    found = json_objects(text)
    fitting = [x for x in found if "action" in x or ("case_id" in x and "edges" in x)]
    return (fitting or found or [None])[-1]


def normal_predictions(found: Any, strict: bool = True) -> list[dict]:
    """[{case_id, edges}] from any accepted wrapping; ``strict`` raises on an edge that is no mapping, else it goes."""
    if isinstance(found, dict) and isinstance(found.get("prediction"), dict):
        found = found["prediction"]
    if isinstance(found, dict) and isinstance(found.get("cases"), list):
        found = found["cases"]
    elif isinstance(found, dict) and "case_id" in found:
        found = [found]
    elif isinstance(found, dict):
        found = [{"case_id": k, **(v if isinstance(v, dict) else {"edges": v})} for k, v in found.items()]
    out = []
    for item in found or []:
        if not isinstance(item, dict) or "case_id" not in item:
            continue
        edges = item.get("edges", item.get("predicted_edges")) or []
        wrong = [e for e in edges if not isinstance(e, dict)]
        if wrong and strict:
            raise ValueError(f"{item['case_id']}: an edge is no mapping")
        out.append({"case_id": str(item["case_id"]), "edges": [e for e in edges if isinstance(e, dict)]})
    return out


def payload_json(text: Column) -> Column:
    """JSON of the payload in each text; null without one."""
    return _series(lambda t: None if (p := payload(t)) is None else json.dumps(p, default=str), "string", text)


def action_json(text: Column) -> Column:
    return _series(lambda t: None if (p := action_object(t)) is None else json.dumps(p), "string", text)


EDGE = "struct<caller: string, callee: string, file: string, line: string, evidence: string, confidence_type: string, notes: string>"


def predictions(texts: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """case_id, pos and the edge fields of every prediction in the texts."""

    def flat(t: str | None) -> list[dict]:
        rows = normal_predictions(payload(t), strict)
        keep = ("caller", "callee", "file", "line", "evidence", "confidence_type", "notes")
        return [{"case_id": r["case_id"], "edges": [{k: None if e.get(k) is None else str(e[k]) for k in keep} for e in r["edges"]]} for r in rows]

    read = texts.select(F.explode(_series(flat, f"array<struct<case_id: string, edges: array<{EDGE}>>>", F.col(text))).alias("p"))
    return read.select("p.case_id", F.posexplode("p.edges").alias("pos", "e")).select("case_id", "pos", "e.*")
