"""Imports of Go and Python sources, and the checks of small JSON inputs."""

from __future__ import annotations

import ast
import json
import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of score weights.
WEIGHT_NAMES = ("recency", "stars", "sub_forks", "releases", "mna", "sync_ratio", "feature_ratio", "lone_wolf", "span", "novelty", "topic_tag", "sibling_sim", "fork_farmer")


def go_imports(source: str) -> list[str]:
    """Imported packages outside the standard library: their first part has a dot."""
    bare = re.sub(r"//[^\n]*|/\*.*?\*/", "", source, flags=re.S)
    found = re.findall(r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', bare, re.M)
    for block in re.findall(r"^\s*import\s*\(([^)]*)\)", bare, re.M):
        found += re.findall(r'"([^"]+)"', block)
    return sorted({p for p in found if "." in p.split("/")[0]})


def python_imports(source: str, module: str = "") -> list[str]:
    """Imported modules outside the standard library; relative ones are made absolute."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return []
    found: set[str] = set()
    package = module.split(".")[:-1]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            base = package[: len(package) - node.level + 1] if node.level else []
            name = ".".join([*base, *([node.module] if node.module else [])])
            found |= {name} if name else {a.name for a in node.names}
    return sorted(m for m in found if m.split(".")[0] not in sys.stdlib_module_names)


def resolve_module(name: str, modules: set[str]) -> str:
    """The module itself, its nearest known parent, or the name as an external one."""
    parts = name.split(".")
    return next((".".join(parts[:n]) for n in range(len(parts), 0, -1) if ".".join(parts[:n]) in modules), name)


def read_weights(text: str) -> dict[str, float]:
    """Weights of a JSON object: known names, numbers in [0, 2]."""
    data = json.loads(text)
    bad = [k for k, v in data.items() if k not in WEIGHT_NAMES or isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 2]
    if bad:
        raise ValueError(f"bad weights: {', '.join(sorted(bad))}")
    return {k: float(v) for k, v in data.items()}


def read_lanes(text: str, known: tuple[str, ...]) -> list[str]:
    """A comma list of known lanes, each once, in order."""
    lanes = list(dict.fromkeys(x.strip().lower() for x in text.split(",") if x.strip()))
    if not lanes or any(x not in known for x in lanes):
        raise ValueError(f"lanes are some of {', '.join(known)}")
    return lanes


def weights(text: Column) -> Column:
    """Map of the weights in a JSON text; null where ``read_weights`` would refuse it."""
    data = F.from_json(text, "map<string,double>", {"mode": "PERMISSIVE"})
    good = F.forall(F.map_entries(data), lambda e: e["key"].isin(*WEIGHT_NAMES) & e["value"].between(0, 2))
    return F.when(good, data)


def lanes(text: Column, known: tuple[str, ...]) -> Column:
    """The lanes of a comma list, each once, in order; null where ``read_lanes`` would refuse it."""
    found = F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return F.when((F.size(found) > 0) & F.forall(found, lambda x: x.isin(*known)), found)


def topic_idf(text: Column) -> Column:
    """Map of topic to weight of a JSON object; empty, so without any penalty, where it cannot be read."""
    return F.coalesce(F.from_json(text, "map<string,double>"), F.create_map().cast("map<string,double>"))
