"""File paths: classes, weights, parts and patterns as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a file junk, generated, documentation, core or secondary.
JUNK_PREFIXES = ("vendor/", "node_modules/", "dist/", "build/", "third_party/", "external/", ".git/", ".next/")
JUNK_SUFFIXES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "cargo.lock", "gemfile.lock", "poetry.lock", "composer.lock", "pipfile.lock", ".min.js", ".min.css")
GENERATED_PREFIXES = ("__generated__/", "generated/")
GENERATED_SUFFIXES = (".pb.go", "_gen.go", ".generated.ts", ".generated.go", ".pb.swift", ".pb.cc", ".pb.h")
DOCS_EXTENSIONS = (".md", ".markdown", ".rst", ".txt", ".adoc", ".org", ".tex")
CORE_EXTENSIONS = (".go", ".rs", ".ts", ".tsx", ".js", ".jsx", ".py", ".c", ".cpp", ".cc", ".h", ".hpp", ".java", ".swift", ".kt", ".rb", ".cs")
SECONDARY_EXTENSIONS = (".md", ".yaml", ".yml", ".json", ".toml", ".sql")


def starts_with(path: Column, prefixes: tuple[str, ...]) -> Column:
    return path.rlike("^(" + "|".join(map(re.escape, prefixes)) + ")")


def ends_with(path: Column, suffixes: tuple[str, ...]) -> Column:
    return path.rlike("(" + "|".join(map(re.escape, suffixes)) + ")$")


def extension(path: Column) -> Column:
    """From the last dot of the last part on, with the dot; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    """The directory with its slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*/)[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """Every directory above a path, each ending in a slash."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    prefix = lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))
    return F.when(depth < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), prefix))


def file_class(path: Column) -> Column:
    """source, docs, junk or generated; the first rule that holds."""
    low = F.lower(path)
    docs = base_name(low).isin(".gitignore", ".gitattributes") | low.startswith(".github/") | extension(low).isin(*DOCS_EXTENSIONS)
    return (
        F.when(starts_with(low, JUNK_PREFIXES) | ends_with(low, JUNK_SUFFIXES), "junk")
        .when(starts_with(low, GENERATED_PREFIXES) | ends_with(low, GENERATED_SUFFIXES), "generated")
        .when(docs, "docs")
        .otherwise("source")
    )


def class_weight(kind: Column) -> Column:
    return F.when(kind == "source", F.lit(1.0)).when(kind == "docs", F.lit(0.5)).otherwise(F.lit(0.0))


def type_weight(path: Column, kind: Column) -> Column:
    """1 for core languages, .3 for secondary and unknown, .05 for junk and generated (M9)."""
    ext = extension(F.lower(path))
    return F.when(ext.isin(*CORE_EXTENSIONS), F.lit(1.0)).when(ext.isin(*SECONDARY_EXTENSIONS), F.lit(0.3)).when(kind.isin("junk", "generated"), F.lit(0.05)).otherwise(F.lit(0.3))


def normalize_pattern(pattern: str) -> str:
    """A pattern relative to the top; raises ValueError on one that is not (F8)."""
    p = pattern.strip()
    while p.startswith("./"):
        p = p[2:]
    p = p.rstrip("/")
    if not p or pattern.strip().startswith("/") or ".." in p.split("/"):
        raise ValueError(f"bad path pattern: {pattern!r}")
    return p


def normalized_pattern(pattern: Column) -> Column:
    """``normalize_pattern`` of a column; null for a pattern that is not relative to the top."""
    bare = F.trim(pattern)
    p = F.regexp_replace(F.regexp_replace(bare, r"^(\./)+", ""), "/+$", "")
    return F.when((p != "") & ~bare.startswith("/") & ~F.array_contains(F.split(p, "/"), ".."), p)


def glob_regex(pattern: str) -> str | None:
    """Java regular expression of a glob; None for a literal path."""
    if not re.search(r"[*?\[]", pattern):
        return None
    parts = pattern.split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += "(?:.*)" if last else "(?:[^/]+/)*"
            continue
        piece, j = "", 0
        while j < len(part):
            c = part[j]
            if c == "*":
                piece += "[^/]*"
            elif c == "?":
                piece += "[^/]"
            elif c == "[":
                end = part.find("]", j + 1)
                if end < 0:
                    raise ValueError(f"bad path pattern: {pattern!r}")
                piece += "[" + part[j + 1 : end].replace("\\", "\\\\") + "]"
                j = end
            else:
                piece += re.escape(c)
            j += 1
        out += piece + ("" if last else "/")
    return f"^{out}$"


def matches(path: Column, pattern: str) -> Column:
    """A literal names a file or a directory above; a glob is matched part by part."""
    p = normalize_pattern(pattern)
    regex = glob_regex(p)
    return path.rlike(regex) if regex else (path == p) | path.startswith(p + "/")


def first_match(path: Column, patterns: list[str]) -> Column:
    """The first pattern of the list that matches, or null."""
    return F.coalesce(*(F.when(matches(path, p), F.lit(p)) for p in patterns)) if patterns else F.lit(None).cast("string")
