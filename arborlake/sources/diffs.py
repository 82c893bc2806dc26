"""Unified diffs: a parser for whole patches and one in plain DataFrame steps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERSIZE = 200_000
FILES_DDL = "path string, previous_path string, status string, additions long, deletions long, patch string, patch_source string"
_OCTAL = re.compile(rb"\\([0-7]{3}|.)")
_SIMPLE = {b"n": b"\n", b"t": b"\t", b"r": b"\r"}


def unquote(path: str) -> str:
    """A path as git writes it: C escapes inside quotes are bytes."""
    if not (len(path) >= 2 and path[0] == path[-1] == '"'):
        return path

    def one(m: re.Match[bytes]) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if len(x) == 3 else _SIMPLE.get(x, x)

    return _OCTAL.sub(one, path[1:-1].encode()).decode("utf-8", "replace")


def _side(path: str, mark: str) -> str | None:
    path = unquote(path.split("\t")[0].rstrip("\r"))
    return None if path == "/dev/null" else path.removeprefix(mark)


def parse_diff(text: str, oversize: int = OVERSIZE) -> list[dict]:
    """One record for each file of a diff.

    Hunk lines are counted by the numbers of their header, so a content line
    that looks like a header stays content.  Binary files have no counts, and a
    patch over ``oversize`` characters is left out, not cut.
    """
    files: list[dict] = []
    now: dict | None = None
    old = new = 0
    for line in text.split("\n"):
        if old > 0 or new > 0:
            kind = line[:1]
            if kind == "\\":
                now["lines"].append(line)
                continue
            old -= kind in ("-", " ", "", "\r")
            new -= kind in ("+", " ", "", "\r")
            now["additions"] += kind == "+"
            now["deletions"] += kind == "-"
            now["lines"].append(line)
            continue
        if line.startswith("diff --git "):
            rest = line[11:].rstrip("\r")
            m = re.fullmatch(r'("a/.*"|a/.*?) ("b/.*"|b/.*)', rest)
            a, b = (m[1], m[2]) if m else (rest, rest)
            now = {"path": _side(b, "b/"), "previous_path": _side(a, "a/"), "status": "modified", "additions": 0, "deletions": 0, "lines": []}
            files.append(now)
        elif now is None:
            continue
        elif line.startswith("new file"):
            now["status"] = "added"
        elif line.startswith("deleted file"):
            now["status"] = "removed"
        elif line.startswith(("rename from ", "copy from ")):
            now["status"] = "renamed" if line[0] == "r" else "copied"
            now["previous_path"] = unquote(line.split(" from ", 1)[1].rstrip("\r"))
        elif line.startswith(("rename to ", "copy to ")):
            now["path"] = unquote(line.split(" to ", 1)[1].rstrip("\r"))
        elif line.startswith("--- ") and (side := _side(line[4:], "a/")):
            now["previous_path"] = side
        elif line.startswith("+++ ") and (side := _side(line[4:], "b/")):
            now["path"] = side
        elif m := re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line):
            old, new = int(m[1] or 1), int(m[2] or 1)
            now["lines"].append(line)
    for f in files:
        patch = "\n".join(f.pop("lines"))
        f["patch"], f["patch_source"] = ("", "oversize") if len(patch) > oversize else (patch, "diff" if patch else "none")
        if f["status"] in ("added", "modified", "removed"):
            f["previous_path"] = None
    return files


def parse_patch_valid(patch: str) -> bool:
    """Hunks are in order, do not overlap and have the lines that they announce."""
    lines, at, last_old, last_new = patch.split("\n"), 0, 0, 0
    while at < len(lines):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", lines[at])
        if not m:
            return at > 0 and not any(lines[at:])
        old_at, old, new_at, new = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
        if old_at < last_old or new_at < last_new:
            return False
        last_old, last_new, at = old_at + old, new_at + new, at + 1
        while old > 0 or new > 0:
            if at >= len(lines) or lines[at][:1] not in ("-", "+", " ", "\\"):
                return False
            old -= lines[at][:1] in "- "
            new -= lines[at][:1] in "+ "
            at += 1
        if old < 0 or new < 0:
            return False
        while at < len(lines) and lines[at].startswith("\\"):
            at += 1
    return bool(lines and lines[0].startswith("@@"))


def diff_files(diffs: DataFrame, key: str = "key", text: str = "diff") -> DataFrame:
    """Diff texts to file rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [{"key": k, **f} for k, t in zip(pdf[key], pdf[text], strict=True) for f in parse_diff(t or "")]
            yield pd.DataFrame(rows, columns=["key", *(c.split(" ")[0] for c in FILES_DDL.split(", "))])

    kind = dict(diffs.dtypes)[key]
    return diffs.select(key, text).mapInPandas(run, f"key {kind}, {FILES_DDL}")


def simple_diff_counts(diffs: DataFrame, key: str = "key", text: str = "diff") -> DataFrame:
    """(key, path, additions, deletions) by a running count of file headers."""
    lines = diffs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line")).withColumn("line", F.rtrim("line"))
    head = F.col("line").startswith("diff --git ")
    run = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("file", F.sum(head.cast("int")).over(run)).filter("file > 0")
    marked = F.col("line").startswith("+++ ") | F.col("line").startswith("--- ")
    path = F.max(F.when(head, F.regexp_extract("line", r"^diff --git .* b/(.*)$", 1)))
    return lines.groupBy(key, "file").agg(path.alias("path"), F.count_if(F.col("line").startswith("+") & ~marked).alias("additions"), F.count_if(F.col("line").startswith("-") & ~marked).alias("deletions")).drop("file")


def suggestions(body: str) -> list[str]:
    """Texts of suggestion fences; an unclosed fence runs to the end."""
    out: list[str] = []
    fence: str | None = None
    mine: list[str] = []
    wanted = False
    for line in body.replace("\r\n", "\n").split("\n"):
        m = re.match(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)", line)
        if fence is None:
            if m:
                fence, wanted, mine = m[1], m[2].lower() == "suggestion", []
        elif re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*", line):
            if wanted:
                out.append("\n".join(mine))
            fence = None
        else:
            mine.append(line)
    if fence is not None and wanted:
        out.append("\n".join(mine))
    return out
