"""Weak signals of a fork side by side: kind of work, language, extensions, name, impact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.hashing import fnv1a_32
from arborlake.functions.paths import extension
from arborlake.functions.vectors import language_one_hot, one_hot

# Kinds of work, their marks in paths, extensions and weights.
ARCHETYPES = ["general", "plugin", "security", "docs", "test", "migration", "refactor", "config"]
SECURITY_WORDS = ["auth", "security", "jwt", "oauth", "crypto", "password", "token"]
PLUGIN_PREFIXES = ["plugins/", "plugin/", "extensions/", "addons/", "ext/"]
MIGRATION_PREFIXES = ["migrations/", "db/migrate/", "alembic/", "flyway/"]
DOC_SUFFIXES = [".md", ".rst", ".txt"]
DOC_PREFIXES = ["docs/", "doc/"]
DOC_NAMES = ["readme", "changelog", "license"]
TEST_SUFFIXES = ["_test.go", "_test.py", ".test.ts", ".test.tsx", ".spec.ts"]
TEST_PREFIXES = ["tests/", "test/", "__tests__/"]
CONFIG_SUFFIXES = [".yaml", ".yml", ".toml", ".json", ".ini", ".cfg", ".conf"]
CONFIG_NAMES = [".gitignore", "dockerfile", "makefile"]
EXTENSIONS = [".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".rs", ".cpp", ".c", ".h", ".cs", ".rb", ".php", ".sh", ".md", ".yaml", ".yml", ".toml", ".json", ".html", ".css", ".sql", ".sol"]
WEIGHTS = {"archetype": 0.2, "language": 0.1, "extensions": 0.15, "name": 0.05, "impact": 0.5}
NAME_SLOTS = 16


def pattern(prefixes: list[str], suffixes: list[str], names: list[str]) -> str:
    """A pattern of lower-case paths that begin, end or are named so."""
    quote = lambda words: "|".join(w.replace(".", "[.]") for w in words)
    parts = [f"^({quote(prefixes)})" if prefixes else "", f"({quote(suffixes)})$" if suffixes else "", f"(^|/)({quote(names)})[^/]*$" if names else ""]
    return "|".join(p for p in parts if p)


SECURITY, MIGRATION, PLUGIN = "|".join(SECURITY_WORDS), pattern(MIGRATION_PREFIXES, [], []), pattern(PLUGIN_PREFIXES, [], [])
TESTS, DOCS, CONFIG = pattern(TEST_PREFIXES, TEST_SUFFIXES, []), pattern(DOC_PREFIXES, DOC_SUFFIXES, DOC_NAMES), pattern([], CONFIG_SUFFIXES, CONFIG_NAMES)


def file_signals(files: DataFrame, by: str = "fork_id") -> DataFrame:
    """archetype and the shares of extensions of each fork's files.

    A mark of security, migrations or plugins in any path decides, in that
    order; then tests, docs or settings only; then five files or more with about
    as much removed as added.
    """
    path = F.lower("path")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, EXTENSIONS)), extension(path)), F.lit(0))
    rows = files.select(by, "additions", "deletions", path.alias("path"), place.alias("place"))
    path = F.col("path")
    df = rows.groupBy(by).agg(
        *(F.bool_or(path.rlike(p)).alias(n) for n, p in (("security", SECURITY), ("migration", MIGRATION), ("plugin", PLUGIN))),
        *(F.bool_and(path.rlike(p)).alias(n) for n, p in (("test", TESTS), ("docs", DOCS), ("config", CONFIG))),
        F.count("*").alias("n"), F.sum("additions").alias("a"), F.sum("deletions").alias("d"),
        *(F.count_if(F.col("place") == i % (len(EXTENSIONS) + 1)).alias(f"e{i}") for i in range(1, len(EXTENSIONS) + 2)),
    )
    even = (F.col("n") >= 5) & (F.abs(F.col("a") - F.col("d")) < 0.1 * (F.col("a") + F.col("d")))
    kind = F.when(F.lit(False), "general")
    for name in ("security", "migration", "plugin", "test", "docs", "config"):
        kind = kind.when(F.col(name), name)
    shares = F.array(*(F.col(f"e{i}") / F.col("n") for i in range(1, len(EXTENSIONS) + 2)))
    return df.select(by, kind.when(even, "refactor").otherwise("general").alias("archetype"), shares.alias("extensions"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def name_slots(name: Column) -> Column:
    """How often the words of a name hash to each slot, at unit length; zeros for no word."""
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[-_/ .]"), lambda w: w != "")
    places = F.transform(words, lambda w: fnv1a_32(w) % NAME_SLOTS)
    count = lambda at: F.transform(F.sequence(F.lit(0), F.lit(NAME_SLOTS - 1)), lambda i: F.size(F.filter(at, lambda s: s == i)).cast("double"))
    length = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda t, c: t + c * c))
    unit = lambda counts: _let(length(counts), lambda n: F.transform(counts, lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))))
    return _let(places, lambda at: _let(count(at), unit))


def weak_signals(archetype: Column, language: Column, extensions: Column, name: Column, impact: Column) -> Column:
    """All blocks scaled by their weights, in one array (E6).  Null extensions are of a fork without files."""
    scaled = lambda v, part: F.transform(v, lambda x: x * F.lit(WEIGHTS[part]))
    none = F.array_repeat(F.lit(0.0), len(EXTENSIONS) + 1)
    reach = F.least(F.greatest(F.coalesce(impact, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.concat(
        scaled(one_hot(F.coalesce(archetype, F.lit("general")), ARCHETYPES), "archetype"), scaled(language_one_hot(language), "language"),
        scaled(F.coalesce(extensions, none), "extensions"), scaled(name_slots(name), "name"), F.array(reach * WEIGHTS["impact"]),
    )
