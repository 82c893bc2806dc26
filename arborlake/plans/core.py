"""How a query is declared: a function and the SQL that restates it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = query
            if sql:
                self.oracles[name] = sql
            return query

        return keep


def r6(x: Column) -> Column:
    """Rounded to six places, as results are compared; no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


# SQL text of the shared functions, written apart from the Column forms.


def sql_log_norm(x: str, half: float) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, log2(1.0::DOUBLE + {x}) / log2({1 + half}::DOUBLE)) END)"


def sql_decay(days: str, half: str) -> str:
    return f"(CASE WHEN {days} <= 0 THEN 1.0::DOUBLE WHEN {half} <= 0 THEN 0.0::DOUBLE ELSE exp(-0.693::DOUBLE * {days} / nullif({half}, 0)) END)"


def sql_days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0::DOUBLE)"


def sql_percentile(value: str, by: str) -> str:
    return f"((rank() OVER (PARTITION BY {by} ORDER BY {value}) - 1 + count(*) OVER (PARTITION BY {by}, {value}) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {by}))"


def sql_cdf(x: str) -> str:
    a = f"least(abs({x}), 37.0::DOUBLE)"
    top = "0.0352624965998911::DOUBLE"
    for t in ("0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376"):
        top = f"({top} * {a} + {t}::DOUBLE)"
    bottom = "0.0883883476483184::DOUBLE"
    for t in ("1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752"):
        bottom = f"({bottom} * {a} + {t}::DOUBLE)"
    far = f"(exp(-{a} * {a} / 2) / ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65::DOUBLE))))) / 2.506628274631::DOUBLE)"
    tail = f"(CASE WHEN {a} < 7.07106781186547::DOUBLE THEN exp(-{a} * {a} / 2) * {top} / {bottom} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def sql_class(path: str) -> str:
    p = f"lower({path})"
    return f"""(CASE
      WHEN regexp_matches({p}, '^(vendor/|node_modules/|dist/|build/|third_party/|external/|[.]git/|[.]next/)') OR regexp_matches({p}, '(package-lock[.]json|yarn[.]lock|pnpm-lock[.]yaml|go[.]sum|cargo[.]lock|gemfile[.]lock|poetry[.]lock|composer[.]lock|pipfile[.]lock|[.]min[.]js|[.]min[.]css)$') THEN 'junk'
      WHEN regexp_matches({p}, '^(__generated__/|generated/)') OR regexp_matches({p}, '([.]pb[.]go|_gen[.]go|[.]generated[.]ts|[.]generated[.]go|[.]pb[.]swift|[.]pb[.]cc|[.]pb[.]h)$') THEN 'generated'
      WHEN regexp_matches({p}, '(^|/)([.]gitignore|[.]gitattributes)$') OR starts_with({p}, '.github/') OR regexp_matches({p}, '[.](md|markdown|rst|txt|adoc|org|tex)$') THEN 'docs'
      ELSE 'source' END)"""
