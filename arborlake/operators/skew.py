"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], rows: int, most: int = 1000) -> DataFrame:
    """Inner join to ``right``, whose keys are unique and whose ``n`` counts their rows in ``left``.

    ``rows`` is the number of rows of ``left``.  Fewer than ``most`` keys can
    hold more than a ``most``-th of them each; these are broadcast, so their rows
    stay where they are.  All others meet in an ordinary equi-join.  ``left`` is
    read twice and should be a written table.
    """
    bound = max(200, rows // most)
    hot = right.filter(F.col("n") > bound).drop("n")
    cold = right.filter(F.col("n") <= bound).drop("n")
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
