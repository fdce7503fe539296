"""Nearest neighbours, exactly (O-89c, O-89g, O-80): distances are columns, top k is Spark's, so each task keeps k rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE = "_INDEX_SCORE"


def distance(column: str, query: list[float], metric: str = "l2") -> Column:
    """l2 (squared root of the sum), cosine (1 - similarity) or inner (negated product), in doubles."""
    v, q = F.transform(F.col(column), lambda x: x.cast("double")), F.array(*(F.lit(float(x)) for x in query))
    total = lambda f: F.aggregate(F.zip_with(v, q, f), F.lit(0.0), lambda a, x: a + x)
    if metric == "l2":
        return F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if metric == "inner":
        return -total(lambda x, y: x * y)
    if metric == "cosine":
        return 1 - total(lambda x, y: x * y) / (F.sqrt(total(lambda x, y: x * x)) * F.sqrt(total(lambda x, y: y * y)))
    raise ValueError(f"unknown metric {metric!r}")


def top_k(df: DataFrame, column: str, query: list[float], k: int, metric: str = "l2", tie: str | None = None) -> DataFrame:
    """The k nearest rows with their `_INDEX_SCORE`; rows without a vector, or of another length, are never near."""
    if k < 1:
        raise ValueError("k must be at least 1")
    near = df.filter(F.col(column).isNotNull() & (F.size(column) == len(query))).withColumn(SCORE, distance(column, query, metric))
    return near.orderBy(SCORE, *([tie] if tie else [])).limit(k)
