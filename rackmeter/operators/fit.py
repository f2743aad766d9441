"""Straight-line fits by least squares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and the ends of the line, over all rows or per key."""
    fit = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("min_x"),
        F.max(x).alias("max_x"),
    )
    return _with_ends(fit)


def _with_ends(fit: DataFrame) -> DataFrame:
    """Both ends of the drawn line lie on the fitted line, at the lowest and the highest x."""
    at = lambda x: F.col("slope") * F.col(x) + F.col("intercept")
    return fit.withColumns({"y_start": at("min_x"), "y_end": at("max_x")})


def linear_fit_holdout(df: DataFrame, x: str, y: str, order: Sequence[str], n_test: int = 20) -> DataFrame:
    """Fit on all but the last ``n_test`` rows in the given order, which must be unique.

    The held-out rows are found by a distributed top-n; the rows before them go into one
    aggregate. No task sees the whole order.
    """
    key = F.struct(*order)
    tail = df.select(key.alias("k")).orderBy(F.col("k").desc()).limit(n_test)
    cut = tail.agg(F.min("k")).scalar()
    train = df.where(key < cut)
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    fit = (
        train.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
        .withColumn("ends", ends)
        .select("n", "slope", "intercept", F.col("ends.lo").alias("min_x"), F.col("ends.hi").alias("max_x"))
    )
    return _with_ends(fit)
