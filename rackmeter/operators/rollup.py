"""Means, sums and counts of samples by server, hour, day and month."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackmeter.functions import columns as cx
from rackmeter.functions import text as tx
from rackmeter.schemas import CPU_COLUMNS, SAMPLE_METRICS, YARN_COLUMNS

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    left_out = set(skip)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in left_out
    ]


def mean_of(df: DataFrame, name: str, digits: int | None = None) -> Column:
    """Mean of a column.

    A caller who knows how many decimals the source of a DOUBLE column has may name them as ``digits``; the
    sum is then taken in fixed point and does not depend on the order of rows.
    """
    integral = isinstance(df.schema[name].dataType, INTEGRAL)
    if digits is None or integral:
        return F.avg(F.col(f"`{name}`"))
    return cx.fixed_mean(F.col(f"`{name}`"), digits)


def sum_of(name: str, digits: int | None = None) -> Column:
    """Sum of a column in its own type, or in fixed point with ``digits``."""
    column = F.col(f"`{name}`")
    return F.sum(column) if digits is None else cx.fixed_sum(column, digits)


def column_means(df: DataFrame, names: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Mean of every numeric column."""
    names = list(names or numeric_columns(df))
    return df.agg(*[mean_of(df, c, digits).alias(c) for c in names])


def column_sums(df: DataFrame, names: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Sum of every numeric column."""
    names = list(names or numeric_columns(df))
    return df.agg(*[sum_of(c, digits).alias(c) for c in names])


def host_means(
    samples: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = ("run", "ip"), digits: int | None = None
) -> DataFrame:
    """Mean of the metrics per server."""
    names = list(names or CPU_COLUMNS + YARN_COLUMNS)
    return samples.groupBy(*keys).agg(*[mean_of(samples, c, digits).alias(c) for c in names])


def hourly_utilisation(
    samples: DataFrame, keys: Sequence[str] = ("run", "ip", "hour"), digits: int | None = None
) -> DataFrame:
    """Utilisation by run, server and hour; the vcore ratio is the ratio of the means.

    Rows come in no order; a writer that wants one sorts them.
    """
    mean = lambda name: mean_of(samples, name, digits)
    return (
        samples.groupBy(*keys)
        .agg(
            (mean("cpu_user") / 100).alias("cpu_user"),
            ((100 - mean("cpu_idle")) / 100).alias("non_idle"),
            F.try_divide(mean("yarn_cpu_used"), mean("yarn_cpu_all")).alias("vcore_ratio"),
            mean("yarn_cpu_used").alias("cpu_used"),
            mean("yarn_mem_used").alias("mem_used"),
        )
    )


def with_ratios(samples: DataFrame) -> DataFrame:
    """Add the share of non-idle time and of used vcores of each sample."""
    return samples.withColumns(
        {
            "cpu_nonidle%": cx.non_idle(F.col("cpu_idle")),
            "vcore%": cx.share(F.col("yarn_cpu_used"), F.col("yarn_cpu_all")),
        }
    )


def with_date_parts(samples: DataFrame) -> DataFrame:
    """Add day, weekday, year and minute from the date text."""
    date = F.col("date")
    return samples.withColumns(
        {"day": tx.day_of(date), "weekday": tx.weekday_of(date), "year": tx.year_of(date), "min": tx.minute_of(date)}
    )


def hourly_means(
    samples: DataFrame, names: Sequence[str] | None = None, digits: int | None = None,
    keys: Sequence[str] = ("run", "year", "day", "ip", "hour"),
) -> DataFrame:
    """Mean of all metrics by run, year, day, server and hour, with the mean of the per-sample ratios.

    ``samples`` needs ``year`` and ``day`` (see ``with_date_parts``).
    """
    rated = with_ratios(samples)
    names = list(names or [c for c in SAMPLE_METRICS if c in samples.columns])
    return rated.groupBy(*keys).agg(
        *[mean_of(rated, c, digits).alias(c) for c in names],
        F.avg("`cpu_nonidle%`").alias("cpu_nonidle%"),
        F.avg("`vcore%`").alias("vcore%"),
    )


def hourly_shares(rollup: DataFrame, ip: str | None = None) -> DataFrame:
    """The cpu and vcore shares by hour, for one server or for all."""
    kept = rollup if ip is None else rollup.where(F.col("ip") == ip)
    return kept.select("run", "year", "day", "ip", "hour", "`cpu_nonidle%`", "`vcore%`")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, matched by column name; duplicates stay."""
    return reduce(DataFrame.unionByName, frames)


def sum_by(df: DataFrame, keys: Sequence[str], names: Sequence[str], digits: int | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*[sum_of(c, digits).alias(c) for c in names])


def mean_by(df: DataFrame, keys: Sequence[str], names: Sequence[str], digits: int | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*[mean_of(df, c, digits).alias(c) for c in names])


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_hosts(df: DataFrame, column: str = "ip") -> DataFrame:
    return df.select(column).distinct()


def audit_counts(df: DataFrame, host: str = "ip") -> DataFrame:
    """How many servers went in and how many rows were written.

    Servers are counted in two steps (distinct, then count), so no task holds them all.
    """
    per_host = df.groupBy(host).agg(F.count("*").alias("n"))
    return per_host.agg(F.count(host).alias("servers"), F.sum("n").alias("rows"))


def without_dates(df: DataFrame, column: str, dates: Sequence[str]) -> DataFrame:
    """Drop listed dates, compared without outer blanks."""
    return df.where(~F.trim(F.col(column)).isin(*[d.strip() for d in dates]))


def between_dates(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    return df.where(F.col(column).between(first, last))


def of_host(df: DataFrame, *ips: str, column: str = "ip") -> DataFrame:
    return df.where(F.col(column).isin(*ips))


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


# Metric names of the per-minute view and the column each one shows.
METRICS = {
    "mem": lambda: F.col("mem_used").cast("double"),
    "cpu": lambda: cx.non_idle(F.col("cpu_idle")),
    "mpc": lambda: cx.mem_per_vcore(F.col("yarn_mem_used"), F.col("yarn_cpu_used")),
    "vcore": lambda: F.col("yarn_cpu_used").cast("double"),
}


def metric_series(samples: DataFrame, metric: str, *keys: str) -> DataFrame:
    """One metric as a (min, value) series, next to the given key columns."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {sorted(METRICS)}")
    return samples.select(*keys, "min", METRICS[metric]().alias("value"))


def all_metric_series(samples: DataFrame, *keys: str) -> DataFrame:
    """All metrics as (metric, min, value) rows, in one pass."""
    pairs = [F.struct(F.lit(m).alias("metric"), column().alias("value")) for m, column in METRICS.items()]
    return samples.select(*keys, "min", F.inline(F.array(*pairs)))
