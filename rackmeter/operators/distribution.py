"""Task durations: histogram, totals, longest tasks, most frequent and highest values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackmeter.schemas import DURATION_EDGES


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """How often each distinct value occurs."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bin ``[lo, hi)`` a value falls in; NULL outside all bins."""
    inner = reduce(
        lambda c, i: c.when(value < edges[i], F.lit(i - 1)), range(2, len(edges)), F.when(value < edges[1], F.lit(0))
    )
    return F.when((value >= edges[0]) & (value < edges[-1]), inner)


def edge_table(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    bins = [(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)]
    return spark.createDataFrame(bins, "bin INT, lo BIGINT, hi BIGINT")


def histogram(df: DataFrame, value: str = "duration", edges: Sequence[int] = DURATION_EDGES) -> DataFrame:
    """Rows per bin, empty bins included. One pass; each task sends at most one row per bin."""
    counts = (
        df.select(bin_of(F.col(value), edges).alias("bin")).where(F.col("bin").isNotNull())
        .groupBy("bin").agg(F.count("*").alias("n"))
    )
    return (
        edge_table(df.sparkSession, edges).join(counts, "bin", "left")
        .select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))
    )


def with_percentages(bins: DataFrame) -> DataFrame:
    """Add the share of each bin and the cumulative share in whole basis points.

    The global windows run over the bins, of which there are as many as edges.
    """
    everything = Window.partitionBy(F.lit(1))
    upto = everything.orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(everything)
    points = F.floor(F.try_divide(F.col("n") * 10000, total)).cast("bigint")
    return bins.withColumn("bp", points).withColumn("cum_bp", F.sum("bp").over(upto))


def totals(df: DataFrame, value: str = "duration") -> DataFrame:
    """Number, sum and mean of a whole-number column."""
    return df.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def longest(df: DataFrame, n: int = 20, value: str = "duration", ties: Sequence[str] = ()) -> DataFrame:
    """The n rows with the highest value, lowest first. Ties go by the given columns."""
    return df.orderBy(F.col(value).desc(), *ties).limit(n).orderBy(F.col(value), *[F.col(t).desc() for t in ties])


def longest_with_shortest(
    tasks: DataFrame, n: int = 20, job: str = "job", value: str = "duration", ties: Sequence[str] = ()
) -> DataFrame:
    """The n longest tasks, each next to the shortest task of its job.

    Only tasks of the at most n jobs in question are looked at; their names are broadcast.
    """
    top = tasks.orderBy(F.col(value).desc(), *ties).limit(n)
    jobs = top.select(job).distinct()
    row = F.struct(value, *[t for t in ties if t not in (job, value)])
    shortest = (
        tasks.join(F.broadcast(jobs), job, "left_semi").groupBy(job).agg(F.min(row).alias("shortest"))
    )
    return top.join(F.broadcast(shortest), job, "left")


def highest_values(df: DataFrame, value: str, n: int = 5, keys: Sequence[str] = ("ip",)) -> DataFrame:
    """The n highest distinct values per server with their counts.

    Spark cuts each server to n values per task before the ranking shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    return (
        value_counts(df, *keys, value)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )


def task_distribution(
    tasks: DataFrame, value: str = "duration", edges: Sequence[int] = DURATION_EDGES
) -> DataFrame:
    """Distribution of the durations with percentages, total and mean on each line."""
    bins = with_percentages(histogram(tasks, value, edges))
    whole = totals(tasks, value).select(F.struct("n", "total", "mean")).scalar()
    return (
        bins.withColumn("t", whole)
        .select(
            "lo", "hi", "n", "bp", "cum_bp",
            F.sum("n").over(Window.partitionBy(F.lit(1))).alias("binned"),
            F.col("t.n").alias("tasks"), F.col("t.total").alias("total"), F.col("t.mean").alias("mean"),
        )
        .orderBy("lo")
    )
