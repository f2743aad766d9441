"""Summary statistics with exact quartiles, for all columns of a frame at once.

The frame is read twice. The first read gives counts, means, spreads and, from a sketch per column, a bracket around
each quantile. The second counts what lies below each bracket and, by value, what lies inside it (a share of about
4 / accuracy of the rows). These counts are a small table, written once: sums over sub-brackets tell in which
one a quantile lies, and only its values are put in order. The driver gets some numbers per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from rackmeter.functions import columns as cx
from rackmeter.session import scratch_path

QUARTILES = [0.25, 0.5, 0.75]
ACCURACY = 100_000
SUB_BRACKETS = 1024


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def _value(column: str) -> Column:
    """The values of a column as DOUBLE; not-a-number is left out like NULL."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


@dataclass(frozen=True)
class Bracket:
    """Bounds of one quantile of one column, and the places of its neighbours among the ordered values."""

    column: int
    share: int
    low: float
    high: float
    place: float


def _first_read(df: DataFrame, columns: Sequence[str], shares: Sequence[float], accuracy: int, more: Sequence[Column] = ()) -> Row:
    slack = 2.0 / accuracy
    bounds = [float(x) for s in shares for x in (max(s - slack, 0.0), min(s + slack, 1.0))]
    per_column = [
        column
        for i, c in enumerate(columns)
        for column in (
            F.count(_value(c)).alias(f"n{i}"), F.min(_value(c)).alias(f"min{i}"), F.max(_value(c)).alias(f"max{i}"),
            F.percentile_approx(_value(c), bounds, accuracy).alias(f"bounds{i}"),
        )
    ]
    return df.agg(*per_column, *more).first()


def _brackets(row: Row, columns: Sequence[str], shares: Sequence[float], accuracy: int) -> list[Bracket]:
    out = []
    for i in range(len(columns)):
        for k, share in enumerate(shares):
            if row[f"n{i}"]:
                low, high = row[f"bounds{i}"][2 * k : 2 * k + 2]
                # The sketch is not exact at the very ends.
                low = row[f"min{i}"] if share <= 2.0 / accuracy else low
                high = row[f"max{i}"] if share >= 1.0 - 2.0 / accuracy else high
                out.append(Bracket(i, k, low, high, share * (row[f"n{i}"] - 1)))
    return out


def _second_read(df: DataFrame, columns: Sequence[str], brackets: Sequence[Bracket]) -> DataFrame:
    """Counts (key, v, n) inside the brackets.

    The row of key -1 has the counts below each (``b0``, ...) and the values next to it (``l0`` and ``h0``, ...).
    """
    numbered = list(enumerate(brackets))
    value = [_value(columns[b.column]) for b in brackets]
    inside = [
        F.when((value[k] >= b.low) & (value[k] <= b.high), F.struct(F.lit(k).alias("key"), value[k].alias("v"))) for k, b in numbered
    ]
    every = F.struct(F.lit(-1).alias("key"), F.lit(None).cast("double").alias("v"))
    beside = [
        c for k, b in numbered
        for c in (F.when(value[k] < b.low, value[k]).alias(f"l{k}"), F.when(value[k] > b.high, value[k]).alias(f"h{k}"))
    ]
    met = df.select(F.explode(F.array_append(F.filter(F.array(*inside), lambda m: m.isNotNull()), every)).alias("m"), *beside)
    whole = lambda c: F.when(F.col("m.key") < 0, F.col(c))
    sums = [
        c for k, _ in numbered
        for c in (F.count(whole(f"l{k}")).alias(f"b{k}"), F.max(whole(f"l{k}")).alias(f"l{k}"), F.min(whole(f"h{k}")).alias(f"h{k}"))
    ]
    return met.groupBy("m.key", "m.v").agg(F.count("*").alias("n"), *sums)


def exact_values(df: DataFrame, columns: Sequence[str], shares: Sequence[float], row: Row, accuracy: int = ACCURACY) -> dict[tuple[int, int], float]:
    """Exact quantiles (linear between neighbours) by number of column and share, after the first read gave ``row``."""
    spark, brackets = df.sparkSession, _brackets(row, columns, shares, accuracy)
    if not brackets:
        return {}
    path = scratch_path(spark, "quantiles")
    _second_read(df, columns, brackets).write.parquet(path)
    counted = spark.read.parquet(path)
    below = counted.where("key < 0").first()
    spec = [
        (k, b.low, b.high, end, int(place) - below[f"b{k}"])
        for k, b in enumerate(brackets) for end, place in enumerate((math.floor(b.place), math.ceil(b.place)))
    ]
    wanted = F.broadcast(spark.createDataFrame(spec, "key int, low double, high double, end int, rank long"))
    share = F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low"))
    part = F.coalesce(F.least(F.floor(share * SUB_BRACKETS), F.lit(SUB_BRACKETS - 1)), F.lit(0)).cast("int")
    placed = counted.where("key >= 0").join(wanted, "key").withColumn("part", part).select("key", "end", "rank", "part", "v", "n")
    # sums by sub-bracket first: at most that many rows for a quantile
    upto = Window.partitionBy("key", "end").orderBy("part")
    sums = placed.groupBy("key", "end", "rank", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    target = sums.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    target = target.select("key", "end", "part", (F.col("upto") - F.col("n")).alias("before"))
    within = Window.partitionBy("key", "end").orderBy("v")
    ordered = placed.join(F.broadcast(target), ["key", "end", "part"]).withColumn("upto", F.col("before") + F.sum("n").over(within))
    hits = ordered.where(F.col("upto") > F.col("rank")).groupBy("key", "end").agg(F.min("v").alias("v")).collect()
    # the neighbour of a value at the edge of its bracket stands next to the bracket
    ends = {(k, end): below[f"{side}{k}"] for k in range(len(brackets)) for end, side in enumerate("lh")}
    ends |= {(r.key, r.end): r.v for r in hits}
    return {
        (b.column, b.share): ends[k, 0] + (ends[k, 1] - ends[k, 0]) * (b.place - math.floor(b.place)) for k, b in enumerate(brackets)
    }


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles (linear between neighbours) of a column as one row: ``q0``, ``q1``, ..."""
    found = exact_values(df, [column], shares, _first_read(df, [column], shares, accuracy), accuracy)
    schema = ", ".join(f"q{i} DOUBLE" for i in range(len(shares)))
    return df.sparkSession.createDataFrame([tuple(found.get((0, i)) for i in range(len(shares)))], schema)


def describe_all(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """A row per numeric column (or per named one): column, count, mean, std, min, p25, p50, p75 and max.

    With ``digits``, the decimals of the values, means are taken in whole numbers. A column without values has a
    count of 0 and NULL otherwise.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    mean = lambda c: F.avg(_value(c)) if digits is None else cx.fixed_mean(_value(c), digits)
    more = [x for i, c in enumerate(names) for x in (mean(c).alias(f"mean{i}"), F.stddev(_value(c)).alias(f"std{i}"))]
    schema = "column STRING, count BIGINT, mean DOUBLE, std DOUBLE, min DOUBLE, p25 DOUBLE, p50 DOUBLE, p75 DOUBLE, max DOUBLE"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    row = _first_read(df, names, QUARTILES, ACCURACY, more)
    found = exact_values(df, names, QUARTILES, row)
    rows = [
        (c, row[f"n{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], *(found.get((i, k)) for k in range(3)), row[f"max{i}"])
        for i, c in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def describe(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """count, mean, std, min, 25 %, 50 %, 75 % and max of a column, as one row."""
    return describe_all(df, [column], digits).drop("column")
