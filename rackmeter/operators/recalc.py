"""Mean task time corrected for executors that ran no task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.functions import columns as cx
from rackmeter.functions import text as tx


def with_surplus(apps: DataFrame) -> DataFrame:
    """Add the surplus executors and their time to each application."""
    executors, tasks, duration = F.col("executors"), F.col("tasks"), F.col("duration2")
    return apps.withColumns(
        {
            "extraexec": cx.surplus_executors(executors, tasks),
            "extratime": cx.surplus_time(duration, executors, tasks),
        }
    )


def recalculate(apps: DataFrame, keys: Sequence[str] = ("run", "host")) -> DataFrame:
    """Old and corrected mean task time per server, and their ratio.

    The surplus time is summed in fixed point, so the result does not depend on row order.
    """
    extra = F.col("extraexec")
    sums = with_surplus(apps).groupBy(*keys).agg(
        F.sum("duration2").alias("duration"),
        F.sum("tasks").alias("tasks"),
        F.sum("executors").alias("executors"),
        F.coalesce(F.sum(F.when(extra > 0, extra)), F.lit(0)).alias("extra_executors"),
        F.round(cx.fixed_sum(F.col("extratime"), 4), 1).alias("extra_time"),
    )
    old = F.round(F.try_divide(F.col("duration").cast("double"), F.col("tasks")), 1)
    new = F.round(F.try_divide(F.col("duration") - F.col("extra_time"), F.col("tasks")), 1)
    return (
        sums.withColumns({"old_time": old, "new_time": new})
        .withColumn("old_over_new", F.round(F.try_divide("old_time", "new_time"), 2))
    )


def recalculation_rows(apps: DataFrame, *more: str) -> DataFrame:
    """The recalculation per run folder and server with date, hours and tag of the run, next to ``more`` key columns."""
    run = F.col("run")
    return recalculate(apps).select(
        *more,
        tx.run_date(run).alias("date"), tx.run_hours(run).alias("hours"),
        F.replace("host", F.lit("tdw-"), F.lit("")).alias("server"), tx.run_tag(run).alias("tag"),
        "duration", "tasks", "executors", "extra_executors", "extra_time",
        "old_time", "new_time", "old_over_new",
    )
