"""Comparison of servers with a reference server, audit of missing inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackmeter.functions import columns as cx
from rackmeter.schemas import MR_TIME_TARGET, SQL_TIME_TARGET, THROUGHPUT_TARGET


def with_throughput(servers: DataFrame, hours: Column) -> DataFrame:
    """Add MR+SQL tasks and tasks per watt-hour."""
    tput = cx.throughput(F.col("mr_nbr"), F.col("sql_nbr"))
    return servers.withColumn("tput", tput).withColumn(
        "tput_per_wh", cx.per_watt_hour(F.col("tput"), F.col("max_w"), hours)
    )


def versus_reference(servers: DataFrame, reference_ip: str) -> DataFrame:
    """Throughput and throughput per watt-hour relative to one server of the same run; a run without it gets 0.

    The rows of a run (one per server) meet once, so whatever they are made from is read once.
    """
    run = Window.partitionBy("run")
    of_reference = lambda c: F.max(F.when(F.col("ip") == reference_ip, F.col(c))).over(run)
    return servers.withColumns({
        "tput_vs_ref": cx.ratio_or_zero(F.col("tput"), of_reference("tput")),
        "per_wh_vs_ref": cx.ratio_or_zero(F.col("tput_per_wh"), of_reference("tput_per_wh")),
    })


def with_target_flags(servers: DataFrame) -> DataFrame:
    """Whether a server meets the report targets."""
    return servers.withColumns(
        {
            "mr_time_ok": cx.within_target(F.col("mr_time"), MR_TIME_TARGET),
            "sql_time_ok": cx.within_target(F.col("sql_time"), SQL_TIME_TARGET),
            "tput_ok": cx.reaches_target(F.col("tput"), THROUGHPUT_TARGET),
        }
    )


def missing_sources(expected: DataFrame, found: DataFrame, keys: Sequence[str] = ("run", "host")) -> DataFrame:
    """Servers for which a kind of input has no file."""
    return expected.join(found.select(*keys).distinct(), list(keys), "left_anti")


def with_utilisation(report: DataFrame, utilisation: DataFrame) -> DataFrame:
    """Fill vcores and cpu shares of a report from a utilisation table, by server.

    A server without utilisation stays in the report, with empty cells.
    """
    used = utilisation.select(
        "ip", F.round("vcore").alias("actual_vcore"),
        (F.col("user") / 100).alias("user_share"),
        (F.col("sys") / 100).alias("sys_share"),
        (F.col("idle") / 100).alias("idle_share"),
    )
    return report.drop("actual_vcore", "user_share", "sys_share", "idle_share").join(used, "ip", "left")
