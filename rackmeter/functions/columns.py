"""Column helpers for metrics: ratios, shares, flags, sums in fixed point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_idle(cpu_idle: Column) -> Column:
    return (F.lit(100) - cpu_idle) / 100


def share(used: Column, total: Column) -> Column:
    """used / total, NULL when total is 0."""
    return F.try_divide(used.cast("double"), total.cast("double"))


def mem_per_vcore(mem_mb: Column, vcores: Column) -> Column:
    """GB per vcore, NULL when no vcore is in use."""
    return share(mem_mb, vcores) / 1000


def mb_to_gb(mem_mb: Column) -> Column:
    return mem_mb / 1000


def mb_to_gb_floor(mem_mb: Column) -> Column:
    return F.floor(mem_mb / 1000)


def percent_to_fraction(percent: Column) -> Column:
    """Percent -> fraction with four digits, halves away from zero."""
    return F.round(percent.cast("decimal(18,6)") / 100, 4).cast("double")


def default_zero(text: Column, kind: str = "double") -> Column:
    """A missing, empty or unreadable cell counts as 0."""
    return F.coalesce(F.trim(text.cast("string")).try_cast(kind), F.lit(0).cast(kind))


def throughput(mr: Column, sql: Column) -> Column:
    return F.coalesce(mr, F.lit(0)) + F.coalesce(sql, F.lit(0))


def per_watt_hour(tput: Column, max_watt: Column, hours: Column) -> Column:
    """Tasks per watt and hour, 0 when no power was measured."""
    return F.coalesce(F.try_divide(F.try_divide(tput.cast("double"), max_watt), hours), F.lit(0.0))


def ratio_or_zero(value: Column, reference: Column) -> Column:
    return F.coalesce(F.try_divide(value.cast("double"), reference.cast("double")), F.lit(0.0))


def reuse_ratio(reused: Column, new: Column) -> Column:
    """reused / new with one digit, 0 when nothing was new."""
    exact = F.try_divide(reused.cast("decimal(18,0)"), new.cast("decimal(18,0)"))
    return F.coalesce(F.round(exact, 1).cast("double"), F.lit(0.0))


def surplus_executors(executors: Column, tasks: Column) -> Column:
    return executors - tasks


def surplus_time(duration: Column, executors: Column, tasks: Column) -> Column:
    """Time of the executors that ran no task; NULL without executors."""
    return F.try_divide((duration * (executors - tasks)).cast("double"), executors)


def within_target(mean_time: Column, target: float) -> Column:
    return F.round(mean_time) <= target


def reaches_target(value: Column, target: float) -> Column:
    return value >= target


def fixed(value: Column, digits: int) -> Column:
    """The value in units of 10**-digits as BIGINT, so that sums do not depend on row order."""
    return F.rint(value * 10**digits).cast("bigint")


def fixed_sum(value: Column, digits: int) -> Column:
    return F.sum(fixed(value, digits)).cast("double") / 10**digits


def fixed_mean(value: Column, digits: int) -> Column:
    """Mean of values with at most ``digits`` decimals, independent of row order."""
    return fixed_sum(value, digits) / F.count(value)
