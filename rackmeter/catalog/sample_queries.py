"""Queries on monitor samples: projections, filters, roll-ups, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackmeter.catalog import bindings as b
from rackmeter.functions import columns as cx
from rackmeter.operators import describe, fit, rollup
from rackmeter.plans import fleet
from rackmeter.schemas import CPU_COLUMNS, SAMPLE_METRICS, YARN_COLUMNS

IP = "10.0.0.8"
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, digits=9, skip=()):
    """Sums of DOUBLE in other orders differ in the last places only."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(f"`{c}`") for c in df.columns])


def agg_hourly_sql(spark, sf_dir):
    return rounded(rollup.hourly_utilisation(b.samples(spark, sf_dir)))


def _dated(spark, sf_dir):
    return rollup.with_date_parts(b.samples(spark, sf_dir))


def agg_hourly_mean(spark, sf_dir):
    return rounded(rollup.hourly_means(_dated(spark, sf_dir)))


def agg_hourly_shares(spark, sf_dir):
    means = rollup.hourly_means(_dated(spark, sf_dir), names=["cpu_idle"])
    return rollup.hourly_shares(means).select(
        "run", "year", "day", "ip", "hour", F.round("`cpu_nonidle%`", 9).alias("nonidle"),
        F.round("`vcore%`", 9).alias("vcore")
    )


def agg_host_mean(spark, sf_dir):
    return rounded(rollup.host_means(b.samples(spark, sf_dir), keys=["ip"]))


def prj_sample_ratios(spark, sf_dir):
    return b.samples(spark, sf_dir).select(
        "event_id",
        cx.non_idle(F.col("cpu_idle")).alias("non_idle"),
        cx.share(F.col("yarn_cpu_used"), F.col("yarn_cpu_all")).alias("vcore_share"),
        cx.mem_per_vcore(F.col("yarn_mem_used"), F.col("yarn_cpu_used")).alias("mem_per_vcore"),
        cx.mb_to_gb(F.col("yarn_mem_used")).alias("mem_gb"),
        cx.mb_to_gb_floor(F.col("yarn_mem_used")).alias("mem_gb_floor"),
    )


def prj_date_parts(spark, sf_dir):
    return _dated(spark, sf_dir).select("event_id", "day", "weekday", "year", "min", "hour")


def prj_percent_fraction(spark, sf_dir):
    fraction = lambda c: cx.percent_to_fraction(F.col(c)).alias(c)
    return b.samples(spark, sf_dir).select("event_id", fraction("cpu_user"), fraction("cpu_sys"), fraction("cpu_idle"))


def prj_metric_series(spark, sf_dir):
    return rollup.all_metric_series(_dated(spark, sf_dir), "event_id", "ip")


def rep_minute_series(spark, sf_dir):
    return fleet.minute_series(b.samples(spark, sf_dir))


def agg_distinct_hosts(spark, sf_dir):
    return rollup.distinct_hosts(b.samples(spark, sf_dir))


def agg_group_size(spark, sf_dir):
    return rollup.group_sizes(b.samples(spark, sf_dir), "ip", "hour")


def agg_audit_counts(spark, sf_dir):
    return rollup.audit_counts(b.samples(spark, sf_dir))


def agg_sum_by_date(spark, sf_dir):
    traffic = b.samples(spark, sf_dir).select(F.to_date("ts").cast("string").alias("day"), "yarn_mem_used", "cpu_user")
    return rounded(rollup.sum_by(traffic, ["day"], ["yarn_mem_used", "cpu_user"]), 2)


def agg_month_mean(spark, sf_dir):
    monthly = b.samples(spark, sf_dir).withColumn("mon", F.date_format("ts", "yyyy-MM"))
    return rounded(rollup.mean_by(monthly, ["ip", "mon"], ["yarn_mem_used", "cpu_user"]))


def agg_describe(spark, sf_dir):
    stats = describe.describe(b.table(spark, sf_dir, "events"), "value")
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


def agg_describe_frame(spark, sf_dir):
    """Summary of every numeric column of a table."""
    stats = describe.describe_all(b.table(spark, sf_dir, "lineitem"))
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


def flt_host(spark, sf_dir):
    return rollup.of_host(b.samples(spark, sf_dir), IP).select("event_id", "ip", "cpu_user")


def flt_date_range(spark, sf_dir):
    dated = b.samples(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    return rollup.between_dates(dated, "day", "2024-01-04", "2024-01-05").select("event_id", "day", "cpu_user")


def flt_drop_dates(spark, sf_dir):
    daily = b.samples(spark, sf_dir).select(
        F.concat(F.to_date("ts").cast("string"), F.lit(" ")).alias("day"), "cpu_user"
    )
    totals = rounded(rollup.sum_by(daily, ["day"], ["cpu_user"]), 2)
    return rollup.without_dates(totals, "day", ["2024-01-01 ", "2024-01-30 "]).select(
        F.trim("day").alias("day"), "cpu_user"
    )


def srt_head(spark, sf_dir):
    return rollup.first_rows(b.samples(spark, sf_dir).select("event_id", "ip", "ts"), 5, "ts", "event_id")


def set_union_all(spark, sf_dir):
    frame = b.samples(spark, sf_dir).select("ip", "hour", "cpu_idle")
    return rollup.union_all([frame, frame.where("hour < 12")])


def _line_numbers(spark, sf_dir):
    """Columns of few decimals, and one of many."""
    taxed = F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax")
    return b.table(spark, sf_dir, "lineitem").select(*LINE_NUMBERS, taxed.alias("taxed"))


def agg_column_mean(spark, sf_dir):
    return rounded(rollup.column_means(_line_numbers(spark, sf_dir)), 6)


def agg_column_sum(spark, sf_dir):
    return rounded(rollup.column_sums(_line_numbers(spark, sf_dir)), 2)


def _rounded_fit(df, keys=()):
    digits = {"slope": 4, "intercept": 3, "min_x": 2, "max_x": 2, "y_start": 3, "y_end": 3}
    return df.select(*keys, "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


def ml_linear_fit(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return _rounded_fit(
        fit.linear_fit_holdout(b.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", order)
    )


def ml_linear_fit_by_group(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    return _rounded_fit(fit.linear_fit(lines, "l_quantity", "l_extendedprice", ["l_returnflag"]), ["l_returnflag"])


def fn_math_pack(spark, sf_dir):
    value, idle = F.col("yarn_mem_used"), F.col("cpu_idle")
    return b.samples(spark, sf_dir).select(
        "event_id",
        F.round(idle.cast("decimal(18,4)") / 100, 1).cast("double").alias("rounded"),
        F.floor(value / 1000).alias("gb"),
        F.when(idle > 50, "idle").otherwise("busy").alias("state"),
        F.try_divide(value, F.col("yarn_cpu_used")).alias("per_vcore"),
        (value - F.col("ctn") * 10 + 3).alias("mixed"),
        F.hour("ts").alias("hour"),
        F.minute("ts").alias("mins"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        agg_hourly_sql, agg_hourly_mean, agg_hourly_shares, agg_host_mean, prj_sample_ratios, prj_date_parts,
        prj_percent_fraction, prj_metric_series, rep_minute_series, agg_distinct_hosts,
        agg_group_size, agg_audit_counts, agg_sum_by_date, agg_month_mean, agg_describe, agg_describe_frame, flt_host,
        flt_date_range, flt_drop_dates, srt_head, set_union_all, agg_column_mean, agg_column_sum,
        ml_linear_fit, ml_linear_fit_by_group, fn_math_pack,
    ]
}

_LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
_LINE_VALUES = {c: c for c in LINE_NUMBERS} | {"taxed": "l_extendedprice * l_discount * l_tax"}
_LONG = [c for c in SAMPLE_METRICS if c not in CPU_COLUMNS]
_means = ", ".join(
    [f"{b.mean_sql(c)} as {c}" for c in CPU_COLUMNS] + [f"{b.mean_sql(c)} as {c}" for c in _LONG]
)
_host_means = ", ".join(
    [f"{b.mean_sql(c)} as {c}" for c in CPU_COLUMNS] + [f"{b.mean_sql(c)} as {c}" for c in YARN_COLUMNS]
)
_DAY = "strftime(ts, '%b-%d')"
_series = "union all ".join(
    f"select event_id, ip, strftime(ts, '%H:%M') as min, '{m}' as metric, {v} as value from samples "
    for m, v in {
        "mem": "cast(mem_used as double)",
        "cpu": "(100 - cpu_idle) / 100",
        "mpc": "cast(yarn_mem_used as double) / nullif(yarn_cpu_used, 0) / 1000",
        "vcore": "cast(yarn_cpu_used as double)",
    }.items()
)
_FIT = """round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
    round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept"""

SQL = {
    "agg_hourly_sql": b.with_samples(f"""
        select run, ip, hour, round(avg(cpu_user) / 100, 9) as cpu_user,
          round((100 - avg(cpu_idle)) / 100, 9) as non_idle,
          round(avg(yarn_cpu_used) / avg(yarn_cpu_all), 9) as vcore_ratio,
          {b.mean_sql('yarn_cpu_used')} as cpu_used, {b.mean_sql('yarn_mem_used')} as mem_used
        from samples group by run, ip, hour"""),
    "agg_hourly_mean": b.with_samples(f"""
        select run, strftime(ts, '%Y') as year, {_DAY} as day, ip, hour, {_means},
          round(avg((100 - cpu_idle) / 100), 9) as "cpu_nonidle%",
          round(avg(cast(yarn_cpu_used as double) / yarn_cpu_all), 9) as "vcore%"
        from samples group by 1, 2, 3, 4, 5"""),
    "agg_hourly_shares": b.with_samples(f"""
        select run, strftime(ts, '%Y') as year, {_DAY} as day, ip, hour,
          round(avg((100 - cpu_idle) / 100), 9) as nonidle,
          round(avg(cast(yarn_cpu_used as double) / yarn_cpu_all), 9) as vcore
        from samples group by 1, 2, 3, 4, 5"""),
    "agg_host_mean": b.with_samples(f"select ip, {_host_means} from samples group by ip"),
    "prj_sample_ratios": b.with_samples("""
        select event_id, (100 - cpu_idle) / 100 as non_idle,
          cast(yarn_cpu_used as double) / yarn_cpu_all as vcore_share,
          cast(yarn_mem_used as double) / nullif(yarn_cpu_used, 0) / 1000 as mem_per_vcore,
          cast(yarn_mem_used as double) / 1000 as mem_gb, yarn_mem_used // 1000 as mem_gb_floor
        from samples"""),
    "prj_date_parts": """
        select event_id, strftime(ts, '%b-%d') as day, strftime(ts, '%a') as weekday,
          strftime(ts, '%Y') as year, strftime(ts, '%H:%M') as min,
          cast(extract(hour from ts) as int) as hour from events""",
    "prj_percent_fraction": b.with_samples("""
        select event_id, round(cpu_user * 100) / 10000 as cpu_user, round(cpu_sys * 100) / 10000 as cpu_sys,
          round(cpu_idle * 100) / 10000 as cpu_idle from samples"""),
    "prj_metric_series": b.with_samples(_series),
    "rep_minute_series": b.with_samples(_series.replace("select event_id, ip,", "select run, ip, ts,")),
    "agg_distinct_hosts": b.with_samples("select distinct ip from samples"),
    "agg_group_size": b.with_samples("select ip, hour, count(*) as n from samples group by ip, hour"),
    "agg_audit_counts": b.with_samples("select count(distinct ip) as servers, count(*) as rows from samples"),
    "agg_sum_by_date": b.with_samples(f"""
        select strftime(ts, '%Y-%m-%d') as day, {b.sum_sql('yarn_mem_used')} as yarn_mem_used,
          {b.sum_sql('cpu_user')} as cpu_user from samples group by 1"""),
    "agg_month_mean": b.with_samples(f"""
        select ip, strftime(ts, '%Y-%m') as mon, {b.mean_sql('yarn_mem_used')} as yarn_mem_used,
          {b.mean_sql('cpu_user')} as cpu_user from samples group by 1, 2"""),
    "agg_describe_frame": " union all ".join(f"""
        select '{c}' as column, count({c}) as count, {b.mean_sql(c, 6)} as mean, round(stddev({c}), 6) as std,
          cast(min({c}) as double) as min, round(quantile_cont(cast({c} as double), 0.25), 6) as p25,
          round(quantile_cont(cast({c} as double), 0.5), 6) as p50, round(quantile_cont(cast({c} as double), 0.75), 6) as p75,
          cast(max({c}) as double) as max from lineitem""" for c in _LINEITEM_NUMBERS),
    "agg_describe": f"""
        select count(value) as count, {b.mean_sql('value', 6)} as mean, round(stddev(value), 6) as std,
          min(value) as min, round(quantile_cont(value, 0.25), 6) as p25,
          round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75,
          max(value) as max from events""",
    "flt_host": b.with_samples(f"select event_id, ip, cpu_user from samples where ip = '{IP}'"),
    "flt_date_range": b.with_samples("""
        select event_id, strftime(ts, '%Y-%m-%d') as day, cpu_user from samples
        where strftime(ts, '%Y-%m-%d') between '2024-01-04' and '2024-01-05'"""),
    "flt_drop_dates": b.with_samples(f"""
        select strftime(ts, '%Y-%m-%d') as day, {b.sum_sql('cpu_user')} as cpu_user from samples
        where strftime(ts, '%Y-%m-%d') not in ('2024-01-01', '2024-01-30') group by 1"""),
    "srt_head": b.with_samples("select event_id, ip, ts from samples order by ts, event_id limit 5"),
    "set_union_all": b.with_samples("""
        select ip, hour, cpu_idle from samples
        union all select ip, hour, cpu_idle from samples where hour < 12"""),
    "agg_column_mean": "select " + ", ".join(f"{b.mean_sql(v, 6)} as {c}" for c, v in _LINE_VALUES.items()) + " from lineitem",
    "agg_column_sum": "select " + ", ".join(f"{b.sum_sql(v)} as {c}" for c, v in _LINE_VALUES.items()) + " from lineitem",
    "ml_linear_fit": """
        with ranked as (select *, row_number() over (order by l_orderkey desc, l_linenumber desc,
          l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) as back from lineitem),
        fitted as (select count(*) as n, regr_slope(l_extendedprice, l_quantity) as m,
          regr_intercept(l_extendedprice, l_quantity) as c from ranked where back > 20),
        ends as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem)
        select n, round(m, 4) as slope, round(c, 3) as intercept, lo as min_x, hi as max_x,
          round(m * lo + c, 3) as y_start, round(m * hi + c, 3) as y_end from fitted, ends""",
    "ml_linear_fit_by_group": """
        with fitted as (select l_returnflag, count(*) as n, regr_slope(l_extendedprice, l_quantity) as m,
          regr_intercept(l_extendedprice, l_quantity) as c, min(l_quantity) as lo, max(l_quantity) as hi
          from lineitem group by l_returnflag)
        select l_returnflag, n, round(m, 4) as slope, round(c, 3) as intercept, lo as min_x, hi as max_x,
          round(m * lo + c, 3) as y_start, round(m * hi + c, 3) as y_end from fitted""",
    "fn_math_pack": b.with_samples("""
        select event_id, cast(round(cast(cpu_idle / 100 as decimal(18,4)), 1) as double) as rounded,
          yarn_mem_used // 1000 as gb, case when cpu_idle > 50 then 'idle' else 'busy' end as state,
          cast(yarn_mem_used as double) / nullif(yarn_cpu_used, 0) as per_vcore,
          yarn_mem_used - ctn * 10 + 3 as mixed, cast(extract(hour from ts) as int) as hour,
          cast(extract(minute from ts) as int) as mins from samples"""),
}
