"""Queries on task and application logs: distributions, longest tasks, recalculation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackmeter.catalog import bindings as b
from rackmeter.functions import text as tx
from rackmeter.operators import distribution, recalc
from rackmeter.schemas import DURATION_EDGES


def agg_histogram(spark, sf_dir):
    return distribution.histogram(b.tasks(spark, sf_dir))


def win_cumulative_pct(spark, sf_dir):
    return distribution.with_percentages(distribution.histogram(b.tasks(spark, sf_dir)))


def agg_total_mean(spark, sf_dir):
    return distribution.totals(b.tasks(spark, sf_dir))


def agg_value_counts(spark, sf_dir):
    return distribution.value_counts(b.tasks(spark, sf_dir), "duration")


def srt_top20(spark, sf_dir):
    return distribution.longest(b.tasks(spark, sf_dir), 20, ties=b.TASK_TIES)


def jon_longest_shortest(spark, sf_dir):
    pairs = distribution.longest_with_shortest(b.tasks(spark, sf_dir), 20, ties=b.TASK_TIES)
    return pairs.select(
        "job", "attempt", "l_partkey", "duration",
        F.col("shortest.duration").alias("shortest_duration"),
        F.col("shortest.attempt").alias("shortest_attempt"),
        F.col("shortest.l_partkey").alias("shortest_partkey"),
    )


def rep_task_distribution(spark, sf_dir):
    return distribution.task_distribution(b.tasks(spark, sf_dir))


def prj_job_key(spark, sf_dir):
    named = b.tasks(spark, sf_dir).withColumn("tid", b.attempt_id(F.col("job"), F.col("attempt")))
    return named.select("tid", tx.job_key(F.col("tid")).alias("job_key"), "duration")


def win_top5_values(spark, sf_dir):
    watts = b.table(spark, sf_dir, "lineitem").select(
        b.server_ip(F.col("l_suppkey")).alias("ip"), F.col("l_quantity").alias("watt")
    )
    return distribution.highest_values(watts, "watt", 5)


def agg_recalc(spark, sf_dir):
    return recalc.recalculate(b.apps(spark, sf_dir))


def prj_surplus(spark, sf_dir):
    return recalc.with_surplus(b.apps(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in [
        agg_histogram, win_cumulative_pct, agg_total_mean, agg_value_counts, srt_top20,
        jon_longest_shortest, rep_task_distribution, prj_job_key, win_top5_values, agg_recalc, prj_surplus,
    ]
}

_BINS = ", ".join(f"({lo}, {hi})" for lo, hi in zip(DURATION_EDGES, DURATION_EDGES[1:]))
_HISTOGRAM = f"""
  edges(lo, hi) as (select cast(lo as bigint), cast(hi as bigint) from (values {_BINS}) v(lo, hi)),
  bins as (select lo, hi, count(duration) as n from edges left join tasks on duration >= lo and duration < hi
    group by lo, hi)"""
_PERCENT = """
  points as (select *, cast(n * 10000 // sum(n) over () as bigint) as bp from bins),
  shares as (select *, cast(sum(bp) over (order by lo rows unbounded preceding) as bigint) as cum_bp from points)"""
_TOP = "order by duration desc, job, attempt, l_partkey, l_suppkey, l_extendedprice limit 20"

_RECALC = """, sums as (select run, host, cast(sum(duration2) as bigint) as duration, cast(sum(tasks) as bigint) as tasks,
          cast(sum(executors) as bigint) as executors,
          cast(coalesce(sum(executors - tasks) filter (where executors > tasks), 0) as bigint) as extra_executors,
          round(cast(sum(cast(round(cast(duration2 * (executors - tasks) as double) / executors * 10000) as bigint)) as double) / 10000, 1)
            as extra_time from apps group by run, host),
        times as (select *, round(cast(duration as double) / nullif(tasks, 0), 1) as old_time,
          round((duration - extra_time) / nullif(tasks, 0), 1) as new_time from sums),
        recalc as (select *, round(old_time / nullif(new_time, 0), 2) as old_over_new from times)"""
RECALC_ROWS_SQL = b.with_apps(f"""{_RECALC}
        select left(run, 2) || '/' || substr(run, 3, 2) as date, '24H' as hours, replace(host, 'tdw-', '') as server, 'POC' as tag, duration, tasks,
          executors, extra_executors, extra_time, old_time, new_time, old_over_new from recalc""")

SQL = {
    "agg_histogram": f"with tasks as ({b.TASKS_SQL}), {_HISTOGRAM} select lo, hi, n from bins",
    "win_cumulative_pct": f"with tasks as ({b.TASKS_SQL}), {_HISTOGRAM}, {_PERCENT} select lo, hi, n, bp, cum_bp from shares",
    "agg_total_mean": b.with_tasks(
        "select count(duration) as n, cast(sum(duration) as bigint) as total, avg(duration) as mean from tasks"),
    "agg_value_counts": b.with_tasks("select duration, count(*) as n from tasks group by duration"),
    "srt_top20": b.with_tasks(f"select * from tasks {_TOP}"),
    "jon_longest_shortest": f"""
        with tasks as ({b.TASKS_SQL}), top as (select * from tasks {_TOP}),
        ranked as (select *, row_number() over (partition by job
          order by duration, attempt, l_partkey, l_suppkey, l_extendedprice) as r from tasks)
        select top.job, top.attempt, top.l_partkey, top.duration, s.duration as shortest_duration,
          s.attempt as shortest_attempt, s.l_partkey as shortest_partkey
        from top join ranked s on s.job = top.job and s.r = 1""",
    "rep_task_distribution": f"""
        with tasks as ({b.TASKS_SQL}), {_HISTOGRAM}, {_PERCENT},
        whole as (select count(*) as tasks, cast(sum(duration) as bigint) as total, avg(duration) as mean from tasks)
        select lo, hi, n, bp, cum_bp, cast((select sum(n) from bins) as bigint) as binned, tasks, total, mean
        from shares, whole""",
    "prj_job_key": b.with_tasks(
        f"select {b.ATTEMPT_SQL} as tid, 'attempt_1700000000001_' || job || '_r' as job_key, duration from tasks"),
    "win_top5_values": f"""
        with counted as (select {b.ip_sql('l_suppkey')} as ip, l_quantity as watt, count(*) as n
          from lineitem group by 1, 2)
        select ip, watt, n, row_number() over (partition by ip order by watt desc) as rank from counted
        qualify rank <= 5""",
    "agg_recalc": b.with_apps(f"{_RECALC} select * from recalc"),
    "prj_surplus": b.with_apps("""
        select *, executors - tasks as extraexec,
          cast(duration2 * (executors - tasks) as double) / executors as extratime from apps"""),
}
