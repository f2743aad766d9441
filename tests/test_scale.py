"""Plans and behaviour that matter at scale: no hot task, one scan, pushed-down columns."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rackmeter.catalog import bindings as b
from rackmeter.operators import distribution
from rackmeter.sources import lines as ln
from rackmeter.sources import monitor, summary
from tests.conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def windows(plan):
    return re.findall(r"windowspecdefinition\(([^\[]*)", plan)


def test_blocks_scan_once_and_shuffle_twice(spark, tmp_path):
    (tmp_path / "0711-24H" / "tdw-1-1-1-1").mkdir(parents=True)
    (tmp_path / "0711-24H" / "tdw-1-1-1-1" / "sdr_log").write_text("== Tue Jul 11 00:00:01 CST 2017 ==\n")
    plan = plan_of(monitor.sample_blocks(ln.read_lines(spark, f"{tmp_path}/*/*/sdr_log")))
    assert plan.count("BatchScan byte_lines") == 1 and plan.count("Exchange hashpartitioning") == 2
    # No window runs over a file alone.
    for line in plan.splitlines():
        if "Window [" in line:
            assert re.search(r"\], \[file#\d+, (chunk|own_chunk)#", line), line
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_head_of_files_is_cut_before_the_shuffle(spark, tmp_path):
    (tmp_path / "0711-24H" / "tdw-1-1-1-1").mkdir(parents=True)
    (tmp_path / "0711-24H" / "tdw-1-1-1-1" / "sum_cron").write_text("a\n")
    plan = plan_of(summary.perf_summary(ln.read_lines(spark, f"{tmp_path}/*/*/sum_cron")))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") or "Partial" in plan


def test_top_values_are_cut_before_the_ranking_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(entry.queries()["win_top5_values"](spark, DATA))


def test_top20_is_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()["srt_top20"](spark, DATA))


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(entry.queries()["agg_histogram"](spark, DATA))
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert schema == "struct<l_linenumber:int,l_quantity:double>"


def test_filter_reaches_the_scan(spark):
    plan = plan_of(b.table(spark, DATA, "events").where(F.col("user_id") == 8).select("value"))
    assert "EqualTo(user_id,8)" in plan


def test_one_server_with_a_third_of_all_lines(spark):
    """The lines of a hot file spread over many chunks; its edge rows stay few."""
    n = 300_000
    lines = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "/r/0711-24H/tdw-1-1-1-1/sdr_log")
        .otherwise(F.concat(F.lit("/r/0711-24H/tdw-2-2-2-"), F.col("id") % 50, F.lit("/sdr_log"))).alias("file"),
        F.lit(0).cast("bigint").alias("split"), F.col("id").alias("pos"),
        F.when(F.floor(F.col("id") / 150) % 2 == 0, "== Tue Jul 11 00:00:01 CST 2017 ==").otherwise("Containers : 7").alias("line"),
    )
    got = monitor.sample_blocks(lines, keep_last=True, full=False)
    headers = lines.where(F.col("line").contains("==")).count()
    assert got.count() == headers


def test_shortest_task_looks_only_at_the_jobs_in_question(spark):
    plan = plan_of(distribution.longest_with_shortest(b.tasks(spark, DATA), ties=b.TASK_TIES))
    assert "LeftSemi, BuildRight" in plan


@pytest.mark.parametrize(("query", "scans"), [("jon_vs_reference", 2), ("rep_fleet", 9), ("rep_fleet_quick_view", 9)])
def test_comparison_with_a_reference_reads_nothing_twice(spark, query, scans):
    plan = plan_of(entry.queries()[query](spark, DATA))
    assert plan.count("FileScan") <= scans


def test_block_parts_are_not_sorted_once_more(spark):
    """One sort by place before the parts are made, one before they are put together."""
    lines = spark.range(10).select(
        F.lit("/r/0711-24H/tdw-1-1-1-1/sdr_log").alias("file"), F.lit(0).cast("bigint").alias("split"), F.col("id").alias("pos"),
        F.lit("== Tue Jul 11 00:00:01 CST 2017 ==").alias("line"),
    )
    for keep_last in (True, False):
        assert plan_of(monitor.sample_blocks(lines, keep_last=keep_last)).count("Sort [") == 2
