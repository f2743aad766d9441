"""Operators on small invented data, checked by hand or by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackmeter.functions import columns as cx
from rackmeter.functions import text as tx
from rackmeter.operators import compare, describe, distribution, fit, recalc, rollup
from rackmeter.schemas import DURATION_EDGES


def test_histogram_edges(spark):
    durations = [0, 9, 10, 119, 120, 299, 143999, 144000, 200000, 10]
    tasks = spark.createDataFrame([(d,) for d in durations], "duration BIGINT")
    bins = distribution.with_percentages(distribution.histogram(tasks)).orderBy("lo").collect()
    want = [sum(lo <= d < hi for d in durations) for lo, hi in zip(DURATION_EDGES, DURATION_EDGES[1:])]
    assert [r["n"] for r in bins] == want
    points = [n * 10000 // sum(want) for n in want]
    assert [r["bp"] for r in bins] == points
    assert [r["cum_bp"] for r in bins] == list(np.cumsum(points))


def test_histogram_of_nothing(spark):
    tasks = spark.createDataFrame([], "duration BIGINT")
    bins = distribution.with_percentages(distribution.histogram(tasks)).collect()
    assert len(bins) == 19 and all(r["n"] == 0 and r["bp"] is None for r in bins)


def test_known_basis_points(spark):
    """Bin counts of a measured day give these basis points."""
    counts = [1010, 354, 282, 217, 215, 151, 139, 108, 107, 77, 92, 64, 958, 568, 295, 29, 4, 3, 0]
    rows = [(DURATION_EDGES[i], n) for i, n in enumerate(counts)]
    bins = spark.createDataFrame(rows, "lo BIGINT, n BIGINT")
    got = distribution.with_percentages(bins).orderBy("lo").collect()
    assert [r["bp"] for r in got] == [
        2161, 757, 603, 464, 460, 323, 297, 231, 228, 164, 196, 136, 2050, 1215, 631, 62, 8, 6, 0]
    assert got[-1]["cum_bp"] == 9992


def test_longest_and_shortest_of_the_job(spark):
    rng = random.Random(3)
    # One job holds a third of all tasks.
    rows = [(0 if rng.random() < 0.33 else rng.randrange(1, 40), i, rng.randrange(5000)) for i in range(3000)]
    tasks = spark.createDataFrame(rows, "job BIGINT, attempt BIGINT, duration BIGINT")
    top = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:20]
    got = distribution.longest(tasks, 20, ties=["job", "attempt"]).collect()
    assert [tuple(r) for r in got] == top[::-1]
    pairs = distribution.longest_with_shortest(tasks, 20, ties=["job", "attempt"]).collect()
    assert sorted((r["job"], r["attempt"], r["shortest"]["duration"], r["shortest"]["attempt"]) for r in pairs) == sorted(
        (j, a, *min((d, t) for k, t, d in rows if k == j)) for j, a, _ in top
    )


def test_highest_values(spark):
    rows = [("a", v) for v in [9, 10, 100, 100, 8, 7, 6]] + [("b", 1)]
    df = spark.createDataFrame(rows, "ip STRING, watt INT")
    got = distribution.highest_values(df, "watt").orderBy("ip", "rank").collect()
    assert [(r["ip"], r["watt"], r["n"]) for r in got] == [
        ("a", 100, 2), ("a", 10, 1), ("a", 9, 1), ("a", 8, 1), ("a", 7, 1), ("b", 1, 1)]


@pytest.mark.parametrize("kind", ["uniform", "ties", "outlier", "one", "two"])
def test_exact_quantiles(spark, kind):
    rng = random.Random(5)
    values = {
        "uniform": [round(rng.uniform(0, 1000), 2) for _ in range(5003)],
        "ties": [5.0] * 2000 + [float(rng.randrange(10)) for _ in range(3001)],
        "outlier": [1e12] + [rng.random() for _ in range(4000)],
        "one": [3.5],
        "two": [1.0, 2.0],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    for accuracy in (100, 100_000):
        got = describe.exact_quantiles(df, "v", shares, accuracy).first()
        want = np.quantile(values, shares)
        assert np.allclose(list(got), want, rtol=1e-12, atol=1e-12)


def test_describe(spark):
    values = [1.25, 2.5, 4.0, 8.0, 16.0]
    row = describe.describe(spark.createDataFrame([(v,) for v in values], "v DOUBLE"), "v").first()
    assert row["count"] == 5 and row["mean"] == sum(values) / 5 and row["p50"] == 4.0
    assert math.isclose(row["std"], np.std(values, ddof=1))
    assert (row["min"], row["p25"], row["p75"], row["max"]) == (1.25, 2.5, 8.0, 16.0)


def test_recalculation(spark):
    rows = [
        ("0524-24H", "tdw-10-0-0-1", 4, 2, 100),  # half of the executors ran nothing
        ("0524-24H", "tdw-10-0-0-1", 2, 2, 50),
        ("0524-24H", "tdw-10-0-0-1", 1, 3, 30),  # more tasks than executors
        ("0524-24H", "tdw-10-0-0-1", 0, 0, 7),  # no executor: no surplus time
        ("0711-12H-td3-b", "tdw-10-0-0-2", 0, 0, 5),
    ]
    apps = spark.createDataFrame(rows, "run STRING, host STRING, executors BIGINT, tasks BIGINT, duration2 BIGINT")
    got = {r["server"]: r for r in recalc.recalculation_rows(apps).collect()}
    one = got["10-0-0-1"]
    assert (one["date"], one["hours"], one["tag"]) == ("05/24", "24H", "POC")
    assert (one["duration"], one["tasks"], one["executors"], one["extra_executors"]) == (187, 7, 7, 2)
    assert one["extra_time"] == 100 / 2 - 30 * 2
    assert one["old_time"] == round(187 / 7, 1) and one["new_time"] == round((187 + 10) / 7, 1)
    two = got["10-0-0-2"]
    assert (two["date"], two["hours"], two["tag"]) == ("07/11", "12H", "td3-b")
    assert two["old_time"] is None and two["extra_executors"] == 0


def test_ratio_of_means_and_mean_of_ratios_differ(spark):
    rows = [("10.0.0.1", 1, "Tue Jul 11 01:00:01 CST 2017", 0.0, 50.0, 10, 20, 1000), ("10.0.0.1", 1, "Tue Jul 11 01:01:01 CST 2017", 10.0, 60.0, 30, 40, 3000)]
    schema = "ip STRING, hour INT, date STRING, cpu_user DOUBLE, cpu_idle DOUBLE, yarn_cpu_used BIGINT, yarn_cpu_all BIGINT, yarn_mem_used BIGINT"
    samples = rollup.with_date_parts(spark.createDataFrame(rows, schema).withColumn("run", F.lit("0711-24H")))
    sql = rollup.hourly_utilisation(samples).first()
    assert sql["vcore_ratio"] == 20 / 30 and sql["cpu_user"] == 0.05 and sql["non_idle"] == 0.45
    mean = rollup.hourly_means(samples).first()
    assert mean["vcore%"] == (10 / 20 + 30 / 40) / 2 and mean["day"] == "Jul-11"
    assert samples.select("weekday", "year", "min").first() == ("Tue", "2017", "01:00")


def test_metric_series(spark):
    rows = [("a", "00:01", 5, 40.0, 8000, 4), ("a", "00:02", 6, 50.0, 8000, 0)]
    schema = "ip STRING, min STRING, mem_used BIGINT, cpu_idle DOUBLE, yarn_mem_used BIGINT, yarn_cpu_used BIGINT"
    df = spark.createDataFrame(rows, schema)
    want = {"mem": [5, 6], "cpu": [0.6, 0.5], "mpc": [2.0, None], "vcore": [4, 0]}
    for metric, values in want.items():
        got = rollup.metric_series(df, metric).orderBy("min").collect()
        assert [r["value"] for r in got] == values
    assert rollup.all_metric_series(df, "ip").count() == 8
    with pytest.raises(ValueError):
        rollup.metric_series(df, "disk")


def test_compare_with_reference(spark):
    rows = [("r1", "1.1.1.1", 10, 10, 100.0), ("r1", "1.1.1.2", 5, 5, 0.0), ("r2", "1.1.1.1", 1, None, 50.0)]
    servers = spark.createDataFrame(rows, "run STRING, ip STRING, mr_nbr BIGINT, sql_nbr BIGINT, max_w DOUBLE")
    with_tput = compare.with_throughput(servers, F.lit(10))
    got = {(r["run"], r["ip"]): r for r in compare.versus_reference(with_tput, "1.1.1.1").collect()}
    assert got["r1", "1.1.1.2"]["tput_vs_ref"] == 0.5 and got["r1", "1.1.1.2"]["tput_per_wh"] == 0
    assert got["r1", "1.1.1.1"]["per_wh_vs_ref"] == 1.0 and got["r2", "1.1.1.1"]["tput"] == 1
    absent = compare.versus_reference(with_tput, "9.9.9.9").collect()
    assert all(r["tput_vs_ref"] == 0 and r["per_wh_vs_ref"] == 0 for r in absent)


def test_linear_fit_holdout(spark):
    rng = random.Random(1)
    points = [(i, x := rng.uniform(1, 10), 25 * x + 3 + rng.random()) for i in range(200)]
    df = spark.createDataFrame(points, "i INT, x DOUBLE, y DOUBLE")
    got = fit.linear_fit_holdout(df, "x", "y", ["i"], 20).first()
    m, b = np.polyfit([p[1] for p in points[:-20]], [p[2] for p in points[:-20]], 1)
    assert got["n"] == 180 and math.isclose(got["slope"], m) and math.isclose(got["intercept"], b)
    assert got["max_x"] == max(p[1] for p in points) and math.isclose(got["y_end"], m * got["max_x"] + b)


def test_helpers(spark):
    df = spark.createDataFrame(
        [("1.2.3.4",), ("256.2.3.4",), ("1.2.3",), ("1.2.3.x",), ("01.2.3.255",), ("99999999999.1.1.1",)], "t STRING")
    assert [r[0] for r in df.select(tx.ip_valid(F.col("t"))).collect()] == [True, False, False, False, True, False]
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(cx.default_zero(F.lit(" 7 "), "bigint")) == 7
    assert value(cx.default_zero(F.lit(""))) == 0 and value(cx.default_zero(F.lit("x"))) == 0
    assert value(cx.reuse_ratio(F.lit(5), F.lit(2))) == 2.5 and value(cx.reuse_ratio(F.lit(5), F.lit(0))) == 0
    assert value(cx.percent_to_fraction(F.lit(12.965))) == 0.1297
    assert value(tx.job_key(F.lit("attempt_1_2_r_3_0"))) == "attempt_1_2_r"
    assert value(tx.run_tag(F.lit("0711-24H-td3-x"))) == "td3-x" and value(tx.run_tag(F.lit("0711-24H"))) == "POC"
    assert value(tx.run_of(F.lit("/a/0711-24H/tdw-1-2-3-4/sdr_log"))) == "0711-24H"
    assert value(tx.run_of(F.lit("/a/0711-24H/x.config.all.txt"))) == "0711-24H"
    assert value(tx.host_to_ip(tx.host_of(F.lit("/a/0711-24H/tdw-1-2-3-4/sdr_log")))) == "1.2.3.4"


def test_means_and_sums_are_exact(spark):
    df = spark.createDataFrame([(0.001, 2**60), (0.004, 1)], "x DOUBLE, n BIGINT")
    assert tuple(rollup.column_means(df, ["x"]).first()) == (0.0025,)
    assert tuple(rollup.column_sums(df).first()) == (0.005, 2**60 + 1)
    odd = spark.createDataFrame([(float("nan"),), (1.0,)], "x DOUBLE")
    assert str(rollup.column_sums(odd).first()[0]) == "nan"


def test_line_ends_lie_on_the_line(spark):
    df = spark.createDataFrame([(2.0, 5.0), (4.0, 9.0)], "x DOUBLE, y DOUBLE")
    from rackmeter.operators import fit

    row = fit.linear_fit(df, "x", "y").first()
    assert (round(row["y_start"], 9), round(row["y_end"], 9)) == (5.0, 9.0)


def test_missing_paths_are_left_out(spark, tmp_path):
    from rackmeter.sources import lines as ln

    (tmp_path / "there").mkdir()
    (tmp_path / "there" / "a.txt").write_text("x\ny\n")
    paths = [str(tmp_path / "there"), str(tmp_path / "gone" / "*")]
    assert ln.read_lines(spark, paths, optional=True).count() == 2
    assert ln.list_files(spark, paths, optional=True).count() == 1


def test_describe_all_columns_in_two_reads(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 20_000
    data = {
        "few": rng.integers(0, 3, n).astype(float), "many": rng.normal(size=n), "heavy": np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n)),
        "whole": rng.integers(-5, 10**12, n).astype(float), "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)), "none": np.full(n, np.nan),
    }
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(data)).withColumn("text", F.lit("x")).repartition(7)
    df = df.withColumn("gaps", F.when(F.col("few") > 0, F.col("gaps")))
    rows = {r.column: r for r in describe.describe_all(df).collect()}
    data["gaps"] = np.where(data["few"] > 0, data["gaps"], np.nan)
    assert list(rows) == list(data)
    for name, values in data.items():
        kept, row = values[~np.isnan(values)], rows[name]
        assert row["count"] == len(kept)
        if len(kept):
            assert (row["min"], row["max"]) == (kept.min(), kept.max())
            assert np.allclose([row.p25, row.p50, row.p75], np.quantile(kept, [0.25, 0.5, 0.75]), rtol=1e-15)
            assert np.allclose([row["mean"], row["std"]], [kept.mean(), kept.std(ddof=1)])
        else:
            assert row.p50 is None and row["mean"] is None
    assert describe.describe_all(df.select("text")).count() == 0
    df.write.parquet(str(tmp_path / "t"))
    plan = describe._second_read(
        spark.read.parquet(str(tmp_path / "t")), ["few", "many"], [describe.Bracket(0, 0, 0.0, 1.0, 5.0), describe.Bracket(1, 0, 0.0, 0.1, 5.0)]
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
