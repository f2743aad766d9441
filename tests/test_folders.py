"""Run folders with all inputs, including the awkward ones."""

import gzip

import pytest
from pyspark.sql import functions as F

from rackmeter.operators import recalc, rollup
from rackmeter.plans import fleet
from rackmeter.schemas import FLEET_COLUMNS, FLEET_COLUMNS_SHORT, SAMPLE_COLUMNS
from rackmeter.sinks import writers
from rackmeter.sources import lines as ln
from rackmeter.sources import summary, tables

REFERENCE = "10.0.29.3"
HOSTS = ["tdw-10-0-29-3", "tdw-10-0-29-4", "tdw-10-0-29-5"]


def config_text():
    out = ["config dump", "generated", "."]
    for i, host in enumerate(HOSTS[:2]):
        ip = host.replace("tdw-", "").replace("-", ".")
        out += [f"===={ip}====", "SMT=8", f"vcore={66 + i}", "freq=3.5001GHz", "jdk=1.8", "x4", "x5", "x6", "x7",
                f"JAVA_HOME: /opt/jdk/openjdk-1.8.0-r{i}", "x9"]
    return "\n".join(out) + "\n"


def summary_text(n, sql=True):
    lines = ["====host====", "===Summary===", f"Total executors mr   : {n}", "Average task duration by X : 65.5 secs",
             "Task duration standard variance : 180.25 secs"]
    if sql:
        lines += [f"Total tasks    : {n // 2}", "Average task duration by X : 38.6 secs", "Task duration standard variance   : 91",
                  "Total tasks    : 15", "Average task duration by X : 12.25 secs", "Task duration standard variance  : 290"]
    else:
        lines += ["something else : 1"] * 6
    return "\n".join(lines + ["Total tasks : 99999"]) + "\n"


def dump_text(ticks, idle):
    out = ["Containers : 5"]
    for k in range(ticks):
        out += [f"== Tue Jul 11 {k:02d}:00:01 CST 2017 ==", "avg-cpu:  %user %nice %system %iowait %steal %idle",
                f"  40.10 0.00 5.20 1.10 0.00 {idle:.2f}",
                "Tue Jul 11 00:00:01 CST 2017 now MR 10/12 SQL 8/9 SCALA 2/3", "Containers : 20", "Containers : 21",
                "Memory-Used : 204999MB", "Memory-Capacity : 262144MB", "CPU-Used : 44 vcores", "CPU-Capacity : 66 vcores",
                "Mem:   512  300  100  2  110  200", "Swap:   16    1   15"]
    return "\n".join(out) + "\n"


@pytest.fixture
def runs(tmp_path):
    run = tmp_path / "0711-24H-td3"
    for i, host in enumerate(HOSTS):
        d = run / host
        d.mkdir(parents=True)
        (d / f"sum_cron.2017.{host}").write_text(summary_text(1000 * (i + 1), sql=i != 1))
        if i < 2:
            (d / "avg_max_min_stdev_2017_24H").write_text("avg max min stdev\n812.5 1000 640 75.2\n1 2 3 4\n")
        if i == 0:
            with gzip.open(d / f"sdr_log_{host}.gz", "wt") as f:
                f.write(dump_text(4, 50))
        else:
            (d / f"sdr_log_{host}").write_text(dump_text(3, 60))
    (run / HOSTS[0] / "hottub_log_1").write_text(
        "ip, total_crash_cnt, more\n10.0.29.3, 1, 2, 3, 4, 50, 60, 7, 8, 20, 0, 9\n")
    (run / HOSTS[1] / "hottub_log_1").write_text("changed header\n10.0.29.4, 1, 2, 3, 4, 50, 60, 7, 8, 20, 0, 9\n")
    (run / "tdw-10-0-29-9").mkdir()  # empty: not a server
    other = run / "notes"
    other.mkdir()
    (other / "readme").write_text("x\n")
    (run / "2017-07-11.config.all.txt").write_text(config_text())
    return tmp_path


def test_hosts_and_audit(spark, runs):
    found = ln.hosts(spark, f"{runs}/*/*/*")
    assert sorted(r["host"] for r in found.collect()) == HOSTS
    assert {r["run"] for r in found.collect()} == {"0711-24H-td3"}
    rejected = ln.rejected_folders(spark, f"{runs}/*/*/*").collect()
    assert [r["file"].endswith("notes/readme") for r in rejected] == [True]
    audit = fleet.sources_audit(spark, f"{runs}/*", ["avg_max_min_stdev_*", "hottub_log*", "nothing*"])
    lacking = sorted((r["pattern"], r["host"]) for r in audit.collect())
    assert lacking == sorted(
        [("avg_max_min_stdev_*", HOSTS[2]), ("hottub_log*", HOSTS[2])] + [("nothing*", h) for h in HOSTS])


def test_fleet_report(spark, runs):
    report = fleet.fleet_report_from_runs(spark, f"{runs}/*", reference_ip=REFERENCE)
    assert report.columns == ["run", *FLEET_COLUMNS, *fleet.DERIVED, "missing_sources"]
    rows = report.collect()
    assert [r["ip"] for r in rows] == ["10.0.29.3", "10.0.29.4", "10.0.29.5"]
    ref, second, third = rows
    assert (ref["mr_nbr"], ref["sql_nbr"], ref["tput"]) == (1000, 500, 1500)
    assert (ref["smt"], ref["vcore"], ref["jdk"]) == (8, 66, "/opt/jdk/openjdk-1.8.0-r0")
    assert ref["tput_per_wh"] == 1500 / 1000 / 24 and ref["tput_vs_ref"] == 1 and ref["per_wh_vs_ref"] == 1
    assert (ref["containers"], ref["cpu_used"], ref["mem_used_gb"], ref["actual_vcore"]) == (21, 44, 204, 20)
    assert (ref["user_share"], ref["sys_share"], ref["idle_share"]) == (0.401, 0.052, 0.5)
    assert ref["missing_sources"] == "" and ref["topops_blank"] is None
    # sql lines with another text count as 0
    assert (second["sql_nbr"], second["sql_time"], second["tput"]) == (0, 0, 2000)
    # no power: 0; no configuration: NULL; both are named
    assert third["missing_sources"] == "config,power" and third["max_w"] == 0 and third["tput_per_wh"] == 0
    assert third["jdk"] is None and third["mr_nbr"] == 3000


def test_quick_view_and_flat_lines(spark, runs):
    report = fleet.fleet_report_from_runs(spark, f"{runs}/*", hours=12, reference_ip=REFERENCE).cache()
    view = fleet.quick_view(report).collect()
    assert view[0]["server"] == "29.3" and view[0]["smt_vcore_freq"] == "8/66/3.50"
    assert view[0]["mr_time"] == 66 and not view[0]["mr_time_ok"] and view[0]["sql_time_ok"] and not view[0]["tput_ok"]
    assert view[0]["tput_vs_ref"] == "1.0x" and view[0]["jdk"] == "openjdk-1.8.0-r0"
    assert view[0]["tput_per_wh"] == 0.13  # 0.125, half away from zero
    flat = [r["line"] for r in writers.flat_lines(report).collect()]
    assert flat[0].startswith("10.0.29.3,,,,,/opt/jdk/openjdk-1.8.0-r0,,,,8,66,3.5001GHz,,1000,65.5,,,500,38.6,15,")
    assert all(line.count(",") == 34 for line in flat)
    short = [r["line"] for r in writers.flat_lines(report, FLEET_COLUMNS_SHORT).collect()]
    assert all(line.count(",") == 29 for line in short)
    report.unpersist()


def test_jvm_pool(spark, runs):
    rows = fleet.jvm_pool_report_from_runs(spark, f"{runs}/*").collect()
    assert [(r["ip"], r["mr_ratio"], r["sql_ratio"], r["jdk"]) for r in rows] == [
        ("10.0.29.3", 2.5, 0.0, "openjdk-1.8.0-r0")]
    lines = ln.read_lines(spark, f"{runs}/*/*/hottub_log*")
    assert summary.jvm_pool_rejects(lines).count() == 1
    assert fleet.jvm_pool_counts(summary.jvm_pool(lines)).columns[6:9] == ["mr_reuse", "mr_fallback", "mr_new"]


def test_perf_spread(spark, runs):
    lines = ln.read_lines(spark, f"{runs}/*/*/sum_cron*")
    rows = {r["ip"]: r for r in summary.perf_spread(lines).collect()}
    one = rows["10.0.29.3"]
    assert (one["mr_nbr"], one["mr_time"], one["mr_std"], one["sql_std"], one["scala_std"]) == (1000, 65.5, 180.25, 91.0, 290.0)


def test_short_summary_and_wrong_labels(spark, tmp_path):
    d = tmp_path / "0711-24H" / "tdw-1-1-1-1"
    d.mkdir(parents=True)
    (d / "sum_cron.1").write_text("a\nb\nTotal executors mr : 5\nwrong : 9 secs\n")
    lines = ln.read_lines(spark, f"{tmp_path}/*/*/sum_cron*")
    row = summary.perf_summary(lines).first()
    assert (row["mr_nbr"], row["mr_time"], row["sql_nbr"], row["scala_time"]) == (5, None, None, None)
    assert summary.perf_spread(lines).count() == 0


def test_config_forms(spark, tmp_path):
    (tmp_path / "0711-24H").mkdir()
    good = tmp_path / "0711-24H" / "a.config.all.txt"
    good.write_text(config_text() )
    keyed = {r["ip"]: r for r in summary.config_blocks(ln.read_lines(spark, str(good))).collect()}
    fixed = {r["ip"]: r for r in summary.config_fixed(ln.read_lines(spark, str(good))).collect()}
    assert set(keyed) == set(fixed) == {"10.0.29.3", "10.0.29.4"}
    assert keyed["10.0.29.4"]["vcore"] == "67" and fixed["10.0.29.4"]["vcore"] == 67
    assert keyed["10.0.29.3"]["java_home"] == fixed["10.0.29.3"]["java_home"] == "/opt/jdk/openjdk-1.8.0-r0"
    # A repeated key counts with its last value; a server named again with its last block.
    bad = tmp_path / "0711-24H" / "b.config.all.txt"
    bad.write_text(config_text() + "SMT=4\nSMT=2\n")
    lines = ln.read_lines(spark, str(bad))
    assert {r["ip"]: r["smt"] for r in summary.config_blocks(lines).collect()}["10.0.29.4"] == "2"
    assert summary.config_fixed(lines).count() == 0 and summary.config_fixed_rejects(lines).count() == 1


def test_missing_optional_input(spark, tmp_path):
    assert ln.read_lines(spark, f"{tmp_path}/none*", optional=True).count() == 0
    assert tables.app_info(spark, f"{tmp_path}/none*", optional=True).count() == 0
    with pytest.raises(Exception):
        ln.read_lines(spark, f"{tmp_path}/none*")


def test_app_info_with_blanks_and_more_columns(spark, tmp_path):
    d = tmp_path / "0524-24H" / "tdw-10-0-0-1"
    d.mkdir(parents=True)
    (d / "mr_appinfo.1").write_text("app, tasks, executors , other, duration2, avgtask\na1, 2, 4, x, 100, 50\n")
    apps = tables.app_info(spark, f"{tmp_path}/*/*/mr_appinfo*")
    row = recalc.recalculation_rows(apps).first()
    assert (row["server"], row["executors"], row["tasks"], row["extra_time"]) == ("10-0-0-1", 4, 2, 50.0)


def test_task_info(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "tid, starttime, endtime, duration\nattempt_1_2_r_3_0, 2017-03-04 05:06:07, 2017-03-04 05:07:10, 63\n")
    row = tables.task_info(spark, str(tmp_path / "t.csv")).first()
    assert (row["endtime"] - row["starttime"]).seconds == row["duration"] == 63


def test_small_tables(spark, tmp_path):
    (tmp_path / "u.tsv").write_text("10.0.0.1\t33.4\t40.5\t5\t50\n")
    assert tuple(tables.utilisation(spark, str(tmp_path / "u.tsv")).first()) == ("10.0.0.1", 33.4, 40.5, 5.0, 50.0)
    (tmp_path / "m.txt").write_text("1 2.5\n\n3 4\n")
    m = tables.matrix(ln.read_lines(spark, str(tmp_path / "m.txt")), 2)
    assert tuple(rollup.column_means(m, ["c0", "c1"]).first()) == (2.0, 3.25)
    assert tuple(rollup.column_sums(m, ["c0", "c1"]).first()) == (4.0, 6.5)
    (tmp_path / "one.txt").write_text("7 8\n")
    assert tuple(rollup.column_means(tables.matrix(ln.read_lines(spark, str(tmp_path / "one.txt")), 2), ["c0", "c1"]).first()) == (7.0, 8.0)


def test_sample_table_is_incremental(spark, runs, tmp_path):
    out = str(tmp_path / "out" / "samples")
    samples = fleet.sample_table_from_runs(spark, f"{runs}/*").select("run", "host", *SAMPLE_COLUMNS)
    writers.write_new_partitions(samples.where(F.col("host") == HOSTS[0]), out)
    changed = samples.withColumn("ctn", F.lit(0).cast("bigint"))
    writers.write_new_partitions(changed, out)
    writers.write_new_partitions(changed, out)
    rows = spark.read.parquet(out).groupBy("host").agg(F.count("*").alias("n"), F.max("ctn").alias("ctn")).collect()
    # The last block of each file is dropped: 4 -> 3 and 3 -> 2 samples.
    assert sorted((r["host"], r["n"], r["ctn"]) for r in rows) == [(HOSTS[0], 3, 21), (HOSTS[1], 2, 0), (HOSTS[2], 2, 0)]


@pytest.mark.parametrize("write, single", [(writers.write_single_csv, True), (writers.write_sorted_csv, False)])
def test_sorted_csv(spark, tmp_path, write, single):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit("x").alias("v"))
    path = tmp_path / "csv"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write(df, str(path), ["k"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(path.glob("part-*.csv"))
    assert (len(parts) == 1) == single
    keys = [int(line.split(",")[0]) for p in parts for line in p.read_text().splitlines()[1:]]
    assert keys == list(range(500))


def test_partition_values_stay_text(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.createDataFrame([("0711", "h1", 1), ("0712", "h1", 2)], "run STRING, host STRING, x INT")
    writers.write_new_partitions(df.where(F.col("run") == "0711"), out)
    writers.write_new_partitions(df, out)
    assert spark.read.parquet(out).count() == 2


ORDERS = {
    "task_info": (["tid", "starttime", "endtime", "duration"], ["t1", "2024-01-02 03:04:05", "2024-01-02 03:05:05", "60"]),
    "app_info": (["executors", "tasks", "duration2", "avgtask", "note"], ["3", "2", "50", "25.5", "x y"]),
    "sample_table": (["date", "ip", "hour", "cpu_user", "ctn#"], ["Mon", "10.0.0.1", "7", "1.5", "9"]),
    "rollup_table": (["year", "day", "ip", "hour", "cpu_user"], ["2024", "2", "10.0.0.1", "7", "1.5"]),
    "traffic": (["ip", "Date", "Mon", "net_received", "net_transferred"], ["10.0.0.1", "2024-01-02", "Jan", "2.5", "4.0"]),
}


@pytest.mark.parametrize("reader", list(ORDERS))
def test_columns_are_bound_by_the_header_of_each_file(spark, tmp_path, reader):
    from rackmeter.sources import tables

    names, row = ORDERS[reader]
    folder = tmp_path / "0711-24H" / "tdw-10-0-0-1"
    folder.mkdir(parents=True)
    write = lambda name, head, cells: (folder / name).write_text(head + "\n" + cells + "\n")
    write("a.csv", ",".join(names), ",".join(row))
    write("b.csv", ", ".join(reversed(names)), ", ".join(reversed(row)))
    write("c.csv", ",".join(names[:-1]), ",".join(row[:-1]))
    (folder / "d.csv").write_text("")
    (folder / "e.csv").write_text(",".join(names))
    read = getattr(tables, reader)
    alone = read(spark, str(folder / "a.csv")).drop("file").collect()
    assert len(alone) == 1 and None not in tuple(alone[0])
    df = read(spark, f"{tmp_path}/*/*")
    got = [r.asDict() for r in df.drop("file").collect()]
    last = {"ctn#": "ctn"}.get(names[-1], names[-1])
    assert len(got) == 3
    assert sum(g == alone[0].asDict() for g in got) == 2
    assert [g[last] for g in got].count(None) == 1 and {**alone[0].asDict(), last: None} in got


def test_optional_application_logs_with_a_missing_path(spark, tmp_path):
    from rackmeter.sources import tables

    (tmp_path / "a.csv").write_text("executors,tasks\n1,2\n")
    paths = [f"{tmp_path}/none*", f"{tmp_path}/a.csv"]
    assert [tuple(r)[:2] for r in tables.app_info(spark, paths, optional=True).collect()] == [(1, 2)]
    assert tables.app_info(spark, paths[:1], optional=True).count() == 0
