"""Queries that write files to the shared scratch folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.catalog import bindings as b
from rackmeter.catalog import sample_queries, server_queries, task_queries, text_queries
from rackmeter.operators import distribution, recalc, rollup
from rackmeter.plans import fleet, rollups
from rackmeter.schemas import CPU_COLUMNS, MEM_COLUMNS, SAMPLE_COLUMNS, SWAP_COLUMNS, YARN_COLUMNS
from rackmeter.session import scratch_path
from rackmeter.sinks import commits, key_files, writers
from rackmeter.sources import lines as ln
from rackmeter.sources import monitor, tables

ALL_METRICS = CPU_COLUMNS + YARN_COLUMNS + MEM_COLUMNS + SWAP_COLUMNS
# Files and rows that one task writes.
TASK_FILES, TASK_ROWS = 100, 50_000


def _write_lines(lines: DataFrame, path: str, **options: str) -> str:
    """Write lines below ``run=/host=/kind=`` by key and number, in this order within a file.

    A server has one file of a kind, or several if it has very many rows; the lines of a key stay in one file.
    """
    keys = ["run", "host", "kind"]
    ordered = lines.sortWithinPartitions(*keys, "pos", "n").select(*keys, "line")
    if key_files.local_path(lines, path) and options in ({}, {"compression": "gzip"}):
        key_files.write_lines(ordered, path, keys, bool(options))
    else:
        ordered.write.mode("append").partitionBy(*keys).options(**options).text(path)
    return path


def _texts(df: DataFrame, kind: str, key: str, texts) -> DataFrame:
    """The lines of one kind of input per row of ``df`` with their number, run, host and kind; NULL lines are skipped.

    Rows are dealt by server before they are rendered, so that a server has one file, or several if it has over
    ``TASK_ROWS`` rows. The number of tasks follows the number of files and rows.
    """
    server = ["run", "host"]
    named = df.withColumn("host", F.concat(F.lit("tdw-"), F.translate("ip", ".", "-")))
    counts = named.groupBy(*server).agg(F.count("*").alias("n"))
    found = counts.agg(F.count("*").alias("files"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    tasks = max(1, -(-found.files // TASK_FILES), -(-(found.rows or 0) // TASK_ROWS))
    part = F.lit(0)
    if (found.most or 0) > TASK_ROWS:
        large = counts.where(F.col("n") > TASK_ROWS).select(*server, F.ceil(F.col("n") / TASK_ROWS).alias("parts"))
        named = named.join(large, server, "left")
        part = F.coalesce(F.pmod(F.xxhash64(key), "parts"), part)
    return named.repartition(tasks, *server, part).select(
        *server, F.lit(kind).alias("kind"), F.col(key).alias("pos"), F.posexplode(F.array(*texts)).alias("n", "line")
    ).where(F.col("line").isNotNull())


def _dumps(spark, sf_dir) -> DataFrame:
    """All samples as dump lines of two runs."""
    return _texts(b.samples(spark, sf_dir, two_runs=True), "sdr_log", "event_id", b.dump_texts())


def src_sample_blocks_files(spark, sf_dir):
    path = _write_lines(_dumps(spark, sf_dir), scratch_path(spark, "dumps"))
    return fleet.sample_table_from_runs(spark, f"{path}/*", True, "kind=sdr_log").select(
        "run", "date", "ip", "hour", *ALL_METRICS
    )


def src_gzip(spark, sf_dir):
    path = _write_lines(_dumps(spark, sf_dir), scratch_path(spark, "gzip"), compression="gzip")
    return monitor.cpu_rows(ln.read_lines(spark, f"{path}/*/*/*/*.gz")).select("run", "ip", *CPU_COLUMNS)


def _app_files(spark, sf_dir, label: str) -> str:
    """Application logs per server as CSV; names and values carry leading blanks."""
    path = scratch_path(spark, label)
    apps = b.apps(spark, sf_dir)
    cells = {
        "app": F.col("app"),
        " executors": F.col("executors"), " tasks": F.col("tasks"), " duration2": F.col("duration2"),
        " avgtask": F.floor(F.try_divide(F.col("duration2"), F.col("tasks"))),
    }
    text = apps.select("run", "host", *[F.concat(F.lit(" "), F.coalesce(c.cast("string"), F.lit("0"))).alias(n) for n, c in cells.items()])
    out = text.hint("rebalance", "run", "host").write.partitionBy("run", "host")
    out.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def src_app_info(spark, sf_dir):
    path = _app_files(spark, sf_dir, "apps")
    return tables.app_info(spark, f"{path}/*/*").select(
        "run", "host", F.col("app").cast("bigint").alias("app"), "executors", "tasks", "duration2"
    )


def src_app_orders(spark, sf_dir):
    """Application logs whose servers write the columns in three orders, one without the mean, read as one."""
    path = scratch_path(spark, "orders")
    apps = b.apps(spark, sf_dir).withColumn("avgtask", F.floor(F.try_divide("duration2", "tasks")))
    server = F.regexp_extract("host", "([0-9]+)$", 1).cast("int")
    orders = [
        ["app", "executors", "tasks", "duration2", "avgtask"], ["duration2", "app", "avgtask", "tasks", "executors"],
        ["tasks", "duration2", "executors", "app"],
    ]
    for k, names in enumerate(orders):
        some = apps.where(server % 3 == k).select("run", "host", *[F.col(n).cast("string").alias(f" {n}" * (k == 1) or n) for n in names])
        some.hint("rebalance", "run", "host").write.mode("append").partitionBy("run", "host").csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return tables.app_info(spark, f"{path}/*/*").select(
        "run", "host", F.col("app").cast("bigint").alias("app"), "executors", "tasks", "duration2", "avgtask"
    )


def src_hosts(spark, sf_dir):
    return ln.hosts(spark, f"{_app_files(spark, sf_dir, 'hosts')}/*/*/*")


def snk_append(spark, sf_dir):
    path = scratch_path(spark, "recalc")
    apps = tables.app_info(spark, f"{_app_files(spark, sf_dir, 'append')}/*/*")
    rows = recalc.recalculation_rows(apps)
    early = F.col("server") < "10-0-0-15"
    writers.append_rows(rows.where(early), path)
    writers.append_rows(rows.where(~early), path)
    schema = (
        "date STRING, hours STRING, server STRING, tag STRING, duration BIGINT, tasks BIGINT, executors BIGINT, "
        "extra_executors BIGINT, extra_time DOUBLE, old_time DOUBLE, new_time DOUBLE, old_over_new DOUBLE"
    )
    return spark.read.schema(schema).csv(path, header=True)


def src_task_info(spark, sf_dir):
    path = scratch_path(spark, "tasks")
    tid = b.attempt_id(F.col("job"), F.col("attempt"))
    tasks = b.tasks(spark, sf_dir).select(
        tid.alias("tid"),
        *[
            F.concat(F.lit(" "), c).alias(n)
            for n, c in [
                (" starttime", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")),
                (" endtime", F.date_format(F.col("l_shipdate") + F.make_dt_interval(secs=F.col("duration")), "yyyy-MM-dd HH:mm:ss")),
                (" duration", F.col("duration").cast("string")),
            ]
        ],
    )
    tasks.write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return tables.task_info(spark, path)


def src_sample_table(spark, sf_dir):
    path = scratch_path(spark, "samples")
    samples = b.samples(spark, sf_dir, two_runs=True).select("run", "host", *SAMPLE_COLUMNS)
    writers.write_new_partitions(writers.for_csv(samples), path, fmt="csv")
    return tables.sample_table(spark, f"{path}/*/*").select(*SAMPLE_COLUMNS)


def snk_incremental(spark, sf_dir):
    path = scratch_path(spark, "incremental")
    samples = b.samples(spark, sf_dir, two_runs=True).select("run", "host", "event_id", "ctn")
    # Servers written first stay as they are; the later run only adds the others.
    writers.write_new_partitions(samples.where(F.col("host").endswith("1")), path)
    writers.write_new_partitions(samples.withColumn("ctn", F.col("ctn") + 100), path)
    # Spark's own reading of folder names takes time with the square of their number, on the driver.
    read = spark.read.schema("event_id BIGINT, ctn BIGINT").option("recursiveFileLookup", "true").parquet(path)
    name = lambda k: F.regexp_extract("_metadata.file_path", f"/{k}=([^/]*)/", 1)
    return read.select("event_id", "ctn", *[F.nullif(name(k), F.lit(key_files.NO_VALUE)).alias(k) for k in ("run", "host")])


def _rollup(spark, sf_dir) -> DataFrame:
    return rollup.hourly_means(rollup.with_date_parts(b.samples(spark, sf_dir)))


def snk_rollup(spark, sf_dir):
    path = scratch_path(spark, "rollup")
    means = _rollup(spark, sf_dir)
    # Runs written first stay as they are; the second call only adds the others.
    writers.write_new_partitions(means.where("run < '0115-24H'"), path, ["run"])
    writers.write_new_partitions(means.withColumn("hour", F.when(F.col("run") < "0115-24H", 99).otherwise(F.col("hour"))), path, ["run"])
    return sample_queries.rounded(spark.read.schema(means.schema).parquet(path))


def snk_rollup_late(spark, sf_dir):
    """Servers and hours of old runs that come late join the roll-up; what is added twice counts once."""
    path = scratch_path(spark, "late")
    samples = b.samples(spark, sf_dir)
    late = F.col("event_id") % 3 == 0
    rollups.add_samples(samples.where(~late & F.col("host").endswith("1")), path, "first")
    rollups.add_samples(samples.where(~late & ~F.col("host").endswith("1")), path, "other servers")
    rollups.add_samples(samples.where(late), path, "late samples")
    rollups.add_samples(samples.where(late), path, "late samples")
    return sample_queries.rounded(rollups.hourly_means(spark, path))


def rep_rollup_runs(spark, sf_dir):
    """The hourly roll-up from run folders, updated when more servers have arrived."""
    dumps = _dumps(spark, sf_dir)
    folders, path = scratch_path(spark, "folders"), scratch_path(spark, "grown")
    odd = F.col("host").rlike("[13579]$")
    _write_lines(dumps.where(odd), folders)
    rollups.update_from_runs(spark, f"{folders}/*", path, True, "kind=sdr_log")
    _write_lines(dumps.where(~odd), folders)
    rollups.update_from_runs(spark, f"{folders}/*", path, True, "kind=sdr_log")
    rollups.update_from_runs(spark, f"{folders}/*", path, True, "kind=sdr_log")
    return sample_queries.rounded(rollups.hourly_means(spark, path))


def snk_commits(spark, sf_dir):
    """Appends by token: the second of the same token and a writer that stopped half-way add nothing."""
    path = scratch_path(spark, "commits")
    apps = b.apps(spark, sf_dir)
    early = F.col("app") % 2 == 0
    commits.append_once(apps.where(early), path, "even")
    commits.stage(apps, path)  # never published
    commits.append_once(apps.where(~early), path, "odd")
    commits.append_once(apps.where(early), path, "even")
    return commits.read(spark, path)


def src_rollup_reread(spark, sf_dir):
    path = scratch_path(spark, "reread")
    writers.write_once(_rollup(spark, sf_dir), path)
    return rollup.hourly_shares(tables.rollup_table(spark, path)).select(
        "run", "year", "day", "ip", "hour", F.round("`cpu_nonidle%`", 9).alias("nonidle"),
        F.round("`vcore%`", 9).alias("vcore")
    )


def snk_single_csv(spark, sf_dir):
    path = scratch_path(spark, "hourly")
    writers.write_sorted_csv(rollup.hourly_utilisation(b.samples(spark, sf_dir)), path, ["run", "ip", "hour"])
    schema = "run STRING, ip STRING, hour INT, cpu_user DOUBLE, non_idle DOUBLE, vcore_ratio DOUBLE, cpu_used DOUBLE, mem_used DOUBLE"
    return sample_queries.rounded(spark.read.schema(schema).csv(path, header=True))


def src_raw_csv(spark, sf_dir):
    path = scratch_path(spark, "traffic")
    ts = F.col("o_orderdate")
    b.table(spark, sf_dir, "orders").select(
        b.server_ip(F.col("o_custkey") % 50).alias("ip"),
        F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" ")).alias("Date "),
        F.date_format(ts, "MMM").alias("Mon"),
        F.col("o_totalprice").alias("net_received"),
        (F.col("o_orderkey") / 4).alias("net_transferred"),
    ).write.csv(path, header=True, ignoreTrailingWhiteSpace=False)
    return tables.traffic(spark, path)


def flt_missing_source(spark, sf_dir):
    path = scratch_path(spark, "audit")
    apps = b.apps(spark, sf_dir).select("run", "host", F.col("app").cast("string").alias("line"))
    kinds = apps.withColumn("kind", F.lit("sum_cron")).unionByName(
        apps.where(~F.col("host").endswith("3")).withColumn("kind", F.lit("hottub_log"))
    )
    kinds.hint("rebalance", "run", "host", "kind").write.partitionBy("run", "host", "kind").text(path)
    patterns = ["kind=sum_cron/*", "kind=hottub_log/*", "kind=sdr_log/*"]
    return fleet.sources_audit(spark, f"{path}/*", patterns, "*/*")


def rep_fleet_files(spark, sf_dir):
    """The fleet report read from run folders that hold all kinds of input."""
    path = scratch_path(spark, "fleet")
    power = b.power(spark, sf_dir)
    row = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("avg_w", "max_w", "min_w", "stdev_w")])
    power_lines = _texts(power, "avg_max_min_stdev_x", "l_suppkey", [F.lit("avg max min stdev"), row])
    _write_lines(rollup.union_all([_dumps(spark, sf_dir), power_lines, _perf_lines(spark, sf_dir)]), path)
    config = b.config(spark, sf_dir).select(
        "run",
        F.concat_ws(
            "\n",
            F.concat(F.lit("===="), "ip", F.lit("====")), F.concat(F.lit("SMT="), "smt"),
            F.concat(F.lit("vcore="), "vcore"), F.concat(F.lit("freq="), "freq"),
            F.concat(F.lit("jdk="), "jdk"), F.concat(F.lit("JAVA_HOME: "), "java_home"),
        ).alias("line"),
    )
    config.withColumn("kind", F.lit("config")).write.mode("append").partitionBy("run", "kind").text(path)
    files = {
        "config": "kind=config", "perf": "kind=sum_cron", "power": "kind=avg_max_min_stdev_x", "dump": "kind=sdr_log",
    }
    return fleet.fleet_report_from_runs(
        spark, f"{path}/*", server_queries.HOURS, reference_ip=b.REFERENCE, keep_last=True, files=files
    )


def rep_fleet_older_files(spark, sf_dir):
    """The older report from folders with fixed-length configuration, summaries with spread and a utilisation file."""
    path, used = scratch_path(spark, "older"), scratch_path(spark, "utilisation")
    power = b.power(spark, sf_dir)
    row = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("avg_w", "max_w", "min_w", "stdev_w")])
    power_lines = _texts(power, "avg_max_min_stdev_x", "l_suppkey", [F.lit("avg max min stdev"), row])
    _write_lines(power_lines.unionByName(_perf_lines(spark, sf_dir)), path)
    config = text_queries.config_lines(spark, sf_dir).withColumn("run", F.regexp_extract("file", "/logs/([^/]+)/", 1))
    ordered = config.withColumn("kind", F.lit("config")).repartition("run").sortWithinPartitions("run", "pos")
    ordered.select("run", "kind", "line").write.mode("append").partitionBy("run", "kind").text(path)
    means = b.samples(spark, sf_dir).groupBy("ip").agg(
        *[F.round(F.avg(c), 6).alias(c) for c in ("yarn_cpu_used", "cpu_user", "cpu_sys", "cpu_idle")]
    )
    means.write.csv(used, sep="\t")
    files = {"config": "kind=config", "perf": "kind=sum_cron", "power": "kind=avg_max_min_stdev_x"}
    report = fleet.older_report_from_runs(spark, f"{path}/*", used, server_queries.HOURS, reference_ip=b.REFERENCE, files=files)
    return report.withColumns({c: F.round(c, 9) for c in ("user_share", "sys_share", "idle_share")})


def rep_recalc_runs(spark, sf_dir):
    """The recalculation from run folders, added to when another run has arrived."""
    folders, path = scratch_path(spark, "recalcs"), scratch_path(spark, "recalculated")
    rows = b.apps(spark, sf_dir).select("run", "host", *[F.col(c).cast("string").alias(c) for c in ("executors", "tasks", "duration2")])
    for first in (True, False):
        some = rows.where((F.col("run") == "0101-24H") == F.lit(first))
        some.hint("rebalance", "run", "host").write.mode("append").partitionBy("run", "host").csv(folders, header=True)
        fleet.recalculation_from_runs(spark, f"{folders}/*", path, "*")
    return fleet.recalculation_from_runs(spark, f"{folders}/*", path, "*")


def src_util_file(spark, sf_dir):
    """The utilisation file read by its own reader."""
    path = scratch_path(spark, "tsv")
    b.samples(spark, sf_dir).select("ip", "yarn_cpu_used", "cpu_user", "cpu_sys", "cpu_idle").write.csv(path, sep="\t")
    return tables.utilisation(spark, path)


def _perf_lines(spark, sf_dir) -> DataFrame:
    texts = [F.lit("=="), F.lit("==")]
    for name, label in [("mr", "Total executors mr"), ("sql", "Total tasks"), ("scala", "Total tasks")]:
        texts += [
            F.format_string(f"{label} : %d", f"{name}_nbr"),
            F.concat(F.lit("Average task duration : "), F.col(f"{name}_time").cast("string"), F.lit(" secs")),
            F.lit("Task duration standard variance : 0 secs"),
        ]
    return _texts(b.perf(spark, sf_dir), "sum_cron", "l_suppkey", texts)


def rep_task_distribution_files(spark, sf_dir):
    return distribution.task_distribution(src_task_info(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in [
        src_sample_blocks_files, src_gzip, src_app_info, src_app_orders, src_hosts, snk_append, src_task_info,
        src_sample_table, snk_incremental, snk_rollup, snk_rollup_late, rep_rollup_runs, snk_commits, rep_fleet_older_files, rep_recalc_runs, src_util_file, src_rollup_reread, snk_single_csv, src_raw_csv,
        flt_missing_source, rep_fleet_files, rep_task_distribution_files,
    ]
}

_list = ", ".join

SQL = {
    "src_sample_blocks_files": b.with_samples(
        f"select run, date, ip, hour, {_list(ALL_METRICS)} from samples", True),
    "src_gzip": b.with_samples(f"select run, ip, {_list(CPU_COLUMNS)} from samples", True),
    "src_app_info": b.with_apps("select * from apps"),
    "src_app_orders": b.with_apps("""
        select *, case when cast(regexp_extract(host, '([0-9]+)$', 1) as int) % 3 < 2 and tasks > 0
          then cast(duration2 // tasks as double) end as avgtask from apps"""),
    "src_hosts": b.with_apps(
        "select distinct run, host, replace(replace(host, 'tdw-', ''), '-', '.') as ip from apps"),
    "src_task_info": b.with_tasks(f"""
        select {b.ATTEMPT_SQL} as tid, l_shipdate as starttime, l_shipdate + to_seconds(duration) as endtime, duration
        from tasks"""),
    "src_sample_table": b.with_samples(f"select {_list(SAMPLE_COLUMNS)} from samples", True),
    "snk_incremental": b.with_samples(f"""
        select run, host, event_id, case when host like '%1' then ctn else ctn + 100 end as ctn from samples""", True),
    "snk_rollup": sample_queries.SQL["agg_hourly_mean"],
    "snk_rollup_late": sample_queries.SQL["agg_hourly_mean"],
    "rep_rollup_runs": sample_queries.SQL["agg_hourly_mean"].replace(b.SAMPLES_SQL, b.TWO_RUNS_SQL),
    "rep_fleet_older_files": server_queries.FLEET_OLDER_SQL,
    "rep_recalc_runs": task_queries.RECALC_ROWS_SQL,
    "src_util_file": text_queries.SQL["src_util_tsv"],
    "snk_commits": b.with_apps("select * from apps"),
    "src_rollup_reread": sample_queries.SQL["agg_hourly_shares"],
    "snk_single_csv": sample_queries.SQL["agg_hourly_sql"],
    "src_raw_csv": f"""
        select {b.ip_sql('(o_custkey % 50)')} as ip, strftime(o_orderdate, '%Y-%m-%d') as Date,
          strftime(o_orderdate, '%b') as Mon, o_totalprice as net_received, o_orderkey / 4 as net_transferred from orders""",
    "flt_missing_source": b.with_apps("""
        , servers as (select distinct run, host, replace(replace(host, 'tdw-', ''), '-', '.') as ip from apps)
        select run, host, ip, 'kind=hottub_log/*' as pattern from servers where host like '%3'
        union all select run, host, ip, 'kind=sdr_log/*' as pattern from servers"""),
    "rep_fleet_files": server_queries.FLEET_FILES_SQL,
    "rep_task_distribution_files": task_queries.SQL["rep_task_distribution"],
    "snk_append": task_queries.RECALC_ROWS_SQL,
}
