"""Complete reports over run folders: fleet, JVM pool, per-minute series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackmeter.functions import columns as cx
from rackmeter.functions import text as tx
from rackmeter.operators import compare, recalc, rollup
from rackmeter.schemas import FLEET_COLUMNS, FLEET_COLUMNS_SHORT
from rackmeter.sinks import commits
from rackmeter.sources import lines as ln
from rackmeter.sources import monitor, summary, tables

KEYS = ["run", "ip"]
# Where each kind of input lies, below the run folder (config) or the server folder.
FILES = {
    "config": "*.config.all.txt",
    "perf": "sum_cron*",
    "power": "avg_max_min_stdev_*",
    "dump": "sdr_log*",
    "pool": "hottub_log*",
}
DERIVED = ["tput", "tput_vs_ref", "tput_per_wh", "per_wh_vs_ref"]


def one_per_server(df: DataFrame) -> DataFrame:
    """The row of the first file (by name) where a server has several."""
    cells = [c for c in df.columns if c not in (*KEYS, "file")]
    return df.groupBy(*KEYS).agg(F.min_by(F.struct(*cells), "file").alias("c")).select(*KEYS, "c.*")


def utilisation_means(cpu_rows: DataFrame, count_rows: DataFrame) -> DataFrame:
    """Mean cpu shares and used vcores per server from the rows of the dumps."""
    cpu = cpu_rows.groupBy(*KEYS).agg(
        *[
            F.avg(c).alias(name)
            for c, name in [("cpu_user", "avg_user"), ("cpu_sys", "avg_sys"), ("cpu_idle", "avg_idle")]
        ]
    )
    vcore = count_rows.groupBy(*KEYS).agg(F.avg("vcore_total").alias("avg_vcore"))
    return cpu.join(vcore, KEYS, "full")


def _hours(hours: int | None) -> Column:
    if hours is not None:
        return F.lit(hours)
    return F.regexp_extract(tx.run_hours(F.col("run")), r"^(\d+)", 1).try_cast("int")


def fleet_report(
    servers: DataFrame,
    config: DataFrame,
    perf: DataFrame,
    power: DataFrame,
    util: DataFrame,
    yarn: DataFrame | None = None,
    hours: int | None = None,
    *,
    reference_ip: str,
) -> DataFrame:
    """One row per server in the report layout, compared with a reference server.

    All inputs hold one row per (run, ip) and are joined on these keys; a server that lacks an
    input stays in the report and names it in ``missing_sources``. ``hours`` is the length of the
    run; without it the run name tells. Without ``yarn`` the figures of both come in ``util``, which then says itself
    what a server has (``has_util``, ``has_yarn``; see ``monitor.server_means``).
    """
    inputs = {"config": config, "perf": perf, "power": power, "util": util} | ({} if yarn is None else {"yarn": yarn})
    joined = servers.select(*KEYS)
    for name, frame in inputs.items():
        own = [c for c in frame.columns if c not in ("host", "file")]
        flag = [F.lit(True).alias(f"has_{name}")] * (f"has_{name}" not in own)
        joined = joined.join(frame.select(*own, *flag), KEYS, "left")
    kinds = ["config", "perf", "power", "util", "yarn"]
    absent = F.array_compact(F.array(*[F.when(F.col(f"has_{n}").isNull(), F.lit(n)) for n in kinds]))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cells = {
        "ip": F.col("ip"), "jdk": F.col("java_home"), "freq": F.col("freq"),
        "smt": F.col("smt").try_cast("bigint"), "vcore": F.col("vcore").try_cast("bigint"),
        **{c: zero(c).cast("bigint") for c in ("mr_nbr", "sql_nbr", "scala_nbr")},
        **{c: zero(c).cast("double") for c in (
            "mr_time", "sql_time", "scala_time", "avg_w", "max_w", "min_w", "stdev_w")},
        "actual_vcore": F.round("avg_vcore"),
        "user_share": cx.percent_to_fraction(F.col("avg_user")),
        "sys_share": cx.percent_to_fraction(F.col("avg_sys")),
        "idle_share": cx.percent_to_fraction(F.col("avg_idle")),
        "containers": F.round("ctn").cast("bigint"),
        "cpu_used": F.round("yarn_cpu_used").cast("bigint"),
        "mem_used_gb": cx.mb_to_gb_floor(F.round("yarn_mem_used").cast("bigint")),
    }
    layout = [
        cells.get(name, F.lit(None).cast("string")).alias(name) for name in FLEET_COLUMNS
    ]
    table = joined.select("run", *layout, F.array_join(absent, ",").alias("missing_sources"))
    compared = compare.versus_reference(compare.with_throughput(table, _hours(hours)), reference_ip)
    return compared.select("run", *FLEET_COLUMNS, *DERIVED, "missing_sources").orderBy("run", "ip")


def older_report(
    servers: DataFrame, config: DataFrame, perf: DataFrame, power: DataFrame, utilisation: DataFrame,
    hours: int | None = None, *, reference_ip: str,
) -> DataFrame:
    """The older form of the report: 30 columns, vcores and cpu shares from a utilisation table by server."""
    used = utilisation.select("ip", *[F.col(c).alias(f"avg_{c}") for c in ("vcore", "user", "sys", "idle")])
    none = {c: F.lit(None).cast("double") for c in ("ctn", "yarn_cpu_used", "yarn_mem_used")}
    util = servers.select(*KEYS).join(used, "ip").withColumns({**none, "has_util": F.lit(True)})
    report = fleet_report(servers, config, perf, power, util.withColumn("has_yarn", F.lit(True)), hours=hours, reference_ip=reference_ip)
    named = F.regexp_replace("missing_sources", ",?yarn", "")  # this form has no such input
    filled = compare.with_utilisation(report, utilisation).withColumn("missing_sources", named)
    return filled.select("run", *FLEET_COLUMNS_SHORT, *DERIVED, "missing_sources").orderBy("run", "ip")


def quick_view(report: DataFrame) -> DataFrame:
    """The console form of the report: short labels, rounded figures, target flags."""
    return compare.with_target_flags(report).select(
        "run",
        tx.short_ip(F.col("ip")).alias("server"),
        F.concat_ws("/", "smt", "vcore", F.left("freq", F.lit(4))).alias("smt_vcore_freq"),
        "mr_nbr", F.round("mr_time").cast("bigint").alias("mr_time"), "mr_time_ok",
        "sql_nbr", F.round("sql_time").cast("bigint").alias("sql_time"), "sql_time_ok",
        "tput", "tput_ok",
        F.concat(F.round("tput_vs_ref", 2).cast("string"), F.lit("x")).alias("tput_vs_ref"),
        F.round("tput_per_wh", 2).alias("tput_per_wh"),
        F.concat(F.round("per_wh_vs_ref", 2).cast("string"), F.lit("x")).alias("per_wh_vs_ref"),
        F.col("max_w").cast("bigint").alias("max_w"),
        F.col("actual_vcore").cast("bigint").alias("actual_vcore"),
        *[F.concat((F.col(c).cast("decimal(9,4)") * 100).cast("decimal(9,2)").cast("string"), F.lit("%")).alias(c) for c in ("user_share", "sys_share", "idle_share")],
        F.concat_ws("/", "containers", "cpu_used").alias("containers_cpu"),
        "mem_used_gb",
        F.right("jdk", F.lit(16)).alias("jdk"),
    )


def jvm_pool_report(pool: DataFrame, config: DataFrame) -> DataFrame:
    """JVM-pool figures per server with reuse ratios and the JDK path."""
    ratio = lambda name: cx.reuse_ratio(F.col(f"{name}_reuse"), F.col(f"{name}_new")).alias(f"{name}_ratio")
    jdk = config.select(*KEYS, F.right("java_home", F.lit(16)).alias("jdk"))
    return (
        pool.join(jdk, KEYS, "left")
        .select(
            "run", "ip", "all_crash", "task_crash", "failed_container", "gc_limit",
            "mr_reuse", "mr_new", ratio("mr"), "mr_fallback",
            "sql_reuse", "sql_new", ratio("sql"), "sql_fallback", "conventional", "jdk",
        )
        .orderBy("run", "ip")
    )


def jvm_pool_counts(pool: DataFrame) -> DataFrame:
    """The same figures in the order reuse, fallback, new, without ratios."""
    return pool.select(
        "run", "ip", "all_crash", "task_crash", "failed_container", "gc_limit",
        "mr_reuse", "mr_fallback", "mr_new", "sql_reuse", "sql_fallback", "sql_new", "conventional",
    )


def minute_series(samples: DataFrame, metric: str | None = None) -> DataFrame:
    """Per-minute series by server, for one metric or for all; each series lies in order in one partition."""
    dated = rollup.with_date_parts(samples)
    series = (
        rollup.all_metric_series(dated, "run", "ip", "ts")
        if metric is None
        else rollup.metric_series(dated, metric, "run", "ip", "ts")
    )
    return series.repartition("run", "ip").sortWithinPartitions("run", "ip", "ts")


def _config(spark: SparkSession, base: str, files: Mapping[str, str]) -> DataFrame:
    return summary.config_blocks(ln.read_lines(spark, f"{base}/{files['config']}", optional=True))


def fleet_report_from_runs(
    spark: SparkSession,
    runs: str,
    hours: int | None = None,
    *,
    reference_ip: str,
    keep_last: bool = False,
    files: Mapping[str, str] = FILES,
) -> DataFrame:
    """The fleet report of all run folders that match ``runs`` (a path or glob); each dump is read once."""
    base = runs.rstrip("/")
    server = f"{base}/*tdw*"
    dumps = ln.read_lines(spark, f"{server}/{files['dump']}")
    perf = summary.perf_summary(ln.read_lines(spark, f"{server}/{files['perf']}", optional=True))
    power = summary.power_stats(ln.read_lines(spark, f"{server}/{files['power']}", optional=True))
    return fleet_report(
        ln.hosts(spark, f"{server}/*"),
        one_per_server(_config(spark, base, files)),
        one_per_server(perf),
        one_per_server(power),
        monitor.server_means(dumps, keep_last),
        hours=hours,
        reference_ip=reference_ip,
    )


def older_report_from_runs(
    spark: SparkSession, runs: str, utilisation: str, hours: int | None = None, *, reference_ip: str,
    files: Mapping[str, str] = FILES,
) -> DataFrame:
    """The older report from run folders (fixed-length configuration, summaries with spread) and a utilisation file."""
    base = runs.rstrip("/")
    server = f"{base}/*tdw*"
    lines = lambda path: ln.read_lines(spark, path, optional=True)
    return older_report(
        ln.hosts(spark, f"{server}/*"),
        one_per_server(summary.config_fixed(lines(f"{base}/{files['config']}"))),
        one_per_server(summary.perf_spread(lines(f"{server}/{files['perf']}"))),
        one_per_server(summary.power_stats(lines(f"{server}/{files['power']}"))),
        tables.utilisation(spark, utilisation), hours, reference_ip=reference_ip,
    )


def recalculation_from_runs(spark: SparkSession, runs: str, path: str, apps: str = "mr_appinfo*") -> DataFrame:
    """Recalculation rows of all run folders, kept in a table that grows: a run is added once.

    Servers without such a log are skipped (see ``sources_audit``). Returns the rows of all runs added so far.
    """
    found = ln.with_server(ln.list_files(spark, f"{runs.rstrip('/')}/*tdw*/{apps}", optional=True))
    if not commits.commits(spark, path).isEmpty():
        found = found.join(commits.read(spark, path).select("run").distinct(), "run", "left_anti")
    files = sorted(r.file for r in found.select("file").collect())
    if files:
        commits.append_new(recalc.recalculation_rows(tables.app_info(spark, files), "run"), path, ["run"])
    return commits.read(spark, path).drop("run")


def jvm_pool_report_from_runs(
    spark: SparkSession, runs: str, files: Mapping[str, str] = FILES
) -> DataFrame:
    """The JVM-pool report; servers without such a log are skipped."""
    base = runs.rstrip("/")
    pool = summary.jvm_pool(ln.read_lines(spark, f"{base}/*tdw*/{files['pool']}", optional=True))
    return jvm_pool_report(one_per_server(pool), one_per_server(_config(spark, base, files)))


def sample_table_from_runs(
    spark: SparkSession, runs: str, keep_last: bool = False, dump: str = FILES["dump"]
) -> DataFrame:
    """Samples of all monitor dumps below the run folders."""
    return monitor.sample_blocks(ln.read_lines(spark, f"{runs.rstrip('/')}/*tdw*/{dump}"), keep_last)


def sources_audit(
    spark: SparkSession, runs: str, patterns: Sequence[str], everything: str = "*"
) -> DataFrame:
    """Servers that lack files of a kind: run, host, ip, pattern."""
    base = f"{runs.rstrip('/')}/*tdw*"
    servers = ln.hosts(spark, f"{base}/{everything}")
    audits = []
    for pattern in patterns:
        files = ln.with_server(ln.list_files(spark, f"{base}/{pattern}", optional=True))
        audits.append(compare.missing_sources(servers, files).withColumn("pattern", F.lit(pattern)))
    return rollup.union_all(audits)
