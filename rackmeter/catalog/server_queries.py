"""Queries on servers: throughput, comparison with a reference, complete reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackmeter.catalog import bindings as b
from rackmeter.functions import columns as cx
from rackmeter.functions import text as tx
from rackmeter.operators import compare, rollup
from rackmeter.plans import fleet
from rackmeter.schemas import FLEET_COLUMNS, FLEET_COLUMNS_SHORT
from rackmeter.sinks import writers

HOURS = 24


def _servers(spark, sf_dir):
    keys = ["run", "ip", "l_suppkey"]
    return b.perf(spark, sf_dir).join(b.power(spark, sf_dir), keys)


def _throughput(spark, sf_dir):
    return compare.with_throughput(_servers(spark, sf_dir), F.lit(HOURS))


def prj_throughput(spark, sf_dir):
    return _throughput(spark, sf_dir).select("ip", "mr_nbr", "sql_nbr", "max_w", "tput", "tput_per_wh")


def jon_vs_reference(spark, sf_dir):
    compared = compare.versus_reference(_throughput(spark, sf_dir), b.REFERENCE)
    return compared.select("run", "ip", "tput", "tput_per_wh", "tput_vs_ref", "per_wh_vs_ref")


def prj_target_flags(spark, sf_dir):
    flagged = compare.with_target_flags(_throughput(spark, sf_dir))
    flags = [F.col(c).cast("int").alias(c) for c in ("mr_time_ok", "sql_time_ok", "tput_ok")]
    return flagged.select("ip", "mr_time", "sql_time", "tput", *flags)


def prj_default_zero(spark, sf_dir):
    # A count as text that is empty for every third order and unreadable for every seventh.
    text = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(
        F.col("o_custkey").cast("string")
    )
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey", cx.default_zero(text, "bigint").alias("n"), cx.default_zero(text).alias("x")
    )


def prj_short_labels(spark, sf_dir):
    return b.config(spark, sf_dir).select(
        "ip", tx.short_ip(F.col("ip")).alias("server"), F.left("freq", F.lit(4)).alias("freq"),
        F.right("java_home", F.lit(16)).alias("jdk"), F.right("java_home", F.lit(20)).alias("jdk_long"),
    )


def prj_reuse_ratio(spark, sf_dir):
    ratio = lambda n: cx.reuse_ratio(F.col(f"{n}_reuse"), F.col(f"{n}_new")).alias(f"{n}_ratio")
    return b.jvm_pool(spark, sf_dir).select("ip", ratio("mr"), ratio("sql"))


def jon_util_tsv(spark, sf_dir):
    used = b.samples(spark, sf_dir).groupBy("ip").agg(
        F.avg("yarn_cpu_used").alias("vcore"),
        *[F.avg(f"cpu_{c}").alias(c) for c in ("user", "sys", "idle")],
    )
    joined = compare.with_utilisation(b.perf(spark, sf_dir).drop("run", "l_suppkey"), used)
    return joined.withColumns({c: F.round(c, 9) for c in ("user_share", "sys_share", "idle_share")})


def _util(spark, sf_dir):
    """Means of all samples per server."""
    samples = b.samples(spark, sf_dir)
    samples = samples.withColumn("run", b.server_run(F.substring_index("ip", ".", -1).cast("int")))
    counted = samples.withColumn(
        "vcore_total", F.col("event_id") % 60 + F.col("event_id") % 50 + F.col("event_id") % 40
    )
    return fleet.utilisation_means(samples, counted), rollup.host_means(samples)


def _fleet(spark, sf_dir):
    config = b.config(spark, sf_dir)
    util, yarn = _util(spark, sf_dir)
    return fleet.fleet_report(
        config.select("run", "ip"), config.drop("s_suppkey", "host"),
        b.perf(spark, sf_dir).drop("l_suppkey"), b.power(spark, sf_dir).drop("l_suppkey"),
        util, yarn, HOURS, reference_ip=b.REFERENCE,
    )


def rep_fleet(spark, sf_dir):
    return _fleet(spark, sf_dir)


def rep_fleet_quick_view(spark, sf_dir):
    return fleet.quick_view(_fleet(spark, sf_dir))


def rep_jvm_pool(spark, sf_dir):
    return fleet.jvm_pool_report(b.jvm_pool(spark, sf_dir), b.config(spark, sf_dir))


def prj_jvm_pool_counts(spark, sf_dir):
    """The JVM-pool figures in the order of the older view."""
    return fleet.jvm_pool_counts(b.jvm_pool(spark, sf_dir))


def snk_flat_line(spark, sf_dir):
    """Lines of the full and of the older layout."""
    report = _fleet(spark, sf_dir)
    return writers.flat_lines(report).unionAll(writers.flat_lines(report, FLEET_COLUMNS_SHORT))


QUERIES = {
    f.__name__: f
    for f in [
        prj_throughput, jon_vs_reference, prj_target_flags, prj_default_zero, prj_short_labels,
        prj_reuse_ratio, jon_util_tsv, rep_fleet, rep_fleet_quick_view, rep_jvm_pool, prj_jvm_pool_counts, snk_flat_line,
    ]
}

_TPUT = f"""
  servers as (select perf.run, perf.ip, mr_nbr, mr_time, sql_nbr, sql_time, max_w, mr_nbr + sql_nbr as tput,
    coalesce(cast(mr_nbr + sql_nbr as double) / nullif(max_w, 0) / {HOURS}, 0) as tput_per_wh
    from perf join power using (l_suppkey)),
  ref as (select run, tput as ref_tput, tput_per_wh as ref_wh from servers where ip = '{b.REFERENCE}')"""
_REF = """coalesce(cast(tput as double) / nullif(ref_tput, 0), 0) as tput_vs_ref,
    coalesce(tput_per_wh / nullif(ref_wh, 0), 0) as per_wh_vs_ref"""


def _with_servers(body: str) -> str:
    return f"with perf as ({b.PERF_SQL}), power as ({b.POWER_SQL}), {_TPUT} {body}"


_blank = ", ".join(f"cast(null as varchar) as {c}" for c in FLEET_COLUMNS if c.endswith("_blank"))
_vcore = "event_id % 60 + event_id % 50 + event_id % 40"
_frac = lambda c: f"cast(cast(round(cast({c} as decimal(18,6)) * 100) as bigint) as double) / 10000"
_fleet_sql = lambda samples, servers: f"""
  with samples as ({samples}), perf as ({b.PERF_SQL}), power as ({b.POWER_SQL}), config as ({b.CONFIG_SQL}),
  util as (select ip, avg(cpu_user) as avg_user, avg(cpu_sys) as avg_sys, avg(cpu_idle) as avg_idle, cast(sum({_vcore}) as double) / count(*) as avg_vcore,
    avg(ctn) as ctn, avg(yarn_cpu_used) as cpu_used, avg(yarn_mem_used) as mem_used from samples group by ip),
  servers as ({servers}),
  filled as (select servers.run, servers.ip, java_home as jdk, cast(smt as bigint) as smt, cast(vcore as bigint) as vcore,
    freq, coalesce(mr_nbr, 0) as mr_nbr, coalesce(mr_time, 0) as mr_time, coalesce(sql_nbr, 0) as sql_nbr,
    coalesce(sql_time, 0) as sql_time, coalesce(scala_nbr, 0) as scala_nbr, coalesce(scala_time, 0) as scala_time,
    coalesce(avg_w, 0) as avg_w, coalesce(max_w, 0) as max_w, coalesce(min_w, 0) as min_w,
    coalesce(stdev_w, 0) as stdev_w, round(avg_vcore) as actual_vcore, {_frac('avg_user')} as user_share,
    {_frac('avg_sys')} as sys_share, {_frac('avg_idle')} as idle_share, cast(round(ctn) as bigint) as containers,
    cast(round(cpu_used) as bigint) as cpu_used, cast(round(mem_used) as bigint) // 1000 as mem_used_gb, {_blank},
    concat_ws(',', case when config.ip is null then 'config' end, case when perf.ip is null then 'perf' end, case when power.ip is null then 'power' end,
      case when util.ip is null then 'util,yarn' end) as missing_sources
    from servers left join config on config.ip = servers.ip left join perf on perf.ip = servers.ip
      left join power on power.ip = servers.ip left join util on util.ip = servers.ip),
  rated as (select *, mr_nbr + sql_nbr as tput,
    coalesce(cast(mr_nbr + sql_nbr as double) / nullif(max_w, 0) / {HOURS}, 0) as tput_per_wh from filled),
  ref as (select run, tput as ref_tput, tput_per_wh as ref_wh from rated where ip = '{b.REFERENCE}'),
  fleet as (select rated.*, {_REF} from rated left join ref using (run))"""
_dropped = ", ".join(["actual_vcore", "user_share", "sys_share", "idle_share", "missing_sources", *FLEET_COLUMNS[30:]])
FLEET_OLDER_SQL = f"""{_fleet_sql(b.SAMPLES_SQL, "select run, ip from perf union select run, ip from power")},
  used as (select ip, round(round(avg(yarn_cpu_used), 6)) as actual_vcore, round(round(avg(cpu_user), 6) / 100, 9) as user_share,
    round(round(avg(cpu_sys), 6) / 100, 9) as sys_share, round(round(avg(cpu_idle), 6) / 100, 9) as idle_share from samples group by ip)
  select fleet.* exclude ({_dropped}), used.* exclude (ip), replace(missing_sources, 'util,yarn', 'util') as missing_sources
  from fleet left join used on used.ip = fleet.ip"""
_FLEET_SQL = _fleet_sql(b.SAMPLES_SQL, "select run, ip from config")
_percent = lambda c: f"cast(cast(cast({c} as decimal(9,4)) * 100 as decimal(9,2)) as varchar) || '%' as {c}"
# From folders, all servers that have one: with dumps, throughput or power figures, configured or not.
_folders = " union ".join(f"select run, ip from {kind}" for kind in ("samples", "perf", "power"))
FLEET_FILES_SQL = f"{_fleet_sql(b.TWO_RUNS_SQL, _folders)} select * from fleet"
_ratio = lambda n: (
    f"coalesce(round(cast({n}_reuse as decimal(18,4)) / nullif({n}_new, 0), 1), 0)"
)

_line = lambda names: " || ',' || ".join(f"coalesce(cast({c} as varchar), '')" for c in names) + " as line"

SQL = {
    "prj_throughput": _with_servers("select ip, mr_nbr, sql_nbr, max_w, tput, tput_per_wh from servers"),
    "jon_vs_reference": _with_servers(
        f"select run, ip, tput, tput_per_wh, {_REF} from servers left join ref using (run)"),
    "prj_target_flags": _with_servers("""
        select ip, mr_time, sql_time, tput, cast(round(mr_time) <= 62 as int) as mr_time_ok,
          cast(round(sql_time) <= 39 as int) as sql_time_ok, cast(tput >= 80000 as int) as tput_ok from servers"""),
    "prj_default_zero": """
        select o_orderkey, case when o_orderkey % 3 = 0 or o_orderkey % 7 = 0 then 0 else o_custkey end as n,
          cast(case when o_orderkey % 3 = 0 or o_orderkey % 7 = 0 then 0 else o_custkey end as double) as x
        from orders""",
    "prj_short_labels": b.with_tables(["config"], """
        select ip, split_part(ip, '.', 3) || '.' || split_part(ip, '.', 4) as server, left(freq, 4) as freq,
          right(java_home, 16) as jdk, right(java_home, 20) as jdk_long from config"""),
    "prj_reuse_ratio": b.with_tables(
        ["pool"], f"select ip, {_ratio('mr')} as mr_ratio, {_ratio('sql')} as sql_ratio from pool"),
    "jon_util_tsv": b.with_tables(["samples", "perf"], f"""
        , util as (select ip, round(avg(yarn_cpu_used)) as actual_vcore, round(avg(cpu_user) / 100, 9) as user_share,
          round(avg(cpu_sys) / 100, 9) as sys_share, round(avg(cpu_idle) / 100, 9) as idle_share
          from samples group by ip)
        select ip, mr_nbr, mr_time, sql_nbr, sql_time, scala_nbr, scala_time, actual_vcore, user_share, sys_share,
          idle_share from perf left join util using (ip)"""),
    "rep_fleet": f"{_FLEET_SQL} select * from fleet",
    "rep_fleet_quick_view": f"""{_FLEET_SQL}
        select run, split_part(ip, '.', 3) || '.' || split_part(ip, '.', 4) as server,
          smt || '/' || vcore || '/' || left(freq, 4) as smt_vcore_freq, mr_nbr,
          cast(round(mr_time) as bigint) as mr_time, sql_nbr, cast(round(sql_time) as bigint) as sql_time, tput,
          round(mr_time) <= 62 as mr_time_ok, round(sql_time) <= 39 as sql_time_ok,
          tput >= 80000 as tput_ok, round(tput_vs_ref, 2) || 'x' as tput_vs_ref,
          round(tput_per_wh, 2) as tput_per_wh, round(per_wh_vs_ref, 2) || 'x' as per_wh_vs_ref,
          {_percent('user_share')}, {_percent('sys_share')}, {_percent('idle_share')},
          cast(trunc(max_w) as bigint) as max_w, cast(actual_vcore as bigint) as actual_vcore,
          concat_ws('/', containers, cpu_used) as containers_cpu, mem_used_gb, right(jdk, 16) as jdk from fleet""",
    "rep_jvm_pool": b.with_tables(["pool", "config"], f"""
        select pool.run, ip, all_crash, task_crash, failed_container, gc_limit, mr_reuse, mr_new,
          {_ratio('mr')} as mr_ratio, mr_fallback, sql_reuse, sql_new, {_ratio('sql')} as sql_ratio, sql_fallback,
          conventional, right(java_home, 16) as jdk from pool left join config using (ip)"""),
    "prj_jvm_pool_counts": b.with_tables(["pool"], "select * exclude (l_suppkey) from pool"),
    "snk_flat_line": f"{_FLEET_SQL} select {_line(FLEET_COLUMNS)} from fleet union all select {_line(FLEET_COLUMNS_SHORT)} from fleet",
}
