"""The given tables as telemetry: samples, tasks, applications, throughput, power, log lines.

Each frame has a twin in SQL (``*_SQL``) that computes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackmeter.schemas import CPU_COLUMNS

# The server the others are compared with; only one of the two runs has it.
REFERENCE = "10.0.0.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def server_ip(key: Column) -> Column:
    return F.concat_ws(".", F.lit("10.0"), F.floor(key / 256), key % 256)


def server_host(key: Column) -> Column:
    return F.concat(F.lit("tdw-"), F.translate(server_ip(key), ".", "-"))


def server_run(key: Column) -> Column:
    """Servers are measured in two runs, even and odd ones."""
    return F.concat(F.lit("010"), key % 2 + 1, F.lit("-24H"))


def run_sql(key: str) -> str:
    return f"('010' || ({key} % 2 + 1) || '-24H')"


def ip_sql(key: str) -> str:
    return f"('10.0.' || ({key} // 256) || '.' || ({key} % 256))"


def host_sql(key: str) -> str:
    return f"('tdw-10-0-' || ({key} // 256) || '-' || ({key} % 256))"


# --- samples: one row per event -------------------------------------------------------------

def samples(spark: SparkSession, sf_dir: str, two_runs: bool = False) -> DataFrame:
    """One monitor sample per event, with run, host, ip and date text.

    A run is a day, or with ``two_runs`` all days of the even or of the odd servers, which gives each server one folder.
    """
    e = table(spark, sf_dir, "events")
    user, event, ts = F.col("user_id"), F.col("event_id"), F.col("ts")
    cents = lambda n: n.cast("double") / 100
    return e.select(
        event, ts,
        (server_run(user) if two_runs else F.concat(F.date_format(ts, "MMdd"), F.lit("-24H"))).alias("run"),
        server_host(user).alias("host"),
        server_ip(user).alias("ip"),
        F.date_format(ts, "EEE MMM dd HH:mm:ss 'CST' yyyy").alias("date"),
        F.hour(ts).alias("hour"),
        cents(event * 37 % 10000).alias("cpu_user"),
        cents(event % 7).alias("cpu_nice"),
        cents(event * 13 % 2500).alias("cpu_sys"),
        cents(user % 90).alias("cpu_io"),
        F.lit(0.0).alias("cpu_steal"),
        F.when(event % 101 == 0, F.lit(100.0)).otherwise(F.get_json_object("props", "$.k").cast("double")).alias("cpu_idle"),
        (event % 29).alias("ctn"),
        F.round(F.col("value") * 100).cast("bigint").alias("yarn_mem_used"),
        F.lit(262144).cast("bigint").alias("yarn_mem_all"),
        (event % 67).alias("yarn_cpu_used"),
        F.lit(66).cast("bigint").alias("yarn_cpu_all"),
        F.lit(512000).cast("bigint").alias("mem_total"),
        (event * 17 % 512000).alias("mem_used"),
        (512000 - event * 17 % 512000).alias("mem_free"),
        (user % 50).alias("mem_share"),
        (event % 1000).alias("mem_cache"),
        (event % 300000).alias("mem_avail"),
        F.lit(16000).cast("bigint").alias("swap_total"),
        (event % 160).alias("swap_used"),
        (16000 - event % 160).alias("swap_free"),
    )


SAMPLES_SQL = f"""
  select event_id, ts, strftime(ts, '%m%d') || '-24H' as run,
    {host_sql('user_id')} as host, {ip_sql('user_id')} as ip,
    strftime(ts, '%a %b %d %H:%M:%S CST %Y') as date, cast(extract(hour from ts) as int) as hour,
    cast(event_id * 37 % 10000 as double) / 100 as cpu_user,
    cast(event_id % 7 as double) / 100 as cpu_nice,
    cast(event_id * 13 % 2500 as double) / 100 as cpu_sys,
    cast(user_id % 90 as double) / 100 as cpu_io,
    cast(0 as double) as cpu_steal,
    case when event_id % 101 = 0 then 100.0 else cast(json_extract_string(props, '$.k') as double) end as cpu_idle,
    event_id % 29 as ctn,
    cast(round(value * 100) as bigint) as yarn_mem_used,
    cast(262144 as bigint) as yarn_mem_all,
    event_id % 67 as yarn_cpu_used,
    cast(66 as bigint) as yarn_cpu_all,
    cast(512000 as bigint) as mem_total,
    event_id * 17 % 512000 as mem_used,
    512000 - event_id * 17 % 512000 as mem_free,
    user_id % 50 as mem_share,
    event_id % 1000 as mem_cache,
    event_id % 300000 as mem_avail,
    cast(16000 as bigint) as swap_total,
    event_id % 160 as swap_used,
    16000 - event_id % 160 as swap_free
  from events"""


TWO_RUNS_SQL = f"""
  select * exclude (user_id), {run_sql('user_id')} as run from (
    select s.* exclude (run), e.user_id from ({SAMPLES_SQL}) s
    join (select event_id, user_id from events) e using (event_id))"""


def with_samples(body: str, two_runs: bool = False) -> str:
    return f"with samples as ({TWO_RUNS_SQL if two_runs else SAMPLES_SQL})\n{body}"


def mean_sql(column: str, digits: int = 9) -> str:
    return f"round(avg({column}), {digits})"


def sum_sql(column: str, digits: int = 2) -> str:
    return f"round(sum({column}), {digits})"


# --- tasks: one row per line item -------------------------------------------------------------

TASK_TIES = ["job", "attempt", "l_partkey", "l_suppkey", "l_extendedprice"]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task attempt per line item; durations spread over all bins."""
    n = F.col("l_linenumber").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job"), n.alias("attempt"), "l_partkey", "l_suppkey",
        "l_extendedprice", "l_shipdate",
        (F.col("l_quantity").cast("bigint") * n * n * n).alias("duration"),
    )


TASKS_SQL = """
  select l_orderkey as job, cast(l_linenumber as bigint) as attempt, l_partkey, l_suppkey,
    l_extendedprice, l_shipdate,
    cast(l_quantity as bigint) * l_linenumber * l_linenumber * l_linenumber as duration
  from lineitem"""


def with_tasks(body: str) -> str:
    return f"with tasks as ({TASKS_SQL})\n{body}"


def attempt_id(job: Column, attempt: Column) -> Column:
    return F.concat(F.lit("attempt_1700000000001_"), job, F.lit("_r_"), F.lpad(attempt.cast("string"), 6, "0"), F.lit("_0"))


ATTEMPT_SQL = "'attempt_1700000000001_' || job || '_r_' || lpad(cast(attempt as varchar), 6, '0') || '_0'"


# --- applications: one row per order ------------------------------------------------------------

def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per order, on a server per nation."""
    n = F.col("l_linenumber").cast("bigint")
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("executors"),
        F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("tasks"),
        F.sum(F.col("l_quantity").cast("bigint") * n * n * n).alias("duration2"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            server_run(F.col("c_nationkey")).alias("run"), server_host(F.col("c_nationkey")).alias("host"),
            F.col("o_orderkey").alias("app"), "executors", "tasks", "duration2",
        )
    )


APPS_SQL = f"""
  select {run_sql('c_nationkey')} as run, {host_sql('c_nationkey')} as host, o_orderkey as app, count(*) as executors,
    count(case when l_returnflag <> 'R' then 1 end) as tasks,
    cast(sum(cast(l_quantity as bigint) * l_linenumber * l_linenumber * l_linenumber) as bigint) as duration2
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  group by 1, 2, 3"""


def with_apps(body: str) -> str:
    return f"with apps as ({APPS_SQL})\n{body}"


# --- throughput, power and configuration: one row per supplier ----------------------------------

FRAMEWORKS = {"mr": "R", "sql": "A", "scala": "N"}


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task counts and mean times per framework and server."""
    flag = lambda f: F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("bigint"))
    aggs = []
    for name, f in FRAMEWORKS.items():
        aggs += [
            F.count(flag(f)).alias(f"{name}_nbr"),
            F.coalesce(F.try_divide(F.sum(flag(f)).cast("double"), F.count(flag(f))), F.lit(0.0)).alias(f"{name}_time"),
        ]
    return (
        table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*aggs)
        .select(server_run(F.col("l_suppkey")).alias("run"), server_ip(F.col("l_suppkey")).alias("ip"), "l_suppkey",
                *[f"{n}_{k}" for n in FRAMEWORKS for k in ("nbr", "time")])
    )


def _framework_sql(name: str, f: str) -> str:
    hit = f"case when l_returnflag = '{f}' then cast(l_quantity as bigint) end"
    return (
        f"count({hit}) as {name}_nbr, "
        f"coalesce(cast(sum({hit}) as double) / nullif(count({hit}), 0), 0) as {name}_time"
    )


PERF_SQL = f"""
  select {run_sql('l_suppkey')} as run, {ip_sql('l_suppkey')} as ip, l_suppkey,
    {', '.join(_framework_sql(n, f) for n, f in FRAMEWORKS.items())}
  from lineitem group by l_suppkey"""


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power figures per server; the spread is derived from the range."""
    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
        .agg(
            (F.sum(F.rint(price * 100).cast("bigint")).cast("double") / 100 / F.count(price)).alias("avg_w"),
            F.max(price).alias("max_w"), F.min(price).alias("min_w"),
        )
        .select(server_run(F.col("l_suppkey")).alias("run"), server_ip(F.col("l_suppkey")).alias("ip"), "l_suppkey",
                "avg_w", "max_w", "min_w", ((F.col("max_w") - F.col("min_w")) / 4).alias("stdev_w"))
    )


POWER_SQL = f"""
  select {run_sql('l_suppkey')} as run, {ip_sql('l_suppkey')} as ip, l_suppkey, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100 / count(*) as avg_w,
    max(l_extendedprice) as max_w, min(l_extendedprice) as min_w,
    (max(l_extendedprice) - min(l_extendedprice)) / 4 as stdev_w
  from lineitem group by l_suppkey"""


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration per server; the JDK path names the nation."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("s_suppkey")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        server_run(key).alias("run"), server_host(key).alias("host"), server_ip(key).alias("ip"), key,
        (key % 3 * 4).cast("string").alias("smt"), (60 + key % 10).cast("string").alias("vcore"),
        F.concat(F.lit("3."), key % 10, F.lit("00GHz")).alias("freq"),
        F.concat(F.lit("1."), key % 9).alias("jdk"),
        F.concat(F.lit("/opt/jdk/openjdk-"), F.col("n_name")).alias("java_home"),
    )


CONFIG_SQL = f"""
  select {run_sql('s_suppkey')} as run, {host_sql('s_suppkey')} as host, {ip_sql('s_suppkey')} as ip, s_suppkey,
    cast(s_suppkey % 3 * 4 as varchar) as smt, cast(60 + s_suppkey % 10 as varchar) as vcore,
    '3.' || (s_suppkey % 10) || '00GHz' as freq, '1.' || (s_suppkey % 9) as jdk,
    '/opt/jdk/openjdk-' || n_name as java_home
  from supplier join nation on s_nationkey = n_nationkey"""


def jvm_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JVM-pool counters per server from order states and line flags of its parts."""
    hit = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    return (
        table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
        .agg(
            hit("l_linenumber", 1).alias("all_crash"), hit("l_linenumber", 2).alias("task_crash"),
            hit("l_linenumber", 3).alias("failed_container"), hit("l_linenumber", 4).alias("gc_limit"),
            hit("l_returnflag", "R").alias("mr_reuse"), hit("l_returnflag", "A").alias("sql_reuse"),
            hit("l_linestatus", "O").alias("mr_fallback"), hit("l_linestatus", "F").alias("sql_fallback"),
            hit("l_quantity", 1.0).alias("mr_new"), hit("l_quantity", 2.0).alias("sql_new"),
            F.count("*").alias("conventional"),
        )
        .select(server_run(F.col("l_suppkey")).alias("run"), server_ip(F.col("l_suppkey")).alias("ip"), "l_suppkey",
                "all_crash", "task_crash", "failed_container", "gc_limit", "mr_reuse", "sql_reuse",
                "mr_fallback", "sql_fallback", "mr_new", "sql_new", "conventional")
    )


JVM_POOL_SQL = f"""
  select {run_sql('l_suppkey')} as run, {ip_sql('l_suppkey')} as ip, l_suppkey,
    count(*) filter (where l_linenumber = 1) as all_crash,
    count(*) filter (where l_linenumber = 2) as task_crash,
    count(*) filter (where l_linenumber = 3) as failed_container,
    count(*) filter (where l_linenumber = 4) as gc_limit,
    count(*) filter (where l_returnflag = 'R') as mr_reuse,
    count(*) filter (where l_returnflag = 'A') as sql_reuse,
    count(*) filter (where l_linestatus = 'O') as mr_fallback,
    count(*) filter (where l_linestatus = 'F') as sql_fallback,
    count(*) filter (where l_quantity = 1) as mr_new,
    count(*) filter (where l_quantity = 2) as sql_new,
    count(*) as conventional
  from lineitem group by l_suppkey"""

SERVER_SQL = {
    "samples": SAMPLES_SQL, "tasks": TASKS_SQL, "apps": APPS_SQL, "perf": PERF_SQL,
    "power": POWER_SQL, "config": CONFIG_SQL, "pool": JVM_POOL_SQL,
}


def with_tables(names: Sequence[str], body: str) -> str:
    ctes = ",\n".join(f"{n} as ({SERVER_SQL[n]})" for n in names)
    return f"with {ctes}\n{body}"


# --- log lines: files rendered row by row ---------------------------------------------------------

def to_lines(
    df: DataFrame, file: Column, key: Column, texts: Sequence[Column], carry: Sequence[str] = ()
) -> DataFrame:
    """Each row becomes some lines of a file, placed by an ascending key; NULL texts are skipped.

    No rows are gathered: a line carries its own place, ``key * 32 + n``. Columns in ``carry`` are
    repeated on each line.
    """
    exploded = df.select(
        file.alias("file"), key.alias("_key"), *carry, F.posexplode(F.array(*texts)).alias("_n", "line")
    ).where(F.col("line").isNotNull())
    place = (F.col("_key") * 32 + F.col("_n")).alias("pos")
    return exploded.select("file", F.lit(0).cast("bigint").alias("split"), place, "line", *carry)


def dump_file() -> Column:
    return F.concat(F.lit("/logs/"), F.col("run"), F.lit("/"), F.col("host"), F.lit("/sdr_log_"), F.col("host"), F.lit("_24H"))


def dump_texts() -> list[Column]:
    """A sample as the lines of a monitor dump."""
    col = F.col
    return [
        F.concat(F.lit("== "), col("date"), F.lit(" ==")),
        F.lit("avg-cpu:  %user   %nice %system %iowait  %steal   %idle"),
        F.concat(F.lit(" "), F.format_string("%9.2f %7.2f %7.2f %7.2f %7.2f %7.2f", *CPU_COLUMNS)),
        F.lit(""),
        F.concat(col("date"), F.lit(" now MR "), _pairs()),
        F.format_string("a b c d e f g Total Power %d", col("yarn_mem_used") + 800),
        F.lit("mr_sparksql_scala_container_count"),
        F.concat(F.lit("0 1 2 3 4 5 6 7 "), _pairs()),
        F.format_string("Containers : %d", col("ctn")),
        F.format_string("Memory-Used : %dMB", col("yarn_mem_used")),
        F.format_string("Memory-Capacity : %dMB", col("yarn_mem_all")),
        F.format_string("CPU-Used : %d vcores", col("yarn_cpu_used")),
        F.format_string("CPU-Capacity : %d vcores", col("yarn_cpu_all")),
        F.format_string("Mem: %8d %8d %8d %8d %8d %8d", "mem_total", "mem_used", "mem_free", "mem_share", "mem_cache", "mem_avail"),
        F.format_string("Swap: %8d %8d %8d", "swap_total", "swap_used", "swap_free"),
    ]


def _pairs() -> Column:
    return F.format_string(
        "%d/60 SQL %d/50 SCALA %d/40", F.col("event_id") % 60, F.col("event_id") % 50, F.col("event_id") % 40
    )


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples as monitor dumps, one file per run and server; rendered by all tasks, though the table is one file."""
    return to_lines(samples(spark, sf_dir).hint("rebalance"), dump_file(), F.col("event_id"), dump_texts())


def server_file(name: str) -> Column:
    return F.concat(F.lit("/logs/"), F.col("run"), F.lit("/tdw-"), F.translate("ip", ".", "-"), F.lit(f"/{name}"))


def run_file(name: str) -> Column:
    return F.concat(F.lit("/logs/"), F.col("run"), F.lit(f"/{name}"))
