"""Column lists and schemas of the inputs and outputs."""

from __future__ import annotations

# One line of a text log: the range of the file it was read in, the bytes at which it and the next line start.
LINE_SCHEMA = "file STRING, split BIGINT, pos BIGINT, next BIGINT, line STRING"

# Column names of the monitor sample table, in file order.
CPU_COLUMNS = ["cpu_user", "cpu_nice", "cpu_sys", "cpu_io", "cpu_steal", "cpu_idle"]
YARN_COLUMNS = ["ctn", "yarn_mem_used", "yarn_mem_all", "yarn_cpu_used", "yarn_cpu_all"]
MEM_COLUMNS = ["mem_total", "mem_used", "mem_free", "mem_share", "mem_cache", "mem_avail"]
SWAP_COLUMNS = ["swap_total", "swap_used", "swap_free"]
SAMPLE_METRICS = CPU_COLUMNS + YARN_COLUMNS + MEM_COLUMNS + SWAP_COLUMNS
SAMPLE_COLUMNS = ["date", "ip", "hour"] + SAMPLE_METRICS

# The container count is headed ``ctn#`` in the CSV form of the sample table.
CSV_NAMES = {"ctn": "ctn#"}

SAMPLE_SCHEMA = (
    "date STRING, ip STRING, hour INT, "
    + ", ".join(f"{c} DOUBLE" for c in CPU_COLUMNS)
    + ", "
    + ", ".join(f"`{c}` BIGINT" for c in YARN_COLUMNS + MEM_COLUMNS + SWAP_COLUMNS)
)

TASK_SCHEMA = "tid STRING, starttime TIMESTAMP_NTZ, endtime TIMESTAMP_NTZ, duration BIGINT"
UTIL_SCHEMA = "ip STRING, vcore DOUBLE, user DOUBLE, sys DOUBLE, idle DOUBLE"
APP_COLUMNS = ["executors", "tasks", "duration2", "avgtask"]
TRAFFIC_COLUMNS = ["ip", "Date", "Mon", "net_received", "net_transferred"]

# Cells of the JVM-pool log, in file order.
JVM_POOL_COLUMNS = [
    "ip", "all_crash", "task_crash", "failed_container", "gc_limit", "mr_reuse",
    "sql_reuse", "mr_fallback", "sql_fallback", "mr_new", "sql_new", "conventional",
]

# The report layout; names ending in _blank are kept free in the report.
FLEET_COLUMNS = [
    "ip", "cpu_core_blank", "pnor_blank", "bmc_blank", "os_blank", "jdk", "compiler_blank",
    "start_blank", "end_blank", "smt", "vcore", "freq", "power_cap_blank", "mr_nbr", "mr_time",
    "spark_nbr_blank", "spark_time_blank", "sql_nbr", "sql_time", "scala_nbr", "scala_time",
    "avg_w", "max_w", "min_w", "stdev_w", "topops_blank", "actual_vcore", "user_share",
    "sys_share", "idle_share", "experiment_blank", "containers", "cpu_used", "mem_used_gb",
    "last_blank",
]
# The older form of the report ends before the experiment column.
FLEET_COLUMNS_SHORT = FLEET_COLUMNS[:30]

# Bin edges of the task-duration distribution, in seconds.
DURATION_EDGES = [
    0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 300, 600, 1800, 3600, 7200, 14400, 144000,
]

# Report targets.
MR_TIME_TARGET = 62
SQL_TIME_TARGET = 39
THROUGHPUT_TARGET = 80000
