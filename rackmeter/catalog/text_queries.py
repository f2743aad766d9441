"""Queries on log text: tables are rendered as log lines, and the readers must give them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackmeter.catalog import bindings as b
from rackmeter.functions import text as tx
from rackmeter.operators import distribution
from rackmeter.schemas import CPU_COLUMNS, MEM_COLUMNS, SWAP_COLUMNS, YARN_COLUMNS
from rackmeter.sources import lines as ln
from rackmeter.sources import monitor, summary, tables

COUNTS = monitor.COUNT_COLUMNS + ["vcore_total"]


def src_sample_blocks(spark, sf_dir):
    blocks = monitor.sample_blocks(b.dump_lines(spark, sf_dir), full=False)
    return blocks.select("run", "ip", "ts", *CPU_COLUMNS, *YARN_COLUMNS)


def src_sample_blocks_hour(spark, sf_dir):
    blocks = monitor.sample_blocks(b.dump_lines(spark, sf_dir), full=False)
    return blocks.select(F.left("run", F.lit(4)).alias("date"), "host", "hour", "ts", *CPU_COLUMNS, *YARN_COLUMNS)


def src_sample_blocks_full(spark, sf_dir):
    blocks = monitor.sample_blocks(b.dump_lines(spark, sf_dir), keep_last=True)
    return blocks.select(
        "run", "date", "ip", "hour", *CPU_COLUMNS, *YARN_COLUMNS, *MEM_COLUMNS, *SWAP_COLUMNS
    )


def src_cpu_rows(spark, sf_dir):
    return monitor.cpu_rows(b.dump_lines(spark, sf_dir)).select("run", "ip", *CPU_COLUMNS)


def src_vcore_rows(spark, sf_dir):
    return monitor.count_rows(b.dump_lines(spark, sf_dir)).select(
        F.floor(F.col("pos") / 32).alias("event_id"), "ip", *COUNTS
    )


def src_vcore_after_marker(spark, sf_dir):
    return monitor.count_rows_after_marker(b.dump_lines(spark, sf_dir)).select(
        F.floor(F.col("block_pos") / 32).alias("event_id"), "ip", *COUNTS
    )


def src_power_readings(spark, sf_dir):
    return monitor.power_readings(b.dump_lines(spark, sf_dir)).select(
        F.floor(F.col("pos") / 32).alias("event_id"), "ip", "watt"
    )


def win_top5_power(spark, sf_dir):
    """The five highest power readings of each server in its dumps, with their counts."""
    return distribution.highest_values(monitor.power_readings(b.dump_lines(spark, sf_dir)), "watt", 5)


def win_block_id(spark, sf_dir):
    numbered = ln.number_blocks(b.dump_lines(spark, sf_dir), monitor.is_header(F.col("line")))
    return numbered.select("file", "pos", "block", "n_blocks")


def win_drop_last(spark, sf_dir):
    numbered = ln.number_blocks(b.dump_lines(spark, sf_dir), monitor.is_header(F.col("line")))
    kept = numbered.where((F.col("block") > 0) & (F.col("block") < F.col("n_blocks")))
    return kept.groupBy("file").agg(F.count("*").alias("n_lines"), F.max("block").alias("last_block"))


def flt_line_class(spark, sf_dir):
    line = F.col("line")
    kind = (
        F.when(monitor.is_header(line), "header")
        .when(monitor.is_cpu_row(line), "cpu")
        .when(line.rlike("Containers|Memory-Used|Memory-Capacity|CPU-Used|CPU-Capacity"), "value")
        .when(line.rlike("Mem:|Swap:"), "memory")
        .when(~line.contains("avg-cpu") & ~line.contains("--") & (line != ""), "other")
    )
    classed = b.dump_lines(spark, sf_dir).select(kind.alias("kind")).where(F.col("kind").isNotNull())
    return classed.groupBy("kind").agg(F.count("*").alias("n"))


def config_lines(spark, sf_dir):
    """Configuration files of eleven lines per server behind three lines of preamble."""
    config = b.config(spark, sf_dir)
    file = b.run_file("2024-01-01.config.all.txt")
    col = F.col
    block = b.to_lines(
        config, file, col("s_suppkey") + 1,
        [
            F.concat(F.lit("===="), col("host"), F.lit("====")),
            F.concat(F.lit("SMT="), "smt"), F.concat(F.lit("vcore="), "vcore"),
            F.concat(F.lit("freq="), "freq"), F.concat(F.lit("jdk="), "jdk"),
            F.lit("x4"), F.lit("x5"), F.lit("x6"), F.lit("x7"),
            F.concat(F.lit("JAVA_HOME: "), "java_home"), F.lit("x9"),
        ],
    )
    first = config.where(col("s_suppkey") < 2)  # the first server of each run
    preamble = b.to_lines(first, file, F.lit(0), [F.lit("config dump"), F.lit("generated"), F.lit(".")])
    return preamble.unionByName(block)


def src_config_fixed(spark, sf_dir):
    return summary.config_fixed(config_lines(spark, sf_dir)).select("run", "ip", "smt", "vcore", "freq", "java_home")


def src_config_blocks(spark, sf_dir):
    # The keyed form recognises a block by a dotted address.
    dotted = config_lines(spark, sf_dir).withColumn(
        "line", F.when(F.col("line").startswith("===="), F.translate("line", "-", ".")).otherwise(F.col("line"))
    )
    return summary.config_blocks(dotted).select("run", "ip", "smt", "vcore", "freq", "jdk", "java_home")


def _perf_lines(spark, sf_dir):
    perf = b.perf(spark, sf_dir)
    # Every fourth server lists no sql tasks on the expected lines.
    other = F.col("l_suppkey") % 4 == 3
    count = lambda c, label: F.format_string(f"{label:<36}: %d", c)
    mean = lambda c: F.concat(F.lit("Average task duration by X w/ : "), F.col(c).cast("string"), F.lit(" secs"))
    spread = lambda c: F.concat(F.lit("Task duration standard variance : "), (F.col(c) * 2).cast("string"), F.lit(" secs"))
    texts = [F.lit("====host===="), F.lit("===Summary===")]
    for name, label in [("mr", "Total executors mr"), ("sql", "Total tasks"), ("scala", "Total tasks")]:
        number = count(f"{name}_nbr", label)
        if name == "sql":
            number = F.when(other, F.lit("No tasks: 0")).otherwise(number)
        texts += [number, mean(f"{name}_time"), spread(f"{name}_time")]
    texts += [F.lit("Total tasks : 99999"), F.lit("Average task duration : 1 secs")]
    return b.to_lines(perf, b.server_file("sum_cron.2024"), F.col("l_suppkey"), texts)


def src_perf_summary(spark, sf_dir):
    return summary.perf_summary(_perf_lines(spark, sf_dir)).drop("file")


def src_perf_spread(spark, sf_dir):
    return summary.perf_spread(_perf_lines(spark, sf_dir)).drop("file", "host")


def src_power_stats(spark, sf_dir):
    power = b.power(spark, sf_dir)
    row = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("avg_w", "max_w", "min_w", "stdev_w")])
    lines = b.to_lines(
        power, b.server_file("avg_max_min_stdev_2024_24H"), F.col("l_suppkey"),
        [F.lit("avg max min stdev"), row, F.lit("1 2 3 4")],
    )
    return summary.power_stats(lines).drop("file", "host")


def src_jvm_pool(spark, sf_dir):
    pool = b.jvm_pool(spark, sf_dir)
    cells = [c for c in pool.columns if c not in ("run", "ip", "l_suppkey")]
    # Every tenth server writes another header and is rejected.
    head = F.when(F.col("l_suppkey") % 10 == 9, "ip, crashes").otherwise(F.lit("ip, total_crash_cnt, ..."))
    row = F.concat_ws(", ", "ip", *[F.col(c).cast("string") for c in cells])
    lines = b.to_lines(pool, b.server_file("hottub_log_24H"), F.col("l_suppkey"), [head, row])
    return summary.jvm_pool(lines).select("run", "ip", *cells)


def src_matrix(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lineitem = b.table(spark, sf_dir, "lineitem")
    text = lineitem.select(
        F.lit("/m/rows").alias("file"), F.lit(0).alias("split"), F.lit(0).alias("pos"),
        F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("line"),
    )
    return tables.matrix(text, 4).select("c0", "c1", "c2", "c3")


def src_util_tsv(spark, sf_dir):
    text = b.samples(spark, sf_dir).select(
        F.concat_ws("\t", "ip", *[F.col(c).cast("string") for c in ("yarn_cpu_used", "cpu_user", "cpu_sys", "cpu_idle")]).alias("line")
    )
    return tables.utilisation_lines(text)


def flt_ip(spark, sf_dir):
    # Addresses around the valid range, in a line of text.
    key, text = F.col("o_orderkey"), F.col("text")
    made = b.table(spark, sf_dir, "orders").select(
        key, F.concat_ws(".", key % 300, key % 256, F.floor(key / 256), key % 7).alias("text")
    )
    return made.select(
        key, text, tx.ip_in(F.concat(F.lit("=="), text, F.lit("=="))).alias("found"),
        tx.ip_valid(text).cast("int").alias("valid"),
    )


def flt_run_name(spark, sf_dir):
    run = F.concat(F.col("o_orderkey") % 2500, F.lit("-24H"))
    made = b.table(spark, sf_dir, "orders").select("o_orderkey", run.alias("run"))
    return made.where(tx.run_name_valid(F.col("run")))


def prj_run_name(spark, sf_dir):
    key = F.col("o_orderkey")
    tail = F.when(key % 3 == 0, "").when(key % 3 == 1, "-td3").otherwise("-hto-x")
    made = b.table(spark, sf_dir, "orders").select(
        key, F.concat(F.date_format("o_orderdate", "MMdd"), F.lit("-24H"), tail).alias("run")
    )
    run = F.col("run")
    return made.select(
        key, tx.run_date(run).alias("date"), tx.run_hours(run).alias("hours"), tx.run_tag(run).alias("tag")
    )


def fn_text_pack(spark, sf_dir):
    name, key = F.col("c_name"), F.col("c_custkey")
    return b.table(spark, sf_dir, "customer").select(
        key,
        tx.field(name, "#", 1).alias("second"),
        tx.number(tx.field(name, "#", 1), "bigint").alias("number"),
        tx.strip(F.concat(F.lit(" \t"), name, F.lit(" \r"))).alias("stripped"),
        F.replace(name, F.lit("#"), F.lit(".")).alias("replaced"),
        F.concat_ws("-", F.left(name, F.lit(4)), F.right(name, F.lit(3))).alias("ends"),
        F.locate("#", name).alias("place"),
        name.contains("00").cast("int").alias("has_00"),
        F.substring(name, 9, 20).rlike("^#[0-9]+$").cast("int").alias("digits"),
        F.format_string("%dx/%s%%", key, F.col("c_mktsegment")).alias("template"),
        tx.word(F.concat(name, F.lit("   "), F.col("c_mktsegment")), 1).alias("word_1"),
        tx.before(F.concat(key, F.lit(" MB free")), "MB").alias("size"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        src_sample_blocks, src_sample_blocks_hour, src_sample_blocks_full, src_cpu_rows, src_vcore_rows,
        src_vcore_after_marker, src_power_readings, win_top5_power, win_block_id, win_drop_last, flt_line_class,
        src_config_fixed, src_config_blocks, src_perf_summary, src_perf_spread, src_power_stats,
        src_jvm_pool, src_matrix, src_util_tsv, flt_ip, flt_run_name, prj_run_name, fn_text_pack,
    ]
}

_list = ", ".join
_complete = """, complete as (select * from samples
    qualify row_number() over (partition by run, ip order by event_id desc) > 1)"""
_counts = """event_id % 60 as mr_used, 60 as mr_all, event_id % 50 as sql_used, 50 as sql_all,
    event_id % 40 as scala_used, 40 as scala_all, event_id % 60 + event_id % 50 + event_id % 40 as vcore_total"""
_blocks = """, blocks as (select '/logs/' || run || '/' || host || '/sdr_log_' || host || '_24H' as file, event_id,
    row_number() over (partition by run, host order by event_id) as block,
    count(*) over (partition by run, host) as n_blocks from samples)"""
_POOL = ["all_crash", "task_crash", "failed_container", "gc_limit", "mr_reuse", "sql_reuse", "mr_fallback",
         "sql_fallback", "mr_new", "sql_new", "conventional"]

SQL = {
    "src_sample_blocks": b.with_samples(
        f"{_complete} select run, ip, date_trunc('second', ts) as ts, {_list(CPU_COLUMNS + YARN_COLUMNS)} from complete"),
    "src_sample_blocks_hour": b.with_samples(
        f"{_complete} select left(run, 4) as date, host, hour, date_trunc('second', ts) as ts, {_list(CPU_COLUMNS + YARN_COLUMNS)} from complete"),
    "src_sample_blocks_full": b.with_samples(
        f"select run, date, ip, hour, {_list(CPU_COLUMNS + YARN_COLUMNS + MEM_COLUMNS + SWAP_COLUMNS)} from samples"),
    "src_cpu_rows": b.with_samples(f"select run, ip, {_list(CPU_COLUMNS)} from samples"),
    "src_vcore_rows": b.with_samples(f"select event_id, ip, {_counts} from samples"),
    "src_vcore_after_marker": b.with_samples(f"select event_id, ip, {_counts} from samples"),
    "src_power_readings": b.with_samples(
        "select event_id, ip, cast(yarn_mem_used + 800 as double) as watt from samples"),
    "win_block_id": b.with_samples(
        f"{_blocks} select file, event_id * 32 + n as pos, block, n_blocks from blocks, range(15) r(n)"),
    "win_drop_last": b.with_samples(f"""{_blocks}
        select file, count(*) * 15 as n_lines, max(block) as last_block from blocks where block < n_blocks group by file"""),
    "flt_line_class": """
        select kind, n * (select count(*) from events) as n from
          (values ('header', 1), ('cpu', 1), ('value', 5), ('memory', 2), ('other', 4)) v(kind, n)""",
    "src_config_fixed": b.with_tables(["config"], """
        select run, ip, cast(smt as bigint) as smt, cast(vcore as bigint) as vcore, freq, java_home from config"""),
    "src_config_blocks": b.with_tables(["config"], "select run, ip, smt, vcore, freq, jdk, java_home from config"),
    "src_perf_summary": b.with_tables(["perf"], """
        select run, replace('tdw-' || ip, '.', '-') as host, ip, mr_nbr, mr_time,
          case when l_suppkey % 4 = 3 then 0 else sql_nbr end as sql_nbr, sql_time, scala_nbr, scala_time from perf"""),
    "src_perf_spread": b.with_tables(["perf"], """
        select run, ip, mr_nbr, mr_time, mr_time * 2 as mr_std, case when l_suppkey % 4 = 3 then 0 else sql_nbr end as sql_nbr,
          sql_time, sql_time * 2 as sql_std, scala_nbr, scala_time, scala_time * 2 as scala_std from perf"""),
    "src_power_stats": b.with_tables(["power"], "select run, ip, avg_w, max_w, min_w, stdev_w from power"),
    "win_top5_power": b.with_samples("""
        , counted as (select ip, cast(yarn_mem_used + 800 as double) as watt, count(*) as n from samples group by 1, 2)
        select ip, watt, n, row_number() over (partition by ip order by watt desc) as rank from counted
        qualify rank <= 5"""),
    "src_jvm_pool": b.with_tables(["pool"], f"select run, ip, {_list(_POOL)} from pool where l_suppkey % 10 <> 9"),
    "src_matrix": "select l_quantity as c0, l_extendedprice as c1, l_discount as c2, l_tax as c3 from lineitem",
    "src_util_tsv": b.with_samples("""
        select ip, cast(yarn_cpu_used as double) as vcore, cpu_user as user, cpu_sys as sys, cpu_idle as idle from samples"""),
    "flt_ip": """
        with made as (select o_orderkey, (o_orderkey % 300) || '.' || (o_orderkey % 256) || '.' || (o_orderkey // 256)
          || '.' || (o_orderkey % 7) as text from orders)
        select o_orderkey, text, case when o_orderkey // 256 <= 255 then
            case when o_orderkey % 300 <= 255 then text else right(text, length(text) - 1) end
          end as found, cast(o_orderkey % 300 <= 255 and o_orderkey // 256 <= 255 as int) as valid from made""",
    "flt_run_name": """
        select o_orderkey, run from (select o_orderkey, (o_orderkey % 2500) || '-24H' as run from orders)
        where regexp_matches(run, '[0-1][0-9][0-3][0-9]')""",
    "prj_run_name": """
        select o_orderkey, strftime(o_orderdate, '%m/%d') as date, '24H' as hours,
          case o_orderkey % 3 when 0 then 'POC' when 1 then 'td3' else 'hto-x' end as tag from orders""",
    "fn_text_pack": """
        select c_custkey, split_part(c_name, '#', 2) as second, cast(split_part(c_name, '#', 2) as bigint) as number,
          c_name as stripped, replace(c_name, '#', '.') as replaced, left(c_name, 4) || '-' || right(c_name, 3) as ends,
          instr(c_name, '#') as place, cast(contains(c_name, '00') as int) as has_00,
          cast(regexp_matches(substr(c_name, 9, 20), '^#[0-9]+$') as int) as digits,
          c_custkey || 'x/' || c_mktsegment || '%' as template, c_mktsegment as word_1,
          cast(c_custkey as varchar) as size from customer""",
}
