"""Small per-run and per-server files: configuration, throughput, power statistics, JVM pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackmeter.functions import text as tx
from rackmeter.schemas import JVM_POOL_COLUMNS
from rackmeter.sources.blocks import Rule, assemble
from rackmeter.sources.lines import head_lines, number_lines, with_server

FIXED_PREAMBLE = 3
FIXED_BLOCK = 11
POOL_HEADER = "total_crash_cnt"


def config_blocks(lines: DataFrame) -> DataFrame:
    """Configuration by keyed lines: run, ip, smt, vcore, freq, jdk, java_home."""
    line = F.col("line")
    rules = [
        Rule(["smt"], line.contains("SMT"), F.array(tx.field(line, "=", 1))),
        Rule(["vcore"], line.contains("vcore"), F.array(tx.field(line, "=", 1))),
        Rule(["freq"], line.contains("freq"), F.array(tx.field(line, "=", 1))),
        Rule(["jdk"], line.startswith("jdk"), F.array(tx.field(line, "=", 1))),
        Rule(["java_home"], line.contains("JAVA_HOME"), F.array(tx.field(line, ":", 1))),
    ]
    has_ip = line.contains(".") & tx.ip_in(line).isNotNull()
    blocks = assemble(lines, has_ip, rules, keep_last=True, every_rule=True)
    # A server named twice in one file counts with its last block.
    place = F.struct("block_split", "block_pos")
    names = [name for rule in rules for name in rule.names]
    return (
        blocks.withColumn("ip", tx.ip_in(F.col("header")))
        .groupBy("file", "ip")
        .agg(F.max_by(F.struct(*names), place).alias("c"))
        .select(tx.run_of(F.col("file")).alias("run"), "file", "ip", "c.*")
    )


def config_fixed(lines: DataFrame) -> DataFrame:
    """Configuration by position: three lines of preamble, then blocks of eleven lines.

    A file of another length is rejected as a whole (see ``config_fixed_rejects``).
    """
    at = F.col("line_no") - FIXED_PREAMBLE - 1
    cells = number_lines(lines).where(
        (F.col("line_no") > FIXED_PREAMBLE)
        & ((F.col("n_lines") - FIXED_PREAMBLE) % FIXED_BLOCK == 0)
    )
    cells = cells.select(
        "file", "line",
        F.floor(at / FIXED_BLOCK).alias("block"),
        (at % FIXED_BLOCK).alias("cell"),
    )
    cell = lambda n: F.max(F.when(F.col("cell") == n, F.col("line")))
    blocks = cells.groupBy("file", "block").agg(
        cell(0).alias("head"), cell(1).alias("c0"), cell(2).alias("c1"),
        cell(3).alias("c2"), cell(9).alias("c8"),
    )
    # Split once: the path holds blanks, so the value follows the first ": ".
    return blocks.select(
        tx.run_of(F.col("file")).alias("run"), "file",
        tx.host_to_ip(F.replace(F.col("head"), F.lit("="), F.lit(""))).alias("ip"),
        F.get(F.split("c0", "="), F.lit(1)).try_cast("bigint").alias("smt"),
        F.get(F.split("c1", "="), F.lit(1)).try_cast("bigint").alias("vcore"),
        F.get(F.split("c2", "="), F.lit(1)).alias("freq"),
        F.get(F.split("c8", ": "), F.lit(1)).alias("java_home"),
    )


def config_fixed_rejects(lines: DataFrame) -> DataFrame:
    """Configuration files whose length does not fit the fixed layout."""
    counted = lines.groupBy("file").agg(F.count("*").alias("n_lines"))
    return counted.where((F.col("n_lines") - FIXED_PREAMBLE) % FIXED_BLOCK != 0)


def _at(n: int, label: str | None, value: Column) -> Column:
    hit = F.col("line_no") == n
    return F.max(F.when(hit & F.col("line").contains(label) if label else hit, value))


def perf_summary(lines: DataFrame, with_defaults: bool = True) -> DataFrame:
    """Task counts and mean times from fixed lines of the throughput summary.

    With defaults, counts and times of sql and scala are 0 where their line carries another text.
    """
    after = tx.field(F.col("line"), ":", 1)
    count = after.try_cast("bigint")
    mean = tx.before(after, "sec").try_cast("double")
    top = head_lines(lines, 10).groupBy("file").agg(
        _at(3, "Total executors mr", count).alias("mr_nbr"),
        _at(4, "Average task duration", mean).alias("mr_time"),
        _at(6, "Total tasks", count).alias("sql_nbr"),
        _at(7, "Average task duration", mean).alias("sql_time"),
        _at(9, "Total tasks", count).alias("scala_nbr"),
        _at(10, "Average task duration", mean).alias("scala_time"),
        F.max("line_no").alias("seen"),
    )
    if with_defaults:
        lines_of = {"sql_nbr": 6, "sql_time": 7, "scala_nbr": 9, "scala_time": 10}
        top = top.withColumns(
            {c: F.when(F.col("seen") >= n, F.coalesce(c, F.lit(0))) for c, n in lines_of.items()}
        )
    return with_server(top.drop("seen"))


def perf_spread(lines: DataFrame) -> DataFrame:
    """Counts, mean times and spreads from lines 3 to 11, whatever their text."""
    line = F.col("line")
    after = F.when(line.contains(":"), tx.strip(F.get(F.split(line, ": "), F.lit(1)))).otherwise(tx.strip(line))
    value = F.replace(after, F.lit(" secs"), F.lit(""))
    names = ["mr_nbr", "mr_time", "mr_std", "sql_nbr", "sql_time", "sql_std",
             "scala_nbr", "scala_time", "scala_std"]
    top = head_lines(lines, 11).groupBy("file").agg(
        *[
            _at(n, None, value.try_cast("bigint" if name.endswith("nbr") else "double")).alias(name)
            for n, name in enumerate(names, start=3)
        ],
        F.max("line_no").alias("seen"),
    )
    return with_server(top.where(F.col("seen") == 11).drop("seen"))


def power_stats(lines: DataFrame) -> DataFrame:
    """Average, highest, lowest and spread of the power draw, from line 2."""
    words = tx.tokens(F.col("line"))
    second = head_lines(lines, 2).where(F.col("line_no") == 2)
    return with_server(
        second.select(
            "file",
            *[
                F.get(words, F.lit(i)).try_cast("double").alias(name)
                for i, name in enumerate(["avg_w", "max_w", "min_w", "stdev_w"])
            ],
        )
    )


def _pool_lines(lines: DataFrame) -> DataFrame:
    return head_lines(lines, 2).groupBy("file").agg(_at(1, None, F.col("line")).alias("head"),
                                                    _at(2, None, F.col("line")).alias("row"))


def jvm_pool(lines: DataFrame) -> DataFrame:
    """The twelve cells of the JVM-pool log; files with another header are left out."""
    cells = F.split(F.translate(tx.strip(F.col("row")), " ", ""), ",")
    known = _pool_lines(lines).where(F.col("head").contains(POOL_HEADER) & F.col("row").isNotNull())
    read = known.select("file", cells.alias("c"))
    return read.select(
        tx.run_of(F.col("file")).alias("run"), "file",
        *[
            (F.get("c", F.lit(i)) if name == "ip" else F.get("c", F.lit(i)).try_cast("bigint")).alias(name)
            for i, name in enumerate(JVM_POOL_COLUMNS)
        ],
    )


def jvm_pool_rejects(lines: DataFrame) -> DataFrame:
    """JVM-pool files whose header has changed."""
    return _pool_lines(lines).where(~F.col("head").contains(POOL_HEADER)).select("file", "head")
