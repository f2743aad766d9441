"""Monitor dumps: cpu rows, container counts, power readings and sample blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackmeter.functions import text as tx
from rackmeter.schemas import CPU_COLUMNS, MEM_COLUMNS, SWAP_COLUMNS, YARN_COLUMNS
from rackmeter.sources.blocks import Rule, Tally, assemble, line_after
from rackmeter.sources.lines import with_server

# What the monitor writes.
HEADER = "CST.*=="
CPU_ROW = r"(\d{1,3}\.\d{1,2} *){6}"
COUNT_LINE = "CST.*MR.*SQL"
# A line that starts with six plain numbers.
NUMBER_ROW = r"^\s*\d+(\.\d+)?(\s+\d+(\.\d+)?){5}"
# Pairs "a/b" in words 9, 11 and 13.
PAIR = r"\d+(\.\d+)?/\d+(\.\d+)?"
COUNT_ROW = rf"^\s*(\S+\s+){{8}}{PAIR}\s+\S+\s+{PAIR}\s+\S+\s+{PAIR}"
COUNT_MARKER = "mr_sparksql_scala_container_coun"
CPU_MARKER = "avg-cpu"
COUNT_COLUMNS = ["mr_used", "mr_all", "sql_used", "sql_all", "scala_used", "scala_all"]


def is_header(line: Column) -> Column:
    return line.contains("CST") & line.rlike(HEADER)


def is_cpu_row(line: Column) -> Column:
    return line.contains(".") & line.rlike(CPU_ROW)


def is_count_line(line: Column) -> Column:
    return line.contains("CST") & line.rlike(COUNT_LINE)


# Literal words that mark the lines with one value, and the unit behind the value.
VALUE_LINES = {
    "ctn": ("Containers", ""),
    "yarn_mem_used": ("Memory-Used", "MB"),
    "yarn_mem_all": ("Memory-Capacity", "MB"),
    "yarn_cpu_used": ("CPU-Used", "vcores"),
    "yarn_cpu_all": ("CPU-Capacity", "vcores"),
}


def _sample_rules(full: bool) -> list[Rule]:
    line = F.col("line")
    words = tx.tokens(line)
    rules = [Rule(CPU_COLUMNS, is_cpu_row(line), tx.numbers(F.slice(words, 1, 6)))]
    for name, (label, unit) in VALUE_LINES.items():
        value = tx.field(line, ":", 1)
        value = tx.before(value, unit) if unit else value
        rules.append(Rule([name], line.contains(label), F.array(value.try_cast("double"))))
    if full:
        rules.append(Rule(MEM_COLUMNS, line.contains("Mem:"), tx.numbers(F.slice(words, 2, 6))))
        rules.append(Rule(SWAP_COLUMNS, line.contains("Swap:"), tx.numbers(F.slice(words, 2, 3))))
    return rules


def relevant(line: Column) -> Column:
    """Lines any reader of a monitor dump looks at; all others can be dropped early."""
    words = ["Mem:", "Swap:", "Total Power", CPU_MARKER, COUNT_MARKER, "CST"]
    words += [label for label, _ in VALUE_LINES.values()]
    literal = F.lit(False)
    for w in words:
        literal = literal | line.contains(w)
    # A readable count line of the older layout has "a/b" pairs behind its marker.
    return literal | is_cpu_row(line) | line.rlike(NUMBER_ROW) | (line.contains("/") & line.rlike(r"\d+/\d+"))


def sample_blocks(
    lines: DataFrame, keep_last: bool = False, missing_as_zero: bool = True, full: bool = True
) -> DataFrame:
    """One row per monitor tick: run, host, ip, date, hour, ts and the metrics.

    ``full=False`` leaves out the memory and swap cells. A metric a block does not hold is 0, or
    NULL with ``missing_as_zero=False``.
    """
    rules = _sample_rules(full)
    blocks = assemble(lines, is_header(F.col("line")), rules, keep_last=keep_last)
    whole = YARN_COLUMNS + MEM_COLUMNS + SWAP_COLUMNS

    def cell(name: str) -> Column:
        value = f"coalesce({name}, 0.0d)" if missing_as_zero else name
        return F.expr(f"cast({value} as {'bigint' if name in whole else 'double'}) as {name}")

    words = F.col("words")
    placed = with_server(blocks.withColumn("words", tx.tokens(F.col("header"))))
    return placed.select(
        "file", "run", "host", "ip", "block_split", "block_pos",
        tx.header_date(words).alias("date"),
        tx.header_hour(words).alias("hour"),
        tx.header_time(words).alias("ts"),
        *[cell(name) for rule in rules for name in rule.names],
    )


def server_means(lines: DataFrame, keep_last: bool = False) -> DataFrame:
    """Per run and server from one reading of the dumps, a row each.

    avg_user, avg_sys and avg_idle (means of the cpu rows), avg_vcore (mean of the used containers), and the means of
    the container and memory figures over all blocks, a figure that a block lacks being 0.
    """
    line = F.col("line")
    cpu = Tally(["user", "nice", "sys", "io", "steal", "idle"], line.rlike(NUMBER_ROW) & ~line.contains(CPU_MARKER),
                tx.numbers(F.slice(tx.tokens(line), 1, 6)), after=line.contains(CPU_MARKER))
    pairs = _counts(line)
    vcore = Tally(["vcore"], is_count_line(line), F.array(F.get(pairs, F.lit(0)) + F.get(pairs, F.lit(2)) + F.get(pairs, F.lit(4))))
    rules = [rule for rule in _sample_rules(False) if rule.names != CPU_COLUMNS]
    found = with_server(assemble(lines, is_header(line), rules, keep_last=keep_last, tallies=[cpu, vcore]))
    mean = lambda name: F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))
    return found.groupBy("run", "ip").agg(
        *[mean(name).alias(f"avg_{name}") for name in ("user", "sys", "idle", "vcore")],
        *[F.avg(F.when(F.col("complete"), F.coalesce(c, F.lit(0.0)))).alias(c) for c in YARN_COLUMNS],
        F.when(F.sum("user_n") + F.sum("vcore_n") > 0, True).alias("has_util"),
        F.when(F.max(F.col("complete")), True).alias("has_yarn"),
    )


def cpu_rows(lines: DataFrame) -> DataFrame:
    """Six cpu percentages from the line after each cpu marker."""
    line = F.col("line")
    cells = tx.numbers(F.slice(tx.tokens(line), 1, 6))
    readable = line.rlike(NUMBER_ROW)
    return with_server(line_after(lines, line.contains(CPU_MARKER), readable, CPU_COLUMNS, cells))


def _counts(line: Column) -> Column:
    """The three ``a/b`` pairs in words 9, 11 and 13 as one array of six numbers."""
    words = tx.tokens(line)
    pairs = F.concat_ws("/", *[F.coalesce(F.get(words, F.lit(n - 1)), F.lit("/")) for n in (9, 11, 13)])
    return tx.numbers(F.split(pairs, "/"))


def _with_total(df: DataFrame) -> DataFrame:
    return df.withColumn("vcore_total", F.col("mr_used") + F.col("sql_used") + F.col("scala_used"))


def count_rows(lines: DataFrame) -> DataFrame:
    """Used and available containers per framework, and the sum of the used ones."""
    found = lines.where(is_count_line(F.col("line"))).select(
        "file", "split", "pos", _counts(F.col("line")).alias("c")
    )
    return _with_total(
        with_server(found).select(
            "file", "run", "host", "ip", "split", "pos",
            *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(COUNT_COLUMNS)],
        )
    )


def count_rows_after_marker(lines: DataFrame) -> DataFrame:
    """The same counts in the older layout: on the line after a marker, whole numbers."""
    line = F.col("line")
    cells = F.transform(_counts(line), lambda c: c.try_cast("bigint"))
    readable = line.contains("/") & line.rlike(COUNT_ROW)
    found = line_after(lines, line.contains(COUNT_MARKER), readable, COUNT_COLUMNS, cells)
    return _with_total(with_server(found))


def power_readings(lines: DataFrame) -> DataFrame:
    """Power readings: word 10 of the power lines, with the machine named in the file name."""
    named = F.replace(F.regexp_extract("file", "tdw-([0-9-]+)[^/]*$", 1), F.lit("-"), F.lit("."))
    return lines.where(F.col("line").contains("Total Power")).select(
        "file", "split", "pos",
        F.coalesce(F.nullif(named, F.lit("")), tx.host_to_ip(tx.host_of(F.col("file")))).alias("ip"),
        tx.word(F.col("line"), 9).try_cast("double").alias("watt"),
    )
