"""Delimited inputs with an explicit schema, and numeric matrices."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rackmeter.functions import text as tx
from rackmeter.schemas import APP_COLUMNS, CSV_NAMES, SAMPLE_METRICS, TASK_SCHEMA, TRAFFIC_COLUMNS, UTIL_SCHEMA
from rackmeter.schemas import CPU_COLUMNS
from rackmeter.session import mounted_scratch, wide
from rackmeter.sources import lines as ln
from rackmeter.sources.byte_lines import first_lines
from rackmeter.sources.lines import are_many, list_files, present_paths, read_lines, with_server

CSV = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
# Endings by which Spark unpacks files, other than .gz.
OTHER_PACKED = r"\.(bz2|deflate|lz4|snappy|zst|xz|lzo)$"
# Signs that names of files hold as %XX, the percent sign first.
QUOTED = "%" + "".join(map(chr, range(1, 33))) + '"#<>?[\\]^`{|}\x7f'


def trim_names(df: DataFrame) -> DataFrame:
    """Column names without outer blanks."""
    return df.toDF(*[name.strip() for name in df.columns])


def header_layouts(files: DataFrame) -> list[tuple[str, list[str]]]:
    """The different header lines of the files (file, bytes), in the order of their first file, each with its files."""
    layouts = first_lines(files).groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sorted(((r["head"], r["files"]) for r in layouts.collect()), key=lambda layout: layout[1][0])


def _csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as trimmed text under their trimmed header names, with the file path.

    Each file's columns are bound by its own header: files are grouped by header line, each group is read with its
    header, and the groups are put together by name. A column that a file lacks is NULL in its rows. Columns come
    in the order of the first file, then what later ones add. Partition folders below a single path are columns too.
    """
    plain = isinstance(paths, str) and not any(c in paths for c in "*?[{")
    files = list_files(spark, paths)
    if not plain and are_many(files) and (table := mounted_scratch(spark, "heads")):
        frames = _many_csv(spark, files, f"file:{table}")
    else:
        frames = []
        for head, some in header_layouts(files):
            folder = plain and not some[0].endswith(paths.split(":")[-1].lstrip("/"))
            frames.append(_csv_files(spark, head, some, paths if folder else None))
    if not frames:
        raise ValueError(f"no file with a header line below {paths}")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.select(*[c for c in whole.columns if c != "file"], "file")


def _csv_files(spark: SparkSession, head: str, files: list[str], base: str | None = None) -> DataFrame:
    """The rows of files of one header line, by Spark's reader."""
    reader = spark.read.option("basePath", base) if base else spark.read
    if head.strip():
        # The names are those of the first file; to find them in all files Spark would list all of them once more.
        reader = reader.schema(spark.read.csv(files[0], **CSV, header=True).schema)
    # Blanks around names may differ, so the header check of the reader would refuse files of the same layout.
    return _trimmed(reader.csv(files, **CSV, header=True), F.col("_metadata.file_path"))


def _trimmed(df: DataFrame, file: Column, names: Sequence[str] | None = None) -> DataFrame:
    names = df.columns if names is None else names
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in names], file.alias("file"))


def _many_csv(spark: SparkSession, files: DataFrame, table: str) -> list[DataFrame]:
    """A frame per header line, in the order of their first file. The driver gets the names of few files only."""
    first_lines(files.repartition(wide(spark), "file")).write.option("compression", "none").parquet(table)
    heads = spark.read.schema("file string, bytes long, head string").parquet(table)
    layouts = heads.groupBy("head").agg(F.min("file").alias("first"), F.count("*").alias("n")).collect()
    frames = []
    for head, first, n in sorted(layouts, key=lambda layout: layout["first"]):
        some = heads.where(F.col("head") == head).select("file", "bytes")
        # Files packed otherwise than by gzip have other lines than those their bytes hold; they are Spark's to read.
        if n > ln.FEW_FILES and any(c > " " for c in head) and some.where(F.col("file").rlike(OTHER_PACKED)).isEmpty():
            frames.append(_csv_lines(spark, first, some))
        else:
            frames.append(_csv_files(spark, head, sorted(r["file"] for r in some.collect())))
    return frames


def _csv_lines(spark: SparkSession, first: str, files: DataFrame) -> DataFrame:
    """The rows of many files of one header line, from their lines, as Spark's reader gives them."""
    names = spark.read.csv(first, **CSV, header=True).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in names)
    lines = read_lines(spark, files).where((F.col("pos") > 0) & F.col("line").rlike(r"[^\x00-\x20]"))
    cells = lines.select(F.from_csv("line", schema, {k: str(v) for k, v in CSV.items()}).alias("c"), F.col("file").alias("_file"))
    return _trimmed(cells.select("c.*", "_file"), _uri(F.col("_file")), names)


def _uri(file: Column) -> Column:
    """The path of a mounted file as ``_metadata.file_path`` names it."""
    quoted = file
    for c in QUOTED:
        quoted = F.replace(quoted, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(file.rlike(f"[{re.escape(QUOTED)}]"), quoted).otherwise(file)


def _bound(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The named columns with their types; those that no file has are NULL."""
    return df.select(*[F.expr(f"try_cast({'`' + c + '`' if c in df.columns else 'null'} as {kind}) as `{c}`") for c, kind in kinds.items()])


def task_info(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Task log: tid, starttime, endtime, duration (whole seconds), by the header of each file."""
    return _bound(_csv(spark, paths), {f.name: f.dataType.simpleString() for f in _parsed(TASK_SCHEMA)})


def _parsed(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def app_info(spark: SparkSession, paths: str | Sequence[str], optional: bool = False) -> DataFrame:
    """Application log per server; further columns of the files are kept as text.

    With ``optional=True`` paths without files are left out.
    """
    found = present_paths(spark, paths) if optional else paths
    if not found:
        schema = "file STRING, run STRING, host STRING, ip STRING, executors BIGINT, tasks BIGINT, duration2 BIGINT, avgtask DOUBLE"
        return spark.createDataFrame([], schema)
    df = _csv(spark, found if isinstance(found, str) or len(found) > 1 else found[0])
    kinds = dict(zip(APP_COLUMNS, ["bigint", "bigint", "bigint", "double"]))
    typed = {c: F.col(c).try_cast(kind) for c, kind in kinds.items() if c in df.columns}
    return with_server(df.withColumns(typed))


def sample_table(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Sample tables written as CSV, one or more per server, read as one frame."""
    df = _csv(spark, paths)
    back = {v: k for k, v in CSV_NAMES.items()}
    df = df.withColumnsRenamed({c: back[c] for c in df.columns if c in back})
    typed = {
        c: F.col(c).try_cast("double" if c in CPU_COLUMNS else "bigint")
        for c in SAMPLE_METRICS if c in df.columns
    }
    return df.withColumns({**typed, "hour": F.col("hour").try_cast("int")})


def rollup_table(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """An hourly roll-up written earlier."""
    df = _csv(spark, paths).drop("file")
    keys = {"run", "year", "day", "ip", "hour"}
    typed = {c: F.col(c).try_cast("double") for c in df.columns if c not in keys}
    return df.withColumns({**typed, "hour": F.col("hour").try_cast("int")})


def utilisation(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tab-separated utilisation by server, without header."""
    return spark.read.schema(UTIL_SCHEMA).csv(
        paths if isinstance(paths, str) else list(paths),
        sep="\t", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )


def utilisation_lines(lines: DataFrame) -> DataFrame:
    """The same from lines."""
    cell = lambda n: tx.field(F.col("line"), "\t", n)
    return lines.select(
        cell(0).alias("ip"),
        *[cell(n).try_cast("double").alias(c) for n, c in enumerate(["vcore", "user", "sys", "idle"], start=1)],
    )


def traffic(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw traffic table: ip, Date, Mon, net_received, net_transferred (further columns kept)."""
    df = _csv(spark, paths).drop("file")
    return df.withColumns(
        {c: F.col(c).try_cast("double") for c in TRAFFIC_COLUMNS[3:] if c in df.columns}
    )


def matrix(lines: DataFrame, width: int) -> DataFrame:
    """Blank-separated numbers as DOUBLE columns c0, c1, ...; empty lines are skipped."""
    words = tx.tokens(F.col("line"))
    kept = lines.where(tx.strip(F.col("line")) != "")
    return kept.select(
        "file", "split", "pos",
        *[F.get(words, F.lit(i)).try_cast("double").alias(f"c{i}") for i in range(width)],
    )
