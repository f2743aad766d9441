"""Text logs as DataFrames of lines that keep their order.

A file is read in splits, so a large file is spread over many tasks. The order of its lines is
``pos``, the byte at which a line starts (``split`` is the byte at which its range starts). Nothing
below puts a whole file into one task: order-dependent work runs in *chunks* of 2**CHUNK_BITS
bytes, and what crosses a chunk border is settled on one or two rows per chunk.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackmeter.functions import text as tx
from rackmeter.schemas import LINE_SCHEMA
from rackmeter.session import mounted_scratch, scratch_path
from rackmeter.sources.byte_lines import lines_of, lines_of_many
from rackmeter.sources.listing import many_files

CHUNK_BITS = 22
# Lines that one task numbers; they are sorted in its memory.
TASK_LINES = 1_000_000
# Files that the driver lists and plans itself. More are listed and planned by tasks, where all of them mount the files.
FEW_FILES = 1000


def chunk_of(pos: Column) -> Column:
    return F.shiftright(pos, CHUNK_BITS)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def present_paths(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Those of the paths that exist (globs: that match something), tried one by one."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            spark.read.format("binaryFile").load(path)
        except AnalysisException as error:
            if not _missing(error):
                raise
        else:
            found.append(path)
    return found


def read_lines(spark: SparkSession, paths: str | Sequence[str] | DataFrame, optional: bool = False) -> DataFrame:
    """Lines of all files below ``paths`` (globs allowed, ``.gz`` is unpacked on the way), with their places.

    The files are listed now, and large ``.gz`` files are searched for members that can be read apart. Files that are
    listed already are given as a frame (file, bytes).

    With ``optional=True`` paths without files are left out.
    """
    files = paths if isinstance(paths, DataFrame) else list_files(spark, paths, optional)
    size = lambda name: _bytes(spark.conf.get(f"spark.sql.files.{name}"))
    sizes = size("maxPartitionBytes"), size("openCostInBytes")
    found = files.limit(FEW_FILES + 1).collect()
    if len(found) > FEW_FILES:
        if lists := mounted_scratch(spark, "ranges"):
            return lines_of_many(files, lists, *sizes)
        found = files.collect()
    return lines_of(spark, sorted((r["file"], r["bytes"]) for r in found), *sizes) if found else spark.createDataFrame([], LINE_SCHEMA)


def are_many(files: DataFrame) -> bool:
    """Whether there are more files than the driver should hold."""
    return files.limit(FEW_FILES + 1).count() > FEW_FILES


def _bytes(setting: str) -> int:
    """A size setting in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index((unit or "b")[0])


def with_server(df: DataFrame) -> DataFrame:
    """Add ``run``, ``host`` and ``ip``, taken from the file path."""
    named = df.withColumns({"run": tx.run_of(F.col("file")), "host": tx.host_of(F.col("file"))})
    return named.withColumn("ip", tx.host_to_ip(F.col("host")))


def list_files(spark: SparkSession, paths: str | Sequence[str], optional: bool = False) -> DataFrame:
    """Path and size of each file, without reading any content."""
    if not optional:
        return _listed(spark, paths)
    frames = []
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            frames.append(_listed(spark, path))
        except AnalysisException as error:
            if not _missing(error):
                raise
    return reduce(DataFrame.unionAll, frames).distinct() if frames else spark.createDataFrame([], "file STRING, bytes BIGINT")


def _listed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    if isinstance(paths, str) and (many := many_files(spark, paths, FEW_FILES)) is not None:
        return many
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def hosts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Server folders that hold at least one file: run, host, ip."""
    listed = with_server(list_files(spark, paths)).where(F.col("host").isNotNull())
    return listed.select("run", "host", "ip").distinct()


def rejected_folders(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files outside any server folder, for audit."""
    return list_files(spark, paths).where(tx.host_of(F.col("file")).isNull())


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines of each file with ``line_no`` from 1.

    Spark keeps n lines per file and task before it shuffles (window group limit).
    """
    order = Window.partitionBy("file").orderBy("split", "pos")
    return lines.withColumn("line_no", F.row_number().over(order)).where(F.col("line_no") <= n)


def running_total(lines: DataFrame, weight: Column, name: str, total: str) -> DataFrame:
    """Add the running sum of ``weight`` within each file and the sum over the file.

    Chunks are summed one by one; the sums of the chunks before (one row per chunk) are joined in. The sums are worked
    out now, as their line counts tell among how many tasks the chunks are dealt: a task's share does not grow.
    """
    spark = lines.sparkSession
    keys = ["file", "split", "chunk"]
    marked = lines.withColumns({"chunk": chunk_of(F.col("pos")), "_w": weight.cast("bigint")})
    per_file = Window.partitionBy("file")
    earlier = per_file.orderBy("split", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    path = scratch_path(spark, "sums")
    marked.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.count("*").alias("_lines")).write.parquet(path)
    sums = spark.read.schema("file STRING, split BIGINT, chunk BIGINT, _n BIGINT, _lines BIGINT").parquet(path)
    tasks = -(-(sums.agg(F.sum("_lines")).first()[0] or 0) // TASK_LINES)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        marked, sums = marked.repartition(tasks, *keys), sums.repartition(tasks, "file")
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(per_file).alias(total),
    )
    in_chunk = (
        Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("_run", F.sum("_w").over(in_chunk))
        .join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_run"))
        .drop("chunk", "_w", "_run", "_before")
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no`` (from 1) and ``n_lines`` of the file."""
    return running_total(lines, F.lit(1), "line_no", "n_lines")


def number_blocks(lines: DataFrame, header: Column) -> DataFrame:
    """Add ``block`` (0 before the first header line) and ``n_blocks`` of the file."""
    return running_total(lines, F.coalesce(header, F.lit(False)).cast("int"), "block", "n_blocks")
