"""Writers: incremental sample tables, roll-ups, appended rows, flat report lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.schemas import CSV_NAMES, FLEET_COLUMNS
from rackmeter.sinks import key_files

KEYS = ("run", "host")


def write_new_partitions(
    df: DataFrame, path: str, keys: Sequence[str] = KEYS, fmt: str = "parquet"
) -> None:
    """Append only partitions the table does not hold yet; existing ones are left as they are.

    Rows are rebalanced by partition first: a partition with very many rows is split over several
    writers, small ones share one. On a mounted file system each writer makes its files by Arrow (``key_files``).
    """
    spark = df.sparkSession
    try:
        # Only names are looked at; no file of the target is opened.
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        value = lambda k: F.url_decode(F.regexp_replace(F.regexp_extract("path", f"/{k}=([^/]*)/", 1), r"\+", "%2B"))
        present = files.select(*[value(k).alias(k) for k in keys]).distinct()
        df = df.join(present, list(keys), "left_anti")
    if key_files.can_write(df, path, keys, fmt):
        return key_files.write(df, path, keys, fmt)
    out = df.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).format(fmt)
    (out.option("header", True) if fmt == "csv" else out).save(path)


def write_once(df: DataFrame, path: str) -> None:
    """CSV with header; nothing is done if the path exists."""
    for_csv(df).write.mode("ignore").csv(path, header=True)


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """CSV with header in several files, sorted by range: in the order of their names they make up the order."""
    for_csv(df.orderBy(*order)).write.csv(path, header=True)


def write_single_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted CSV with header, always in one file and thus by one task; made for roll-ups."""
    for_csv(df.repartition(1).sortWithinPartitions(*order)).write.csv(path, header=True)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a CSV folder."""
    df.write.mode("append").csv(path, header=True)


def flat_lines(report: DataFrame, names: Sequence[str] = FLEET_COLUMNS) -> DataFrame:
    """One comma-separated line per row; missing cells are empty."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    return report.select(F.concat_ws(",", *cells).alias("line"))


def for_csv(df: DataFrame) -> DataFrame:
    """Column names as in the CSV form of the sample table."""
    return df.withColumnsRenamed({k: v for k, v in CSV_NAMES.items() if k in df.columns})
