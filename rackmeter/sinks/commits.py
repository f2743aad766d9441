"""Tables that grow by whole commits.

Rows are staged in a folder of their own below ``data``; a commit then names that folder by writing one small file
below ``log``, which appears at once or not at all. Readers follow the log, so rows of a writer that stopped
half-way are never seen, and "present" means committed. A commit has a token: an append that is run again with the
same token adds nothing, and if two writers race with one token, readers take the first by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "token STRING, folder STRING, columns STRING"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commits of a table: token, folder and columns; empty for a new table."""
    try:
        log = spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/log")
        log.isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)
    first = Window.partitionBy("token").orderBy("folder")
    return log.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of a table, with the columns of its first commit."""
    listed = commits(spark, path).orderBy("folder").collect()
    if not listed:
        raise ValueError(f"{path} has no commits")
    return spark.read.schema(listed[0]["columns"]).parquet(*[f"{path}/data/{r.folder}" for r in listed])


def has(spark: SparkSession, path: str, token: str) -> bool:
    return not commits(spark, path).where(F.col("token") == token).isEmpty()


def stage(df: DataFrame, path: str, keys: Sequence[str] = ()) -> str:
    """Write rows where no reader looks for them yet; returns the folder's name."""
    folder = uuid.uuid4().hex
    rows = df.hint("rebalance", *keys) if keys else df
    rows.write.parquet(f"{path}/data/{folder}")
    return folder


def publish(spark: SparkSession, path: str, token: str, folder: str, columns: str) -> None:
    """Make a staged folder part of the table."""
    row = spark.createDataFrame([(token, folder, columns)], LOG_SCHEMA)
    row.coalesce(1).write.parquet(f"{path}/log/{folder}")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def append_once(df: DataFrame, path: str, token: str, keys: Sequence[str] = ()) -> bool:
    """Add rows under a token, unless a commit has it; tells whether rows were added."""
    spark = df.sparkSession
    if has(spark, path, token):
        return False
    publish(spark, path, token, stage(df, path, keys), _columns(df))
    return True


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Add only rows whose keys no committed row has."""
    spark = df.sparkSession
    if not commits(spark, path).isEmpty():
        df = df.join(read(spark, path).select(*keys).distinct(), list(keys), "left_anti").select(df.columns)
    folder = stage(df, path, keys)
    publish(spark, path, folder, folder, _columns(df))
