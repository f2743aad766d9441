"""Hourly roll-ups that grow: sums and counts are stored, so late servers and late samples merge in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackmeter.operators import rollup
from rackmeter.plans.fleet import FILES
from rackmeter.schemas import SAMPLE_METRICS
from rackmeter.sinks import commits
from rackmeter.sources import lines as ln
from rackmeter.sources import monitor

KEYS = ["run", "year", "day", "ip", "hour"]
RATIOS = ["cpu_nonidle%", "vcore%"]


def partial_sums(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum and number of values of every metric and ratio by key: ``<name>_sum`` and ``<name>_n``."""
    rated = rollup.with_ratios(samples)
    names = [c for c in SAMPLE_METRICS if c in samples.columns] + RATIOS
    return rated.groupBy(*keys).agg(
        *[f(F.col(f"`{c}`")).alias(f"{c}{end}") for c in names for f, end in ((F.sum, "_sum"), (F.count, "_n"))]
    )


def means_of(partials: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Means by key from any number of partial sums of the same key."""
    names = [c.removesuffix("_sum") for c in partials.columns if c.endswith("_sum")]
    merged = [F.try_divide(F.sum(f"`{c}_sum`").cast("double"), F.sum(f"`{c}_n`")).alias(c) for c in names]
    return partials.groupBy(*keys).agg(*merged)


def add_samples(samples: DataFrame, path: str, token: str) -> bool:
    """Add the sums of some samples to a stored roll-up; the same token adds once."""
    return commits.append_once(partial_sums(rollup.with_date_parts(samples)), path, token)


def hourly_means(spark: SparkSession, path: str) -> DataFrame:
    """The roll-up of all samples added so far, as ``rollup.hourly_means`` gives it in one go."""
    return means_of(commits.read(spark, path))


def update_from_runs(spark: SparkSession, runs: str, path: str, keep_last: bool = False, dump: str = FILES["dump"]) -> None:
    """Add all servers of the run folders that the stored roll-up does not have; only their dumps are read.

    A server counts as present once a commit holds it, also in a run that was rolled up before.
    """
    found = ln.with_server(ln.list_files(spark, f"{runs.rstrip('/')}/*tdw*/{dump}"))
    if not commits.commits(spark, path).isEmpty():
        found = found.join(commits.read(spark, path).select("run", "ip").distinct(), ["run", "ip"], "left_anti")
    files = found.select("file", "bytes")
    if not files.isEmpty():
        samples = monitor.sample_blocks(ln.read_lines(spark, files), keep_last)
        commits.append_new(partial_sums(rollup.with_date_parts(samples)), path, ["run", "ip"])
