"""Tables that grow by commits, and roll-ups with late servers."""

import pytest

from rackmeter.operators import rollup
from rackmeter.plans import rollups
from rackmeter.sinks import commits

SCHEMA = "run string, host string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_only_commits_are_seen_and_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], SCHEMA)
    two = spark.createDataFrame([("c", "z", 3)], SCHEMA)
    with pytest.raises(ValueError):
        commits.read(spark, path)
    commits.stage(two, path)
    with pytest.raises(ValueError):
        commits.read(spark, path)
    assert commits.append_once(one, path, "t1") and not commits.append_once(one, path, "t1")
    assert rows(commits.read(spark, path)) == rows(one)
    # a writer that dies between staging and publishing leaves nothing that counts as present
    folder = commits.stage(two, path)
    assert rows(commits.read(spark, path)) == rows(one)
    commits.append_new(one.unionAll(two), path, ["run", "host"])
    assert rows(commits.read(spark, path)) == rows(one.unionAll(two))
    commits.append_new(one, path, ["run", "host"])
    assert rows(commits.read(spark, path)) == rows(one.unionAll(two))
    # two writers that race with one token
    commits.publish(spark, path, "race", folder, SCHEMA)
    commits.publish(spark, path, "race", commits.stage(two, path), SCHEMA)
    assert rows(commits.read(spark, path)) == rows(one.unionAll(two).unionAll(two))


def test_a_failed_write_is_not_present(spark, tmp_path):
    path = str(tmp_path / "t")
    from pyspark.sql import functions as F

    bad = spark.range(100).repartition(10).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        commits.append_once(bad, path, "t")
    assert not commits.has(spark, path, "t")
    assert commits.append_once(spark.range(100), path, "t") and commits.read(spark, path).count() == 100


def test_late_servers_and_samples_join_the_means(spark, tmp_path):
    date = "Tue Jul 11 {:02d}:00:01 CST 2017"
    data = [("0711-24H", f"10.0.0.{k % 3}", date.format(k % 4), k % 4, float(k), 60.0 - k, k % 7, 66) for k in range(60)]
    names = "run string, ip string, date string, hour int, cpu_user double, cpu_idle double, yarn_cpu_used long, yarn_cpu_all long"
    samples = spark.createDataFrame(data, names)
    path = str(tmp_path / "r")
    parts = [samples.where("ip = '10.0.0.0'"), samples.where("ip = '10.0.0.1'"), samples.where("ip = '10.0.0.2' and hour < 2"), samples.where("ip = '10.0.0.2' and hour >= 2")]
    for k, part in enumerate(parts):
        assert rollups.add_samples(part, path, str(k))
    assert not rollups.add_samples(parts[0], path, "0")
    want = rollup.hourly_means(rollup.with_date_parts(samples))
    got = rollups.hourly_means(spark, path).select(want.columns)
    flat = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert flat(got) == flat(want)
