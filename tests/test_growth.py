"""Figures that must not grow faster than the input: files per server, lines per task, rows dealt out for hot keys."""

import pickle
import re

from pyspark.sql import functions as F

from rackmeter.catalog import bindings as b
from rackmeter.catalog import file_queries as fq
from rackmeter.llm import repeats
from rackmeter.sources import lines as ln
from rackmeter.sources import monitor
from rackmeter.sources.byte_lines import LineReader


def write_events(spark, path, events):
    rows = spark.createDataFrame(events, "event_id long, user_id long").select(
        "event_id", F.expr("timestamp_seconds(1704067200 + event_id % 100000)").alias("ts"), "user_id",
        F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 5}').alias("props"),
    )
    rows.write.parquet(f"{path}/events.parquet")


def test_samples_of_a_server_share_a_file_however_far_apart_they_are(spark, tmp_path):
    write_events(spark, tmp_path / "sf", [(k * 50_000, k % 2) for k in range(40)])
    dumps = fq._dumps(spark, f"{tmp_path}/sf")
    path = fq._write_lines(dumps, f"{tmp_path}/logs")
    files = sorted((tmp_path / "logs").glob("run=*/host=tdw-*/kind=sdr_log/part-*"))
    assert len(files) == 2
    rendered = b.to_lines(
        b.samples(spark, f"{tmp_path}/sf", two_runs=True), F.lit("f"), F.col("event_id"), b.dump_texts(), carry=["host"]
    )
    for file in files:
        host = re.search("host=([^/]+)", str(file)).group(1)
        want = [r.line for r in rendered.where(F.col("host") == host).orderBy("pos").collect()]
        assert file.read_text().splitlines() == want
    assert ln.read_lines(spark, f"{path}/*/*/*").count() == 40 * 15


def test_files_are_written_by_as_many_tasks_as_there_are_files_and_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fq, "TASK_FILES", 2)
    monkeypatch.setattr(fq, "TASK_ROWS", 30)
    write_events(spark, tmp_path / "sf", [(k, k % 8 if k < 40 else 8) for k in range(160)])
    dumps = fq._dumps(spark, f"{tmp_path}/sf")
    assert dumps.rdd.getNumPartitions() == 6
    fq._write_lines(dumps, f"{tmp_path}/logs")
    files = {}
    for file in (tmp_path / "logs").glob("run=*/host=tdw-*/kind=sdr_log/part-*"):
        files.setdefault(re.search("host=([^/]+)", str(file)).group(1), []).append(file.read_text().splitlines())
    assert len(files) == 9
    assert all((len(parts) > 1) == (host == "tdw-10-0-0-8") for host, parts in files.items())
    assert sum(len(lines) for parts in files.values() for lines in parts) == 160 * 15
    assert all(lines[k].startswith("== ") for parts in files.values() for lines in parts for k in range(0, len(lines), 15))


def test_tasks_do_not_get_the_list_of_all_files():
    options = {"files": '[["/some/file", 5, []]]', "rangebytes": "100", "opencost": "1"}
    reader = LineReader(options)
    assert b"/some/file" not in pickle.dumps(reader)
    assert [part.ranges[0][0] for part in reader.partitions()] == ["/some/file"]


def test_optional_paths_are_listed_once(spark, tmp_path, monkeypatch):
    (tmp_path / "log").write_text("a\nb\n")
    loads = []
    kind = type(spark.read)
    real = kind.load
    monkeypatch.setattr(kind, "load", lambda self, *a, **k: loads.append(a) or real(self, *a, **k))
    paths = [f"{tmp_path}/log", f"{tmp_path}/none*"]
    assert [r.file.rsplit("/", 1)[1] for r in ln.list_files(spark, paths, optional=True).collect()] == ["log"]
    assert len(loads) == 2
    assert ln.read_lines(spark, paths, optional=True).count() == 2
    assert ln.read_lines(spark, paths[1], optional=True).count() == 0


def test_lines_are_numbered_by_as_many_tasks_as_their_number_asks_for(spark, monkeypatch):
    monkeypatch.setattr(ln, "TASK_LINES", 100)
    lines = spark.range(4000).select(
        F.concat(F.lit("/r/f"), F.col("id") % 100).alias("file"), F.lit(0).cast("bigint").alias("split"), F.col("id").alias("pos"),
        F.when(F.col("id") % 700 < 100, "== Tue Jul 11 00:00:01 CST 2017 ==").otherwise("x").alias("line"),
    )
    numbered = ln.number_blocks(lines, monitor.is_header(F.col("line")))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\([^)]*, 40\), REPARTITION_BY_NUM", plan)) == 2
    got = {(r.file, r.pos): (r.block, r.n_blocks) for r in numbered.collect()}
    assert len(got) == 4000
    for k in range(100):
        block = 0
        for pos in range(k, 4000, 100):
            block += pos % 700 < 100
            assert got[f"/r/f{k}", pos] == (block, 6)


def test_different_runs_of_a_hot_anchor_are_not_dealt_out(spark, monkeypatch):
    """Salts multiply only contents that are many rows themselves, each in one row whatever its stretches are."""
    made = []
    real = repeats._for_all_salts
    monkeypatch.setattr(repeats, "_for_all_salts", lambda rows, hot: made.append((rows, real(rows, hot))) or made[-1][1])
    common = "0123456789abcdefghijklmnopqrstuvwxyz" * 8
    docs = spark.createDataFrame(
        [(k, f"{k:05d}{k * 7919 % 1000003:07d}" * 20 + common + f"{k * 104729 % 999983:07d}" * 30) for k in range(300)],
        "doc_id long, text string",
    )
    assert repeats.remove_repeats(docs).where("n_removed > 0").count() == 300
    rows, dealt = made[-1]
    assert dealt.count() <= rows.count() + 2 * repeats.SHARES
    assert rows.groupBy("anchor", "content").count().where("count > 1").isEmpty()


def test_folder_names_are_not_parsed_one_by_one_on_the_driver(spark, tmp_path):
    write_events(spark, tmp_path / "sf", [(k, k % 40) for k in range(80)])
    got = fq.snk_incremental(spark, f"{tmp_path}/sf")
    scan = re.search(r"ReadSchema: struct<([^>]*)>", got._jdf.queryExecution().executedPlan().toString())
    assert scan and not re.search(r"FileScan parquet \[[^\]]*(run|host)#", got._jdf.queryExecution().executedPlan().toString())
    assert got.where("run like '010_-24H' and host rlike '^tdw-10-0-0-[0-9]+$'").select("host").distinct().count() == 40
