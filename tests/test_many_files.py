"""More files than the driver should hold: listed, planned and read by tasks, with the results of Spark's own way."""

import gzip
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rackmeter.catalog import file_queries as fq
from rackmeter.sinks import key_files
from rackmeter.sources import byte_lines, tables
from rackmeter.sources import lines as ln
from tests.conftest import DATA
from tests.test_key_files import ODD


def put(path, data=b"x\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(ln, "FEW_FILES", 2)


@pytest.fixture
def spark_lists(monkeypatch):
    """Patterns that are listed by Spark."""
    asked, kind = [], None

    def watch(spark):
        nonlocal kind
        kind = type(spark.read)
        real = kind.load
        monkeypatch.setattr(kind, "load", lambda self, *a, **k: asked.append(a[0] if a else None) or real(self, *a, **k))
        return asked

    return watch


@pytest.mark.parametrize("pattern", [
    "*/*tdw*/kind=a", "*/*tdw*/kind=a/*", "*/*/*/*.gz", "*/*tdw*/*", "r1/tdw-0/kind=a", "*/tdw-?/kind=?/part-*", "r1//tdw-*/./kind=a/", "*/ä*/*",
])
def test_files_are_listed_by_tasks_as_by_spark(spark, tmp_path, few, spark_lists, pattern):
    for run in ("r1", "r2"):
        for k in range(12):
            for kind in ("a", "b"):
                put(tmp_path / run / f"tdw-{k}" / f"kind={kind}" / "part-1", b"x" * (k + 1))
                put(tmp_path / run / f"tdw-{k}" / f"kind={kind}" / "part-2.txt.gz")
                for hidden in (".part-3", "_SUCCESS", ".part-1.crc", "x._COPYING_"):
                    put(tmp_path / run / f"tdw-{k}" / f"kind={kind}" / hidden)
            put(tmp_path / run / "ä b%" / f"q{k}" / "part-1")
        put(tmp_path / run / "tdw-file")
        (tmp_path / run / "tdw-none" / "kind=a").mkdir(parents=True)
        os.symlink(tmp_path / "gone", tmp_path / run / "tdw-1" / "kind=a" / "part-9")
    path = f"{tmp_path}/{pattern}"
    want = rows(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes")))
    asked = spark_lists(spark)
    assert rows(ln.list_files(spark, path)) == want
    assert rows(ln.list_files(spark, f"file://{path}", optional=True)) == want
    assert asked == [path, f"file://{path}"] if len(want) <= 2 else not asked


def test_other_patterns_and_deeper_folders_are_left_to_spark(spark, tmp_path, few, spark_lists):
    for k in range(12):
        put(tmp_path / "r" / f"tdw-{k}" / "f")
        put(tmp_path / "p" / "q" / f"day={k}" / "f")
    asked = spark_lists(spark)
    for pattern, n in [("r/tdw-[0-4]/*", 5), ("r/{tdw-1,tdw-2,tdw-3}/*", 3), ("p/q", 12), ("p/*", 12)]:
        assert ln.list_files(spark, f"{tmp_path}/{pattern}").count() == n
    assert len(asked) == 4
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        ln.list_files(spark, f"{tmp_path}/r/*/*/*/none")


def dumps(path):
    for k in range(20):
        text = "".join(f"{k} line {i}\r\n" * (i % 3 + 1) for i in range(60 * (k % 4))).encode()
        put(path / f"tdw-{k}" / "plain", text)
        put(path / f"tdw-{k}" / "one.gz", gzip.compress(text))
        put(path / f"tdw-{k}" / "several.gz", b"".join(gzip.compress(text[i : i + 200]) for i in range(0, len(text), 200)) or gzip.compress(b""))
    return f"{path}/*/*"


def test_many_files_give_the_same_lines(spark, tmp_path, small_splits, monkeypatch):
    path = dumps(tmp_path)
    columns = ["file", "pos", "next", "line"]
    want = rows(ln.read_lines(spark, path).select(columns))
    monkeypatch.setattr(ln, "FEW_FILES", 2)
    got = ln.read_lines(spark, path)
    assert rows(got.select(columns)) == want and len(want) > 3000
    assert rows(ln.read_lines(spark, ln.list_files(spark, path)).select(columns)) == want


def test_the_driver_plans_tasks_by_places_in_lists_not_by_files(spark, tmp_path, few, monkeypatch):
    plans = []
    real = byte_lines._load
    monkeypatch.setattr(byte_lines, "_load", lambda spark, plan, lists, *a: plans.append((plan, lists)) or real(spark, plan, lists, *a))
    for k in range(300):
        put(tmp_path / f"tdw-{k}" / "log", b"a\nb\n")
    lines = ln.read_lines(spark, f"{tmp_path}/*/log")
    assert lines.count() == 600
    (plan, lists), = plans
    # Not one partition for 32 files either, as the cost of opening a file would have it.
    assert plan == [] and len(lists) <= 4 * spark.sparkContext.defaultParallelism
    reader = byte_lines.LineReader({"files": "[]", "lists": json.dumps(lists), "rangebytes": "100", "opencost": "1"})
    parts = reader.partitions()
    assert not any(part.ranges for part in parts)
    assert len({one[0] for part in parts for one in part.all()}) == 300


def test_an_empty_file_may_come_first(spark, tmp_path):
    put(tmp_path / "a", b"")
    put(tmp_path / "b", b"x\n")
    assert [r.line for r in ln.read_lines(spark, f"{tmp_path}/*").collect()] == ["x"]


def test_many_csv_files_give_the_same_rows(spark, tmp_path, monkeypatch):
    ends = [
        "1,2,3\n", ' 1 ,"2, ""x"" ", 3 \n', "1\n", "1,2,3,4\n", "\n  \n5,6,7", "1,2,3\r\n\r\n4,,6\r7,8,9", '"",\\",""\n', "", "ä,　,\x01\n", "a\tb,\t,c\n",
    ]
    for k in range(40):
        put(tmp_path / f"r{k % 2}" / f"h ä%{k}" / "part-1.csv", ("a, b ,c\n" + ends[k % len(ends)]).encode())
        if k < 8:
            put(tmp_path / "r2" / f"h{k}" / "part-1.csv", ("c,a,d,d\n" + ends[k]).encode())
            put(tmp_path / "r3" / f"h{k}" / "part-1.csv.gz", gzip.compress(("a, b ,c\n" + ends[k]).encode()))
    for k in range(5):
        put(tmp_path / "r4" / f"h{k}" / "bom.csv", b"\xef\xbb\xbfa,b,c\n1,\xff,3\n")
    put(tmp_path / "r5" / "h" / "one.csv", b"b,z\n1,2\n")
    put(tmp_path / "r5" / "blank" / "part-1.csv", b"\na,b,c\n9,9,9\n")
    put(tmp_path / "r5" / "none" / "part-1.csv", b"")
    want = tables._csv(spark, f"{tmp_path}/*/*")
    names, want = want.columns, rows(want)
    monkeypatch.setattr(ln, "FEW_FILES", 2)
    asked = []
    real = tables._csv_files
    monkeypatch.setattr(tables, "_csv_files", lambda spark, head, files, base=None: asked.append(len(files)) or real(spark, head, files, base))
    got = tables._csv(spark, f"{tmp_path}/*/*")
    assert got.columns == names and rows(got) == want
    assert sorted(asked) == [1, 1]


@pytest.mark.parametrize("packed", [False, True])
def test_text_files_are_those_of_sparks_writer(spark, tmp_path, packed):
    lines = spark.range(400).select(
        F.get(F.array(*[F.lit(v) for v in ODD]), (F.col("id") % len(ODD)).cast("int")).alias("run"),
        F.concat(F.lit("h"), F.col("id") % 3).alias("host"), F.lit("log").alias("kind"), F.col("id").alias("pos"), F.lit(0).alias("n"),
        F.get(F.array(*[F.lit(v) for v in ("", " ä b ", "x\ty", "€")]), (F.col("id") % 4).cast("int")).alias("line"),
    ).repartition(3, "run", "host")
    fq._write_lines(lines, str(tmp_path / "new"), **({"compression": "gzip"} if packed else {}))
    with pytest.MonkeyPatch.context() as other:
        other.setattr(key_files, "local_path", lambda df, path: None)
        fq._write_lines(lines, str(tmp_path / "own"), **({"compression": "gzip"} if packed else {}))

    def found(name):
        files = [f for f in (tmp_path / name).rglob("part-*")]
        assert all(f.name.endswith(".txt.gz" if packed else ".txt") for f in files)
        return sorted((str(f.parent.relative_to(tmp_path / name)), gzip.decompress(f.read_bytes()) if packed else f.read_bytes()) for f in files)

    assert found("new") == found("own")
    # A checksum beside each file tells that Spark wrote it, with three processes a file.
    assert not [f for f in (tmp_path / "new").rglob("*.crc")] and [f for f in (tmp_path / "own").rglob("*.crc")]


def test_names_of_written_files_are_sent_packed():
    names = [f"run=0101-24H/host=tdw-10-0-{k // 256}-{k % 256}/kind=sdr_log/.part-{1:032x}.txt" for k in range(2000)]
    written = key_files.Written.of(names)
    assert written.names() == names and len(written.packed) < 20 * len(names)
    assert key_files.Written.of([]).names() == []


@pytest.mark.parametrize("name", [
    "src_gzip", "src_sample_blocks_files", "rep_fleet_files", "rep_rollup_runs", "rep_fleet_older_files", "src_sample_table",
])
def test_queries_give_the_same_by_tasks(spark, monkeypatch, spark_lists, name):
    query = entry.queries()[name]
    want = rows(query(spark, DATA))
    monkeypatch.setattr(ln, "FEW_FILES", 4)
    asked = spark_lists(spark)
    assert rows(query(spark, DATA)) == want
    # Only a few files of configuration are still listed on the driver.
    assert [p for p in asked if isinstance(p, str) and "kind=config" not in p and "checkpoint" not in p] == []
