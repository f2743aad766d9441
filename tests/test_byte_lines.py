"""Lines with their places against a plain reading, for many ways to cut the files."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackmeter.schemas import CPU_COLUMNS
from rackmeter.sources import byte_lines as bl
from rackmeter.sources import lines as ln
from rackmeter.sources import monitor

SIZES = ["64b", "300b", "1000b", "5000b", "128m"]


@pytest.fixture
def split_size(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def places(raw):
    """(pos, next, line) of each line of the bytes."""
    out, at = [], 0
    while at < len(raw):
        end = re.compile(rb"\r\n|\r|\n").search(raw, at)
        stop, after = end.span() if end else (len(raw), len(raw))
        out.append((at, after, raw[at:stop].decode()))
        at = after
    return out


def noisy(rng, n):
    ends = [b"\n", b"\n", b"\r\n", b"\r", b"\n\n", b"\r\r\n", b"\n\r"]
    return b"".join(rng.choice([b"", b"a", "é 日本".encode(), b"x" * rng.randint(0, 200)]) + rng.choice(ends) for _ in range(n))


def read(spark, path):
    rows = ln.read_lines(spark, str(path)).collect()
    return sorted((r.file.rsplit("/", 1)[1], r.pos, r.next, r.line) for r in rows)


def test_places_do_not_depend_on_the_cuts(spark, split_size, tmp_path):
    rng = random.Random(1)
    raw = {"a.log": noisy(rng, 300), "b.log": noisy(rng, 40) + b"no end", "c.log": b"", "d.log": b"\r", "e.log": b"\n", "f.log": b"y" * 3000}
    for name, data in raw.items():
        (tmp_path / name).write_bytes(data)
    expected = sorted((name, *line) for name, data in raw.items() for line in places(data))
    for size in SIZES:
        split_size(size)
        assert read(spark, tmp_path) == expected


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_cuts_at_every_byte(step):
    raw = b"one\r\n\r\n\rtwo\n\n\r\nthree"
    for low in range(0, len(raw), step):
        high = min(low + step, len(raw))
        at = [max(low - 1, 0)]

        def some(size, at=at):
            part = raw[at[0] : at[0] + min(size, 2)]
            at[0] += len(part)
            return part

        got = []
        for data, lengths, spots in bl.cut_lines(some, at[0], bl.INSIDE if low else bl.FRESH, high):
            ends = np.cumsum(lengths)
            got += [(int(a), int(b), bytes(data[e - n : e]).decode()) for a, b, e, n in zip(spots, spots[1:], ends, lengths)]
        assert got == [x for x in places(raw) if low <= x[0] < high]


def test_members_of_a_gzip_file_are_read_apart(spark, split_size, tmp_path):
    rng = random.Random(2)
    raw = noisy(rng, 3000)
    inner = gzip.compress(b"a member inside of another\n" * 20)
    cuts = sorted(rng.sample(range(len(raw)), 40))
    parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
    packed = b"".join(gzip.compress(p) for p in parts)
    stored = gzip.compress(b"head\n" + inner + b"\ntail\n", compresslevel=0) + gzip.compress(b"") + gzip.compress(b"rest\r") + gzip.compress(b"\nend") + b"\0" * 20
    (tmp_path / "many.gz").write_bytes(packed)
    (tmp_path / "plain.log").write_bytes(raw)
    (tmp_path / "one.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "nested.gz").write_bytes(stored)
    for size in SIZES:
        split_size(size)
        lines = ln.read_lines(spark, f"{tmp_path}/*n*.gz").union(ln.read_lines(spark, f"{tmp_path}/plain.log"))
        by_file = {}
        for r in lines.where(~F.col("file").endswith("nested.gz")).collect():
            by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pos, r.next, r.line))
        want = places(raw)
        assert sorted(by_file["many.gz"]) == sorted(by_file["one.gz"]) == sorted(by_file["plain.log"]) == want
        nested = ln.read_lines(spark, f"{tmp_path}/nested.gz").orderBy("pos")
        assert [bytes(r.line) for r in nested.select(F.col("line").cast("binary").alias("line")).tail(3)] == [b"tail", b"rest", b"end"]
    split_size("300b")
    assert ln.read_lines(spark, f"{tmp_path}/many.gz").select(F.spark_partition_id()).distinct().count() > 10
    assert ln.read_lines(spark, f"{tmp_path}/one.gz").select(F.spark_partition_id()).distinct().count() == 1


def test_line_after_marker_with_unreadable_followers(spark, split_size, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "0711-24H" / "tdw-10-0-0-9"
    folder.mkdir(parents=True)
    text, want = [], []
    for _ in range(400):
        kind = rng.randrange(5)
        numbers = [float(rng.randrange(100)) for _ in range(6)]
        row = " ".join(map(str, numbers))
        text += [["avg-cpu: x", row], ["avg-cpu: x", "cut off", row], ["avg-cpu: x", "avg-cpu: y", row], [row], ["other", "avg-cpu: x"]][kind]
    for line, after in zip(text, text[1:]):
        if "avg-cpu" in line and re.fullmatch(r"[\d. ]+", after):
            want.append(tuple(map(float, after.split())))
    (folder / "sdr_log").write_text("\n".join(text))
    for size in SIZES:
        split_size(size)
        lines = ln.read_lines(spark, f"{tmp_path}/*/*/sdr_log")
        for source in (lines, lines.where(monitor.relevant(F.col("line")))):
            got = monitor.cpu_rows(source).orderBy("block_pos").select(*CPU_COLUMNS).collect()
            assert [tuple(r) for r in got] == want


def test_block_numbers_do_not_depend_on_the_cuts(spark, split_size, tmp_path, monkeypatch):
    rng = random.Random(4)
    text = [rng.choice(["CST ==", "x", "y" * 90]) for _ in range(500)]
    (tmp_path / "log").write_text("\n".join(text) + "\n")
    blocks = np.cumsum([line == "CST ==" for line in text]).tolist()
    for size in SIZES:
        for bits in (6, 10, 22):
            monkeypatch.setattr(ln, "CHUNK_BITS", bits)
            split_size(size)
            got = ln.number_blocks(ln.read_lines(spark, f"{tmp_path}/log"), monitor.is_header(F.col("line"))).orderBy("pos")
            rows = got.collect()
            assert [(r.line, r.block, r.n_blocks) for r in rows] == [(t, b, blocks[-1]) for t, b in zip(text, blocks)]


def test_all_records_from_one_reading(spark, split_size, tmp_path, monkeypatch):
    from rackmeter.operators import rollup
    from rackmeter.plans import fleet
    from rackmeter.schemas import YARN_COLUMNS
    from test_blocks import make_dump

    rng = random.Random(6)
    for k, blocks in enumerate([60, 3, 1, 0]):
        folder = tmp_path / "0711-24H" / f"tdw-10-0-0-{k}"
        folder.mkdir(parents=True)
        text = make_dump(rng, blocks) if blocks else ["no header", "avg-cpu: x", "1.0 2.0 3.0 4.0 5.0 6.0"]
        for at in sorted(rng.sample(range(len(text)), min(len(text), 12)), reverse=True):
            text[at:at] = rng.choice([["Tue Jul 11 00:00:01 CST 2017 now MR 10/12 SQL 8/9 SCALA 2/3"], ["avg-cpu: x", "cut off"]])
        (folder / f"sdr_log_{k}").write_text("\n".join(text) + "\n")
    for size in SIZES[1:]:
        for bits in (5, 9, 22):
            monkeypatch.setattr(ln, "CHUNK_BITS", bits)
            split_size(size)
            dumps = ln.read_lines(spark, f"{tmp_path}/*/*/sdr_log*")
            one = {r.ip: r for r in monitor.server_means(dumps).collect()}
            util = {r.ip: r for r in fleet.utilisation_means(monitor.cpu_rows(dumps), monitor.count_rows(dumps)).collect()}
            yarn = {r.ip: r for r in rollup.host_means(monitor.sample_blocks(dumps, full=False)).collect()}
            assert set(util) | set(yarn) == {ip for ip, r in one.items() if r.has_util or r.has_yarn}
            for ip, row in one.items():
                assert (row.has_util, row.has_yarn) == (True if ip in util else None, True if ip in yarn else None)
                for c in ("avg_user", "avg_sys", "avg_idle", "avg_vcore"):
                    assert row[c] == pytest.approx(util[ip][c]) if ip in util and util[ip][c] is not None else row[c] is None
                for c in YARN_COLUMNS:
                    assert row[c] == pytest.approx(yarn[ip][c]) if ip in yarn else row[c] is None
    plan = monitor.server_means(dumps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan byte_lines") == 1
