"""Block assembly against a plain line-by-line reading of invented dumps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rackmeter.schemas import CPU_COLUMNS, MEM_COLUMNS, SWAP_COLUMNS, YARN_COLUMNS
from rackmeter.sources import lines as ln
from rackmeter.sources import monitor

ALL = CPU_COLUMNS + YARN_COLUMNS + MEM_COLUMNS + SWAP_COLUMNS
LABELS = ["Containers", "Memory-Used", "Memory-Capacity", "CPU-Used", "CPU-Capacity"]


def make_dump(rng, blocks):
    out = []
    for k in range(blocks):
        if rng.random() < 0.1 or k == 0:
            out.append("Containers : 777" if rng.random() < 0.5 else "noise before")
        out.append(f"== Tue Jul {rng.choice([' 1', '11'])} {k // 60 % 24:02d}:{k % 60:02d}:01 CST 2017 ==")
        body = []
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            cpu = [f"{rng.uniform(0, 99):.2f}" for _ in range(5)] + [rng.choice(["100.00", "3.50"])]
            body.append(["avg-cpu:  %user   %nice %system %iowait  %steal   %idle", "    " + "   ".join(cpu)])
        for label, unit in zip(LABELS, ["", "MB", "MB", " vcores", " vcores"]):
            for _ in range(rng.choice([0, 1, 1, 2])):
                body.append([f"{label} : {rng.randrange(100000)}{unit}"])
        if rng.random() < 0.8:
            body.append(["Mem: " + " ".join(str(rng.randrange(999)) for _ in range(6))])
            body.append(["Swap:  " + "  ".join(str(rng.randrange(99)) for _ in range(3))])
        body += [["some other text"]] * rng.randrange(4)
        rng.shuffle(body)
        out += [line for group in body for line in group]
    return out


def read_plainly(lines, keep_last):
    rows, row = [], None
    for line in lines:
        if re.search("CST.*==", line):
            if row:
                rows.append(row)
            w = line.split()
            row = {"date": " ".join(w[1:7]), "hour": int(w[4].split(":")[0]), **{c: 0 for c in ALL}}
        elif row is None:
            continue
        elif re.search(r"(\d+\.\d+ *){6}", line):
            row.update(zip(CPU_COLUMNS, map(float, line.split()[:6])))
        elif any(label in line for label in LABELS):
            label = next(x for x in LABELS if x in line)
            row[YARN_COLUMNS[LABELS.index(label)]] = int(re.search(r":\s*(\d+)", line).group(1))
        elif "Mem:" in line:
            row.update(zip(MEM_COLUMNS, map(int, line.split()[1:7])))
        elif "Swap:" in line:
            row.update(zip(SWAP_COLUMNS, map(int, line.split()[1:4])))
    if row and keep_last:
        rows.append(row)
    return rows


@pytest.fixture
def dumps(tmp_path):
    rng = random.Random(7)
    made = {}
    # One server holds most of the data.
    for host, blocks in {"tdw-10-0-0-1": 120, "tdw-10-0-0-2": 3, "tdw-10-0-0-3": 1}.items():
        folder = tmp_path / "0711-24H" / host
        folder.mkdir(parents=True)
        made[host] = make_dump(rng, blocks)
        (folder / f"sdr_log_{host}_2017").write_text("\n".join(made[host]) + "\n")
    return tmp_path, made


@pytest.mark.parametrize("keep_last", [False, True])
@pytest.mark.parametrize("bits", [1, 4, 17])
def test_blocks_across_splits_and_chunks(spark, small_splits, dumps, monkeypatch, bits, keep_last):
    monkeypatch.setattr(ln, "CHUNK_BITS", bits)
    path, made = dumps
    lines = ln.read_lines(spark, f"{path}/*/tdw*/sdr_log*")
    assert lines.select("file", "split").distinct().count() > 20
    got = monitor.sample_blocks(lines, keep_last).orderBy("block_split", "block_pos").collect()
    for host, text in made.items():
        want = read_plainly(text, keep_last)
        mine = [{c: r[c] for c in ["date", "hour", *ALL]} for r in got if r["host"] == host]
        assert mine == want
    assert all(r["ts"].year == 2017 and r["run"] == "0711-24H" for r in got)


def test_missing_metric_can_stay_null(spark, dumps):
    path, _ = dumps
    lines = ln.read_lines(spark, f"{path}/*/tdw*/sdr_log*")
    zero = monitor.sample_blocks(lines)
    null = monitor.sample_blocks(lines, missing_as_zero=False)
    assert null.where(F.col("mem_total").isNull()).count() > 0
    assert zero.where(F.col("mem_total").isNull()).count() == 0


@pytest.mark.parametrize("bits", [1, 17])
def test_line_after_marker(spark, small_splits, dumps, monkeypatch, bits):
    monkeypatch.setattr(ln, "CHUNK_BITS", bits)
    path, made = dumps
    lines = ln.read_lines(spark, f"{path}/*/tdw*/sdr_log*")
    for source in (lines, lines.where(monitor.relevant(F.col("line")))):
        got = sorted(tuple(r) for r in monitor.cpu_rows(source).select("host", *CPU_COLUMNS).collect())
        want = sorted(
            (host, *map(float, text[i + 1].split()[:6]))
            for host, text in made.items() for i, line in enumerate(text) if "avg-cpu" in line
        )
        assert got == want


def test_marker_without_numbers_gives_nothing(spark, tmp_path):
    folder = tmp_path / "0711-24H" / "tdw-10-0-0-9"
    folder.mkdir(parents=True)
    (folder / "sdr_log").write_text("avg-cpu: x\ncut off\n1.0 2.0 3.0 4.0 5.0 6.0\navg-cpu: x\n6.0 5.0 4.0 3.0 2.0 1.0\n")
    rows = monitor.cpu_rows(ln.read_lines(spark, f"{tmp_path}/*/*/sdr_log")).collect()
    assert [r["cpu_user"] for r in rows] == [6.0]


@pytest.mark.parametrize("bits", [2, 17])
def test_numbering(spark, small_splits, dumps, monkeypatch, bits):
    monkeypatch.setattr(ln, "CHUNK_BITS", bits)
    path, made = dumps
    lines = ln.with_server(ln.read_lines(spark, f"{path}/*/tdw*/sdr_log*"))
    got = ln.number_lines(ln.number_blocks(lines, monitor.is_header(F.col("line")))).collect()
    for host, text in made.items():
        mine = sorted((r["line_no"], r["line"], r["block"], r["n_lines"]) for r in got if r["host"] == host)
        block, want = 0, []
        for i, line in enumerate(text, start=1):
            block += bool(re.search("CST.*==", line))
            want.append((i, line, block, len(text)))
        assert mine == want


def test_head_lines(spark, small_splits, dumps):
    path, made = dumps
    lines = ln.with_server(ln.read_lines(spark, f"{path}/*/tdw*/sdr_log*"))
    got = ln.head_lines(lines, 5)
    for host, text in made.items():
        mine = [r["line"] for r in got.where(F.col("host") == host).orderBy("line_no").collect()]
        assert mine == text[:5]


def test_counts_and_power(spark, tmp_path):
    folder = tmp_path / "0711-24H" / "tdw-10-0-0-9"
    folder.mkdir(parents=True)
    (folder / "sdr_log_tdw-10-0-0-9_2017").write_text(
        "Tue Jul 11 00:00:01 CST 2017 now MR 10/12 SQL 8/9 SCALA 2/3\n"
        "a b c d e f g Total Power 873\n"
        "mr_sparksql_scala_container_count\n"
        "1 2 3 4 5 6 7 8 11/12 SQL 7/9 SCALA 1/3\n"
    )
    lines = ln.read_lines(spark, f"{tmp_path}/*/*/sdr_log*")
    names = monitor.COUNT_COLUMNS + ["vcore_total"]
    new = monitor.count_rows(lines).select("ip", *names).collect()
    old = monitor.count_rows_after_marker(lines).select("ip", *names).collect()
    assert [tuple(r) for r in new] == [("10.0.0.9", 10, 12, 8, 9, 2, 3, 20)]
    assert [tuple(r) for r in old] == [("10.0.0.9", 11, 12, 7, 9, 1, 3, 19)]
    assert [(r["ip"], r["watt"]) for r in monitor.power_readings(lines).collect()] == [("10.0.0.9", 873.0)]
