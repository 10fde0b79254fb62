"""UTF-16 tables in byte ranges against Spark's whole-file reader."""

import random

import pytest

from hireplane.sources import readers, utf16


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def set_to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_to
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def whole(spark, path):
    raw = spark.read.csv(str(path), sep="\t", encoding="UTF-16", header=True, multiLine=True)
    return sorted(map(repr, raw.collect()))


def cell(rng, alphabet):
    text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
    return f'"{text}"' if "\n" in text or rng.random() < 0.2 else text


def table(rng, alphabet, rows, end):
    lines = ["name\tyear\tcount"] + ["\t".join([cell(rng, alphabet), str(i), cell(rng, alphabet)]) for i in range(rows)]
    return end.join(lines) + end


@pytest.mark.parametrize("alphabet", ["abc é漢", "ab\n", "ਊĀ一ઊ a\n", "😀ਅĀb"])
@pytest.mark.parametrize("code", ["utf-16-le", "utf-16-be"])
def test_equals_the_whole_file_reader(spark, tmp_path, small_ranges, alphabet, code):
    rng = random.Random(5)
    text = table(rng, alphabet, 120, "\n")
    mark = b"\xff\xfe" if code.endswith("le") else b"\xfe\xff"
    file = tmp_path / "t.csv"
    file.write_bytes(mark + text.encode(code))
    want = whole(spark, file)
    assert len(want) == 120
    for size in (64, 333, 1000, 10**6):
        small_ranges(size)
        got = utf16.read_utf16_table(spark, str(file))
        assert got.columns == ["name", "year", "count"]
        assert sorted(map(repr, got.collect())) == want, size


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_ranges):
    file = tmp_path / "t.csv"
    file.write_bytes(b"\xff\xfe" + table(random.Random(1), "abcdef", 3000, "\r\n").encode("utf-16-le"))
    want = whole(spark, file)
    small_ranges(20_000)
    got = utf16.read_utf16_table(spark, str(file))
    assert got.rdd.getNumPartitions() > 4
    assert sorted(map(repr, got.collect())) == want


def test_a_cell_longer_than_ranges(spark, tmp_path, small_ranges):
    body = 'a\tb\nx\t"' + "\n".join(f"line {i}" for i in range(400)) + '"\ny\tz\n'
    file = tmp_path / "t.csv"
    file.write_bytes(b"\xfe\xff" + body.encode("utf-16-be"))
    small_ranges(500)
    got = {r.a: r.b for r in utf16.read_utf16_table(spark, str(file)).collect()}
    assert got == {"x": "\n".join(f"line {i}" for i in range(400)), "y": "z"}


def test_files_of_both_orders_short_rows_and_blank_lines(spark, tmp_path):
    (tmp_path / "1.csv").write_bytes(b"\xff\xfe" + "a\tb\tc\n1\t2\t3\n\n4\n5\t6\t7\t8".encode("utf-16-le"))
    (tmp_path / "2.csv").write_bytes(b"\xfe\xff" + "a\tb\tc\r\n9\t\t\"q\"\"q\"\r\n".encode("utf-16-be"))
    got = sorted(map(tuple, utf16.read_utf16_table(spark, str(tmp_path)).collect()), key=str)
    quoted = spark.read.csv(str(tmp_path / "2.csv"), sep="\t", encoding="UTF-16", header=True, multiLine=True).first().c
    assert got == [("1", "2", "3"), ("4", None, None), ("5", "6", "7"), ("9", None, quoted)]


def test_petitions_by_ranges(spark, tmp_path, small_ranges):
    head = "Employer (Petitioner) Name \tFiscal Year\tNew Employment Approval"
    rows = "".join(f"Acme {i % 7}, Inc.\t2024\t{i % 3}\r\n" for i in range(500))
    (tmp_path / "u.csv").write_bytes(f"{head}\r\n{rows}".encode("utf-16"))
    want = sorted(map(tuple, readers.read_uscis(spark, str(tmp_path / "u.csv"), split=False).collect()))
    small_ranges(3000)
    got = readers.read_uscis(spark, str(tmp_path / "u.csv"))
    assert got.columns[0] == "Employer (Petitioner) Name" and got.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("little", [True, False])
def test_states_of_many_records_at_once(little):
    """What is said after each record equals reading them character by character, cut anywhere."""
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        records = [bytes(rng.choice([0, 0x22, 0x41]) for _ in range(rng.randint(0, 7))) for _ in range(6)]
        bounds = np.cumsum([0] + [len(r) for r in records])
        for shift, quoted in ((0, 0), (0, 1), (1, 0), (1, 1)):
            got = utf16._Records("f", 0, np.frombuffer(b"".join(records), np.uint8), bounds).after(shift, quoted, little)
            want, s, q = [], shift, quoted
            for r in records:
                pairs = [r[n : n + 2] for n in range(s, len(r) - 1, 2)]
                q ^= pairs.count(b'"\0' if little else b'\0"') & 1
                s = (s + len(r)) & 1
                want.append((s, q))
            assert list(zip(*[g.tolist() for g in got])) == want


def test_whole_lines_are_read_as_arrays(spark, tmp_path, monkeypatch):
    """Plain lines are not handled one by one."""
    import pyarrow as pa

    text = "".join(f"row {i}\n" for i in range(50)).encode("utf-16-le")
    lines = text.split(b"\n\0")[:-1]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["f"] * 50), pa.array([128] * 50), pa.array(lines, pa.binary())], names=["file", "start", "value"]
    )
    states = type("B", (), {"value": {("f", 128): (0, 0, 0)}})
    got = list(utf16._read_ranges(True, states)(iter([batch])))
    assert len(got) == 1 and got[0].column("line").to_pylist() == [f"row {i}" for i in range(50)]
    assert got[0].column("file").null_count == 50


def test_a_header_within_one_range_is_read_from_it(spark, tmp_path, monkeypatch):
    (tmp_path / "t.csv").write_bytes(b"\xff\xfe" + "a\tb\n1\t2\n".encode("utf-16-le"))
    real, asked = utf16.utf16_lines, []

    def lines(*args):
        whole, crossing = real(*args)
        monkeypatch.setattr(crossing, "where", lambda c: asked.append(c), raising=False)
        return whole, crossing

    monkeypatch.setattr(utf16, "utf16_lines", lines)
    assert utf16.read_utf16_table(spark, str(tmp_path)).columns == ["a", "b"] and not asked
