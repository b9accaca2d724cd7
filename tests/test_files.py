"""Seeking planners, cursors, the command line and the text forms of plans."""

import random

import pytest

from spanforge import cli, streaming
from spanforge.model import Plan, PlanError, Range, as_byte, as_parts, as_path
from spanforge.plans import files
from spanforge.sources import tsv

from . import semantics as S


def write(folder, name, data):
    path = folder / name
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("seed", range(6))
def test_plans_match_the_plain_planners(tmp_path, seed, monkeypatch):
    monkeypatch.setattr(files, "FIRST_BLOCK", 3)
    monkeypatch.setattr(files, "LARGEST_BLOCK", 5)
    rng = random.Random(seed)
    for case in range(60):
        data = [bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 5))]
        paths = [write(tmp_path, f"{case}-{k}", d) for k, d in enumerate(data)]
        parts, size, pattern = rng.choice([1, 2, 3, 7, 1000]), rng.choice([0, 1, 4, 9]), rng.choice([b"\n", b"a\n", b"aa"])
        plan = files.plan_file(paths[0], parts)
        assert [(r.start, r.end) for r in plan.ranges] == S.partition(data[0], parts, 10)
        assert [(w.worker_index, w.source_index, w.start, w.end) for w in files.plan_files(paths, parts)] == S.multi(data, parts, 10)
        with streaming.RangeCursor(paths[0], size, pattern) as cursor:
            assert cursor.size_hint() == ((1, len(data[0])) if data[0] else (0, 0))
            assert list(cursor) == S.delimited(data[0], size, pattern)
            assert cursor.is_exhausted and cursor.size_hint() == (0, 0)


def test_planning_does_not_read_the_file_through(tmp_path):
    path = write(tmp_path, "big", (b"x" * 99 + b"\n") * 50_000)
    read = 0

    class Counting:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            return self.f.seek(at)

        def read(self, n):
            nonlocal read
            out = self.f.read(n)
            read += len(out)
            return out

    with open(path, "rb") as f:
        cuts = files.partition_cuts(Counting(f), 5_000_000, 8, 10)
    assert len(cuts) == 8 and read <= 7 * files.FIRST_BLOCK


def test_a_file_named_twice_is_two_sources(tmp_path):
    path = write(tmp_path, "a", b"a\n")
    assert [w.row() for w in files.plan_files([path, path], 2)] == [(0, 0, 0, 2, 2), (1, 1, 0, 2, 2)]


def test_errors(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.plan_file(tmp_path / "none", 2)
    with pytest.raises(IsADirectoryError):
        files.plan_file(tmp_path, 2)
    path = write(tmp_path, "a", b"a\n")
    for bad in (0, -1):
        with pytest.raises(ValueError):
            files.plan_file(path, bad)
    for bad in (True, 1.0, "2"):
        with pytest.raises(TypeError):
            as_parts(bad)
    for bad in (True, -1, 256, b"", b"ab"):
        with pytest.raises(ValueError):
            as_byte(bad)
    with pytest.raises(TypeError):
        as_byte("a")
    assert as_byte(b"\xff") == 255
    with pytest.raises(ValueError):
        as_path("a\0b")
    with pytest.raises(TypeError):
        as_path(3)
    with pytest.raises(ValueError):
        Range(0, 4, 3)
    assert Range(0, 4, 4).length == 0
    broken = Plan(path, 2, 1, 10, (Range(0, 0, 1),))
    with open(path, "rb") as f, pytest.raises(PlanError):
        files.check_plan(broken, f)


def test_range_for_part(tmp_path):
    plan = files.plan_file(write(tmp_path, "a", b"x" * 32 + b"\nsmall\n"), 8)
    assert plan.actual_partitions == 2 and plan.range_for_part(1).row() == (1, 33, 39, 6) and plan.range_for_part(5) is None


def test_reading_ranges(tmp_path):
    data = b"ab\nc\n\nlast"
    path = write(tmp_path, "a", data)
    assert b"".join(streaming.read_range(path, 1, 6, 2)) == data[1:6]
    assert list(streaming.read_records(path, 3, 10)) == [b"c\n", b"\n", b"last"]
    with pytest.raises(OSError, match="short read"):
        list(streaming.read_range(path, 0, 99))
    with pytest.raises(OSError, match="splits"):
        list(streaming.read_records(path, 0, 8))


def test_checksum_of_chunks_does_not_depend_on_the_cuts():
    assert streaming.checksum([b"foobar"]) == streaming.checksum([b"foo", b"", b"bar"]) == 0x85944171F73967E8


def test_text_forms(spark, tmp_path):
    path = write(tmp_path, "a", b"a\nb\nc\n")
    text = tsv.ranges_tsv(files.plan_file(path, 6).ranges)
    assert text == "0\t0\t2\t2\n1\t2\t4\t2\n2\t4\t6\t2\n"
    assert tsv.ranges_tsv(tsv.parse_ranges(text)) == text
    rows = files.plan_files([path, path], 2)
    assert tsv.parse_worker_ranges(tsv.worker_ranges_tsv(rows)) == rows
    for bad in ("0\t1\n", "0\ta\t2\t2\n", "0\t-1\t2\t3\n"):
        with pytest.raises(ValueError):
            tsv.parse_ranges(bad)
    with pytest.raises(AssertionError):
        tsv.parse_ranges("0\t0\t2\t3\n")
    held = write(tmp_path, "plan.tsv", text.encode())
    assert tsv.read_ranges(spark, held).count() == 3
    wrong = write(tmp_path, "wrong.tsv", b"0\t0\t2\t3\n")
    with pytest.raises(Exception, match="length"):
        tsv.read_ranges(spark, wrong).collect()


def test_command_line(tmp_path, capsys, monkeypatch):
    a, b = write(tmp_path, "a", b"a\nb\n"), write(tmp_path, "b", b"c\n")
    assert cli.run(["partition", a, "--parts", "4"]) == "0\t0\t2\t2\n1\t2\t4\t2\n"
    assert cli.run(["partition", "--parts", "4", a, "--worker", "3"]) == ""
    assert cli.run(["partition-files", "--parts", "2", "--delimiter-byte", "010", a, b]) == "0\t0\t0\t4\t4\n1\t1\t0\t2\t2\n"
    assert cli.run(["--version"]).startswith("spanforge")
    for bad in (
        [], ["nope"], ["partition", a], ["partition", "--parts", "2"], ["partition", a, b, "--parts", "2"], ["partition", a, "--parts", "0"], ["partition", a, "--parts", "+2"],
        ["partition", a, "--parts", "2", "--parts", "2"], ["partition", a, "--parts"], ["partition", a, "--parts", "2", "--worker", "2"], ["partition", a, "--parts", "2", "--delimiter-byte", "256"],
        ["partition", a, "--parts", "2", "--delimiter-byte", "0x0a"], ["partition-files", "--parts", "2", "--worker", "0", a], ["partition", a, "--parts", "2", "--what"],
    ):
        with pytest.raises(cli.Usage):
            cli.run(bad)
    monkeypatch.setattr("sys.argv", ["x", "partition-files", "--parts", "2", a, str(tmp_path / "none")])
    assert cli.main() != 0
    out = capsys.readouterr()
    assert out.out == "" and out.err
