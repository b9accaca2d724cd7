"""Driver-side planners that seek in files. None reads a file through unless its delimiters are that sparse."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from typing import BinaryIO

from ..model import Plan, PlanError, Range, WorkerRange, as_byte, as_parts, as_path, as_pattern

FIRST_BLOCK, LARGEST_BLOCK = 1 << 16, 1 << 20


def open_source(path: str) -> BinaryIO:
    """A local file, or one of a file system that pyarrow knows by its URI."""
    if "://" not in path:
        return open(path, "rb")  # noqa: SIM115
    import pyarrow.fs as fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def source_size(path: str) -> int:
    """The size of a regular file; FileNotFoundError, IsADirectoryError or PlanError for anything else."""
    if "://" in path:
        import pyarrow.fs as fs

        store, inner = fs.FileSystem.from_uri(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type != fs.FileType.File:
            raise IsADirectoryError(path)
        return info.size
    mode = os.stat(path)
    if stat.S_ISDIR(mode.st_mode):
        raise IsADirectoryError(path)
    if not stat.S_ISREG(mode.st_mode):
        raise PlanError(f"not a regular file: {path}")
    return mode.st_size


def find_from(f: BinaryIO, at: int, pattern: bytes, size: int) -> int | None:
    """Offset of the first occurrence of pattern at or after at, in blocks that grow; None if there is none."""
    block, keep = FIRST_BLOCK, len(pattern) - 1
    f.seek(at)
    tail = b""
    while at < size:
        data = f.read(min(block, size - at))
        if not data:
            raise OSError(f"short read at {at}: the file has shrunk from {size} bytes")
        data = tail + data
        found = data.find(pattern)
        if found >= 0:
            return at - len(tail) + found
        at += len(data) - len(tail)
        tail = data[len(data) - keep :] if keep else b""
        block = min(2 * block, LARGEST_BLOCK)
    return None


def delimited(f: BinaryIO, size: int, chunk_size: int, pattern=b"\n", start: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of at least chunk_size bytes up to the next delimiter, one after another: the state is one offset."""
    pattern, step = as_pattern(pattern), max(int(chunk_size), 1)
    while start < size:
        aim = start + step
        found = find_from(f, aim, pattern, size) if aim < size else None
        end = size if found is None else found + len(pattern)
        yield start, end
        start = end


def fixed_count(size: int, chunk_size: int) -> int:
    return -(-size // max(int(chunk_size), 1))


def fixed_bounds(size: int, chunk_size: int, index: int) -> tuple[int, int] | None:
    step = max(int(chunk_size), 1)
    return (index * step, min((index + 1) * step, size)) if 0 <= index < fixed_count(size, step) else None


def fixed(size: int, chunk_size: int) -> Iterator[tuple[int, int]]:
    step = max(int(chunk_size), 1)
    return ((s, min(s + step, size)) for s in range(0, size, step))


def partition_cuts(f: BinaryIO, size: int, parts: int, delimiter: int) -> list[tuple[int, int]]:
    """At most parts contiguous ranges: each inner edge is the end of the record that holds floor(size * i / parts)."""
    n, last, out = min(parts, size), 0, []
    for i in range(1, n):
        aim = size * i // n
        if aim <= last:  # also where it is equal: that cut is made
            continue
        found = find_from(f, aim, bytes([delimiter]), size)
        if found is None or found + 1 == size:
            break
        out.append((last, found + 1))
        last = found + 1
    return [*out, (last, size)] if last < size else out


def plan_file(path, parts: int, delimiter=0x0A) -> Plan:
    """A record-aligned plan of one file, checked for coverage and alignment."""
    name, parts, byte = as_path(path), as_parts(parts), as_byte(delimiter)
    size = source_size(name)
    with open_source(name) as f:
        cuts = partition_cuts(f, size, parts, byte)
        plan = Plan(name, size, parts, byte, tuple(Range(i, s, e) for i, (s, e) in enumerate(cuts)))
        check_plan(plan, f)
    return plan


def check_plan(plan: Plan, f: BinaryIO) -> None:
    """PlanError unless the ranges cover the file without gaps and begin and end with records: reads one byte an edge."""
    at = 0
    for r in plan.ranges:
        if r.start != at:
            raise PlanError(f"range {r.index} begins at {r.start}, not at {at}")
        at = r.end
        if r.end < plan.file_size:
            f.seek(r.end - 1)
            if f.read(1) != bytes([plan.delimiter]):
                raise PlanError(f"range {r.index} does not end with the delimiter")
    if at != plan.file_size:
        raise PlanError(f"the ranges cover {at} of {plan.file_size} bytes")


def plan_files(paths: Sequence, parts: int, delimiter=0x0A) -> list[WorkerRange]:
    """An ordered list of files shared out to at most parts workers. All files are opened before anything is planned;
    a file named twice is two sources. A file's end ends a record; aims at a file's start stay there."""
    names, parts, byte = [as_path(p) for p in paths], as_parts(parts), as_byte(delimiter)
    sizes = [source_size(n) for n in names]
    for n in names:
        open_source(n).close()
    total = sum(sizes)
    if not total:
        return []
    begins, at = [], 0
    for s in sizes:
        begins.append(at)
        at += s
    n, last, cuts, source = min(parts, total), 0, [], 0
    held: tuple[int, int, int] | None = None  # the last search: source, from, to
    for i in range(1, n):
        aim = total * i // n
        if aim <= last:
            continue
        while begins[source] + sizes[source] <= aim:
            source += 1
        local = aim - begins[source]
        if local == 0:
            edge = aim
        else:
            if held is None or held[0] != source or not held[1] <= local < held[2]:
                with open_source(names[source]) as f:
                    found = find_from(f, local, bytes([byte]), sizes[source])
                held = (source, local, sizes[source] if found is None else found + 1)
            edge = begins[source] + held[2]
        if edge <= last:
            continue
        if edge == total:
            break
        cuts.append(edge)
        last = edge
    out, source, edges = [], 0, [0, *cuts, total]
    for w, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        while source < len(sizes):
            a, b = max(s, begins[source]), min(e, begins[source] + sizes[source])
            if a < b:
                out.append(WorkerRange(w, source, a - begins[source], b - begins[source]))
            if begins[source] + sizes[source] > e:
                break
            source += 1
    return out


def list_files(path: str) -> list[str]:
    """The data files of a folder that Spark wrote, in order of name."""
    name = as_path(path)
    if "://" not in name:
        return sorted(os.path.join(name, x) for x in os.listdir(name) if x[0] not in "._")
    import pyarrow.fs as fs

    store, inner = fs.FileSystem.from_uri(name)
    scheme = name.split("://")[0]
    return sorted(f"{scheme}://{x.path}" for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file and x.base_name[0] not in "._")
