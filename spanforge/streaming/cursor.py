"""Lazy cursors over files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from ..model import as_path, as_pattern
from ..plans.files import delimited, open_source, source_size

BLOCK = 1 << 20


class RangeCursor(Iterator):
    """The ranges of a delimited plan, each found when it is asked for. The same ranges as planned at once."""

    def __init__(self, path, chunk_size: int, pattern=b"\n"):
        self.path, self.size, self.position = as_path(path), source_size(as_path(path)), 0
        self.pattern = as_pattern(pattern)
        self._file = open_source(self.path)
        self._ranges = delimited(self._file, self.size, chunk_size, self.pattern)

    def __next__(self) -> tuple[int, int]:
        found = next(self._ranges)
        self.position = found[1]
        return found

    @property
    def remaining(self) -> int:
        return self.size - self.position

    @property
    def is_exhausted(self) -> bool:
        return self.remaining == 0

    def size_hint(self) -> tuple[int, int]:
        """The least and most ranges that can follow."""
        return (1, self.remaining) if self.remaining else (0, 0)

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> RangeCursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read_range(path, start: int, end: int, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a range in blocks; OSError if the file ends before it does."""
    with open_source(as_path(path)) as f:
        f.seek(start)
        at = start
        while at < end:
            data = f.read(min(block, end - at))
            if not data:
                raise OSError(f"short read: [{start}, {end}) stopped at {at}")
            at += len(data)
            yield data


def read_records(path, start: int, end: int, delimiter: int = 0x0A) -> Iterator[bytes]:
    """The records of a range, each with its delimiter, one at a time. OSError if the range ends within a record of the file."""
    mark, rest, at = bytes([delimiter]), b"", start
    for data in read_range(path, start, end):
        at += len(data)
        *full, rest = (rest + data).split(mark)
        for r in full:
            yield r + mark
    if rest:
        if at < source_size(as_path(path)):
            raise OSError(f"range [{start}, {end}) splits a record")
        yield rest


def checksum(chunks: Iterable[bytes]) -> int:
    """FNV-1a, 64 bits, over the chunks in order."""
    h = 0xCBF29CE484222325
    for chunk in chunks:
        for b in chunk:
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h
