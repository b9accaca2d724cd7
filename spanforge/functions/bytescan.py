"""Searching, cutting and planning ranges in BINARY columns, as expressions that stay in the JVM.

A binary value is looked at as ISO-8859-1 text: one character is one byte, so that positions and lengths of
string functions are those of bytes. All offsets are bytes from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import as_byte, as_parts, as_pattern

#: Bytes that a search from a given place looks at first, before it takes the rest of the value.
SEARCH_BLOCK = 4096
#: Up to so many parts each aim is searched for; a search costs about as much as a look at a thousandth of the records.
FEW_PARTS = 256
RANGES = "array<struct<start:bigint,end_exclusive:bigint>>"


def utf8(text: Column) -> Column:
    """The bytes of a string column."""
    return text.cast("binary")


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def byte_length(data: Column) -> Column:
    return F.octet_length(data).cast("long")


def _quoted(pattern: bytes) -> str:
    return "".join(f"\\x{b:02x}" for b in pattern)


def _overlaps_itself(pattern: bytes) -> bool:
    return any(pattern[k:] == pattern[:-k] for k in range(1, len(pattern)))


def find_first(data: Column, pattern, start: int | Column = 0) -> Column:
    """Offset of the first occurrence at or after start, or null."""
    text = as_pattern(pattern).decode("latin-1")
    begin = (F.lit(start) if isinstance(start, int) else start).cast("int") + 1
    found = F.call_function("locate", F.lit(text), latin1(data), begin)
    return F.when(found > 0, (found - 1).cast("long"))


def find_from(data: Column, byte: int, at: Column) -> Column:
    """Offset behind the first such byte at or after `at`, or 0: it looks from there on, in a block and then in the rest."""
    mark = F.lit(chr(byte))

    def inside(start: Column, length) -> Column:
        return F.call_function("locate", mark, latin1(F.substring(data, (start + 1).cast("int"), F.lit(length)))).cast("long")

    near = inside(at, SEARCH_BLOCK)
    far = F.when(at + SEARCH_BLOCK < byte_length(data), inside(at + SEARCH_BLOCK, (1 << 31) - 1)).otherwise(F.lit(0).cast("long"))
    return F.when(near > 0, at + near).when(far > 0, at + SEARCH_BLOCK + far).otherwise(F.lit(0).cast("long"))


def count_of(data: Column, pattern) -> Column:
    """How many times the pattern occurs, without overlaps."""
    return (F.size(F.split(latin1(data), _quoted(as_pattern(pattern)), -1)) - 1).cast("long")


def _pieces(data: Column, pattern: bytes) -> Column:
    """Lengths of what lies between occurrences. Of a pattern that can overlap itself every occurrence counts, and the
    pieces begin with it; one at offset 0 is left out, which no plan can cut at."""
    regex = f"(?={_quoted(pattern)})" if _overlaps_itself(pattern) else _quoted(pattern)
    return F.transform(F.split(latin1(data), regex, -1), lambda p: F.length(p).cast("long"))


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end_exclusive"))


def _div(a: Column, b: Column) -> Column:
    """a div b of integers: exact, unlike the quotient of doubles. A value has at most 2 ** 31 bytes, so products fit."""
    return F.round((a - F.pmod(a, b)) / b).cast("long")


def _closed(state: Column, length: Column) -> Column:
    """The ranges so far and what is left behind the last cut."""
    last = F.filter(F.array(_range(state["start"], length)), lambda r: r["start"] < r["end_exclusive"])
    return F.concat(state["out"], last)


def delimited_ranges(data: Column, chunk_size: int, pattern=b"\n") -> Column:
    """Ranges of at least chunk_size bytes that end with the first delimiter found at or after that size; the last range takes the rest.

    chunk_size 0 counts as 1. A delimiter begins at or after start + chunk_size; any occurrence counts, overlapping ones too.
    One fold over the pieces: it appends for each range, not for each record.
    """
    pattern = as_pattern(pattern)
    step, width, overlapping = max(int(chunk_size), 1), len(pattern), _overlaps_itself(pattern)
    step = min(step, 1 << 40)
    pieces = _pieces(data, pattern)
    zero = F.lit(0).cast("long")
    begin = F.struct(zero.alias("at"), zero.alias("start"), F.array().cast(RANGES).alias("out"), byte_length(data).alias("size"))

    def fold(state: Column, piece: Column) -> Column:
        found = state["at"] + piece  # where the delimiter begins; behind the last piece there is none
        end = found + width
        cut = (found >= state["start"] + step) & (end <= state["size"])
        return F.struct(
            (found if overlapping else end).alias("at"),
            F.when(cut, end).otherwise(state["start"]).alias("start"),
            F.when(cut, F.array_append(state["out"], _range(state["start"], end))).otherwise(state["out"]).alias("out"),
            state["size"].alias("size"),
        )

    return F.aggregate(pieces, begin, fold, lambda s: _closed(s, s["size"]))


def fixed_count(data: Column, chunk_size: int) -> Column:
    """ceil(length / chunk_size); chunk_size 0 counts as 1."""
    step = min(max(int(chunk_size), 1), 1 << 40)
    return F.ceil(byte_length(data) / F.lit(float(step))).cast("long")


def fixed_ranges(data: Column, chunk_size: int) -> Column:
    step = F.lit(min(max(int(chunk_size), 1), 1 << 40)).cast("long")
    size = byte_length(data)
    count = fixed_count(data, chunk_size)
    some = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long"))), lambda i: _range(i * step, F.least((i + 1) * step, size)))
    return F.when(size > 0, some).otherwise(F.array().cast(RANGES))


def fixed_bounds(data: Column, chunk_size: int, index: int) -> Column:
    """The range with that index, or null; by arithmetic, without the others."""
    step, size = min(max(int(chunk_size), 1), 1 << 40), byte_length(data)
    start = F.lit(index * step).cast("long")
    return F.when(start < size, _range(start, F.least(start + step, size)))


def partition_ranges(data: Column, parts: int, delimiter=0x0A) -> Column:
    """At most parts ranges that end with a delimiter (the last with the data), near equal cuts of the length.

    Cut i aims at floor(length * i / parts) and moves to the end of the record that holds that byte; an aim at or before the
    last cut is passed over. Few parts are folded over the aims, each with one search; many parts over the records: of the
    aims in a record only the greatest can cut it, so each record is decided by arithmetic.
    """
    parts, byte = as_parts(parts), as_byte(delimiter)
    size = byte_length(data)
    n = F.least(F.lit(min(parts, 1 << 31)).cast("long"), F.greatest(size, F.lit(1).cast("long")))
    zero = F.lit(0).cast("long")
    if parts <= FEW_PARTS:
        # size, n and the bytes travel in the state: as expressions over data they would be worked out anew for every aim
        first = F.struct(zero.alias("start"), F.array().cast(RANGES).alias("out"), size.alias("size"), n.alias("n"), data.alias("data"))

        def search(state: Column, i: Column) -> Column:
            aim = _div(state["size"] * i, state["n"])
            due = (i < state["n"]) & (aim > state["start"])
            end = F.when(due, find_from(state["data"], byte, aim)).otherwise(zero)
            cut = due & (end > 0) & (end < state["size"])
            return F.struct(
                F.when(cut, end).otherwise(state["start"]).alias("start"),
                F.when(cut, F.array_append(state["out"], _range(state["start"], end))).otherwise(state["out"]).alias("out"),
                state["size"].alias("size"), state["n"].alias("n"), state["data"].alias("data"),
            )

        aims = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), lambda i: i > 0)
        return F.aggregate(aims, first, search, lambda s: _closed(s, s["size"]))
    pieces = _pieces(data, bytes([byte]))
    begin = F.struct(zero.alias("at"), zero.alias("start"), F.array().cast(RANGES).alias("out"), size.alias("size"), n.alias("n"))

    def fold(state: Column, piece: Column) -> Column:
        end = state["at"] + piece + 1
        i = F.least(_div(end * state["n"] - 1, F.greatest(state["size"], F.lit(1).cast("long"))), state["n"] - 1)
        aim = _div(state["size"] * i, state["n"])
        cut = (i >= 1) & (aim >= state["at"]) & (aim > state["start"]) & (end < state["size"])
        return F.struct(
            end.alias("at"),
            F.when(cut, end).otherwise(state["start"]).alias("start"),
            F.when(cut, F.array_append(state["out"], _range(state["start"], end))).otherwise(state["out"]).alias("out"),
            state["size"].alias("size"),
            state["n"].alias("n"),
        )

    return F.aggregate(pieces, begin, fold, lambda s: _closed(s, s["size"]))


def payload(data: Column, start: Column, length: Column) -> Column:
    """The bytes of a range."""
    return F.substring(data, (start + 1).cast("int"), length.cast("int"))


def records(data: Column, delimiter=0x0A, strict: bool = False) -> Column:
    """array<binary>: the data cut at the delimiter, without it; one empty record at the end is dropped. Inner empty ones stay, or fail if strict."""
    cut = F.split(latin1(data), _quoted(bytes([as_byte(delimiter)])), -1)
    full = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    if strict:
        full = F.when(F.array_contains(full, ""), F.raise_error(F.lit("the range holds an empty record"))).otherwise(full)
    return F.transform(full, lambda r: F.encode(r, "ISO-8859-1"))


def without_carriage_return(line: Column) -> Column:
    """A text line without one trailing carriage return."""
    return F.regexp_replace(line, "\\r$", "")
