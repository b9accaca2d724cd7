"""Secret scanning with a worklist that unwraps nested encodings until nothing new appears.

Every layer (the text, and whatever URL escapes, Unicode escapes, base64 blobs and
compressed blobs in it decode to) is scanned; spans found in a decoded layer are mapped to the
code points of the original text that produced them.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Runs of base64 characters over line breaks, plain or written as \\n, and one line of them.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n|[\r\n]|\\r\\n|\\n)[ \t]*+[A-Za-z0-9+/_-]++)++")
LINE_END = re.compile(r"([A-Za-z0-9+/_-]++)(?:[ \t]*+(?:\r\n|[\r\n]|\\r\\n|\\n)[ \t]*+)?")
#: Bytes in URL form; those that need no quoting may stand plainly.
QUOTED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/!*'()@+^-])++")
UNIT = re.compile(r"%..|.")
VISIBLE = re.compile(rb"[\x20-\x7e\t\r\n]{12}")
MAGIC = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00")
#: A decompressed layer above this many bytes is scanned in blocks that overlap by a quarter, and counted in n_unopened, as what is
#: encoded in it is opened only where it lies within a block.
MAX_LAYER_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20

END = object()
Layer = tuple[str, "np.ndarray | None", "np.ndarray | None"]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every secret that stands plainly in text."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _tool(blob: bytes):
    """What decompresses a gzip, zlib, bzip2 or xz blob; None if it is none of these."""
    if blob[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if blob[:1] == b"\x78" and len(blob) > 2 and (blob[0] * 256 + blob[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if blob[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if blob[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _decompress(blob: bytes, limit: int) -> tuple[bytes, int, bool] | None:
    """(content of all members of a compressed blob, bytes read, whether it is whole); None if it is none. OverflowError beyond limit."""
    out, size, rest, tool = [], 0, blob, _tool(blob)
    if tool is None:
        return None
    while True:
        try:
            out.append(tool.decompress(rest, limit + 1 - size))
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return (b"".join(out), len(blob), False) if out else None
        size += len(out[-1])
        if size > limit:
            raise OverflowError
        if not tool.eof:
            return b"".join(out), len(blob), False
        used = len(blob) - len(tool.unused_data)
        rest = tool.unused_data.lstrip(b"\0")  # padding between members
        tool = _tool(rest)
        if tool is None:
            return b"".join(out), used, True


def _inflated(source: Iterator[bytes], piece: int) -> Iterator[bytes]:
    """The content of all members of a compressed blob that comes in pieces, in pieces; it ends where the blob breaks off."""
    tool, data = None, b""
    for more in source:
        data += more
        while data:
            if tool is None:
                if len(data) < 6:
                    break
                if (tool := _tool(data)) is None:
                    return
            while True:
                try:
                    out = tool.decompress(data, piece)
                except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                    return
                if out:
                    yield out
                if tool.eof:
                    tool, data = None, tool.unused_data.lstrip(b"\0")
                    break
                data = getattr(tool, "unconsumed_tail", b"")
                if not data and len(out) < piece:
                    break


def _blocks(blob: bytes, size: int) -> Iterator[str]:
    """The text in directly nested compressed layers of any size, in blocks that overlap by a quarter."""
    pieces: Iterator[bytes] = (blob[at : at + 65536] for at in range(0, len(blob), 65536))
    for _ in range(256):
        pieces = _inflated(pieces, 1 << 16)
        first = next(pieces, b"")
        pieces = chain([first], pieces)
        if _tool(first) is None:
            break
    held, begun = bytearray(), False
    for piece in chain(pieces, [b""]):
        held += piece
        if len(held) < size and piece:
            continue
        raw = bytes(held)
        skip = next((k for k in range(4) if len(raw) > k and raw[k] & 0xC0 != 0x80), 0) if begun else 0
        if (plain := _start_as_text(raw[skip:])) is not None:
            yield plain
        held, begun = held[len(held) - size // 4 :], True


def _as_text(raw: bytes) -> str | None:
    """raw as text if it is UTF-8 and nine tenths printable."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    good = sum(map(str.isprintable, text)) + text.count("\n") + text.count("\t") + text.count("\r")
    return text if text and good * 10 >= len(text) * 9 else None


def _start_as_text(raw: bytes) -> str | None:
    """As _as_text, of bytes that may end within a character; a character a byte if they are no text."""
    if VISIBLE.search(raw) is None:
        return None
    return next((t for k in range(4) if (t := _as_text(raw[: len(raw) - k])) is not None), None) or raw.decode("latin-1")


def _view(raw: bytes) -> tuple[str, np.ndarray] | None:
    """(raw as text, offset of each character's bytes): as UTF-8, or else a character a byte. None if no secret and no form of one
    can stand in it, as all take a dozen visible characters in a row."""
    if VISIBLE.search(raw) is None:
        return None
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1"), np.arange(len(raw) + 1)
    return text, _char_bytes(text)


def _base64_bytes(token: str) -> bytes | None:
    if len(token) % 4 == 1:
        return None
    try:
        return base64.b64decode(token.replace("-", "+").replace("_", "/") + "=" * (-len(token) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _wrapped(text: str) -> Iterator[list[list[tuple[int, int]]]]:
    """Base64 over several lines: for each place the [start, end) of the lines it may have, longest reading first. A blob is lines of one
    width and a shorter one; all lines of a run are tried as well, and so are those of one width only, as a word may follow."""
    for m in WRAPPED.finditer(text):
        lines, at = [], m.start()
        while at < m.end():
            one = LINE_END.match(text, at)
            lines.append((one.start(1), one.end(1)))
            at = one.end()
        width = [e - s for s, e in lines]
        readings: dict[int, list[list[tuple[int, int]]]] = {0: [lines]} if max(width) >= 12 else {}
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and width[j] == width[i]:
                j += 1
            if width[i] >= 12:
                mine = readings.setdefault(i, [])
                if j < len(lines) and width[j] < width[i]:
                    mine.append(lines[i : j + 1])
                if j - i > 1:
                    mine.append(lines[i:j])
            i = j
        yield from (x for x in readings.values() if x)


def _char_bytes(text: str) -> np.ndarray:
    """For each code point the offset of its first UTF-8 byte, and at the end the length."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate(([0], np.cumsum(size)))


def _replaced(layer: Layer, pieces: list[tuple[int, int, str, list[int]]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The layer with pieces (start, end, decoded, source offset of each decoded character, end last) put in."""
    text, starts, ends = layer
    parts, first, last, at = [], [], [], 0
    for s, e, new, offs in [*pieces, (len(text), len(text), "", [len(text)])]:
        keep = np.arange(at, s)
        parts += [text[at:s], new]
        first += [keep, np.asarray(offs[:-1], dtype=np.int64)]
        last += [keep, np.asarray(offs[1:], dtype=np.int64) - 1]
        at = e
    first, last = np.concatenate(first).astype(np.int64), np.concatenate(last).astype(np.int64)
    if starts is None:
        return "".join(parts), first, last + 1
    return "".join(parts), starts[first], ends[last]


def _unwrap(layer: Layer, limit: int) -> Iterator[tuple[str, np.ndarray, np.ndarray] | None]:
    """The layers directly inside; None for one that is too large to open or cut off."""
    text, starts, ends = layer

    opened: list[tuple[int, int]] = []
    shut: dict[int, int] = {}

    def all_of(plain: str, s: int, e: int) -> tuple[str, np.ndarray, np.ndarray]:
        a, b = (s, e) if starts is None else (starts[s], ends[e - 1])
        return plain, np.broadcast_to(np.int64(a), len(plain)), np.broadcast_to(np.int64(b), len(plain))

    def whole(inner: bytes, s: int, ends_at) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Of a compressed blob from s on: every character of the content maps to all of it. ends_at: where the first n bytes end."""
        try:
            got = _decompress(inner, limit)
            if got is None:
                return
            out, used, fine = got
            e = ends_at(used)
            if not fine and any(a <= s and e <= b for a, b in opened):
                return  # a piece of a blob that is open
            met = set()
            while (more := _decompress(out, limit)) is not None and (key := hashlib.blake2b(out).digest()) not in met:
                met.add(key)
                out, fine = more[0], fine and more[2]
        except OverflowError:
            shut[s] = e = ends_at(len(inner))
            for plain in _blocks(inner, min(limit, BLOCK_BYTES)):
                yield all_of(plain, s, e)
            return
        if fine:
            opened.append((s, e))
        elif _as_text(inner) is None:
            shut[s] = e
        if (plain := _start_as_text(out)) is not None:
            yield all_of(plain, s, e)

    if "%" in text:
        for m in QUOTED.finditer(text):
            if "%" not in m[0]:
                continue
            for form in dict.fromkeys((m[0].replace("+", " "), m[0])):  # a plus is a space in forms and itself elsewhere
                raw, at = unquote_to_bytes(form), 0
                units, before = None, len(opened)
                while (magic := MAGIC.search(raw, at)) is not None:
                    if units is None:
                        units = np.array([u.end() for u in UNIT.finditer(form)]) + m.start()
                    k = magic.start()
                    yield from whole(raw[k:], int(units[k - 1]) if k else m.start(), lambda n, k=k, units=units: int(units[k + n - 1]))
                    at = k + 1
                    if len(opened) > before:
                        before, at = len(opened), int(np.searchsorted(units, opened[-1][1])) + 1
        pieces = []
        for m in PERCENT.finditer(text):
            raw = binascii.unhexlify(m[0].replace("%", ""))
            try:
                new = raw.decode()
                offs = _char_bytes(new)
            except UnicodeDecodeError:
                new = raw.decode("latin-1")
                offs = np.arange(len(raw) + 1)
            pieces.append((m.start(), m.end(), new, (m.start() + 3 * offs).tolist()))
        if pieces:
            yield _replaced(layer, pieces)
    if "\\" in text or "&#" in text:
        pieces = []
        for m in ESCAPES.finditer(text):
            code = int(m[6]) if m[6] else int(next(x for x in m.groups() if x), 16)
            if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
                pieces.append((m.start(), m.end(), chr(code), [m.start(), m.end()]))
        if pieces:
            yield _replaced(layer, pieces)
    for readings in _wrapped(text):
        for lines in readings:
            token = "".join(text[a:b] for a, b in lines)
            if (raw := _base64_bytes(token)) is None:
                continue
            before, view = len(opened), _view(raw)
            if view is None and MAGIC.match(raw) is None:
                continue
            place = np.concatenate([np.arange(a, b) for a, b in lines])
            yield from whole(raw, lines[0][0], lambda n, place=place: int(place[min((n * 4 + 2) // 3, len(place)) - 1]) + 1)
            if view is not None:
                plain, at = view
                first, last = place[at[:-1] * 4 // 3], place[np.minimum((at[1:] * 4 + 2) // 3, len(token)) - 1]
                yield (plain, first, last + 1) if starts is None else (plain, starts[first], ends[last])
            if (view is not None and _as_text(raw) is not None) or len(opened) > before:
                break
    for m in BASE64.finditer(text):
        token = m[0].rstrip("=")
        if (raw := _base64_bytes(token)) is None:
            continue
        yield from whole(raw, m.start(), lambda n, m=m: m.end())
        if (view := _view(raw)) is None:
            continue
        plain, at = view
        first, last = m.start() + at[:-1] * 4 // 3, m.start() + np.minimum((at[1:] * 4 + 2) // 3, len(token)) - 1
        yield (plain, first, last + 1) if starts is None else (plain, starts[first], ends[last])
    yield from (None for s, e in shut.items() if not any(a <= s and e <= b for a, b in opened))


def find_secrets(text: str | None, limit: int = MAX_LAYER_BYTES) -> tuple[list, list, int, int]:
    """(base spans, all spans, layers scanned, layers too large to open or cut off); spans are sorted (start, kind, end)."""
    text = text or ""
    base = sorted(scan(text))
    found, layers, closed = set(base), 1, 0
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    seen: set = set()
    path = {digest(text)}  # of the layers around the present one
    work = [(digest(text), _unwrap((text, None, None), limit))]  # depth first: of a large layer one block at a time is held
    while work:
        own, inside = work[-1]
        inner = next(inside, END)
        if inner is END:
            work.pop()
            path.discard(own)
            continue
        if inner is None:
            closed += 1
            continue
        new, starts, ends = inner
        key = digest(new)
        # a layer that contains itself is a cycle; the same content at the same place was seen
        if key in path or (key, int(starts[0]), int(ends[-1])) in seen:
            continue
        seen.add((key, int(starts[0]), int(ends[-1])))
        layers += 1
        found.update((int(starts[s]), k, int(ends[e - 1])) for s, k, e in scan(new))
        path.add(key)
        work.append((key, _unwrap((new, starts, ends), limit)))
    return base, sorted(found), layers, closed


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_layers", T.LongType()), T.StructField("n_unopened", T.LongType())]
)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document with its secrets. A null or empty text has none, a very long one is scanned whole; extra columns are ignored;
    repeated rows give repeated results; a null id stays null; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in RESULT}
            out["doc_id"] = batch.column(0).to_pylist()
            for value in batch.column(1):
                base, every, layers, closed = find_secrets(value.as_py())
                for i, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(k == i for _, k, _ in base))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(every))
                out["n_layers"].append(layers)
                out["n_unopened"].append(closed)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in RESULT]))

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long"), docs[text]).mapInArrow(run, RESULT)
