"""Byte-level BPE by DuckDB recursive queries, one in-memory database per Python worker.

Texts are cut by the pattern; each distinct piece becomes token-position rows. A recursive query
joins neighbouring rows with the merge table, contracts each piece's leftmost pair of least
rank and goes on with the pieces that changed until none does. Ordered aggregation over
position gives each piece's ids, and, joined with the vocabulary, its decoded bytes.

Pieces are encoded once per worker and kept, from task to task, in a table of at most CACHE_BYTES; when it is full, those go that have
not been met since it was last half full.

The recursion takes as many rounds as a piece has merges, so a piece of more than LONG_PIECE bytes, which ordinary text seldom has,
is encoded in windows that overlap by half. Two windows join at a token that both have at the same place: then any two neighbours of the result
are neighbours in the encoding of one window, so no merge crosses an edge between them, and each token is made of its own bytes alone; that is
the encoding of the whole. Windows without such a token, as texts of one repeated sign can have, become one window, whose query
contracts all pairs of least rank in a round where that comes to the same (MERGE_ALL).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Recent, give_memory_back, small_batches, worker_keeps

CACHE_BYTES = 160 << 20
SLICE_CHARS = 2_000_000
POSITIONS = 100_000
#: Bytes of a window, twice the step from one to the next.
LONG_PIECE = 192
IDS_OF, BYTES_OF = itemgetter(0), itemgetter(1)

_OUT = """
SELECT s.w, array_to_string(list(s.t ORDER BY p), ',') AS ids, unhex(string_agg(v.hex, '' ORDER BY p)) AS decoded
FROM s JOIN vocab v ON v.id = s.t WHERE done GROUP BY s.w
"""

# A row is a token of piece w at [p, e). Its neighbour is the row that begins where it ends.
MERGE = f"""
WITH RECURSIVE s(done, w, p, e, t) AS (
  SELECT false, w, p, p + 1, t FROM start
  UNION ALL
  SELECT * FROM (
    WITH live AS MATERIALIZED (SELECT (w::BIGINT << 32) | p::BIGINT AS at, w, p, e, t FROM s WHERE NOT done),
    ranked AS MATERIALIZED (
      SELECT a.w, a.p, b.e, b.at AS gone, m.id FROM live a JOIN live b ON b.at = ((a.w::BIGINT << 32) | a.e::BIGINT)
      JOIN merges m ON m.pair = ((a.t::BIGINT << 32) | b.t::BIGINT)),
    least_of AS MATERIALIZED (SELECT w, min((id::BIGINT << 32) | p::BIGINT) AS best FROM ranked GROUP BY w),
    hits AS MATERIALIZED (SELECT r.* FROM ranked r JOIN least_of l ON l.w = r.w AND l.best & 4294967295 = r.p)
    SELECT f.w IS NULL, a.w, a.p, coalesce(h.e, a.e), coalesce(h.id, a.t)
    FROM live a LEFT JOIN least_of f ON f.w = a.w LEFT JOIN hits h ON h.w = a.w AND h.p = a.p
    WHERE a.at NOT IN (SELECT gone FROM hits)))
{_OUT}"""

# After a merge the next pair of the same rank is next in turn, unless the new token makes a pair of lower rank (solo: a
# token that some merge of lower rank has as a part). So all pairs of the least rank go in one round, of those that overlap every other one.
MERGE_ALL = f"""
WITH RECURSIVE s(done, w, p, e, t) AS (
  SELECT false, w, p, p + 1, t FROM start
  UNION ALL
  SELECT * FROM (
    WITH pair AS MATERIALIZED (
      SELECT w, p, e, t, lead(t) OVER o AS nt, lead(e) OVER o AS ne, row_number() OVER o AS n FROM s WHERE NOT done WINDOW o AS (PARTITION BY w ORDER BY p)),
    ranked AS MATERIALIZED (SELECT pair.*, m.id, m.solo FROM pair LEFT JOIN merges m ON m.pair = ((t::BIGINT << 32) | nt::BIGINT)),
    least_of AS MATERIALIZED (SELECT w, min((id::BIGINT << 32) | p::BIGINT) AS best FROM ranked GROUP BY w),
    marked AS MATERIALIZED (SELECT r.*, best, coalesce(id = best >> 32 AND (NOT solo OR p = best & 4294967295), false) AS hit FROM ranked r JOIN least_of USING (w)),
    runs AS (SELECT *, n - 1 - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marked)
    SELECT best IS NULL, w, p, CASE WHEN hit THEN ne ELSE e END, CASE WHEN hit THEN id ELSE t END FROM runs WHERE before % 2 = 0))
{_OUT}"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def _values(column: pa.ChunkedArray) -> list[bytes]:
    """The values of a column of strings or bytes without nulls, cut out of its buffer; to_pylist() makes an object of its own for each on the way."""
    out: list[bytes] = []
    for chunk in column.cast(pa.large_binary()).chunks:
        if len(chunk):
            _, offsets, data = chunk.buffers()
            cuts = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
            raw = data.to_pybytes() if data is not None else b""
            out += [raw[a:b] for a, b in pairwise(cuts)]
    return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks, self.split = load_ranks(path), regex.compile(pattern).findall
        pairs, ids, solo = [], [], set()
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    ids.append(rank)
                    solo.update(x for x in (left, right) if x > rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "id": pa.array(ids, pa.int32()), "solo": [i in solo for i in ids]})  # noqa: F841
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        #: piece -> (ids joined by commas, decoded bytes)
        self.known = Recent(CACHE_BYTES)

    def _query(self, pieces: list[bytes], sql: str = MERGE) -> list[tuple[bytes, bytes]]:
        """(ids, decoded) of pieces, by the recursive query."""
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), length)
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        start = pa.table({"w": w, "p": at.astype(np.int32), "t": self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]})
        self.db.register("start", start)
        found = self.db.sql(sql).to_arrow_table()
        self.db.unregister("start")
        found = found.take(np.argsort(found["w"].to_numpy()))
        ids, decoded = _values(found["ids"]), _values(found["decoded"])
        if not np.array_equal(found["w"].to_numpy(), np.arange(len(pieces))) or sum(map(len, decoded)) != len(at):
            raise RuntimeError("the recursive query lost rows")
        return list(zip(ids, decoded, strict=True))

    def _queries(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """As _query(), about POSITIONS bytes at a time."""
        turn = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))) // POSITIONS
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(pieces)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                yield from self._query(pieces[lo:hi])

    def _tokens(self, at: int, coded: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each token begins and the last one ends) of a window that begins at `at`."""
        ids = np.array(coded[0].split(b","), dtype=np.int64)
        return ids, at + np.concatenate(([0], np.cumsum([len(self.tokens[i]) for i in ids.tolist()])))

    def _long(self, raw: bytes) -> tuple[bytes, bytes]:
        """(ids, decoded) of one piece of more than LONG_PIECE bytes."""
        step = LONG_PIECE // 2
        spans = [(at, min(at + LONG_PIECE, len(raw))) for at in range(0, len(raw) - step, step)]
        texts = list(dict.fromkeys(raw[a:b] for a, b in spans))
        coded = dict(zip(texts, self._queries(texts), strict=True))
        windows = [self._tokens(a, coded[raw[a:b]]) for a, b in spans]
        while True:
            joins = [self._join(x, y) for x, y in zip(windows[:-1], windows[1:], strict=True)]
            if None not in joins:
                break
            merged, k = [], 0
            while k < len(windows):
                first = k
                while k < len(joins) and joins[k] is None:
                    k += 1
                if k > first:
                    a, b = int(windows[first][1][0]), int(windows[k][1][-1])
                    merged.append(self._tokens(a, self._query([raw[a:b]], MERGE_ALL)[0]))
                else:
                    merged.append(windows[k])
                k += 1
            windows = merged
        out, begin = [], 0
        for (ids, at), end in zip(windows, [*joins, len(raw)], strict=True):
            lo, hi = np.searchsorted(at, (begin, end))
            out.append(ids[lo:hi])
            begin = end
        ids = np.concatenate(out).tolist()
        decoded = b"".join(map(self.tokens.__getitem__, ids))
        if decoded != raw:
            raise RuntimeError("windows do not join")
        return ",".join(map(str, ids)).encode(), decoded

    @staticmethod
    def _join(x: tuple, y: tuple) -> int | None:
        """Where a token ends that two windows have in common, or None."""
        (a_ids, a), (b_ids, b) = x, y
        _, i, j = np.intersect1d(a[:-1], b[:-1], assume_unique=True, return_indices=True)
        same = np.flatnonzero(a_ids[i] == b_ids[j])
        return int(a[i[same[len(same) // 2]] + 1]) if len(same) else None

    def _keep(self, pieces: list[str], got: list[tuple[bytes, bytes]]) -> None:
        for part, coded in zip(pieces, got, strict=True):
            self.known[part] = coded
        sizes = 3 * sum(map(len, map(BYTES_OF, got))) + sum(map(len, map(IDS_OF, got)))
        self.known.held += sizes + 260 * len(pieces)

    def learn(self, pieces: list[str]) -> None:
        raw = list(map(str.encode, pieces))
        whole = list(map(self.ranks.get, raw))
        # a piece that is a token needs no merges
        ready = [i for i, rank in enumerate(whole) if rank is not None]
        self._keep([pieces[i] for i in ready], [(b"%d" % whole[i], self.tokens[whole[i]]) for i in ready])
        long = [i for i, r in enumerate(raw) if len(r) > LONG_PIECE and whole[i] is None]
        self._keep([pieces[i] for i in long], [self._long(raw[i]) for i in long])
        todo = [i for i, r in enumerate(raw) if len(r) <= LONG_PIECE and whole[i] is None]
        self._keep([pieces[i] for i in todo], list(self._queries([raw[i] for i in todo])))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text (ids joined by commas, decoded bytes)."""
        at = 0
        while at < len(texts):
            parts, chars = [], 0
            while at < len(texts) and (not parts or chars + len(texts[at]) <= SLICE_CHARS):
                chars += len(texts[at])
                parts.append(self.split(texts[at]))
                at += 1
            self.known.make_room()
            rows = [list(map(self.known.get, part)) for part in parts]
            gaps = [[i for i, x in enumerate(row) if x is None] for row in rows]
            self.learn(self.known.missing({part[i] for part, gap in zip(parts, gaps, strict=True) for i in gap}))
            for part, row, gap in zip(parts, rows, gaps, strict=True):
                for i in gap:
                    row[i] = self.known[part[i]]
                yield b",".join(map(IDS_OF, row)), b"".join(map(BYTES_OF, row))


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])


def _texts(batches: Iterator[pa.RecordBatch], path: str, pattern: str):
    encoder = None
    for batch in batches:
        encoder = encoder or worker_keeps(("bpe", path, pattern), lambda: Encoder(path, pattern))
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield part.column(0), encoder.encode([x or "" for x in part.column(1).to_pylist()])
    give_memory_back(("bpe", path, pattern))  # the merge table and the pieces met stay for the worker's next task


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its ids, and the bytes they decode to. A null or empty text has no ids; a very long one is encoded whole.
    Invalid ranks files fail. Extra columns are ignored; repeated rows give repeated results; a null id stays null; an empty table gives an empty result."""

    def run(batches):
        for ids, coded in _texts(batches, path, pattern):
            lists, raw = [], []
            for csv, decoded in coded:
                lists.append([int(x) for x in csv.split(b",")] if csv else [])
                raw.append(decoded)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lists, pa.list_(pa.int32())), pa.array(raw, pa.binary())], names=IDS.names)

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long"), docs[text]).mapInArrow(run, IDS)


def bpe_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """As bpe_round_trip(), with n_tokens and digests in place of ids and bytes, made where they are."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for ids, coded in _texts(batches, path, pattern):
            n, a, b = [], [], []
            for csv, decoded in coded:
                n.append(csv.count(b",") + 1 if csv else 0)
                a.append(sha(csv))
                b.append(sha(decoded))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=RESULT.names)

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long"), docs[text]).mapInArrow(run, RESULT)
