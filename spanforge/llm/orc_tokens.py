"""Token ids as ORC files: stripes with run-length encoded integers, row indexes, Bloom filters on doc_id.

write_token_ids() encodes documents in ascending id order: documents are dealt into ranges of ids
first (texts are smaller than ids in a shuffle), sorted, and encoded on the way into the file of
their range. read_token_ids() reads stripes in parallel; lookup() prunes stripes and row groups by
the id statistics and Bloom filters.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bounded, give_memory_back, materialise, small_batches, worker_keeps

END_ID = 1
PART_BYTES = 32 << 20
CACHE_BYTES = 160 << 20
CHUNK_WORDS = 4096

ORC_OPTIONS = {
    "compression": "snappy",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.dictionary.key.threshold": "0",
}


#: Signs that stand in one piece when they end a word; an apostrophe can begin a piece of its own.
SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'")


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Encodes the space-separated words of texts with a tokenizers file that drops white space and lower-cases, so that
    a text's ids are those of its words in turn. Words are encoded once and kept, up to CACHE_BYTES.

    A word of letters is one piece and goes straight to the library's merges, in the byte letters that its pre-tokenizer would make;
    with signs at its end it is two pieces; any other word, and every word of a file of another make, takes the library's whole way.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        steps = [[x["type"] for x in (made[k] or {}).get(n, [])] for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.direct = steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and made["model"]["type"] == "BPE"
        if self.direct:
            self.tok.model._resize_cache(0)  # words come once
        self.letters = byte_letters()
        self.known = Bounded(CACHE_BYTES)

    def _letters(self, word: bytes) -> str | None:
        """The word in byte letters if it is one piece, else None."""
        if word.isalpha():  # ASCII letters
            return word.decode().lower()
        text = word.decode()
        if text.isalpha() and "\u03a3" not in text:  # its lower case depends on where it stands
            low = unicodedata.normalize("NFC", text).lower()
            if low.isalpha():
                return low.encode().decode("latin-1").translate(self.letters)
        return None

    def _learn(self, words: list[bytes]) -> None:
        known, other, tails, merge = self.known, [], [], self.tok.model.tokenize
        pack = [struct.Struct(f"<{n}I").pack for n in range(64)]

        direct, letters_of, held = self.direct, self._letters, 0

        def coded(letters: str) -> bytes:
            ids = [t.id for t in merge(letters)]
            return pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, dtype="<u4").tobytes()

        for w in words:
            if w in known:
                continue
            # most are ASCII letters, or those with signs behind them
            letters = (w.decode().lower() if w.isalpha() else letters_of(w)) if direct else None
            if letters is not None:
                got = known[w] = coded(letters)
                held += 200 + len(w) + len(got)
                continue
            stem = w.rstrip(SIGNS) if direct else b""
            if stem and len(stem) < len(w):
                letters = stem.decode().lower() if stem.isalpha() else letters_of(stem)
                if letters is not None:
                    if stem not in known:
                        got = known[stem] = coded(letters)
                        held += 200 + len(stem) + len(got)
                    tails.append((w, stem, w[len(stem) :]))
                    continue
            other.append(w)
        known.held += held
        other += list({t for _, _, t in tails if t not in known})
        for i in range(0, len(other), CHUNK_WORDS):
            part = other[i : i + CHUNK_WORDS]
            got = self.tok.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            ids, word = np.array(got.ids, dtype="<u4"), np.array(got.word_ids, dtype=np.int64)
            cut = np.searchsorted(word, np.arange(len(part) + 1))
            for k, w in enumerate(part):
                known.put(w, ids[cut[k] : cut[k + 1]].tobytes(), len(w) + 4 * int(cut[k + 1] - cut[k]))
        held = 0
        for w, stem, tail in tails:
            got = known[w] = known[stem] + known[tail]
            held += 200 + len(w) + len(got)
        known.held += held

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            rows, chars = [], 0
            while at < len(texts) and (not rows or chars < 4_000_000):
                raw = texts[at].encode()
                if b"<|" not in raw:  # the tokenizer lower-cases all but its special tokens
                    raw = raw.lower()
                rows.append(raw.split())  # bytes.split() takes the ASCII white space only
                chars += len(raw)
                at += 1
            self.known.make_room()
            get = self.known.get
            found = [list(map(get, r)) for r in rows]
            gaps = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
            self._learn(list(dict.fromkeys(r[i] for r, g in zip(rows, gaps, strict=True) for i in g)))
            for r, f, g in zip(rows, found, gaps, strict=True):
                for i in g:
                    f[i] = get(r[i])
                out.append(b"".join(f))
        return out


def _encode(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = worker_keeps(("words", path), lambda: WordEncoder(path))
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [r + end for r in encoder.encode([x or "" for x in part.column(2).to_pylist()])]
                offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "part", "h", "ids"])
        give_memory_back(("words", path))

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, text: str = "text", id_col: str = "doc_id", part_bytes: int = PART_BYTES) -> None:
    """Writes (doc_id, part, h, ids) in ascending doc_id order, equal ids by h, a hash of the text; part numbers the ranges of both.

    A null text is empty and has the end id only; a very long one is encoded whole. A null id comes first. Rows with the same id all
    stay, and many of them, or many null ids, fill several files. Extra columns are ignored. An empty table gives files without rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    dealt.select("doc_id", F.spark_partition_id().alias("part"), "text", "h").mapInArrow(_encode(tokenizer, end_id), "doc_id long, part int, h long, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, h long, ids array<int>").orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; ORC skips the stripes and row groups that cannot hold them."""
    return read_token_ids(spark, path).where(F.col("doc_id").isin(*doc_ids))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the files. start: the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, offs = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "h", "n_tokens", "ids_crc32"])

    each = materialise(read_token_ids(spark, path).mapInArrow(run, "doc_id long, part int, h long, n_tokens long, ids_crc32 long"))
    totals = sorted(each.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row a range of ids
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    base = spark.createDataFrame(rows, "__part int, __base long")
    order = Window.partitionBy("part").orderBy("doc_id", "h", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    out = each.join(F.broadcast(base), F.expr("part = __part"))
    return out.select("doc_id", (F.col("__base") + F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
