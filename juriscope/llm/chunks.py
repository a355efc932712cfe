"""Documents as chunks of coded words, and exchanges of packed sorted hashes between chunks and buckets.

A chunk is a run of documents with about CHUNK_WORDS words: word codes, and the chunk's own list of
words. Chunks are written once, bucketed by chunk number, so that later passes meet their replies
without moving the words again. In an exchange every chunk sends each bucket one packed message
about the distinct keys it holds; the bucket answers each chunk with one packed reply. A key that is
in every document thus costs one entry a chunk, and neither side's size grows with the corpus:
buckets are numbered in proportion to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import shared_dir

CHUNK_WORDS = 1_100_000
#: Words of the corpus for each bucket of an exchange.
BUCKET_WORDS = 2_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

CHUNKS = "chunk bigint, n_docs bigint, n_words bigint, ids binary, known binary, counts binary, codes binary, words binary"
_SCHEMA = pa.schema([("chunk", pa.int64()), ("n_docs", pa.int64()), ("n_words", pa.int64()), *[(c, pa.binary()) for c in ("ids", "known", "counts", "codes", "words")]])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
        return x ^ (x >> np.uint64(32))


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def expand(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack(a: np.ndarray) -> bytes:
    """Numbers as byte planes, so that planes of zeros shrink to nothing when compressed."""
    a = np.ascontiguousarray(a)
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T))


def unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as packed differences."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


class Chunk:
    """A decoded row of the chunk table."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.ids, self.known = expand(row["ids"], np.int64), expand(row["known"], np.bool_)
        self.counts, self.codes = expand(row["counts"], np.int64), expand(row["codes"], np.uint32)
        self._words = row["words"]

    @property
    def words(self) -> list[bytes]:
        raw = zstandard.ZstdDecompressor().decompress(self._words)
        return raw.split(b"\n") if raw else []

    def word_hashes(self) -> np.ndarray:
        """64-bit hash of the word of each code."""
        words = self.words
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))

    def starts(self) -> np.ndarray:
        """The first word of every document, and the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def _encoder(fold: bool, chunk_words: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        ids, counts, codes, seen = [], [], [], {}

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, codes, seen, nth
            row = [
                [(part << 32) + nth], [len(ids)], [int(sum(counts))],
                [squeeze(np.array([i or 0 for i in ids], np.int64))], [squeeze(np.array([i is not None for i in ids], np.bool_))], [squeeze(np.array(counts, np.int64))],
                [squeeze(np.concatenate(codes) if codes else np.empty(0, np.uint32))], [zstandard.ZstdCompressor(level=1).compress(b"\n".join(seen))],
            ]
            ids, counts, codes, seen, nth = [], [], [], {}, nth + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass") if text else b""
                    words = (raw.lower() if fold else raw).split()
                    ids.append(doc)
                    counts.append(len(words))
                    codes.append(np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.uint32, len(words)))
                    total += len(words)
                    if total >= chunk_words:
                        yield flush()
                        total = 0
        if ids:
            yield flush()

    return encode


def encode(docs: DataFrame, fold: bool, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The chunk table of docs (doc_id bigint, text): a table bucketed by chunk in the shared folder.

    fold lower-cases A-Z. Words are split at ASCII white space; null texts have none.
    """
    spark = docs.sparkSession
    name = f"juriscope_chunks_{uuid.uuid4().hex}"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_encoder(fold, chunk_words), CHUNKS)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def bucket_count(chunks: DataFrame) -> int:
    """Buckets for an exchange over these chunks."""
    words = chunks.agg({"n_words": "sum"}).first()[0] or 0
    return max(12, int(words // BUCKET_WORDS) + 1)


def rows_of(table: pa.Table) -> Iterator[dict]:
    yield from table.to_pylist()


def by_bucket(buckets: np.ndarray, count: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, its part of each column), keeping the order within a bucket."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(count + 1))
    for b in range(count):
        if edges[b + 1] > edges[b]:
            which = order[edges[b] : edges[b + 1]]
            yield b, [c[which] for c in columns]
