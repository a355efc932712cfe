"""Removal of word passages that an earlier document has, through difference-cover anchors.

Anchors are windows of ANCHOR words that start at positions whose remainder modulo PERIOD is in
COVER, a difference cover: for any two positions of a common passage some shift below PERIOD puts
both on the cover, so two copies of WINDOW = PERIOD - 1 + ANCHOR words share an anchor. Only
passages around anchors that several documents hold are extended to full windows; each window's
96-bit digest then finds the smallest document that holds it, so no pairs of documents are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, bucket_count, by_bucket, encode, mixed, pack, pack_sorted, squeeze, expand, unpack, unpack_sorted
from .shared import NOT_SPACES, materialise

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1

_MESSAGE = "bucket bigint, chunk bigint, keys binary, more binary, docs binary"
_MESSAGE_PA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("docs", pa.binary())])
_REPLY = "chunk bigint, bucket bigint, stage bigint, bits binary"


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, length, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            acc = mixed(acc + hashes[j : n + j])
    return acc


class View:
    """Positions and hashes of one chunk."""

    def __init__(self, row: dict):
        self.chunk = Chunk(row)
        self.hashes = self.chunk.word_hashes()[self.chunk.codes] if len(self.chunk.codes) else np.empty(0, np.uint64)
        starts = self.chunk.starts()
        self.doc = np.repeat(np.arange(len(self.chunk.counts)), self.chunk.counts)
        self.place = np.arange(len(self.doc)) - starts[:-1][self.doc]
        self.left = self.chunk.counts[self.doc] - self.place  # words from here to the end of the document

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every anchor in a document that can hold a window and has an id."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= ANCHOR) & (self.chunk.counts[self.doc] >= WINDOW) & self.chunk.known[self.doc])
        return at, runs(self.hashes, ANCHOR)[at]

    def windows(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, hash, second hash) of every window that holds one of the anchors at ``hot``."""
        mark = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(mark, np.maximum(hot - (PERIOD - 1), hot - self.place[hot]), 1)
        np.add.at(mark, hot + 1, -1)
        at = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (self.left >= WINDOW) & self.chunk.known[self.doc])
        first = np.full(len(at), WINDOW, np.uint64)
        second = np.full(len(at), WINDOW + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                word = self.hashes[at + j]
                first = mixed(first + word)
                second = (second ^ word) * np.uint64(0x100000001B3) + (second >> np.uint64(29))
        return at, first, (mixed(second) >> np.uint64(32)).astype(np.uint32)


def _bucket(keys: np.ndarray, count: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(count)).astype(np.int64)


def _distinct(keys: np.ndarray, more: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, more) in order: keys, more, smallest doc, largest doc, and for each row its distinct one."""
    order = np.lexsort((more, keys))
    k, m = keys[order], more[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    group = np.cumsum(new) - 1
    back = np.empty(len(k), np.int64)
    back[order] = group
    edges = np.flatnonzero(new)
    d = docs[order]
    low, high = (np.minimum.reduceat(d, edges), np.maximum.reduceat(d, edges)) if len(edges) else (d, d)
    return k[new], m[new], low, high, back


def _messages(number: int, count: int, keys: np.ndarray, more: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = [(b, number, pack_sorted(k), pack(m) if len(m) and m.any() else b"", pack(d)) for b, (k, m, d) in by_bucket(_bucket(keys, count), count, keys, more, docs)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MESSAGE_PA, strict=True)], schema=_MESSAGE_PA)


_MANY = np.int64(np.iinfo(np.int64).max)


def _send_anchors(count: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                view = View(batch.slice(i, 1).to_pylist()[0])
                at, keys = view.anchors()
                docs = view.chunk.ids[view.doc[at]]
                k, m, low, high, _ = _distinct(keys, np.zeros(len(keys), np.uint32), docs)
                yield from _messages(view.chunk.number, count, k, m, np.where(low == high, low, _MANY))

    return send


def _merge(stage: int):
    """Answer every chunk with one bit a key: (stage 0) several documents hold it; (stage 1) a smaller one than the chunk's own smallest does."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "keys", "more", "docs", "bucket"]).to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        more = [unpack(r["more"], np.uint32) if r["more"] else np.zeros(len(k), np.uint32) for r, k in zip(rows, keys, strict=True)]
        docs = [unpack(r["docs"], np.int64) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        own = np.concatenate(docs)
        _, _, low, high, back = _distinct(np.concatenate(keys), np.concatenate(more), own)
        bits = ((low != high) | (high == _MANY))[back] if stage == 0 else low[back] < own
        parts = np.split(bits, ends[:-1])
        return pa.table({
            "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()),
            "stage": pa.array([stage] * len(rows), pa.int64()), "bits": pa.array([squeeze(np.packbits(p)) for p in parts], pa.binary()),
        })

    return merge


def _answers(replies: pa.Table, stage: int, buckets: np.ndarray, count: int) -> np.ndarray:
    """The bits for keys in distinct order, whose buckets are given."""
    out = np.zeros(len(buckets), bool)
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(count + 1))
    for r in replies.to_pylist():
        if r["stage"] == stage:
            which = order[edges[r["bucket"]] : edges[r["bucket"] + 1]]
            out[which] = np.unpackbits(expand(r["bits"], np.uint8), count=len(which)).astype(bool)
    return out


def _hot(view: View, replies: pa.Table, count: int) -> np.ndarray:
    at, keys = view.anchors()
    k, _, _, _, back = _distinct(keys, np.zeros(len(keys), np.uint32), view.chunk.ids[view.doc[at]])
    return at[_answers(replies, 0, _bucket(k, count), count)[back]]


def _send_windows(count: int):
    def send(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            view = View(row)
            at, keys, more = view.windows(_hot(view, replies, count))
            k, m, low, _, _ = _distinct(keys, more, view.chunk.ids[view.doc[at]])
            out += list(_messages(view.chunk.number, count, k, m, low))
        return pa.Table.from_batches(out, schema=_MESSAGE_PA)

    return send


_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
_RESULT_PA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _remove(count: int):
    def remove(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            view = View(row)
            chunk = view.chunk
            at, keys, more = view.windows(_hot(view, replies, count))
            docs = chunk.ids[view.doc[at]]
            k, _, low, _, back = _distinct(keys, more, docs)
            known = _answers(replies, 1, _bucket(k, count), count)
            covered = at[known[back] | (docs > low[back])]
            mark = np.zeros(len(view.doc) + 1, np.int64)
            np.add.at(mark, covered, 1)
            np.add.at(mark, covered + WINDOW, -1)
            gone = np.cumsum(mark[:-1]) > 0
            words, starts, codes = chunk.words, chunk.starts(), chunk.codes
            names = chunk.ids.tolist()
            kept = []
            for d in range(len(chunk.counts)):
                own = codes[starts[d] : starts[d + 1]][~gone[starts[d] : starts[d + 1]]]
                kept.append(b" ".join([words[c] for c in own.tolist()]).decode("utf-8", "replace"))
            removed = np.bincount(view.doc[gone], minlength=len(chunk.counts)) if len(gone) else np.zeros(len(chunk.counts), np.int64)
            out.append(pa.RecordBatch.from_arrays([pa.array([n if f else None for n, f in zip(names, chunk.known, strict=True)], pa.int64()), pa.array(chunk.counts), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], schema=_RESULT_PA))
        return pa.Table.from_batches(out, schema=_RESULT_PA)

    return remove


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row of docs.

    A word goes if it is covered by a window of WINDOW words whose sequence also starts in a
    document with a smaller doc_id; windows are judged on the input. Null texts have no words; rows
    without doc_id neither lose words nor cause others to; rows that repeat a doc_id do not affect
    each other; texts are taken whole; an empty table gives an empty result; other columns are not
    read.
    """
    chunks = encode(docs, fold=False)
    count = bucket_count(chunks)
    anchors = chunks.mapInArrow(_send_anchors(count), _MESSAGE)
    hot = materialise(anchors.groupBy("bucket").applyInArrow(_merge(0), _REPLY), "anchors")
    windows = chunks.groupBy("chunk").cogroup(hot.groupBy("chunk")).applyInArrow(_send_windows(count), _MESSAGE)
    found = materialise(windows.groupBy("bucket").applyInArrow(_merge(1), _REPLY), "windows")
    replies = hot.unionByName(found)
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_remove(count), _RESULT)


def op6_substrings(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{NOT_SPACES}') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS x FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - {WINDOW} + 1)) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT x, min(doc_id) AS low FROM g GROUP BY x),
c AS (SELECT DISTINCT rid, unnest(generate_series(i, i + {WINDOW} - 1)) AS p FROM g JOIN f USING (x) WHERE f.low < g.doc_id),
t AS (SELECT rid, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
k AS (SELECT t.rid, count(c.p) AS n_removed, string_agg(t.word, ' ' ORDER BY t.p) FILTER (c.p IS NULL) AS kept FROM t LEFT JOIN c ON c.rid = t.rid AND c.p = t.p GROUP BY t.rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
