"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

The model of order n is built level by level. At level k every chunk of documents (see chunks.py)
sends the distinct k-grams it holds, keyed by context and word, with their training counts and what
level k - 1 knows of their word; buckets add the counts up and gather, for each context h, its total
C(h), how many continuations it has of each small count, and S(h), the mass that level k - 1 gives
to the words seen after h. From these and the counts of counts follow

    p(w | h) = d(c) * c / C'(h)                  for c = c(h w) > 0
             = a(h) * p(w | shorter h)           otherwise (recursively)
    a(h)     = (1 - sum of the seen p(. | h)) / (1 - S(h))

C'(h) is C(h), or C(h) + 1 where no continuation of h is discounted, so a(h) is never zero. The
probabilities of all V known words and one unknown word sum to 1 after every context. Level 1 gives
unseen mass to the unknown word alone.

What travels is exact and small. Level 1 numbers the words of training, frequent ones first, so a
k-gram is k whole numbers, no hash. The probability of a word that training has after h is a
discounted count by a denominator, so these two whole numbers stand for it. A context that only one
chunk holds (held-out texts included) has all its continuations there: it is counted in that chunk
and not sent. S(h) and the small counts are sent back only to chunks that have a word unseen after h.

Tables (Parquet, in the shared folder): replies of each level, partitioned by kind (counts for
chunks, contexts that several buckets share, counts of counts).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, bucket_count, by_bucket, encode, mixed, pack, pack_sorted, unpack, unpack_sorted
from .shared import shared_dir, shuffles_freed

#: Counts above this are not discounted.
MOST_DISCOUNTED = 5
ORDER = 2
#: The order of the registered query.
QUERY_ORDER = 3
#: The fixed hash of the end token.
END = np.uint64(0xC6A4A7935BD1E995)
#: Numbers of the start marker and the unknown word; those of training's words follow.
START, UNKNOWN, FIRST_WORD = 0, 1, 2


@dataclass
class Level:
    """What holds for all of one level: discounts for counts 0..MOST_DISCOUNTED + 1 (above: 1)."""

    discount: np.ndarray
    small: np.ndarray  # types of count 1..MOST_DISCOUNTED
    tokens: int = 0
    types: int = 0

    @staticmethod
    def of(counts_of_counts: np.ndarray, tokens: int = 0, types: int = 0) -> Level:
        """Good-Turing discounts by Katz's formula for the largest k that gives all of 1..k a discount in (0, 1).

        Counts of counts of small or repetitive corpora may allow none; then nothing is discounted.
        """
        n, small = np.concatenate([[0], counts_of_counts]).astype(np.float64), counts_of_counts[:MOST_DISCOUNTED]
        for k in range(MOST_DISCOUNTED, 0, -1):
            if (n[1 : k + 2] <= 0).any():
                continue
            r = np.arange(1, k + 1)
            common = (k + 1) * n[k + 1] / n[1]
            if common >= 1:
                continue
            d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if ((d > 0) & (d < 1)).all():
                return Level(np.concatenate([[1.0], d, np.ones(MOST_DISCOUNTED + 1 - k)]), small, tokens, types)
        return Level(np.ones(MOST_DISCOUNTED + 2), small, tokens, types)

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return self.discount[np.minimum(counts, MOST_DISCOUNTED + 1)] * counts

    def context(self, total: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominator and seen mass of contexts; small[:, r - 1]: continuations of count r."""
        r = np.arange(1, MOST_DISCOUNTED + 1)
        kept = total - small @ (r * (1 - self.discount[1 : MOST_DISCOUNTED + 1]))
        below = total + (kept >= total)
        return below, kept / np.maximum(below, 1)


# ---------------------------------------------------------------- level 1


def unigram(level: Level, counts: np.ndarray) -> np.ndarray:
    """p(w) for counts in training; 0 means the unknown word."""
    below, seen = level.context(np.array([level.tokens], np.float64), level.small[None, :])
    p = level.discounted(counts) / max(float(below[0]), 1.0)
    return np.where(counts > 0, p, 1.0 - float(seen[0]) if level.tokens else 1.0)


_MESSAGE = "bucket bigint, chunk bigint, contexts array<binary>, sizes binary, keys binary, counts binary, lower array<binary>, tally array<double>"
_MESSAGE_PA = pa.schema([
    ("bucket", pa.int64()), ("chunk", pa.int64()), ("contexts", pa.list_(pa.binary())), *[(c, pa.binary()) for c in ("sizes", "keys", "counts")],
    ("lower", pa.list_(pa.binary())), ("tally", pa.list_(pa.float64())),
])
_PACKED = ("counts", "several", "numbered", "totals", "least", "small", "mass")
_REPLY = f"kind string, level int, chunk bigint, bucket bigint, {', '.join(f'{c} binary' for c in _PACKED)}, context bigint, numbers array<double>"
_REPLY_PA = pa.schema([
    ("kind", pa.string()), ("level", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in _PACKED],
    ("context", pa.int64()), ("numbers", pa.list_(pa.float64())),
])


def _pack_ints(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in the least bytes that hold the largest; the first byte says how many."""
    most = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - (w == 8)))
    return bytes([width]) + pack(a.astype(f"u{width}"))


def _unpack_ints(b: bytes) -> np.ndarray:
    return unpack(b[1:], f"u{b[0]}").astype(np.int64)


def _pack_flags(a: np.ndarray) -> bytes:
    return pack(np.packbits(a))


def _unpack_flags(b: bytes, count: int) -> np.ndarray:
    return np.unpackbits(unpack(b, np.uint8), count=count).astype(bool)


def _starts(a: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])


def _reply_rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_REPLY_PA)


def _bucket(keys: np.ndarray, count: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(count)).astype(np.int64)


class Text:
    """The token stream of a chunk: words of each document, then one end."""

    def __init__(self, row: dict, remainder: int, modulus: int):
        self.chunk = chunk = Chunk(row)
        words = chunk.word_hashes()
        self.vocabulary = np.concatenate([words, [END]]).astype(np.uint64)
        n, docs = len(chunk.codes), len(chunk.counts)
        ends = np.cumsum(chunk.counts) + np.arange(docs)
        total = n + docs
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        self.code = np.empty(total, np.int64)
        self.code[~is_end] = chunk.codes
        self.code[is_end] = len(words)
        self.doc = np.repeat(np.arange(docs), chunk.counts + 1)
        self.n_tokens = chunk.counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.n_tokens)[:-1]])
        self.place = np.arange(total) - self.first[self.doc]
        names = [str(i) if k else "" for i, k in zip(chunk.ids.tolist(), chunk.known.tolist(), strict=True)]
        self.held_out = np.array([zlib.crc32(x.encode()) % modulus == remainder for x in names], bool)
        self.trains = ~self.held_out[self.doc]


def _send_words(count: int, rule: tuple[int, int]):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = Text(batch.slice(i, 1).to_pylist()[0], *rule)
                counts = np.bincount(text.code[text.trains], minlength=len(text.vocabulary))
                order = np.argsort(text.vocabulary)
                keys, counts = text.vocabulary[order], counts[order]
                rows = [{"bucket": b, "chunk": text.chunk.number, "keys": pack_sorted(k), "counts": _pack_ints(c)} for b, (k, c) in by_bucket(_bucket(keys, count), count, keys, counts)]
                yield from pa.Table.from_pylist(rows, schema=_MESSAGE_PA).to_batches()

    return send


def _tally(counts: np.ndarray) -> list[float]:
    """Counts of the counts 1..MOST_DISCOUNTED + 1, then tokens and types."""
    few = np.bincount(np.minimum(counts, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2]
    return [*few.astype(float).tolist(), float(counts.sum()), float((counts > 0).sum())]


def _add_words(buckets: int):
    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        counts = np.concatenate([_unpack_ints(r["counts"]) for r in rows])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, counts).astype(np.int64)
        several = np.bincount(back) > 1
        number = np.empty(len(total), np.int64)
        number[np.argsort(-total, kind="stable")] = FIRST_WORD + np.arange(len(total)) * buckets + rows[0]["bucket"]
        out, edges = [], np.cumsum([len(k) for k in keys])[:-1]
        for r, which in zip(rows, np.split(back, edges), strict=True):
            known = which[total[which] > 0]
            out.append({"kind": "reply", "level": 1, "chunk": r["chunk"], "bucket": r["bucket"], "counts": _pack_ints(total[which]), "several": _pack_flags(several[which]), "numbered": _pack_ints(number[known])})
        out.append({"kind": "tally", "level": 1, "numbers": _tally(total)})
        return _reply_rows(out)

    return add


# ---------------------------------------------------------------- levels above


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of contexts, given as columns of word numbers."""
    acc = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        with np.errstate(over="ignore"):
            acc = mixed(acc + c.astype(np.uint64))
    return acc


def _spread(contexts: np.ndarray, keys: np.ndarray, pieces: np.ndarray, count: int) -> np.ndarray:
    """The bucket of each k-gram: its context's, moved on by its word where a frequent context is cut into pieces."""
    return (_bucket(contexts, count) + keys % pieces) % count


class State:
    """What a chunk knows after the replies of levels 1..k: for each token the probability under level k.

    Of the gram of level k that ends at each token it knows a number within the chunk (in the order
    of the word numbers), the count in training, the denominator if it is counted, and whether
    several chunks hold it.
    """

    def __init__(self, row: dict, replies: list[dict], settings: dict, upto: int):
        self.settings, self.count = settings, settings["buckets"]
        self.text = text = Text(row, *settings["rule"])
        self.replies: dict[int, list[dict]] = {}
        for r in replies:
            self.replies.setdefault(r["level"], []).append(r)
        order = np.argsort(text.vocabulary)
        vocabulary = text.vocabulary[order]
        counts, number, several = np.zeros(len(order), np.int64), np.full(len(order), UNKNOWN), np.zeros(len(order), bool)
        parts = {b: w for b, (w,) in by_bucket(_bucket(vocabulary, self.count), self.count, order)}
        for r in self.replies.get(1, []):
            which = parts[r["bucket"]]
            counts[which] = found = _unpack_ints(r["counts"])
            number[which[found > 0]] = _unpack_ints(r["numbered"])
            several[which] = _unpack_flags(r["several"], len(which))
        numbers, code = np.unique(number, return_inverse=True)
        #: The word number of each code; codes are in the order of the numbers.
        self.numbers = np.concatenate([[START], numbers])
        self.code = (code + 1)[text.code]
        self.word_count = counts[text.code]
        self.p = unigram(settings["levels"][0], self.word_count)
        self.gram, self.gram_count, self.several = self.code - 1, self.word_count, several[text.code]
        self.below = np.zeros(0, np.int64)
        for k in range(2, upto + 1):
            self._climb(k)

    def grams(self, k: int) -> dict:
        """The distinct k-grams in order, where each token's is, and their contexts.

        Unknown words are one word. Tokens after an unknown word are left out: training has no such
        context, so their probability is that of the level below.
        """
        text = self.text
        context, held = np.zeros(len(self.code), np.int64), np.ones(len(self.code), bool)
        # how often training has the context: the count of the gram that ends before the token
        before = np.zeros(len(self.code), np.int64)
        context[1:], held[1:], before[1:] = self.gram[:-1] + 1, self.several[:-1], self.gram_count[:-1]
        context[text.first], held[text.first], before[text.first] = 0, True, self.settings["documents"]
        at = np.flatnonzero(before > 0)
        key = context[at] * len(self.numbers) + self.code[at]
        order = np.argsort(key)
        at, key = at[order], key[order]
        edges = _starts(key)
        group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(key))))
        counts = np.add.reduceat(text.trains[at].astype(np.int64), edges) if len(edges) else np.empty(0, np.int64)
        first = at[edges]
        pieces = 1 + before[first] // self.settings["piece"]
        return {"at": at, "group": group, "context": context[first], "counts": counts, "first": first, "held": held[first], "pieces": pieces}

    def _sent(self, g: dict, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Grams whose context several chunks hold: which they are, contexts as word numbers and hashed, words, buckets."""
        send = np.flatnonzero(g["held"])
        first = g["first"][send]
        place = self.text.place[first]
        columns = [self.numbers[np.where(place >= back, self.code[np.maximum(first - back, 0)], START)] for back in range(k - 1, 0, -1)]
        hashed, word = _mix(columns), self.numbers[self.code[first]]
        return send, columns, hashed, word, _spread(hashed, word, g["pieces"][send], self.count)

    def messages(self, k: int) -> pa.Table:
        g = self.grams(k)
        send, columns, _, word, bucket = self._sent(g, k)
        first = g["first"][send]
        # what gives the probability of the level below: the count and, above level 1, its denominator
        lower = [self.gram_count[first]] if k == 2 else [self.gram_count[first], self.below[first]]
        own = g["counts"][~g["held"]]
        rows = []
        for b, (c, w, n, pieces, *more) in by_bucket(bucket, self.count, g["context"][send], word, g["counts"][send], g["pieces"][send], *columns, *lower):
            starts, contexts = _starts(c), more[: k - 1]
            # the size of a context's run, and whether other buckets hold pieces of it
            sizes = np.diff(np.append(starts, len(c))) * 2 + (pieces[starts] > 1)
            rows.append({
                "bucket": b, "chunk": self.text.chunk.number, "contexts": [_pack_ints(np.diff(x[starts], prepend=0) if i == 0 else x[starts]) for i, x in enumerate(contexts)],
                "sizes": _pack_ints(sizes), "keys": _pack_ints(w), "counts": _pack_ints(n), "lower": [_pack_ints(x[n > 0]) for x in more[k - 1 :]],
                "tally": [] if rows else _tally(own),
            })
        return pa.Table.from_pylist(rows, schema=_MESSAGE_PA)

    def _climb(self, k: int) -> None:
        """From the probabilities of level k - 1 to those of level k."""
        level, g = self.settings["levels"][k - 1], self.grams(k)
        m = len(g["context"])
        starts = _starts(g["context"])
        spot = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, m)))
        # as if no other chunk held the contexts
        counts, several = g["counts"].copy(), np.zeros(m, bool)
        total, mass, small, least = (x[spot] for x in _gather(counts, self.p[g["first"]], starts))
        send, _, hashed, _, bucket = self._sent(g, k)
        parts = {b: w for b, (w,) in by_bucket(bucket, self.count, send)}
        for r in self.replies.get(k, []):
            which = parts[r["bucket"]]
            runs = _starts(g["context"][which])
            size = np.diff(np.append(runs, len(which)))
            counts[which] = found = _unpack_ints(r["counts"])
            several[which] = _unpack_flags(r["several"], len(which))
            total[which], least[which] = np.repeat(_unpack_ints(r["totals"]), size), np.repeat(_unpack_ints(r["least"]), size)
            lacking = np.logical_or.reduceat(found == 0, runs)
            some = which[np.repeat(lacking, size)]
            mass[some] = np.repeat(unpack(r["mass"], np.float64), size[lacking])
            small[some] = np.repeat(_unpack_ints(r["small"]).reshape(-1, MOST_DISCOUNTED), size[lacking], 0)
        shared = self.settings["shared"].get(k, {})
        if shared:
            cut = g["pieces"][send] > 1
            names, back = np.unique(hashed[cut], return_inverse=True)
            for i, name in enumerate(names.view(np.int64).tolist()):
                if numbers := shared.get(name):
                    which = send[cut][back == i]
                    total[which], mass[which], small[which] = numbers[0], numbers[1], numbers[2:]
                    least[which] = _least(np.array(numbers[2:]))
        # as Level.context: without a discounted continuation the denominator is one more
        below = total + (level.discount[least] >= 1)
        direct = level.discounted(counts) / np.maximum(below, 1)
        unseen = np.flatnonzero(counts == 0)
        weight = np.ones(m)
        _, seen = level.context(total[unseen].astype(np.float64), small[unseen])
        weight[unseen] = np.where(total[unseen] > 0, (1 - seen) / np.maximum(1 - mass[unseen], 1e-300), 1.0)
        p = self.p.copy()
        at, group = g["at"], g["group"]
        p[at] = np.where(counts[group] > 0, direct[group], weight[group] * self.p[at])
        self.p = p
        self.gram, self.gram_count, self.below, self.several = np.full(len(p), -1), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        self.gram[at], self.gram_count[at], self.below[at], self.several[at] = group, counts[group], below[group], several[group]


def _least(small: np.ndarray) -> int:
    """The least count, given how often each small one occurs."""
    return next((r for r, n in enumerate(small.tolist(), 1) if n), MOST_DISCOUNTED + 1)


def _gather(counts: np.ndarray, lower: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every context: total, lower mass of its seen words, number of continuations of each small count, the least count."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0), np.empty((0, MOST_DISCOUNTED)), np.empty(0, np.int64)
    total = np.add.reduceat(counts, starts)
    mass = np.add.reduceat(np.where(counts > 0, lower, 0.0), starts)
    small = np.stack([np.add.reduceat((counts == r).astype(np.int64), starts) for r in range(1, MOST_DISCOUNTED + 1)], 1)
    least = np.minimum.reduceat(np.where(counts > 0, np.minimum(counts, MOST_DISCOUNTED + 1), MOST_DISCOUNTED + 1), starts)
    return total, mass, small, least


def _ranked(columns: list[np.ndarray]) -> np.ndarray:
    """Whole numbers 0, 1, ... for the distinct rows of columns, in their order."""
    rank = np.unique(columns[0], return_inverse=True)[1]
    for c in columns[1:]:
        if len(c) and c.max() >= 1 << 32:
            c = np.unique(c, return_inverse=True)[1]
        rank = np.unique(rank << 32 | c, return_inverse=True)[1]
    return rank


def _add_grams(k: int, settings: dict):
    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        marked = [_unpack_ints(r["sizes"]) for r in rows]
        columns = [np.concatenate([np.cumsum(x) if i == 0 else x for x in (_unpack_ints(r["contexts"][i]) for r in rows)]) for i in range(k - 1)]
        contexts, marks = _ranked(columns), np.concatenate(marked)
        cut = np.unique(contexts[marks & 1 == 1], return_index=True)[1]
        cut = np.flatnonzero(marks & 1 == 1)[cut]
        c = np.repeat(contexts, marks >> 1)
        w = np.concatenate([_unpack_ints(r["keys"]) for r in rows])
        n = np.concatenate([_unpack_ints(r["counts"]) for r in rows])
        if w.max() >= 1 << 32:
            w = np.unique(w, return_inverse=True)[1]
        key = c << 32 | w
        order = np.argsort(key)
        edges = _starts(key[order])
        chunks = np.diff(np.append(edges, len(key)))
        back = np.empty(len(key), np.int64)
        back[order] = np.repeat(np.arange(len(edges)), chunks)
        total = np.add.reduceat(n[order], edges)
        known = []
        for i in range(len(rows[0]["lower"])):
            x = np.zeros(len(key), np.int64)
            x[n > 0] = np.concatenate([_unpack_ints(r["lower"][i]) for r in rows])
            known.append(np.maximum.reduceat(x[order], edges))
        lower = unigram(settings["levels"][0], known[0]) if k == 2 else settings["levels"][k - 2].discounted(known[0]) / np.maximum(known[1], 1)
        sums, mass, small, least = _gather(total, lower, _starts(c[order][edges]))
        out, at, spots = [], 0, np.split(contexts, np.cumsum([len(x) for x in marked])[:-1])
        for r, x, spot in zip(rows, marked, spots, strict=True):
            size = x >> 1
            m = int(size.sum())
            which = back[at : at + m]
            lacking = spot[np.logical_or.reduceat(total[which] == 0, np.cumsum(size) - size)]
            out.append({
                "kind": "reply", "level": k, "chunk": r["chunk"], "bucket": r["bucket"], "counts": _pack_ints(total[which]), "several": _pack_flags(chunks[which] > 1),
                "totals": _pack_ints(sums[spot]), "least": _pack_ints(least[spot]), "small": _pack_ints(small[lacking].reshape(-1)), "mass": pack(mass[lacking]),
            })
            at += m
        names = _mix([x[cut] for x in columns]).view(np.int64)
        for name, i in zip(names.tolist(), contexts[cut].tolist(), strict=True):
            out.append({"kind": "context", "level": k, "context": name, "numbers": [float(sums[i]), float(mass[i]), *small[i].astype(float).tolist()]})
        own = [r["tally"] for r in rows if r["tally"]]
        out.append({"kind": "tally", "level": k, "numbers": np.sum([_tally(total), *own], axis=0).tolist()})
        return _reply_rows(out)

    return add


def _climber(settings: dict, k: int):
    def climb(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        rows = replies.to_pylist()
        parts = [State(row, rows, settings, k - 1).messages(k) for row in chunks.to_pylist()]
        return pa.concat_tables(parts) if parts else _MESSAGE_PA.empty_table()

    return climb


_SCORE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
_SCORE_PA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scorer(settings: dict, order: int):
    def score(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        rows, out = replies.to_pylist(), []
        tokens, types = settings["levels"][0].tokens, settings["levels"][0].types
        for row in chunks.to_pylist():
            state = State(row, rows, settings, order)
            text, docs = state.text, len(state.text.n_tokens)
            base = np.log10((state.word_count + 1) / (tokens + types + 1))
            out.append(pa.Table.from_arrays([
                pa.array([i if f else None for i, f in zip(text.chunk.ids.tolist(), text.chunk.known.tolist(), strict=True)], pa.int64()), pa.array(text.held_out),
                pa.array(text.n_tokens), pa.array(np.bincount(text.doc, state.word_count > 0, docs).astype(np.int64)),
                pa.array(np.bincount(text.doc, base, docs)), pa.array(np.bincount(text.doc, np.log10(state.p), docs)),
            ], schema=_SCORE_PA))
        return pa.concat_tables(out) if out else _SCORE_PA.empty_table()

    return score


def _write(df: DataFrame, level: int) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/katz-{level}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.partitionBy("kind").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _totals(table: DataFrame) -> list[float]:
    size = MOST_DISCOUNTED + 3
    row = table.filter("kind = 'tally'").agg(*[F.coalesce(F.sum(F.col("numbers")[i]), F.lit(0.0)).alias(f"n{i}") for i in range(size)]).first()
    return [row[i] for i in range(size)]


def score_texts(docs: DataFrame, order: int = ORDER, held_out: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    The model learns from rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``; a null
    doc_id has the empty text. Tokens are the lower-cased (A-Z) words and one end; null texts are
    empty and have one token. Rows that repeat count as often as they stand; texts are scored whole;
    with nothing to learn from every token is unknown with probability 1; an empty table gives an
    empty result; other columns are not read.
    """
    chunks = encode(docs, fold=True)
    sizes = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    count = bucket_count(chunks)
    settings: dict = {"rule": (held_out, folds), "buckets": count, "levels": [], "shared": {}, "documents": int(sizes[1]), "piece": max(1000, (int(sizes[0]) + int(sizes[1])) // count // 2)}
    words = chunks.mapInArrow(_send_words(count, settings["rule"]), _MESSAGE)
    replies = _write(words.groupBy("bucket").applyInArrow(_add_words(count), _REPLY), 1)
    tally = _totals(replies)
    level = Level.of(np.array(tally[: MOST_DISCOUNTED + 1]), int(tally[-2]), int(tally[-1]))
    settings["levels"].append(level)
    known = replies.filter("kind = 'reply'")
    for k in range(2, order + 1):
        sent = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_climber(settings, k), _MESSAGE)
        table = _write(sent.groupBy("bucket").applyInArrow(_add_grams(k, dict(settings)), _REPLY), k)
        tally = _totals(table)
        settings["levels"].append(Level.of(np.array(tally[: MOST_DISCOUNTED + 1]), int(tally[-2]), int(tally[-1])))
        settings["shared"][k] = _shared_contexts(table)
        known = known.unionByName(table.filter("kind = 'reply'"))
    scored = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_scorer(settings, order), _SCORE)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(level.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _shared_contexts(table: DataFrame) -> dict[int, list[float]]:
    """Sums over buckets of the contexts that are cut into pieces.

    Bounded: a context is cut only if training has it ``piece`` times, and ``piece`` is a fixed share
    of all tokens, so there are at most about twice as many as buckets.
    """
    parts = [F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(MOST_DISCOUNTED + 2)]
    rows = table.filter("kind = 'context'").groupBy("context").agg(*parts).collect()
    return {r["context"]: [r[f"n{i}"] for i in range(MOST_DISCOUNTED + 2)] for r in rows}


def op1_katz(docs: DataFrame) -> DataFrame:
    return score_texts(docs, order=QUERY_ORDER)
