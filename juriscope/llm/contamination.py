"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items. For each pattern length a shift table says how far the
scan may jump after seeing a block of two words, buckets keyed by the last block of a pattern select
the patterns to try where the jump is zero, and a direct comparison of all words confirms them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, materialise

WINDOW = 13
#: Benchmark text collected and broadcast at once; larger benchmarks are searched in so many blocks.
BLOCK_BYTES = 16 << 20

_SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if text else []


class Matcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list[int]]]] = defaultdict(list)
        for words, items in patterns.items():
            for j in range(length - self.block + 1):
                block = words[j : j + self.block]
                self.shift[block] = min(self.shift.get(block, self.default), length - self.block - j)
            self.buckets[words[length - self.block :]].append((list(words), items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence."""
        length, shift, default, n = self.length, self.shift, self.default, len(words)
        end = length - 1
        while end < n:
            block = (words[end - 1], words[end]) if self.block == 2 else (words[end],)
            jump = shift.get(block, default)
            if jump:
                end += jump
                continue
            start = end - length + 1
            first = words[start]
            for pattern, items in self.buckets[block]:
                if pattern[0] == first and pattern == words[start : end + 1]:
                    yield start, items
            end += 1


def matchers_of(items: list[tuple[str, str | None]], window: int) -> list[Matcher]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, (_, text) in enumerate(items):
        words = words_of(text)
        length = min(window, len(words))
        for s in {tuple(words[i : i + length]) for i in range(len(words) - length + 1)} if words else ():
            by_length[length][s].append(k)
    return [Matcher(n, p) for n, p in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _searcher(items: list[tuple[str, str | None]], window: int, spark):
    shared = spark.sparkContext.broadcast(items)

    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rows = shared.value
        matchers = matchers_of(rows, window)
        for texts, before in batches:
            out = []
            for text, old in zip(texts.to_pylist(), before.to_pylist(), strict=True):
                words = words_of(text)
                spans = [(s["start"], s["end"]) for s in old["spans"]]
                names = set(old["items"])
                for m in matchers:
                    for start, which in m.occurrences(words):
                        spans.append((start, start + m.length))
                        names.update(rows[k][0] for k in which)
                out.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in merged(spans)], "items": sorted(names)})
            yield pa.array(out, _FOUND)

    search.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(search, FOUND)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, name: str = "found") -> DataFrame:
    """docs with one more column: n_words, the merged word spans that windows cover, and the items found.

    A null text has no words; null or empty items have no windows; a null item_id is named as the
    empty string; items that repeat count once; texts are searched whole, whatever their length.
    An empty benchmark finds nothing. ``name`` must not be among the columns of docs.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("item_text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("n")).first()["n"]
    blocks = size // BLOCK_BYTES + 1
    if blocks > 1:
        items = items.withColumn("block", F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)))
    out = docs.withColumn(name, F.from_json(F.lit('{"n_words":0,"spans":[],"items":[]}'), FOUND))
    for b in range(blocks):
        some = (items.filter(F.col("block") == b) if blocks > 1 else items).select("item", "item_text").collect()
        udf = _searcher(sorted(((r[0], r[1]) for r in some), key=lambda x: (x[0], x[1] or "")), window, spark)
        out = out.withColumn(name, udf(F.col("text"), F.col(name)))
        if b < blocks - 1:  # written before the next block is read, so that no process holds two
            out = materialise(out, f"block-{b}")
    return out


def is_contaminated(found):
    """The contract's rule: some word is hit, and at least one word in twenty."""
    n_hit = F.aggregate(found["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return n_hit, (n_hit > 0) & (20 * n_hit >= found["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = find(rows, benchmark, window)
    return found.filter(~is_contaminated(F.col("found"))[1]).select("row.*")


def op2_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"), benchmark)
    n_hit, flag = is_contaminated(F.col("found"))
    rows = found.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("found.items").alias("items"), flag.alias("contaminated"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT dw.rid, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
