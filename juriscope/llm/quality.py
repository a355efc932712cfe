"""Quality classifier: a byte-level convolutional network in numpy.

Every filter is WIDTH bytes wide and is applied at every STRIDE-th byte of the whole text. Its
responses are max-pooled over overlapping chunks of CHUNK blocks; the chunk features are combined
over the document by mean and by maximum into one logistic output. Only the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, STRIDE, FILTERS = 8, 4, 32
#: Filter positions in a block; blocks in a chunk; blocks between the starts of chunks.
BLOCK, CHUNK, HOP = 64, 4, 3
#: The classifier is fitted on at most so many labelled rows, of texts of at most so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 12_000
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.02, 11
#: Filter positions evaluated at once, which bounds memory for texts of any length.
PIECE = 16_384


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS: the filters' weight for each byte at each offset
    bias: np.ndarray
    mean_w: np.ndarray
    max_w: np.ndarray
    out: float

    @staticmethod
    def fresh(seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), 0.0)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each filled with zero bytes up to whole blocks; the block at which each begins."""
    step = BLOCK * STRIDE
    blocks = np.array([max(1, -(-len(t) // step)) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    buffer = np.zeros(int(starts[-1]) * step + WIDTH, np.uint8)
    for t, s in zip(texts, starts, strict=False):
        buffer[s * step : s * step + len(t)] = np.frombuffer(t, np.uint8)
    return buffer, starts


def convolve(net: Network, buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Responses (before the rectifier) of all filters at the given byte positions."""
    out = net.table[0][buffer[at]]
    for j in range(1, WIDTH):
        out += net.table[j][buffer[at + j]]
    return out


def block_maxima(net: Network, buffer: np.ndarray, blocks: int) -> np.ndarray:
    best = np.empty((blocks, FILTERS), np.float32)
    for b in range(0, blocks, PIECE // BLOCK):
        n = min(PIECE // BLOCK, blocks - b)
        at = np.arange(b * BLOCK, (b + n) * BLOCK, dtype=np.int64) * STRIDE
        best[b : b + n] = convolve(net, buffer, at).reshape(n, BLOCK, FILTERS).max(axis=1)
    return best


def chunks_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every chunk its document and its blocks (CHUNK of them; at the end of a text the last repeats)."""
    owner, rows = [], []
    for d in range(len(starts) - 1):
        n = starts[d + 1] - starts[d]
        first = np.arange(0, max(1, n - (CHUNK - HOP)), HOP)
        rows.append(np.minimum(first[:, None] + np.arange(CHUNK), n - 1) + starts[d])
        owner.append(np.full(len(first), d))
    return np.concatenate(owner), np.concatenate(rows)


def combine(net: Network, features: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each document; the mean and maximum of its chunks' features, and the chunk counts."""
    edges = np.searchsorted(owner, np.arange(docs))
    count = np.diff(np.append(edges, len(owner)))
    mean = np.add.reduceat(features, edges, axis=0) / count[:, None]
    top = np.maximum.reduceat(features, edges, axis=0)
    logit = mean @ net.mean_w + top @ net.max_w + net.out
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))), mean, top, count


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    buffer, starts = padded(texts)
    best = np.maximum(block_maxima(net, buffer, int(starts[-1])) + net.bias, 0)
    owner, rows = chunks_of(starts)
    return combine(net, best[rows].max(axis=1), owner, len(texts))[0]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the log loss; gradients flow to the position that won each chunk's maximum."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    if len(texts) == 0:
        return net
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    net.out = float(np.log(share / (1 - share)))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = [net.table.reshape(-1, FILTERS), net.bias, net.mean_w, net.max_w, np.array([net.out], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            which = order[b : b + BATCH]
            buffer, starts = padded([texts[i] for i in which])
            n_blocks = int(starts[-1])
            at = np.arange(n_blocks * BLOCK, dtype=np.int64) * STRIDE
            responses = convolve(net, buffer, at).reshape(n_blocks, BLOCK, FILTERS)
            win = responses.argmax(axis=1)
            best = np.take_along_axis(responses, win[:, None, :], 1)[:, 0, :] + net.bias
            owner, rows = chunks_of(starts)
            stacked = best[rows]
            which_block = stacked.argmax(axis=1)
            raw = np.take_along_axis(stacked, which_block[:, None, :], 1)[:, 0, :]
            features = np.maximum(raw, 0)
            net.out = float(params[4][0])
            p, mean, top, count = combine(net, features, owner, len(which))
            error = ((p - labels[which]) * weight[which]).astype(np.float32) / len(which)
            grad_mean, grad_max, grad_out = mean.T @ error, top.T @ error, np.array([error.sum()], np.float32)
            is_top = features == top[owner]
            grad = (error / count)[owner][:, None] * net.mean_w + is_top * (error[owner][:, None] * net.max_w)
            grad = (grad * (raw > 0)).astype(np.float32)
            block = np.take_along_axis(rows[:, :, None].repeat(FILTERS, 2), which_block[:, None, :], 1)[:, 0, :]
            spot = (block * BLOCK + np.take_along_axis(win[block.ravel()].reshape(*block.shape, FILTERS), np.arange(FILTERS)[None, :, None].repeat(len(block), 0), 2)[:, :, 0]) * STRIDE
            flat, column = grad.ravel(), np.tile(np.arange(FILTERS), len(block))
            grad_table = np.zeros(WIDTH * 256 * FILTERS, np.float64)
            for j in range(WIDTH):
                cell = (j * 256 + buffer[spot.ravel() + j].astype(np.int64)) * FILTERS + column
                grad_table += np.bincount(cell, flat, len(grad_table))
            grads = [grad_table.reshape(-1, FILTERS).astype(np.float32), grad.sum(axis=0), grad_mean, grad_max, grad_out]
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                params[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.out = float(params[4][0])
    return net


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out third, in hash order of doc_id.

    The bound is a parameter: candidates are half as many labels again (some may lack a document
    or be longer than ``most_bytes``). Null labels and rows without a document are passed over; of
    repeated rows one is used.
    """
    key = F.col("doc_id").cast("string")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").filter(F.pmod(F.crc32(key.cast("binary")), F.lit(3)) != 1)
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows * 3 // 2)
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes)
    found = texts.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("text", "quality").toArrow()
    return [_bytes(t) for t in found.column("text").to_pylist()], np.array(found.column("quality").to_pylist(), np.float64)


def scorer(net: Network, spark):
    shared = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            out, some, size = [], [], 0
            for text in batch.to_pylist():
                some.append(_bytes(text))
                size += len(some[-1])
                if size > 4 << 20:
                    out.append(predict(own, some))
                    some, size = [], 0
            out.append(predict(own, some))
            yield pa.array(np.concatenate(out), pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")


def classify(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with one more column, the probability of label 1, from a network fitted on ``labels``.

    Null and empty texts are scored as a block of zero bytes; texts are read whole; without usable
    labels every score comes from the untrained network. ``name`` must not be among the columns.
    """
    texts, marks = training_sample(docs, labels)
    net = fit(texts, marks)
    return docs.withColumn(name, scorer(net, docs.sparkSession)(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least ``least``, with the columns of docs."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return classify(rows, labels).filter(F.col("score") >= least).select("row.*")


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    scored = classify(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
