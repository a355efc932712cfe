"""Near-duplicates of documents: MinHash LSH forest for candidates, full shingle sets for links.

1. Documents with equal shingle sets form a class; one row of each class goes on.
2. Every class has a MinHash signature of TREES * DEPTH values. Tree t orders the classes by the
   signature read from value t * DEPTH on. Classes that agree on the first DEPTH values of a tree
   share a region; regions with one class are dropped. Rows are range-sorted by the tree's order, so
   those with the longest common prefixes are neighbours, and large regions are cut at deeper values
   (adaptive depth): no region needs to fit one task. Neighbours whose signatures agree enough are
   candidates.
3. A window may be too narrow for a region that holds more rows than it. Regions in which the windows of
   all trees have left rows apart are looked at again as a whole: up to CROWD rows, all their
   signatures are compared; beyond, all their rows become one group of candidates, on which step 4 is
   exact. So no pair that shares a region is lost to the width of a window.
4. Candidates are grouped by connected components, and within a group links are confirmed on the
   full sets through an index of their rarest shingles (two sets with the similarity asked for share one
   among those), so classes that no tree put side by side are still compared. Groups whose work is
   more than a task's share are cut into blocks: linked block by block, then through the leaders of
   what is linked so far, then exactly for all that is outside the largest part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise

SHINGLE = 5
TREES, DEPTH, DEEPER = 32, 3, 5
VALUES = TREES * DEPTH
#: Rows before it in a tree's order that a row is compared with.
NEIGHBOURS = 16
#: Share of equal signature bytes from which neighbours are candidates: about four standard
#: deviations of the estimate below a similarity of 0.75.
LEAST_AGREEMENT = 0.56
#: Rows of a region whose signatures are all compared; beyond, the region becomes a group of candidates.
CROWD = 512
#: Shingles that one task may hold, and shingles of a group that are not worth dividing.
GROUP_SHINGLES = 3_000_000
LEAST_SHINGLES = 20_000
#: Candidate classes up to this count (16 bytes each) are broadcast to the scan of texts.
MOST_BROADCAST = 1_000_000

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (lower-cased A-Z, split at ASCII white space), and word counts."""
    seen: dict[bytes, int] = {}
    parts, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        counts[k] = len(words)
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        parts.append(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), counts


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle; no words, none."""
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts:
        own = hashes[at : at + n]
        at += n
        if n == 0:
            out.append(own)
            continue
        width = min(size, n)
        with np.errstate(over="ignore"):
            acc = np.full(n - width + 1, width, np.uint64)
            for j in range(width):
                acc = mixed(acc + own[j : n - width + 1 + j])
        out.append(np.unique(acc))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of VALUES 32-bit minima for each set; empty sets get zeros."""
    out = np.zeros((len(sets), VALUES), np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    joined = np.concatenate([sets[k] for k in full])
    edges = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
    with np.errstate(over="ignore"):
        for v in range(VALUES):
            out[full, v] = np.minimum.reduceat(((joined * _MULTIPLY[v] + _ADD[v]) >> np.uint64(32)).astype(np.uint32), edges)
    return out


def _slices(rows: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most so many bytes together (or one row)."""
    sizes = np.array([len(t) if t else 0 for t in rows.column("text").to_pylist()], np.int64)
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield rows.slice(start, k - start)
            start, total = k, 0
        total += int(n)
    if len(sizes) > start:
        yield rows.slice(start)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            sets = shingle_sets(part.column("text").to_pylist())
            signed = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([r.tobytes() if len(s) else None for r, s in zip(signed, sets, strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )


def _ordered(signed: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each signature and tree the region's hash, and per tree the deeper values as big-endian bytes."""
    regions, deeper = np.empty((len(signed), TREES), np.uint64), []
    with np.errstate(over="ignore"):
        for t in range(TREES):
            acc = np.full(len(signed), t + 1, np.uint64)
            for d in range(DEPTH):
                acc = mixed(acc + signed[:, t * DEPTH + d].astype(np.uint64) + np.uint64(1))
            regions[:, t] = acc
            columns = [(t * DEPTH + DEPTH + d) % VALUES for d in range(DEEPER)]
            deeper.append(np.ascontiguousarray(signed[:, columns].astype(">u4")))
    return regions.view(np.int64), deeper


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            signed = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            regions, _ = _ordered(signed)
            yield pa.RecordBatch.from_arrays([pa.array(regions.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), part.num_rows))], names=["region", "rep", "tree"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place: the bytes that sort a row in its tree's order; bits: the low byte of every signature value."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            signed = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            _, deeper = _ordered(signed)
            regions = part.column("region").to_numpy()
            trees = part.column("tree").to_numpy()
            bits = (signed & 0xFF).astype(np.uint8)
            place = [int(r).to_bytes(8, "big", signed=True) + deeper[t][k].tobytes() for k, (r, t) in enumerate(zip(regions, trees, strict=True))]
            yield pa.RecordBatch.from_arrays([part.column("region"), pa.array(place, pa.binary()), part.column("rep"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["region", "place", "rep", "bits"])


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("seam", pa.int64()), ("place", pa.binary()), ("bits", pa.binary())])
_LINKS_DDL = "a bigint, b bigint, seam bigint, place binary, bits binary"


def _pairs(place: list[bytes], reps: np.ndarray, bits: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the candidate pairs among rows in a tree's order."""
    n = len(reps)
    region = np.array([p[:8] for p in place], "S8").view(">u8").reshape(-1) if n else np.empty(0)
    least = int(np.ceil(LEAST_AGREEMENT * VALUES))
    label = np.arange(n)
    a_out, b_out = [], []
    for w in range(1, min(NEIGHBOURS, n - 1) + 1):
        near = np.flatnonzero((region[w:] == region[:-w]) & (label[w:] != label[:-w]) & (reps[w:] != reps[:-w]))
        for at in range(0, len(near), 100_000):
            some = near[at : at + 100_000]
            some = some[(bits[some + w] == bits[some]).sum(axis=1) >= least]
            if w == 1:
                a_out += reps[some + 1].tolist()
                b_out += reps[some].tolist()
                linked = np.zeros(n, bool)
                linked[some + 1] = True
                if at == 0:
                    chain = linked
                else:
                    chain |= linked
                continue
            for i in some.tolist():
                x, y = _root(label, i), _root(label, i + w)
                if x != y:
                    label[max(x, y)] = min(x, y)
                    a_out.append(int(reps[i + w]))
                    b_out.append(int(reps[i]))
        if w == 1:
            if len(near):
                starts = np.flatnonzero(~chain)
                label = starts[np.cumsum(~chain) - 1]
        else:
            while True:
                flat = label[label]
                if (flat == label).all():
                    break
                label = flat
    return a_out, b_out


def _root(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        i = int(label[i])
    return i


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of one range of the order; its first and last rows go to the seams with the ranges beside it."""
    mine = TaskContext.get().partitionId()
    place: list[bytes] = []
    reps, bits = np.empty(0, np.int64), np.empty((0, VALUES), np.uint8)
    head = 0

    def rows(a, b, seam=None, places=None, bit=None):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([seam] * n, pa.int64()), pa.array(places or [None] * n, pa.binary()), pa.array(bit or [None] * n, pa.binary())], schema=_LINKS)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        new_place = batch.column("place").to_pylist()
        new_bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(-1, VALUES)
        new_reps = batch.column("rep").to_numpy()
        if head < NEIGHBOURS:
            k = min(NEIGHBOURS - head, len(new_reps))
            yield rows(new_reps[:k], [None] * k, mine - 1, new_place[:k], [b.tobytes() for b in new_bits[:k]])
            head += k
        place = place[-NEIGHBOURS:] + new_place
        reps, bits = np.concatenate([reps[-NEIGHBOURS:], new_reps]), np.concatenate([bits[-NEIGHBOURS:], new_bits])
        yield rows(*_pairs(place, reps, bits))
    tail = place[-NEIGHBOURS:]
    if tail:
        yield rows(reps[-len(tail) :], [None] * len(tail), mine, tail, [b.tobytes() for b in bits[-len(tail) :]])


def _seam(table: pa.Table) -> pa.Table:
    table = table.sort_by([("place", "ascending"), ("a", "ascending")])
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, VALUES)
    a, b = _pairs(table.column("place").to_pylist(), table.column("a").to_numpy(), bits)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _whole_region(table: pa.Table) -> pa.Table:
    """Candidate pairs among the rows of one region that other regions have not joined, by all their signatures."""
    table = table.combine_chunks()
    reps, label = table.column("rep").to_numpy(), np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, VALUES)
    least = int(np.ceil(LEAST_AGREEMENT * VALUES))
    a, b = [], []
    for i in range(1, len(reps)):
        near = np.flatnonzero(label[:i] != label[i])
        near = near[(bits[near] == bits[i]).sum(axis=1) >= least]
        for j in near.tolist():
            if label[j] != label[i]:
                a.append(int(reps[i]))
                b.append(int(reps[j]))
                label[label == label[i]] = label[j]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def candidates(reps: DataFrame, partitions: int) -> DataFrame:
    """a, b: candidate pairs of classes. reps: rep, signature."""
    regions = reps.mapInArrow(_regions, "region bigint, rep bigint, tree int")
    shared = regions.groupBy("region").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("region")
    crowded = regions.join(shared, "region").join(reps, "rep")
    keyed = crowded.mapInArrow(_keyed, "region bigint, place binary, rep bigint, bits binary")
    keyed = materialise(keyed, "places")
    ordered = keyed.select("place", "rep", "bits").repartitionByRange(partitions, "place", "rep").sortWithinPartitions("place", "rep")
    found = materialise(ordered.mapInArrow(_neighbours, _LINKS_DDL), "neighbours")
    seams = found.filter("seam is not null").groupBy("seam").applyInArrow(_seam, "a bigint, b bigint")
    near = materialise(found.filter("seam is null").select("a", "b").unionByName(seams), "near")
    # regions larger than a window in which rows are still apart
    sizes = keyed.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > NEIGHBOURS + 1)
    wide = materialise(keyed.select("region", "rep").join(sizes, "region"), "wide")
    if wide.isEmpty():
        return near
    # what follows needs no more of the pairs than the stars that they make
    stars = materialise(components(near), "stars")
    near = stars.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = stars.withColumnRenamed("node", "rep")
    wide = wide.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    apart = wide.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("region")
    wide = materialise(wide.join(apart, "region"), "apart")
    some = wide.filter(F.col("n") <= CROWD).join(keyed.select("region", "rep", "bits"), ["region", "rep"])
    compared = some.select("region", "rep", "label", "bits").groupBy("region").applyInArrow(_whole_region, "a bigint, b bigint")
    # one representative of each part of a large region: the parts are joined, step 4 sees all their rows
    parts = wide.filter(F.col("n") > CROWD).groupBy("region", "label").agg(F.min("rep").alias("rep"))
    first = parts.groupBy("region").agg(F.min("rep").alias("b"))
    joined = parts.join(first, "region").select(F.col("rep").alias("a"), "b").filter("a <> b")
    return near.unionByName(compared).unionByName(joined)


def linked(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """New labels: classes with equal labels or with 100 * intersection >= percent * union share one (the smallest id).

    Codes are numbered from the rarest on. Two sets that are linked share at least percent of the larger one, so
    the rarest codes of each, all but that many less one, have a code in common: only those are indexed and
    looked up, and what is found is counted on the full sets.
    """
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.empty(len(often), np.int64)
    number[np.argsort(often, kind="stable")] = np.arange(len(often))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(m), sizes)
    code = number[code]
    code = code[np.lexsort((code, owner))]  # each set's codes, the rarest first
    rare = sizes - (percent * sizes + 99) // 100 + 1
    indexed = np.arange(len(code)) - begin[owner] < rare[owner]
    order = np.argsort(code[indexed], kind="stable")
    posting = owner[indexed][order]
    edge = np.searchsorted(code[indexed][order], np.arange(len(often) + 1))
    _, start = np.unique(labels, return_inverse=True)
    by_start: dict[int, list[int]] = {}
    for i, s in enumerate(start.tolist()):
        by_start.setdefault(s, []).append(i)
    unseen = np.ones(m, bool)
    out = labels.copy()
    mark = np.zeros(len(often), bool)

    def runs(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The places lo, lo + 1, ... of each run of length n, one run after the other."""
        return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    def partners(x: int, among: np.ndarray) -> np.ndarray:
        """Which of the classes in the mask ``among`` x is linked with."""
        own = code[begin[x] : begin[x + 1]]
        first = own[: rare[x]]
        near = np.unique(posting[runs(edge[first], edge[first + 1] - edge[first])])
        near = near[among[near] & (100 * sizes[near] >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes[near])]
        if not len(near):
            return near
        mark[own] = True
        both = np.add.reduceat(mark[code[runs(begin[near], sizes[near])]], np.concatenate([[0], np.cumsum(sizes[near])[:-1]]), dtype=np.int64)
        mark[own] = False
        return near[100 * both >= percent * (sizes[near] + sizes[x] - both)]

    left = m
    for first in range(m):
        if not unseen[first]:
            continue
        group = list(by_start[int(start[first])])
        unseen[group] = False
        left -= len(group)
        done = 0
        while done < len(group) and left:
            if left < len(group) - done:  # fewer classes outside than inside: ask those
                inside = np.zeros(m, bool)
                inside[group] = True
                grew = True
                while grew and left:
                    grew = False
                    for u in np.flatnonzero(unseen).tolist():
                        if unseen[u] and len(partners(u, inside)):
                            more = [i for i in by_start[int(start[u])] if unseen[i]]
                            group += more
                            unseen[more], inside[more], grew = False, True, True
                            left -= len(more)
                break
            hit = partners(group[done], unseen)
            done += 1
            for u in hit.tolist():
                if unseen[u]:
                    more = [i for i in by_start[int(start[u])] if unseen[i]]
                    group += more
                    unseen[more] = False
                    left -= len(more)
        out[group] = min(ids[group].min(), labels[group].min())
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            sets = shingle_sets(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("block"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())], names=["rep", "label", "block", "shingles", "digest"])


def _linker(percent: int):
    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, labels = table.column("rep").to_numpy(), table.column("now").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        new = linked(ids, labels, sets, percent)
        a = np.concatenate([ids, labels])
        b = np.concatenate([new, new])
        keep = a != b
        return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})

    return link


def _large_groups(items: DataFrame, percent: int) -> DataFrame:
    """Edges of groups beyond one task's share. items: label (group), block, rep, shingles; exact, see the module's text.

    There are fewer such groups than partitions, and few blocks of each, so what says something of a group or a block
    is broadcast: only (group, block) decides where rows go, never the group alone.
    """
    link = _linker(percent)
    pair = "a bigint, b bigint"
    edges = materialise(items.withColumn("now", F.col("rep")).groupBy("label", "block").applyInArrow(link, pair), "links")
    blocks = items.select(F.col("label").alias("of"), F.col("block").alias("to")).distinct()
    for _ in range(3):  # leaders of what is linked so far meet every block of their group
        now = materialise(components(edges), "linked")
        edges = now.select(F.col("node").alias("a"), F.col("label").alias("b"))
        named = items.join(now.withColumnRenamed("label", "low"), items["rep"] == now["node"], "left").drop("node").withColumn("now", F.coalesce("low", "rep")).drop("low")
        named = materialise(named, "named")
        leaders = named.filter("rep = now")
        few = leaders.groupBy("label").agg(F.sum(F.length("shingles") / 8).alias("n"), F.count("*").alias("k")).filter((F.col("n") <= GROUP_SHINGLES) & (F.col("k") > 1)).select(F.col("label").alias("of"))
        few = F.broadcast(few)
        sent = leaders.join(few, leaders["label"] == few["of"], "left_semi")
        copies = sent.join(F.broadcast(blocks), sent["label"] == blocks["of"]).filter("block <> to").select("label", F.col("to").alias("block"), "rep", "shingles", "now")
        meet = named.join(few, named["label"] == few["of"], "left_semi").select("label", "block", "rep", "shingles", "now").unionByName(copies)
        more = materialise(meet.groupBy("label", "block").applyInArrow(link, pair), "links")
        if more.isEmpty():
            break
        edges = materialise(edges.unionByName(more).distinct(), "links")
    now = components(edges)
    named = items.join(now.withColumnRenamed("label", "low"), items["rep"] == now["node"], "left").withColumn("now", F.coalesce("low", "rep")).select("label", "block", "rep", "shingles", "now")
    named = materialise(named, "named")
    sizes = named.groupBy("label", "now").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("label").agg(F.max_by("now", F.struct("k", "now")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select(F.col("label").alias("of"), "main")
    open_groups = named.join(F.broadcast(largest), named["label"] == largest["of"])
    outside = open_groups.filter("now <> main").select("label", "block", "rep", "shingles", "now")
    outside_blocks = outside.select(F.col("label").alias("of2"), F.col("block").alias("other")).distinct()
    left = outside.withColumnRenamed("block", "other").join(F.broadcast(blocks), F.col("label") == F.col("of")).select("label", "other", F.col("to").alias("block"), "rep", "shingles", "now")
    right = open_groups.select("label", "block", "rep", "shingles", "now").join(F.broadcast(outside_blocks), F.col("label") == F.col("of2")).select("label", "other", "block", "rep", "shingles", "now")
    last = left.unionByName(right).dropDuplicates(["label", "other", "block", "rep", "shingles"]).groupBy("label", "other", "block").applyInArrow(link, pair)
    return edges.unionByName(last)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    A document's set is its distinct SHINGLE-word shingles; with fewer words its whole sequence is
    one shingle; null and wordless texts have none and are linked with nothing. Documents are linked
    where 100 * intersection >= percent * union, on full sets; component_id is the smallest doc_id
    reachable. Rows without doc_id take no part and have a null component_id; rows that repeat a
    doc_id are one node; an empty table gives an empty result; of other columns none is read.
    """
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(texts.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, digest binary, signature binary"), "signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.count("*").alias("rows"))
    classes = materialise(classes, "classes")
    same = (full["digest"] == classes["digest"]) & (full["doc_id"] == classes["rep"])
    reps = materialise(full.join(classes, same).select("rep", "n", classes["digest"], "signature").dropDuplicates(["rep", "digest"]), "reps")
    groups = components(candidates(reps.select("rep", "signature"), partitions))
    weights = groups.join(reps.groupBy("rep").agg(F.sum("n").alias("n")), groups["node"] == F.col("rep")).groupBy("label").agg(F.sum("n").alias("n"))
    weights = materialise(weights, "weights")
    # a group of k shares of the work is cut into about sqrt(2 k) blocks, whose pairs are then k tasks
    total = weights.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = min(GROUP_SHINGLES, max(LEAST_SHINGLES, total // (2 * partitions)))
    blocks = F.when(F.col("n") <= 2 * share, F.lit(1)).otherwise(F.greatest(F.ceil(F.col("n") * 2 / F.lit(GROUP_SHINGLES)), F.ceil(F.sqrt(F.col("n") * 2 / F.lit(share)))))
    # fewer groups than partitions have two shares or more: they are broadcast, so that no group's rows meet here
    cut = weights.filter(F.col("n") > 2 * share).select("label", blocks.alias("blocks"))
    sized = groups.join(F.broadcast(cut), "label", "left")
    member = materialise(sized.select("node", "label", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.lit(-1)).cast("long").alias("block")), "members")
    small = member.count() <= MOST_BROADCAST
    chosen = texts.join(F.broadcast(member) if small else member, texts["doc_id"] == member["node"]).select("doc_id", "text", "label", "block")
    sets = chosen.mapInArrow(_sets, "rep bigint, label bigint, block bigint, shingles binary, digest binary")
    sets = materialise(sets.join(reps.select("rep", "digest"), ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"]).drop("digest"), "sets")
    edges = sets.filter("block = -1").withColumn("now", F.col("rep")).groupBy("label").applyInArrow(_linker(percent), "a bigint, b bigint")
    if not member.filter("block >= 0").isEmpty():
        edges = edges.unionByName(_large_groups(sets.filter("block >= 0"), percent))
    found = components(edges)
    lows = classes.join(found.withColumnRenamed("label", "low"), classes["rep"] == found["node"], "left").select("digest", "rows", F.coalesce("low", "rep").alias("low"))
    lows = materialise(lows, "lows")
    # documents without words share a digest but no class; classes with more copies than a task's share, of which
    # there are few, are broadcast, so that their copies need not meet
    words, none = signed.filter("n_shingles > 0"), signed.filter("n_shingles = 0")
    hub = max(1000, lows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] // partitions)
    hubs = lows.filter(F.col("rows") > hub).select(F.col("digest").alias("hub"), F.col("low").alias("hub_low"))
    told = words.join(F.broadcast(hubs), words["digest"] == F.col("hub"), "left")
    hot = told.filter("hub is not null").select("doc_id", "n_shingles", F.col("hub_low").alias("low"))
    rest = told.filter("hub is null").select("doc_id", "n_shingles", "digest").join(lows.filter(F.col("rows") <= hub).select("digest", "low"), "digest", "left").select("doc_id", "n_shingles", "low")
    out = hot.unionByName(rest).unionByName(none.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("low")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component (that whose doc_id is the component_id), with the columns of docs.

    Of rows that repeat a doc_id the one with the smallest row hash stays; rows without doc_id are
    linked with nothing and all stay. Only rows that repeat a kept doc_id are grouped; all others stay where they are
    if the kept ids are few enough to broadcast, and are joined by doc_id otherwise.
    """
    found = near_duplicates(docs, percent).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"))
    found = materialise(found, "kept")
    ids = found.filter("rows = 1")
    if found.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    own = F.col("doc_id").cast("long")
    once = docs.join(ids, own == ids["kept_id"], "left_semi")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("own_id"), F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t]).alias("mark"))
    again = found.filter("rows > 1")
    repeated = again.count()
    out = once.unionByName(docs.filter("doc_id is null"))
    if not repeated:  # else all texts would be shuffled for a join with nothing
        return out
    if repeated <= MOST_BROADCAST:
        again = F.broadcast(again)
    several = rows.join(again, rows["own_id"] == again["kept_id"], "left_semi").groupBy("own_id").agg(F.min_by("row", "mark").alias("row"))
    return out.unionByName(several.select("row.*"))


def op10_near_duplicates(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE} - 1], ' ') AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE} + 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id, d.doc_id = c.low AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) c ON c.a = d.doc_id
"""
