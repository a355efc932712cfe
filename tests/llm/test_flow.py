"""Sharding and mixing: laws, movement, targets, odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from juriscope.llm import mixing, sharding


def test_slots_and_sizes(odd_docs, odd_rows):
    got = sharding.shard_documents(odd_docs, shards=5).collect()
    assert len(got) == len(odd_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 5 and r.grown_shard in (r.shard, 5) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())


def plain_shard(key, tree):
    """The descent in plain Python."""
    node, name = tree.regions, "root"
    for _ in range(3):
        draws = []
        for i, child in enumerate(node):
            weight = sharding._weight(child)
            if weight > 0:
                u = (int(hashlib.md5(f"{name}/{i}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                draws.append((-math.log(u) / weight, i))
        i = min(draws)[1]
        node, name = node[i], f"{name}/{i}"
    return node[0]


def places(spark, n, **trees):
    rows = sharding.place(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", trees).collect()
    return [r.asDict() for r in sorted(rows)]


def test_descent_against_plain_python(spark, odd_docs, odd_rows):
    trees = {"a": sharding.Tree.even(24), "b": sharding.Tree.even(24).grown(), "c": sharding.Tree.even(7, 2, 3, (1, 2.5, 0, 4)), "d": sharding.Tree.even(1)}
    for r in places(spark, 400, **trees):
        assert all(r[n] == plain_shard(r["doc_id"], t) for n, t in trees.items())
    got = {(r.doc_id, r.shard, r.grown_shard) for r in sharding.shard_documents(odd_docs, shards=5).collect()}
    small = sharding.Tree.even(5)
    assert got == {(d, plain_shard(d, small), plain_shard(d, small.grown())) for d, _, _ in odd_rows}


def region_of(shard):
    return shard % 3


def rack_of(shard):
    return shard % 3, shard // 3 % 2


def test_movement_is_confined_to_changed_subtrees(spark):
    """A heavier shard draws rows into its region, within the region into its rack, within the rack into itself; nothing else moves."""
    rows = places(spark, 20000, a=sharding.Tree.even(12), b=sharding.Tree.even(12, weights=(1, 1, 1, 3)))
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert all(region_of(b) == 0 for _, b in moved)
    inside = [(a, b) for a, b in moved if region_of(a) == 0]
    assert all(rack_of(b) == rack_of(3) for a, b in inside) and all(b == 3 for a, b in inside if rack_of(a) == rack_of(3))
    shares = Counter(r["b"] for r in rows)
    assert abs(shares[3] / 20000 - 3 / 14) < 0.02 and abs(shares[5] / 20000 - 1 / 14) < 0.01
    assert max(Counter(r["a"] for r in rows).values()) < 20000 / 12 * 1.15


def test_gone_shard_empties_and_leaves_other_regions(spark):
    rows = places(spark, 5000, a=sharding.Tree.even(12), b=sharding.Tree.even(12, weights=(1, 1, 0)))
    assert all(r["b"] != 2 for r in rows)
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    # out of shard 2's region to others, or inside that region; never between two other regions
    assert moved and all(region_of(a) == 2 for a, _ in moved)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = places(spark, 20000, a=sharding.Tree.even(24), b=sharding.Tree.even(24).grown())
    moved = [r for r in rows if r["a"] != r["b"]]
    assert all(r["b"] == 24 for r in moved) and abs(len(moved) - 20000 / 25) < 120


def test_the_shape_of_the_tree_matters(spark):
    rows = places(spark, 3000, a=sharding.Tree.even(24, 3, 2), b=sharding.Tree.even(24, 4, 2))
    assert sum(r["a"] != r["b"] for r in rows) > 2000


def test_slots_of_repeated_rows(spark):
    """One doc_id and text holds most rows: equal rows are divided over partitions and numbered once each."""
    docs = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN 7 ELSE id END AS doc_id", "'same' AS text").repartition(9)
    slots = defaultdict(list)
    for r in sharding.shard_documents(docs, shards=4).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 4000 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_tables(no_docs):
    assert sharding.shard_documents(no_docs).collect() == []
    assert mixing.copies(no_docs).collect() == []
    assert mixing.mix(no_docs).collect() == []


def water(sizes, weights, share, cap):
    """Targets by sharing out and resharing the excess until none is above its cap."""
    total, out, left = share * sum(sizes.values()), {}, dict(sizes)
    while left:
        w = sum(weights[k] for k in left)
        level = (total - sum(out.values())) / w
        full = [k for k in left if level * weights[k] > cap * sizes[k]]
        if not full:
            out |= {k: level * weights[k] for k in left}
            break
        for k in full:
            out[k] = cap * sizes[k]
            del left[k]
    return out


def test_targets_and_copies(odd_docs, odd_rows):
    got = mixing.copies(odd_docs).collect()
    assert len(got) == len(odd_rows)
    sizes = defaultdict(int)
    for _, t, s in odd_rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    goal = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.copies in (int(r.target // r.source_size), int(r.target // r.source_size) + 1) if r.source_size else r.copies == 0
        assert r.copies <= 2
    again = mixing.copies(odd_docs).collect()
    assert Counter(got) == Counter(again)


def test_mix_emits_the_copies(odd_docs):
    want = Counter()
    for r in mixing.copies(odd_docs).collect():
        want[(r.doc_id, r.size)] += r.copies
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    have = Counter((r.doc_id, len((r.text or "").encode().split())) for r in mixed.collect())
    assert have == +want


def test_taken_nears_target(spark):
    rows = [(i, "w " * (20 + i % 50), f"s{i % 6}") for i in range(6000)]
    got = mixing.op5_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, goal = defaultdict(int), {}
    for r, (_, _, s) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        taken[s] += r.taken
        goal[s] = r.target
    assert all(abs(taken[s] - goal[s]) < 0.05 * goal[s] for s in goal)
