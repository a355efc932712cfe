"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. At each node it draws once for every child, -ln(u) / weight with u from a
hash of (the child's name, doc_id) and the weight of all shards below the child, and goes to the
least draw. The least of such draws falls on a child with probability equal to its share of the
weight. Only the children on the row's own path are drawn: 3 + 2 + 4 for 24 shards.

A draw depends on nothing but the child's name and weight. So a changed weight moves rows between
its own subtree and the rest, at each level, and never between two subtrees that did not change.
A tree grows by a region of its own for the new shard: then no weight of the old tree changes, and
rows move only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Bits of the hash that make u.
_BITS = 52


@dataclass(frozen=True)
class Tree:
    """Regions of racks of (shard, weight); names are positions, so a new region at the end changes no name."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(shards: int, regions: int = 3, racks: int = 2, weights: tuple[float, ...] = ()) -> Tree:
        """Shard s under region s % regions and its rack (s // regions) % racks; weights that are not given are 1."""
        found: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for s in range(shards):
            found.setdefault(s % regions, {}).setdefault((s // regions) % racks, []).append((s, float(weights[s]) if s < len(weights) else 1.0))
        return Tree(tuple(tuple(tuple(shelf) for shelf in region.values()) for region in found.values()))

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own."""
        new = 1 + max((s for region in self.regions for rack in region for s, _ in rack), default=-1)
        return Tree((*self.regions, (((new, weight),),)))


def _weight(node) -> float:
    """The weight of all shards below a node."""
    return node[1] if isinstance(node[0], int) else sum(map(_weight, node))


def _u(key: Column, name: Column) -> Column:
    """Between 0 and 1, from a hash of a node's name and the key."""
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), key).cast("binary")), 1, _BITS // 4), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << _BITS))


def _nodes(tree: Tree) -> list[dict[str, tuple]]:
    """The inner nodes of each level by name: regions of the root, racks of regions, shards of racks."""
    levels: list[dict[str, tuple]] = [{"root": tree.regions}]
    for _ in range(2):
        levels.append({f"{name}/{i}": child for name, children in levels[-1].items() for i, child in enumerate(children)})
    return levels


def _step(key: Column, at: Column, nodes: dict[str, tuple]) -> Column:
    """The name of the child that a row at one of these nodes goes to; children without weight are never drawn."""
    draws = []
    for i in range(max(map(len, nodes.values()))):
        weights = {name: _weight(children[i]) for name, children in nodes.items() if i < len(children) and _weight(children[i]) > 0}
        weight = F.lit(None).cast("double")
        for value in sorted(set(weights.values())):
            having = [name for name, w in weights.items() if w == value]
            weight = F.lit(value) if len(having) == len(nodes) else F.when(at.isin(having), F.lit(value)).otherwise(weight)
        draw = -F.ln(_u(key, F.concat(at, F.lit(f"/{i}")))) / weight
        draws.append(F.when(weight.isNotNull(), F.struct(draw.alias("draw"), F.lit(i).alias("child"))))
    taken = draws[0] if len(draws) == 1 else F.least(*draws)
    return F.concat(at, F.lit("/"), taken["child"].cast("string"))


def place(rows: DataFrame, key: str, trees: dict[str, Tree]) -> DataFrame:
    """rows with the shard of ``key`` in each tree under the given name; null keys are one key.

    One projection for each level: a step reads where the row is, and only that node's children are drawn.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = rows.withColumns({name: F.lit("root") for name in trees})
    for level in range(3):
        rows = rows.withColumns({name: _step(text, F.col(name), _nodes(tree)[level]) for name, tree in trees.items()})
    leaves = {name: {f"{rack}/{i}": leaf[0] for rack, shelf in _nodes(tree)[2].items() for i, leaf in enumerate(shelf)} for name, tree in trees.items()}
    return rows.withColumns({name: F.element_at(F.create_map(*(F.lit(x) for pair in leaves[name].items() for x in pair)), F.col(name)) for name in trees})


def shard_documents(docs: DataFrame, shards: int = 24, regions: int = 3, racks: int = 2, weights: tuple[float, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``key``: doc_id and the tree decide. Null text counts as no bytes; null doc_ids are one key;
    rows that repeat a doc_id share its shard and get slots of their own; an empty table gives an
    empty result; columns other than doc_id and text are not read.

    Slots number a shard's rows by (doc_id, text_crc32, size), without gaps and without gathering a
    shard in one task: rows are range-partitioned by (shard, doc_id, ...), numbered where they lie, and
    each run of a shard in a partition is moved by the rows before it. Rows get a number of their own
    before that, so equal rows can be divided too. Both steps are written, so a task that runs again
    finds the same numbers.
    """
    now = Tree.even(shards, regions, racks, weights)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = place(rows, "doc_id", {"shard": now, "grown_shard": now.grown()})
    order = ["shard", "doc_id", "text_crc32", "size", "nth"]
    rows = materialise(rows, "placed")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # the number holds the partition in its upper bits and counts below them
    rows = materialise(rows.withColumn("part", F.shiftright("at", 33)), "ordered")
    runs = rows.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("move"))
    # at most one row for each partition and one for each shard
    return rows.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") + F.col("move")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def _sql_descend(children, name: str, below) -> str:
    """DuckDB SQL of the same descent."""
    live = [(c, f"{name}/{i}") for i, c in enumerate(children) if _weight(c) > 0]
    if len(live) == 1:
        return below(*live[0])
    draws = ", ".join(f"{{'d': -ln((CAST('0x' || substr(md5('{n}:' || key), 1, {_BITS // 4}) AS BIGINT) + 0.5) / {float(1 << _BITS)!r}) / {_weight(c)!r}, 'i': {i}}}" for i, (c, n) in enumerate(live))
    return f"CASE list_min([{draws}]).i " + " ".join(f"WHEN {i} THEN {below(*child)}" for i, child in enumerate(live)) + " END"


def sql_place(tree: Tree) -> str:
    shard = lambda leaf, name: str(leaf[0])
    rack = lambda node, name: _sql_descend(node, name, shard)
    region = lambda node, name: _sql_descend(node, name, rack)
    return _sql_descend(tree.regions, "root", region)


def oracle(shards: int = 24) -> str:
    tree = Tree.even(shards)
    return f"""
WITH RECURSIVE crc_table(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_table WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM crc_table WHERE k = 8),
base AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
placed AS (
  SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size,
    CAST(CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) END AS BIGINT) AS text_crc32,
    {sql_place(tree)} AS shard, {sql_place(tree.grown())} AS grown_shard
  FROM base, crc
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed
"""


ORACLE = oracle()
