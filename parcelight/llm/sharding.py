"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards carries weights. A key descends from the root: at every level each child
draws -ln(u) / weight from a hash of (key, child) and the smallest draw wins, so a child is chosen in
proportion to its weight and a changed weight moves keys only into or out of the subtree that holds it.
A node's weight is the sum of its shards' weights. Growth adds a region: the only child whose weight changes at
the root is the new one, so rows move into the new shard alone.

The draw is one expression over the key; it needs no state, no shuffle and no table lookups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import gapless_rank


@dataclass(frozen=True)
class Node:
    name: str
    shard: int | None = None
    own_weight: float = 1.0
    children: tuple[Node, ...] = field(default_factory=tuple)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def cluster_tree(regions: list[list[list[float]]]) -> Node:
    """regions[r][k] lists the weights of the shards of rack k; shards are numbered in that order."""
    shard, tops = 0, []
    for r, racks in enumerate(regions):
        rack_nodes = []
        for k, weights in enumerate(racks):
            leaves = []
            for w in weights:
                leaves.append(Node(f"shard-{shard}", shard, float(w)))
                shard += 1
            rack_nodes.append(Node(f"region-{r}/rack-{k}", children=tuple(leaves)))
        tops.append(Node(f"region-{r}", children=tuple(rack_nodes)))
    return Node("root", children=tuple(tops))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    shard = n_shards(tree)
    r = len(tree.children)
    leaf = Node(f"shard-{shard}", shard, weight)
    region = Node(f"region-{r}", children=(Node(f"region-{r}/rack-0", children=(leaf,)),))
    return Node("root", children=(*tree.children, region))


def n_shards(tree: Node) -> int:
    return sum(n_shards(c) for c in tree.children) if tree.children else 1


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that the key's descent ends in. A null key has the hash of null and so one fixed shard."""
    if not tree.children:
        return F.lit(tree.shard).cast("int")
    if len(tree.children) == 1:
        return shard_of(key, tree.children[0])

    def draw(c: Node) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(c.name)), 11).cast("double")
        return -F.log((bits + 0.5) / float(1 << 53)) / F.lit(c.weight)

    won = F.array_min(F.array(*[F.struct(draw(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(tree.children)]))["i"]
    path = F.when(won == 0, shard_of(key, tree.children[0]))
    for i, c in enumerate(tree.children[1:], 1):
        path = path.when(won == i, shard_of(key, c))
    return path


#: Two regions of two racks of four equal shards.
SIXTEEN = cluster_tree([[[1, 1, 1, 1], [1, 1, 1, 1]], [[1, 1, 1, 1], [1, 1, 1, 1]]])


def assign_shards(docs: DataFrame, tree: Node = SIXTEEN, pieces: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard: every row of docs placed by doc_id.

    size is the UTF-8 bytes of the text plus 1; a null text counts as empty (size 1, checksum 0). slot numbers the
    rows of a shard from 0 without gaps, by hash piece, then doc_id, checksum and size; equal rows may swap slots.
    Rows with one doc_id share a shard; a null doc_id is a key like any other. An empty table gives no rows. Other
    columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"),
    )
    return gapless_rank(rows, ["shard"], F.col("doc_id"), ["doc_id", "text_crc32", "size"], "slot", pieces)


def query(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
