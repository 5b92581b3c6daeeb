"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A key descends region, rack and shard levels. At each node every child draws -ln(u) / weight, with u a hash of the key and
the child's name; the least draw wins, so a child gets its share of the weight, and changing a child's weight moves keys
only to it or from it. A weight that changes deep in the tree changes its ancestors' weights and no other draw: movement
stays within the subtrees on that path and the flow into or out of them.

grow() adds a shard as a branch of its own: all other draws stay, so it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import cut


@dataclass(frozen=True)
class Node:
    """A shard (with its number), or a region or rack with children. Its weight is its own or its children's sum."""

    name: str
    shard: int | None = None
    own: float = 1.0
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own

    @property
    def count(self) -> int:
        return sum(c.count for c in self.children) if self.children else 1


def tree(shards: int, racks: int = 2, per_rack: int = 4) -> Node:
    """Shards 0 to shards - 1 of weight 1, `per_rack` in a rack and `racks` racks in a region, by number."""
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        rack = s // per_rack
        regions.setdefault(rack // racks, {}).setdefault(rack, []).append(Node(f"shard-{s}", s))
    return Node("root", children=tuple(Node(f"region-{r}", children=tuple(Node(f"rack-{k}", children=tuple(v)) for k, v in of.items())) for r, of in regions.items()))


def grow(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    s = root.count
    new = Node(f"region+{s}", children=(Node(f"rack+{s}", children=(Node(f"shard-{s}", s, weight),)),))
    return Node(root.name, children=(*root.children, new))


def draw(key: Column, child: Node) -> Column:
    """-ln(u) / weight, with u in (0, 1) from 53 bits of a hash of key and name."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(child.weight))


def descend(key: Column, node: Node) -> Column:
    """The number of the shard that a key reaches below a node."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    least = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]
    if all(not c.children for c in node.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), least + 1)
    # the winner is found once; only its branch is evaluated
    out = None
    for i, c in enumerate(node.children):
        hit = least == i
        out = F.when(hit, descend(key, c)) if out is None else out.when(hit, descend(key, c))
    return out


def assign(docs: DataFrame, root: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot, grown_shard: a row for each row of docs.

    The id alone decides (law `key`): rows of the same id, null too, share a shard. size: UTF-8 bytes of the text and one;
    a null text has none, and the checksum of an empty one. Slots of a shard run from 0 without gap, by input partition
    and in it by id, size and checksum; ties are in any order.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        key.alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
    )
    grown_shard = descend(F.col("id"), grown) if grown else F.lit(None).cast("int")
    # the partition that a row was read in must be the same for both uses below
    placed = cut(rows.select("*", descend(F.col("id"), root).cast("int").alias("shard"), grown_shard.cast("int").alias("grown_shard")))
    return placed.sparkSession.sql(
        """
        WITH counts AS (SELECT shard, part, count(*) AS n FROM {placed} GROUP BY shard, part),
             firsts AS (SELECT shard, part, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY shard, part ORDER BY id, size, text_crc32) AS place FROM {placed})
        SELECT r.id, r.size, r.text_crc32, r.shard, CAST(f.before + r.place - 1 AS BIGINT) AS slot, r.grown_shard
        FROM ranked r JOIN firsts f ON r.shard = f.shard AND r.part = f.part
        """,
        placed=placed,
    )
