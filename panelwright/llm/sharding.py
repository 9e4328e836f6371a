"""Sharding: a hierarchical weighted hash tree of regions, racks and shards.

A row descends the tree. At each level every child makes a draw from a hash of its own name and
the row's key, ``-ln(u) / weight``, and the least draw wins, so a child gets rows in proportion to
its weight. A child's draw depends on nothing but its name, its weight and the key: when a weight
changes, rows move only into or out of that child's subtree. A shard added as a region of its own
takes rows from everywhere and leaves all others where they are.

Only the key and the tree decide. Null keys are one key of their own. Rows with equal keys go to
the same shard. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.llm.common import documents, query, settle

#: Each shard's rows are numbered in so many parts, so no shard is numbered by one task.
SLOT_PARTS = 1024


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A shard has a number and no children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> Node:
    """A tree of equal shards, numbered in order."""
    number = iter(range(regions * racks * shards))
    return Node(
        "root",
        tuple(
            Node(
                f"region{r}",
                tuple(
                    Node(
                        f"region{r}/rack{k}",
                        tuple(Node(f"shard{n}", shard=n) for n in (next(number) for _ in range(shards))),
                    )
                    for k in range(racks)
                ),
            )
            for r in range(regions)
        ),
    )


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    name = f"grown{shard}"
    rack = Node(f"{name}/rack0", (Node(f"shard{shard}", shard=shard, own_weight=weight),))
    return Node(tree.name, (*tree.children, Node(name, (rack,))))


def draw(name: str, weight: float, key: Column) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1) from the hash of the name and the key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / F.lit(float(weight))


def place(tree: Node, key: Column) -> Column:
    """Number of the shard a key descends to."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return place(tree.children[0], key)
    least = F.least(
        *[F.struct(draw(c.name, c.weight, key).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(tree.children)]
    )["child"]
    out = F.lit(None).cast("int")
    for i, child in reversed(list(enumerate(tree.children))):
        out = F.when(least == i, place(child, key)).otherwise(out)
    return out


def with_slots(rows: DataFrame, order: list[str], parts: int = SLOT_PARTS) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... within ``shard``, without a gap.

    Each shard's rows are dealt to ``parts`` parts by hash; parts are numbered by themselves and
    start where the parts before them end. ``rows`` has ``shard`` and the columns of ``order``,
    and is written once, as counting and numbering must see the same rows.
    """
    dealt = settle(rows.withColumn("_part", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(parts)).cast("int")))
    sizes = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order))
    return (
        dealt.join(starts, ["shard", "_part"])
        .withColumn("slot", (F.col("_start") + within - 1).cast("long"))
        .drop("_part", "_start")
    )


def shard_documents(docs: DataFrame, tree: Node | None = None, more: bool = True) -> DataFrame:
    """One row per document: its key, size, place, slot and its place with one more shard."""
    tree = tree or even_tree()
    text = F.coalesce(F.col("text"), F.lit(""))
    last = max(_shards(tree)) + 1
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(tree, F.col("doc_id")).cast("int").alias("shard"),
        (place(grown(tree, last), F.col("doc_id")) if more else F.lit(None)).cast("int").alias("grown_shard"),
    )
    return with_slots(rows, ["doc_id", "size", "text_crc32"])


def _shards(tree: Node) -> list[int]:
    return [tree.shard] if tree.shard is not None else [s for c in tree.children for s in _shards(c)]


@query("op2_hash_tree_shards")
def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
