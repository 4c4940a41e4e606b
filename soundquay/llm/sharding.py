"""Hierarchical weighted hash tree: rows go to regions, racks and shards by weighted draws.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the row key and the
child's place in the tree; the smallest draw wins. A child is chosen in proportion to its weight,
and its draw does not depend on the other children: when the weight of a subtree changes, rows
move only into or out of it, and rows below other subtrees stay where they are.

All steps are DataFrame functions. Keys may be null (one key, the empty text) and may repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay.llm.slots import gapless
from soundquay.llm.tables import Staged

_STEPS = float(1 << 52)


@dataclass(frozen=True)
class Tree:
    """Weights of the shards, nested as regions of racks of shards; shards count in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own: no old subtree changes weight.

        Rows therefore move only into the new shard, whatever the size of the tree.
        """
        return Tree((*self.regions, ((weight,),)))


def even_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> Tree:
    return Tree((((1.0,) * shards,) * racks,) * regions)


def _draw(key: Column, level: str, child: Column | int, weight: Column) -> Column:
    place = F.concat_ws(":", key, F.lit(level), child if isinstance(child, Column) else F.lit(str(child)))
    part = F.conv(F.substring(F.md5(place), 1, 13), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((part + 0.5) / _STEPS) / weight)


def _least(key: Column, level: str, parent: Column | None, weights: list[Column]) -> Column:
    draws = []
    for i, weight in enumerate(weights):
        child = F.lit(str(i)) if parent is None else F.concat_ws(".", parent, F.lit(str(i)))
        draw = _draw(key, level, child, weight)
        draws.append(F.when(draw.isNotNull(), F.struct(draw.alias("draw"), F.lit(i).alias("i"))))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["i"]


def _at(values: list, *place: Column) -> Column:
    """Element of a nested literal table; null where the table has none."""

    def literal(x):
        return F.array(*[literal(y) for y in x]) if isinstance(x, list) else F.lit(x)

    out = literal(values)
    for p in place:
        out = F.get(out, p)
    return out


def assign(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Add ``region``, ``rack`` (inside the region) and ``shard`` (number in the whole tree)."""
    k = F.coalesce(key.cast("string"), F.lit(""))
    sums = [[float(sum(rack)) for rack in region] for region in tree.regions]
    first, n = [], 0
    for region in tree.regions:
        first.append([])
        for rack in region:
            first[-1].append(n)
            n += len(rack)
    region, rack, leaf = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    df = df.withColumn(region, _least(k, "region", None, [F.lit(float(sum(s))) for s in sums]))
    widest = max(len(s) for s in sums)
    below = [_at(sums, F.col(region), F.lit(i)) for i in range(widest)]
    df = df.withColumn(rack, _least(k, "rack", F.col(region).cast("string"), below))
    weights = [[list(map(float, rack)) for rack in region] for region in tree.regions]
    widest = max(len(r) for x in weights for r in x)
    below = [_at(weights, F.col(region), F.col(rack), F.lit(i)) for i in range(widest)]
    parent = F.concat_ws(".", F.col(region).cast("string"), F.col(rack).cast("string"))
    inside = _least(k, "shard", parent, below)
    return df.withColumn(leaf, (_at(first, F.col(region), F.col(rack)) + inside).cast("int"))


def shard_documents(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Shard rows of ``documents`` by doc_id under the law ``key``.

    The key is doc_id, the tree follows from the number of shards. Returns doc_id, size (UTF-8
    bytes of the text plus 8), text_crc32 (of the empty text for null), law, region, rack, shard,
    slot (from 0 inside a shard, without gaps) and grown_shard (with one more shard). Rows with
    one doc_id share a shard and get slots of their own. Other columns are not read. An empty
    table gives an empty result.
    """
    tree = tree or even_tree()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = assign(rows, F.col("doc_id"), tree)
    rows = assign(rows, F.col("doc_id"), tree.grown(), "grown_")
    rows = rows.withColumn(
        "order", F.md5(F.concat_ws(":", F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    ).drop("grown_region", "grown_rack")
    placed = Staged(docs.sparkSession, "shards").keep(rows, "placed")
    return gapless(placed, ["shard"], "order").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard",
        "slot", "grown_shard",
    )
