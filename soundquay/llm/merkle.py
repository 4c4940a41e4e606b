"""Merkle manifest of a dataset: a digest for every row, one root, and proofs that rows are unchanged.

Rows are leaves, in order inside their group; runs of ``fanout`` consecutive nodes become a parent,
up to one root for a group, and the group roots, in order, become one root for the dataset.

* Rows are numbered inside their group by range partitioning and cut into aligned blocks of
  ``fanout ** levels`` rows. A block holds whole subtrees, so it is hashed without the others.
* A block keeps each of its levels as one string of hex digests of WIDTH characters (as ASCII
  bytes, so that a substring is found by its offset). Parents are the hashes of its substrings of
  ``fanout`` digests; the substrings to the left and right of a node in its run are its siblings.
* Block roots are the leaves of the next tree, until each group has one block.

A block is all that one task holds at once, however many rows a group has; after each step there
are ``fanout ** levels`` times fewer nodes, and proofs of blocks are joined before rows are unfolded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay.llm.tables import Staged
from soundquay.operators.order import number_rows

WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose n_chars the report tampers with: one of so many, by the CRC-32 of the id.
TAMPERED = 7


@dataclass(frozen=True)
class Shape:
    """Children of a node, and levels that a block spans."""

    fanout: int = 2
    levels: int = 8


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields in order, each as its length in bytes, a colon and the value; null as -."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _parents(level: Column, shape: Shape) -> Column:
    run = WIDTH * shape.fanout
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
    hashes = F.transform(runs, lambda i: F.sha2(F.substring(level, i * run + 1, run), 256))
    return F.array_join(hashes, "").cast("binary")


def _levels(nodes: Column, height: Column, shape: Shape) -> Column:
    """The levels of a block from its nodes up to the height."""
    first = F.array(F.array_join(nodes, "").cast("binary"))
    steps = F.filter(F.sequence(F.lit(1), F.lit(shape.levels)), lambda k: k <= height)
    return F.aggregate(steps, first, lambda done, _: F.array_append(done, _parents(F.element_at(done, -1), shape)))


def _siblings(levels: Column, height: Column, at: Column, shape: Shape) -> Column:
    """What stands left and right of a node's ancestors in their runs, from the bottom up."""

    def segment(level: Column, k: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(shape.fanout), k)).cast("int")
        run = F.floor(place / shape.fanout).cast("int") * shape.fanout
        left = F.substring(level, run * WIDTH + 1, (place - run) * WIDTH)
        right = F.substring(level, (place + 1) * WIDTH + 1, (run + shape.fanout - 1 - place) * WIDTH)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), height), segment)


def climb(nodes: DataFrame, work: Staged, shape: Shape) -> DataFrame:
    """Root and siblings for numbered nodes.

    ``nodes`` has ``key``, ``at`` (from 0 without gaps inside a key), ``node`` (hex) and ``more``
    (anything to carry along); ``siblings`` and ``root`` are added.
    """
    block = shape.fanout**shape.levels
    item = F.struct("at", "node", "more")
    cut = nodes.groupBy("key", F.floor(F.col("at") / block).alias("block")).agg(
        F.sort_array(F.collect_list(item)).alias("items")  # a block: bounded
    )
    # a block that is not full and the first is its group's only one; it ends at one node
    powers = F.array(*[F.lit(shape.fanout**k) for k in range(shape.levels)])
    lowest = F.size(F.filter(powers, lambda x: x < F.size("items")))
    alone = (F.col("block") == 0) & (F.size("items") < block)
    shaped = cut.withColumn("height", F.when(alone, lowest).otherwise(shape.levels))
    node = F.transform("items", lambda x: x["node"])
    blocks = work.keep(shaped.withColumn("levels", _levels(node, F.col("height"), shape)), "blocks")
    top = F.element_at("levels", -1).cast("string")
    if blocks.filter("block > 0").isEmpty():
        none = F.array().cast("array<struct<left:string,right:string>>")
        placed = blocks.withColumn("above", none).withColumn("root", top)
    else:
        ups = blocks.select("key", F.col("block").alias("at"), top.alias("node"), F.lit(None).cast("int").alias("more"))
        above = climb(ups, work, shape)
        above = above.select("key", F.col("at").alias("block"), F.col("siblings").alias("above"), "root")
        placed = blocks.join(above, ["key", "block"])
    inside = F.posexplode("items").alias("_i", "_item")
    rows = placed.select("key", "root", "above", "levels", "height", inside)
    own = _siblings(F.col("levels"), F.col("height"), F.col("_i"), shape)
    return rows.select(
        "key", F.col("_item.at").alias("at"), F.col("_item.node").alias("node"), F.col("_item.more").alias("more"),
        F.concat(own, "above").alias("siblings"), "root",
    )


def proofs(rows: DataFrame, work: Staged, shape: Shape = Shape()) -> DataFrame:
    """``siblings`` (bottom up, through the group's root to the dataset's), ``subroot`` and ``root``.

    ``rows`` has ``group`` (string), ``rank`` (orderable), ``node`` and ``more``. Groups are ordered
    by their UTF-8 bytes, null first; rows by rank, null first, rows of one rank by node.
    """
    # the prefix tells a null group from an empty one and keeps the order
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "group"), F.lit("")))
    numbered = number_rows(keyed, ["rank", "node"], ["key"], "at").select("key", "at", "node", "more")
    inner = work.keep(climb(numbered, work, shape), "inner")
    groups = inner.groupBy("key").agg(F.first("root").alias("node"))
    ordered = number_rows(groups, ["key"], [], "at").select(
        F.lit("").alias("key"), "at", "node", F.col("key").alias("more")
    )
    outer = work.keep(climb(ordered, work, shape), "outer")
    outer = outer.select(F.col("more").alias("key"), F.col("siblings").alias("_above"), F.col("root").alias("_root"))
    return inner.join(outer, "key").select(
        "node", "more", F.concat("siblings", "_above").alias("siblings"), F.col("root").alias("subroot"),
        F.col("_root").alias("root"),
    )


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, claimed: Column, shape: Shape = Shape()) -> DataFrame:
    """Per document: doc_id, leaf, siblings, subroot, root and the root that the claimed leaf folds to.

    ``claimed`` is the digest of the row as it is found later, over columns of docs. Null fields
    count as ``-``; documents without an id come first in their language; equal ids are ordered by
    leaf; equal rows take neighbouring places; an empty table gives no rows; other columns of docs
    are not read.
    """
    work = Staged(docs.sparkSession, "merkle")
    leaf = digest([F.col(c) for c in FIELDS])
    # a claimed digest is kept only where it differs
    own = docs.select(F.col("doc_id").alias("id"), "lang", leaf.alias("node"), claimed.alias("claimed"))
    leaves = own.select(
        F.col("lang").alias("group"), F.col("id").alias("rank"), "node",
        F.struct("id", F.when(F.col("claimed") != F.col("node"), F.col("claimed")).alias("claimed")).alias("more"),
    )
    found = proofs(work.keep(leaves, "leaves"), work, shape)
    return found.select(
        F.col("more.id").alias("doc_id"), F.col("node").alias("leaf"), "siblings", "subroot", "root",
        folded(F.coalesce("more.claimed", "node"), F.col("siblings")).alias("folded_root"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The manifest held against rows of which one in TAMPERED has one added to n_chars."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    length = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = [length if c == "n_chars" else F.col(c) for c in FIELDS]
    return manifest(docs, digest(fields)).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("siblings")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
