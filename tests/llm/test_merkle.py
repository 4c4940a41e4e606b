"""Merkle manifests against a plain version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from soundquay.llm import merkle
from soundquay.llm.tables import Staged

from .corpora import DOCS, awkward


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    doc_id, text, lang, source, _ = row
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h(*parts)


def plain_tree(nodes, fanout):
    """Root, and for each node the (left, right) siblings from the bottom up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owned = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i:i + fanout]
            for j in range(len(run)):
                for o in owners[i + j]:
                    paths[o].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(h(*run))
            owned.append([o for x in owners[i:i + fanout] for o in x])
        nodes, owners = above, owned
    return nodes[0], paths


def plain(rows, fanout=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = [r for r in rows if r[2] == lang]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append((mine, *plain_tree([leaf(r, r[4]) for r in mine], fanout)))
    if not trees:
        return []
    root, above = plain_tree([t[1] for t in trees], fanout)
    out = []
    for (mine, subroot, paths), up in zip(trees, above, strict=True):
        for r, path in zip(mine, paths, strict=True):
            n = r[4]
            if n is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                n += 1
            fold = leaf(r, n)
            for left, right in path + up:
                fold = h(left, fold, right)
            proof = h(*[x + y for x, y in path + up])
            out.append((r[0], leaf(r, r[4]), subroot, root, proof, fold, fold == root))
    return sorted(out, key=str)


def tables():
    many = [(i, f"t{i}", "en" if i % 3 else None, "s", i if i % 5 else None) for i in range(150)]
    return [awkward() + [(5, "a", "", "s", 1), (5, "a", "", "s", 1)], many, many[:1], []]


@pytest.mark.parametrize("rows", tables())
def test_report(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("key", "at", "node", "group", "_key", "root", "block"):
        docs = docs.withColumn(name, F.lit("x"))
    got = merkle.report(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows)


@pytest.mark.parametrize("shape", [merkle.Shape(3, 2), merkle.Shape(2, 1), merkle.Shape(5, 1)])
def test_other_shapes(spark, shape):
    """Blocks far smaller than a group: several rounds of block roots."""
    rows = tables()[1]
    docs = spark.createDataFrame(rows, DOCS)
    claimed = merkle.digest([F.col(c) for c in merkle.FIELDS])
    found = merkle.manifest(docs, claimed, shape).withColumn("proof", merkle.proof_digest(F.col("siblings"))).collect()
    want = {r[0]: r[1:5] for r in plain(rows, shape.fanout)}
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof"]) for r in found} == want
    assert all(r["folded_root"] == r["root"] for r in found)


def test_proofs_of_other_rows(spark):
    rows = [(g, i, h(f"{g}{i}"), None) for g in ("b", "a", None) for i in range(9)]
    nodes = spark.createDataFrame(rows, "group string, rank int, node string, more int")
    found = merkle.proofs(nodes, Staged(spark, "proofs"), merkle.Shape(2, 2)).collect()
    order = [h(f"{g}{i}") for g in (None, "a", "b") for i in range(9)]
    subroots = [plain_tree(order[k:k + 9], 2)[0] for k in (0, 9, 18)]
    assert {r["root"] for r in found} == {plain_tree(subroots, 2)[0]}
    assert {r["node"]: r["subroot"] for r in found} == {n: subroots[i // 9] for i, n in enumerate(order)}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    assert sorted([tuple(r) for r in merkle.report(docs).collect()], key=str) == plain(rows)
