"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The word n-grams of the test items are counted over all documents. Each item keeps those that
occur but for its commonest tenth, and the rarest one of every few neighbours, as seeds: which seeds are taken
depends on their order within the item only, so an item that leaked into very many documents keeps
its seeds. Documents are walked for seeds; a passage is the words around neighbouring seeds. Seeds
join passages to items, and local alignment of words scores each pair, so that copies with
replaced, inserted and dropped words are found.

The walk over the documents carries two bit maps of fixed size, whatever the benchmark holds; what
passes them by chance falls out in the join on the full hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundquay.llm.tables import Staged, unused

N = 3
#: An item's neighbouring n-grams of which the rarest is always a seed.
NEIGHBOURS = 6
#: Items with fewer seeds than this need one seed in a passage, others two.
FEW_SEEDS = 4
LEAST_SIMILARITY = 0.45
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds this many words apart belong to one passage.
REACH = 32
_BITS = 1 << 22
_WORD = re.compile(r"\w+")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of a text; null and empty texts have none."""
    found = _WORD.findall((text or "").lower())
    return np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in found), np.uint32, len(found))


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the word n-grams; a text of fewer words is one n-gram, one of no words has none."""
    if not len(codes):
        return np.zeros(0, np.int64)
    n = min(N, len(codes))
    x = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        x = (x * _STEP) ^ codes[k : len(codes) - n + 1 + k].astype(np.uint64)
        x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes; at most _BITS numbers reach the driver."""
    at = hashes.select(F.expr(f"cast(hash & {_BITS - 1} as int)").alias("at")).distinct().toPandas()["at"]
    out = np.zeros(_BITS, bool)
    out[at.to_numpy(np.int64)] = True
    return out


def _hits(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    return bits[found & (_BITS - 1)]


def _counter(bits):
    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for part in parts:
            for text in part["text"]:
                found = grams(words(text))
                for h in np.unique(found[_hits(bits.value, found)]).tolist():
                    seen[h] = seen.get(h, 0) + 1
            if len(seen) > 500_000:
                yield pd.DataFrame({"hash": list(seen), "n": list(seen.values())})
                seen = {}
        yield pd.DataFrame({"hash": list(seen), "n": list(seen.values())}, dtype="int64")

    return of


def _passages(bits, alone, around: int):
    """Runs of neighbouring seeds with the words around them."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, body_key, text in zip(part["doc_id"], part["body_key"], part["text"], strict=True):
                codes = words(text)
                found = grams(codes)
                at = np.flatnonzero(_hits(bits.value, found))
                if not len(at):
                    continue
                for run in np.split(at, np.flatnonzero(np.diff(at) > REACH) + 1):
                    seeds = np.unique(found[run])
                    if len(seeds) > 1 or _hits(alone.value, seeds).any():
                        first = max(0, int(run[0]) - around)
                        piece = codes[first : int(run[-1]) + N + around]
                        rows.append((doc_id, body_key, first, piece.astype(np.int64), seeds))
            yield pd.DataFrame(rows, columns=["doc_id", "body_key", "first_word", "codes", "seeds"])

    return of


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of an item with each row of passages, and the word it ends at.

    Linear gap costs; a row of the table is computed for all passages and words at once, gaps along
    it by a running maximum.
    """
    rows, width = passages.shape
    slope = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((rows, width + 1), np.int32)
    best, stop = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for w in item:
        step = np.where(passages == w, MATCH, MISMATCH).astype(np.int32)
        now = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        above[:, 1:] = now
        top = now.argmax(axis=1)
        value = now[np.arange(rows), top]
        stop = np.where(value > best, top, stop)
        best = np.maximum(best, value)
    return best, stop


def _score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for _, same in part.groupby("item"):
            item = np.asarray(same["item_codes"].iloc[0], np.int64)
            order = same["codes"].map(len).sort_values().index
            at = 0
            while at < len(order):
                width = len(same["codes"][order[at]])
                take = order[at : at + max(1, 400_000 // max(1, width))]
                width = len(same["codes"][take[-1]])
                table = np.full((len(take), width), -1, np.int64)
                for i, row in enumerate(take):
                    table[i, : len(same["codes"][row])] = same["codes"][row]
                score, stop = align(item, table)
                piece = same.loc[take, ["doc_id", "body_key", "item_id", "first_word"]].copy()
                piece["score"], piece["last_word"] = score.astype(np.int64), piece["first_word"] + stop
                piece["similarity"] = score / (MATCH * len(item))
                out.append(piece.drop(columns="first_word"))
                at += len(take)
        if out:
            yield pd.concat(out)


def body_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Pairs of documents and test items whose texts align.

    Returns doc_id, item_id, score (local alignment: 2 for a word in common, -1 for one replaced,
    inserted or dropped), similarity (score against the item's own, 0 to 1) and last_word (number
    of the document's word at which the best alignment ends) for pairs of at least ``least``, the
    best passage for each pair. Texts without words match nothing; items of fewer than three words
    match by all their words. Rows with one doc_id count as one document, null ids included.
    """
    best = F.max(F.struct("similarity", "score", "last_word")).alias("best")
    scored = _aligned(docs, items, least)
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _aligned(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Scored passages of at least ``least``: doc_id and body_key of the row, and the item's figures."""
    spark = docs.sparkSession
    work = Staged(spark, "decontaminate")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body_key().alias("body_key"), "text")

    @F.pandas_udf("array<long>")
    def codes_of(column: pd.Series) -> pd.Series:
        return pd.Series([words(t).astype(np.int64) for t in column])

    @F.pandas_udf("array<long>")
    def grams_of(column: pd.Series) -> pd.Series:
        return pd.Series([grams(words(t)) for t in column])

    tests = work.keep(
        items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
        .select(
            "item_id", F.xxhash64("item_id", "text").alias("item"),
            codes_of(F.coalesce("text", F.lit(""))).alias("item_codes"),
            grams_of(F.coalesce("text", F.lit(""))).alias("grams"),
        )
        .filter(F.size("item_codes") > 0),
        "items",
    )
    places = tests.select("item", F.posexplode("grams").alias("at", "hash"))
    all_bits = spark.sparkContext.broadcast(_bit_map(places))
    counts = (
        texts.select("text").mapInPandas(_counter(all_bits), "hash long, n long")
        .groupBy("hash").agg(F.sum("n").alias("n"))
    )
    rarest = W.partitionBy("item").orderBy("n", "hash")
    ahead = W.partitionBy("item").orderBy("at").rowsBetween(0, NEIGHBOURS - 1)
    behind = W.partitionBy("item").orderBy("at").rowsBetween(-(NEIGHBOURS - 1), 0)
    order = F.struct("n", "hash")
    seeds = (
        places.join(counts, "hash")
        .withColumn("least", F.min(order).over(ahead))
        .withColumn("chosen", F.max(F.col("least")).over(behind) >= order)
        .withColumn("rare", F.row_number().over(rarest) * 10 <= F.count("*").over(W.partitionBy("item")) * 9 + 1)
        .filter(F.col("chosen") | F.col("rare"))
        .groupBy("item", "hash").agg(F.min("n").alias("n"))
        .withColumn("seeds", F.count("*").over(W.partitionBy("item")))
        .withColumn("few", F.col("seeds") < FEW_SEEDS)
    )
    seeds = work.keep(seeds.select("item", "hash", "few"), "seeds")
    longest = tests.agg(F.max(F.size("item_codes"))).first()[0] or 0
    bits = spark.sparkContext.broadcast(_bit_map(seeds))
    alone = spark.sparkContext.broadcast(_bit_map(seeds.filter("few")))
    shape = "doc_id long, body_key long, first_word long, codes array<long>, seeds array<long>"
    passages = work.keep(
        texts.mapInPandas(_passages(bits, alone, longest), shape)
        .withColumn("passage", F.monotonically_increasing_id()),
        "passages",
    )
    pairs = (
        passages.select("passage", F.explode("seeds").alias("hash")).join(seeds, "hash")
        .groupBy("passage", "item").agg(F.count("*").alias("n"), F.max("few").alias("few"))
        .filter("few or n > 1")
        .select("passage", "item")
    )
    return (
        passages.drop("seeds").join(pairs, "passage").join(tests.drop("grams"), "item")
        .select("doc_id", "body_key", "item_id", "item", "first_word", "codes", "item_codes")
        .mapInPandas(_score, "doc_id long, body_key long, item_id long, score long, last_word long, similarity double")
        .filter(F.col("similarity") >= least)
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a contaminated passage, with all their columns.

    Rows with one doc_id, or without an id, are told apart by their texts.
    """
    leaks = _aligned(docs, items, LEAST_SIMILARITY)
    leak, body = unused(docs, "_leak"), unused(docs, "_body")
    leaks = leaks.select(F.col("doc_id").alias(leak), F.col("body_key").alias(body)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(leak)) & (body_key() == F.col(body))
    return docs.join(leaks, same, "left_anti")
