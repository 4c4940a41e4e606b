"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits, the majority bits of the hashes of a text's word shingles. Fingerprints
within ``bits`` differing bits are found without comparing all pairs: the bits are grouped into
partitions, correlated bits together, and each partition gets a threshold of its own. If the
thresholds plus one sum to ``bits`` + 1, two fingerprints within ``bits`` are within the threshold
of at least one partition. Dynamic programming chooses the thresholds (unequal, some partitions may
be left out) by the number of candidates and probes they are expected to cause, from bit statistics
and key counts of all fingerprints. Probes within a threshold are looked up by equality and
verified in the join.

Cells with many fingerprints (groups of near copies differ in few bits) are looked up otherwise, so
that their work stays linear: two fingerprints within two bits share a neighbour within one bit, at
which at most 65 fingerprints meet; for other distances the cell is cut by longer keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay.llm.components import components
from soundquay.llm.tables import Staged, unused
from soundquay.operators.order import first_k

BITS = 64
SEED = 42
#: Fingerprints in a cell from which it is looked up by neighbours or longer keys.
HOT_CELL = 128
#: Candidates that cost as much as a probe.
PROBE_COST = 20
#: Thresholds with more probes for a fingerprint are not considered; the plan names each of them.
MOST_PROBES = 1000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space, a shingle joins them by single
    spaces. Fewer words make one shingle; no words make none.
    """
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    plain = b" ".join(parts)
    if len(parts) <= words:
        return np.frombuffer(xxhash.xxh64_digest(plain, SEED), ">u8").astype(np.uint64)
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])[: len(parts) - words + 1]
    of = xxhash.xxh64_digest
    pairs = zip(starts.tolist(), stops[words - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([of(plain[s:e], SEED) for s, e in pairs]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed long: bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: Column, words: int) -> Column:
    """The 64-bit fingerprint of a text as a long; null and empty texts have fingerprint zero."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return of(F.coalesce(text, F.lit("")))


def _patterns(bits: list[int], t: int) -> list[int]:
    return [sum(1 << b for b in flip) for k in range(t + 1) for flip in combinations(bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass(frozen=True)
class Layout:
    parts: tuple[tuple[int, ...], ...]
    #: one for each part; -1 leaves it out
    thresholds: tuple[int, ...]

    def used(self):
        return [(i, sorted(p), t) for i, (p, t) in enumerate(zip(self.parts, self.thresholds, strict=True)) if t >= 0]


def group_bits(together: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of like size; each takes the bits most correlated with those it has."""
    left, out = list(range(BITS)), []
    for i in range(m):
        size = len(left) // (m - i)
        strength = together[np.ix_(left, left)].sum(axis=1)
        group = [left[int(np.argmax(strength))]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(together[np.ix_(rest, group)].sum(axis=1)))])
        left = [b for b in left if b not in group]
        out.append(group)
    return out


def _within(mismatch: np.ndarray) -> np.ndarray:
    """Chance that at most t of independent bits differ, for each t."""
    chance = np.array([1.0])
    for q in mismatch:
        chance = np.convolve(chance, [1 - q, q])
    return np.cumsum(chance)


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds t >= -1 with sum(t + 1) = units and the least sum of costs[part][t + 1]."""
    best = {0: (0.0, [])}
    for cost in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in best.items():
            for take in range(min(len(cost) - 1, units - used) + 1):
                new = (total + cost[take], [*ts, take - 1])
                if used + take not in now or new[0] < now[used + take][0]:
                    now[used + take] = new
        best = now
    return best[units]


def _bit_pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both, n = np.zeros((BITS, BITS)), 0
    for part in parts:
        raw = part["fp"].to_numpy(np.int64).astype(np.uint64)
        bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        both, n = both + bits.T @ bits, n + len(raw)
    if n:
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": i, "j": j, "both": both.ravel().astype(np.int64), "n": n})


def plan(prints: DataFrame, bits: int) -> Layout:
    """Choose the partitions and thresholds for a table of distinct fingerprints ``fp``.

    A probe, which is shuffled and sorted, costs PROBE_COST candidates; the candidates of a partition at threshold t follow
    from the bits' own frequencies (as if independent), raised by the ratio of the pairs that share
    a key in the data to those expected.
    """
    rows = (
        prints.select("fp").mapInPandas(_bit_pairs, "i int, j int, both long, n long")
        .groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    )
    if not rows:
        return Layout((tuple(range(BITS)),), (bits,))
    n = rows[0]["n"]
    both = np.zeros((BITS, BITS))
    for x in rows:
        both[x["i"], x["j"]] = x["both"] / n
    share = both.diagonal()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    together = np.abs(both - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(together, 0)
    grouped = {m: group_bits(together, m) for m in range(2, bits + 2)} or {1: [list(range(BITS))]}
    cells = [(m, i, part) for m, parts in grouped.items() for i, part in enumerate(parts)]
    met = [
        prints.groupBy(_key(F.col("fp"), part)).count()
        .agg(F.sum(F.col("count").cast("double") ** 2).alias("pairs")).select(F.lit(k).alias("k"), "pairs")
        for k, (_, _, part) in enumerate(cells)
    ]
    union = met[0]
    for x in met[1:]:
        union = union.unionByName(x)
    pairs = {x["k"]: x["pairs"] for x in union.collect()}
    costs: dict[int, list[list[float]]] = {}
    for k, (m, _, part) in enumerate(cells):
        chance = _within(2 * share[part] * (1 - share[part]))
        raised = max(1.0, (pairs[k] - n) / max(n * n * chance[0], 1e-9))
        cost, probes = [0.0], 0
        for t in range(min(bits, len(part)) + 1):
            probes += comb(len(part), t)
            cost.append(PROBE_COST * n * probes + min(n * n, n * n * chance[t] * raised) if probes <= MOST_PROBES else float("inf"))
        costs.setdefault(m, []).append(cost)
    best = min((allocate(costs[m], bits + 1), m) for m in grouped)
    (_, thresholds), m = best
    return Layout(tuple(map(tuple, grouped[m])), tuple(thresholds))


def _key(fp: Column, part) -> Column:
    return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in part))).cast("long"))


def _near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def _by_neighbours(hot: DataFrame) -> DataFrame:
    """Links within two bits: all fingerprints one bit around a value are linked to their least."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in range(BITS)])
    around = hot.select("seed", "fp", F.explode(flips).alias("flip")).select(
        "seed", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")
    )
    met = around.groupBy("seed", "at").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    found = met.filter(F.size("all") > 1).select("seed", "a", F.explode("all").alias("b"))
    return found.filter("a <> b")


def _by_longer_keys(hot: DataFrame, bits: int) -> DataFrame:
    """Links by keys of three out of bits + 3 parts; any link leaves at least three parts equal."""
    parts = [p.tolist() for p in np.array_split(np.arange(BITS), bits + 3)]
    keys = F.array(*[
        F.struct(F.lit(i).alias("i"), _key(F.col("fp"), [b for p in chosen for b in p]).alias("key"))
        for i, chosen in enumerate(combinations(parts, 3))
    ])
    rows = hot.select("seed", "fp", F.explode(keys).alias("k")).select("seed", "k.*", "fp")
    return _meet(rows, rows, bits)


def _meet(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    a, b = left.withColumnRenamed("fp", "a"), right.withColumnRenamed("fp", "b")
    # both sides are exploded, which Spark's sizes do not show: never broadcast one of them
    return a.hint("merge").join(b, CELL).filter(_near("a", "b", bits) & F.expr("a <> b")).select("seed", "a", "b")


CELL = ["seed", "i", "key"]


def links(prints: DataFrame, bits: int, work: Staged, hot_cell: int = HOT_CELL) -> DataFrame:
    """Pairs a, b that connect all distinct fingerprints ``fp`` of a ``seed`` within ``bits`` bits.

    Every pair within ``bits`` bits is joined by these links, directly or over fingerprints within
    that distance of each other; pairs may repeat.
    """
    layout = plan(prints.filter("seed = 0"), bits)
    own = F.array(*[
        F.struct(F.lit(i).alias("i"), _key(F.col("fp"), part).alias("key")) for i, part, _ in layout.used()
    ])
    index = prints.select("seed", "fp", F.explode(own).alias("k")).select("seed", "k.*", "fp")
    probes = None
    for i, part, t in layout.used():
        flips = F.array(*[F.lit(_signed(x)).cast("long") for x in _patterns(part, t)])
        found = prints.select("seed", "fp", F.explode(flips).alias("flip")).select(
            "seed", F.lit(i).alias("i"), _key(F.col("fp"), part).bitwiseXOR(F.col("flip")).alias("key"), "fp"
        )
        probes = found if probes is None else probes.unionByName(found)
    crowded = index.groupBy(*CELL).count().filter(F.col("count") > hot_cell).drop("count")
    crowded = work.keep(crowded, "crowded")
    if crowded.isEmpty():
        return _meet(probes, index, bits)
    hot = work.keep(probes.join(crowded, CELL, "left_semi").select("seed", "fp").distinct(), "hot")
    rest = _meet(probes.join(crowded, CELL, "left_anti"), index.join(crowded, CELL, "left_anti"), bits)
    return rest.unionByName(_by_neighbours(hot) if bits == 2 else _by_longer_keys(hot, bits))


def groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of docs.

    Rows are linked when their fingerprints differ in at most ``bits`` bits; component_id is the
    smallest doc_id that can be reached over links, the row's own included. Texts without words
    share fingerprint zero and are linked like others. Null ids reach the others of their group
    and are never the smallest; a group of null ids only has a null component_id.
    """
    work = Staged(docs.sparkSession, "simhash")
    rows, placed = _placed(docs, words, bits, work)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = work.keep(placed.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")


def _placed(docs: DataFrame, words: int, bits: int, work: Staged) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and for each fingerprint its least id and its root."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = work.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("body_key"),
            fingerprint(F.col("text"), words).alias("fp"),
        ),
        "fingerprints",
    )
    prints = work.keep(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("seed", F.lit(0)), "distinct"
    )
    roots = components(links(prints, bits, work), work)
    placed = prints.drop("seed").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    return rows, work.keep(placed, "placed")


def print_groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, body_key (hash of the text) and root of every row of docs; root names its group of groups()."""
    rows, placed = _placed(docs, words, bits, Staged(docs.sparkSession, "prints"))
    return rows.join(placed.select("fp", "root"), "fp").select("doc_id", "body_key", "root")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def set_key(shingles: np.ndarray) -> int:
    """Hash, as a signed long, of a sorted set of shingles: texts with one set are one text."""
    return _signed(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED))


#: Shingles that two near copies must have in common among the first of each.
SHARED = 3
#: Texts in a cell up to which all its pairs are counted; larger ones go on in rounds.
SMALL_CELL = 32
#: Growth of the sizes from one class to the next, in cells of many texts.
CLASS_RATIO = 1.05
#: Texts from which common shingles are told, and how many of these hold one.
SAMPLE, COMMON = 32_768, 3


def least_shared(n: Column, similarity: float) -> Column:
    """The fewest shingles a set of n has in common with any set of that Jaccard similarity."""
    return F.ceil(n * similarity - 1e-9)


def _firsts(words: int, similarity: float, common):
    """The key of a text, the size of its shingle set, and the first shingles of the set.

    The order puts the common shingles of ``common`` (sorted hashes) last and is the same for all
    texts. Two sets of the similarity have ``least`` shingles in common, so all but
    ``least - SHARED`` of either, taken in one order, hold their SHARED first common ones.
    """

    @F.pandas_udf("text_key long, size int, firsts array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        last, out = common.value, []
        for t in texts:
            shingles = np.unique(shingle_hashes(t, words))
            n = len(shingles)
            take = n - max(0, int(np.ceil(n * similarity - 1e-9)) - SHARED)
            is_last = np.zeros(n, bool)
            if len(last) and n:
                at = np.minimum(np.searchsorted(last, shingles), len(last) - 1)
                is_last = last[at] == shingles
            firsts = shingles[np.argsort(is_last, kind="stable")][:take]
            out.append((set_key(shingles), n, firsts.view(np.int64)))
        return pd.DataFrame(out, columns=["text_key", "size", "firsts"])

    return of


def _common(docs: DataFrame, body: Column, words: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts hold, from a sample; they only set the order."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.uint64)

    part = F.pmod(F.xxhash64(body, F.lit(1)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / n) * (1 << 20))
    sample = docs.filter(part).select(body.alias("body")).distinct()
    counts = sample.select(F.explode(_sets(words)(F.col("body"))).alias("hash")).groupBy("hash").count()
    found = counts.filter(F.col("count") >= COMMON)
    return np.sort(found.select("hash").toPandas()["hash"].to_numpy(np.int64).view(np.uint64))


def _sets(words: int):
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts])

    return of


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose whole sets of shingles have the Jaccard similarity."""
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return (
        pairs.join(sets.select(F.col("text_key").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("text_key").alias("b"), F.col("shingles").alias("sb")), "b")
        .filter(both / union >= similarity)
        .select("a", "b")
    )


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= least_shared(F.greatest(a, b), similarity)


def _small_cells(cells: DataFrame, similarity: float) -> DataFrame:
    """Pairs with SHARED shingles in common among the cells that hold few texts."""
    a = cells.select("hash", F.col("text_key").alias("a"), F.col("size").alias("na"))
    b = cells.select("hash", F.col("text_key").alias("b"), F.col("size").alias("nb"))
    met = a.hint("merge").join(b, "hash").filter((F.col("a") < F.col("b")) & _sizes_fit("na", "nb", similarity))
    need = F.least(F.lit(SHARED), least_shared(F.least("na", "nb"), similarity))
    return met.groupBy("a", "b", "na", "nb").count().filter(F.col("count") >= need).select("a", "b")


def _overlap(na: Column, nb: Column, similarity: float) -> Column:
    """The fewest common shingles of two sets of these sizes and the similarity."""
    return F.ceil((na + nb) * (similarity / (1 + similarity)) - 1e-9)


def _can_reach(n: Column, pos: Column, other: Column, similarity: float) -> Column:
    """Whether a set of n can be similar to one of ``other``, if they first meet at ``pos`` of its order.

    Of the earlier shingles, at most SHARED - 1 are common: those met in small cells.
    """
    return n - pos + (SHARED - 1) >= _overlap(n, other, similarity)


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(CLASS_RATIO))).cast("int")


def _by_size(cells: DataFrame, similarity: float) -> DataFrame:
    """Cells of many texts cut by the size classes of the shorter and the longer text of a pair.

    A text comes as the shorter one (side 0) and as the longer one (side 1) for each class of a
    partner that it can still reach from the place of the shingle in its order. Texts that hold
    much of their own ahead of a common shingle reach none, and drop out.
    """
    n, pos, k = F.col("size"), F.col("pos"), F.col("class")
    floor = F.greatest(F.floor(F.pow(F.lit(CLASS_RATIO), k) - 1e-3).cast("long"), F.lit(1))
    own = _size_class(n)
    least = F.greatest(least_shared(n, similarity), F.lit(1))
    most = F.floor(n / similarity + 1e-9)
    shorter = cells.withColumn("class", F.explode(F.sequence(own, _size_class(most)))).filter(
        _can_reach(n, pos, F.greatest(n, floor), similarity)
    ).select(F.xxhash64("hash", own, k).alias("cell"), "text_key", "size", "pos", F.lit(0).alias("side"))
    longer = cells.withColumn("class", F.explode(F.sequence(_size_class(least), own))).filter(
        _can_reach(n, pos, F.greatest(least, floor), similarity)
    ).select(F.xxhash64("hash", k, own).alias("cell"), "text_key", "size", "pos", F.lit(1).alias("side"))
    return shorter.unionByName(longer)


def _in_rounds(
    cells: DataFrame, links: DataFrame, texts: DataFrame, sets: DataFrame, similarity: float, work: Staged
) -> DataFrame:
    """Go on with the cells of many texts: node and root over ``links`` and the pairs found here.

    In each round the first shorter texts of a cell meet its longer ones that are not in their
    component yet, and leave the cell; a cell ends when what is left is one component. So any two
    texts of a cell that can be similar by their sizes and the place of the shingle were compared
    or are in one component. A group of near copies ends after a few rounds; each round takes three
    times as many texts.
    """
    firsts = texts.select("text_key", "firsts")
    many, old = 1, []
    while True:
        roots = work.keep(components(links, work), "roots")
        now = cells.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn(
            "root", F.coalesce("root", "text_key")
        )
        ends = [f(F.when(F.col("side") == x, F.col("root"))) for x in (0, 1) for f in (F.min, F.max)]
        open_ = now.groupBy("cell").agg(*[e.alias(c) for e, c in zip(ends, ("lo0", "hi0", "lo1", "hi1"), strict=True)])
        open_ = open_.filter("lo0 is not null and lo1 is not null and (lo0 <> hi0 or lo1 <> hi1 or lo0 <> lo1)")
        now, now_path = work.put(now.join(open_.select("cell"), "cell", "left_semi"), "open")
        for path in old:
            work.drop(path)
        work.settle()
        if now.isEmpty():
            return roots
        heads, heads_path = work.put(first_k(now.filter("side = 0"), ["cell"], ["text_key"], many), "heads")
        a = heads.select("cell", *[F.col(c).alias(x) for c, x in (("text_key", "a"), ("size", "na"), ("pos", "pa"), ("root", "ra"))])
        b = now.filter("side = 1").select(
            "cell", *[F.col(c).alias(x) for c, x in (("text_key", "b"), ("size", "nb"), ("pos", "pb"), ("root", "rb"))]
        )
        na, nb = F.col("na"), F.col("nb")
        pairs = (
            a.hint("merge").join(b, "cell")
            .filter((na < nb) | ((na == nb) & (F.col("a") < F.col("b"))))
            .filter((F.col("ra") != F.col("rb")) & _sizes_fit("na", "nb", similarity))
            .filter(_can_reach(na, F.col("pa"), nb, similarity) & _can_reach(nb, F.col("pb"), na, similarity))
            .select("a", "b", F.least(F.lit(SHARED), least_shared(na, similarity)).alias("need"))
            .distinct()
        )
        pairs = (
            pairs.join(firsts.select(F.col("text_key").alias("a"), F.col("firsts").alias("fa")), "a")
            .join(firsts.select(F.col("text_key").alias("b"), F.col("firsts").alias("fb")), "b")
            .filter(F.size(F.array_intersect("fa", "fb")) >= F.col("need")).select("a", "b")
        )
        met, met_path = work.put(pairs, "met")
        found = work.keep(_alike(met, sets, similarity), "found")
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        done = heads.groupBy("cell").agg(F.max("text_key").alias("last"))
        cells = now.drop("root").join(done, "cell").filter("side = 1 or text_key > last").drop("last")
        cells, path = work.put(cells, "cells")
        for done_path in (now_path, heads_path, met_path):
            work.drop(done_path)
        old, many = [path], many * 3


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, body_key (hash of the text), root and component_id of every row of docs, by verified
    near copies; root names the group.

    Two texts are linked when their sets of word shingles have a Jaccard similarity of at least
    ``similarity``, measured on the whole sets; groups are the components of all
    these links. Texts meet when they share some of their first shingles in an order of all
    shingles, which two such texts always do, so no pair is missed. Texts with the same set of
    shingles count as one text. Texts without words are one group. Null ids as in groups().
    """
    spark = docs.sparkSession
    work = Staged(spark, "near")
    body = F.coalesce(F.col("text"), F.lit(""))
    common = spark.sparkContext.broadcast(_common(docs, body, words))
    rows = work.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("body_key"),
            _firsts(words, similarity, common)(body).alias("made"),
        ).select("doc_id", "body_key", "made.*"),
        "rows",
    )
    texts = work.keep(
        rows.groupBy("text_key").agg(
            F.first("size").alias("size"), F.first("firsts").alias("firsts"), F.min("doc_id").alias("least"),
            F.min(F.struct("doc_id", "body_key")).alias("owner"),
        ),
        "texts",
    )
    work.settle()
    places = texts.select("text_key", "size", F.posexplode("firsts").alias("pos", "hash"))
    counts = places.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    cells, cells_path = work.put(places.hint("merge").join(counts, "hash"), "cells")
    work.settle()
    small, large = cells.filter(F.col("n") <= SMALL_CELL).drop("n"), cells.filter(F.col("n") > SMALL_CELL).drop("n")
    pairs = work.keep(_small_cells(small, similarity), "pairs")
    involved = pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).union(large.select("text_key")).distinct()
    #: one document for each involved text
    owners = texts.join(involved, "text_key", "left_semi").select("text_key", "owner")
    mine = F.col("owner.doc_id").eqNullSafe(F.col("id")) & (F.col("owner.body_key") == F.xxhash64("body"))
    sets = work.keep(
        docs.select(F.col("doc_id").cast("long").alias("id"), body.alias("body"))
        .join(owners, mine)
        .select("text_key", _sets(words)(F.col("body")).alias("shingles"))
        .groupBy("text_key").agg(F.first("shingles").alias("shingles")),
        "sets",
    )
    sized = work.keep(_by_size(large, similarity), "sized")
    work.drop(cells_path)
    work.settle()
    near = work.keep(_alike(pairs, sets, similarity), "near")
    roots = _in_rounds(sized, near, texts, sets, similarity, work)
    placed = work.keep(
        texts.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
        .select("text_key", "least", F.coalesce("root", "text_key").alias("root")),
        "placed",
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_text = work.keep(placed.join(least, "root").select("text_key", "root", "component_id"), "components")
    return rows.join(of_text, "text_key").select("doc_id", "body_key", "root", "component_id")


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = near_groups) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id, with all columns.

    ``grouped`` tells the groups: near_groups by whole shingle sets, print_groups by fingerprints.

    Where that id has several texts in the group, one of them stays, and of rows that repeat it one.
    Rows without an id come last: one of them stays when no row of their group has an id.
    """
    work = Staged(docs.sparkSession, "kept")
    rows = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "body_key")
    placed = work.keep(grouped(docs).select("root", rows.alias("row")), "placed")
    top = placed.groupBy("root").agg(F.min("row").alias("top"))
    texts = placed.groupBy("root", "row").agg(F.count("*").alias("n")).join(top, "root")
    texts = work.keep(texts.filter("row <> top or n > 1").select("row", (F.col("row") == F.col("top")).alias("stays")), "copies")

    def mine(part: DataFrame) -> tuple[DataFrame, object]:
        own, key = unused(docs, "_id"), unused(docs, "_body")
        named = part.select(F.col("row.doc_id").alias(own), F.col("row.body_key").alias(key))
        body = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
        return named, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (body == F.col(key))

    gone, is_gone = mine(texts.filter("not stays"))
    left = docs.join(gone, is_gone, "left_anti")
    again, is_again = mine(texts.filter("stays"))
    if again.isEmpty():
        return left
    return left.join(again, is_again, "left_anti").unionByName(
        left.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text"])
    )
