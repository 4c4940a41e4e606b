"""Fuzzy lexicon match without comparing every word group with every term.

A word group of length q may differ from its term by at most ``d`` inserted or deleted letters
(``d`` follows from q and the wanted similarity). Cut the group into d + 1 pieces: one of them
must stand in the term unchanged, moved by no more than the edits around it. The group side of
the join therefore holds d + 1 rows, the term side every place where such a piece may stand, and
the join is an equality on (language, words, length, piece number, piece). Only pairs sharing a
piece are compared. No hint is given: the term side is staged as a table where texts are joined
with it, so Spark knows its size and broadcasts it or shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.bind import let
from soundquay.functions.distance import indel_distance, similarity
from soundquay.functions.text import normalize

_BLOCK = ["lang", "n", "q_len", "piece_no", "piece"]


def _percent(n: Column) -> Column:
    return F.when(n == 1, fixed.FUZZY_PERCENT[1]).otherwise(fixed.FUZZY_PERCENT[2])


def _edit_limit(length: Column, n: Column) -> Column:
    """The most inserted or deleted letters that can still reach the wanted similarity."""
    return F.call_function("div", 2 * length * (100 - _percent(n)), _percent(n)).cast("int")


def _cut(length: Column, pieces: Column, j: Column) -> Column:
    return F.call_function("div", length * j, pieces).cast("int")


def _piece_rows(gram: Column, size: Column, limit: Column) -> Column:
    """``limit + 1`` pieces of the group; ``size`` and ``limit`` must be cheap to repeat."""

    def piece(j: Column) -> Column:
        start = _cut(size, limit + 1, j)
        return F.struct(
            size.alias("q_len"),
            j.alias("piece_no"),
            F.substring(gram, start + 1, _cut(size, limit + 1, j + 1) - start).alias("piece"),
        )

    return F.transform(F.sequence(F.lit(0), limit), piece)


def group_keys(gram: Column, n: Column, exact_only: Column) -> Column:
    """Join keys of a word group: its pieces, or one key without a piece for a known term."""
    alone = F.array(
        F.struct(F.length(gram).alias("q_len"), F.lit(-1).alias("piece_no"), F.lit("").alias("piece"))
    )
    pieces = let(
        F.length(gram),
        lambda size: let(_edit_limit(size, n), lambda limit: _piece_rows(gram, size, limit)),
    )
    return F.when(exact_only, alone).otherwise(pieces)


def query_pieces(grams: DataFrame, gram: str = "gram") -> DataFrame:
    """One row per piece of each word group that can have a fuzzy match at all."""
    limit = _edit_limit(F.length(gram), F.col("n"))
    pieces = let(limit, lambda lim: _piece_rows(F.col(gram), F.length(gram), lim))
    return grams.filter(limit > 0).select("*", F.inline(pieces))


def term_pieces(terms: DataFrame) -> DataFrame:
    """Every place of a term where a piece of a matching word group may stand."""
    gap = fixed.MAX_LENGTH_GAP
    sized = (
        terms.withColumn("_t_len", F.length("norm"))
        .withColumn(
            "q_len",
            F.explode(F.sequence(F.greatest(F.col("_t_len") - gap, F.lit(1)), F.col("_t_len") + gap)),
        )
        .withColumn("_limit", _edit_limit(F.col("q_len"), F.col("n")))
        .filter("_limit > 0")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("_limit"))))
        .withColumn("_from", _cut(F.col("q_len"), F.col("_limit") + 1, F.col("piece_no")))
        .withColumn("_to", _cut(F.col("q_len"), F.col("_limit") + 1, F.col("piece_no") + 1))
        .withColumn("_shift", F.explode(F.sequence(-F.col("_limit"), F.col("_limit"))))
    )
    growth = F.col("_t_len") - F.col("q_len")
    fits = (
        (F.abs("_shift") + F.abs(growth - F.col("_shift")) <= F.col("_limit"))
        & ((F.col("piece_no") > 0) | (F.col("_shift") == 0))
        & ((F.col("piece_no") < F.col("_limit")) | (F.col("_shift") == growth))
        & (F.col("_from") + F.col("_shift") >= 0)
        & (F.col("_to") + F.col("_shift") <= F.col("_t_len"))
    )
    return (
        sized.filter(fits)
        .withColumn(
            "piece",
            F.substring(
                F.col("norm"),
                F.col("_from") + F.col("_shift") + 1,
                F.col("_to") - F.col("_from"),
            ),
        )
        .select(*terms.columns, "q_len", "piece_no", "piece")
        .dropDuplicates([*_BLOCK, "norm"])
    )


def similar_enough(gram: Column, norm: Column, n: Column) -> Column:
    """Different strings of at least the wanted similarity.

    An edit script with replacements is never longer than one without, so the bounded edit
    distance is a cheap first test; the exact distance is worked out for what is left.
    """
    total = F.length(gram) + F.length(norm)
    limit = F.floor(total * (100 - _percent(n)) / 100).cast("int")
    near = F.call_function("levenshtein", gram, norm, limit) >= 0
    # one single edit changes the length; two strings of one length are at least two edits apart
    possible = (limit >= 2) | (F.abs(F.length(gram) - F.length(norm)) == 1)
    close = 100 * indel_distance(gram, norm) <= (100 - _percent(n)) * total
    return (gram != norm) & possible & near & close


def distance_share(gram: Column, norm: Column) -> Column:
    return indel_distance(gram, norm) / (F.length(gram) + F.length(norm))


def similar_pairs(grams: DataFrame, terms: DataFrame, gram: str = "gram") -> DataFrame:
    """All (group, term) pairs of at least the wanted similarity; equal strings excluded.

    A pair can come up once per shared piece. Adds ``norm, ord, canonical``.
    """
    sides = query_pieces(grams, gram).join(
        term_pieces(terms.select("lang", "n", "norm", "ord", "canonical")), _BLOCK
    )
    return sides.filter(similar_enough(F.col(gram), F.col("norm"), F.col("n"))).drop(
        "q_len", "piece_no", "piece"
    )


def best_terms(grams: DataFrame, terms: DataFrame, gram: str = "gram") -> DataFrame:
    """The most similar term per distinct word group (ties: the earliest term)."""
    keys = ["lang", "n", gram]
    pairs = similar_pairs(grams.select(*keys).distinct(), terms, gram)
    ranked = pairs.withColumn("_far", distance_share(F.col(gram), F.col("norm")))
    return (
        ranked.groupBy(*keys)
        .agg(F.min(F.struct("_far", "ord", "norm", "canonical")).alias("_best"))
        .select(*keys, "_best.norm", "_best.canonical")
        .withColumn(
            "confidence",
            F.round(
                similarity(F.col(gram), normalize(F.col("canonical"), F.col("lang"))) / 100.0, 3
            ),
        )
    )
