"""Confusion pairs: word alignment, substitution counts, candidate rules and case skeletons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.batches import MOST, replaced, words
from soundquay.functions.text import normalize, tokens
from soundquay.operators.order import first_k, number_rows


#: First half width of the band; it doubles until the alignment fits.
_BAND = 16


def _band_columns(left: list[str], right: list[str], half: int) -> tuple[list[tuple[int, int, int]], int]:
    """Bit vectors of the rises and falls down each column, inside a band around the diagonal.

    One (first row, rises, falls) per word of ``right`` (bit-vector edit distance, Hyyro 2003); a
    bit is a row. Below the band a column counts as rising, above it a row counts as rising, so
    values are never too small, and exact wherever a path of at most ``half`` edits runs.
    """
    places: dict[str, int] = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | (1 << i)
    width = min(2 * half + 1, len(left))
    full = (1 << width) - 1
    plus, minus, low = full, 0, 0
    columns = []
    for j, word in enumerate(right):
        if j - half > low and low + width < len(left):
            low += 1
            plus, minus = (plus >> 1) | (1 << (width - 1)), minus >> 1
        match = (places.get(word, 0) >> low) & full
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        up = ((up << 1) | 1) & full
        down = (down << 1) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal & full
        columns.append((low, plus, minus))
    return columns, width


def _walk_back(left: list[str], right: list[str], half: int) -> list[tuple[int, int]] | None:
    """Places (left, right) of replaced words, last first; None if the path does not fit the band."""
    columns, width = _band_columns(left, right, half)
    found, cost = [], 0
    i, j = len(left), len(right)
    while i and j and cost <= half:
        low, plus, _ = columns[j - 1]
        at = i - 1 - low
        if not 0 <= at < width:
            return None
        before, _, falls = columns[j - 2] if j > 1 else (0, 0, 0)
        if plus >> at & 1:
            i, cost = i - 1, cost + 1
        elif i - 1 >= before and falls >> (i - 1 - before) & 1:
            j, cost = j - 1, cost + 1
        else:
            i, j = i - 1, j - 1
            if left[i] != right[j]:
                found.append((i, j))
                cost += 1
    return found if cost + i + j <= half else None


def _substitutions(ref: list[str], hyp: list[str]) -> list[tuple[int, str, str]]:
    """Replaced words ``(place in hyp, wrong, right)`` of one optimal alignment.

    The part between common head and tail is aligned in a band that doubles until the path fits,
    so time and memory follow the length times the number of edits. Reading back from the end, a
    deletion is taken where it is optimal, then an insertion where the diagonal is worse, then the
    diagonal.
    """
    head, least = 0, min(len(ref), len(hyp))
    while head < least and ref[head] == hyp[head]:
        head += 1
    tail = 0
    while tail < least - head and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    left, right = ref[head : len(ref) - tail], hyp[head : len(hyp) - tail]
    if not left or not right:
        return []
    half = max(_BAND, abs(len(left) - len(right)))
    while (found := _walk_back(left, right, half)) is None:
        half *= 2
    return [(head + j, right[j], left[i]) for i, j in reversed(found)]


def _aligned(ref: pa.Array, hyp: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Row, place, wrong and right word of the replaced words of some pairs of normal forms."""
    (left, m, right, n), known = words(ref, hyp)
    wide = (m > MOST) | (n > MOST)
    some = [np.where(wide, 0, x) for x in (m, n)]
    short = [codes[np.repeat(~wide, x)] for codes, x in ((left, m), (right, n))]
    row, i, j, long = replaced(short[0], some[0], short[1], some[1])
    starts = [np.cumsum(x) - x for x in (m, n)]
    out = [(row, j, right[starts[1][row] + j], left[starts[0][row] + i])]
    for at in np.concatenate([long, np.flatnonzero(wide)]).tolist():
        pair = [c[s[at] : s[at] + k[at]].tolist() for c, s, k in ((left, starts[0], m), (right, starts[1], n))]
        found = np.array(_substitutions(*pair), np.int64).reshape(-1, 3)
        out.append((np.full(len(found), at), *found.T))
    row, place, wrong, right_ = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    return row, place, known.take(pa.array(wrong - 1)), known.take(pa.array(right_ - 1))


def substitutions(pairs: DataFrame, key: str = "utterance_id") -> DataFrame:
    """One row per replaced word of the pairs ``key, lang, hyp, ref``, whatever their lengths.

    Pairs without edits are dropped; all others are aligned in Arrow batches, the short ones together.
    """
    normal = pairs.select(
        key,
        "lang",
        normalize(F.col("ref"), F.col("lang")).alias("_ref"),
        normalize(F.col("hyp"), F.col("lang")).alias("_hyp"),
    )
    key_type = dict(pairs.dtypes)[key]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ref, hyp = batch.column(2), batch.column(3)
            edited = pc.and_(pc.and_(pc.not_equal(ref, ""), pc.not_equal(hyp, "")), pc.not_equal(ref, hyp))
            batch = batch.filter(edited)
            if batch.num_rows:
                row, place, wrong, right = _aligned(batch.column(2), batch.column(3))
                rows = pa.array(row)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place), wrong, right]
                yield pa.RecordBatch.from_arrays(columns, [key, "lang", "place", "wrong", "right"])

    return normal.mapInArrow(align, f"`{key}` {key_type}, lang string, place long, wrong string, right string")


def evidence(subs: DataFrame) -> DataFrame:
    """How often each (lang, wrong, right) was seen."""
    return subs.groupBy("lang", "wrong", "right").agg(F.count(F.lit(1)).alias("evidence"))


def pair_counts(subs: DataFrame) -> DataFrame:
    """Evidence and precision of each (lang, wrong, right)."""
    counts = evidence(subs)
    totals = counts.groupBy("lang", "wrong").agg(F.sum("evidence").alias("_total"))
    return counts.join(totals, ["lang", "wrong"]).select(
        "lang", "wrong", "right", "evidence", (F.col("evidence") / F.col("_total")).alias("precision")
    )


def candidates(
    subs: DataFrame,
    menu_words: DataFrame | None = None,
    min_evidence: int = fixed.MIN_EVIDENCE,
    min_precision: float = fixed.MIN_PRECISION,
) -> DataFrame:
    """Frequent, consistent confusions whose wrong form is no menu term (``lang, term``)."""
    kept = pair_counts(subs).filter(
        (F.col("evidence") >= min_evidence) & (F.col("precision") >= min_precision)
    )
    if menu_words is not None:
        kept = kept.join(
            menu_words.select("lang", F.col("term").alias("wrong")).distinct(),
            ["lang", "wrong"],
            "left_anti",
        )
    return kept.withColumn("precision", F.round("precision", 3))


def contexts(
    subs: DataFrame,
    mined: DataFrame,
    pairs: DataFrame,
    key: str = "utterance_id",
    keep: int = fixed.CONTEXTS_KEPT,
) -> DataFrame:
    """The first hypotheses in which each mined pair was seen."""
    wanted = subs.join(mined.select("lang", "wrong", "right"), ["lang", "wrong", "right"])
    first = first_k(wanted, ["lang", "wrong", "right"], [key, "place"], keep)
    return first.join(pairs.select(key, "hyp"), key)


def context_terms(
    ctx: DataFrame, key: str = "utterance_id", keep: int = fixed.CONTEXT_TERMS
) -> DataFrame:
    """The most frequent neighbour words of the kept contexts, ties by first sight."""
    said = ctx.select(
        "lang",
        "wrong",
        "right",
        key,
        "place",
        F.posexplode(tokens(F.col("hyp"), F.col("lang"))).alias("at", "word"),
    ).filter(F.col("word") != F.col("wrong"))
    counts = said.groupBy("lang", "wrong", "right", "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "place", "at")).alias("_first")
    )
    best = first_k(counts, ["lang", "wrong", "right"], [F.desc("n"), F.col("_first")], keep)
    return best.groupBy("lang", "wrong", "right").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "_first", "word"))),
            lambda s: s["word"],
        ).alias("context_any")
    )


def rule_rows(mined: DataFrame, terms: DataFrame, cycle_id: str) -> DataFrame:
    """Candidate rules in order of evidence, with provenance and gate words."""
    ranked = mined.withColumn("_rank", -F.col("evidence"))
    numbered = number_rows(ranked, ["_rank", "lang", "wrong", "right"], (), "_no")
    return numbered.join(terms, ["lang", "wrong", "right"], "left").select(
        F.concat(F.lit(f"mined-{cycle_id}-"), F.format_string("%03d", F.col("_no"))).alias("id"),
        "lang",
        "wrong",
        "right",
        F.lit("word").alias("scope"),
        F.coalesce("context_any", F.array().cast("array<string>")).alias("context_any"),
        F.array().cast("array<string>").alias("context_none"),
        F.lit("candidate").alias("status"),
        F.struct(
            F.lit("mined").alias("source"),
            F.col("evidence").alias("evidence_count"),
            F.lit("").alias("added"),
        ).alias("provenance"),
    )


def case_skeletons(mined: DataFrame, ctx: DataFrame, key: str = "utterance_id") -> DataFrame:
    """A positive case from a real context and a negative one to be completed, per pair."""
    first = ctx.groupBy("lang", "wrong", "right").agg(
        F.min(F.struct(key, "place", "hyp")).alias("_first")
    )
    joined = mined.join(first, ["lang", "wrong", "right"], "left")
    cases = F.array(
        F.struct(
            F.coalesce(F.col("_first.hyp"), F.concat(F.lit("the "), "wrong")).alias("input"),
            F.lit(True).alias("fires"),
        ),
        F.struct(
            F.concat(F.lit("TODO legit use of "), "wrong").alias("input"),
            F.lit(False).alias("fires"),
        ),
    )
    return joined.select("lang", "wrong", "right", F.inline(cases))
