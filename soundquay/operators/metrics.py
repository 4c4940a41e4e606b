"""Word, character and keyword error rates over paired transcripts.

``measure`` turns each pair into integer counts (a narrow step); every rate is a ratio of sums
of these counts, so grouping needs one partial aggregation and never holds a group in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from soundquay.functions.batches import char_distance, word_distance
from soundquay.functions.bind import let
from soundquay.functions.distance import char_edits, word_edits
from soundquay.functions.text import SEPARATOR, normalize, sound_letters, split_words, word_key


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def keyword_hits(keywords: Column, hyp_norm: Column, lang: Column, sound: bool = True) -> Column:
    """How many keywords occur in the hypothesis word for word, and what is said besides.

    A struct of ``exact`` and ``said``: the hypothesis and the keywords that it lacks, in the letters of
    the sound keys with a separator between them; null where none is lacking, or without ``sound``.
    An empty keyword never counts as found.
    """
    if not sound:
        text = _padded(hyp_norm)
        exact = F.filter(keywords, lambda k: let(normalize(k, lang), lambda n: (n != "") & text.contains(_padded(n))))
        return F.struct(F.size(exact).cast("long").alias("exact"), F.lit(None).cast("string").alias("said"))

    def count(plain: Column) -> Column:
        there = let(_padded(hyp_norm), lambda text: F.transform(
            F.filter(plain, lambda k: k != ""), lambda k: F.struct(k.alias("k"), text.contains(_padded(k)).alias("in"))))
        return let(there, lambda ks: F.struct(
            F.size(F.filter(ks, lambda k: k["in"])).cast("long").alias("exact"),
            F.when(F.exists(ks, lambda k: ~k["in"]) & (hyp_norm != ""), sound_letters(F.concat_ws(
                f" {SEPARATOR} ", F.array(hyp_norm), F.transform(F.filter(ks, lambda k: ~k["in"]), lambda k: k["k"])
            ), lang)).alias("said"),
        ))

    return let(F.transform(keywords, lambda k: normalize(k, lang)), count)


@F.arrow_udf(LongType())
def keywords_by_sound(said: pa.Array, lang: pa.Array) -> pa.Array:
    """How many of the keywords in ``said`` sound like words of the hypothesis in front of them."""
    counts = []
    for text, code in zip(said.to_pylist(), lang.to_pylist(), strict=True):
        n = 0
        if text is not None:
            hyp, *runs = text.split(f" {SEPARATOR} ")
            keys = [f" {' '.join([word_key(w, code) for w in x.split(' ')])} " for x in (hyp, *runs)]
            n = sum(run in keys[0] for run in keys[1:])
        counts.append(n)
    return pa.array(counts, pa.int64())


def measure(df: DataFrame, sound: bool = True) -> DataFrame:
    """Add the counts behind every rate to ``ref, hyp, lang[, keywords, guard_fired]``."""
    norm = df.withColumn("_ref", normalize(F.col("ref"), F.col("lang"))).withColumn(
        "_hyp", normalize(F.col("hyp"), F.col("lang"))
    )
    words = norm.withColumn("_ref_words", split_words(F.col("_ref"))).withColumn(
        "_hyp_words", split_words(F.col("_hyp"))
    )
    scored = F.col("_ref") != ""
    fired = F.col("guard_fired") if "guard_fired" in df.columns else F.lit(False)
    keywords = (
        F.coalesce(F.col("keywords"), F.array().cast("array<string>"))
        if "keywords" in df.columns
        else F.array().cast("array<string>")
    )
    recovered = F.lit(0).cast("long")
    if "keywords" in df.columns:
        # unfolded from an array of one: Spark leaves a UDF unplanned whose argument holds lambdas
        hits = F.when(F.size(keywords) > 0, keyword_hits(keywords, F.col("_hyp"), F.col("lang"), sound))
        words = words.select("*", F.inline(F.array(F.struct(hits.alias("_hits")))))
        by_sound = keywords_by_sound(F.col("_hits.said"), F.col("lang")) if sound else F.lit(0)
        recovered = F.coalesce(F.col("_hits.exact") + by_sound, F.lit(0)).cast("long")
    counted = (
        words.withColumn(
            "word_edits",
            F.when(scored, word_distance(
                F.col("_ref"), F.col("_hyp"), word_edits(F.col("_ref_words"), F.col("_hyp_words"))
            )).otherwise(0),
        )
        .withColumn("ref_words", F.size("_ref_words").cast("long"))
        .withColumn(
            "char_edits",
            F.when(scored, char_distance(
                F.col("_ref"), F.col("_hyp"), char_edits(F.col("_ref"), F.col("_hyp"))
            )).otherwise(0),
        )
        .withColumn("ref_chars", F.length("_ref").cast("long"))
        .withColumn("n_keywords", F.size(keywords).cast("long"))
        .withColumn("n_recovered", recovered)
        .withColumn(
            "hallucinated",
            (((F.col("_ref") == "") & (F.col("_hyp") != "")) | fired).cast("long"),
        )
    )
    return counted.drop("_ref", "_hyp", "_ref_words", "_hyp_words", "_hits")


def ratio(top: Column, bottom: Column) -> Column:
    """Null for an empty denominator."""
    return F.when(bottom > 0, top / bottom)


def wer() -> Column:
    return ratio(F.sum("word_edits"), F.sum("ref_words"))


def cer() -> Column:
    return ratio(F.sum("char_edits"), F.sum("ref_chars"))


def ker() -> Column:
    return 1.0 - ratio(F.sum("n_recovered"), F.sum("n_keywords"))


def keyword_recall() -> Column:
    """Recovered share; 1 when there is no keyword to recover."""
    return F.coalesce(ratio(F.sum("n_recovered"), F.sum("n_keywords")), F.lit(1.0))


def hallucination_rate() -> Column:
    return F.coalesce(F.sum("hallucinated") / F.count(F.lit(1)), F.lit(0.0))


def bundle(
    measured: DataFrame, by: Sequence[str] = ("lang",), more: Sequence[Column] = ()
) -> DataFrame:
    """All rates per group, and ``more`` aggregates; a null group key (clean audio) is a group of
    its own."""
    rates = [wer().alias("wer")]
    if "char_edits" in measured.columns:
        rates.append(cer().alias("cer"))
    rates += [
        ker().alias("ker"),
        hallucination_rate().alias("hallucination_rate"),
        F.count(F.lit(1)).alias("n_utts"),
        F.sum("n_keywords").alias("n_keywords"),
    ]
    if "avg_logprob" in measured.columns:
        rates.append(F.avg("avg_logprob").alias("avg_logprob_mean"))
    return measured.groupBy(*by).agg(*rates, *more)


def regression_report(measured: DataFrame) -> DataFrame:
    """Keyword recall on the ``keyword`` part and word error rate on the ``generic`` part."""

    def only(part: str, column: str) -> Column:
        return F.sum(F.when(F.col("part") == part, F.col(column)))

    return measured.groupBy("lang").agg(
        F.coalesce(
            ratio(only("keyword", "n_recovered"), only("keyword", "n_keywords")), F.lit(1.0)
        ).alias("keyword_recall"),
        ratio(only("generic", "word_edits"), only("generic", "ref_words")).alias("generic_wer"),
    )


def corrector_gain(off: DataFrame, on: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Keyword error rate without and with correction, and the relative improvement."""
    before = off.groupBy("lang").agg(
        (1.0 - keyword_recall()).alias("ker_off"), F.count(F.lit(1)).alias("n")
    )
    after = on.groupBy("lang").agg((1.0 - keyword_recall()).alias("ker_on"))
    gain = (F.col("ker_off") - F.col("ker_on")) / F.greatest(F.col("ker_off"), F.lit(floor))
    return before.join(after, "lang").select(
        "lang", "ker_off", "ker_on", gain.alias("ker_rel_improvement"), "n"
    )


def false_correction_rate(corrected: DataFrame, corrections: str = "corrections") -> DataFrame:
    """Share of texts that got at least one correction."""
    return corrected.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum((F.size(corrections) > 0).cast("long")).alias("n_corrected"),
        F.avg((F.size(corrections) > 0).cast("double")).alias("false_correction_rate"),
    )


def paired_model_metrics(pairs: DataFrame, lang: str | None = None) -> DataFrame:
    """Production and candidate on the same inputs (``ref, prod_hyp, cand_hyp, *_logprob``)."""
    prod = measure(pairs.withColumn("hyp", F.col("prod_hyp")), sound=False)
    both = measure(
        prod.withColumnRenamed("word_edits", "prod_edits").withColumn("hyp", F.col("cand_hyp")),
        sound=False,
    )
    return both.agg(
        F.coalesce(ratio(F.sum("prod_edits"), F.sum("ref_words")), F.lit(0.0)).alias("prod_wer"),
        F.coalesce(ratio(F.sum("word_edits"), F.sum("ref_words")), F.lit(0.0)).alias("cand_wer"),
        F.coalesce(F.avg("prod_logprob"), F.lit(0.0)).alias("prod_logprob"),
        F.coalesce(F.avg("cand_logprob"), F.lit(0.0)).alias("cand_logprob"),
        F.count(F.lit(1)).alias("n"),
    )
