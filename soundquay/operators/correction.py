"""Transcript correction: lexicon recovery, context-gated rewrite rules, and their merge.

A lexicon and rules of a checked size are compiled and walked once per text (``matcher``). Larger
ones stay tables, and the rest of this module applies: candidates of both kinds are found by equality joins on exploded word groups (narrow apart from
the joins), gathered once per text, and resolved in order by one fold over the candidate array.
Only texts with candidates take part in the gathering shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.bind import let
from soundquay.functions.text import (
    fold_diacritics,
    match_case,
    normalize,
    normalized_words,
    raw_words,
)
from soundquay.functions.distance import similarity
from soundquay.operators import matcher
from soundquay.operators.lexicon import distance_share, group_keys, similar_enough, term_pieces
from soundquay.sources.stage import stage_table

_HIT = (
    "struct<start:int,end:int,rule_id:string,before:string,after:string,confidence:double>"
)
CORRECTIONS = f"array<{_HIT}>"
_HITS = "array<struct<start:int,end:int,rule_id:string,after:string,confidence:double>>"


def _is_stopword(word: Column, lang: Column) -> Column:
    hit = F.lit(False)
    for code, words in fixed.STOPWORDS.items():
        hit = hit | ((lang == code) & word.isin(*words))
    return hit


def word_groups(texts: DataFrame, key: str, wanted: Column | None = None) -> DataFrame:
    """Groups of one to three neighbouring words in normal form, with their place.

    ``wanted`` is a condition on ``lang``, ``n`` and ``length`` (columns of the result).
    """

    def group(norm: Column, n: int) -> Column:
        count = F.size(norm) - n + 1

        def at(i: Column) -> Column:
            words = [F.get(norm, i + k) for k in range(n)]
            return F.struct(
                i.cast("int").alias("start"),
                F.lit(n).alias("n"),
                F.concat_ws(" ", *words).alias("gram"),
            )

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(
            F.array().cast("array<struct<start:int,n:int,gram:string>>")
        )

    groups = let(
        normalized_words(raw_words(F.col("text")), F.col("lang")),
        lambda norm: F.concat(*[group(norm, n) for n in (1, 2, 3)]),
    )
    out = texts.select(key, "lang", F.inline(groups)).withColumn("length", F.length("gram"))
    return out if wanted is None else out.filter(wanted)


def _spans(df: DataFrame, length: str) -> dict[tuple[str, int], tuple[int, int]]:
    """Shortest and longest form per language and number of words: at most six rows."""
    rows = df.groupBy("lang", "n").agg(F.min(length).alias("lo"), F.max(length).alias("hi"))
    return {(r["lang"], r["n"]): (r["lo"], r["hi"]) for r in rows.collect()}


def _within(spans: dict[tuple[str, int], tuple[int, int]], any_n: bool) -> Column:
    inside = F.lit(False)
    for (lang, n), (low, high) in spans.items():
        fits = (F.col("lang") == lang) & F.col("length").between(low, high)
        inside = inside | (fits if any_n else fits & (F.col("n") == n))
    return inside


def lexicon_candidates(texts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Exact groups (they only lock their words) and fuzzy groups with the term to put in.

    Texts are read once. Word groups are cut down to lengths that occur in the lexicon, met with
    the exact forms, and only what is no term itself is looked up by its pieces. Only groups that
    hit a term leave this step. A group can come up for several terms and pieces, best first in
    the order of ``far, ord``.
    """
    # as text, in the order of the values: rules have no such number
    text_ord = F.col("ord").cast("string")
    ordered = text_ord if dict(terms.dtypes)["ord"] == "string" else F.lpad(text_ord, 20, "0")
    dims = stage_table(terms.select("lang", "n", "norm", ordered.alias("ord"), "canonical"), "lexicon")
    pieces = stage_table(term_pieces(dims), "lexicon-pieces")
    whole = dims.select(
        "lang", F.col("norm").alias("gram"), F.length("norm").alias("_len"), "n"
    )
    can_equal = _within(_spans(whole, "_len"), any_n=True)
    can_match = _within(_spans(pieces, "q_len"), any_n=False) & ~(
        (F.col("n") == 1) & _is_stopword(F.col("gram"), F.col("lang"))
    )
    groups = word_groups(texts, key, can_equal | can_match).withColumn("_fuzzy", can_match)
    known = groups.join(
        whole.select("lang", "gram", F.lit(True).alias("exact")), ["lang", "gram"], "left"
    ).withColumn("exact", F.coalesce("exact", F.lit(False)))
    keyed = known.filter("exact or _fuzzy").select(
        key,
        "lang",
        "start",
        "n",
        "gram",
        "exact",
        F.inline(group_keys(F.col("gram"), F.col("n"), F.col("exact"))),
    )
    met = keyed.join(pieces, ["lang", "n", "q_len", "piece_no", "piece"], "left").filter(
        F.col("exact") | F.col("norm").isNotNull()
    )
    hits = met.filter(
        F.col("exact") | similar_enough(F.col("gram"), F.col("norm"), F.col("n"))
    )
    sure = similarity(F.col("gram"), normalize(F.col("canonical"), F.col("lang"))) / 100.0
    fuzzy = ~F.col("exact")
    return hits.select(
        key,
        "start",
        "n",
        "exact",
        F.when(fuzzy, distance_share(F.col("gram"), F.col("norm"))).otherwise(0.0).alias("far"),
        "ord",
        F.when(fuzzy, F.col("canonical")).alias("after"),
        F.when(fuzzy, F.round(sure, 3)).alias("confidence"),
    )


def prepare_rules(rules: DataFrame, mode: str) -> DataFrame:
    """Folded match words and context phrases of the rules that may fire in ``mode``."""
    statuses = ["active"] if mode == "replace" else ["active", "approved"]

    def fold(text: Column) -> Column:
        return fold_diacritics(normalize(text, F.col("lang")))

    wrong = F.split(fold(F.col("wrong")), " ")
    return (
        rules.filter(F.col("status").isin(*statuses))
        .withColumn("wrong_words", wrong)
        .withColumn("any_of", F.transform("context_any", fold))
        .withColumn("none_of", F.transform("context_none", fold))
        .select(
            F.col("id").alias("rule_id"),
            "rule_ord",
            "lang",
            F.col("wrong_words")[0].alias("word"),
            "wrong_words",
            "right",
            "any_of",
            "none_of",
        )
    )


def _in_window(phrase: Column, window: Column) -> Column:
    """A single word must be one of the window's words; a phrase may stand anywhere in it."""
    return F.when(
        phrase.contains(" "), F.array_join(window, " ").contains(phrase)
    ).otherwise(F.array_contains(window, phrase))


def context_allows(any_of: Column, none_of: Column, window: Column) -> Column:
    blocked = F.exists(none_of, lambda p: _in_window(p, window))
    wanted = (F.size(any_of) == 0) | F.exists(any_of, lambda p: _in_window(p, window))
    return ~blocked & wanted


def rule_candidates(texts: DataFrame, rules: DataFrame, key: str, mode: str) -> DataFrame:
    """Places where a rule's words stand and its context gates pass."""
    ready = stage_table(prepare_rules(rules, mode), "rules")
    longest = ready.agg(F.max(F.size("wrong_words"))).first()[0] or 1
    reach = fixed.CONTEXT_REACH

    # each word carries only its neighbourhood, so long texts stay linear in size
    def places(raw: Column) -> Column:
        return let(
            normalized_words(raw, F.col("lang"), fold=True),
            lambda words: F.transform(
                words,
                lambda w, i: F.struct(
                    i.alias("start"),
                    w.alias("word"),
                    F.slice(words, i + 1, longest).alias("ahead"),
                    F.slice(
                        words,
                        F.greatest(i - reach, F.lit(0)) + 1,
                        F.least(i, F.lit(reach)) + reach + 1,
                    ).alias("window"),
                    F.get(raw, i).alias("raw"),
                ),
            ),
        )

    words = texts.select(key, "lang", F.inline(let(raw_words(F.col("text")), places)))
    n = F.size("wrong_words")
    return (
        words.join(ready, ["lang", "word"])
        .filter(F.slice("ahead", 1, n) == F.col("wrong_words"))
        .filter(context_allows(F.col("any_of"), F.col("none_of"), F.col("window")))
        .select(
            key,
            "start",
            n.alias("n"),
            "rule_id",
            "rule_ord",
            match_case(F.col("raw"), F.col("right")).alias("after"),
        )
    )


def _clashes(spans: Column, c: Column) -> Column:
    return F.exists(
        spans, lambda s: (s["start"] < c["start"] + c["n"]) & (s["end"] > c["start"])
    )


def resolve(candidates: Column) -> Column:
    """Walk the candidates in order and keep those whose words are still free.

    Several candidates for the same words stand best first: the later ones find them taken.
    Exact lexicon groups lock words for the lexicon only; corrections lock words for all. A rule
    fires at most once per text.
    """
    spans = "array<struct<start:int,end:int>>"
    empty = F.struct(
        F.array().cast(spans).alias("lexicon"),
        F.array().cast(spans).alias("used"),
        F.array().cast("array<string>").alias("fired"),
        F.array().cast(_HITS).alias("hits"),
    )

    def step(acc: Column, c: Column) -> Column:
        is_rule = c["rule_ord"] >= 0
        blocked = F.when(
            is_rule, _clashes(acc["used"], c) | F.array_contains(acc["fired"], c["rule_id"])
        ).otherwise(_clashes(acc["lexicon"], c))
        span = F.array(
            F.struct(c["start"].alias("start"), (c["start"] + c["n"]).alias("end"))
        )
        hit = F.array(
            F.struct(
                c["start"].alias("start"),
                (c["start"] + c["n"]).alias("end"),
                c["rule_id"].alias("rule_id"),
                c["after"].alias("after"),
                c["confidence"].alias("confidence"),
            )
        )
        taken = F.struct(
            F.concat(acc["lexicon"], span).alias("lexicon"),
            F.when(c["exact"], acc["used"]).otherwise(F.concat(acc["used"], span)).alias("used"),
            F.when(is_rule, F.concat(acc["fired"], F.array(c["rule_id"])))
            .otherwise(acc["fired"])
            .alias("fired"),
            F.when(c["exact"], acc["hits"]).otherwise(F.concat(acc["hits"], hit)).alias("hits"),
        )
        return F.when(blocked, acc).otherwise(taken)

    return F.array_sort(F.aggregate(candidates, empty, step, lambda acc: acc["hits"]))


def _with_source(text: Column, hits: Column) -> Column:
    """Add the words each hit stands for."""

    def fill(words: Column) -> Column:
        return F.transform(
            hits,
            lambda h: F.struct(
                h["start"].alias("start"),
                h["end"].alias("end"),
                h["rule_id"].alias("rule_id"),
                F.array_join(F.slice(words, h["start"] + 1, h["end"] - h["start"]), " ").alias(
                    "before"
                ),
                h["after"].alias("after"),
                h["confidence"].alias("confidence"),
            ),
        )

    return F.when(hits.isNotNull(), let(raw_words(text), fill))


def rewrite(words: Column, hits: Column) -> Column:
    """Put each hit's replacement at its first word and drop its other words."""
    kept = F.transform(
        words,
        lambda w, i: F.coalesce(
            F.get(F.filter(hits, lambda h: h["start"] == i), F.lit(0))["after"],
            F.when(~F.exists(hits, lambda h: (h["start"] < i) & (h["end"] > i)), w),
        ),
    )
    return F.array_join(F.array_compact(kept), " ")


def correct(
    texts: DataFrame,
    terms: DataFrame | None = None,
    rules: DataFrame | None = None,
    mode: str = "log_only",
    key: str = "utterance_id",
) -> DataFrame:
    """Add ``corrections`` and ``corrected``; in ``log_only`` the text stays as it is.

    Works as a transform: ``df.transform(correct, terms, rules, "replace")``. With a lexicon and
    rules that can be compiled, texts are read once and not shuffled, and ``key`` is not used; else
    keys may repeat, and texts are told apart by key and text.
    """
    columns = [c for c in texts.columns if c not in ("corrections", "corrected")]
    rows = matcher.compiled(terms, rules, mode) if terms is not None or rules is not None else None
    if rows is not None:
        # unfolded from an array of one: Spark leaves a UDF unplanned whose argument holds lambdas
        pair = F.inline(F.array(F.struct(F.col("text").alias("_text"), F.col("lang").alias("_lang"))))
        made = texts.select(*columns, pair).withColumn("_made", matcher.matched(texts, rows, CORRECTIONS))
        text = F.col("_made.corrected") if mode == "replace" else F.col("text")
        return made.select(*columns, F.col("_made.corrections").alias("corrections"), text.alias("corrected"))
    body = F.hex(F.xxhash64("lang", "text"))
    texts = texts.withColumn("_row", F.concat_ws(" ", F.col(key).cast("string"), body))
    key = "_row"
    found: DataFrame | None = None
    if terms is not None:
        found = lexicon_candidates(texts, terms, key).select(
            key,
            F.struct(
                F.lit(0).alias("stage"),
                (-F.col("n")).alias("order"),
                F.col("start").cast("int").alias("start"),
                F.col("n").cast("int").alias("n"),
                (~F.col("exact")).alias("inexact"),
                "far",
                "ord",
                "exact",
                F.lit("lexicon").alias("rule_id"),
                F.lit(-1).alias("rule_ord"),
                "after",
                "confidence",
            ).alias("c"),
        )
    if rules is not None:
        from_rules = rule_candidates(texts, rules, key, mode).select(
            key,
            F.struct(
                F.lit(1).alias("stage"),
                F.col("rule_ord").cast("int").alias("order"),
                F.col("start").cast("int").alias("start"),
                F.col("n").cast("int").alias("n"),
                F.lit(True).alias("inexact"),
                F.lit(0.0).alias("far"),
                F.lit("").alias("ord"),
                F.lit(False).alias("exact"),
                "rule_id",
                F.col("rule_ord").cast("int").alias("rule_ord"),
                "after",
                F.lit(1.0).alias("confidence"),
            ).alias("c"),
        )
        found = from_rules if found is None else found.unionByName(from_rules)
    none = F.array().cast(CORRECTIONS)
    if found is None:
        plain = texts.withColumn("corrections", none).withColumn("corrected", F.col("text"))
        return plain.select(*columns, "corrections", "corrected")
    hits = (
        found.groupBy(key)
        .agg(F.array_sort(F.collect_list("c")).alias("_c"))
        .select(key, resolve(F.col("_c")).alias("_hits"))
        .filter(F.size("_hits") > 0)
    )
    joined = texts.join(hits, key, "left").withColumn(
        "corrections", F.coalesce(_with_source(F.col("text"), F.col("_hits")), none)
    )
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    if mode == "replace":
        text = F.when(blank | ~F.col("lang").isin(*fixed.LANGS), F.col("text")).otherwise(
            rewrite(raw_words(F.col("text")), F.col("corrections"))
        )
    else:
        text = F.col("text")
    return joined.withColumn("corrected", text).select(*columns, "corrections", "corrected")
