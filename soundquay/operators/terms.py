"""Menu terms: de-duplicated term lists, prompts within a word budget, the lexicon table.

A menu is a table ``lang, ord, term, canonical``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.text import phonetic_key, raw_words, tokens
from soundquay.operators.order import number_rows


def menu_terms(menu: DataFrame) -> DataFrame:
    """First spelling of each term per language, ignoring case, in menu order."""
    first = menu.groupBy("lang", F.lower("term").alias("_folded")).agg(
        F.min(F.struct("ord", "term")).alias("_first")
    )
    return first.select("lang", "_first.ord", "_first.term")


def _word_count(term: Column) -> Column:
    return F.size(raw_words(term)).cast("long")


def _within_budget(ordered: DataFrame, order: list[str], within: list[str], budget: int):
    """Terms are taken in order until the first one that would exceed the word budget."""
    costed = number_rows(
        ordered.withColumn("_cost", _word_count(F.col("term"))),
        order,
        within,
        "_at",
        value=F.col("_cost"),
        before="_spent",
    ).filter(F.col("_spent") + F.col("_cost") <= budget)
    # costs are positive, so the rows left are a prefix of at most ``budget`` terms
    return costed.groupBy(*within).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_at", "term"))), lambda s: s["term"]
            ),
            ", ",
        ).alias("prompt")
    )


def initial_prompt(menu: DataFrame, budget: int = fixed.PROMPT_BUDGET) -> DataFrame:
    return _within_budget(menu_terms(menu), ["ord"], ["lang"], budget)


def bilingual_terms(menu: DataFrame) -> DataFrame:
    """Spanish and English terms taken in turn, the longer tail at the end, first spelling kept."""
    placed = number_rows(menu_terms(menu), ["ord"], ["lang"], "turn").withColumn(
        "side", F.when(F.col("lang") == "es", 0).otherwise(1)
    )
    first = placed.groupBy(F.lower("term").alias("_folded")).agg(
        F.min(F.struct("turn", "side", "term")).alias("_first")
    )
    return first.select("_first.turn", "_first.side", "_first.term")


def bilingual_prompt(menu: DataFrame, budget: int = fixed.PROMPT_BUDGET) -> DataFrame:
    return _within_budget(bilingual_terms(menu), ["turn", "side"], [], budget)


def lexicon(menu: DataFrame, with_key: bool = True) -> DataFrame:
    """Terms of one to three words by normal form; the first writer of a form wins."""
    worded = menu.withColumn("_words", tokens(F.col("term"), F.col("lang"))).filter(
        F.size("_words").between(1, 3)
    )
    first = (
        worded.groupBy("lang", F.array_join("_words", " ").alias("norm"))
        .agg(F.min(F.struct("ord", "canonical", F.size("_words").alias("n"))).alias("_first"))
        .select("lang", "norm", "_first.ord", "_first.canonical", "_first.n")
    )
    return first.withColumn("key", phonetic_key(F.col("norm"), F.col("lang"))) if with_key else first
