"""Quality: a sparse rule ensemble over text statistics.

Shallow trees are grown on statistics of labelled texts; every path from a root is a rule, a
conjunction of thresholds. A logistic regression with a lasso penalty weighs the rules and leaves
most at zero. The rest is one Spark column expression over the statistics.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay.llm.labelled import held_out, training_rows
from soundquay.llm.tables import Staged, unused

STATISTICS = (
    "chars_log", "words_log", "word_chars", "longest_word_log", "upper_share", "digit_share",
    "mark_share", "symbol_share", "bar_share", "other_share", "space_share", "distinct_share",
    "top_word_share", "stutter_share", "line_words", "repeated_line_share", "marked_word_share",
    "entropy",
)
_CLASS = np.zeros(128, np.int64)  # 0 other, 1 upper, 2 digit, 3 mark, 4 symbol, 5 bar, 6 space
for _group, _chars in enumerate(
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#$%&*+/<=>@[\\]^_`{}~", "|", " \t\n\r\x0b\x0c"), 1
):
    _CLASS[[ord(c) for c in _chars]] = _group


def describe(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS; an empty text gives zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes[codes < 128]
    kinds = np.bincount(low, minlength=128)
    groups = np.bincount(_CLASS, weights=kinds, minlength=7) / len(codes)
    letters = kinds[kinds > 0] / len(codes)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    return [
        np.log1p(len(codes)),
        np.log1p(n),
        sum(map(len, words)) / n,
        np.log1p(max(map(len, counts))),
        *groups[1:6],
        (len(codes) - len(low)) / len(codes),
        groups[6],
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in counts.items() if not w[-1].isalnum()) / n,
        float(-(letters * np.log2(letters)).sum()),
    ]


def statistics(text: Column) -> Column:
    """The statistics of a text as an array of doubles; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([describe(t) for t in texts])

    return of(F.coalesce(text, F.lit("")))


#: A rule: (statistic, "<=" or ">", threshold), in the order of the path.
Rule = tuple[tuple[int, str, float], ...]
_NODE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.eE0-9]+)\)")


def paths(tree: str) -> list[Rule]:
    """All paths from the root of a tree in its printed form, inner nodes included."""
    found, stack = [], []
    for line in tree.splitlines():
        if m := _NODE.match(line):
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth]
            stack.append((depth, (int(m[2]), m[3], float(m[4]))))
            found.append(tuple(step for _, step in stack))
    return found


def holds(rule: Rule, at: Column) -> Column:
    test = F.lit(True)
    for i, sign, limit in rule:
        value = F.get(at, F.lit(i))
        test = test & (value <= limit if sign == "<=" else value > limit)
    return test


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, at: Column) -> Column:
        """The probability of good quality as one expression over a column of statistics."""
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + F.when(holds(rule, at), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 10_000,
    trees: int = 24, depth: int = 3, penalty: float = 0.002,
) -> Model:
    """Grow trees and weigh their rules on at most ``max_rows`` labelled rows.

    Rows of the held-out fold are never used. Without rows of both classes the model scores every
    text with the share of good rows (a half when there are no rows at all).
    """
    work = Staged(docs.sparkSession, "quality")
    rows = training_rows(docs, labels, label, max_rows).repartition(8, "doc_id")
    rows, path = work.put(rows.select("doc_id", "label", statistics(F.col("text")).alias("at")), "train")
    total = {int(x["label"]): x["count"] for x in rows.groupBy("label").count().collect()}
    no, yes = total.get(0, 0), total.get(1, 0)
    if not no or not yes:
        share = min(max((yes + 0.5) / (no + yes + 1), 1e-3), 1 - 1e-3)
        return Model((), float(np.log(share / (1 - share))))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, seed=7, featureSubsetStrategy="0.5"
    ).fit(rows.select("label", array_to_vector("at").alias("features")))
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString)})
    fired = F.array(*[holds(r, F.col("at")).cast("double") for r in rules])
    matrix, fired_path = work.put(rows.select("label", fired.alias("fired")), "rules")
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=80, standardization=False
    ).fit(matrix.select("label", array_to_vector("fired").alias("features")))
    weights = lasso.coefficients.toArray()
    work.drop(path)
    work.drop(fired_path)
    return Model(
        tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept)
    )


def scored(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """docs with the score in ``out``; the other columns stay as they are."""
    name = unused(docs, "_statistics")
    known = docs.withColumn(name, statistics(F.col(text)))
    return known.withColumn(out, model.score(F.col(name))).drop(name)


LEAST_SCORE = 0.3


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of LEAST_SCORE or more) for every row of docs."""
    model = fit(docs, labels)
    return scored(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"),
    )
