"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. For each n-gram the training rows give the
ratio of its smoothed share in toxic texts to that in the others; its logarithm is the value of
the feature. A logistic regression with an L2 penalty on these values gives the weights. Only the
n-grams whose ratio is surest (ratio against its standard error) are kept.

Training touches a bounded sample of labelled rows; scoring is one narrow pass over whole texts
with a weight table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay.llm.labelled import held_out, training_rows
from soundquay.llm.tables import Staged

BUCKETS = 1 << 20
N_GRAMS = (3, 4, 5, 6)
_CHUNK = 1 << 14
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(44)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of a lower-cased text, one array for each length."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    run = codes + np.uint64(1)
    for n in range(2, max(N_GRAMS) + 1):
        if len(codes) < n:
            return
        run = run[:-1] * _STEP + codes[n - 1 :] + np.uint64(n)
        if n in N_GRAMS:
            yield ((run ^ (run >> np.uint64(31))) * _MIX) >> _SHIFT


def present(text: str, kept: np.ndarray) -> np.ndarray:
    """The kept buckets that occur in a text, in ascending order."""
    found = [h[kept[h]] for h in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Model:
    """Weights by bucket, zero for n-grams that are not kept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: Column) -> Column:
        """Probability of toxicity; a null text counts as empty."""
        table = _broadcast(self.weights)
        intercept = self.intercept

        @F.pandas_udf("double")
        def logit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = table.value
            kept = weights != 0
            for part in texts:
                yield pd.Series([intercept + float(weights[present(t, kept)].sum()) for t in part])

        return 1 / (1 + F.exp(-logit(F.coalesce(text, F.lit("")))))


def _broadcast(array: np.ndarray):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(array)


def _counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each class that hold a bucket, in chunks of buckets."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for part in parts:
        for text, label in zip(part["text"], part["label"], strict=True):
            found = [*grams(text)]
            if found:
                seen[int(label), np.unique(np.concatenate(found))] += 1
    for i in range(0, BUCKETS, _CHUNK):
        piece = seen[:, i : i + _CHUNK]
        if piece.any():
            yield pd.DataFrame({"chunk": [i], "no": [piece[0].tobytes()], "yes": [piece[1].tobytes()]})


def _ratios(n_no: int, n_yes: int, smooth: float):
    def of(part: pd.DataFrame) -> pd.DataFrame:
        no = sum(np.frombuffer(x, np.int64) for x in part["no"])
        yes = sum(np.frombuffer(x, np.int64) for x in part["yes"])
        ratio = np.log((yes + smooth) / (n_yes + 2 * smooth)) - np.log((no + smooth) / (n_no + 2 * smooth))
        sure = np.abs(ratio) / np.sqrt(1 / (yes + smooth) + 1 / (no + smooth))
        at = np.flatnonzero(yes + no > 1)
        return pd.DataFrame({"bucket": at + int(part["chunk"].iloc[0]), "ratio": ratio[at], "sure": sure[at]})

    return of


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 10_000,
    features: int = 8192, smooth: float = 1.0, penalty: float = 0.001,
) -> Model:
    """Train on at most ``max_rows`` labelled rows outside the held-out fold.

    Without rows of both classes the model scores every text with the share of toxic rows (a half
    when there are no rows at all).
    """
    spark = docs.sparkSession
    work = Staged(spark, "toxicity")
    rows, path = work.put(training_rows(docs, labels, label, max_rows).repartition(16), "train")
    total = {int(x["label"]): x["count"] for x in rows.groupBy("label").count().collect()}
    no, yes = total.get(0, 0), total.get(1, 0)
    if not no or not yes:
        share = min(max((yes + 0.5) / (no + yes + 1), 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    best = (
        rows.mapInPandas(_counts, "chunk int, no binary, yes binary")
        .groupBy("chunk")
        .applyInPandas(_ratios(no, yes, smooth), "bucket int, ratio double, sure double")
        .orderBy(F.desc("sure"), "bucket")
        .limit(features)
        .toPandas()
        .sort_values("bucket")
    )
    buckets, ratios = best["bucket"].to_numpy(), best["ratio"].to_numpy()
    kept = np.zeros(BUCKETS, bool)
    kept[buckets] = True

    @F.udf(VectorUDT())
    def vector(text):
        at = np.searchsorted(buckets, present(text, kept).astype(np.int64))
        return Vectors.sparse(len(buckets), at, ratios[at])

    train = rows.select("label", vector("text").alias("features"))
    train, vectors = work.put(train, "vectors")
    model = LogisticRegression(regParam=penalty, maxIter=60, standardization=False).fit(train)
    weights = np.zeros(BUCKETS, np.float32)
    weights[buckets] = model.coefficients.toArray() * ratios
    work.drop(path)
    work.drop(vectors)
    return Model(weights, float(model.intercept))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of a half or more) for every row of docs."""
    model = fit(docs, labels)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        model.score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
