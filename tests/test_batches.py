"""Work on whole batches against the plain recurrences."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from soundquay.functions import batches
from soundquay.functions.text import SEPARATOR, phonetic_key, sound_letters, word_key
from soundquay.operators import corpus, matcher, metrics, mining
from soundquay.plans import load_catalogue


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def texts():
    rng = random.Random(1)
    left, right = [], []
    for _ in range(500):
        letters = rng.choice(["ab", "abc d", "añ€😀 x"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([0, 1, 5, 24, 63, 64, 65, 130, 200]))))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choice(letters)
        if rng.random() < 0.2:
            b = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        left.append(" ".join(a.split()))
        right.append(" ".join("".join(b).split()))
    return left, right


def test_distances_against_the_plain_recurrence():
    a, b = texts()
    got = batches.distances(*batches.characters(pa.array(a), pa.array(b)))
    assert got.tolist() == [plain_distance(x, y) for x, y in zip(a, b, strict=True)]
    codes, _ = batches.words(pa.array(a), pa.array(b))
    assert batches.distances(*codes).tolist() == [plain_distance(x.split(), y.split()) for x, y in zip(a, b, strict=True)]


def test_replaced_words_against_the_banded_walk():
    a, b = ([" ".join(x.replace(" ", "")) for x in side] for side in texts())
    row, place, wrong, right = mining._aligned(pa.array(a), pa.array(b))
    got = {}
    for r, *found in zip(row.tolist(), place.tolist(), wrong.to_pylist(), right.to_pylist(), strict=True):
        got.setdefault(r, []).append(tuple(found))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        assert sorted(got.get(k, [])) == sorted(mining._substitutions(x.split(), y.split()))


@pytest.mark.parametrize("most", [4, 512])
def test_long_pairs_go_on_in_the_old_way(spark, monkeypatch, most):
    for module in (batches, mining):
        monkeypatch.setattr(module, "MOST", most)
    rows = [(1, "en", "one two three four", "one too three"), (2, "en", "a b", "a c"), (3, "en", "", "x"), (4, "en", "x", "")]
    df = spark.createDataFrame(rows, "utterance_id long, lang string, ref string, hyp string")
    got = {r["utterance_id"]: (r["word_edits"], r["char_edits"]) for r in metrics.measure(df).collect()}
    assert got == {1: (2, 6), 2: (1, 1), 3: (0, 0), 4: (1, 1)}
    subs = sorted(tuple(r) for r in mining.substitutions(df).collect())
    assert subs == [(1, "en", 1, "too", "two"), (2, "en", 1, "c", "b")]


def test_pairs_are_read_and_aligned_once(spark):
    """One scan and one Python step; the counts of a pair need no join with totals."""
    df = spark.createDataFrame([(1, "en", "a b", "a c")], "utterance_id long, lang string, ref string, hyp string")
    plan = mining.evidence(mining.substitutions(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "Join" not in plan


def test_sound_keys_by_word_equal_those_of_the_expression(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioubcdghkmnpqstvwxyzñéß1") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows = [(w, lang) for w in [*words, SEPARATOR, "thumb", "ghost", "bocina", "'s"] for lang in ("en", "es")]
    df = spark.createDataFrame(rows, "w string, lang string")
    lang = F.col("lang")
    out = df.select("lang", sound_letters(F.col("w"), lang).alias("l"), phonetic_key(F.col("w"), lang).alias("k")).collect()
    assert [r for r in out if word_key(r["l"], r["lang"]) != r["k"]] == []


def test_keywords_by_sound(spark):
    rows = [("we had soup", ["soap", "", "we", "glass"], "en"), ("", ["a"], "en"), ("un vaso", ["bazo", "un vazo"], "es"), ("x", [], "en"), ("x", None, "en")]
    df = spark.createDataFrame([("ref", *r) for r in rows], "ref string, hyp string, keywords array<string>, lang string")
    got = [(r["n_keywords"], r["n_recovered"]) for r in metrics.measure(df).collect()]
    assert got == [(4, 2), (1, 0), (2, 2), (0, 0), (0, 0)]


def test_samples_of_distinct_keys(spark):
    rows = [(c, f"k{i}") for c in ("a", None) for i in range(40) for _ in range(3)]
    df = spark.createDataFrame(rows, "cell string, key string").repartition(7)
    want = corpus.sample_cells(df.distinct(), ["cell"], "key", 5)
    got = corpus.sample_distinct(df, ["cell"], "key", 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 10


def test_samples_are_dealt_out_after_each_task_cut_them(spark, sf_dir):
    plan = load_catalogue()["cell_samples"].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInPandas") :]


def test_results_of_short_texts_are_worked_out_once():
    made = matcher.Matcher([("en", 2, "iced tea", "iced tea")], [])
    for _ in range(3):
        assert made.made("one icd tea please", "en")[1] == "one iced tea please"
    assert made._short.cache_info().hits >= 2
    long = "one icd tea " + "x " * 200
    assert made.made(long, "en")[1].startswith("one iced tea x") and made.made(None, "en") == ([], None)
