"""Golden texts for lexicon recovery and context-gated rules."""

from __future__ import annotations

import itertools

import pytest
from golden_data import CASES, MENU, RULES
from pyspark.sql import functions as F

from soundquay.functions.distance import indel_distance, similarity, word_edits
from soundquay.operators import matcher
from soundquay.operators.correction import correct
from soundquay.operators.lexicon import best_terms, similar_pairs
from soundquay.operators.terms import bilingual_prompt, initial_prompt, lexicon, menu_terms


@pytest.fixture(scope="module")
def menu(spark):
    rows = [(lang, i, term, canonical) for i, (lang, term, canonical) in enumerate(MENU)]
    return spark.createDataFrame(rows, "lang string, ord int, term string, canonical string")


@pytest.fixture(scope="module")
def rules(spark):
    rows = [(i, *rule) for i, rule in enumerate(RULES)]
    return spark.createDataFrame(
        rows,
        "rule_ord int, id string, lang string, wrong string, right string, "
        "context_any array<string>, context_none array<string>, status string",
    )


@pytest.fixture(params=["compiled", "joined"], autouse=True)
def way(request, monkeypatch):
    """Both ways of ``correct``: the compiled matcher and the joins for large tables."""
    if request.param == "joined":
        monkeypatch.setattr(matcher, "MOST_ENTRIES", 0)


def run(spark, menu, rules, texts, mode):
    df = spark.createDataFrame(
        [(i, lang, text) for i, (lang, text) in enumerate(texts)],
        "utterance_id int, lang string, text string",
    )
    out = df.transform(correct, lexicon(menu), rules, mode).orderBy("utterance_id").collect()
    return [(r["corrected"], [(c["rule_id"], c["after"]) for c in r["corrections"]]) for r in out]


@pytest.mark.parametrize("mode", ["replace", "log_only"])
def test_golden_cases(spark, menu, rules, mode):
    cases = [c for c in CASES if c[4] == mode]
    got = run(spark, menu, rules, [(c[0], c[2]) for c in cases], mode)
    for case, (text, fired) in zip(cases, got, strict=True):
        assert text == case[3], case
        assert (case[1] in {rule for rule, _ in fired}) == case[5], case


def test_rule_engine_details(spark, menu, rules):
    texts = [
        ("es", "Me da un Tejedor"),
        ("es", "quiero un plazo de comida"),
        ("es", "me da una servilleta"),
        ("es", "me da un tenedor"),
        ("es", "me da un tejedor y un tejedor"),
        ("fr", "me da un  tejedor"),
        ("es", "  "),
    ]
    got = [text for text, _ in run(spark, menu, rules, texts, "replace")]
    assert got == [
        "Me da un Tenedor",
        "quiero un plazo de comida",
        "me da una servilleta",
        "me da un tenedor",
        "me da un tenedor y un tejedor",  # one firing per rule and text
        "me da un  tejedor",
        "  ",
    ]


def test_lexicon_recovers_and_guards(spark, menu, rules):
    texts = [
        ("es", "papas fritaz"),
        ("es", "ensalda"),
        ("es", "hamburgesa"),
        ("es", "universidad"),
        ("es", "de"),
        ("es", "quiero una ensalda con papas fritas"),
    ]
    got = run(spark, menu, None, texts, "replace")
    assert got[0][0] == "papas fritas"  # 91.67 is enough for two words
    assert got[1][0] == "ensalada"
    assert got[2][0] == "hamburguesa clásica"
    assert got[3][1] == [] and got[4][1] == []
    assert got[5] == ("quiero una ensalada con papas fritas", [("lexicon", "ensalada")])


def test_similarity_values(spark):
    pairs = [("hamburgesa", "hamburguesa", 95.24), ("papas fritaz", "papas fritas", 91.67),
             ("flies", "fries", 80.0), ("", "", 100.0), ("abc", "", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for row in df.withColumn("got", similarity(F.col("a"), F.col("b"))).collect():
        assert row["got"] == pytest.approx(row["want"], abs=0.01)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_pieces_find_every_similar_pair(spark):
    """The piece join must find what comparing everything with everything finds."""
    import random

    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(4, 26))).strip()
                    for _ in range(60)})
    terms = [t for t in terms if len(t) > 3 and "  " not in t]
    grams = set()
    for t in terms:
        for _ in range(12):
            s = list(t)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(s) + 1)
                if rng.random() < 0.5 and s:
                    s.pop(min(at, len(s) - 1))
                else:
                    s.insert(at, rng.choice("abc"))
            grams.add("".join(s))
    grams = sorted(g for g in grams if g)
    term_rows = [("es", n, t, i, t) for i, t in enumerate(terms) for n in (1, 2)]
    tdf = spark.createDataFrame(term_rows, "lang string, n int, norm string, ord int, canonical string")
    gdf = spark.createDataFrame([("es", n, g) for g in grams for n in (1, 2)],
                                "lang string, n int, gram string")
    got = {(r["n"], r["gram"], r["norm"]) for r in similar_pairs(gdf, tdf).collect()}
    want = set()
    for g, t in itertools.product(grams, terms):
        if g == t or abs(len(g) - len(t)) > 3:
            continue
        d = len(g) + len(t) - 2 * plain_lcs(g, t)
        for n, percent in ((1, 92), (2, 90)):
            if 100 * d <= (100 - percent) * (len(g) + len(t)):
                want.add((n, g, t))
    assert want and got == want


def test_best_term_tie_goes_to_the_first(spark):
    terms = spark.createDataFrame(
        [("es", 1, "abcdefgh", 2, "late"), ("es", 1, "abcdefgi", 1, "early")],
        "lang string, n int, norm string, ord int, canonical string")
    grams = spark.createDataFrame([("es", 1, "abcdefg")], "lang string, n int, gram string")
    assert best_terms(grams, terms).first()["canonical"] == "early"


def test_long_strings_use_the_row_form(spark):
    a, b = "ab" * 45, "ba" * 40 + "c"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(indel_distance(F.col("a"), F.col("b"))).first()[0] == (
        len(a) + len(b) - 2 * plain_lcs(a, b)
    )


def test_word_edits_many_words(spark):
    ref = [f"w{i}" for i in range(60000)]
    hyp = ref[:10] + ["x"] + ref[11:59990]
    small = spark.createDataFrame([(ref[:300], ref[:100] + ["x"] + ref[101:290])],
                                  "r array<string>, h array<string>")
    assert small.select(word_edits(F.col("r"), F.col("h"))).first()[0] == 11
    assert len(hyp) == 59990


def test_prompts(spark, menu):
    terms = menu_terms(menu)
    assert terms.groupBy("lang", F.lower("term")).count().filter("count > 1").count() == 0
    prompt = {r["lang"]: r["prompt"] for r in initial_prompt(menu, 6).collect()}
    assert prompt["es"] == "hamburguesa clásica, hamburguesa, burger"  # the next term needs 3 words
    both = bilingual_prompt(menu, 5).first()["prompt"]
    assert both == "hamburguesa clásica, classic burger, hamburguesa"


def test_texts_with_one_key_do_not_mix(spark, menu, rules):
    texts = [("es", "me da un tejedor y un plato"), ("es", "quiero un plazo de comida"), ("es", "nada de eso")]
    apart = run(spark, menu, rules, texts, "replace")
    df = spark.createDataFrame(
        [(7, lang, text) for lang, text in [*texts, texts[0]]], "utterance_id int, lang string, text string"
    )
    out = df.transform(correct, lexicon(menu), rules, "replace")
    assert out.columns == ["utterance_id", "lang", "text", "corrections", "corrected"]
    got = {r["text"]: r["corrected"] for r in out.collect()}
    assert out.count() == 4 and got == {text: fixed for (_, text), (fixed, _) in zip(texts, apart)}


def test_phrases_of_any_length(spark, menu):
    """A rule of twelve words, overlapping phrases, and a rule that is part of another."""
    long = "one two three four five six seven eight nine ten eleven twelve"
    made = [(0, "r0", "en", long, "dozen", [], [], "active"), (1, "r1", "en", "five six", "56", [], [], "active"),
            (2, "r2", "en", "six seven", "67", [], [], "active"), (3, "r3", "en", "b", "B2", ["a"], ["c d"], "active")]
    rules = spark.createDataFrame(
        made, "rule_ord int, id string, lang string, wrong string, right string, "
        "context_any array<string>, context_none array<string>, status string")
    got = run(spark, menu, rules, [("en", f"so {long} go"), ("en", "five six seven"), ("en", "six seven five six seven"),
                                   ("en", "a b c d"), ("en", "a b c e"), ("en", "x b")], "replace")
    assert [g[0] for g in got] == ["so dozen go", "56 seven", "67 56 seven", "a b c d", "a B2 c e", "x b"]


def test_both_ways_agree(spark, monkeypatch):
    """Random texts over damaged terms, with rules between them: the same corrections either way."""
    import random

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeghilmnoprst") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    terms = sorted({" ".join(rng.sample(words, rng.choice([1, 1, 2, 3]))) for _ in range(30)})
    lex = spark.createDataFrame([("en", len(t.split()), t, i, t.title()) for i, t in enumerate(terms)],
                                "lang string, n int, norm string, ord int, canonical string")
    rules = spark.createDataFrame(
        [(i, f"r{i}", "en", " ".join(rng.sample(words, rng.choice([1, 2]))), f"R{i}", rng.sample(words, rng.choice([0, 8])),
          rng.sample(words, 1), "active") for i in range(12)],
        "rule_ord int, id string, lang string, wrong string, right string, context_any array<string>, "
        "context_none array<string>, status string")

    def damaged(word):
        i = rng.randrange(len(word))
        return rng.choice([word, word, word[:i] + word[i + 1:], word[:i] + "z" + word[i:], word.title()])

    texts = [" ".join(damaged(w) for t in rng.sample(terms, 4) for w in t.split()) + " " + " ".join(rng.sample(words, 5))
             for _ in range(150)]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "utterance_id int, lang string, text string")

    def rows():
        return sorted(map(str, df.transform(correct, lex, rules, "replace").collect()))

    monkeypatch.setattr(matcher, "MOST_ENTRIES", 0)
    joined = rows()
    monkeypatch.setattr(matcher, "MOST_ENTRIES", 1000)
    assert rows() == joined


def test_compiled_way_does_not_shuffle(spark, menu, rules):
    from soundquay.operators.terms import lexicon as made

    df = spark.createDataFrame([(1, "es", "papas fritaz")], "utterance_id int, lang string, text string")
    plan = df.transform(correct, made(menu), rules, "replace")._jdf.queryExecution().toString()
    assert ("Exchange" in plan) == (matcher.MOST_ENTRIES == 0)
