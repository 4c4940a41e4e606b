"""Known values for normal forms, guard, metrics, damage, policy, gates, drift and classifier."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions import guard as g
from soundquay.functions import signal
from soundquay.functions import text as t
from soundquay.operators import classifier, damage, gates, metrics, operations, policy


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "text,lang,want",
    [
        ("Hola, ¿me da café?", "es", "hola me da café"),
        ("Fries, please!", "en", "fries please"),
        ("I don't want water", "en", "i don't want water"),
        ("I don’t", "en", "i don't"),
        ("don't", "es", "don t"),
        ("'quote' end", "en", "quote end"),
        ("Dos HAMBURGUESAS!!", "es", "dos hamburguesas"),
        ("café niño", "es", "café niño"),
        ("", "es", ""),
    ],
)
def test_normalize(spark, text, lang, want):
    assert one(spark, t.normalize(F.lit(text), F.lit(lang)))[0] == want


def test_folding_and_words(spark):
    row = one(
        spark,
        t.fold_diacritics(F.lit("piñón ﬁn ½ Ångström")),
        t.tokens(F.lit("  "), F.lit("es")),
        t.normalized_words(t.raw_words(F.lit("Me  da, -- un-café")), F.lit("es"), True),
        t.normalized_words(t.raw_words(F.lit(" ")), F.lit("es")),
    )
    assert row[0] == "pinon fin 1⁄2 Angstrom"
    assert row[1] == [] and row[2] == ["me", "da", "", "un cafe"] and row[3] == []


def test_sound_keys(spark):
    spanish = "bocina cocina vaso bazo hielo cielo caza casa"
    assert one(spark, t.es_key(F.lit(spanish)))[0] == (
        "bosina kosina baso baso ielo sielo kasa kasa"
    )
    keys = one(spark, t.en_key(F.lit("soup soap glass class flies fries 123")))[0].split(" ")
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] != keys[5] and keys[6] == "123"


def segment(start, end, text, logprob=-0.3, silence=0.1):
    return (start, end, text, logprob, silence)


def test_guard_cases(spark):
    loop = "gracias por venir gracias por venir gracias por venir gracias por venir"
    rows = [
        (1, [segment(0.0, 4.0, loop, -0.4)], [(0.0, 9.0)]),
        (2, [segment(0.0, 1.0, "hola"), segment(1.0, 2.0, "ruido", -2.0, 0.95)], []),
        (3, [segment(0.0, 1.0, "hola"), segment(5.0, 6.0, "inventado")], [(0.0, 2.0)]),
        (4, [segment(0.0, 1.0, "me da  un cafe con leche")], [(0.0, 2.0)]),
        (5, [], [(0.0, 1.0)]),
    ]
    from soundquay import schemas

    df = spark.createDataFrame(
        rows, f"id int, segments {schemas.SEGMENTS}, vad {schemas.INTERVALS}"
    )
    out = {r["id"]: r for r in g.apply_guard(df).collect()}
    assert out[1]["text"] == "gracias por venir"
    assert out[1]["guard_flags"] == ["repetition_truncated"]
    assert out[2]["text"] == "hola" and out[2]["guard_flags"] == ["low_speech_dropped"]
    assert out[3]["text"] == "hola" and out[3]["guard_flags"] == ["vad_dropped"]
    assert out[4]["text"] == "me da  un cafe con leche" and out[4]["guard_flags"] == []
    assert out[5]["text"] == ""


def test_error_rates(spark):
    pairs = [
        ("the cat sat", "the cat sat", []),
        ("i want fries", "i want flies", ["fries"]),
        ("give me a spoon", "give me spoon", ["spoon"]),
        ("large soda please", "large soda please now", []),
        ("chicken sandwich", "chicken sandwich", None),
    ]
    df = spark.createDataFrame(
        [(r, h, "en", k) for r, h, k in pairs],
        "ref string, hyp string, lang string, keywords array<string>",
    )
    row = metrics.bundle(metrics.measure(df)).first()
    assert row["wer"] == pytest.approx(0.2)
    assert row["ker"] == pytest.approx(0.5) and row["n_keywords"] == 2
    one_pair = spark.createDataFrame(
        [("spoon", "spoons", "en"), ("", "hi", "en")], "ref string, hyp string, lang string"
    )
    row = metrics.bundle(metrics.measure(one_pair)).first()
    assert row["cer"] == pytest.approx(0.2)
    assert row["ker"] is None and row["hallucination_rate"] == 0.5


def test_keyword_matching_by_sound_and_phrase(spark):
    df = spark.createDataFrame(
        [
            ("quiero un bazo", "quiero un vaso", "es", ["bazo"]),
            ("x", "papas y fritas", "es", ["papas fritas", ""]),
            ("x", "unas PAPAS fritas!", "es", ["papas fritas"]),
        ],
        "ref string, hyp string, lang string, keywords array<string>",
    )
    got = [r["n_recovered"] for r in metrics.measure(df).orderBy("hyp").collect()]
    assert sorted(got) == [0, 1, 1]


MATRIX = [
    ("es", None, None, 0.10, 0.20, 0.0),
    ("es", "AC", "05", 0.13, 0.25, 0.0),
    ("es", "AC", "10", 0.20, 0.40, 0.05),
    ("es", "AC", "15", 0.35, 0.60, 0.10),
    ("es", "AB", "05", 0.11, 0.21, 0.0),
    ("es", "AB", "10", 0.12, 0.22, 0.0),
    ("es", "AB", "15", 0.14, 0.24, 0.0),
]
MATRIX_COLUMNS = (
    "lang string, noise_subtype string, noise_level string, wer double, ker double, "
    "hallucination_rate double"
)


def test_damage_index(spark):
    ranking = damage.damage_ranking(damage.damage_cells(spark.createDataFrame(MATRIX, MATRIX_COLUMNS)))
    rows = ranking.collect()
    assert [r["noise_subtype"] for r in rows] == ["AC", "AB"]
    assert rows[0]["per_level"] == {"05": 0.25, "10": 0.905, "15": 2.06}
    assert rows[0]["ndi"] == pytest.approx(1.0717, abs=1e-3)
    top = damage.top_subtypes(ranking, 1).first()
    assert top["noise_subtype"] == "AC"


def test_damage_without_keywords_or_clean_row(spark):
    rows = [("en", None, None, 0.10, None, 0.0), ("en", "BA", "10", 0.20, None, 0.0)]
    cells = damage.damage_cells(spark.createDataFrame(rows, MATRIX_COLUMNS))
    assert cells.first()["ndi"] == 0.5
    broken = spark.createDataFrame(rows[1:], MATRIX_COLUMNS)
    with pytest.raises(Exception, match="no clean row"):
        damage.damage_cells(broken).collect()


def test_sampling_weights_sum_to_one_and_boost(spark):
    ndi = spark.createDataFrame(
        [("es", "AA", 1.0), ("es", "BB", 1.0), ("en", "AA", 0.2)],
        "lang string, noise_subtype string, ndi double",
    )
    subtypes = spark.createDataFrame([("AA",), ("BB",)], "noise_subtype string")
    residual = spark.createDataFrame([("BB",)], "noise_subtype string")
    rows = damage.sampling_weights(ndi, subtypes, residual).collect()
    weight = {(r["lang"], r["noise_subtype"]): r["weight"] for r in rows}
    assert weight[("es", "AA")] + weight[("es", "BB")] == pytest.approx(1.0)
    assert weight[("es", "BB")] / weight[("es", "AA")] == pytest.approx(math.exp(1.0))


def effect(spark, rows):
    return spark.createDataFrame(
        rows,
        "lang string, subtype string, chain string, wer double, ker double, latency_ms double, "
        "chain_order int",
    )


def chains(es, en, subtype="BB", chain="gate", order=1):
    base = [(lang, subtype, "none", 0.40, 0.3, 0.0, 0) for lang in ("es", "en")]
    rows = [
        (lang, subtype, chain, *values, order)
        for lang, values in (("es", es), ("en", en))
        if values
    ]
    return base + rows


@pytest.mark.parametrize(
    "es,en,want",
    [
        ((0.30, 0.3, 100.0), (0.30, 0.3, 100.0), "gate"),
        ((0.30, 0.3, 100.0), (0.395, 0.3, 100.0), "none"),  # one language only
        ((0.30, 0.3, 500.0), (0.30, 0.3, 500.0), "none"),  # too slow
        ((0.30, 0.4, 100.0), (0.30, 0.3, 100.0), "none"),  # keywords get worse
        ((0.30, None, 100.0), (0.30, None, None), "gate"),  # unknown values do not forbid
        ((float("nan"), 0.3, 1.0), (0.30, 0.3, 1.0), "none"),  # an unknown gain never wins
        ((0.30, 0.3, 100.0), None, "none"),  # not measured in one language
    ],
)
def test_policy_cases(spark, es, en, want):
    subtypes = spark.createDataFrame([("AA",), ("BB",)], "subtype string")
    got = policy.generate_policy(effect(spark, chains(es, en)), subtypes)
    chosen = {r["subtype"]: r["chain"] for r in got.collect()}
    assert chosen == {"AA": "none", "BB": want}


def test_policy_tie_goes_to_the_first_chain(spark):
    rows = chains((0.3, 0.3, 1.0), (0.3, 0.3, 1.0), chain="z", order=1)
    rows += [r for r in chains((0.3, 0.3, 1.0), (0.3, 0.3, 1.0), chain="a", order=2) if r[2] == "a"]
    subtypes = spark.createDataFrame([("BB",)], "subtype string")
    assert policy.generate_policy(effect(spark, rows), subtypes).first()["chain"] == "z"


def model(spark, rows):
    return spark.createDataFrame(
        rows, "lang string, noisy_wer double, clean_wer double, keyword_recall double"
    )


@pytest.mark.parametrize(
    "candidate,want",
    [
        ([("es", 0.40, 0.10, 0.80), ("en", 0.32, 0.05, 0.90)], True),
        ([("es", 0.40, 0.10, 0.80), ("en", 0.39, 0.05, 0.90)], False),
        ([("es", 0.40, 0.13, 0.80), ("en", 0.32, 0.05, 0.90)], False),
        ([("es", 0.40, 0.10, 0.70), ("en", 0.32, 0.05, 0.90)], False),
    ],
)
def test_promotion_gate(spark, candidate, want):
    base = model(spark, [("es", 0.50, 0.10, 0.80), ("en", 0.40, 0.05, 0.90)])
    decided = gates.overall(gates.promotion_decision(base, model(spark, candidate))).first()
    assert decided["promote"] == want
    assert bool(decided["reasons"]) != want


def test_regression_and_shadow_gates(spark):
    columns = "lang string, keyword_recall double, generic_wer double"
    base = spark.createDataFrame([("es", 0.90, 0.10), ("en", 0.95, 0.05)], columns)
    good = spark.createDataFrame([("es", 0.895, 0.101), ("en", 0.95, 0.05)], columns)
    bad = spark.createDataFrame([("es", 0.85, 0.10), ("en", 0.95, 0.05)], columns)
    assert gates.overall(gates.regression_decision(base, good)).first()["promote"]
    assert not gates.overall(gates.regression_decision(base, bad)).first()["promote"]
    shadow = spark.createDataFrame(
        [(1, 0.1, 0.09, -0.4, -0.45, 900.0), (2, 0.1, 0.11, -0.4, -0.45, 900.0),
         (3, 0.1, 0.09, -0.4, -0.6, 900.0), (4, 0.1, 0.09, -0.4, -0.4, 3500.0)],
        "id int, prod_wer double, cand_wer double, prod_logprob double, cand_logprob double, "
        "cand_latency_ms double",
    )
    got = {r["id"]: r["reasons"] for r in gates.shadow_gate(shadow).collect()}
    assert got == {1: [], 2: ["wer"], 3: ["logprob"], 4: ["latency"]}
    assert gates.shadow_gate(shadow, False).first()["reasons"] == ["regression"]


# --- fixed values: confusion counts of 812 evaluated items, rows are the true labels ---
CONFUSION = {
    "AA": {"AB": 4, "CLEAN": 1, "AA": 4, "CA": 1},
    "AB": {"AB": 8, "AA": 2},
    "AC": {"CA": 1, "CLEAN": 6, "BC": 2, "AC": 9},
    "BA": {"BA": 169, "BB": 11, "CLEAN": 7, "BC": 1},
    "BB": {"BB": 281, "BA": 10, "CLEAN": 9},
    "BC": {"BA": 72, "BC": 76, "BB": 9, "CLEAN": 28, "CA": 3},
    "CA": {"CA": 16, "CLEAN": 2},
    "CLEAN": {"CLEAN": 80},
}


def test_classifier_scores(spark):
    rows = [(truth, pred, n) for truth, row in CONFUSION.items() for pred, n in row.items()]
    counts = spark.createDataFrame(rows, "truth string, pred string, n long")
    labels = list(CONFUSION)
    assert classifier.macro_f1(counts, labels).first()[0] == pytest.approx(0.7175, abs=5e-5)
    families = classifier.family_counts(counts)
    score = classifier.macro_f1(families, ["A", "B", "C", "CLEAN"]).first()[0]
    assert score == pytest.approx(0.8412, abs=5e-5)
    rates = classifier.clean_rates(counts).first()
    assert rates["clean_recall"] == 1.0 and rates["clean_fp_rate"] == 0.0
    assert rates["clean_precision"] == pytest.approx(0.6015, abs=5e-5)


def test_psi(spark):
    x = spark.createDataFrame([(float(i % 17),) for i in range(200)], "v double")
    shifted = x.select((F.col("v") + 9).alias("v"))
    empty = x.limit(0)
    same = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert operations.psi(x, x, "v").first()[0] == pytest.approx(0.0)
    assert operations.psi(x, shifted, "v").first()[0] > 0.2
    assert operations.psi(x, empty, "v").first()[0] == 0.0
    assert operations.psi(same, same, "v").first()[0] == 0.0


def test_noise_decision_gate(spark):
    def decide(values, least):
        subtype, confidence = signal.decide(
            F.array(*[F.lit(v) for v in values]), ["AA", "BB", "CLEAN"], least
        )
        return one(spark, subtype, confidence)

    assert decide([5.0, 0.0, 0.0], 0.6)[0] == "AA"
    assert decide([0.0, 0.0, 5.0], 0.6)[0] is None  # clean
    assert decide([0.1, 0.0, 0.0], 0.6)[0] is None  # not sure
    assert decide([5.0, 0.0, 0.0], 0.6)[1] == pytest.approx(
        math.exp(5) / (math.exp(5) + 2), rel=1e-6
    )


def test_language_clamp(spark):
    def clamp(odds, detected):
        entries = [F.lit(x) for pair in odds.items() for x in pair]
        column = F.create_map(*entries) if odds else F.lit(None).cast("map<string,double>")
        return one(spark, g.clamp_language(column, F.lit(detected)))[0]

    assert clamp({"es": 0.5, "en": 0.5}, "fr") == "es"
    assert clamp({"en": 0.3, "fr": 0.6}, "fr") == "en"
    assert clamp({"fr": 0.9}, "en") == "es"
    assert clamp({}, "en") == "en" and clamp({}, "fr") == "es"


def test_fixed_lists_are_consistent():
    assert set(fixed.CANONICAL_LEVELS) <= set(fixed.LEVEL_SNR_DB)
    assert set(fixed.BANK_SUBTYPES) <= set(fixed.SUBTYPES)
