"""Unicode forms against the Unicode database."""

import random
import unicodedata

from pyspark.sql import functions as F

from soundquay.functions.text import fold_diacritics, nfc, normalize

MARKS = [chr(c) for c in range(0x300, 0x370)] + [chr(c) for c in (0x323, 0x301, 0x9be, 0x9c7, 0x94d, 0x5b0, 0x64b, 0x3099, 0x309a)]


def texts():
    rng = random.Random(4)
    out = ["ẹ́", "ẹ́", "ẹ́", "Å", "क़", "각x", "각", "각ᆨ",
           "ＡＢ ｶﾞ", "한국", "ﬁn", "́a", "দো", "̈́", "ṩ", "ṩ",
           "à֮̀̕b", "", "plain", "Ụ̈̄", "ㄱ"]
    assigned = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for _ in range(1500):
        out.append("".join(rng.choice(assigned) for _ in range(rng.randint(1, 6))))
    for _ in range(1500):
        out.append("".join(rng.choice("aeiouscnAOéüΑиকか가가")
                           + "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 3))) for _ in range(3)))
    return [t for t in out if "" not in t]


def test_forms(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, t string")
    out = {r["i"]: r for r in df.select("i", nfc(F.col("t")).alias("c"), fold_diacritics(F.col("t")).alias("f")).collect()}

    def folded(t):
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    wrong = [(t, out[i]["c"], unicodedata.normalize("NFC", t)) for i, t in rows if out[i]["c"] != unicodedata.normalize("NFC", t)]
    assert not wrong, (len(wrong), [[list(map(ascii, x)) for x in w] for w in wrong[:5]])
    wrong = [(t, out[i]["f"], folded(t)) for i, t in rows if out[i]["f"] != folded(t)]
    assert not wrong, (len(wrong), [[list(map(ascii, x)) for x in w] for w in wrong[:5]])


def test_normal_form_of_marks_out_of_order(spark):
    df = spark.createDataFrame([("e\u0301\u0323a",)], "t string")
    assert df.select(normalize(F.col("t"), F.lit("en"))).first()[0] == "\u1eb9 a"
