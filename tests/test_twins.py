"""Queries against their SQL twins on small awkward tables."""

import duckdb

from soundquay.plans import load_catalogue


def test_sound_of_words_of_sharp_s(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "ßü ßieö ß, straße 123 йод", "en", "s", 20), (2, "ß", "es", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    item = load_catalogue()["english_sound_keys"]
    got = sorted((r["word"], r["sound"]) for r in item.build(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(item.sql).fetchall())
    assert ("ß", "SS") in got and ("ßieö", "SSIEO") in got
