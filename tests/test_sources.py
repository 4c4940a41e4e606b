"""Sources through files, the report sink, the interval sweep and long edit distances."""

import random
import time

import pytest
from pyspark.sql import functions as F

from soundquay.functions.distance import char_edits, word_edits
from soundquay.operators import intervals, order
from soundquay.plans import load_catalogue
from soundquay.sources import manifests, tables, transcripts


def test_bank_reads_one_split(spark, sf_dir, tmp_path):
    bank = load_catalogue()["noise_bank_eval_split"].build(spark, sf_dir)
    plan = bank._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "DataFilters: []" in plan
    rows = [(f"c{i}", "AA" if i % 2 else "BB", "p", 1.0, "s", "l", "eval" if i % 3 else "train", "r") for i in range(12)]
    df = spark.createDataFrame(rows, "clip_id string, subtype string, path string, duration_s double, source string, "
                                     "license string, split string, recording_id string")
    manifests.write_noise_bank(df, f"{tmp_path}/bank")
    one = manifests.read_noise_bank(spark, f"{tmp_path}/bank", "eval")
    files = {r[0].split("/bank/")[1].rsplit("/", 1)[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert files == {"split=eval/subtype=AA", "split=eval/subtype=BB"}
    assert one.count() == 8 and manifests.read_noise_bank(spark, f"{tmp_path}/bank").count() == 12


def test_report_round_trip(spark, tmp_path):
    rates = spark.createDataFrame([("es", 0.25, None, 3), ("en", 0.5, 0.125, 4)], "lang string, wer double, cer double, n_utts long")
    tables.write_report(rates, f"{tmp_path}/r", "run-1", "0.1", "d", 7)
    tables.write_report(rates.limit(0), f"{tmp_path}/r", "run-2", "0.1", "d", 7)
    got = {r["run_id"]: r for r in tables.read_reports(spark, f"{tmp_path}/r").collect()}
    assert got["run-1"]["seed"] == 7 and got["run-1"]["metrics"]["en"]["cer"] == 0.125
    assert got["run-1"]["metrics"]["es"]["cer"] is None and got["run-1"]["metrics"]["es"]["n_utts"] == 3
    assert got["run-2"]["metrics"] == {}


def test_audio_files_are_listed_without_content(spark, tmp_path):
    for name in ("a/x-1.wav", "a/x-2.flac", "b/x-3.wav", "b/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"RIFF" * 10)
    (tmp_path / "a/x.trans.txt").write_text("x-1 ONE TWO\nx-3 THREE\nbroken\n")
    files = transcripts.list_audio(spark, str(tmp_path))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    index = transcripts.read_word_index(spark, str(tmp_path / "a/x.trans.txt"))
    got = transcripts.join_transcripts(files, index).select("file_id", "text", "length").collect()
    assert sorted(map(tuple, got)) == [("x-1", "ONE TWO", 40), ("x-3", "THREE", 40)]


def test_sweep_against_all_pairs(spark):
    rng = random.Random(2)
    segs, spans = [], [("d0", 0.0, 40_000.0)]  # one interval of hours
    for i in range(300):
        start = rng.randint(0, 400) / 2
        segs.append((f"d{i % 4}", i, start, start + rng.randint(0, 6) / 2))
    for _ in range(60):
        start = rng.randint(0, 400) / 2
        spans.append((f"d{rng.randint(1, 2)}", start, start + rng.randint(0, 9) / 2))
    segs.append(("d1", 999, None, None))
    a = spark.createDataFrame(segs, "doc string, no int, start double, end double")
    b = spark.createDataFrame(spans, "doc string, start double, end double")
    got = sorted(r["no"] for r in intervals.outside(a, b, "doc").collect())
    want = [no for doc, no, s, e in segs if s is None or not any(d == doc and vs < e and ve > s for d, vs, ve in spans)]
    assert got == sorted(want) and 999 in got
    assert intervals.outside(a, b.limit(0), "doc").count() == len(segs)


def test_running_max(spark):
    rows = [(g, i, (i * 37) % 50) for g in ("a", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    for r in order.running_max(df, ["i"], ["g"], "v").collect():
        assert r["so_far"] == max([(j * 37) % 50 for j in range(r["i"])], default=None)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_in_growing_bands(spark):
    rng = random.Random(8)
    pairs = []
    for n in (0, 1, 5, 40, 300):
        for share in (0.02, 0.3, 1.0):
            a = [rng.choice("abcdefgh") for _ in range(n)]
            b = [rng.choice("abcdefgh") if rng.random() < share else c for c in a if rng.random() > share / 3]
            pairs.append((a, b + [rng.choice("xyz")] * rng.randint(0, 2)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    out = df.select("i", word_edits(F.col("a"), F.col("b")).alias("w"),
                    char_edits(F.array_join("a", ""), F.array_join("b", "")).alias("c")).collect()
    for r in out:
        assert r["w"] == r["c"] == plain_distance(*pairs[r["i"]]), r


def test_long_texts_with_few_edits_are_quick(spark):
    text = "".join(random.Random(1).choices("abcdefghij ", k=20_000))
    other = "x" + text[3:9000] + "yy" + text[9001:15_000] + text[15_004:]
    df = spark.createDataFrame([(text, other)] * 50, "a string, b string")
    start = time.time()
    assert df.agg(F.max(char_edits(F.col("a"), F.col("b")))).first()[0] == 3 + 2 + 4
    assert time.time() - start < 30


@pytest.mark.parametrize("name", ["manifest_read", "transcript_index_tabs", "audio_with_transcripts"])
def test_queries_read_files(spark, sf_dir, name):
    plan = load_catalogue()[name].build(spark, sf_dir)._jdf.queryExecution().toString()
    assert "/manifest-" in plan or "/index-" in plan
