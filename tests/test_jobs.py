"""Alignment, rate limit, numbering, stages, sources: checked against plain loops and round trips."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from soundquay.operators import feedback, mining, operations, order
from soundquay.sources import manifests, tables, telemetry, transcripts
from soundquay.sources.stage import stage_table


def plain_alignment(ref, hyp):
    """Full table; from the end a deletion first, then an insertion, then the diagonal."""
    rows, cols = len(ref) + 1, len(hyp) + 1
    d = [[0] * cols for _ in range(rows)]
    for i in range(rows):
        for j in range(cols):
            if i == 0 or j == 0:
                d[i][j] = i + j
            else:
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1,
                              d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    i, j, found = len(ref), len(hyp), []
    while i and j:
        if d[i][j] == d[i - 1][j] + 1:
            i -= 1
        elif d[i][j - 1] == d[i - 1][j - 1] - 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if ref[i] != hyp[j]:
                found.append((j, hyp[j], ref[i]))
    return found[::-1], d[-1][-1]


@pytest.mark.parametrize("band,longest", [(mining._BAND, 9), (1, 9), (1, 40), (2, 60)])
def test_alignment_against_full_table(monkeypatch, band, longest):
    """Also with bands that are too narrow at first."""
    monkeypatch.setattr(mining, "_BAND", band)
    rng = random.Random(11)
    for _ in range(400):
        ref = [rng.choice("abcd") for _ in range(rng.randint(1, longest))]
        hyp = [rng.choice("abcd") for _ in range(rng.randint(1, longest))]
        if longest > 9:  # a damaged copy: few edits over a long text
            hyp = [rng.choice("abcd") if rng.random() < 0.1 else w for w in ref if rng.random() > 0.1] or hyp
        head = 0
        while head < min(len(ref), len(hyp)) and ref[head] == hyp[head]:
            head += 1
        tail = 0
        while tail < min(len(ref), len(hyp)) - head and ref[-1 - tail] == hyp[-1 - tail]:
            tail += 1
        want, _ = plain_alignment(ref[head:len(ref) - tail], hyp[head:len(hyp) - tail])
        assert mining._substitutions(ref, hyp) == [(j + head, w, r) for j, w, r in want]


def test_alignment_of_long_texts():
    """A hundred thousand words with a few edits: the band keeps the work in proportion."""
    ref = [f"w{i % 997}" for i in range(100_000)]
    hyp = list(ref)
    hyp[500], hyp[90_000] = "x", "y"
    del hyp[40_000:40_005]
    assert mining._substitutions(ref, hyp) == [(500, "x", ref[500]), (89_995, "y", ref[90_000])]


def test_mining_takes_pairs_of_any_length(spark):
    rows = [(1, "en", "we saw a cat", "we saw the big cat"), (2, "en", "a dog", "a dog"), (3, "en", "", "gone"),
            (4, "en", "one more time please", "one time please"), (5, "en", "pay bee now", "pay me now"), (6, "en", None, "x")]
    df = spark.createDataFrame(rows, "utterance_id int, lang string, hyp string, ref string")
    got = sorted(tuple(r) for r in mining.substitutions(df).collect())
    assert got == [(1, "en", 2, "a", "the"), (5, "en", 1, "bee", "me")]


def test_mining_thresholds(spark):
    pairs = [(i, "es", "quiero un plazo grande", "quiero un plato grande") for i in range(6)]
    pairs += [(10 + i, "es", "la ropa", "la sopa") for i in range(4)]
    pairs += [(20 + i, "es", "mi mesa", "mi misa") for i in range(6)]
    pairs += [(30, "es", "un plazo", "un plazo")]
    df = spark.createDataFrame(pairs, "utterance_id int, lang string, hyp string, ref string")
    subs = mining.substitutions(df)
    menu = spark.createDataFrame([("es", "mesa")], "lang string, term string")
    mined = mining.candidates(subs, menu)
    rows = mined.collect()
    assert [(r["wrong"], r["right"], r["evidence"], r["precision"]) for r in rows] == [
        ("plazo", "plato", 6, 1.0)
    ]
    ctx = mining.contexts(subs, mined, df)
    assert ctx.count() == 5
    rule = mining.rule_rows(mined, mining.context_terms(ctx), "c9").first()
    assert rule["id"] == "mined-c9-000" and rule["context_any"] == ["quiero", "un", "grande"]


@pytest.mark.parametrize("limit,window", [(3, 60), (5, 30), (1, 60)])
def test_rate_limit_against_a_loop(spark, limit, window):
    rng = random.Random(limit)
    rows, now = [], 1_700_000_000.0
    for trace in range(1500):
        # bursts with pauses; one store has most of the traffic
        now += rng.choice([0.5, 1, 2, 20, 45, 300 if rng.random() < 0.1 else 3])
        store = "hot" if rng.random() < 0.7 else f"s{rng.randrange(3)}"
        rows.append((store, trace, now))
    df = spark.createDataFrame(rows, "store_id string, trace_id long, at double").select(
        "store_id", "trace_id", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts")
    )
    got = {r["trace_id"]: r["accepted"] for r in
           operations.rate_limit(df, window_s=window, limit=limit).collect()}
    held, want = {}, {}
    for store, trace, at in rows:
        q = held.setdefault(store, deque())
        while q and q[0] < at - window:
            q.popleft()
        want[trace] = len(q) < limit
        if want[trace]:
            q.append(at)
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_rate_limit_of_crowded_windows(spark, limit):
    """Many requests in a window, equal times, no time and no store; no request looks at all of its window."""
    rng = random.Random(limit)
    rows = [("hot", i, 1_700_000_000_000_000 + rng.randrange(400_000) * 1000) for i in range(30_000)]
    rows += [(None, 100_000 + i, 1_700_000_000_000_000 + i // 7 * 10_000_000) for i in range(300)]
    rows += [("edge", 200_000 + i, 1_700_000_040_000_000 + i * 20_000_000) for i in range(20)]
    lost = [("hot", 300_000, None), (None, 300_001, None)]
    df = spark.createDataFrame(rows + lost, "store_id string, trace_id long, at long").select(
        "store_id", "trace_id", F.timestamp_micros("at").alias("ts")
    )
    out = operations.rate_limit(df, window_s=60, limit=limit)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"RangeFrame, -?\d", plan)  # such a frame is counted anew for each row
    got = out.collect()
    held, want = {}, {300_000: True, 300_001: True}
    for store, trace, at in sorted(rows, key=lambda r: (r[2], r[1])):
        q = held.setdefault(store, deque())
        while q and q[0] < at - 60_000_000:
            q.popleft()
        want[trace] = len(q) < limit
        if want[trace]:
            q.append(at)
    assert {r["trace_id"]: r["accepted"] for r in got} == want and len(got) == len(rows) + 2
    stores = {trace: store for store, trace, _ in rows + lost}
    assert all(stores[r["trace_id"]] == r["store_id"] for r in got)


def test_numbering_is_independent_of_buckets(spark):
    rows = [(f"k{i % 3}", i * 7919 % 1000, float(i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int, w double")
    for buckets in (1, 4, 13):
        out = order.number_rows(df, ["v"], ["g"], "p", F.col("w"), "b", buckets=buckets).collect()
        by_group = {}
        for r in sorted(out, key=lambda r: (r["g"], r["v"])):
            place, total = by_group.get(r["g"], (0, 0.0))
            assert (r["p"], r["b"]) == (place, total)
            by_group[r["g"]] = (place + 1, total + r["w"])
    assert order.number_rows(df.limit(0), ["v"], ["g"]).count() == 0


def test_latest_by_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")],
                               "k int, seq int, v string")
    got = {r["k"]: r["v"] for r in order.latest_by_key(df, ["k"], ["seq"]).collect()}
    assert got == {1: "c", 2: "x"}


def test_stage_is_not_computed_twice(spark, tmp_path):
    stages = feedback.CycleStages(spark, str(tmp_path), "cycle-7")
    first = stages.run("harvest", lambda: spark.range(5)).count()

    def never():
        raise AssertionError("a finished step must be read back")

    assert stages.run("harvest", never).count() == first == 5
    other = feedback.CycleStages(spark, str(tmp_path), "cycle-8")
    assert other.run("harvest", lambda: spark.range(2)).count() == 2


def test_changed_inputs_rebuild_what_follows(spark, tmp_path):
    from soundquay.plans import loop_queries as loop

    rows = [(f"{d:09d}-{s:06d}", f"{d:09d}-{s:06d}", "en", "one two three", "one too three", d, s, [], -1.0, 0, None)
            for d in range(12) for s in range(6)]
    schema = ("utterance_id string, transcription_id string, lang string, ref string, hyp string, doc long, seg long, "
              "guard_flags array<string>, avg_logprob double, n_rules int, verdict string")
    tel = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), "AA")], "store_id string, ts timestamp, noise_pred string")
    menu = spark.createDataFrame([], "lang string, term string")

    def cycle(rows):
        stages = feedback.CycleStages(spark, str(tmp_path), "c")
        return loop._cycle(stages, spark.createDataFrame(rows, schema), tel, menu).first().asDict(), stages.built

    first, built = cycle(rows)
    assert len(built) == 11 and first["n_candidates"] == 1 and first["promote"] and first["n_harvested"] == 72
    again, built = cycle(rows[::-1])
    assert again == first and built == []
    changed = [(*r[:4], "one tu three", *r[5:]) if r[5] == 1 else r for r in rows]
    other, built = cycle(changed)
    assert built[:2] == ["transcribe", "harvest"] and "profile" not in built and "noise" not in built
    quiet = [(*r[:8], -0.1, *r[9:]) for r in rows]
    assert cycle(quiet)[0]["n_harvested"] == 1  # the control sample alone


def test_harvest_counts(spark):
    rows = [(i, f"utt-{i:03d}", -0.2, [], 0, None) for i in range(96)]
    rows += [(96, "utt-096", -0.9, [], 0, None), (97, "utt-097", -0.2, ["vad_dropped"], 0, None)]
    df = spark.createDataFrame(
        rows, "transcription_id int, utterance_id string, avg_logprob double, "
        "guard_flags array<string>, n_rules int, verdict string")
    out = feedback.harvest(df).collect()
    assert len(out) == 4 and sum(r["reasons"] == "control" for r in out) == 2
    assert feedback.harvest(df, cap=1).count() == 1
    assert [r["utterance_id"] for r in out] == [r["utterance_id"] for r in feedback.harvest(df).collect()]


def test_manifest_round_trip(spark, tmp_path):
    from soundquay import schemas

    rows = [("u1", "p", "es", "hola", 1.5, "a", None, None, None, None, None, float("nan"), None,
             None, None),
            ("u2", "q", "en", "hi", 2.0, "b", None, "u1", "AA", "05", "n1", 10.0, float("inf"), 7,
             ["hi"])]
    manifests.write_manifest(spark.createDataFrame(rows, schemas.MANIFEST), str(tmp_path / "m"))
    back = {r["utterance_id"]: r for r in manifests.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert back["u1"]["keywords"] == [] and back["u1"]["snr_db_target"] is None
    assert back["u2"]["snr_db_achieved"] == float("inf")
    info = manifests.summary(manifests.read_manifest(spark, str(tmp_path / "m"))).first()
    assert (info["row_count"], info["langs"], info["n_clean"]) == (2, ["en", "es"], 1)


def test_noise_bank_split_prunes_files(spark, tmp_path):
    from soundquay import schemas

    rows = [(f"c{i}", "AA", "p", 4.0, "s", "CC", "eval" if i % 3 == 0 else "train", f"r{i}")
            for i in range(9)]
    path = str(tmp_path / "bank")
    manifests.write_noise_bank(spark.createDataFrame(rows, schemas.NOISE_BANK), path)
    held = manifests.read_noise_bank(spark, path, "eval")
    assert held.count() == 3
    assert "PartitionFilters: [isnotnull(split" in held._jdf.queryExecution().toString()


def test_telemetry_skips_broken_lines_and_text(spark, tmp_path):
    path = tmp_path / "t" / "day=2024-01-01"
    path.mkdir(parents=True)
    (path / "a.json").write_text(
        '{"ts":"2024-01-01T00:00:00.000Z","trace_id":"1","latency_ms":{"total":5.0}}\n'
        '{"ts":"2024-01-01T00:00:01.000Z","trace_id":"2","latency_ms":{}}\n'
        '{broken\n')
    assert [r["trace_id"] for r in telemetry.read_telemetry(spark, str(tmp_path / "t")).collect()] == ["1"]
    rows = spark.createDataFrame([("1", "secret")], "trace_id string, text string")
    assert operations.telemetry_lines(rows).columns == ["trace_id"]


def test_transcript_files(spark, tmp_path):
    (tmp_path / "line_index.tsv").write_text("a\t\thola\nb\t \nc\tx\tque tal\n")
    (tmp_path / "x.trans.txt").write_text("u1 hello there\nu2\n")
    (tmp_path / "a.wav").write_bytes(b"0")
    (tmp_path / "z.wav").write_bytes(b"0")
    tab = transcripts.read_tab_index(spark, str(tmp_path / "line_index.tsv"))
    assert {(r[0], r[1]) for r in tab.collect()} == {("a", "hola"), ("c", "que tal")}
    word = transcripts.read_word_index(spark, str(tmp_path / "x.trans.txt"))
    assert [(r[0], r[1]) for r in word.collect()] == [("u1", "hello there")]
    files = transcripts.list_audio(spark, str(tmp_path))
    joined = transcripts.join_transcripts(files, tab)
    assert [r["file_id"] for r in joined.collect()] == ["a"]


def test_upsert_and_append(spark):
    current = spark.createDataFrame([(1, "old"), (2, "keep")], "id long, v string")
    changes = spark.createDataFrame([(1, "new", 2), (1, "mid", 1), (3, "add", 1)],
                                    "id long, v string, seq int")
    got = {r["id"]: r["v"] for r in tables.upsert(current, changes, ["id"], "seq").collect()}
    assert got == {1: "new", 2: "keep", 3: "add"}
    rows = spark.createDataFrame([("b",), ("a",)], "v string")
    got = {r["v"]: r["id"] for r in tables.append_with_ids(current, rows, ["v"]).collect()}
    assert got["a"] == 3 and got["b"] == 4


def test_staged_table_keeps_rows(spark):
    assert stage_table(spark.range(7).withColumn("x", F.lit("a")), "t").count() == 7
