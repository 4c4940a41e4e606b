"""Sharding, personal data and packing against plain versions."""

import hashlib
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundquay.llm import packing, pii, sharding
from soundquay.llm.queries import QUERIES
from soundquay.llm.slots import gapless

from .corpora import DOCS, awkward, personal


def clashing(df):
    for name in ("slot", "order", "cell", "shard", "region", "bucket", "pii_email", "text_crc32", "_cell"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_shards(spark):
    docs = clashing(spark.createDataFrame(awkward(), DOCS))
    out = sharding.shard_documents(docs).collect()
    assert len(out) == docs.count()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, crc32((r[1] or "").encode())) for r in awkward())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    by_id = {}
    for r in out:
        assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_shards_follow_weights_and_move_little(spark):
    keys = spark.range(20_000)
    tree = sharding.Tree((((1.0, 2.0), (1.0,)), ((4.0,),)))
    now = sharding.assign(keys, F.col("id"), tree)
    share = {r["shard"]: r["count"] / 20_000 for r in now.groupBy("shard").count().collect()}
    assert all(abs(share[i] - w / 8) < 0.02 for i, w in enumerate((1, 2, 1, 4)))
    heavier = sharding.Tree((((1.0, 4.0), (1.0,)), ((4.0,),)))
    both = sharding.assign(now, F.col("id"), heavier, "new_")
    moved = both.filter("shard <> new_shard")
    # rows move only into what grew, or between the subtrees that hold it
    assert moved.filter("region = 1 and new_region = 1").count() == 0
    assert moved.filter("region = 0 and new_region = 1").count() == 0
    assert moved.filter("rack = 1 and region = 0 and new_shard = 2").count() == 0
    grown = tree
    for n in range(4, 7):
        grown_next = grown.grown()
        pair = sharding.assign(sharding.assign(keys, F.col("id"), grown), F.col("id"), grown_next, "new_")
        assert pair.filter(f"shard <> new_shard and new_shard <> {n}").count() == 0
        grown = grown_next


def test_gapless_slots_over_deep_cells(spark, monkeypatch):
    monkeypatch.setattr("soundquay.llm.slots.ROWS_PER_CELL", 1)
    df = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("g"))
    out = gapless(df, ["g"], "h").collect()
    for g in range(3):
        rows = sorted((r["h"], r["slot"]) for r in out if r["g"] == g)
        assert [s for _, s in rows] == list(range(1000))


TEXTS = [
    "mail a.b@c.de, x@y, z@w.org%q@r.s.t and ip 1.2.3.4 or 300.1.1.1 1.2.3.4.5.6.7.8 end",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (234) 567-8901, +12 345 and ++44 20 7946 0958 ",
    "é ü 𝄞 a@b.cd 0.0.0.0 000000001.2.3.255 5500005555555559 phone +49 (30) 1234 5678-9..",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 not GB82 WEST 1234 5698 7654 33",
    "9" * 30_000, "1 " * 20_000, "a" * 50_000 + "@", "@.@.@a.b", "", None, "+" * 1000, "1.1.1.1" * 300,
]


def test_personal_data(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        want = personal(t)
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in out[i]["spans"].split(",") if s and not s.startswith("iban")] == want
        assert out[i]["n_email"] == sum(s.startswith("email") for s in want)
    assert out[3]["n_iban"] == 2
    assert pii.report(docs.limit(0)).count() == 0


def test_account_numbers_before_capitals_and_digits(spark):
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    texts = [f"{de} Please pay", f"{gb} BIC DEUTDEFF", f"{gb} 12 EUR", f"{de} {gb} {de}", f"{gb}X", f"{de}5 NOW",
             f"AB12 {de} A", f"é {gb}\nTHEN"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["i"]: [texts[r["i"]][s["start"]:s["stop"]] for s in r["pii_iban"]] for r in pii.find(docs).collect()}
    assert got == {0: [de], 1: [gb], 2: [gb], 3: [de, gb, de], 4: [], 5: [], 6: [de], 7: [gb]}
    clean = {r["i"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "<iban> Please pay" and clean[1] == "<iban> BIC DEUTDEFF"


def test_context_raises_scores(spark):
    docs = spark.createDataFrame([(1, "server 1.2.3.4"), (2, "xx 1.2.3.4")], "doc_id long, text string")
    got = {r["doc_id"]: r["pii_ip"][0]["score"] for r in pii.find(docs).collect()}
    assert got[1] > got[2]


def test_redaction(spark):
    docs = spark.createDataFrame(
        [(1, "é a@b.cd, 1.2.3.4!"), (2, None), (3, "plain"), (4, "1.2.3.4@x.yz")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "é <email>, <ip>!", 2: None, 3: "plain", 4: "<email>"}


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 6))
        lengths, counts = np.sort(rng.choice(40, n, replace=False) + 1), rng.integers(1, 20, n)

        def cost(edges, lengths=lengths, counts=counts):
            return sum(c * min(e for e in edges if e >= x) for x, c in zip(lengths, counts))

        best = min(cost((*e, lengths[-1])) for r in range(min(k, n)) for e in combinations(lengths[:-1], r))
        got = packing.bounds(lengths, counts, k)
        assert cost(got) == best and len(got) <= k


def test_least_costs_against_all_cuts():
    rng = np.random.default_rng(2)
    lengths, counts = np.sort(rng.choice(5000, 300, replace=False) + 1), rng.integers(1, 9, 300)
    rows = np.concatenate([[0], np.cumsum(counts)])
    best = lengths * rows[1:]
    cost, at = packing._least_costs(best, lengths, rows, 1)
    for j in range(1, 300):
        tried = best[:j] + lengths[j] * (rows[j + 1] - rows[1 : j + 1])
        assert cost[j] == tried.min() and at[j] == int(np.argmin(tried))


def test_packing_of_long_texts_pads_no_more_than_needed(spark):
    lengths = [300, 1170, 1170, 1171, 1173, 5001]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    out = {r["doc_id"]: (r["padded_tokens"], r["batch_rows"]) for r in packing.pack(docs).collect()}
    assert out == {i: (n, 8192 // n if n <= 8192 else 1) for i, n in enumerate(lengths)}
    two = {r["n_tokens"]: r["padded_tokens"] for r in packing.pack(docs, n_buckets=2).collect()}
    assert two == {300: 1173, 1170: 1173, 1171: 1173, 1173: 1173, 5001: 5001}


@pytest.mark.parametrize("budget", [1, 64, 8192])
def test_packing(spark, budget):
    docs = clashing(spark.createDataFrame(awkward(), DOCS))
    out = packing.pack(docs, n_buckets=4, budget=budget).collect()
    assert Counter(r["n_tokens"] for r in out) == Counter(len((r[1] or "").split()) for r in awkward())
    batches = {}
    for r in out:
        assert r["padded_tokens"] >= r["n_tokens"] and r["bucket"] < 4
        assert r["batch_rows"] == max(1, budget // r["padded_tokens"])
        batches.setdefault((r["bucket"], r["batch"]), []).append((r["place"], r["batch_rows"]))
    for (bucket, batch), rows in batches.items():
        last = (bucket, batch + 1) not in batches
        assert sorted(p for p, _ in rows) == list(range(len(rows)))
        assert len(rows) == rows[0][1] or last and len(rows) < rows[0][1]
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_query(spark, sf_dir):
    out = QUERIES["op10_packing"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert len(out) == len(docs) and out["bucket"].nunique() <= 16
    tokens = dict(zip(docs.doc_id, docs.text.str.split().str.len()))
    assert all(tokens[d] == n for d, n in zip(out.doc_id, out.n_tokens))
