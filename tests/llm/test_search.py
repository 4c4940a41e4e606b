"""WARC archives, exact search, near copies, repeats and decontamination against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundquay.llm import decontaminate, simhash, suffix, topk, warc
from soundquay.llm.components import components
from soundquay.llm.queries import QUERIES
from soundquay.llm.tables import Staged

from .corpora import DOCS, awkward, fingerprint, linked, sentence, unique_ids, without_repeats


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


PAGES = [(5, "u5", "a" * 200), (3, "u3", "a" * 200), (9, "u\r\n9", "a" * 200), (1, None, None), (2, "", ""),
         (4, "u4", "short"), (6, "u6", "short"), (7, "u7", "é" * 60), (8, "u8", "é" * 60), (3, "u3", "a" * 200),
         (None, "n", "a" * 200), (11, "w", "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n" * 30)]


def _archive_wanted(rows):
    firsts = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            firsts[data] = min(firsts.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = firsts.get(data)
        again = first is not None and (page is None or page > first)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(),
                    "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archive(spark):
    pages = clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"), "payload", "same", "first")
    out = warc.archive_report(pages)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in out.collect()), key=str) == _archive_wanted(PAGES)
    assert warc.archive_report(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip_and_pushdown(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(warc, "_SPLIT_BYTES", 300)
    path = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write(warc.page_records(pages), path, compression)
    back = warc.read(spark, path)
    want = {(r["record_id"], r["payload_digest"], r["payload"] and bytes(r["payload"]))
            for r in warc.page_records(pages).collect() if r["record_type"] == "response"}
    got = back.filter("record_type = 'response'")
    assert {(r["record_id"], r["payload_digest"], bytes(r["payload"]) or b"") for r in got.collect()} == {
        (a, b, c or b"") for a, b, c in want}
    one = back.filter(F.col("target_uri").startswith("u7")).collect()
    assert [bytes(r["payload"]).decode() for r in one] == ["é" * 60]
    assert all(r["payload"] is None for r in warc.read(spark, path, payload=False).collect())


def test_reader_takes_pushed_filters():
    reader = warc.WarcReader({"path": "x"})
    kept = list(reader.pushFilters([
        warc.EqualTo(("record_type",), "revisit"), warc.In(("record_id",), ("a",)),
        warc.StringStartsWith(("target_uri",), "http"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(kept) == 1 and len(reader.wanted) == 3
    assert reader._wants({"record_type": "revisit", "record_id": "a", "target_uri": "http://x"})
    assert not reader._wants({"record_type": "response", "record_id": "a", "target_uri": "http://x"})


def test_archive_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = sorted((tuple(r[c] for c in cols) for r in QUERIES["op1_warc"](spark, sf_dir).collect()), key=str)
    assert got == _archive_wanted(rows)


def _best(ids, vectors, every, k):
    out = []
    for i, q in zip(ids, vectors):
        if i % every == 0:
            scores = sorted(((-int(np.dot(q.astype(object), v.astype(object))), j) for j, v in zip(ids, vectors) if j != i))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("hot", [0, 150])
def test_search(spark, monkeypatch, hot):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).round(2).tolist() for _ in range(300)] + [[0.5] * 8] * hot
    rows = list(enumerate(vectors))
    bad = [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8)]
    df = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), "v", "far", "block", "rank")
    got = sorted(tuple(r) for r in topk.report(df, every=20, k=5).select("query_id", "rank", "vec_id", "score").collect())
    whole = [np.floor(64 * np.array(v)).astype(np.int64) for v in vectors]
    assert got == _best([i for i, _ in rows], whole, 20, 5)


def test_search_of_few_and_huge_vectors(spark):
    rows = [(0, [1e14, -3e14]), (1, [2e14, 5e13]), (2, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.report(df.withColumn("embedding", F.transform("embedding", lambda x: x / 1e7)), k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2)]
    assert topk.report(df.limit(0)).count() == 0


def test_search_deals_narrow_vectors_without_their_distances(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    found = topk.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=5)
    plan = found._jdf.queryExecution().executedPlan()
    search = next(line for line in plan.toString().splitlines() if "FlatMapCoGroups" in line)
    assert "far" not in search and "block" in search
    dealt = [line for line in plan.toString().splitlines() if "Exchange hashpartitioning(block" in line]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in line for line in dealt)
    scans = [line for line in plan.toString().splitlines() if "FileScan" in line]
    assert scans and not any("far:" in line or "v:array<bigint>" in line for line in scans)


@pytest.mark.parametrize("size", [30, 2**15, 2**31])
def test_search_in_every_integer_type(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 3)
    rng = np.random.default_rng(size % 97)
    high = min(size, 2**30) + 1
    vectors = [*rng.integers(-high, high, (90, 4)), np.array([size, -size, 0, 1]), np.array([-size, size, 1, 0])]
    rows = [(i, [int(c) for c in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.largest_products(df, df.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id"), 6)
    ids = [i for i, _ in rows]
    assert sorted(tuple(r) for r in got.collect()) == _best(ids, [np.array(v) for _, v in rows], 3, 6)


def test_copies_of_a_vector_give_one_pivot(spark, monkeypatch):
    seen, space = [], topk.Space
    monkeypatch.setattr(topk, "Space", lambda pivots, reach: seen.append(pivots) or space(pivots, reach))
    rows = [(i, [i // 40, 7 - i // 40]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.largest_products(df, df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 4, pivots=8)
    assert sorted(tuple(r) for r in got.collect()) == _best(range(400), [np.array(v) for _, v in rows], 50, 4)
    assert len(np.unique(seen[0], axis=0)) == 8


@pytest.mark.parametrize("kind", [np.float32, np.float64, object])
def test_best_scores_of_a_piece(kind):
    rng = np.random.default_rng(11)
    ids = np.sort(rng.integers(0, 40, 60))
    who = np.arange(30, 50)
    scores = rng.integers(-3, 4, (20, 60))
    floors = np.where(who % 2, topk._NONE, rng.integers(-3, 4, 20))
    i, j, values = topk._best(scores.astype(kind), who, ids, floors, 5)
    got = [(a, ids[b], int(v)) for a, b, v in zip(i, j, values)]
    want = []
    for a in range(20):
        fit = sorted((-scores[a, b], ids[b]) for b in range(60) if scores[a, b] >= floors[a] and ids[b] != who[a])
        want += [(a, b, -s) for s, b in fit[:5]]
    assert sorted(got) == sorted(want)


def test_piece_leaves_out_rows_ruled_out_by_their_bounds(monkeypatch):
    import pyarrow as pa

    x = np.array([[60, 0], [59, 3], [-60, 2], [-59, -4]])
    space = topk.Space(x, float((x**2).sum(axis=1).max()))
    rows = pa.table({"vec_id": [1, 2, 3, 4], "v": x.tolist()})
    queries = pa.table({"query_id": [7, 8], "v": [[60, 0], [58, 1]], "floor": pa.array([3000, 3000], pa.int64())})
    scored, best = [], topk._best
    monkeypatch.setattr(topk, "_best", lambda scores, who, ids, floors, k: scored.extend(ids) or best(scores, who, ids, floors, k))
    found = topk._search(space, 2)(queries, rows).to_pylist()
    assert scored == [1, 2]
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in found) == [
        (7, 1, 3600), (7, 2, 3540), (8, 1, 3480), (8, 2, 3425)]


def test_fingerprints_and_groups(spark):
    rows = unique_ids()
    docs = clashing(spark.createDataFrame(rows, DOCS), "fp", "seed", "root", "least")
    got = {r["doc_id"]: r for r in simhash.report(docs).collect()}
    prints = [fingerprint(r[1]) for r in rows]
    roots = linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    for i, r in enumerate(rows):
        assert got[r[0]]["fingerprint"] == f"{prints[i]:016x}"
        assert got[r[0]]["component_id"] == min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[i])
    odd = spark.createDataFrame(awkward(), DOCS)
    assert simhash.report(odd).count() == odd.count()
    assert simhash.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "hot"), [(2, 128), (2, 1), (3, 2), (5, 128)])
def test_links_against_all_pairs(spark, bits, hot):
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
              for c in centres for _ in range(30)}
    prints = sorted(prints)
    work = Staged(spark, "test")
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = work.keep(spark.createDataFrame([(0, p) for p in signed], "seed int, fp long"), "prints")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, bits, work, hot), work).collect()}
    roots = linked(prints, lambda a, b: (a ^ b).bit_count() <= bits)
    least = {}
    for p, r in zip(signed, roots):
        least[r] = min(least.get(r, p), p)
    assert all(got.get(p, p) == least[r] for p, r in zip(signed, roots))


def test_long_chains_are_one_component(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000)]
    work = Staged(spark, "chain")
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long"), work).collect()}
    assert set(got.values()) == {0, 2000} and len(got) == 303
    assert components(spark.createDataFrame([], "a long, b long"), work).count() == 0


def test_one_of_each_group_stays(spark):
    rows = awkward()
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(0) == 1 and 10 not in ids and 20 not in ids
    assert ids.count(70) == 1 and ids.count(80) == 1 and None in ids  # "alone here" has no id
    assert simhash.keep_one(spark.createDataFrame(rows, DOCS).limit(0)).count() == 0


def kept_ids(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    return sorted(r["doc_id"] for r in simhash.keep_one(df).collect())


def test_a_repeated_line_makes_no_copies(spark):
    line = " ".join(f"line{i}" for i in range(35))
    texts = [" ".join([line] * 40 + [f"t{k}x{i}" for i in range(104)]) for k in range(6)]
    hashes = [simhash.shingle_hashes(t, 5) for t in texts[:2]]
    assert simhash.majority(hashes[0]) == simhash.majority(hashes[1])
    assert kept_ids(spark, texts + [texts[0]]) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("small", [32, 1])
def test_near_copies_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_CELL", small, raising=False)
    rng = np.random.default_rng(4)
    texts = []
    for base in range(4):
        words = sentence(base, 90).split()
        for i in range(12):  # up to four changed words: similarities around the limit
            mine = list(words)
            for j in rng.choice(len(mine), rng.integers(1, 5), replace=False):
                mine[j] = f"e{base}x{i}x{j}"
            texts.append(" ".join(mine))
    texts += ["", "one", "a b c d e f", "a b c d e g"]
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    groups = linked(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    least = {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    assert kept_ids(spark, texts) == sorted(least.values())


def plain_least(texts):
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    holders = {}
    for i, x in enumerate(sets):
        for h in x or {None}:
            holders.setdefault(h, []).append(i)
    near = {(i, j) for own in holders.values() for i in own for j in own if i < j
            and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    groups = linked(list(range(len(texts))), lambda a, b: (min(a, b), max(a, b)) in near)
    least = {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    return sorted(least.values())


@pytest.mark.parametrize("small,sample", [(2, 3), (8, 3), (8, 10**9)])
def test_near_copies_with_a_line_in_every_text(spark, monkeypatch, small, sample):
    """Texts that are mostly one line, with and without near copies; also with a useless order of shingles."""
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    monkeypatch.setattr(simhash, "COMMON", sample)
    rng = np.random.default_rng(6)
    line = sentence(50, 60)
    texts = []
    for i in range(60):
        own = sentence(100 + i // 2, int(rng.integers(2, 40))).split()
        if i % 2:
            own[int(rng.integers(len(own)))] = f"e{i}"
        texts.append(f"{' '.join(own)} {line}")
    texts += [line, f"x {line}", f"{line} y", " ".join(line.split()[:50])]
    assert kept_ids(spark, texts) == plain_least(texts)


def test_near_copies_of_the_whole_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_CELL", 4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in docs]
    assert kept_ids(spark, texts) == plain_least(texts)


def test_long_near_copies_are_decided_on_whole_sets(spark):
    texts, want = [], []
    for k in range(12):  # 596 shingles each; 530 / 662 is above 0.8, 529 / 663 below it
        for changed in (66, 67):
            words = [f"p{k}c{changed}w{i}" for i in range(600)]
            texts += [" ".join(words), " ".join(words[:-changed] + [f"new{i}" for i in range(changed)])]
            want += [len(texts) - 2] if changed == 66 else [len(texts) - 2, len(texts) - 1]
    assert kept_ids(spark, texts) == want


def test_repeats(spark):
    rows = [(r[0], r[1]) for r in unique_ids()]
    rows += [(500, "ab" * 300), (501, "ab" * 80 + "c"), (-3, rows[0][1][20:260]), (502, rows[0][1][:99])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "doc", "first", "last", "anchor", "cell")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.report(docs).collect()}
    assert got == without_repeats(rows)
    odd = spark.createDataFrame(awkward(), DOCS)
    out = suffix.report(odd)
    assert out.count() == odd.count()
    assert suffix.report(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [3, 1000])
def test_repeats_of_edited_copies(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    rng = np.random.default_rng(9)
    base = sentence(11, 300)
    rows = []
    for i in range(25):
        words = base.split()
        for j in rng.choice(len(words), 12, replace=False):
            words[j] = f"e{i}x{j}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == without_repeats(rows)


def _smith_waterman(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = 2 if a[i - 1] == b[j - 1] else -1
            table[i, j] = max(0, table[i - 1, j - 1] + step, table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(30):
        item, passages = rng.integers(0, 5, 7), rng.integers(0, 5, (4, 12))
        score, _ = decontaminate.align(item, passages)
        assert score.tolist() == [_smith_waterman(item.tolist(), p.tolist()) for p in passages]


def test_leaks_are_found(spark):
    item = sentence(21, 40)
    words = item.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 9 != 4)
    rows = [(1, sentence(31, 80) + " " + item + " " + sentence(32, 80)), (2, sentence(33, 80) + " " + edited),
            (3, sentence(34, 200)), (4, None), (5, ""), (6, "tiny item"), (None, item), (7, item.upper())]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "item", "hash", "passage", "seeds")
    items = spark.createDataFrame([(100, item), (101, "tiny item"), (102, None), (103, ""), (100, item)],
                                  "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, items).collect()}
    assert {(1, 100), (2, 100), (None, 100), (7, 100), (6, 101)} <= set(out)
    assert out[(1, 100)] == 1.0 and not any(d in (3, 4, 5) for d, _ in out)
    kept = {r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()}
    assert kept == {3, 4, 5}
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_leak_query(spark, sf_dir):
    """Every document that holds a test item word for word is reported with it."""
    docs = {r["doc_id"]: " ".join(decontaminate._WORD.findall(r["text"].lower()))
            for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: " ".join(decontaminate._WORD.findall(r["text"].lower()))
             for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, sf_dir).collect()}
    whole = {(d, i) for d, t in docs.items() for i, u in items.items() if u and f" {u} " in f" {t} "}
    assert whole <= got


def test_query_results(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_suffix"](spark, sf_dir).collect()}
    assert got == without_repeats(docs)
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    whole = [np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) for v in embeddings.embedding]
    found = QUERIES["op2_topk"](spark, sf_dir).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in found.collect()) == _best(embeddings.vec_id.tolist(), whole, 20, 20)


def test_clean_rows_with_the_id_of_a_leak_stay(spark):
    leak, clean = sentence(40, 40), [sentence(41 + i, 40).upper()[::-1] for i in range(3)]
    rows = [(None, leak), (None, clean[0]), (7, leak), (7, clean[1]), (8, clean[2]), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.keep_clean(docs, items).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != leak], key=str)
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == {None, 7}
