"""Repeated passages against a plain version."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from soundquay.llm import hot, passages
from soundquay.llm.passages import Automaton

from .corpora import DOCS, awkward, sentence


def plain(rows, length=passages.LENGTH):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[p:p + length]) for w in words for p in range(len(w) - length + 1))
    out = []
    for row, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p:p + length])] > 1:
                gone[p:p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((row[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def surrounded():
    """One line of 20 words and one passage of 45 in many surroundings, an exact copy, a repeat inside a text."""
    line, passage = sentence(90, 20), sentence(91, 45)
    rows = [(i, f"{sentence(100 + i, 40)} {line} {sentence(300 + i, 30)}\t{passage} {sentence(500 + i, 20)}", "en", "s", 1)
            for i in range(40)]
    twice = sentence(700, 50)
    return [*rows, (1000, rows[0][1], "en", "s", 1), (1001, f"{twice} {twice}", "en", "s", 1), (1002, "a " * 36, "en", "s", 1),
            (1003, "b " * 35, "en", "s", 1)]


@pytest.mark.parametrize("crowded", [passages.CROWDED, 3])
@pytest.mark.parametrize("words", [passages.SHARD_WORDS, 100])
def test_report(spark, monkeypatch, crowded, words):
    """Also with anchors that count as crowded, many small shards and keys that are broadcast."""
    monkeypatch.setattr(passages, "CROWDED", crowded)
    monkeypatch.setattr(passages, "SHARD_WORDS", words)
    monkeypatch.setattr(hot, "FEW", 2 if crowded == 3 else hot.FEW)
    rows = awkward() + surrounded()
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("doc", "anchor", "same", "n", "first", "spans", "runs", "shard"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted([tuple(r) for r in passages.report(docs).collect()], key=str) == plain(rows)


def test_unique_ids_and_empty_tables(spark):
    rows = surrounded()
    got = passages.report(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows)
    assert passages.report(spark.createDataFrame([], DOCS)).count() == 0
    short = [(1, None, None, None, None), (2, "one two", "en", "s", 1)]
    assert sorted([tuple(r) for r in passages.report(spark.createDataFrame(short, DOCS)).collect()], key=str) == plain(short)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted([tuple(r) for r in passages.report(docs).collect()], key=str) == plain(rows)


def test_chunks_of_a_long_text(monkeypatch):
    """Windows, and for equal windows the anchors, do not depend on where a text is cut into chunks."""
    words = passages.words_of(sentence(8, 300) + " " + sentence(9, 300) + " " + sentence(8, 300))

    def by_window():
        out = {}
        for first, last, anchor, _ in passages.stretches(words):
            for f, e, a in zip(first, last, anchor, strict=True):
                out.update({p: a for p in range(f, e + 1)})
        return out

    whole = by_window()
    monkeypatch.setattr(passages, "_CHUNK", 64)
    assert by_window() == whole
    assert sorted(whole) == list(range(len(words) - passages.LENGTH + 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), st.integers(1, 3)),
                min_size=1, max_size=5))
def test_matching_statistics(texts):
    """Against all substrings with two places or more."""
    places = Counter()
    for words, n in texts:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                places[tuple(words[i:j])] += n
    automaton = Automaton.of(texts)
    for words, _ in texts:
        want = [max([k for k in range(1, i + 1) if places[tuple(words[i - k:i])] > 1], default=0)
                for i in range(1, len(words) + 1)]
        assert automaton.matching(words) == want
    assert automaton.matching([b"z"]) == [0]


def near_copies():
    """Copies of one text with a changed word each, some of them twice, and a line in many surroundings."""
    base, line = sentence(40, 120).split(" "), sentence(41, 12)
    rows = []
    for i in range(160):
        words = list(base)
        words[i * 37 % 120] = f"changed{i}"
        rows.append((i, " ".join(words), "en", "s", 1))
        rows.append((1000 + i, f"{sentence(2000 + i, 30)} {line} {sentence(4000 + i // 2, 30)}", "en", "s", 1))
    return [*rows, *((3000 + i, rows[2 * i][1], "en", "s", 1) for i in range(5))]


def test_narrowing_makes_few_rows(spark, monkeypatch):
    """The stretches of crowded anchors are not taken apart into all their windows."""
    monkeypatch.setattr(passages, "CROWDED", 30)
    made = {}
    real = passages.Staged.put

    def put(self, df, name):
        out = real(self, df, name)
        made[name] = made.get(name, 0) + out[0].count()
        if name == "cut":
            sizes = F.size(F.split(F.decode("data", "UTF-8"), " ")) - passages.LENGTH + 1
            made["all windows"] = out[0].agg(F.sum(sizes)).first()[0]
        return out

    monkeypatch.setattr(passages.Staged, "put", put)
    rows = near_copies()
    got = passages.report(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows)
    assert made["cut"] > 100 and "windows" not in made
    assert made["pieces"] < made["all windows"] / 2


def test_pieces_hold_each_window_once():
    words = [b"w%d" % i for i in range(passages.LENGTH + 27)]
    for off, size in ((27, 28), (20, 5), (3, 2), (0, 1)):
        data = b" ".join(words[: size + passages.LENGTH - 1])
        for width in (14, 7, 1):
            seen = []
            for common, number, first, at, held in passages.pieces(data, off, width):
                n = len(held.split(b" ")) - passages.LENGTH + 1
                assert held.split(b" ") == words[first : first + n + passages.LENGTH - 1] and at == off - first
                for p in range(first, first + n):
                    assert (off - p) // width == number
                    assert common in b" ".join(words[p : p + passages.LENGTH])
                    seen.append(p)
                assert len(common.split(b" ")) == passages.LENGTH - width + 1
            assert sorted(seen) == list(range(size))
