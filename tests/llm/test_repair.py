"""Repair of conversations against plain versions."""

import hashlib
import random
import re
from functools import lru_cache
from itertools import groupby
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from soundquay.llm import repair
from soundquay.llm.tables import Staged

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_edits(rows):
    """Cost, audit and repaired rows of (role, text, fault); the least of all paths by (cost, audit)."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            cost, audit, rest = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                for edit, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if (state, new[:1]) in NEXT:
                        cost, audit, rest = best(i + 1, NEXT[state, new[:1]], 0)
                        found.append((cost + price + more, edit + audit, ((new, text), *rest)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if (state, new[:1]) in NEXT:
                    cost, audit, rest = best(i, NEXT[state, new[:1]], inserted + 1)
                    found.append((cost + 3, "I" + audit, ((new, ""), *rest)))
        return min(found) if found else (1 << 30, "", ())

    return best(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = ("blank" if not solid else "duplicate" if (role, text) in seen
                 else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        known = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = [" " if v is None else v for v in (role, text)]
        kind = crc32(":".join(known).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def plain(rows):
    ids = sorted({r[0] for r in rows}, key=str)
    left = damage(rows)
    out = []
    for conv in ids:
        mine = [r[1:] for r in left if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marked = faults(mine)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, done = plain_edits(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        counts = [sum(f == kind for _, _, f in marked) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reported(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in repair.report(df).collect()], key=str)


def some_rows(seed, n, conversations=12, roles=("user", "assistant", "system", "tool", None, "")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", None, "Same again.", "x" * 3000 + ".", "é ü.\n", "a.b", "ends.  "]
    return [(rng.choice([None, *range(conversations)]), rng.choice([None, *range(20)]), rng.choice(roles), rng.choice(texts))
            for _ in range(n)]


@pytest.mark.parametrize("chunk", [repair.CHUNK, 3])
def test_report(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = some_rows(1, 150) + [(50, 17, "user", "Gone?"), (51, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "at", "chunk", "letter", "same", "next", "end", "start", "run", "fault"):
        df = df.withColumn(name, F.lit("x"))
    assert reported(df) == plain(rows)


def test_no_rows_and_dropped_conversations(spark):
    gone = [(c, t, "user", "Hi.") for c in range(40) for t in range(5) if crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone and reported(spark.createDataFrame(gone, SCHEMA)) == plain(gone)
    assert reported(spark.createDataFrame([], SCHEMA)) == []


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert reported(df) == plain([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("roles", [("user", "assistant"), ("tool",), ("user",), ("user", "assistant", "system", "tool")])
def test_one_long_conversation(spark, monkeypatch, roles):
    """Many chunks of one conversation; with one role the parity never settles inside a chunk."""
    monkeypatch.setattr(repair, "CHUNK", 16)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(roles), f"text {t}{rng.choice('.,')}") for t in range(600)]
    assert reported(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Anyone?"), (2, 0, "assistant", "Hm."), (2, 1, "user", "cut")]
    work = Staged(spark, "repair")
    counted, audits, repaired = repair.repair(spark.createDataFrame(rows, SCHEMA), work)
    got = sorted((r["key"], r["at"], r["part"], r["role"], r["text"]) for r in repaired.collect())
    for key, group in groupby(got, key=lambda r: r[0]):
        roles = "".join(r[3][0] for r in group)
        assert re.fullmatch("(s?(ua)+)?", roles), (key, roles)
    assert {r["key"]: r["cost"] for r in audits.collect()} == {"1": 3, "2": 7}
    assert counted.count() == 2


@settings(max_examples=300, deadline=None)
@given(st.text("suaxSUAX-", max_size=9))
def test_least_edits(letters):
    """Backward costs and traces against all paths, also from every state of entry and for a wrong guess mended."""
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "tool"}
    rows = [(roles[c.lower()], "t", "blank" if c == "-" else "truncated" if c.isupper() else None) for c in letters]
    cost, audit, done = plain_edits(rows)
    vectors = repair.backward(letters, repair.FINAL)
    edits, tail, found, _ = repair.trace(letters, vectors, 0, True)
    text = "".join(edits) + tail
    assert (found, text.translate({ord("u"): None, ord("a"): None})) == (cost, audit)
    guessed = repair.backward(letters, repair.GUESS)[0]
    assert repair.rerun(letters, repair.GUESS, repair.FINAL, guessed) == repair.backward(letters, repair.FINAL)[0]
