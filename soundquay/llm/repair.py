"""Repair of the turn structure of conversations by a rank-convergent parallel Viterbi recursion.

Roles must read ``(s?(ua)+)?`` by their initials. Edits keep, rerole or delete rows and insert empty
ones; the cheapest edits are a shortest path through four states (nothing yet, after a system,
user or assistant row). Costs run backward: ``vector[x]`` is the cost of the rest from state x.

1. Rows are numbered inside their conversation by range partitioning, so a conversation may hold
   any share of all rows, and become one letter each; CHUNK rows make a chunk.
2. All chunks run backward at once, from a speculative cost vector where their successor is not
   known. Fix-up passes rerun a chunk whose successor gave another vector, alongside the old run,
   and stop where both differ by a constant only: before that nothing changes. Passes go on until
   no vector changes. A pass walks twice as many chunks in a row as the one before, so rows
   that never settle (a parity that is handed on) take a logarithmic number of passes too.
3. The least trace of a chunk follows from its vectors and its state of entry. Each chunk maps the
   four states of entry to those of exit; the maps are composed by doubling.

A task holds one chunk at once. The digest of a repaired conversation is one SHA-256 over all its
rows, which only one task can work out; it streams them and holds one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay.llm.hot import join_counted
from soundquay.llm.tables import Staged
from soundquay.operators.order import number_rows

CHUNK = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after s, after u, after a; the state after the one role that may be inserted.
STATES = "ESUA"
_FORCED = (2, 2, 3, 2)
_STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (True, False, False, True)
_NEVER = 1 << 30

Vector = tuple[int, ...]


def _closed(costs: list[int]) -> Vector:
    """With any number of rows inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_FORCED[x]]) for x, c in enumerate(costs)]
    return tuple(costs)


FINAL = _closed([0 if end else _NEVER for end in _ENDS])
GUESS = (0, 0, 0, 0)


def _edits(letter: str, x: int) -> list[tuple[str, int, int]]:
    """Edits of a row in state x as initial, cost and next state. Letters: see ``_letter``."""
    out = [("D", DELETE, x)]
    if letter != "-":
        more = TRUNCATED if letter.isupper() else 0
        if letter.lower() in _STEPS[x]:
            out.append(("K", more, _STEPS[x][letter.lower()]))
        out.append(("R", REROLE + more, _FORCED[x]))
    return out


@lru_cache(maxsize=1 << 16)
def _before(letter: str, after: Vector) -> Vector:
    """The vector ahead of a row, less its least cost."""
    costs = _closed([min(c + after[to] for _, c, to in _edits(letter, x)) for x in range(4)])
    least = min(costs)
    return tuple(c - least for c in costs)


def backward(letters: str, end: Vector) -> list[Vector]:
    """The vectors ahead of each row and at the end, each up to a constant."""
    out = [end]
    for letter in reversed(letters):
        out.append(_before(letter, out[-1]))
    return out[::-1]


def rerun(letters: str, old_end: Vector, new_end: Vector, start: Vector) -> Vector:
    """The vector ahead of the first row for another end; ``start`` was that for the old one."""
    old, new = old_end, new_end
    for letter in reversed(letters):
        if old == new:
            return start
        old, new = _before(letter, old), _before(letter, new)
    return new


@lru_cache(maxsize=1 << 16)
def _choice(letter: str, x: int, after: Vector) -> tuple[str, int, int]:
    """The least initial among the cheapest edits ahead of a row in state x, its cost and next state."""
    rest = [min(c + after[to] for _, c, to in _edits(letter, y)) for y in range(4)]
    here = _closed(rest)
    options = [(i, c, to) for i, c, to in _edits(letter, x) if c + after[to] == here[x]]
    if INSERT + here[_FORCED[x]] == here[x]:
        options.append(("I", INSERT, _FORCED[x]))
    return min(options)


def trace(letters: str, vectors: list[Vector], x: int, last: bool) -> tuple[list[str], str, int, int]:
    """Edits of each row (inserts ahead of it and the row's own), those at the end, cost and state.

    The initials I and R are followed by that of the new role. Vectors are true up to a constant,
    which leaves the choice as it is.
    """
    rows, cost = [], 0
    for i, letter in enumerate(letters):
        done, initial = "", "I"
        while initial == "I":
            initial, c, x = _choice(letter, x, vectors[i + 1])
            done, cost = done + initial + (STATES[x].lower() if initial in "IR" else ""), cost + c
        rows.append(done)
    tail = ""
    while last and not _ENDS[x]:
        x = _FORCED[x]
        tail, cost = tail + "I" + STATES[x].lower(), cost + INSERT
    return rows, tail, cost, x


def _read(text: str) -> Vector:
    return tuple(map(int, text.split()))


def _write(vector: Vector) -> str:
    least = min(vector)
    return " ".join(str(c - least) for c in vector)


def _pass(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of chunks from the last to the first; each takes the vector of the one behind it."""
    behind: tuple = ()
    columns = ("key", "run", "chunk", "letters", "end", "start", "next")
    for part in parts:
        out = []
        for key, run, chunk, letters, end, start, following in zip(*(part[c] for c in columns), strict=True):
            known = behind[1] if behind and behind[0] == (key, run, chunk + 1) else following
            if known != end:
                start = _write(rerun(letters, _read(end), _read(known), _read(start)) if start else backward(letters, _read(known))[0])
            behind = ((key, run, chunk), start)
            out.append((key, chunk, letters, known, start, known != end))
        yield pd.DataFrame(out, columns=["key", "chunk", "letters", "end", "start", "changed"])


def _maps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State of exit for each state of entry."""
    for part in parts:
        exits = []
        for letters, end in zip(part["letters"], part["end"], strict=True):
            vectors = backward(letters, _read(end))
            exits.append("".join(STATES[trace(letters, vectors, x, False)[3]] for x in range(4)))
        yield part[["key", "chunk"]].assign(exits=exits)


def _traces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        columns = ("key", "chunk", "letters", "end", "entry", "last")
        for key, chunk, letters, end, entry, last in zip(*(part[c] for c in columns), strict=True):
            rows, tail, cost, _ = trace(letters, backward(letters, _read(end)), STATES.index(entry), last)
            out.append((key, chunk, entry, rows, tail, cost))
        yield pd.DataFrame(out, columns=["key", "chunk", "entry", "edits", "tail", "cost"])


def solve(chunks: DataFrame, work: Staged) -> DataFrame:
    """Cheapest edits of numbered chunks of letters (key, chunk, letters, last).

    Returns key, chunk, entry (state), edits (for each row), tail (inserts at the end) and cost.
    """
    final = F.lit(_write(FINAL))
    spent, width = 0, 1
    now = chunks.withColumn("end", F.lit("")).withColumn("start", F.lit("")).withColumn("next", F.when(F.col("last"), final).otherwise(_write(GUESS)))
    while True:
        runs = now.withColumn("run", F.floor(F.col("chunk") / width))
        ordered = runs.repartition("key", "run").sortWithinPartitions("key", "run", F.desc("chunk"))
        made = work.keep(
            ordered.select("key", "run", "chunk", "letters", "end", "start", "next").mapInPandas(
                _pass, "key string, chunk long, letters string, end string, start string, changed boolean"
            ),
            "vectors",
        )
        spent, width = spent + 1, width * 2
        behind = made.select("key", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("next"))
        now = made.join(behind, ["key", "chunk"], "left").withColumn("next", F.coalesce("next", final)).drop("changed")
        if now.filter(F.col("next") != F.col("end")).isEmpty():
            break
    maps = work.keep(made.select("key", "chunk", "letters", "end").mapInPandas(_maps, "key string, chunk long, exits string"), "maps")
    one = F.col("exits") == F.repeat(F.substring("exits", 1, 1), 4)  # the entry does not matter
    found = maps.withColumn("since", F.when(one, 0).otherwise(F.col("chunk")))
    while True:
        found = work.keep(found, "composed")
        if found.filter("since > 0").isEmpty():
            break
        earlier = found.select("key", (F.col("chunk") + 1).alias("since"), F.col("exits").alias("_exits"), F.col("since").alias("_since"))
        joined = found.join(earlier.filter("since > 0"), ["key", "since"], "left")
        composed = F.coalesce(F.expr(f"translate(_exits, '{STATES}', exits)"), "exits")
        found = joined.select("key", "chunk", composed.alias("exits"), F.coalesce("_since", "since").alias("since"))
    entry = found.select("key", (F.col("chunk") + 1).alias("chunk"), F.substring("exits", 1, 1).alias("entry"))
    placed = made.select("key", "chunk", "letters", "end").join(chunks.select("key", "chunk", "last"), ["key", "chunk"])
    entered = placed.join(entry, ["key", "chunk"], "left").fillna(STATES[0], ["entry"])
    shape = "key string, chunk long, entry string, edits array<string>, tail string, cost long"
    return work.keep(entered.select("key", "chunk", "letters", "end", "entry", "last").mapInPandas(_traces, shape), "traces")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text after the damage that the CRC-32 of ``conv_id:turn`` deals."""

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    plain = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return plain.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def _key(conv_id: str) -> Column:
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(""))


def faulty(rows: DataFrame, work: Staged) -> DataFrame:
    """Numbered rows with their first fault (blank, duplicate, truncated or null) and initial."""
    keyed = rows.select(_key("conv_id").alias("key"), "turn", "role", "text")
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    numbered = number_rows(keyed, ["turn", "role", "text"], ["key"], "at").withColumn("same", same)
    ends = F.substring(said, -1, 1).isin(".", "!", "?")
    fault = F.when(said == "", "blank").when(~ends, "truncated")
    numbered = work.keep(numbered.withColumn("fault", fault), "rows")
    first = numbered.groupBy("key", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = work.keep(first, "said-again")
    again = join_counted(numbered.select("key", "at", "same"), first, ["key", "same"], "n")
    again = again.filter("at > first").select("key", "at", F.lit(True).alias("again"))
    marked = numbered.join(again, ["key", "at"], "left")
    initial = F.substring("role", 1, 1)
    return marked.select(
        "key", "at", "turn", "role", "text",
        F.when(F.col("fault") == "blank", "blank").when(F.col("again"), "duplicate").otherwise(F.col("fault")).alias("fault"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
    )


def _letter() -> Column:
    """The row's initial (x: none that is allowed), upper case if truncated; - if it must go."""
    gone = F.col("fault").isin("blank", "duplicate")
    return F.when(gone, "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))


def _in_order(order: str, value: str) -> Column:
    """Values of a bounded group in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def repair(rows: DataFrame, work: Staged) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, their edits and the repaired rows.

    ``rows`` has conv_id, turn, role and text. Rows are taken by turn (null first), then by role
    and text; an empty role has no initial and cannot be kept. The first result has key (the id as
    text, empty for null) and the counts gaps, blank, duplicate, truncated and illegal; the second
    key, audit and cost; the third key, at, part, edit, role and text in the order key, at, part.
    """
    marked = work.keep(faulty(rows, work), "marked")
    chunk = F.floor(F.col("at") / CHUNK).alias("chunk")
    cut = marked.withColumn("letter", _letter()).groupBy("key", chunk).agg(
        _in_order("at", "letter").alias("letters"), _in_order("at", "initial").alias("initials")
    )
    cut = work.keep(cut, "chunks")
    ends = cut.select("key", (F.col("chunk") - 1).alias("chunk"), F.substring("initials", 1, 1).alias("following"))
    chunks = work.keep(cut.join(ends, ["key", "chunk"], "left").withColumn("last", F.col("following").isNull()), "linked")
    solved = solve(chunks.select("key", "chunk", "letters", "last"), work)

    # a lookahead counts overlapping pairs; the pair across the border belongs to the earlier chunk
    across = F.concat("initials", F.coalesce("following", F.lit("")))
    illegal = F.regexp_count(across, F.lit("(?=..)(?!su|ua|au)"))
    turns = marked.groupBy("key", "turn").agg(
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counted = turns.groupBy("key").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    pairs = chunks.groupBy("key").agg(F.sum(illegal).cast("long").alias("illegal"))

    whole = F.translate(F.concat(F.array_join("edits", ""), "tail"), "ua", "")
    audits = solved.select("key", "chunk", whole.alias("part"), "cost").groupBy("key").agg(
        _in_order("chunk", "part").alias("audit"), F.sum("cost").alias("cost")
    )
    return counted.join(pairs, "key"), audits, _repaired(marked, solved)


def _repaired(marked: DataFrame, solved: DataFrame) -> DataFrame:
    """The rows after the edits; ``part`` orders what stands at one place."""
    at = F.col("chunk") * CHUNK
    own = solved.select("key", at.alias("_at"), F.posexplode("edits").alias("_i", "_edits"))
    own = own.select("key", (F.col("_at") + F.col("_i")).alias("at"), "_edits")
    ends = solved.filter("tail <> ''").select("key", (at + F.size("edits")).alias("at"), F.col("tail").alias("_edits"))
    places = own.join(marked.select("key", "at", "role", "text"), ["key", "at"]).unionByName(ends, allowMissingColumns=True)
    each = F.posexplode(F.regexp_extract_all("_edits", F.lit("[DIKR][ua]?"), F.lit(0))).alias("part", "_edit")
    edit, new = F.substring("_edit", 1, 1), F.substring("_edit", 2, 1)
    role = F.when(new == "u", ROLES["u"]).when(new == "a", ROLES["a"]).otherwise(F.col("role"))
    text = F.when(edit == "I", "").otherwise(F.col("text"))
    rows = places.select("key", "at", "role", "text", each)
    return rows.filter(edit != "D").select("key", "at", "part", edit.alias("edit"), role.alias("role"), text.alias("text"))


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the lines of each key, from lines in order; holds one running digest."""
    key, running = None, None
    for part in parts:
        out = []
        for k, line in zip(part["key"], part["line"], strict=True):
            data = line.encode("utf-8", "surrogatepass")
            if k == key:
                running.update(b"\n" + data)
            else:
                if running is not None:
                    out.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(data)
        yield pd.DataFrame(out, columns=["key", "digest"])
    if running is not None:
        yield pd.DataFrame([(key, running.hexdigest())], columns=["key", "digest"])


def report(rows: DataFrame) -> DataFrame:
    """Counts of faults, cheapest edits and digest of every conversation after the damage.

    Null columns count as one space, a null id is a conversation of its own, repeated rows and
    turns each count; conversations that lost all rows have zeros, no edits and the digest of an
    empty string; an empty table gives no rows; other columns are not read.
    """
    work = Staged(rows.sparkSession, "repair")
    counted, audits, repaired = repair(damaged(rows), work)
    lines = repaired.select("key", "at", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("key").sortWithinPartitions("key", "at", "part").select("key", "line")
    digests = ordered.mapInPandas(_digests, "key string, digest string")
    ids = rows.select("conv_id").distinct().withColumn("key", _key("conv_id"))
    whole = ids.join(counted, "key", "left").join(audits, "key", "left").join(digests, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return whole.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", empty).alias("repaired_sha256")
    )
