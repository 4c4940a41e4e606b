"""Repeated substrings by a distributed difference-cover algorithm, bounded at the length sought.

A byte goes when a string of LENGTH bytes that covers it also starts earlier in the corpus.

1. Windows. Each LENGTH-byte window has an anchor, the k-mer of least hash in it; equal windows
   have equal anchors. Neighbouring windows with one anchor form a cell. A cell whose anchor occurs
   nowhere else holds no repeat. Cells of equal bytes collapse to the first of them: the windows of
   the others repeat it. What is left open are cells that share an anchor with different cells.
2. Difference cover. Of the open windows, positions 1 and 2 modulo 3 are sampled. Their strings of
   98 bytes are triples of strings of 35 bytes at sampled positions; the 35-byte strings are sorted
   and named in order, then the triples of names are sorted and named in order.
3. Merge. Windows of different classes compare by one or two bytes and a name of a sampled position
   on either side, as suffixes of different classes do: (1 byte, name, 1 byte), (name, 2 bytes) or
   (2 bytes, name). In the merged order, adjacent windows with an equal key repeat the first.

Only cells with one anchor need one order, so Spark deals the open cells out by anchor and each task
runs steps 2 and 3 over runs of whole anchors. An anchor with more than CROWDED different cells is
dealt out in pieces; what remains first in its piece goes through steps 2 and 3 once more as joins
and range sorts over the whole cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundquay.llm.tables import Staged

LENGTH = 100
ANCHOR = 32
GRAM = 35
NAMED = 98
_PARTS = (0, 33, 63)
#: Cells that a task orders at once (about half a megabyte of text); anchors are kept whole.
_CELLS = 4096
#: Different cells of an anchor that one task orders; more are ordered in pieces, then together.
CROWDED = _CELLS
_CHUNK = 1 << 23
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 24) - 1)


def cells(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First and last window and anchor of the cells of a text, by chunks."""
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        piece = data[at : at + _CHUNK + LENGTH - 1]
        n = len(piece)
        words = np.ndarray((n - 7,), "<u8", piece, 0, (1,))
        h = words[: n - ANCHOR + 1].copy()
        for j in range(8, ANCHOR, 8):
            h = (h ^ (h >> np.uint64(29))) * _M1 + words[j : j + n - ANCHOR + 1]
        h = (h ^ (h >> np.uint64(31))) * _M2
        h = (h ^ (h >> np.uint64(30))) * _M1
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        wide, step = LENGTH - ANCHOR + 1, 1
        while step * 2 <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if wide > step:
            least = np.minimum(least[: step - wide], least[wide - step :])
        where = (least & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        last = np.concatenate([first[1:], [len(where)]]) - 1
        yield first + at, last + at, h[where[first]].view(np.int64)


def _anchors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [a for t in part["text"] for _, _, a in cells(t.encode("utf-8", "surrogatepass"))]
        yield pd.DataFrame({"anchor": np.concatenate(found) if found else np.zeros(0, np.int64)})


def _cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells as anchor, hash of their bytes, document and (first window, number of windows)."""
    of = xxhash.xxh64_intdigest
    for part in parts:
        out: list[tuple] = []
        for doc, text in zip(part["doc"], part["text"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for first, last, anchor in cells(data):
                spans = zip(first.tolist(), last.tolist(), strict=True)
                same = np.array([of(data[a : b + LENGTH]) for a, b in spans], np.uint64).view(np.int64)
                out.append((anchor, same, np.full(len(first), doc), first, last - first + 1))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        yield pd.DataFrame(dict(zip(("anchor", "same", "doc", "first", "size"), cols, strict=True)))


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of open cells."""
    for part in parts:
        rows = []
        for doc, text, spans in zip(part["doc"], part["text"], part["spans"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for x in spans:
                first, n = x["first"], x["size"]
                rows.append((x["anchor"], x["pieces"], doc, first, first + n - 1, data[first : first + n + LENGTH - 1]))
        yield pd.DataFrame(rows, columns=["anchor", "pieces", "doc", "first", "last", "data"])


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Names of rows in the order of their keys (the first key counts most); equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _runs(flags: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of set flags inside a cell."""
    at = np.flatnonzero(flags)
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(cell[at]) != 0)) + 1
    return at[np.concatenate([[0], cuts])] if len(at) else at, at[np.concatenate([cuts - 1, [len(at) - 1]])] if len(at) else at


def order_cells(group, doc, first, last, data) -> tuple[np.ndarray, ...]:
    """Difference cover and merge over the windows of some cells.

    Returns, for every window, the cell's index, its position and whether an earlier window of the
    same group (by doc, then position) has equal bytes.
    """
    sizes = np.array([len(d) for d in data])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    buffer = b"".join(data) + bytes(8)
    raw = np.frombuffer(buffer, np.uint8)
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))

    def spread(extra: int):
        n = last - first + 1 + extra
        cell = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
        return cell, step

    cell, step = spread(2)
    q = first[cell] + step
    sampled = q % 3 != 0
    cell, at = cell[sampled], (begin[cell] + step)[sampled]
    need = np.zeros(len(raw), bool)
    owner = np.zeros(len(raw), np.int64)
    for k in _PARTS:
        need[at + k] = True
        owner[at + k] = group[cell]
    ids = np.flatnonzero(need)
    names = np.zeros(len(raw), np.int64)
    names[ids] = _ranks(owner[ids], *[words[ids + k].byteswap() for k in (0, 8, 16, 24, GRAM - 8)])
    named = np.zeros(len(raw), np.int64)
    named[at] = _ranks(*[names[at + k] for k in _PARTS])
    cell, step = spread(0)
    at, p = begin[cell] + step, first[cell] + step
    keys, of = [], []
    for kind, (left_out, i, j, k) in enumerate(((2, 0, 99, 1), (0, 98, 99, 0), (1, 0, 1, 2))):
        mine = np.flatnonzero(p % 3 != left_out)
        x = at[mine]
        pair = raw[x + i].astype(np.int64) << 8 | raw[x + j]
        keys.append(named[x + k] << 18 | kind << 16 | pair)
        of.append(mine)
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.lexsort((p[of], doc[cell[of]], keys))
    again = keys[order][1:] == keys[order][:-1]
    repeated = np.zeros(len(p), bool)
    repeated[of[order[1:][again]]] = True
    return cell, p, repeated


def _ordered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated runs of windows (data null); of anchors in pieces, also what stays first, with bytes."""
    held = None
    for part in parts:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        # a run that is followed by another group is complete
        while len(held) > _CELLS and (cut := _cut_at(held)):
            yield _order_rows(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield _order_rows(held)


def _cut_at(rows: pd.DataFrame) -> int:
    """Where to cut: the last border of groups within _CELLS rows, or else the first one; 0: none."""
    anchor, piece = rows["anchor"].to_numpy(), rows["piece"].to_numpy()
    borders = np.flatnonzero((anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])) + 1
    if not len(borders):
        return 0
    return int(max(borders[0], borders[np.searchsorted(borders, _CELLS, "right") - 1] if borders[0] <= _CELLS else 0))


def _order_rows(rows: pd.DataFrame) -> pd.DataFrame:
    anchor, piece = rows["anchor"].to_numpy(), rows["piece"].to_numpy()
    doc, first, last = (rows[c].to_numpy(np.int64) for c in ("doc", "first", "last"))
    data, pieces = rows["data"].tolist(), rows["pieces"].to_numpy()
    change = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    group = np.concatenate([[0], np.cumsum(change)])
    cell, p, repeated = order_cells(group, doc, first, last, data)
    start, stop = _runs(repeated, cell)
    out = [pd.DataFrame({"doc": doc[cell[start]], "first": p[start], "last": p[stop], "data": None})]
    start, stop = _runs(~repeated & (pieces > 1)[cell], cell)
    kept = [
        data[c][a - first[c] : b - first[c] + LENGTH] for c, a, b in zip(cell[start], p[start], p[stop], strict=True)
    ]
    out.append(pd.DataFrame({"doc": doc[cell[start]], "first": p[start], "last": p[stop], "data": kept}))
    return pd.concat(out)


def _sampled(first: int, last: int) -> np.ndarray:
    """Sampled positions whose names the windows first..last need."""
    q = np.arange(first, last + 3)
    return q[q % 3 != 0]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 35-byte strings at the positions that the names of a cell are made of."""
    for batch in batches:
        ids, places, pieces = [], [], []
        for cell, first, last, base, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            at = np.unique((_sampled(first, last)[:, None] + np.array(_PARTS)).ravel())
            at = at[at - base + GRAM <= len(data)]
            view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), GRAM)
            ids.append(np.full(len(at), cell))
            places.append(at)
            pieces.append(view[at - base].tobytes())
        n = sum(map(len, places))
        ends = np.arange(0, (n + 1) * GRAM, GRAM, dtype=np.int32)
        grams = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(pieces))])
        empty = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(ids or empty)), pa.array(np.concatenate(places or empty)), grams],
            names=["cell", "at", "gram"],
        )


def _triples(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for cell, first, last, named in zip(part["cell"], part["first"], part["last"], part["named"], strict=True):
            names = {x["at"]: x["name"] for x in named}
            for q in _sampled(first, last).tolist():
                three = [names.get(q + k) for k in _PARTS]
                if None not in three:
                    out.append((cell, q, *three))
        yield pd.DataFrame(out, columns=["cell", "at", "a", "b", "c"])


def _merge_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two keys for each open window; equal windows of any two classes share one of theirs."""
    for part in parts:
        out: list[tuple] = []
        columns = ("doc", "first", "last", "base", "data", "named")
        for doc, first, last, base, data, named in zip(*(part[c] for c in columns), strict=True):
            names = {x["at"]: x["name"] for x in named}
            for p in range(first, last + 1):
                i, kind = p - base, p % 3
                if kind != 2:
                    out.append((doc, p, 0, data[i] << 8 | data[i + 99], names[p + 1]))
                if kind != 0:
                    out.append((doc, p, 1, data[i + 98] << 8 | data[i + 99], names[p]))
                if kind != 1:
                    out.append((doc, p, 2, data[i] << 8 | data[i + 1], names[p + 2]))
        yield pd.DataFrame(out, columns=["doc", "p", "kind", "bytes", "name"])


def _in_order(df: DataFrame, keys: list[str], work: Staged, name: str) -> DataFrame:
    """The distinct keys with a name each; names follow the order of the keys."""
    ordered = df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    return work.keep(ordered.withColumn("name", F.monotonically_increasing_id()), name)


def _named(rows: DataFrame, names: DataFrame, keys: list[str], by: str) -> DataFrame:
    pair = F.collect_list(F.struct("at", "name")).alias("named")
    return rows.join(names, keys).groupBy(by).agg(pair)


def _numbered(docs: DataFrame, work: Staged) -> DataFrame:
    """Texts with ``doc``, a number in the order of the documents.

    That is doc_id itself where it is a key. Where ids repeat or are null, rows are numbered by
    doc_id (nulls last), then by a hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    again = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if again.isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return work.keep(ordered.withColumn("doc", F.monotonically_increasing_id()), "numbered")


def repeated_starts(texts: DataFrame, work: Staged) -> DataFrame:
    """Rows doc, first, last: runs of starts of LENGTH-byte strings that also start earlier."""
    anchors = texts.select("text").mapInPandas(_anchors, "anchor long")
    often = anchors.groupBy("anchor").count().filter("count > 1").select("anchor")
    found = texts.select("doc", "text").mapInPandas(_cells, "anchor long, same long, doc long, first long, size long")
    found = work.keep(found.join(often, "anchor"), "cells")
    place = F.struct("doc", "first")
    firsts = work.keep(
        found.groupBy("anchor", "same").agg(F.min(place).alias("top"), F.min("size").alias("size"), F.count("*").alias("n")),
        "first-cells",
    )
    later = (
        found.join(firsts.filter("n > 1").select("anchor", "same", "top"), ["anchor", "same"])
        .filter(place != F.col("top"))
        .select("doc", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    )
    shared = firsts.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    pieces = F.ceil(F.col("m") / CROWDED).cast("int")
    spans = (
        firsts.join(shared, "anchor")
        .select(
            F.col("top.doc").alias("doc"),
            F.struct("anchor", pieces.alias("pieces"), F.col("top.first").alias("first"), "size").alias("s"),
        )
        .groupBy("doc").agg(F.collect_list("s").alias("spans"))
    )
    shape = "anchor long, pieces int, doc long, first long, last long, data binary"
    keys = ["anchor", "piece"]
    ordered = work.keep(
        texts.select("doc", "text").join(spans, "doc").mapInPandas(_cut, shape)
        .withColumn("piece", F.pmod(F.xxhash64("doc", "first"), F.col("pieces")))
        .repartition(*keys).sortWithinPartitions(*keys)
        .mapInPandas(_ordered, "doc long, first long, last long, data binary"),
        "ordered",
    )
    found = later.unionByName(ordered.filter("data is null").drop("data"))
    rest = ordered.filter("data is not null")
    if rest.isEmpty():
        return found
    return found.unionByName(_difference_cover(rest.withColumn("cell", F.monotonically_increasing_id()), work))


def _difference_cover(rest: DataFrame, work: Staged) -> DataFrame:
    """Steps 2 and 3 over the whole cluster."""
    rows = work.keep(rest.select("cell", "first", "last", F.col("first").alias("base"), "data", "doc"), "windows")
    grams = rows.select("cell", "first", "last", "base", "data").mapInArrow(_grams, "cell long, at long, gram binary")
    named = _named(grams, _in_order(grams, ["gram"], work, "grams"), ["gram"], "cell")
    triples = rows.select("cell", "first", "last").join(named, "cell").mapInPandas(
        _triples, "cell long, at long, a long, b long, c long"
    )
    triples = work.keep(triples, "triples")
    keys = ["a", "b", "c"]
    named = _named(triples, _in_order(triples, keys, work, "triple-names"), keys, "cell")
    windows = work.keep(
        rows.join(named, "cell").mapInPandas(_merge_keys, "doc long, p long, kind int, bytes int, name long"), "keys"
    )
    key = ["kind", "bytes", "name"]
    place = F.struct("doc", "p")
    tops = windows.groupBy(*key).agg(F.min(place).alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return windows.join(tops, key).filter(place > F.col("top")).select(
        "doc", F.col("p").alias("first"), F.col("p").alias("last")
    )


def _remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for doc_id, text, runs in zip(part["doc_id"], part["text"], part["runs"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            steps = np.zeros(len(data) + 1, np.int64)
            if runs is not None and len(runs):
                np.add.at(steps, [r["first"] for r in runs], 1)
                np.add.at(steps, [r["last"] + LENGTH for r in runs], -1)
            gone = np.cumsum(steps[:-1]) > 0
            starts = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((doc_id, len(data), int(gone.sum()), int(starts.sum()), kept))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row of docs.

    A byte is removed when a LENGTH-byte string that covers it also starts earlier: in a document
    before (by doc_id; see _numbered for repeated and null ids) or further left in the same one;
    strings are judged on the input. Null texts count as empty; texts shorter than LENGTH stay.
    """
    work = Staged(docs.sparkSession, "suffix")
    texts = _numbered(docs, work)
    runs = work.keep(repeated_starts(texts, work), "runs")
    by_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return texts.join(by_doc, "doc", "left").select("doc_id", "text", "runs").mapInPandas(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
