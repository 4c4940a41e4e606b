"""Repeated passages by suffix automata of reference shards.

A word goes when a window of LENGTH consecutive words that covers it also starts anywhere else.

1. Stretches. Every window has an anchor, the run of GRAM words of least hash in it; equal windows
   have equal anchors. Neighbouring windows with one anchor form a stretch of the document. Only
   stretches whose anchor occurs again can repeat; equal stretches collapse to one with a count.
2. Reference shards. The stretches are dealt into shards by their anchor, so that all places where
   a window occurs lie in one shard, and a shard has a bounded number of words. The stretches of an
   anchor with very many different ones (a common line in many surroundings) are narrowed: cut by
   the place of the anchor in the window into pieces whose windows share more words, which become
   the anchor of the piece, until an anchor has few different pieces or a piece is one window.
3. Automata. Each shard becomes a suffix automaton over words, with the number of places for each
   state; states with one place are left out, so that what it accepts are the repeated strings.
4. Matching statistics. Stretches stream through the automaton of their shard: the length of the
   longest repeated string that ends at each word. Where it reaches LENGTH the words go.

The anchor tells which shard a stretch can match, so the automaton of a shard is needed in the
task of that shard only and is not broadcast to the others: all documents through all automata
would be work that grows with the square of the corpus, and all automata together are larger than
the corpus. Memory of a task is bounded by the words of one shard.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundquay.llm.hot import join_counted
from soundquay.llm.tables import Staged

LENGTH = 35
GRAM = 8
#: Words of a shard, about; an anchor stays in one shard.
SHARD_WORDS = 1 << 15
#: Different stretches of an anchor from which each window becomes a stretch of its own.
CROWDED = 500
_CHUNK = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 24) - 1)
#: Places of the anchor in the windows of a piece, in each round of narrowing.
_WIDTHS = (14, 7, 1)
#: Words on one side of the anchor that every window has at least on one of its sides.
_SIDE = (LENGTH - GRAM + 1) // 2


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _borders(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word of words joined by single spaces."""
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(plain)]])


#: The lowest n bytes.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _word_hashes(plain: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Of the length and 8 bytes at the start, middle and end of each word: enough to choose anchors."""
    eight = np.ndarray(len(plain) + 1, "<u8", plain + bytes(8), 0, (1,))
    size = stops - starts
    mask, spare = _BYTES[np.minimum(size, 8)], np.maximum(size - 8, 0)
    h = _mixed((eight[starts] & mask) + size.astype(np.uint64) * _M2)
    long = np.flatnonzero(spare)
    at, more = starts[long], spare[long]
    h[long] = _mixed(_mixed(h[long] ^ eight[at + more]) ^ eight[at + more // 2])
    return h


def stretches(words: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """First and last window, anchor and its place of the stretches of a document, by chunks."""
    plain = b" ".join(words)
    return _stretches(plain, *_borders(plain))


def _stretches(plain: bytes, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    every = _word_hashes(plain, starts, stops)
    for at in range(0, len(every) - LENGTH + 1, _CHUNK):
        h = every[at : at + _CHUNK + LENGTH - 1]
        n = len(h)
        grams = h[: n - GRAM + 1].copy()
        for j in range(1, GRAM):
            grams = grams * _M1 + h[j : n - GRAM + 1 + j]
        grams = _mixed(grams)
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        wide, step = LENGTH - GRAM + 1, 1
        while step * 2 <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if wide > step:
            least = np.minimum(least[: step - wide], least[wide - step :])
        where = (least & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        last = np.concatenate([first[1:], [len(where)]]) - 1
        yield first + at, last + at, grams[where[first]].view(np.int64), where[first] + at


def _hashed(plain: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    of = xxhash.xxh64_intdigest
    pairs = zip(starts.tolist(), stops.tolist(), strict=True)
    return np.array([of(plain[a:b]) for a, b in pairs], np.uint64).view(np.int64)


#: ``off``: words of the stretch ahead of its anchor
_STRETCH = "anchor long, same long, doc long, first int, size int, off int"


def _frame(out: list[tuple]) -> pd.DataFrame:
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
    return pd.DataFrame(dict(zip(("anchor", "same", "doc", "first", "size", "off"), columns, strict=True)))


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches as anchor, hash of their words, document, first window and number of windows."""
    for part in parts:
        out: list[tuple] = []
        for doc, text in zip(part["doc"], part["text"], strict=True):
            plain = b" ".join(words_of(text))
            starts, stops = _borders(plain)
            if len(starts) < LENGTH:
                continue
            for first, last, anchor, place in _stretches(plain, starts, stops):
                same = _hashed(plain, starts[first], stops[last + LENGTH - 1])
                out.append((anchor, same, np.full(len(first), doc), first, last - first + 1, place - first))
        yield _frame(out)


#: ``n``: places in all texts
_PIECE = "anchor long, same long, n long, off int, data binary"
#: ``shift``: first window of the piece in its stretch
_NARROW = f"{_PIECE}, whole_anchor long, whole_same long, shift int"


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of stretches."""
    for part in parts:
        rows = []
        for text, spans in zip(part["text"], part["spans"], strict=True):
            plain = b" ".join(words_of(text))
            starts, stops = _borders(plain)
            for x in spans:
                data = plain[starts[x["first"]] : stops[x["first"] + x["size"] + LENGTH - 2]]
                rows.append((x["anchor"], x["same"], x["n"], x["off"], data))
        yield pd.DataFrame(rows, columns=["anchor", "same", "n", "off", "data"])


def pieces(data: bytes, off: int, width: int) -> list[tuple[bytes, int, int, int, bytes]]:
    """The windows of a stretch, by the number of words ahead of the anchor in them.

    As words that all windows of the piece hold, number of the piece, its first window, place of
    the anchor in it, and its words. Equal windows have the anchor at the same place, so that they
    lie in pieces of one number with the same common words.
    """
    starts, stops = (x.tolist() for x in _borders(data))
    size = len(starts) - LENGTH + 1
    out = []
    for number in range((off - size + 1) // width, off // width + 1):
        least, most = number * width, (number + 1) * width - 1
        first, last = max(off - most, 0), min(off - least, size - 1)
        common = data[starts[off - least] : stops[off - most + LENGTH - 1]]
        out.append((common, number, first, off - first, data[starts[first] : stops[last + LENGTH - 1]]))
    return out


def _split(width: int):
    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stretches, or pieces of such, in pieces whose windows share more words."""
        of = xxhash.xxh64_intdigest
        for part in parts:
            rows = [
                (of(common, number), of(data), n, off, data, whole_anchor, whole_same, shift + first)
                for _, _, n, at, words, whole_anchor, whole_same, shift in part.itertuples(index=False, name=None)
                for common, number, first, off, data in pieces(words, at, width)
            ]
            names = ["anchor", "same", "n", "off", "data", "whole_anchor", "whole_same", "shift"]
            out = pd.DataFrame(rows, columns=names)
            for name in ("anchor", "same"):
                out[name] = out[name].to_numpy(np.uint64).view(np.int64)
            yield out

    return split


@dataclass
class Automaton:
    """Suffix automaton of some texts, without the strings that occur in one place only."""

    symbols: dict[bytes, int]
    length: list[int]
    link: list[int]
    step: list[dict[int, int]]

    @classmethod
    def of(cls, texts: Sequence[tuple[list[bytes], int]]) -> Automaton:
        """Of pairs of words and the number of places where they stand."""
        symbols: dict[bytes, int] = {}
        length, link, step, places = [0], [-1], [{}], [0]

        def split(p: int, c: int, q: int) -> int:
            """The state of the strings of q that are one longer than those of p."""
            twin = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            step.append(dict(step[q]))
            places.append(0)
            link[q] = twin
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = twin
                p = link[p]
            return twin

        for words, n in texts:
            last = 0
            for c in [symbols.setdefault(w, len(symbols)) for w in words]:
                q = step[last].get(c)
                depth = length[last] + 1
                if q is not None:  # the string is there from an earlier text
                    last = q if length[q] == depth else split(last, c, q)
                else:
                    new, p = len(length), last
                    length.append(depth)
                    link.append(0)
                    step.append({})
                    places.append(0)
                    while p >= 0 and (q := step[p].setdefault(c, new)) == new:
                        p = link[p]
                    if p >= 0:
                        link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                    last = new
                places[last] += n
        depths, links, found = np.array(length), np.array(link), np.array(places, np.int64)
        order = np.argsort(-depths, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(depths[order])) + 1)[:-1]:
            np.add.at(found, links[level], found[level])
        # suffixes and prefixes of repeated strings are repeated: the rest stays connected
        kept = found > 1
        kept[0] = True
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        to = number.tolist()
        moves = [{c: to[q] for c, q in step[v].items() if to[q] >= 0} for v in np.flatnonzero(kept).tolist()]
        suffix = np.where(links >= 0, number[links], -1)
        return cls(symbols, depths[kept].tolist(), suffix[kept].tolist(), moves)

    def matching(self, words: Sequence[bytes]) -> list[int]:
        """For each word the length of the longest string kept that ends there."""
        symbol, length, link, step = self.symbols.get, self.length, self.link, self.step
        v = n = 0
        out = []
        for word in words:
            c = symbol(word, -1)
            while v and c not in step[v]:
                v = link[v]
                n = length[v]
            if c in step[v]:
                v = step[v][c]
                n += 1
            out.append(n)
        return out


def _shards(parts: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The rows of each shard, from rows in the order of their shards; a shard is bounded."""
    shard, held = None, []
    for part in parts:
        for row in part.itertuples(index=False, name=None):
            if row[0] != shard and held:
                yield held
                held = []
            shard = row[0]
            held.append(row)
    if held:
        yield held


def _sides(anchor: int, off: int, words: list[bytes]) -> list[tuple]:
    """The anchor with _SIDE words ahead of it, and with as many behind it; a window holds one of them."""
    out = []
    if off >= _SIDE:
        out.append((anchor, b" ".join(words[off - _SIDE : off + GRAM])))
    if len(words) - off >= GRAM + _SIDE:
        out.append((anchor, b" ".join(words[off : off + GRAM + _SIDE]), "behind"))
    return out


def _shared(off: int, words: list[bytes], sides: list[bool]) -> tuple[int, list[bytes]]:
    """First window, and words, of the windows that hold a side of the anchor that is also elsewhere."""
    ahead, behind = off >= _SIDE, len(words) - off >= GRAM + _SIDE
    low = ahead and not sides[0]  # then only the windows with fewer than _SIDE words ahead are left
    high = behind and not sides[-1]
    first = max(off - _SIDE + 1, 0) if low else 0
    return first, words[first : off - _SIDE + LENGTH if high else len(words)]


def _matched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of repeated windows of the stretches of each shard, from rows in the order of shards.

    A window of a stretch with one place can only stand elsewhere if the words at one side of the
    anchor, of which it holds one, do; windows without such words are left out.
    """
    for rows in _shards(parts):
        texts = [(key, n, off, data.split(b" ")) for _, *key, n, off, data in rows]
        sides = [_sides(key[0], off, words) for key, _, off, words in texts]
        seen = Counter(side for x in sides for side in x)
        used = []
        for (key, n, off, words), mine in zip(texts, sides, strict=True):
            again = [seen[side] > 1 for side in mine]
            if n > 1:
                used.append((key, n, 0, words))
            elif any(again):
                used.append((key, n, *_shared(off, words, again)))
        automaton = Automaton.of([(words, n) for _, n, _, words in used])
        out = []
        for key, _, first, words in used:
            found = np.array(automaton.matching(words)[LENGTH - 1 :]) >= LENGTH
            edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))) + first
            if len(edges):
                out.append((*key, edges[::2].tolist(), (edges[1::2] - 1).tolist()))
        yield pd.DataFrame(out, columns=["anchor", "same", "narrow", "rows", "starts", "stops"])


def _keyed(docs: DataFrame, work: Staged) -> DataFrame:
    """Texts with ``doc``, a key: doc_id, or a number where ids repeat or are null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    again = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if again.isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    return work.keep(rows.withColumn("doc", F.monotonically_increasing_id()), "keyed")


def _spans(places: DataFrame, *more: str) -> DataFrame:
    return places.groupBy("doc").agg(F.collect_list(F.struct("first", "size", *more)).alias("spans"))


def _firsts(found: DataFrame) -> DataFrame:
    """Different stretches with one place and the number of all places."""
    place = F.min(F.struct("doc", "first", "size", "off")).alias("top")
    return found.groupBy("anchor", "same").agg(place, F.count("*").alias("n"))


def open_stretches(texts: DataFrame, work: Staged) -> tuple[DataFrame, DataFrame]:
    """Stretches with an anchor that occurs again, and the different ones of them with counts."""
    whole, path = work.put(texts.select("doc", "text").mapInPandas(_scan, _STRETCH), "stretches")
    often = work.keep(whole.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    found = work.keep(join_counted(whole, often, ["anchor"], "n").drop("n"), "open")
    work.drop(path)
    firsts = work.keep(_firsts(found), "different")
    work.settle()
    return found, firsts


def _cut_out(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    spans = _spans(firsts.select("anchor", "same", "n", "top.*"), "anchor", "same", "n", "off")
    return texts.select("doc", "text").join(spans, "doc").mapInPandas(_cut, _PIECE)


def narrowed(stretches: DataFrame, work: Staged) -> DataFrame:
    """Pieces of different stretches, as _NARROW, with few different ones for each anchor.

    A piece names the stretch it is of, and has its number of places. Pieces whose anchor occurs
    once are left out: their windows do.
    """
    left = stretches.select(
        "*", F.col("anchor").alias("whole_anchor"), F.col("same").alias("whole_same"), F.lit(0).alias("shift")
    )
    done = []
    for width in _WIDTHS:
        made = work.keep(left.mapInPandas(_split(width), _NARROW), "pieces")
        different = made.groupBy("anchor", "same").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        counts = different.groupBy("anchor").agg(
            F.count("*").alias("m"), F.sum("n").alias("places"), F.sum("rows").alias("rows")
        )
        often = work.keep(counts.filter("places > 1").select("anchor", "m", "rows"), "piece-anchors")
        again = work.keep(join_counted(made, often, ["anchor"], "rows").drop("rows"), "open-pieces")
        crowded = (F.col("m") > CROWDED) & F.lit(width > 1)
        done.append(again.filter(~crowded).drop("m").select(*made.columns))
        left = again.filter(crowded).drop("m").select(*made.columns)
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _lifted(matched: DataFrame, narrow: DataFrame) -> DataFrame:
    """Runs of pieces as runs of the stretches they are of."""
    found = matched.filter("narrow").select("anchor", "same", "rows", "starts", "stops")
    both = join_counted(narrow.drop("off", "data"), found, ["anchor", "same"], "rows")
    moved = [F.transform(name, lambda x: x + F.col("shift")).alias(name) for name in ("starts", "stops")]
    whole = both.groupBy(F.col("whole_anchor").alias("anchor"), F.col("whole_same").alias("same"))
    runs = whole.agg(F.first("n").alias("n"), F.collect_list(F.struct(*moved)).alias("runs"))
    return runs.select("anchor", "same", "n", F.flatten("runs.starts").alias("starts"), F.flatten("runs.stops").alias("stops"))


def repeated_windows(texts: DataFrame, work: Staged) -> DataFrame:
    """Rows doc, first, last: runs of windows that also start elsewhere."""
    found, firsts = open_stretches(texts, work)
    words = firsts.agg(F.sum(F.col("top.size") + LENGTH - 1)).first()[0] or 0
    crowded = work.keep(firsts.groupBy("anchor").count().filter(f"count > {CROWDED}"), "crowded")
    small = None
    if not crowded.isEmpty():
        many = join_counted(firsts, crowded, ["anchor"], "count")
        small = narrowed(work.keep(_cut_out(texts, many), "cut"), work)
        firsts = firsts.join(crowded, "anchor", "left_anti")
    columns = ["anchor", "same", "narrow", "rows", "n", "off", "data"]
    cut = _cut_out(texts, firsts).withColumns({"narrow": F.lit(False), "rows": F.col("n")}).select(*columns)
    if small is not None:
        different = small.groupBy("anchor", "same").agg(
            F.lit(True).alias("narrow"), F.count("*").alias("rows"), F.sum("n").alias("n"),
            F.first("off").alias("off"), F.first("data").alias("data"),
        )
        cut = cut.unionByName(different)
    shard = F.pmod(F.xxhash64("anchor"), F.lit(int(words) // SHARD_WORDS + 1)).cast("int")
    matched = work.keep(
        cut.select(shard.alias("shard"), *columns).repartition("shard").sortWithinPartitions("shard")
        .mapInPandas(_matched, "anchor long, same long, narrow boolean, rows long, starts array<int>, stops array<int>"),
        "matched",
    )
    runs = matched.filter("not narrow").select("anchor", "same", F.col("rows").alias("n"), "starts", "stops")
    if small is not None:
        runs = work.keep(runs.unionByName(_lifted(matched, small)), "runs")
    work.settle()
    places = join_counted(found, runs, ["anchor", "same"], "n")
    each = places.select("doc", "first", F.explode(F.arrays_zip("starts", "stops")).alias("_r"))
    return each.select("doc", (F.col("first") + F.col("_r.starts")).alias("first"), (F.col("first") + F.col("_r.stops")).alias("last"))


def _remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for doc_id, text, runs in zip(part["doc_id"], part["text"], part["runs"], strict=True):
            words = words_of(text)
            n, gone = len(words), 0
            if runs is not None and len(runs):
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, [r["first"] for r in runs], 1)
                np.add.at(steps, [r["last"] + LENGTH for r in runs], -1)
                covered = np.cumsum(steps[:-1]) > 0
                gone = int(covered.sum())
                words = [words[i] for i in np.flatnonzero(~covered).tolist()]
            rows.append((doc_id, n, gone, b" ".join(words)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8, words joined by one space) of every row of docs.

    A word is removed when a window of LENGTH words that covers it also starts anywhere else, in
    the same document or another; windows are judged on the input. Null texts have no words; texts
    of fewer than LENGTH words stay; of repeated rows (also with one id) each counts as a document
    of its own; an empty table gives no rows; other columns of docs are not read.
    """
    work = Staged(docs.sparkSession, "passages")
    texts = _keyed(docs, work)
    runs = work.keep(repeated_windows(texts, work), "removed")
    by_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return texts.join(by_doc, "doc", "left").select("doc_id", "text", "runs").mapInPandas(
        _remove, "doc_id long, n_words long, n_removed long, kept binary"
    )


def report(docs: DataFrame) -> DataFrame:
    return remove_passages(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
