"""Edit distances and alignments of whole Arrow batches, with bit vectors over all rows at once.

A batch of strings becomes one array of codes and the number of codes of each row. Column after
column of the distance tables is worked out for all rows together (bit vectors, Myers 1999, with
as many 64-bit words as the left side needs). Longer rows are left to the caller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Longest side, in characters or words, of rows that are worked out in batches.
MOST = 512
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _strings(values: pa.Array) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(values, "").cast(pa.string())


def _plain(codes: np.ndarray) -> np.ndarray:
    """Codes from one on without gaps, in the smallest type that holds them."""
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    number = np.cumsum(seen)
    return number.astype(np.min_scalar_type(int(number[-1])))[codes]


def characters(a: pa.Array, b: pa.Array) -> list[np.ndarray]:
    """Codes and lengths of a, codes and lengths of b; the least code is one."""
    sides = [_strings(x) for x in (a, b)]
    codes = [np.frombuffer("".join(x.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32) for x in sides]
    lengths = [pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in sides]
    plain = _plain(np.concatenate(codes))
    return [plain[: len(codes[0])], lengths[0], plain[len(codes[0]) :], lengths[1]]


def words(a: pa.Array, b: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The same for words between single blanks, and the words by their code less one."""
    parts, lengths = [], []
    for side in (a, b):
        split = pc.split_pattern(_strings(side), " ")
        flat = split.flatten()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        count = np.zeros(len(split), np.int64)
        rows = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        np.add.at(count, rows[full], 1)
        parts.append(flat.filter(pa.array(full)))
        lengths.append(count)
    coded = pa.concat_arrays(parts).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + np.uint32(1)
    n = len(parts[0])
    return [codes[:n], lengths[0], codes[n:], lengths[1]], coded.dictionary


def _table(codes: np.ndarray, lengths: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """One line of codes for each of some rows, filled up with zeros."""
    out = np.zeros((len(rows), width), codes.dtype)
    at = np.arange(width) < lengths[rows][:, None]
    starts = (np.cumsum(lengths) - lengths)[rows]
    out[at] = codes[(starts[:, None] + np.arange(width))[at]]
    return out


def _equal(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits where a line of ``left`` (a multiple of 64 wide) has the code of its row, as 64-bit words."""
    return np.packbits(left == right[:, None], axis=1, bitorder="little").view("<u8")


def _distances_of(left: np.ndarray, right: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of lines; rows in falling order of n, at least one code on the left."""
    size = left.shape[1] // 64
    last, bit = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    ends = [last == w for w in range(size)]
    plus = [np.full(len(m), ~np.uint64(0)) for _ in range(size)]
    minus = [np.zeros(len(m), np.uint64) for _ in range(size)]
    score = m.copy()
    for j in range(int(n.max(initial=0))):
        k = int(np.searchsorted(-n, -j, "left"))  # rows with more than j codes
        same = _equal(left[:k], right[:k, j])
        rise: np.ndarray | np.uint64 = _ONE
        fall: np.ndarray | np.uint64 = np.uint64(0)
        for w in range(size):
            p, q, e = plus[w][:k], minus[w][:k], same[:, w]
            x = e | q
            e = e | fall
            h = (((e & p) + p) ^ p) | e
            up, down = q | ~(h | p), p & h
            here = ends[w][:k]
            step = ((up >> bit[:k]) & _ONE).astype(np.int64) - ((down >> bit[:k]) & _ONE).astype(np.int64)
            score[:k] += np.where(here, step, 0)
            up, down, rise, fall = (up << _ONE) | rise, (down << _ONE) | fall, up >> _TOP, down >> _TOP
            plus[w][:k] = down | ~(x | up)
            minus[w][:k] = up & x
    return score


def distances(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distance of each row."""
    out = np.where(m == 0, n, m)
    size = (m + 63) // 64
    for w in np.unique(size[(m > 0) & (n > 0)]).tolist():
        rows = np.flatnonzero((size == w) & (n > 0))
        rows = rows[np.argsort(-n[rows], kind="stable")]
        left, right = _table(a, m, rows, w * 64), _table(b, n, rows, int(n[rows].max()))
        out[rows] = _distances_of(left, right, m[rows], n[rows])
    return out


def replaced(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place on the left and on the right of the replaced codes of one optimal alignment each.

    Common heads and tails are left out first. Reading back from the end, a deletion is taken where
    it is optimal, then an insertion where the diagonal is worse, then the diagonal. Rows whose left
    side has more than 64 codes between head and tail come back last, as rows to be done otherwise.
    """
    rows = np.arange(len(m))
    wide = int(max(m.max(initial=0), n.max(initial=0), 1))
    left, right = _table(a, m, rows, wide), _table(b, n, rows, wide)
    least, at = np.minimum(m, n), np.arange(wide)
    head = np.logical_and.accumulate((left == right) & (at < least[:, None]), axis=1).sum(axis=1)
    back = [np.take_along_axis(x, np.maximum(k[:, None] - 1 - at, 0), 1) for x, k in ((left, m), (right, n))]
    tail = np.logical_and.accumulate((back[0] == back[1]) & (at < (least - head)[:, None]), axis=1).sum(axis=1)
    m, n = m - head - tail, n - head - tail
    long = np.flatnonzero((m > 64) & (n > 0))
    rows = np.flatnonzero((m > 0) & (n > 0) & (m <= 64))
    rows = rows[np.argsort(-n[rows], kind="stable")]
    if not len(rows):
        return (*[np.zeros(0, np.int64)] * 3, long)
    head, m, n = head[rows], m[rows], n[rows]
    places = head[:, None] + np.arange(64)
    left = np.where(np.arange(64) < m[:, None], np.take_along_axis(left[rows], np.minimum(places, wide - 1), 1), 0)
    places = head[:, None] + np.arange(int(n.max()))
    right = np.take_along_axis(right[rows], np.minimum(places, wide - 1), 1)
    rises = np.zeros((int(n.max()) + 1, len(rows)), np.uint64)
    falls = np.zeros_like(rises)
    rises[0] = ~np.uint64(0)
    for j in range(int(n.max())):
        k = int(np.searchsorted(-n, -j, "left"))
        p, q, e = rises[j, :k], falls[j, :k], _equal(left[:k], right[:k, j])[:, 0]
        h = (((e & p) + p) ^ p) | e | q
        up, down = q | ~(h | p), p & h
        up, down = (up << _ONE) | _ONE, down << _ONE
        rises[j + 1, :k], falls[j + 1, :k] = down | ~(h | up), up & h
    found = []
    active, i, j = np.arange(len(rows)), m.copy(), n.copy()
    while len(active):
        bit = (i - 1).astype(np.uint64)
        deleted = (rises[j, active] >> bit) & _ONE == _ONE
        inserted = ~deleted & ((falls[j - 1, active] >> bit) & _ONE == _ONE)
        both = ~(deleted | inserted)
        differ = both & (left[active, i - 1] != right[active, j - 1])
        found.append((active[differ], i[differ] - 1, j[differ] - 1))
        i, j = i - (deleted | both), j - (inserted | both)
        on = (i > 0) & (j > 0)
        active, i, j = active[on], i[on], j[on]
    of, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows[of], head[of] + i, head[of] + j, long


@F.arrow_udf(LongType())
def _char_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(distances(*characters(a, b)), pa.int64())


@F.arrow_udf(LongType())
def _word_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(distances(*words(a, b)[0]), pa.int64())


def _in_batches(distance, a: Column, b: Column, longer: Column) -> Column:
    short = (F.length(a) <= MOST) & (F.length(b) <= MOST)
    return F.when(short, distance(F.when(short, a), F.when(short, b))).otherwise(longer)


def char_distance(a: Column, b: Column, longer: Column) -> Column:
    """Edit distance of two strings; ``longer`` where one has more than MOST characters."""
    return _in_batches(_char_distance, a, b, longer)


def word_distance(a: Column, b: Column, longer: Column) -> Column:
    """The same in words between single blanks."""
    return _in_batches(_word_distance, a, b, longer)
