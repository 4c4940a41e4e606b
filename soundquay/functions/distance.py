"""Edit distances between token arrays and strings, kept inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundquay.functions.bind import let


#: Characters that can stand for a word; a pair with more distinct words on both sides is an error.
MOST_SYMBOLS = 1_000_000
#: Widths of the band in which a distance is looked for, one after the other.
_BANDS = (16, 256, 4096)


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two strings, in time that follows the length times the number of edits.

    A band around the diagonal is tried first; it grows until the distance fits.
    """

    def within(x: Column, y: Column, bands: tuple[int, ...]) -> Column:
        if not bands:
            return F.levenshtein(x, y)
        found = F.levenshtein(x, y, bands[0])
        return let(found, lambda d: F.when(d >= 0, d).otherwise(within(x, y, bands[1:])))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: within(p["a"], p["b"], _BANDS))


def word_symbols(words: Column, vocabulary: Column) -> Column:
    """Write each word as one character: its place in ``vocabulary``, or one for all other words.

    Built through UTF-32 so that a pair may hold a million distinct words; places past the
    surrogate block are moved behind it.
    """
    place = F.transform(words, lambda w: F.array_position(vocabulary, w).cast("int"))
    codes = F.transform(
        place,
        lambda i: F.lpad(F.hex(F.when(i < 50000, i + 255).otherwise(i + 65536)), 8, "0"),
    )
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance of two token arrays (inserts, deletes, replacements).

    Words of one side only match nothing and need no symbol of their own; those of ``hyp`` are
    written as blanks, so that they differ from those of ``ref``.
    """
    too_many = F.raise_error(f"both sides of a pair hold more than {MOST_SYMBOLS} distinct words").cast("int")
    distance = let(
        F.array_intersect(ref, hyp),
        lambda v: F.when(F.size(v) > MOST_SYMBOLS, too_many).otherwise(
            edit_distance(word_symbols(ref, v), F.translate(word_symbols(hyp, v), "\u00ff", " "))
        ),
    )
    return (
        F.when(ref == hyp, F.lit(0))
        .when(F.size(ref) == 0, F.size(hyp))
        .when(F.size(hyp) == 0, F.size(ref))
        .otherwise(distance)
        .cast("long")
    )


def char_edits(ref: Column, hyp: Column) -> Column:
    return F.when(ref == hyp, F.lit(0)).otherwise(edit_distance(ref, hyp)).cast("long")


_WORD_BITS = 60


def _common_by_rows(a: Column, b: Column) -> Column:
    """One dynamic-programming row per character of ``a``, folded with array functions."""
    right = F.filter(F.split(b, ""), lambda c: c != "")
    left = F.filter(F.split(a, ""), lambda c: c != "")
    zeros = F.array_repeat(F.lit(0), F.length(b) + 1)
    pairs = F.transform(right, lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def next_row(row: Column, char: Column, pairs: Column) -> Column:
        def cell(acc: Column, c_i: Column) -> Column:
            i = c_i["i"]
            best = F.when(c_i["c"] == char, F.get(row, i) + 1).otherwise(
                F.greatest(F.get(row, i + 1), F.element_at(acc, -1))
            )
            return F.concat(acc, F.array(best))

        return F.aggregate(pairs, F.array(F.lit(0)), cell)

    last = let(
        pairs, lambda ps: F.aggregate(left, zeros, lambda row, char: next_row(row, char, ps))
    )
    return F.element_at(last, -1)


def _shift_left(places: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), places)


def _common_by_bits(a: Column, b: Column) -> Column:
    """The row kept as the bits of one long: a cleared bit marks a step of the row."""
    full = _shift_left(F.length(a)) - 1

    def places(left: Column, char: Column) -> Column:
        bits = F.transform(
            left,
            lambda c, i: F.when(c == char, _shift_left(i)).otherwise(F.lit(0).cast("long")),
        )
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(v))

    def step(row: Column, mask: Column) -> Column:
        hit = row.bitwiseAND(mask)
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(full)

    right = F.filter(F.split(b, ""), lambda c: c != "")
    masks = let(
        F.filter(F.split(a, ""), lambda c: c != ""),
        lambda left: F.transform(right, lambda c: places(left, c)),
    )
    return (F.length(a) - F.bit_count(F.aggregate(masks, full, step))).cast("int")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short strings."""
    return F.when(F.length(a) <= _WORD_BITS, _common_by_bits(a, b)).otherwise(
        _common_by_rows(a, b)
    )


def indel_distance(a: Column, b: Column) -> Column:
    """Distance with inserts and deletes only.

    When the plain edit distance equals the difference in length, its script has no replacement
    and both distances are the same; the common subsequence is only needed otherwise.
    """
    by_common = F.length(a) + F.length(b) - 2 * common_subsequence(a, b)
    gap = F.abs(F.length(a) - F.length(b))
    return let(
        F.levenshtein(a, b), lambda plain: F.when(plain == gap, plain).otherwise(by_common)
    ).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Indel similarity in percent; two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        (1.0 - indel_distance(a, b) / total) * 100.0
    )


def contains_run(words: Column, run: Column) -> Column:
    """True when ``run`` occurs as a contiguous slice of ``words``."""
    n = F.size(run)
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when((n == 0) | (n > F.size(words)), F.lit(False)).otherwise(
        F.exists(starts, lambda i: F.slice(words, i, n) == run)
    )
