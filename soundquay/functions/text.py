"""Text columns: normal form, tokens, accent folding and sound keys.

Everything here is a ``Column -> Column`` expression on the whole text of a row, so it stays
inside the JVM. Sound keys are computed on the whole blank-joined token string at once: no
rewrite looks across a blank, which is cheaper than one call per token.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundquay.functions.bind import let

# The tables below are derived from the Unicode database rather than listed.
_INNER_APOSTROPHE = "\ue000"  # private-use stand-ins while a text is being rewritten
_ENYE = "\ue001"
SEPARATOR = "\ue004"
_HANGUL = range(0xAC00, 0xD7A4)  # composed and taken apart by arithmetic
_VOWELS, _FINALS = 21, 28
#: Cheap tests that spare most texts the rest: no form changes ASCII, none composes below U+0300.
_BEYOND_ASCII, _BEYOND_LATIN = r"[^\x00-\x7f]", r"[\x{300}-\x{10ffff}]"


def _letters() -> Iterator[str]:
    """All characters but the surrogates and Hangul syllables."""
    return (chr(c) for c in range(0xA0, 0x30000) if not 0xD800 <= c < 0xE000 and c not in _HANGUL)


def _class(chars: Iterable[str]) -> str:
    """A regular expression of single characters, as ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


@lru_cache(maxsize=1)
def _canonical() -> tuple[tuple, tuple, tuple, str]:
    """Full decompositions, primary compositions, classes of marks, and what NFC changes by itself."""
    apart, pairs, marks, changed = [], [], [], []
    for char in _letters():
        parts = unicodedata.normalize("NFD", char)
        if parts != char:
            apart.append((char, parts))
            own = unicodedata.decomposition(char).split()
            if len(own) == 2 and unicodedata.normalize("NFC", char) == char:
                pairs.append((chr(int(own[0], 16)) + chr(int(own[1], 16)), char))
        if unicodedata.combining(char):
            marks.append((char, str(unicodedata.combining(char))))
        if unicodedata.normalize("NFC", char) != char:
            changed.append(char)
    return tuple(apart), tuple(pairs), tuple(marks), _class(changed)


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, tuple[tuple[str, str], ...], str, str]:
    """One-to-one letters (for ``translate``), one-to-many expansions, their class, that of the marks."""
    source, target, longer, marks = [], [], [], []
    for char in _letters():
        if unicodedata.combining(char):
            marks.append(char)
            continue
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char:
            continue
        if not plain:  # a mark in another width
            marks.append(char)
        elif len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            longer.append((char, plain))
    return "".join(source), "".join(target), tuple(longer), _class(c for c, _ in longer), _class(marks)


def _literal_map(pairs: tuple[tuple[str, str], ...]) -> Column:
    """A constant string map as one folded literal."""
    packed = "\ue003".join(f"{key}\ue002{value}" for key, value in pairs)
    return F.str_to_map(F.lit(packed), F.lit("\ue003"), F.lit("\ue002"))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _compose_unit(unit: Column) -> Column:
    """Canonical form of a letter with its marks: taken apart, marks in order of class, put together."""
    apart, pairs, marks, _ = (_literal_map(x) if isinstance(x, tuple) else x for x in _canonical())
    parts = F.flatten(F.transform(_characters(unit), lambda c: _characters(F.coalesce(F.element_at(apart, c), c))))
    classed = F.transform(parts, lambda c: F.struct(c.alias("c"), F.coalesce(F.element_at(marks, c).cast("int"), F.lit(0)).alias("k")))

    def ordered(all_: Column) -> Column:
        # marks move inside the run that follows a character of class 0
        return F.array_sort(F.transform(all_, lambda x, i: F.struct(
            F.size(F.filter(F.slice(all_, 1, i + 1), lambda y: y["k"] == 0)).alias("run"),
            x["k"].alias("k"), i.alias("i"), x["c"].alias("c"))))

    def step(done: Column, x: Column) -> Column:
        joined = F.element_at(pairs, F.concat(done["base"], x["c"]))
        free = (done["last"] < x["k"]) | (done["rest"] == "")
        starts = x["k"] == 0
        kept = F.concat(done["out"], done["base"], done["rest"])

        def choose(composed: Column, base: Column, rest: Column, last: Column, out: Column) -> Column:
            return F.struct(out.alias("out"), base.alias("base"), rest.alias("rest"), last.alias("last"))

        return (
            F.when(free & joined.isNotNull(), choose(joined, joined, done["rest"], done["last"], done["out"]))
            .when(starts, choose(joined, x["c"], F.lit(""), F.lit(0), kept))
            .otherwise(choose(joined, done["base"], F.concat(done["rest"], x["c"]), x["k"], done["out"]))
        )

    zero = F.struct(F.lit("").alias("out"), F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    return let(classed, lambda all_: F.aggregate(
        ordered(all_), zero, step, lambda d: F.concat(d["out"], d["base"], d["rest"])))


def _compose_hangul(text: Column) -> Column:
    """Conjoining letters to syllables."""
    parts = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?|[\uac00-\ud7a3][\u11a8-\u11c2]?|(?s:.)"

    def syllable(u: Column) -> Column:
        first, second = F.ascii(u), F.ascii(F.substring(u, 2, 1))
        from_letters = (
            _HANGUL.start + ((first - 0x1100) * _VOWELS + (second - 0x1161)) * _FINALS
            + F.when(F.length(u) == 3, F.ascii(F.substring(u, 3, 1)) - 0x11A7).otherwise(0)
        )
        open_ = (first - _HANGUL.start) % _FINALS == 0
        return (
            F.when(F.length(u) == 1, u)
            .when(first < 0x1200, _character(from_letters))
            .when(open_, _character(first + second - 0x11A7))
            .otherwise(u)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(parts), F.lit(0)), syllable), "")


def nfc(text: Column) -> Column:
    """Composed form. Rows without combining marks or characters that the form replaces pass untouched."""
    changed = _canonical()[3]

    def compose(value: Column) -> Column:
        units = F.regexp_extract_all(value, F.lit(r"(?s)(\P{M}\p{M}*|\p{M}+)"), F.lit(1))
        composed = F.array_join(F.transform(units, lambda u: F.when(
            (F.length(u) == 1) & ~u.rlike(changed), u).otherwise(_compose_unit(u))), "")
        marked = F.when(value.rlike(rf"\p{{M}}|{changed}"), composed).otherwise(value)
        whole = let(marked, lambda v: F.when(v.rlike("[\u1161-\u1175\u11a8-\u11c2]"), _compose_hangul(v)).otherwise(v))
        return F.when(value.rlike(_BEYOND_LATIN), whole).otherwise(value)

    return let(text, compose)


def _clean(text: Column, lang: Column, keep: str = "") -> Column:
    def guard_apostrophes(low: Column) -> Column:
        marked = F.regexp_replace(
            low, r"(?<=[\p{L}\p{N}])['’](?=[\p{L}\p{N}])", _INNER_APOSTROPHE
        )
        return F.when((lang == "en") & low.rlike("['’]"), marked).otherwise(low)

    marked = let(F.translate(F.lower(nfc(text)), _INNER_APOSTROPHE, " "), guard_apostrophes)
    blanked = F.regexp_replace(
        marked, r"[^\p{L}\p{N}" + _INNER_APOSTROPHE + keep + "]+", " "
    )
    return F.trim(F.translate(blanked, _INNER_APOSTROPHE, "'"))


def normalize(text: Column, lang: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed; English keeps inner apostrophes."""
    return _clean(text, lang)


def normalized_words(raw: Column, lang: Column, fold: bool = False) -> Column:
    """The normal form (optionally without accents) of each word of an array.

    The words are cleaned as one string with a separator between them: one pass per text
    instead of one call per word. A word may come out empty or as several words.
    """
    joined = F.array_join(raw, SEPARATOR)
    cleaned = F.regexp_replace(_clean(joined, lang, SEPARATOR), f" ?{SEPARATOR} ?", SEPARATOR)
    plain = fold_diacritics(cleaned) if fold else cleaned
    return F.slice(F.split(plain, SEPARATOR), F.lit(1), F.size(raw))  # no words, no parts


def split_words(text: Column) -> Column:
    """Words of a text that holds single blanks only; an empty text gives an empty array."""
    return F.array_remove(F.split(text, " "), "")


def raw_words(text: Column) -> Column:
    """White-space split of a raw text (no empty words)."""
    return split_words(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column, lang: Column) -> Column:
    return split_words(normalize(text, lang))


def fold_diacritics(text: Column) -> Column:
    """Compatibility-decompose and drop the marks: ``café`` -> ``cafe``, ``ñ`` -> ``n``."""
    source, target, longer, expands, marks = _foldings()
    table = _literal_map(longer)

    def letters(c: Column) -> Column:
        code = F.ascii(c) - _HANGUL.start
        first, second, third = F.floor(code / (_VOWELS * _FINALS)), F.floor(code / _FINALS) % _VOWELS, code % _FINALS
        return F.when(F.ascii(c).between(_HANGUL.start, _HANGUL.stop - 1), F.concat(
            _character(first + 0x1100), _character(second + 0x1161),
            F.when(third > 0, _character(third + 0x11A7)).otherwise(""))).otherwise(c)

    def finish(folded: Column) -> Column:
        expanded = F.array_join(
            F.transform(_characters(folded), lambda c: letters(F.coalesce(F.element_at(table, c), c))), ""
        )
        return F.when(folded.rlike(rf"{expands}|[\uac00-\ud7a3]"), expanded).otherwise(folded)

    def fold(plain: Column) -> Column:
        rest = let(F.regexp_replace(plain, marks, ""), finish)
        return F.when(plain.rlike(_BEYOND_ASCII), rest).otherwise(plain)

    return let(F.when(text.rlike(_BEYOND_ASCII), F.translate(text, source, target)).otherwise(text), fold)


def _fold_keeping_enye(text: Column) -> Column:
    return F.translate(fold_diacritics(F.translate(text, "ñ", _ENYE)), _ENYE, "ñ")


# --- fixed values: Spanish sound rewrites, in order (pattern, replacement) ---
_ES_REWRITES = (
    ("v", "b"),
    ("x", "ks"),
    ("ch", "x"),
    ("h", ""),
    ("ll", "y"),
    ("z", "s"),
    ("c(?=[ei])", "s"),
    ("qu", "k"),
    ("c", "k"),
    ("g(?=[ei])", "j"),
    ("w", "u"),
    ("ñ", "n"),
    (r"([^ ])\1+", "$1"),
)


def es_key(words: Column) -> Column:
    """Spanish sound key of each blank-separated word, blanks kept."""
    out = _fold_keeping_enye(F.lower(words))
    for pattern, replacement in _ES_REWRITES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


_START = r"(?<![^ ])"
_END = r"(?![^ ])"

# English sound key after the published Metaphone rules. Lower-case letters are still to be
# read, upper-case letters (and 0) are codes already written, "~" is a letter that is silent
# but still separates its neighbours.
_EN_REWRITES = (
    (r"[^a-z ]", "~"),
    (_START + r"(?:[kgp](?=n)|w(?=r)|a(?=e))", ""),
    (_START + r"([aeiou])(?=\1)", "~"),
    (r"([^ch \x7e])(?=\1)", ""),
    (r"t(?=ch)", "~"),
    (r"c(?=ia)", "X"),
    (r"ch", "X"),
    (r"cy", "S"),
    (r"c(?=[ie])", "S"),
    (r"ck|c", "K"),
    (r"dgy", "J"),
    (r"dg(?=[ie])", "J"),
    (r"g(?=[iey])", "J"),
    (r"gh(?![aeiou])", "~"),
    (r"g(?=n" + _END + ")", "~"),
    (r"ph", "F"),
    (_START + r"x(?=h|i[oa])", "X"),
    (_START + r"x", "S"),
    (r"x", "KS"),
    (r"sh|s(?=i[oa])", "X"),
    (r"th", "0"),
    (r"t(?=i[oa])", "X"),
    (_START + r"wh|w(?=[aeiou])", "W"),
    (r"y(?=[aeiou])", "Y"),
    (r"hh+", "H"),
    (r"(?<=[aeiou])h(?![aeiou])", "~"),
    (r"h", "H"),
    (r"(?<=m)b" + _END, "~"),
)


def en_key(words: Column) -> Column:
    """English sound key of each blank-separated word; a word without a key keeps its letters."""

    def rewritten(plain: Column) -> Column:
        out = plain
        for pattern, replacement in _EN_REWRITES:
            out = F.regexp_replace(out, pattern, replacement)
        out = F.translate(out, "bdfgjklmnpqrstvz", "BTFKJKLMNPKRSTFS")
        out = F.regexp_replace(out, r"(?<=[^ ])[^A-Z0 ]+", "")
        return F.upper(F.regexp_replace(out, r"[^A-Z0aeiou ]", ""))

    def filled(plain: Column, out: Column) -> Column:
        keyless = F.concat(F.lit(" "), out, F.lit(" ")).contains("  ")
        keyed = F.array_join(
            F.zip_with(
                F.split(out, " "),
                F.split(plain, " "),
                lambda key, word: F.when(key == "", word).otherwise(key),
            ),
            " ",
        )
        return F.when(keyless, keyed).otherwise(out)

    return let(fold_diacritics(F.lower(words)), lambda plain: let(rewritten(plain), lambda out: filled(plain, out)))


def phonetic_key(words: Column, lang: Column) -> Column:
    return F.when(lang == "es", es_key(words)).otherwise(en_key(words))


@lru_cache(maxsize=1)
def _word_rewrites() -> dict[str, list[tuple[re.Pattern, str]]]:
    made = {"es": _ES_REWRITES, "en": _EN_REWRITES}
    return {lang: [(re.compile(a), b.replace("$", "\\")) for a, b in rules] for lang, rules in made.items()}


_EN_LETTERS = str.maketrans("bdfgjklmnpqrstvz", "BTFKJKLMNPKRSTFS")


@lru_cache(maxsize=1 << 17)
def word_key(word: str, lang: str) -> str:
    """The sound key of one word in the form that sound_letters() gives it, by the same rewrites."""
    out = word
    for pattern, replacement in _word_rewrites()["es" if lang == "es" else "en"]:
        out = pattern.sub(replacement, out)
    if lang != "es":
        out = re.sub(r"(?<=[^ ])[^A-Z0 ]+", "", out.translate(_EN_LETTERS))
        out = re.sub(r"[^A-Z0aeiou ]", "", out).upper() or word
    return out


def sound_letters(words: Column, lang: Column) -> Column:
    """Words as the rewrites of the sound keys take them: lower case, without marks (Spanish keeps ñ)."""
    return F.when(lang == "es", _fold_keeping_enye(F.lower(words))).otherwise(fold_diacritics(F.lower(words)))


def match_case(source: Column, replacement: Column) -> Column:
    """Carry the casing of ``source`` over to ``replacement``."""
    first = F.substring(source, 1, 1)
    cased = F.upper(source) != F.lower(source)
    return (
        F.when(cased & (source == F.upper(source)), F.upper(replacement))
        .when(
            (F.upper(first) != F.lower(first)) & (first == F.upper(first)),
            F.concat(
                F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1 << 30)
            ),
        )
        .otherwise(replacement)
    )


def family(subtype: Column, clean: str = "CLEAN") -> Column:
    return F.when(subtype == clean, subtype).otherwise(F.substring(subtype, 1, 1))


def speaker_id(path: Column) -> Column:
    """Leading number of ``123-456-...`` names, else the first two ``_`` parts of the stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    number = F.regexp_extract(stem, r"^(\d+)-", 1)
    return F.when(number != "", number).otherwise(F.substring_index(stem, "_", 2))


def hash_number(*parts: Column, seed: int = 0) -> Column:
    """A repeatable 48-bit number from the given key columns, independent of row order."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    digest = F.md5(joined.cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def uniform_hash(*parts: Column, seed: int = 0) -> Column:
    """The same number scaled to [0, 1)."""
    return hash_number(*parts, seed=seed) / F.lit(float(1 << 48))


def md5_order(key: Column, seed: int | str) -> Column:
    """A repeatable shuffle key that other engines can compute as well."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))
