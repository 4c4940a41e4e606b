"""One pass over a text with a compiled lexicon and rule set.

For tables of a checked size: phrases of the lexicon and the rules are compiled into token
automata (tries with failure links) and a piece index for fuzzy terms, broadcast once, and walked
once per text in Arrow batches. Texts are read once and never shuffled. ``correction.correct`` takes
this way up to MOST_ENTRIES rows and joins the tables beyond.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from soundquay import fixed

#: Rows of lexicon and rules together that are compiled (some 20 MB in each worker).
MOST_ENTRIES = 100_000
_MEMO = 1 << 17
#: Characters of a text whose result is kept; rows that are held as Python objects at a time.
_SHORT, _SLICE = 128, 256
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_APOSTROPHE = re.compile(r"(?<=[^\W_])['’](?=[^\W_])")
_INNER = "\ue000"  # stands for an inner apostrophe meanwhile
_OTHER = re.compile(rf"[^\w{_INNER}]+|_+")


@lru_cache(maxsize=_MEMO)
def normal_form(text: str, lang: str) -> str:
    """Composed, lower case, all but letters and digits to single blanks; English inner apostrophes stay."""
    low = unicodedata.normalize("NFC", text).lower().replace(_INNER, " ")
    if lang == "en":
        low = _APOSTROPHE.sub(_INNER, low)
    return " ".join(_OTHER.sub(" ", low).split()).replace(_INNER, "'")


@lru_cache(maxsize=_MEMO)
def folded_form(text: str, lang: str) -> str:
    """The normal form without marks."""
    plain = unicodedata.normalize("NFKD", normal_form(text, lang))
    return "".join(c for c in plain if not unicodedata.combining(c))


class TokenAutomaton:
    """Phrases of tokens as a trie with failure links: all places of all phrases in one walk."""

    def __init__(self, phrases: Sequence[tuple[tuple[str, ...], int]]):
        self.step: list[dict[str, int]] = [{}]
        self.back = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for words, value in phrases:
            at = 0
            for word in words:
                if word not in self.step[at]:
                    self.step[at][word] = len(self.step)
                    self.step.append({})
                    self.back.append(0)
                    self.ends.append([])
                at = self.step[at][word]
            self.ends[at].append((len(words), value))
        queue = deque(self.step[0].values())
        while queue:
            at = queue.popleft()
            for word, to in self.step[at].items():
                queue.append(to)
                back = self.back[at]
                while back and word not in self.step[back]:
                    back = self.back[back]
                self.back[to] = self.step[back].get(word, 0)
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]

    def find(self, words: Sequence[str]) -> Iterator[tuple[int, int]]:
        """(value, first word) of every place, in the order of the last words."""
        at = 0
        for i, word in enumerate(words):
            while at and word not in self.step[at]:
                at = self.back[at]
            at = self.step[at].get(word, 0)
            for n, value in self.ends[at]:
                yield value, i - n + 1


def indel(a: str, b: str) -> int:
    """Edit distance with inserts and deletes only, by bit vectors."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


class Terms:
    """The lexicon of one language: known forms, and the nearest term of a group of words.

    A term is cut into one piece more than edits are allowed for its length; a group within these
    edits holds one of the pieces unchanged, moved by at most as many places.
    """

    def __init__(self, rows: Sequence[tuple[int, str, str]]):
        """``rows``: words, normal form and canonical form, in the order of the lexicon."""
        self.rows = rows
        self.known = {norm for _, norm, _ in rows}
        self.pieces: dict[tuple[int, int, int, str], list[int]] = {}
        self.sizes: dict[int, set[int]] = {}
        self.memo: dict[tuple[str, int], tuple[str, int, int] | None] = {}
        for at, (n, norm, _) in enumerate(rows):
            size = len(norm)
            self.sizes.setdefault(n, set()).add(size)
            for j, (start, stop) in enumerate(self._cuts(size, n)):
                self.pieces.setdefault((n, size, j, norm[start:stop]), []).append(at)

    @staticmethod
    def _percent(n: int) -> float:
        return fixed.FUZZY_PERCENT[1] if n == 1 else fixed.FUZZY_PERCENT[2]

    def _edits(self, size: int, n: int) -> int:
        """The most edits of a term of this size and any group that is similar enough."""
        percent = self._percent(n)
        return int(2 * size * (100 - percent) // percent)

    def _cuts(self, size: int, n: int) -> list[tuple[int, int]]:
        parts = self._edits(size, n) + 1
        return [(size * j // parts, size * (j + 1) // parts) for j in range(parts)]

    def nearest(self, gram: str, n: int) -> tuple[str, int, int] | None:
        """Canonical form, distance and total length; the earliest of the most similar terms."""
        key = (gram, n)
        if key not in self.memo:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[key] = self._nearest(gram, n)
        return self.memo[key]

    def _nearest(self, gram: str, n: int) -> tuple[str, int, int] | None:
        size, found = len(gram), set()
        for other in range(size - fixed.MAX_LENGTH_GAP, size + fixed.MAX_LENGTH_GAP + 1):
            if other not in self.sizes.get(n, ()):
                continue
            cuts = self._cuts(other, n)
            for j, (start, stop) in enumerate(cuts):
                for shift in range(-len(cuts) + 1, len(cuts)):
                    if 0 <= start + shift and stop + shift <= size:
                        found.update(self.pieces.get((n, other, j, gram[start + shift : stop + shift]), ()))
        best = None
        for at in sorted(found):
            _, norm, canonical = self.rows[at]
            distance, total = indel(gram, norm), size + len(norm)
            close = 100 * distance <= (100 - self._percent(n)) * total
            if close and norm != gram and (best is None or distance * best[2] < best[1] * total):
                best = (canonical, distance, total)
        return best


def _cased(source: str, replacement: str) -> str:
    if source != source.lower() and source == source.upper():
        return replacement.upper()
    first = source[:1]
    if first.upper() != first.lower() and first == first.upper():
        return replacement[:1].upper() + replacement[1:]
    return replacement


def _in_window(phrase: str, window: list[str]) -> bool:
    return phrase in " ".join(window) if " " in phrase else phrase in window


class Matcher:
    """Corrections of a text: (start, end, rule_id, before, after, confidence), in order."""

    def __init__(self, terms: Sequence[tuple], rules: Sequence[tuple]):
        """Terms: lang, n, norm, canonical, in order. Rules: lang, id, wrong, right, any, none, in order."""
        self.terms: dict[str, Terms] = {}
        for lang in {t[0] for t in terms}:
            self.terms[lang] = Terms([t[1:] for t in terms if t[0] == lang])
        self.rules: dict[str, tuple[TokenAutomaton, list]] = {}
        for lang in {r[0] for r in rules}:
            mine = [
                (i, folded_form(wrong, lang), right, [folded_form(p, lang) for p in any_of], [folded_form(p, lang) for p in none_of])
                for code, i, wrong, right, any_of, none_of in rules
                if code == lang
            ]
            phrases = [(tuple(r[1].split(" ")), k) for k, r in enumerate(mine)]
            self.rules[lang] = (TokenAutomaton(phrases), mine)

    @lru_cache(maxsize=_MEMO)
    def _sure(self, gram: str, canonical: str, lang: str) -> float:
        norm = normal_form(canonical, lang)
        total = len(gram) + len(norm)
        share = (1.0 - indel(gram, norm) / total) * 100.0 / 100.0 if total else 1.0
        return float(Decimal(repr(share)).quantize(Decimal("0.001"), ROUND_HALF_UP))

    def _from_terms(self, norm: list[str], lang: str) -> list[tuple]:
        """Groups of three words, then two, then one, from left to right; known terms lock their words."""
        terms, stopwords = self.terms[lang], fixed.STOPWORDS.get(lang, ())
        taken = bytearray(len(norm))
        found = []
        for n in (3, 2, 1):
            for i in range(len(norm) - n + 1):
                if any(taken[i : i + n]):
                    continue
                gram = " ".join(norm[i : i + n])
                if gram in terms.known:
                    taken[i : i + n] = b"\1" * n
                elif n > 1 or gram not in stopwords:
                    near = terms.nearest(gram, n)
                    if near is not None:
                        taken[i : i + n] = b"\1" * n
                        found.append((i, i + n, "lexicon", near[0], self._sure(gram, near[0], lang)))
        return found

    def _from_rules(self, raw: list[str], lang: str, found: list[tuple]) -> list[tuple]:
        """Each rule fires once, at its first free place whose surroundings allow it; rules in order."""
        automaton, rules = self.rules[lang]
        words = [folded_form(w, lang) for w in raw]
        places = sorted(automaton.find(words))
        taken = bytearray(len(raw))
        for start, end, *_ in found:
            taken[start:end] = b"\1" * (end - start)
        fired, out = -1, []
        for k, i in places:
            rule_id, wrong, right, any_of, none_of = rules[k]
            n = wrong.count(" ") + 1
            if k == fired or any(taken[i : i + n]):
                continue
            window = words[max(0, i - fixed.CONTEXT_REACH) : i + fixed.CONTEXT_REACH + 1]
            if any(_in_window(p, window) for p in none_of):
                continue
            if any_of and not any(_in_window(p, window) for p in any_of):
                continue
            fired = k
            taken[i : i + n] = b"\1" * n
            out.append((i, i + n, rule_id, _cased(raw[i], right), 1.0))
        return out

    def made(self, text: str | None, lang: str | None) -> tuple[Sequence[tuple], str | None]:
        """Corrections of a text and the corrected text; short texts, which repeat, are worked out once."""
        return self._short(text, lang) if text is not None and len(text) <= _SHORT else self._made(text, lang)

    @lru_cache(maxsize=_MEMO)
    def _short(self, text: str, lang: str | None) -> tuple[Sequence[tuple], str | None]:
        return self._made(text, lang)

    def _made(self, text: str | None, lang: str | None) -> tuple[Sequence[tuple], str | None]:
        raw = _WORD.findall(text) if text is not None else []
        hits = self.corrections(raw, lang) if raw and lang is not None else []
        return hits, rewritten(raw, hits) if raw and lang in fixed.LANGS else text

    def corrections(self, raw: list[str], lang: str) -> list[tuple]:
        found: list[tuple] = []
        if lang in self.terms:
            found = self._from_terms([normal_form(w, lang) for w in raw], lang)
        if lang in self.rules:
            found = found + self._from_rules(raw, lang, found)
        return [(s, e, rule, " ".join(raw[s:e]), after, sure) for s, e, rule, after, sure in sorted(found)]


def rewritten(raw: list[str], corrections: list[tuple]) -> str:
    out, at = [], 0
    for start, end, _, _, after, _ in corrections:
        out += raw[at:start]
        out.append(after)
        at = end
    return " ".join(out + raw[at:])


def compiled(terms: DataFrame | None, rules: DataFrame | None, mode: str) -> tuple[list, list] | None:
    """The rows of lexicon and rules in order, or None where they are too many to broadcast."""
    sizes = [t.limit(MOST_ENTRIES + 1).count() for t in (terms, rules) if t is not None]
    if sum(sizes) > MOST_ENTRIES:
        return None
    statuses = ["active"] if mode == "replace" else ["active", "approved"]
    term_rows, rule_rows = [], []
    if terms is not None:
        rows = terms.select("lang", "n", "norm", "canonical", "ord").orderBy("lang", "ord").collect()
        term_rows = [tuple(r)[:4] for r in rows]
    if rules is not None:
        rows = rules.filter(F.col("status").isin(*statuses)).orderBy("rule_ord").collect()
        columns = ("lang", "id", "wrong", "right", "context_any", "context_none")
        rule_rows = [tuple(r[c] for c in columns) for r in rows]
    return term_rows, rule_rows


_ready: dict[int, Matcher] = {}


def matched(texts: DataFrame, rows: tuple[list, list], shape: str) -> Column:
    """``corrections`` (of the type ``shape``) and ``corrected`` of the columns _text and _lang."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(rows)
    number = id(shared)
    names = ("start", "end", "rule_id", "before", "after", "confidence")
    hits_type = to_arrow_type(StructType.fromDDL(f"c {shape}")["c"].dataType)

    @F.arrow_udf(StructType.fromDDL(f"corrections {shape}, corrected string"))
    def of(text: pa.Array, lang: pa.Array) -> pa.Array:
        if number not in _ready:  # once for each worker
            _ready.clear()
            _ready[number] = Matcher(*shared.value)
        matcher, out = _ready[number], []
        for at in range(0, len(text), _SLICE):  # few rows as Python objects at a time
            found, plain = [], []
            for t, code in zip(text.slice(at, _SLICE).to_pylist(), lang.slice(at, _SLICE).to_pylist(), strict=True):
                hits, new = matcher.made(t, code)
                found.append([dict(zip(names, h, strict=True)) for h in hits])
                plain.append(new)
            parts = [pa.array(found, hits_type), pa.array(plain, pa.string())]
            out.append(pa.StructArray.from_arrays(parts, ["corrections", "corrected"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct({"corrections": hits_type, "corrected": pa.string()}))

    # nondeterministic: not copied to each place above that reads a field of the result
    return of.asNondeterministic()(F.col("_text"), F.col("_lang"))
