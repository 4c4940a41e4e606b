"""Personal data in whole texts: patterns propose, checksums confirm, context weighs.

Every kind has a pattern that proposes leftmost spans without overlap, a check of the span
(checksum, number of digits, value range) that drops it or confirms it, and words that raise its
score when they stand shortly before it. Spans of the base kinds stay whatever their score is;
spans of the added kinds must reach LEAST_SCORE: account numbers have a checksum and do so by
themselves, social security numbers have none and need words ahead of them.

All steps are DataFrame functions. One regular expression walks a text for each kind: it starts
where the last match ended and takes the gap before a match together with the match, so the
lengths of the gaps give the positions, in code points. Quantifiers do not give back characters,
and a match starts only where a run of its characters starts, so the walk is linear in the text. An
account number takes 4 characters in the walk and looks at a bounded run after them, which may hold
words that follow it; each end of a word in the run is tried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: characters a match cannot start after, unless the last match ended there
    before: str | None
    #: cheap test of the whole text
    hint: str
    check: object
    words: str
    #: score of a confirmed span without and with context
    score: tuple[float, float]
    base: bool = True
    #: what a match consumes, when the pattern only looks ahead and ``check`` gives the span's length
    head: str | None = None
    head_chars: int = 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        x = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return (F.length(digits) > 0) & (F.aggregate(at, F.lit(0), add) % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number (country, check digits, number) leaves 1 when divided by 97."""
    turned = F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4))
    letters = F.split(turned, "")

    def add(rest, c):
        code = F.ascii(c)
        return F.when(c == "", rest).when(code >= 65, (rest * 100 + code - 55) % 97).otherwise(
            (rest * 10 + code - 48) % 97
        )

    return F.aggregate(letters, F.lit(0), add) == 1


def _ip(found: Column) -> Column:
    def small(part):
        part = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(part) > 3, False).otherwise(part.cast("int") <= 255)

    return F.forall(F.split(found, "\\."), small)


def _card(found: Column) -> Column:
    digits = _digits(found)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def _account(found: Column) -> Column:
    """Length of the longest start of a run that ends with a word and is an account number, or null.

    The run may go on into the words after the number; its last character may be the one after it.
    """
    parts = F.split(found, " ")
    starts = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " ")
    )

    def good(start):
        plain = F.replace(start, F.lit(" "), F.lit(""))
        shaped = F.length(plain).between(15, 34) & plain.rlike("^[A-Z0-9]+$")
        return F.when(shaped, mod97(plain)).otherwise(False)

    return F.char_length(F.try_element_at(F.filter(starts, good), F.lit(-1)))


#: The base patterns and limits of the contract, in its order, then the added kinds.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "A-Za-z0-9._%+-",
         "@", lambda s: F.lit(True), "mail|contact|write|reply", (0.9, 1.0)),
    Kind("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "0-9",
         r"[0-9]\.[0-9]", _ip, "ip|host|address|server", (0.6, 0.9)),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None,
         r"(?:[0-9][\x20-]?+){13}", _card, "card|visa|credit|payment", (0.7, 1.0)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", None,
         r"\+[0-9]", lambda s: F.length(_digits(s)).between(9, 15), "phone|tel|call|mobile",
         (0.7, 1.0)),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+", "A-Za-z0-9",
         r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", _account, "iban|account|bank|konto|compte|cuenta",
         (0.8, 1.0), False, "[A-Z]{2}[0-9]{2}", 4),
    # numbers of this form are common and have no check digit: only the words before them decide
    Kind("ssn", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "0-9-",
         r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda s: F.lit(True), "ssn|social security", (0.3, 0.8), False),
)
LEAST_SCORE = 0.5
CONTEXT_CHARS = 40


def _walk(kind: Kind) -> str:
    if kind.head:
        return rf"\G((?s:.*?)(?<![{kind.before}]))(?=({kind.pattern})){kind.head}"
    gap = "(?s:.*?)" if kind.before is None else f"|(?s:.*?)(?<![{kind.before}])"
    return rf"\G({gap})({kind.pattern})"


def _spans(text: str, kind: Kind) -> Column:
    """Confirmed spans of one kind: start, stop, score; null texts are empty."""
    body, walk = F.coalesce(F.col(text), F.lit("")), F.lit(_walk(kind))
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, walk, 1).alias("gap"),
        F.regexp_extract_all(body, walk, 2).alias("found"),
    )

    def step(done, pair):
        start = done["at"] + F.char_length(pair["gap"])
        length = kind.check(pair["found"]) if kind.head else F.char_length(pair["found"])
        stop = start + length
        near = F.lower(F.right(pair["gap"], F.lit(CONTEXT_CHARS))).rlike(rf"\b(?:{kind.words})")
        score = F.when(near, kind.score[1]).otherwise(kind.score[0])
        span = F.struct(start.alias("start"), stop.alias("stop"), score.alias("score"))
        if kind.head:
            last = F.coalesce(F.try_element_at(done["spans"], F.lit(-1))["stop"], F.lit(0))
            sure = length.isNotNull() & (start >= last)
        else:
            sure = F.coalesce(kind.check(pair["found"]), F.lit(False))
        good = sure & (score >= LEAST_SCORE)
        return F.struct(
            (start + kind.head_chars if kind.head else stop).alias("at"),
            F.when(good, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    empty = F.array().cast("array<struct<start:int,stop:int,score:double>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    walked = F.aggregate(pairs, zero, step, lambda done: done["spans"])
    return F.when(body.rlike(kind.hint), walked).otherwise(empty)


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, prefix: str = "pii_") -> DataFrame:
    """Add one column ``pii_<kind>`` (or of another prefix; such a column is replaced) with the spans (start, stop, score) of each kind.

    ``start`` and ``stop`` count code points, ``stop`` is exclusive. A null text counts as empty
    and has no spans. Other columns stay as they are; of the added kinds, spans that overlap a
    base span are left out.
    """
    out = docs.withColumns({f"{prefix}{k.name}": _spans(text, k) for k in kinds if k.base})
    base = F.flatten(F.array(*[F.col(f"{prefix}{k.name}") for k in kinds if k.base]))
    added = {}
    for k in kinds:
        if not k.base:
            clear = lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
            added[f"{prefix}{k.name}"] = F.filter(_spans(text, k), clear)
    return out.withColumns(added) if added else out


def _named(kind: Kind) -> Column:
    def say(s):
        return F.concat_ws(":", F.lit(kind.name), s["start"].cast("string"), s["stop"].cast("string"))

    return F.transform(F.col(f"pii_{kind.name}"), say)


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest, list and scores of the spans of each document (one row for each row of docs)."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.array_join(F.concat(*[_named(k) for k in KINDS if k.base]), ",")
    rest = F.array_join(F.concat(*[_named(k) for k in KINDS]), ",")
    counts = [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS]
    scores = F.flatten(F.array(*[F.transform(f"pii_{k.name}", lambda s: s["score"]) for k in KINDS]))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), rest.alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets; overlapping spans become one.

    A run of overlapping spans gets the kind that starts first (the first listed among those).
    Texts without spans, empty and null ones stay as they are.
    """
    prefix = "_pii_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = find(docs, text, prefix=prefix)

    def tagged(i, kind):
        def tag(s):
            return F.struct(s["start"].alias("start"), F.lit(i).alias("i"),
                            s["stop"].alias("stop"), F.lit(f"<{kind.name}>").alias("tag"))

        return F.transform(F.col(f"{prefix}{kind.name}"), tag)

    all_spans = F.flatten(F.array(*[tagged(i, k) for i, k in enumerate(KINDS)]))
    ordered = F.array_sort(all_spans)
    body = F.col(text)

    def step(done, s):
        free = s["start"] >= done["at"]
        kept = F.substring(body, done["at"] + 1, s["start"] - done["at"])
        return F.struct(
            F.greatest(done["at"], s["stop"]).alias("at"),
            F.when(free, F.concat(done["out"], F.array(kept, s["tag"]))).otherwise(done["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def close(done):
        return F.concat(F.array_join(done["out"], ""), F.substring(body, done["at"] + 1, F.char_length(body)))

    clean = F.when(F.size(all_spans) > 0, F.aggregate(ordered, zero, step, close)).otherwise(body)
    return found.withColumn(text, clean).drop(*[f"{prefix}{k.name}" for k in KINDS])
