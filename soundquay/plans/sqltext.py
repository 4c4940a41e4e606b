"""SQL building blocks of the independent checks (DuckDB dialect)."""

from __future__ import annotations

from soundquay.plans.views import VIEWS, WINDOW_WORDS

_AP = "\ue000"

SEG = f"""v_raw AS (
  SELECT doc_id, lang, source,
         string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w
  FROM documents WHERE lang IN ('es', 'en') AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
v_win AS (
  SELECT doc_id, lang, source, i AS seg_no,
         lpad(CAST(doc_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(i AS VARCHAR), 6, '0')
           AS utterance_id,
         list_slice(w, i * {WINDOW_WORDS} + 1, i * {WINDOW_WORDS} + {WINDOW_WORDS}) AS words
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / {WINDOW_WORDS}.0) AS BIGINT))) AS i
        FROM v_raw)),
v_seg AS (SELECT utterance_id, doc_id, seg_no, lang, source,
                 array_to_string(words, ' ') AS text FROM v_win)"""


def pair_cte(aligned: bool = False) -> str:
    drop = "" if aligned else "WHEN (i - 1) % 11 = 7 THEN NULL "
    return f"""{SEG},
v_pair AS (
  SELECT utterance_id, lang, array_to_string(words, ' ') AS ref,
         array_to_string(list_filter(list_transform(words, lambda t, i: CASE {drop}
           WHEN (i - 1) % 5 = 2 THEN 'x' || t ELSE t END), lambda t: t IS NOT NULL), ' ') AS hyp,
         list_concat(list_filter(words, lambda t: length(t) >= 9),
                     [array_to_string(list_slice(words, 1, 2), ' ')]) AS keywords,
         seg_no % 9 = 8 AS guard_fired
  FROM v_win)"""


def cte(*names: str, extra: str = "", recursive: bool = False) -> str:
    parts = [f"{n} AS ({VIEWS[n].sql()})" for n in names]
    if extra:
        parts.append(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def norm(text: str, lang: str) -> str:
    """Normal form without look-around: the apostrophe step runs twice for ``a'b'c``."""
    inner = f"'([\\p{{L}}\\p{{N}}])[''’]([\\p{{L}}\\p{{N}}])', '\\1{_AP}\\2', 'g'"
    en = f"regexp_replace(regexp_replace(lower({text}), {inner}), {inner})"
    cased = f"CASE WHEN {lang} = 'en' THEN {en} ELSE lower({text}) END"
    return (
        f"replace(trim(regexp_replace({cased}, '[^\\p{{L}}\\p{{N}}{_AP}]+', ' ', 'g')), "
        f"'{_AP}', '''')"
    )


def words(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({text}, ' ') END"


def collapse(text: str) -> str:
    """Runs of one letter to one letter (blanks stay), letter by letter."""
    chars = f"string_split({text}, '')"
    return (
        f"array_to_string(list_transform(list_filter(list_zip({chars}, "
        f"list_prepend('', {chars})), lambda p: p[1] IS NOT NULL AND p[1] <> '' "
        f"AND (p[1] <> p[2] OR p[1] = ' ')), lambda p: p[1]), '')"
    )


def es_key(word: str) -> str:
    out = f"replace(strip_accents(replace(lower({word}), 'ñ', '\ue001')), '\ue001', 'ñ')"
    for old, new in (
        ("v", "b"), ("x", "ks"), ("ch", "x"), ("h", ""), ("ll", "y"), ("z", "s"),
        ("ce", "se"), ("ci", "si"), ("qu", "k"), ("c", "k"), ("ge", "je"), ("gi", "ji"),
        ("w", "u"), ("ñ", "n"),
    ):
        out = f"replace({out}, '{old}', '{new}')"
    return collapse(out)


def en_key(word: str) -> str:
    """English sound key of one word, worked out letter by letter from the neighbours.

    ``p2 p1 c n1 n2`` are the letters around the current one in the padded word, which makes this
    form independent of the chain of replacements it is compared with.
    """
    plain = f"strip_accents(lower({word}))"
    head = (
        f"CASE WHEN regexp_matches({plain}, '^([kgp]n|wr|ae)') THEN substr({plain}, 2) "
        f"ELSE {plain} END"
    )
    vowel = "('a', 'e', 'i', 'o', 'u')"

    def at(k: int) -> str:
        return f"substr(s, CAST(i + {k + 3} AS BIGINT), 1)"

    p2, p1, c, n1, n2 = at(-2), at(-1), at(0), at(1), at(2)
    # letters swallowed by the letter before them
    eaten = (
        f"({c} = 'h' AND {p1} IN ('c', 'p', 's', 't')) "
        f"OR ({c} = 'h' AND {p1} = 'g' AND {n1} NOT IN {vowel}) "
        f"OR ({c} = 'h' AND i = 2 AND {p1} = 'w') "
        f"OR ({c} = 'k' AND {p1} = 'c') "
        f"OR ({c} = 'y' AND {p1} = 'c') "
        f"OR ({c} = 'g' AND {p1} = 'd' AND {n1} IN ('i', 'e', 'y')) "
        f"OR ({c} = 'y' AND {p1} = 'g' AND {p2} = 'd')"
    )
    code = f"""CASE
      WHEN {c} = {n1} AND {c} <> 'c' THEN ''
      WHEN {eaten} THEN ''
      WHEN {c} IN {vowel} THEN CASE WHEN i = 1 THEN upper({c}) ELSE '' END
      WHEN {c} = 'b' THEN CASE WHEN {p1} = 'm' AND {n1} = '.' THEN '' ELSE 'B' END
      WHEN {c} = 'c' THEN CASE WHEN ({n1} = 'i' AND {n2} = 'a') OR {n1} = 'h' THEN 'X'
                               WHEN {n1} IN ('i', 'e', 'y') THEN 'S' ELSE 'K' END
      WHEN {c} = 'd' THEN CASE WHEN {n1} = 'g' AND {n2} IN ('i', 'e', 'y') THEN 'J' ELSE 'T' END
      WHEN {c} = 'g' THEN CASE WHEN {n1} IN ('i', 'e', 'y') THEN 'J'
                               WHEN {n1} = 'h' AND {n2} NOT IN {vowel} THEN ''
                               WHEN {n1} = 'n' AND {n2} = '.' THEN '' ELSE 'K' END
      WHEN {c} = 'h' THEN CASE WHEN i = 1 OR {n1} IN {vowel} OR {p1} NOT IN {vowel}
                               THEN 'H' ELSE '' END
      WHEN {c} = 'p' THEN CASE WHEN {n1} = 'h' THEN 'F' ELSE 'P' END
      WHEN {c} = 'q' THEN 'K'
      WHEN {c} = 's' THEN CASE WHEN {n1} = 'h' OR ({n1} = 'i' AND {n2} IN ('o', 'a')) THEN 'X'
                               ELSE 'S' END
      WHEN {c} = 't' THEN CASE WHEN {n1} = 'i' AND {n2} IN ('o', 'a') THEN 'X'
                               WHEN {n1} = 'h' THEN '0'
                               WHEN {n1} = 'c' AND {n2} = 'h' THEN '' ELSE 'T' END
      WHEN {c} = 'v' THEN 'F'
      WHEN {c} = 'w' THEN CASE WHEN (i = 1 AND {n1} = 'h') OR {n1} IN {vowel} THEN 'W' ELSE '' END
      WHEN {c} = 'x' THEN CASE WHEN i = 1 AND ({n1} = 'h' OR ({n1} = 'i' AND {n2} IN ('o', 'a')))
                               THEN 'X' WHEN i = 1 THEN 'S' ELSE 'KS' END
      WHEN {c} = 'y' THEN CASE WHEN {n1} IN {vowel} THEN 'Y' ELSE '' END
      WHEN {c} = 'z' THEN 'S'
      WHEN {c} IN ('f', 'j', 'k', 'l', 'm', 'n', 'r') THEN upper({c})
      ELSE '' END"""
    coded = (
        f"(SELECT string_agg({code}, '' ORDER BY i) FROM "
        f"(SELECT '...' || ({head}) || '...' AS s, "
        f"unnest(range(1, length({head}) + 1)) AS i))"
    )
    return coded, plain


def words_to_symbols(list_expr: str, vocabulary: str) -> str:
    """Each word as one ASCII character (at most 90 distinct words per pair)."""
    return (
        f"array_to_string(list_transform({list_expr}, "
        f"lambda t: chr(CAST(33 + list_position({vocabulary}, t) AS INT))), '')"
    )


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of two short strings, one bit per letter of ``a``."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    mask = (
        f"list_sum(list_prepend(CAST(0 AS HUGEINT), list_transform(range(1, length({a}) + 1), "
        f"lambda k: CASE WHEN substr({a}, k, 1) = ch THEN CAST(1 AS HUGEINT) << CAST(k - 1 AS INT) "
        f"ELSE CAST(0 AS HUGEINT) END)))"
    )
    masks = f"list_transform(string_split({b}, ''), lambda ch: CAST({mask} AS HUGEINT))"
    row = (
        f"list_reduce(list_prepend({full}, {masks}), lambda v, m: "
        f"((v + (v & m)) | (v - (v & m))) & {full})"
    )
    return f"(length({a}) - bit_count({row}))"


def unit(*parts: str, seed: int) -> str:
    """The 48-bit hash number of key parts, as a whole number."""
    joined = f"concat_ws('|', '{seed}', {', '.join(parts)})"
    return f"CAST('0x' || substr(md5({joined}), 1, 12) AS BIGINT)"


def uniform(*parts: str, seed: int) -> str:
    return f"(CAST({unit(*parts, seed=seed)} AS DOUBLE) / 281474976710656.0)"


def ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) END)"
