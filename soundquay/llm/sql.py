"""SQL forms of the queries that SQL can express, for a check on small tables."""

from __future__ import annotations

from soundquay.llm.sharding import Tree, even_tree

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest AS same, min(page_id) AS first_ FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_ < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_ < page_id THEN first_ END AS refers_to
FROM q LEFT JOIN f ON payload_digest = same AND payload_bytes >= 100"""

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))
  AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b,
  CASE WHEN 2 * i + 200 <= len(h) THEN substr(h, 2 * i + 1, 200) END AS s FROM p),
r AS (SELECT doc_id, i, b, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again
  FROM w),
g AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
n AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
k AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  CAST(count(*) FILTER (opens) AS BIGINT) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM n GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


def _draw(place: str, weight: float) -> str:
    part = f"CAST(('0x' || substr(md5({place}), 1, 13)) AS BIGINT)"
    return f"-ln(({part} + 0.5) / 4503599627370496.0) / {weight}"


def _pick(draws: list[str]) -> str:
    """Index of the least of some draws, the first of equal ones."""
    return f"list_position([{', '.join(draws)}], list_min([{', '.join(draws)}])) - 1"


def _by_place(values: dict[tuple[int, ...], str], names: list[str]) -> str:
    cases = " ".join(
        f"WHEN {' AND '.join(f'{n} = {i}' for n, i in zip(names, place, strict=True))} THEN {value}"
        for place, value in values.items()
    )
    return f"CASE {cases} END"


def _shard_steps(source: str, tree: Tree, out: str) -> str:
    """Common table expressions that walk the tree; the last one adds the column ``out``."""
    key = "CAST(doc_id AS VARCHAR)"
    sums = [[sum(rack) for rack in region] for region in tree.regions]
    region = _pick([_draw(f"{key} || ':region:{i}'", sum(s)) for i, s in enumerate(sums)])
    racks = {
        (i,): _pick([_draw(f"{key} || ':rack:{i}.{j}'", w) for j, w in enumerate(s)]) for i, s in enumerate(sums)
    }
    leaves, first = {}, 0
    for i, x in enumerate(tree.regions):
        for j, rack in enumerate(x):
            draws = [_draw(f"{key} || ':shard:{i}.{j}.{k}'", w) for k, w in enumerate(rack)]
            leaves[(i, j)] = f"{first} + {_pick(draws)}"
            first += len(rack)
    r, k = f"{out}_region", f"{out}_rack"
    return f"""{out}_1 AS (SELECT *, {region} AS {r} FROM {source}),
{out}_2 AS (SELECT *, {_by_place(racks, [r])} AS {k} FROM {out}_1),
{out}_3 AS (SELECT *, CAST({_by_place(leaves, [r, k])} AS INTEGER) AS {out} FROM {out}_2)"""


_CRC = """CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
  regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
  lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS BIGINT)"""

SHARDS = f"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS tbl),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, CAST(strlen(t) AS BIGINT) + 8 AS size, {_CRC} AS text_crc32 FROM d, crc),
{_shard_steps('e', even_tree(), 'shard')},
{_shard_steps('shard_3', even_tree().grown(), 'grown_shard')}
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard_region AS INTEGER) AS region,
  CAST(shard_rack AS INTEGER) AS rack, shard, CAST(row_number() OVER (PARTITION BY shard
  ORDER BY md5(doc_id || ':' || text_crc32 || ':' || size)) - 1 AS BIGINT) AS slot, grown_shard
FROM grown_shard_3"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


_PAIRS = """list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"""
_SIBLING = """CASE WHEN (pos >> k) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(l[xor(pos >> k, 1) + 1], '')"""

#: A level is a list; a sibling carries the side on which it stands.
MERKLE = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS tbl),
t AS (SELECT *, CAST(doc_id AS VARCHAR) AS t FROM documents),
f AS (SELECT *, n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END AS forged FROM t, crc),
o AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf('n_chars')} AS leaf, {_leaf('forged')} AS claimed FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS pos FROM o),
lv AS (SELECT grp, 0 AS k, list(leaf ORDER BY pos) AS l FROM n GROUP BY grp
  UNION ALL SELECT grp, k + 1, {_PAIRS} FROM lv WHERE len(l) > 1),
g AS (SELECT grp, l[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos FROM lv WHERE len(l) = 1),
gl AS (SELECT 0 AS k, list(subroot ORDER BY pos) AS l FROM g
  UNION ALL SELECT k + 1, {_PAIRS} FROM gl WHERE len(l) > 1),
gs AS (SELECT grp, any_value(subroot) AS subroot, coalesce(list({_SIBLING} ORDER BY k) FILTER (len(l) > 1), []) AS above
  FROM g, gl GROUP BY grp),
s AS (SELECT n.grp, n.pos, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, any_value(claimed) AS claimed,
  coalesce(list({_SIBLING} ORDER BY k) FILTER (len(l) > 1), []) AS own FROM n JOIN lv USING (grp) GROUP BY n.grp, n.pos),
p AS (SELECT doc_id, leaf, claimed, subroot, list_concat(own, above) AS path FROM s JOIN gs USING (grp)),
r AS (SELECT p.*, l[1] AS root, sha256(array_to_string(list_transform(path, lambda x: substr(x, 2)), '')) AS proof_sha256,
  list_reduce(list_prepend(claimed, path), lambda h, x: sha256(
    CASE WHEN x[1] = 'L' THEN substr(x, 2) || h ELSE h || substr(x, 2) END)) AS folded_root
  FROM p, gl WHERE len(l) = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM r"""

PASSAGES = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS d,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT d, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
s AS (SELECT p.d, i, word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS s
  FROM p JOIN d USING (d)),
r AS (SELECT d, i, word, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS again FROM s),
g AS (SELECT d, i, word, bool_or(again) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM r),
k AS (SELECT d, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (d)"""


def _add(cost: str, edit: str, v: str) -> str:
    """A value is its cost in nine digits and the edits, so that the least string is the least of both."""
    return f"(lpad(CAST(CAST(left({v}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({v}, 10))"


def _edit(x: str) -> str:
    """The least value ahead of a row in state x, without inserts."""
    to, new = ("a", "Ra") if x == "u" else ("u", "Ru")
    keeps = [(c, c) for c in ("s", "u") if x == "e"] or [(to, to)]
    kept = [f"CASE WHEN NOT gone AND initial = '{c}' THEN {_add('more', 'K', f'v{y}')} END" for c, y in keeps]
    moved = f"CASE WHEN NOT gone THEN {_add('3 + more', new, f'v{to}')} END"
    return f"least({_add('4', 'D', f'v{x}')}, {', '.join([*kept, moved])}) AS w{x}"


#: States: e nothing yet, s, u, a after such a row. A role that is inserted or given follows its edit.
REPAIR = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS tbl),
b AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS t FROM conversations),
k AS (SELECT *, {_CRC} % 20 AS kind FROM b, crc),
e AS (SELECT key, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, txt) AS i,
  rtrim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM e),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY key, role, txt ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, left(role, 1) AS initial,
  lead(left(role, 1)) OVER (PARTITION BY key ORDER BY i) AS following FROM n),
m AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone,
  CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM f),
r AS (SELECT key, max(i) + 1 AS i, '000000000' AS ve, '000000006IuIa' AS vs, '000000003Ia' AS vu, '000000000' AS va
  FROM n GROUP BY key
  UNION ALL SELECT key, i, least(we, {_add('3', 'Iu', f"least(wu, {_add('3', 'Ia', 'wa')})")}),
    least(ws, {_add('3', 'Iu', f"least(wu, {_add('3', 'Ia', 'wa')})")}),
    least(wu, {_add('3', 'Ia', 'wa')}), least(wa, {_add('3', 'Iu', 'wu')})
  FROM (SELECT m.key, m.i, {', '.join(_edit(x) for x in 'esua')} FROM r JOIN m ON m.key = r.key AND m.i = r.i - 1)),
p AS (SELECT key, CAST(left(ve, 9) AS BIGINT) AS cost, substr(ve, 10) AS code FROM r WHERE i = 1),
x AS (SELECT key, unnest(regexp_extract_all(code, '[DIKR][ua]?')) AS edit,
  unnest(range(len(regexp_extract_all(code, '[DIKR][ua]?')))) AS j FROM p),
y AS (SELECT *, sum(CASE WHEN edit[1] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY j) AS i FROM x),
z AS (SELECT y.key, sha256(string_agg(CASE right(edit, 1) WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE role END
  || ':' || CASE WHEN edit[1] = 'I' THEN '' ELSE txt END, chr(10) ORDER BY j)) AS digest
  FROM y LEFT JOIN n ON n.key = y.key AND n.i = y.i WHERE edit <> 'D' GROUP BY y.key),
g AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY key),
ids AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS key FROM conversations)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(translate(code, 'ua', ''), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN g USING (key) LEFT JOIN p USING (key) LEFT JOIN z USING (key)"""
