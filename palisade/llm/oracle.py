"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from palisade.llm import licenses, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{_ALNUM}')"


OP10 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM windows),
runs AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k)),
found AS (SELECT r, i, k, item_id FROM runs JOIN windows USING (k, words)),
hit AS (
  SELECT r, count(DISTINCT j) AS n_hit
  FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN names USING (r)
"""

def _values(rows: list[tuple]) -> str:
    quoted = (", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) for row in rows)
    return ", ".join(f"({row})" for row in quoted)


OP6 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_words('text')} AS w FROM documents),
phrases(phrase, label) AS (VALUES {_values(list(licenses.PHRASES.items()))}),
split AS (SELECT label, string_split(phrase, ' ') AS p FROM phrases),
places AS (
  SELECT r, label, i - 1 AS word FROM (SELECT r, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM docs, split WHERE len(w) >= len(p))
  WHERE w[i:i + len(p) - 1] = p),
base AS (
  SELECT r, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY r),
templates(t, label, text) AS (VALUES {_values([(f'{k} {i}', k, t) for k, v in licenses.TEMPLATES.items() for i, t in enumerate(v)])}),
wanted AS (SELECT DISTINCT t, label, unnest({_words('text')}) AS word FROM templates),
sizes AS (SELECT t, count(*) AS n FROM wanted GROUP BY t),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
numbered AS (SELECT r, row_number() OVER () AS b, line FROM lines),
held AS (SELECT DISTINCT r, b, unnest({_words('line')}) AS word FROM numbered),
common AS (SELECT r, b, t, label, count(*) AS c FROM held JOIN wanted USING (word) GROUP BY ALL),
found AS (SELECT r, label, c / n AS share FROM common JOIN sizes USING (t) WHERE 100 * c >= {licenses.THRESHOLD} * n),
best AS (SELECT r, max(share) AS score FROM found GROUP BY r),
named AS (
  SELECT r, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM found UNION SELECT r, label FROM places) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN named USING (r)
"""

def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"{_literal(str(k))}: {_literal(v)}" for k, v in pairs.items()) + "}"


def _numbered(reference: str) -> str:
    """The character that a numeric reference names."""
    digits = f"regexp_extract({reference}, '^#[xX]?0*([0-9a-fA-F]*)', 1)"
    number = (f"(CASE WHEN {digits} = '' THEN 0 WHEN length({digits}) > 7 THEN 1114112 WHEN lower({reference}[2:2]) = 'x' "
              f"THEN TRY_CAST('0x' || {digits} AS BIGINT) ELSE TRY_CAST({digits} AS BIGINT) END)")
    return (f"(CASE WHEN {number} > 1114111 OR {number} BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN {number} IN ({', '.join(map(str, warc.RENUMBERED))}) THEN {_map(warc.RENUMBERED)}[CAST({number} AS VARCHAR)] "
            f"WHEN {number} BETWEEN 1 AND 8 OR {number} IN (11, 127) OR {number} BETWEEN 14 AND 31 OR {number} BETWEEN 64976 AND 65007 "
            f"OR {number} & 65535 >= 65534 THEN '' ELSE chr(CAST({number} AS INTEGER)) END)")


def _decoded(text: str, attribute: bool = False) -> str:
    """Character references from left to right: what stands behind each ampersand is a number, a closed name, a bare name or none."""
    closed = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')"
    bare = f"regexp_extract(p, '^(?:{'|'.join(warc.BARE)})')"
    number = "regexp_extract(p, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?')"
    named = _map(warc.NAMED)
    goes_on = f"AND NOT regexp_matches(p[length({bare}) + 1:length({bare}) + 1], '[A-Za-z0-9=]')" if attribute else ""
    return (f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
            f"WHEN {number} <> '' THEN {_numbered(number)} || p[length({number}) + 1:] "
            f"WHEN {named}[{closed}] IS NOT NULL THEN {named}[{closed}] || p[length({closed}) + 1:] "
            f"WHEN {bare} <> '' {goes_on} THEN {named}[{bare}] || p[length({bare}) + 1:] ELSE '&' || p END), '')")


def _plain(html: str) -> str:
    text = html
    for pattern, plain in ((warc.DROPPED, "' '"), (warc.BREAKS, "chr(10)"), (warc.TAGS, "''")):
        text = f"regexp_replace({text}, {_literal(pattern)}, {plain}, 'g')"
    text = f"regexp_replace({_decoded(text)}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


def _digest(text: str) -> str:
    parts = [f"to_base(('0x' || substr(sha1({text}), {1 + 10 * k}, 10))::BIGINT, 32, 8)" for k in range(4)]
    return f"('sha1:' || translate({' || '.join(parts)}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'))"


def _uuid(keys: str) -> str:
    h = f"sha1(concat_ws(chr(10), {keys}))"
    return (f"('<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) "
            f"|| '-' || substr({h}, 21, 12) || '>')")


#: A link's tag up to the value of its first href, in any quoting, as RE2 reads it: whole attributes, as few as there can be.
_VALUE = "(?:\"[^\"]*\"|'[^']*'|[^\\s\"'>][^\\s>]*)"
_LINK = f"(?i)<a(?:[\\s/]+[^\\s>/=]+(?:\\s*=\\s*{_VALUE})?)*?[\\s/]+href\\s*=\\s*({_VALUE})"
_CRLF = "chr(13) || chr(10)"
OP2 = f"""
WITH pages_ AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
source AS (
  SELECT page_id, {_uuid("'response', coalesce(CAST(page_id AS VARCHAR), ''), target_uri, payload")} AS refers_to, target_uri, payload,
    {_digest('payload')} AS payload_digest, {_plain('payload')} AS text,
    {_plain(f"('<p>' || regexp_extract(payload, {_literal(warc.TITLE)}, 1))")} AS title,
    list_transform(regexp_extract_all(payload, {_literal(_LINK)}, 1), lambda v: regexp_replace(v, '^["'']|["'']$', '', 'g')) AS links FROM pages_),
made AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, text AS block FROM source
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields',
    'title: ' || replace(title, chr(10), ' ') || {_CRLF} || 'language: ' || regexp_extract(payload, {_literal(warc.LANG)}, 1) || {_CRLF}
    || 'sourcePayloadDigest: ' || payload_digest || {_CRLF} || 'sourceLength: ' || strlen(payload) || {_CRLF}
    || 'textLength: ' || strlen(text) || {_CRLF}
    || coalesce(array_to_string([ 'outlink: ' || {_decoded('u', attribute=True)} || {_CRLF} for u in links ], ''), '')
    || 'sourceHeader: HTTP/1.1 200 OK' || {_CRLF} || 'sourceHeader: Content-Type: text/html; charset=utf-8' || {_CRLF}
    || 'sourceHeader: Content-Length: ' || strlen(payload) || {_CRLF}
  FROM source),
digested AS (
  SELECT *, {_digest('block')} AS block_digest, {_uuid('record_type, refers_to, payload_digest')} AS derived_id FROM made)
SELECT page_id, record_type, derived_id, refers_to, target_uri, '{warc.DATE}' AS date, content_type, payload_digest, block_digest,
  CAST(strlen(block) AS BIGINT) AS content_length, block,
  'WARC/1.1' || {_CRLF} || 'WARC-Type: ' || record_type || {_CRLF} || 'WARC-Record-ID: ' || derived_id || {_CRLF}
  || 'WARC-Refers-To: ' || refers_to || {_CRLF} || 'WARC-Target-URI: ' || target_uri || {_CRLF} || 'WARC-Date: {warc.DATE}' || {_CRLF}
  || 'WARC-Block-Digest: ' || block_digest || {_CRLF} || 'Content-Type: ' || content_type || {_CRLF}
  || 'Content-Length: ' || strlen(block) || {_CRLF} AS header
FROM digested
"""

OP11 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 6) lengths(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, c, h.a AS l, t.a AS r, n,
    CAST(CAST(1000 AS HUGEINT) * cuts.a * n // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
  JOIN totals ON totals.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM worst w WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = w.lang AND f.a >= w.a AND f.phrase <> w.phrase AND contains(' ' || f.phrase || ' ', ' ' || w.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

OP13 = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM usable a JOIN usable b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, vec_id, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.ar, p.r ORDER BY n.s DESC, n.vec_id, n.r) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scored n ON n.ar = p.ar AND NOT n.same AND 100 * n.s BETWEEN 80 * p.s AND 100 * p.s
QUALIFY row_number() OVER (PARTITION BY p.ar, p.r ORDER BY n.s DESC, n.vec_id, n.r) <= 5
"""

ORACLE: dict[str, str] = {
    "op2_warc_derivatives": OP2,
    "op6_license_scan": OP6,
    "op10_decontaminate": OP10,
    "op11_phrases": OP11,
    "op13_hard_negatives": OP13,
}
