"""The queries of the operators, one opN_<name> each, and their SQL where SQL can express them."""

from __future__ import annotations

import re

from quarry.llm import media, minhash, mixing, packing, secrets, sharding, tokenids, toxicity, vectors, warc

QUERIES = {f.__name__: f for f in (packing.op1_best_fit_packing, secrets.op2_secret_scans, warc.op3_warc, toxicity.op4_toxicity, media.op5_media_columns, minhash.op6_minhash_near_dedup, vectors.op7_projection_near_dedup, sharding.op8_vector_sharding, tokenids.op9_token_ids, mixing.op10_pfair_mixing)}


def _op2() -> str:
    """Every rule over every text, without an index: what lies between a rule's matches gives their places.

    DuckDB's expressions fold letters beyond ASCII and know no look-behind: letters in either case are spelled out,
    and the character before a match is matched as well (group 1) and taken off.
    """
    before, parts = "(?<![A-Za-z0-9_-])", []
    for n, r in enumerate(secrets.RULES):
        pattern, group, skip = r.pattern, r.group, "0"
        if pattern.startswith("(?i)"):
            names, rest = pattern[4:].split(")", 1)
            pattern = re.sub("[a-z]", lambda x: f"[{x[0]}{x[0].upper()}]", names) + ")" + rest
        if pattern.startswith(before):
            pattern, skip = "(^|[^A-Za-z0-9_-])" + pattern[len(before) :], "length(regexp_extract_all(text, {p}, 1)[i])"
        p = "'" + pattern.replace("'", "''") + "'"
        lists = f"regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, regexp_split_to_array(text, {p}) AS gaps"
        places = f"SELECT doc_id, generate_subscripts(m, 1) AS i, m, v, gaps, text FROM (SELECT doc_id, text, {lists} FROM texts)"
        at = f"SELECT doc_id, length(m[i]) AS n, length(v[i]) AS size, {skip.format(p=p)} AS skip, sum(length(gaps[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM ({places})"
        parts.append(f"SELECT doc_id, {n} AS k, '{r.kind}' AS kind, CAST(z - n + skip AS BIGINT) AS a, CAST(z AS BIGINT) AS z FROM ({at}) WHERE size >= {r.least}")
    base = ", ".join(f"'{x}'" for x in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in secrets.BASE)
    said = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k, z)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
said AS (SELECT doc_id, {counts}, {said} FILTER (kind IN ({base})) AS base, {said} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN said USING (doc_id)
"""


_OP3 = r"""
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (
  SELECT page_id, octet_length(p) AS n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1) FOR i IN range(0, 32)], '') AS d FROM payloads),
named AS (SELECT *, max(page_id) OVER (PARTITION BY n, d) AS r FROM digests)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> r THEN r END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM named
"""

_OP6 = r"""
WITH words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM words),
five AS (
  SELECT doc_id, i, n, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS g
  FROM places WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
shingles AS (SELECT DISTINCT doc_id, g FROM five WHERE i <= greatest(n - 4, 1)),
sized AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS sig FROM shingles GROUP BY doc_id),
classes AS (SELECT sig, n, min(doc_id) AS c FROM sized GROUP BY sig, n),
lines AS (SELECT c, n, g FROM classes JOIN shingles ON c = doc_id),
pairs AS (
  SELECT x.c AS a, y.c AS b FROM lines x JOIN lines y ON x.g = y.g AND x.c < y.c
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a) SELECT a, min(b) AS least FROM r GROUP BY a),
labels AS (SELECT sig, n, least(c, coalesce(least, c)) AS component FROM classes LEFT JOIN reach ON c = a)
SELECT d.doc_id, coalesce(sized.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN sized ON d.doc_id = sized.doc_id LEFT JOIN labels ON sized.sig = labels.sig AND sized.n = labels.n
"""

_OP7 = r"""
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a) SELECT a, min(b) AS least FROM r GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN reach ON vec_id = reach.a LEFT JOIN counts ON vec_id = counts.a
"""

#: For ids that are distinct and not null, as those of the tables given. All pairs are compared, so these are for
#: small tables; the other operators have none, since SQL does not state their plans, files or learned scores.
ORACLE_SQL: dict[str, str] = {"op2_secret_scans": _op2(), "op3_warc": _OP3, "op6_minhash_near_dedup": _OP6, "op7_projection_near_dedup": _OP7}
