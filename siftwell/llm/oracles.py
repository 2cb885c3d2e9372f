"""SQL (DuckDB's) for the queries of this package that it can express."""

from __future__ import annotations

from siftwell.llm import licenses


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


LOW = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"


def op3() -> str:
    """Diagonals, merged as in the scan: gap 3, cover 0.8."""
    rows = [(i, t, v, "true") for i, (t, v) in enumerate(licenses.PHRASES.items())]
    rows += [(len(rows) + i, t, v, "false") for i, (t, v) in enumerate(licenses.TEMPLATES.items())]
    values = ", ".join(f"({i}, string_split({_text(t)}, ' '), {_text(v)}, {b})" for i, t, v, b in rows)
    return rf"""
WITH t AS (SELECT * FROM (VALUES {values}) v(template, w, label, base)),
tp AS (SELECT template, label, base, len(w) - 1 AS pairs, i - 1 AS spot, w[i] AS one, w[i + 1] AS two FROM t, unnest(range(1, len(w))) u(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, i - 1 AS place, w[i] AS one, w[i + 1] AS two FROM d, unnest(range(1, len(w))) u(i)),
votes AS (SELECT r, template, label, base, pairs, place - spot AS diagonal, min(place) AS low, max(place) AS high, count(DISTINCT spot) AS n FROM p JOIN tp USING (one, two) GROUP BY 1, 2, 3, 4, 5, 6),
lagged AS (SELECT *, lag(diagonal) OVER s AS d0, lag(high) OVER s AS h0 FROM votes WINDOW s AS (PARTITION BY r, template ORDER BY low, diagonal)),
groups AS (SELECT *, sum(CASE WHEN base OR d0 IS NULL OR abs(diagonal - d0) > 3 OR low - h0 > 4 OR low - diagonal <= h0 - d0 THEN 1 ELSE 0 END) OVER (PARTITION BY r, template ORDER BY low, diagonal ROWS UNBOUNDED PRECEDING) AS g FROM lagged),
spans AS (SELECT r, label, base, min(low) AS first, sum(n) / any_value(pairs) AS share FROM groups GROUP BY r, template, label, base, g HAVING CASE WHEN base THEN sum(n) = any_value(pairs) ELSE sum(n)::DOUBLE / any_value(pairs) >= 0.8::DOUBLE END)
SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM d LEFT JOIN spans USING (r) GROUP BY r, doc_id"""


def op4() -> str:
    """All pairs of a label in double precision; components by repeated reachability."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.98::DOUBLE),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)"""


def op7() -> str:
    """Base 32 goes by groups of four letters, which are five hexadecimal digits each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = "('0x' || substr(hex, 5 * g + 1, 5))::BIGINT"
    four = " || ".join(f"substr('{letters}', ((({group}) >> {shift}) & 31)::INT + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT hex, string_agg({four}, '' ORDER BY g) AS payload_digest FROM (SELECT DISTINCT hex FROM p), unnest(range(8)) u(g) GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN d USING (hex)"""


def op10() -> str:
    """Exact containment of distinct runs of five words, or of all words of a shorter item."""
    words = rf"regexp_extract_all({LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return f"""
WITH i AS (SELECT row_number() OVER () AS item, item_id, {words} AS w FROM benchmark),
g AS (SELECT item, item_id, least(5, len(w)) AS n, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda x: array_to_string(w[x:x + least(5, len(w)) - 1], ' ')))) AS gram FROM i WHERE len(w) > 0),
of AS (SELECT item, count(*) AS n_item FROM g GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
h AS (SELECT r, doc_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' ')))) AS gram FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment FROM h JOIN g USING (n, gram) JOIN of USING (item) GROUP BY r, doc_id, item, item_id HAVING count(*) >= 0.8::DOUBLE * any_value(n_item)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": op3(), "op4_embeddings": op4(), "op7_warc": op7(), "op10_decontamination": op10()}
