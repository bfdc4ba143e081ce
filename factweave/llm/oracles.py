"""SQL of the operators that SQL can express, for DuckDB over the driver's tables."""

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
root AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN root ON root.a = vec_id
"""

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
sets AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS h FROM s GROUP BY doc_id),
classes AS (SELECT h, min(doc_id) AS class_id, count(*) AS class_size FROM sets GROUP BY h)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_size, 1) AS class_size
FROM documents d JOIN root ON root.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN classes USING (h)
"""


def op7(rules: dict[str, int], spreads: int, least_rows: int) -> str:
    """The adaptive rules with the same constants as the operator."""
    least = " ".join(f"WHEN '{r}' THEN {n}" for r, n in rules.items())
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t WHERE len(ws) >= 5))),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS j FROM win WHERE c > 1) GROUP BY doc_id),
b AS (SELECT t.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_bangs FROM t LEFT JOIN rep USING (doc_id)),
m AS (SELECT doc_id, lang, source, unnest(['symbols', 'upper', 'bangs', 'repeats', 'lines', 'length']) AS rule, unnest([n_symbols * 1000 // greatest(n_words, 1), n_upper * 1000 // greatest(word_chars, 1), n_bangs * 1000 // greatest(n_words, 1), n_repeat_words * 1000 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_lines, 1), word_chars * 10 // greatest(n_words, 1)]) AS v FROM b),
k AS (SELECT *, sh * 16 + (v >> CAST(sh AS INTEGER)) AS bucket FROM (SELECT *, greatest(length(bin(v)) - 5, 0) AS sh FROM m)),
levels AS (SELECT 1 AS lvl, lang, source, rule, bucket FROM k UNION ALL SELECT 2, lang, NULL, rule, bucket FROM k UNION ALL SELECT 3, NULL, NULL, rule, bucket FROM k),
cum AS (SELECT lvl, lang, source, rule, bucket, sum(c) OVER (PARTITION BY lvl, lang, source, rule ORDER BY bucket) AS below, sum(c) OVER (PARTITION BY lvl, lang, source, rule) AS total FROM (SELECT lvl, lang, source, rule, bucket, count(*) AS c FROM levels GROUP BY ALL)),
q AS (SELECT lvl, lang, source, rule, max(total) AS total, min(bucket) FILTER (below * 100 >= total * 10) AS b10, min(bucket) FILTER (below * 100 >= total * 50) AS b50 FROM cum GROUP BY ALL),
val AS (SELECT lvl, lang, source, rule, total, (b10 - greatest(b10 // 16 - 1, 0) * 16) << CAST(greatest(b10 // 16 - 1, 0) AS INTEGER) AS q10, (b50 - greatest(b50 // 16 - 1, 0) * 16) << CAST(greatest(b50 // 16 - 1, 0) AS INTEGER) AS q50 FROM q),
pick AS (SELECT o.lang, o.source, o.rule, CASE WHEN o.total >= {least_rows} THEN o.q10 WHEN l.total >= {least_rows} THEN l.q10 ELSE e.q10 END AS q10, CASE WHEN o.total >= {least_rows} THEN o.q50 WHEN l.total >= {least_rows} THEN l.q50 ELSE e.q50 END AS q50
  FROM val o JOIN val l ON l.lvl = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.rule = o.rule JOIN val e ON e.lvl = 3 AND e.rule = o.rule WHERE o.lvl = 1),
lim AS (SELECT *, q50 + {spreads} * greatest(q50 - q10, CASE rule {least} END) AS top FROM pick),
bad AS (SELECT DISTINCT doc_id FROM m JOIN lim ON lim.rule = m.rule AND lim.lang IS NOT DISTINCT FROM m.lang AND lim.source IS NOT DISTINCT FROM m.source WHERE v > top)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""
