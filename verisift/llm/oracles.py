"""DuckDB SQL of the queries that SQL can express over whole tables."""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w),
windows AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS k FROM starts),
firsts AS (SELECT k, MIN(doc_id) AS first_id FROM windows GROUP BY k),
gone AS (SELECT DISTINCT a.doc_id, unnest(range(a.p, a.p + 13)) AS i FROM windows a JOIN firsts f ON a.k = f.k WHERE f.first_id < a.doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
told AS (SELECT e.doc_id, COUNT(g.i) AS n_removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS kept
FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, COALESCE(t.n_removed, 0) AS n_removed, sha256(COALESCE(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN told t ON w.doc_id = t.doc_id""",
    "op6_fingerprints": r"""WITH n AS (SELECT doc_id, COALESCE(text, '') AS text, COALESCE(LEAD(text) OVER (ORDER BY doc_id DESC), FIRST_VALUE(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM (SELECT doc_id, COALESCE(text, '') AS text FROM documents) d),
e AS (SELECT doc_id, text, nxt, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) AS edited FROM n),
t AS (SELECT doc_id, 'a' AS v, text AS x FROM e UNION ALL SELECT doc_id, 'b', edited FROM e UNION ALL SELECT doc_id, 'c', nxt FROM e),
k AS (SELECT doc_id, v, CAST('0x' || left(md5(line), 15) AS BIGINT) AS d FROM (SELECT doc_id, v, unnest(list_distinct(string_split(x, chr(10)))) AS line FROM t) z WHERE line <> ''),
c AS (SELECT doc_id, v, COUNT(*) AS n, GREATEST(8, CASE WHEN COUNT(*) * 4 > 1 THEN 1 << length(bin(COUNT(*) * 4 - 1)) ELSE 1 END) AS size FROM k GROUP BY 1, 2),
p AS (SELECT k.doc_id, k.v, d, unnest([0, 1, 2]) AS i, size FROM k JOIN c ON k.doc_id = c.doc_id AND k.v = c.v WHERE k.v <> 'c'),
s AS (SELECT doc_id, v, i * size + ((d >> (20 * i)) & (size - 1)) AS place, bit_xor(d) AS d, bit_xor(((d & 1073741823) + 12345) * ((d >> 30) + 67890) % 2147483647) AS h FROM p GROUP BY ALL),
f AS (SELECT doc_id, v, string_agg(place || '-' || lower(hex(d)) || '-' || lower(hex(h)), '.' ORDER BY place) AS cells FROM s WHERE d <> 0 OR h <> 0 GROUP BY 1, 2),
m AS (SELECT a.doc_id, b.v, COUNT(*) AS both FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.d = b.d WHERE a.v = 'a' AND b.v <> 'a' GROUP BY 1, 2),
w AS (SELECT e.doc_id, e.text, e.edited, COALESCE(a.n, 0) AS na, COALESCE(b.n, 0) AS nb, COALESCE(c3.n, 0) AS nc, COALESCE(a.size, 8) AS sa, COALESCE(b.size, 8) AS sb, COALESCE(fa.cells, '') AS fa,
COALESCE(fb.cells, '') AS fb, COALESCE(mb.both, 0) AS mb, COALESCE(mc.both, 0) AS mc FROM e LEFT JOIN c a ON a.doc_id = e.doc_id AND a.v = 'a' LEFT JOIN c b ON b.doc_id = e.doc_id AND b.v = 'b' LEFT JOIN c c3 ON c3.doc_id = e.doc_id AND c3.v = 'c'
LEFT JOIN f fa ON fa.doc_id = e.doc_id AND fa.v = 'a' LEFT JOIN f fb ON fb.doc_id = e.doc_id AND fb.v = 'b' LEFT JOIN m mb ON mb.doc_id = e.doc_id AND mb.v = 'b' LEFT JOIN m mc ON mc.doc_id = e.doc_id AND mc.v = 'c')
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, na || ':' || sa || ':' || fa AS fingerprint, nb || ':' || sb || ':' || fb AS edited_fingerprint,
CASE WHEN na + nb = 0 THEN 1.0::DOUBLE ELSE 1 - (na + nb - 2 * mb)::DOUBLE / (na + nb) END AS near_edited, CASE WHEN na + nc = 0 THEN 1.0::DOUBLE ELSE 1 - (na + nc - 2 * mc)::DOUBLE / (na + nc) END AS near_next FROM w""",
}
