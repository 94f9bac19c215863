"""DuckDB SQL of the registered queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SPACED = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"



def _number(text: str, size: int) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT) % {size})"


ORACLE_SQL = {
    "op4_url_temporal": f"""
WITH bare AS (SELECT page_id, url, {_number("coalesce(url, '')", 720)} AS fetched_on,
              lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')) AS b FROM pages),
part AS (SELECT row_number() OVER () AS r, *, nullif(regexp_replace(split_part(b, '/', 1), '(^.*@)|(:[0-9]*$)', '', 'g'), '') AS host,
         regexp_extract(b, '^[^/]*(/.*)?$', 1) AS path FROM bare),
cap AS (SELECT r, page_id, url, fetched_on, host, string_split(host, '.') AS l, string_split(path, '/') AS f, regexp_replace(path, '/+$', '') AS page FROM part),
keys AS (SELECT r, fetched_on, list_concat(CASE WHEN page <> '' THEN [host || page] ELSE [] END,
                list_transform(generate_series(len(f) - 1, 2, -1), lambda i: host || array_to_string(f[1:i], '/') || '/'),
                [host], list_transform(generate_series(2, len(l) - 1), lambda i: array_to_string(l[i:], '.'))) AS k
         FROM cap WHERE host IS NOT NULL),
look AS (SELECT r, fetched_on, unnest(generate_series(1, len(k))) AS rank, unnest(k) AS pattern FROM keys),
pat AS (SELECT DISTINCT pattern FROM look WHERE {_number("'in' || pattern", 3)} > 0),
seed AS (SELECT pattern, pattern AS s, 0 AS second FROM pat UNION ALL SELECT pattern, pattern || '#2', 1 FROM pat WHERE {_number("'two' || pattern", 3)} = 0),
step AS (SELECT pattern, ['allow', 'adult', 'phishing', 'spam'][({_number("'list' || pattern", 4)} + second) % 4 + 1] AS list_name,
         {_number("'start' || s", 500)} AS d1, 30 + {_number("'gone' || s", 200)} AS d2, {_number("'again' || s", 90)} AS d3 FROM seed),
-- listed again on the day of the removal: the removal is that day's last word
span AS (SELECT pattern, list_name, d1 AS valid_from, d1 + d2 AS valid_to FROM step
         UNION ALL SELECT pattern, list_name, d1 + d2 + d3, NULL FROM step WHERE d3 > 0),
live AS (SELECT r, rank, pattern, list_name, valid_from FROM look JOIN span USING (pattern)
         WHERE valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)),
top AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY r) AS n,
        row_number() OVER (PARTITION BY r ORDER BY rank, list_name <> 'allow', list_name, valid_from) AS o FROM live) WHERE o = 1)
SELECT page_id, url, fetched_on, host,
       CASE WHEN list_name IS NULL THEN 'none' WHEN list_name = 'allow' THEN 'allow' ELSE 'block' END AS verdict,
       list_name AS matched_list, pattern AS matched_pattern, valid_from, CAST(coalesce(n, 0) AS BIGINT) AS n_active
FROM cap LEFT JOIN top USING (r)""",
    "op6_bbit_minhash": f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_SPACED.format('text')} AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
         FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(4, len(w)) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * m >= 80 * (p.n + q.n - m)),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM doc UNION SELECT link.x, reach.seen FROM reach JOIN link ON link.y = reach.doc_id)
SELECT doc.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, min(seen) AS component_id, doc.doc_id = min(seen) AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN reach USING (doc_id) GROUP BY doc.doc_id, size.n""",
    "op10_benchmark_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
place AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
          FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
                FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT place.r, place.i, place.size, win.item_id FROM place JOIN win USING (size, gram)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY r),
item_list AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
              FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN item_list USING (r)""",
}
