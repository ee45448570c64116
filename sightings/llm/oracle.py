"""SQL of the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from sightings.llm.licenses import HEADERS, MIN_COSINE, STOP_WORDS, TEMPLATES

_WORD = r"[^\x20\x09-\x0D]+"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"



def _texts(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


_TEMPLATES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES + HEADERS))
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five digits of the digest are twenty bits, or four letters.
_DIGEST = " || ".join(
    f"substr('{_BASE32}', ((('0x' || substr(sha, {5 * g + 1}, 5))::BIGINT >> {b}) & 31)::INT + 1, 1)"
    for g in range(8)
    for b in (15, 10, 5, 0)
)

SQL = {
    "op4_license_scan": rf"""
WITH f AS (
  SELECT doc_id AS file_id, text, doc_id // 1000 || '/' AS a, doc_id // 100 || '/' AS b, doc_id // 10 || '/' AS c
  FROM documents
), files AS (
  SELECT file_id, text, CASE
    WHEN file_id % 1000 = 0 THEN a || 'LICENSE' WHEN file_id % 100 = 0 THEN a || b || 'LICENSE'
    WHEN file_id % 10 = 0 THEN a || b || c || 'LICENSE' ELSE a || b || c || file_id || '.txt' END AS path
  FROM f
), tw AS (
  SELECT t, name, w, count(*) AS n
  FROM (SELECT t, name, unnest(regexp_extract_all(lower(body), '[\pL\pN]+')) AS w
        FROM (VALUES {_TEMPLATES}) AS v(t, name, body))
  WHERE NOT list_contains({_texts(STOP_WORDS)}, w) GROUP BY ALL
), vocab AS (SELECT list(DISTINCT w) AS v FROM tw),
lines AS (
  SELECT file_id, pos, list_filter(regexp_extract_all(lower(line), '[\pL\pN]+'),
    lambda w: NOT list_contains({_texts(STOP_WORDS)}, w)) AS found
  FROM (SELECT file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM files)
), marked AS (
  SELECT file_id, pos, len(found) AS n, list_filter(found, lambda w: list_contains(v, w)) AS own FROM lines, vocab
), runs AS (
  SELECT file_id, unnest(list_distinct(list_concat(
    string_split_regex(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '[\pL\pN]') THEN x ELSE '' END), chr(10)), '\n{{2,}}'),
    string_split_regex(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '[\pL\pN]')
      AND regexp_matches(x, '^[ \t\n\x0B\f\r]*(//|/\*|\*|#|--|;|%|<!--)') THEN x ELSE '' END), chr(10)), '\n{{2,}}')))) AS block
  FROM (SELECT file_id, string_split(coalesce(text, ''), chr(10)) AS l FROM files)
), blocks AS (
  SELECT file_id, -1 - row_number() OVER () AS pos, list_filter(regexp_extract_all(lower(block), '[\pL\pN]+'),
    lambda w: NOT list_contains({_texts(STOP_WORDS)}, w)) AS found
  FROM runs WHERE contains(trim(block, chr(10)), chr(10))
), units AS (
  SELECT file_id, pos, own, n FROM marked WHERE len(own) > 0
  UNION ALL
  SELECT file_id, -1, flatten(list(own ORDER BY pos)), sum(n) FROM marked GROUP BY file_id HAVING sum(len(own)) > 0
  UNION ALL
  SELECT file_id, pos, own, n FROM (SELECT file_id, pos, len(found) AS n,
    list_filter(found, lambda w: list_contains(v, w)) AS own FROM blocks, vocab) WHERE len(own) > 0
), df AS (
  SELECT w, count(DISTINCT file_id) AS df
  FROM (SELECT file_id, unnest(own) AS w FROM units WHERE pos = -1) GROUP BY w
), idf AS (
  SELECT DISTINCT tw.w, ln((1.0 + (SELECT count(*) FROM files)) / (1.0 + coalesce(df, 0))) + 1 AS idf
  FROM tw LEFT JOIN df USING (w)
), tf AS (
  SELECT file_id, pos, u.others, u.w, count(*) * any_value(idf) AS weight
  FROM (SELECT file_id, pos, n - len(own) AS others, unnest(own) AS w FROM units) u JOIN idf ON idf.w = u.w
  GROUP BY ALL
), norm AS (
  SELECT file_id, pos, sqrt(sum(weight * weight)
    + max(others) * pow(ln(1.0 + (SELECT count(*) FROM files)) + 1, 2)) AS norm FROM tf GROUP BY ALL
), tv AS (
  SELECT t, name, w, n * idf / sqrt(sum(n * n * idf * idf) OVER (PARTITION BY t)) AS unit FROM tw JOIN idf USING (w)
), best AS (
  SELECT file_id, min({{'c': -round(c, 9), 'name': name}}) AS b
  FROM (SELECT file_id, name, sum(weight * unit) / any_value(norm) AS c
        FROM tf JOIN norm USING (file_id, pos) JOIN tv USING (w) GROUP BY file_id, pos, t, name)
  WHERE round(c, 9) >= {MIN_COSINE} GROUP BY file_id
), own AS (
  SELECT files.file_id, path, b.name AS own_license, -b.c AS own_cosine FROM files LEFT JOIN best USING (file_id)
), dirs AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, min({{'c': -own_cosine, 'path': path, 'name': own_license}}) AS d
  FROM own WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY 1
), above AS (
  SELECT file_id, k, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS dir
  FROM (SELECT file_id, path, unnest(range(1, len(string_split(path, '/')))) AS k FROM own WHERE own_license IS NULL)
), near AS (
  SELECT file_id, arg_max(d, k) AS d FROM above JOIN dirs USING (dir) GROUP BY file_id
)
SELECT file_id, path, own_license, round(own_cosine, 6) AS own_cosine,
  coalesce(own_license, d.name) AS license,
  CASE WHEN own_license IS NOT NULL THEN path ELSE d.path END AS from_path
FROM own LEFT JOIN near USING (file_id)
""",
    "op9_seekable_warc": rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
    sha1(coalesce(html, '')) AS sha FROM pages
)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM p
""",
    "op2_mix_sources": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size,
    ('0x' || substr(md5('mix-1/' || coalesce(doc_id::VARCHAR, '~') || '/' || md5(coalesce(text, ''))), 1, 12))::BIGINT
      AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[rank % 3 + 1] AS weight FROM s
), fill(level, clamped, round) AS (
  SELECT 0.0::DOUBLE, 0::BIGINT, 0
  UNION ALL
  SELECT ((SELECT 1.5 * sum(source_size) FROM w)
          - coalesce(sum(CASE WHEN full_ THEN source_size * 2.0 END), 0.0))
         / sum(CASE WHEN NOT full_ THEN weight END), count(*) FILTER (full_), round + 1
  FROM (SELECT w.*, f.round, f.level, source_size * 2.0 <= weight * f.level AS full_ FROM w, fill f WHERE f.round < 60)
  GROUP BY round
  HAVING sum(CASE WHEN NOT full_ THEN weight END) > 0
), t AS (
  SELECT source, source_size,
    least(source_size * 2.0, weight * (SELECT arg_max(level, round) FROM fill)) AS target FROM w
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), c AS (
  SELECT doc_id, d.source, size, source_size, target, whole, target - whole * source_size AS extra,
    sum(size) OVER (PARTITION BY d.source ORDER BY draw >> 36 RANGE UNBOUNDED PRECEDING) AS part_end,
    sum(size) OVER (PARTITION BY d.source, draw >> 36) AS part_size,
    sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE
    WHEN part_end <= extra THEN 1
    WHEN part_end - part_size >= extra THEN 0
    WHEN upto - size / 2.0 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
""",
    "op5_cqf_exact": """
WITH g AS (
  SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size
  FROM documents GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.t
""",
    "op10_decontaminate": rf"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TOKEN}') AS w FROM benchmark
), n AS (
  SELECT item_id, w, least(len(w), 13) AS k FROM i WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, k, list_slice(w, a, a + k - 1) AS gram
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS a FROM n)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TOKEN}'), []) AS w
  FROM documents
), x AS (
  SELECT doc_id, k, a, list_slice(w, a, a + k - 1) AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM g))
), h AS (
  SELECT DISTINCT doc_id, a, k, item_id FROM x JOIN g USING (k, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM (SELECT DISTINCT doc_id, a, k FROM h)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op11_source_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), x AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (
  SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * v.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 5) // (v.total + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), r AS (
  SELECT * FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
""",
    "op12_repeated_substrings": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents
), x AS (
  SELECT row, doc_id, pos, array_to_string(list_slice(w, pos, pos + 12), ' ') AS gram
  FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d)
), least AS (
  SELECT gram, min(doc_id) AS first FROM x GROUP BY gram
), covered AS (
  SELECT DISTINCT row, unnest(range(pos, pos + 13)) AS pos
  FROM x JOIN least USING (gram) WHERE coalesce(doc_id, 9223372036854775807) > first
), words AS (
  SELECT row, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM d
), kept AS (
  SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN covered USING (row, pos)
  GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
""",
    "op13_collocations": rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)
), g AS (
  SELECT lang, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM p, (VALUES (1), (2), (3), (4)) AS v(k))
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING f >= 30
), total AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
cuts AS (
  SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, c, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(list_slice(w, 1, c), ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(list_slice(w, c + 1, len(w)), ' ')
), own AS (
  SELECT lang, phrase, k, any_value(a) AS a, min(struct_pack(score := score, c := c, l := l, r := r)) AS cut
  FROM scored GROUP BY ALL
), inner_ AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
    FROM (SELECT lang, a, w, m, unnest(range(1, len(w) - m + 2)) AS i
          FROM (SELECT lang, f AS a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2))
  ) GROUP BY lang, phrase
), best AS (
  SELECT own.lang, own.phrase, own.a, cut.l AS l, cut.r AS r, cut.score AS score,
    row_number() OVER (PARTITION BY own.lang ORDER BY cut.score DESC, own.a DESC, own.phrase) AS rank
  FROM own LEFT JOIN inner_ ON own.lang = inner_.lang AND own.phrase = inner_.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * own.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
  total.n::BIGINT AS n, score::BIGINT AS score
FROM best JOIN total USING (lang) WHERE rank <= 2000
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
