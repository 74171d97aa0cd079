"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .secret_scan import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secret_scan() -> str:
    parts, counts = [], []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        group = f"length(regexp_extract(m[k], '{pattern}', {r.group}))" if r.group else "length(m[k])"
        parts.append(f"""SELECT n, {rank} AS rank, '{r.kind}' AS kind, CAST(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
          length(m[k]) AS len FROM (SELECT n, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')) AS x, unnest(range(1, len(m) + 1)) AS u(k) WHERE {group} >= {r.least}""")
        if r.base:
            counts.append(f"CAST(count(*) FILTER (rank = {rank}) AS BIGINT) AS n_{r.kind}")
    base = max(i for i, r in enumerate(RULES) if r.base)
    one = "kind || ':' || s || ':' || (s + len)"
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)})
      SELECT doc_id, {', '.join(counts)}, sha256(coalesce(string_agg({one}, ',' ORDER BY s, rank, len) FILTER (rank <= {base}), '')) AS base_sha256,
      coalesce(string_agg({one}, ',' ORDER BY s, rank, len), '') AS spans FROM d LEFT JOIN f ON d.n = f.n GROUP BY d.n, doc_id"""


NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS u(i) WHERE len(ws) > 0),
  z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
  SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, c.o AS component_id, c.o = w.doc_id AS kept FROM w LEFT JOIN z ON z.doc_id = w.doc_id JOIN (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: A run of windows on one diagonal is one verbatim match; the longest is longest_match.
DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
  q AS (SELECT item_id, i, ws[i : i + 9] AS w FROM b, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS u(i) WHERE len(ws) > 0), k AS (SELECT DISTINCT len(w) AS n FROM q),
  h AS (SELECT doc_id, j, n, item_id, i FROM (SELECT doc_id, n, j, ws[j : j + n - 1] AS w FROM d, k, unnest(range(1, len(ws) - n + 2)) AS u(j)) x JOIN q ON q.w = x.w),
  t AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(j, j + n)) AS u(p) GROUP BY doc_id),
  g AS (SELECT doc_id, item_id, j - i AS diagonal, n, j, j - row_number() OVER (PARTITION BY doc_id, item_id, j - i ORDER BY j) AS run FROM h),
  m AS (SELECT doc_id, max(len) AS longest FROM (SELECT doc_id, max(j) + max(n) - min(j) AS len FROM g GROUP BY doc_id, item_id, diagonal, run) y GROUP BY doc_id),
  f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
  FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

#: crc32 of a feature's bytes: a table of 256 values, made by the polynomial's rule, stepped over the bytes.
_CRC = """crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS tab FROM range(256) AS r(i))"""
_STEP = "xor(list_reduce(list_transform(range(octet_length(encode(g))), lambda i: CAST('0x' || substr(hex(encode(g)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
RESAMPLE = f"""WITH {_CRC}, d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT {_WORDS} AS ws FROM benchmark),
  fd AS (SELECT n, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM d),
  fb AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM b),
  k AS (SELECT g, {_STEP} % 10000 AS bucket FROM (SELECT g FROM fd UNION SELECT g FROM fb) AS u, crc),
  s AS (SELECT bucket, count(*) AS s FROM fd JOIN k USING (g) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM fb JOIN k USING (g) GROUP BY bucket),
  m AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
  w AS (SELECT n, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM fd JOIN k USING (g) JOIN m USING (bucket) GROUP BY n),
  v AS (SELECT d.n, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(CAST((total - ((total % n_features) + n_features) % n_features) // n_features AS BIGINT), 0) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON w.n = d.n),
  z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM v),
  r AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS able FROM z WHERE n_words >= 20)
  SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM z LEFT JOIN r ON r.n = z.n"""

_P = "(1 + 1000000000::HUGEINT * ({n} + 1) // ({size} + v))"
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
  f AS (SELECT lang, source, n, unnest(ws) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS total FROM f GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
  g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM f GROUP BY lang, source, term),
  l AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM kept GROUP BY lang),
  a AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, total, v, lang_size FROM g JOIN kept ON kept.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
  s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size FROM a),
  p AS (SELECT lang, source, term, n, {_P.format(n="n", size="size")} AS p, {_P.format(n="total", size="lang_size")} AS q FROM s),
  t AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
  o AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
  e AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN o ON o.lang = x.lang AND o.source = x.source AND o.item = y.source),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM e UNION ALL SELECT * FROM t))
  SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""

COVER_TREE = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
  r AS (SELECT vec_id, vec_id AS o FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.o),
  c AS (SELECT vec_id, min(o) AS o FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
  SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.o AS component_id, c.o = v.vec_id AS kept FROM v JOIN c ON c.vec_id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

SQL = {
    "op1_secret_scan": _secret_scan(), "op3_near_dedup": NEAR_DEDUP, "op8_decontaminate": DECONTAMINATE, "op11_resampling": RESAMPLE,
    "op12_divergence": DIVERGENCE, "op13_cover_tree": COVER_TREE,
}
