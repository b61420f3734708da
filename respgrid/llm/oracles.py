"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), grouped AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM grouped
"""

OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), keys AS (
  SELECT line_key, max(doc_id) AS keeps FROM keyed
  WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.keeps IS NOT NULL AND k.doc_id <> s.keeps AS gone
  FROM keyed k LEFT JOIN keys s ON k.line_key = s.line_key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


# Base32 has four digits for every five hexadecimal ones.
OP11 = r"""
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages
), ranked AS (
  SELECT *, first_value(page_id) OVER w AS top, row_number() OVER w AS nth FROM digests WINDOW w AS (PARTITION BY hexed ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda c:
         substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substring(hexed, (c // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (c % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN top END AS refers_to
FROM ranked
"""

# Each round: every part's nearest entry, then the floored means.
_OP12_ROUND = r"""
near{k} AS MATERIALIZED (
  SELECT p, vec_id, ints, min(struct_pack(d := d, i := i)) AS best FROM (
    SELECT v.p, v.vec_id, v.ints, b.i, list_sum(list_transform(range(1, len(v.ints) + 1), lambda j: (v.ints[j] - b.ints[j]) * (v.ints[j] - b.ints[j]))) AS d
    FROM parts v JOIN book{k} b ON v.p = b.p)
  GROUP BY p, vec_id, ints
)"""
_OP12_BOOK = r"""
mean{k} AS MATERIALIZED (
  SELECT p, i, list(m ORDER BY j) AS ints FROM (
    SELECT p, best.i AS i, j, CAST(floor(sum(ints[j]) / count(*)) AS BIGINT) AS m FROM near{k}, (SELECT unnest(range(1, 17)) AS j) GROUP BY p, best.i, j)
  GROUP BY p, i
), book{next} AS MATERIALIZED (
  SELECT b.p, b.i, coalesce(m.ints, b.ints) AS ints FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.i = m.i
)"""

OP12 = (
    r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, ints[p * 16 + 1 : p * 16 + 16] AS ints FROM kept, (SELECT unnest(range(4)) AS p)
), book0 AS MATERIALIZED (
  SELECT p, ints, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM parts QUALIFY i < 256
), """
    + ", ".join(_OP12_ROUND.format(k=k) + ", " + _OP12_BOOK.format(k=k, next=k + 1) for k in range(4))
    + ", "
    + _OP12_ROUND.format(k=4)
    + r""", coded AS (
  SELECT n.vec_id, k.label, string_agg(lower(lpad(to_base(best.i, 16), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near4 n JOIN kept k ON n.vec_id = k.vec_id GROUP BY n.vec_id, k.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(ints, ','), ',' ORDER BY p, i)) FROM book4) AS codebooks_sha256
FROM coded
"""
)


# CRC-32 by its table, which follows from the polynomial. Near words share what one of them is without a character, or both without the same one.
OP13 = r"""
WITH RECURSIVE bits(b, v, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY doc_id, run
), hexed AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substring(x, i * 2 + 1, 2) AS BIGINT)),
                     lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h
  FROM hexed, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (
  SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest
), ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word
), way(word, last) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT way.word, f.form FROM way JOIN formed f ON way.last = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.last AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN way w ON f.word = w.word JOIN formed e ON w.last = e.word WHERE e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5, "op10_line_dedup": OP10, "op11_warc": OP11, "op12_vector_codes": OP12, "op13_spelling": OP13}
