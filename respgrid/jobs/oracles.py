"""DuckDB SQL for the registered queries: the same derivations and results, written for themselves."""

from __future__ import annotations

# Responses made of pages, and the name that each gives its file.
PAGES = r"""
pages_r AS (
  SELECT page_id AS response_id, regexp_replace(url, '^[a-z]+://[^/]+', '') AS request_path,
         CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/octet-stream' WHEN 4 THEN 'text/csv' END AS content_type,
         strlen(html) AS n, html
  FROM pages
), pages_n AS (
  SELECT *, CASE response_id % 4
    WHEN 1 THEN 'p' || response_id || '.csv'
    WHEN 2 THEN 'p ' || response_id || '.tsv'
    ELSE nullif(regexp_extract(split_part(request_path, '?', 1), '[^/]*$'), '') END AS file_name
  FROM pages_r
), pages_t AS (
  SELECT *, CASE WHEN content_type = 'text/csv' OR file_name LIKE '%.csv' THEN 'CSV' WHEN file_name LIKE '%.tsv' THEN 'TSV' ELSE 'UNKNOWN' END AS file_type
  FROM pages_n
)"""

# The lines of orders as fields, numbered; kept: whether the delimiter can be told (a blank line at the end hides it).
ORDERS = r"""
fields AS (
  SELECT l_orderkey AS response_id, l_linenumber AS n,
         [CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR),
          CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), l_returnflag, strftime(l_shipdate, '%Y-%m-%d')] AS f,
         [',', ';', chr(9), '|'][CAST(l_orderkey % 4 AS INTEGER) + 1] AS d
  FROM lineitem
), numbered AS (
  SELECT response_id, d, f, row_number() OVER (PARTITION BY response_id ORDER BY n, (f[1] || d || f[2] || d || f[3] || d || f[4] || d || f[5] || d || f[6])) AS row_idx
  FROM fields
), order_rows AS (
  SELECT response_id, d, row_idx, f FROM numbered
  UNION ALL
  SELECT DISTINCT response_id, d, 0, ['line', 'part', 'quantity', 'price', 'flag', 'shipped'] FROM numbered
), told AS (
  SELECT * FROM order_rows WHERE NOT (response_id % 5 = 0 AND response_id % 3 <> 2)
), order_sizes AS (
  SELECT response_id, any_value(d) AS d, count(*) AS n_rows, sum(strlen((f[1] || d || f[2] || d || f[3] || d || f[4] || d || f[5] || d || f[6]))) AS chars FROM order_rows GROUP BY response_id
), order_bodies AS (
  SELECT response_id, d, n_rows,
         chars + (n_rows - 1 + CASE WHEN response_id % 3 = 2 THEN 0 ELSE 1 END + CASE WHEN response_id % 5 = 0 THEN 1 ELSE 0 END)
           * CASE WHEN response_id % 3 = 1 THEN 2 ELSE 1 END AS n,
         CASE WHEN response_id % 5 = 0 AND response_id % 3 <> 2 THEN 'UNKNOWN' WHEN d = chr(9) THEN 'TSV' ELSE 'CSV' END AS file_type
  FROM order_sizes
)"""

# Staged workbook rows and cells, one workbook for each supplier.
BOOKS = r"""
book_lines AS (
  SELECT *, l_suppkey AS response_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_returnflag, l_linestatus) - 1 AS n
  FROM lineitem
), book_rows AS (
  SELECT response_id, n, CASE WHEN n % 7 = 6 THEN NULL ELSE n + 1 + 2 * ((n + 1) // 10) END AS declared FROM book_lines
), placed AS (
  SELECT response_id, n, n + greatest(0, coalesce(max(declared - 1 - n) OVER (PARTITION BY response_id ORDER BY n), 0)) AS row_idx FROM book_rows
), shown AS (
  SELECT response_id, n AS row_n, unnest([0, 1, 2, 3, 4, 5, 6]) AS cell_n,
         unnest([l_returnflag, regexp_replace(regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', ''),
                 strftime(l_shipdate, '%Y-%m-%d'), CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'FALSE' END,
                 CAST(l_partkey AS VARCHAR), l_linestatus, CASE WHEN n % 11 = 0 THEN 'note' ELSE '' END]) AS text
  FROM book_lines
), book_cells AS (
  SELECT s.response_id, 0 AS sheet_idx, p.row_idx, s.cell_n AS col_idx, s.text
  FROM shown s JOIN placed p ON s.response_id = p.response_id AND s.row_n = p.n
  WHERE NOT (s.cell_n = 6 AND s.text = '')
)"""

MIX = r"""
mix AS (
  SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS response_id, CAST(p_partkey AS INTEGER) AS row_idx,
         CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 3 <> 0 THEN p_name
              WHEN p_partkey % 6 = 0 AND p_partkey * 7 % 5000 >= 1000 THEN CAST(p_partkey * 7 % 5000 // 1000 AS VARCHAR) || ',' || lpad(CAST(p_partkey * 7 % 5000 % 1000 AS VARCHAR), 3, '0')
              ELSE CAST(p_partkey * 7 % 5000 AS VARCHAR) END AS text,
         CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 3 = 0 THEN CAST(p_partkey * 7 % 5000 AS DOUBLE) END AS number
  FROM part
)"""

HUMAN = """CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B'
  WHEN {n} < 1048576 THEN printf('%.1f KB', floor({n} / 1024.0 * 10 + 0.5) / 10)
  ELSE printf('%.1f MB', floor({n} / 1048576.0 * 10 + 0.5) / 10) END"""

STATUS = f"""{PAGES}, outcomes AS (
  SELECT response_id, file_type, CASE WHEN file_type = 'UNKNOWN' THEN 0 ELSE n END AS n, CASE WHEN response_id % 11 = 0 THEN 'bad quote' END AS error, response_id % 3 AS sheets FROM pages_t
), status AS (
  SELECT *, CASE WHEN file_type = 'UNKNOWN' THEN 'nothing' WHEN n > 2048 THEN 'too_large' WHEN error IS NOT NULL THEN 'error' WHEN sheets = 0 THEN 'empty' ELSE 'ok' END AS status
  FROM outcomes
)"""

DATES = r"""
serials AS (
  SELECT DISTINCT datediff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) + (l_quantity % 4) / 4 AS serial, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS INTEGER) % 4 AS quarter
  FROM lineitem
)"""

# Bodies of documents that are compressed by doc_id modulo 8, and what they hold.
PACKED = r"""
packed AS (
  SELECT doc_id AS response_id, doc_id % 8 AS kind, strlen(coalesce(text, '')) AS n, coalesce(text, '') AS text FROM documents
), opened AS (
  SELECT *, kind < 4 AND n + CASE WHEN kind IN (1, 2) THEN 0 ELSE 72 END > 0 AS decompressed,
         CASE WHEN kind IN (0, 3, 6) THEN 'PDF' WHEN kind IN (1, 2, 4) AND position('%PDF' IN left(text, 1028)) > 0 THEN 'PDF' WHEN kind IN (1, 4) THEN 'CSV' WHEN kind = 2 THEN 'TSV' ELSE 'UNKNOWN' END AS file_type,
         CASE WHEN kind IN (1, 2, 4) THEN n ELSE n + 72 END AS size
  FROM packed
)"""

# The lines of large exports in their order.
EXPORTS = r"""
export_lines AS (
  SELECT l_orderkey // 8192 AS response_id, l_orderkey, l_linenumber,
         [CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR),
          CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag || ', "' || l_linestatus || '"' || chr(10) ELSE '' END || strftime(l_shipdate, '%Y-%m-%d')] AS f
  FROM lineitem
), exported AS (
  SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY l_orderkey, l_linenumber, CAST(f[3] AS VARCHAR) || ',' || f[4]) - 1 AS row_idx FROM export_lines
)"""

# The workbooks of customers: rows of their orders, and which books are locked or early.
EARLY_BOOKS = r"""
book_orders AS (
  SELECT o_custkey AS response_id, o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(o_orderdate AS DATE) AS day, o_orderpriority,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)), o_orderdate, o_orderpriority) - 1 AS row_idx
  FROM orders
), xls_cells AS (
  SELECT response_id, 0 AS sheet_idx, CAST(row_idx AS INTEGER) AS row_idx, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS col_idx,
         unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, regexp_replace(regexp_replace(CAST(price AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', ''),
                 strftime(day, '%Y-%m-%d'), CAST(row_idx % 4096 AS VARCHAR), o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN 'TRUE' ELSE 'FALSE' END,
                 ['#NULL!', '#DIV/0!', '#N/A'][CAST(o_orderkey % 3 AS INTEGER) + 1]]) AS text
  FROM book_orders WHERE response_id % 11 <> 3
)"""

# Books of many sheets: which are found, and their rows.
MANY_SHEETS = r"""
customers AS (
  SELECT DISTINCT o_custkey AS k, o_custkey // 25 AS response_id, CASE WHEN o_custkey % 7 = 3 THEN 'Sheet' ELSE 'C' || o_custkey END AS name, o_custkey % 5 <> 2 AND o_custkey % 11 <> 7 AS found FROM orders
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY k) - 1 AS place, row_number() OVER (PARTITION BY response_id, found ORDER BY k) - 1 AS sheet_idx FROM customers
), sheet_rows AS (
  SELECT n.response_id, n.sheet_idx, n.name, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE)) - 1 AS row_idx
  FROM orders JOIN numbered n ON o_custkey = n.k WHERE n.found
)"""

SQL: dict[str, str] = {
    "s3_many_sheets": f"""WITH {MANY_SHEETS} SELECT response_id, CAST(sheet_idx AS INTEGER) AS sheet_idx, CAST(row_idx AS INTEGER) AS row_idx, unnest([0, 1, 2]) AS col_idx,
  unnest([CAST(o_orderkey AS VARCHAR), CASE WHEN response_id % 2 = 0 THEN strftime(day, '%Y-%m-%d') ELSE CAST(datediff('day', DATE '1899-12-30', day) AS VARCHAR) END, o_orderstatus]) AS text FROM sheet_rows""",
    "x1_x2_many_sheets": f"""WITH {MANY_SHEETS} SELECT response_id, 'sheet' AS kind, CAST(sheet_idx AS INTEGER) AS place, name || ' ' || count(*) || ' 3' AS message FROM sheet_rows GROUP BY response_id, sheet_idx, name
UNION ALL SELECT response_id, 'warning', CAST(place AS INTEGER), 'Sheet "' || name || '" could not be located inside the container' FROM numbered WHERE NOT found""",
    "d2_compressed_flags": f"WITH {PACKED} SELECT response_id, kind IN (0, 3, 5) AS gzip, kind IN (1, 2, 4) AS mentioned FROM packed",
    "d3_expanded_bodies": f"""WITH {PACKED} SELECT response_id, file_type, file_type <> 'UNKNOWN' AND decompressed AS decompressed, CAST(CASE WHEN file_type = 'UNKNOWN' THEN 0 ELSE size END AS INTEGER) AS n_bytes,
  sha256(CASE WHEN file_type = 'UNKNOWN' THEN '' WHEN kind IN (0, 3, 6) THEN '%PDF-1.7' || repeat(' ', 64) || text ELSE text END) AS digest, file_type <> 'UNKNOWN' AS has_length FROM opened""",
    "d3_many_members": """WITH b AS (SELECT doc_id // 20 AS response_id, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)
SELECT response_id, 'CSV' AS file_type, true AS decompressed, CAST(strlen(t) AS INTEGER) AS n_bytes, sha256(t) AS digest FROM b""",
    "d9_legacy_excel": """WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT k AS response_id, true AS excel FROM c UNION ALL SELECT -1 - k, k % 2 = 0 OR k % 3 = 0 FROM c)
SELECT response_id, excel, CASE WHEN excel THEN 'XLS' ELSE 'UNKNOWN' END AS file_type FROM b""",
    "d15_sniff_against_detect": f"WITH {PACKED} SELECT response_id, CASE WHEN kind = 5 THEN 'PDF' WHEN kind IN (1, 2) AND position('%PDF' IN left(text, 64)) = 0 THEN CASE kind WHEN 1 THEN 'CSV' ELSE 'TSV' END ELSE file_type END AS sniffed, file_type FROM opened",
    "f10_expanded_header": f"WITH {PACKED} SELECT response_id, file_type AS type_badge, decompressed AS gzip, {HUMAN.format(n='size')} AS size, decompressed AS expanded FROM opened WHERE file_type <> 'UNKNOWN'",
    "s4_xls_cells": f"WITH {EARLY_BOOKS} SELECT response_id, sheet_idx, row_idx, col_idx, text FROM xls_cells",
    "x12_packed_numbers": f"WITH {EARLY_BOOKS} SELECT response_id, col_idx, round(sum(CAST(text AS DOUBLE)), 2) AS total, count(*) AS n FROM xls_cells WHERE col_idx IN (2, 4) GROUP BY ALL",
    "x14_formula_values": f"WITH {EARLY_BOOKS} SELECT response_id, col_idx, text, count(*) AS n FROM xls_cells WHERE col_idx IN (5, 6) GROUP BY ALL",
    "x16_xls_messages": f"""WITH {EARLY_BOOKS}, b AS (SELECT response_id, count(*) AS n FROM book_orders GROUP BY 1)
SELECT response_id, 'errors' AS kind, 'Workbook is password protected' AS message FROM b WHERE response_id % 11 = 3
UNION ALL SELECT response_id, 'warnings', 'Excel 5/95 workbook: text cells may render incorrectly' FROM b WHERE response_id % 11 = 4
UNION ALL SELECT response_id, 'sheets', 'Orders ' || n || ' 8' FROM b WHERE response_id % 11 <> 3""",
    "s1_read_responses": f"WITH {PAGES} SELECT response_id, request_path, content_type, CAST(n AS INTEGER) AS n_bytes, n BETWEEN 1 AND 3000 AS ok FROM pages_r",
    "k1_savable_bodies": f"WITH {PAGES} SELECT response_id, file_type, coalesce(nullif(file_name, ''), 'response' || CASE file_type WHEN 'CSV' THEN '.csv' ELSE '.tsv' END) AS suggested_name, CAST(n AS INTEGER) AS n_bytes FROM pages_t WHERE file_type <> 'UNKNOWN' AND n > 0",
    "k2_csv_export": f"WITH {ORDERS} SELECT CAST(response_id AS INTEGER) AS response_id, count(*) AS n_lines, CAST(sum(length(array_to_string(f, ','))) AS BIGINT) AS n_chars FROM told GROUP BY response_id",
    "s3_xlsx_cells": r"""WITH r AS (
  SELECT o_custkey AS response_id, o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS price,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)) - 1 AS row_idx FROM orders)
SELECT response_id, 0 AS sheet_idx, CAST(row_idx AS INTEGER) AS row_idx, unnest([0, 1, 2]) AS col_idx,
       unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, regexp_replace(regexp_replace(CAST(price AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '')]) AS text FROM r""",
    "s3_rich_xlsx_cells": r"""WITH r AS (
  SELECT o_custkey AS response_id, o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(12,2)) AS price,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE), CAST(o_totalprice AS DECIMAL(12,2))) - 1 AS k FROM orders), c AS (
SELECT response_id, 0 AS sheet_idx, CAST(2 * k AS INTEGER) AS row_idx, unnest([0, 2, 3, 4, 5, 6, 7]) AS col_idx,
       unnest([o_orderpriority, strftime(day, '%Y-%m-%d'), o_orderstatus || ' & status', CASE WHEN o_orderstatus = 'O' THEN 'TRUE' ELSE 'FALSE' END, o_orderkey || '!',
               CASE WHEN o_orderkey % 2 = 0 THEN '#N/A' ELSE '' END, regexp_replace(regexp_replace(CAST(price AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '')]) AS text FROM r)
SELECT * FROM c WHERE text <> ''""",
    "t2_stream_updates": """WITH r AS (SELECT event_id % 4 AS batch, user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1, 2)
SELECT CAST(batch AS INTEGER) AS batch, user_id, event_id, event_type FROM r QUALIFY event_id > coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)""",
    "t2_latest_stream": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "d4_d6_file_name": f"WITH {PAGES} SELECT response_id, file_name FROM pages_n",
    "d7_pdf_marker": r"SELECT doc_id AS response_id, (doc_id % 7 IN (0, 1)) OR (doc_id % 7 > 2 AND position('%PDF' IN left(text, 1028)) > 0) AS pdf, false AS gzip, false AS zip FROM documents",
    "d10_declared_type": f"WITH {PAGES} SELECT response_id, nullif(file_type, 'UNKNOWN') AS declared, false AS compressed FROM pages_t",
    "d11_mostly_printable": r"""WITH t AS (SELECT doc_id, left(CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', chr(1)) ELSE text END, 8192) AS head FROM documents)
SELECT doc_id, length(head) > 0 AND (length(head) - length(regexp_replace(head, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'))) * 100 < length(head) AS printable FROM t""",
    "d12_guess_delimiter": r"""WITH t AS (
  SELECT doc_id, regexp_replace(left(text, 8192), '^\s+', '') AS t FROM documents
), l AS (
  SELECT doc_id, t, string_split(regexp_replace(t, '"(?:[^"]|"")*(?:"|\z)', '', 'g'), chr(10)) AS lines FROM t
), c AS (
  SELECT doc_id, t, k, d, list_transform(list_slice(lines, 1, len(lines) - 1), lambda x: length(x) - length(replace(x, d, '')) + 1) AS counts
  FROM l, (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) AS v(k, d)
), f AS (
  SELECT doc_id, t, k, d, list_slice(counts, first, first + 19) AS sample
  FROM (SELECT *, list_position(list_transform(counts, lambda x: x > 1), true) AS first FROM c) WHERE first > 0
), s AS (
  SELECT doc_id, d, list_max(sample) AS n, k FROM f WHERE list_min(sample) = list_max(sample) AND left(t, 1) NOT IN ('<', '{', '[')
), best AS (
  SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS place FROM s
)
SELECT documents.doc_id, best.d AS delimiter FROM documents LEFT JOIN best ON best.doc_id = documents.doc_id AND place = 1""",
    "d13_classify_orders": f"WITH {ORDERS} SELECT response_id, file_type FROM order_bodies",
    "d14_detect": f"""WITH {PAGES} SELECT response_id, file_type, CASE WHEN file_type <> 'UNKNOWN' THEN file_name END AS file_name, false AS decompressed,
  CAST(CASE WHEN file_type <> 'UNKNOWN' THEN n ELSE 0 END AS INTEGER) AS original_length, CAST(CASE WHEN file_type <> 'UNKNOWN' THEN n ELSE 0 END AS INTEGER) AS n_bytes FROM pages_t""",
    "d16_renderable": f"WITH {PAGES} SELECT response_id, file_type FROM pages_t WHERE file_type <> 'UNKNOWN'",
    "d18_open_status": f"""WITH {STATUS} SELECT response_id, file_type, status,
  CASE status WHEN 'too_large' THEN 'File is too large to open as a table' WHEN 'error' THEN 'Could not read this ' || file_type WHEN 'empty' THEN 'No sheets in this file' ELSE '' END AS title,
  CASE status WHEN 'too_large' THEN ({HUMAN.format(n="n")}) || ' exceeds the 2.0 KB parse limit' WHEN 'error' THEN error ELSE '' END AS detail FROM status""",
    "f1_number_text": r"""WITH p AS (SELECT l_extendedprice, l_discount, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_extendedprice, l_discount, n,
  regexp_replace(regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS price,
  CASE WHEN l_discount = 0 THEN '0' ELSE '-' || regexp_replace(CAST(CAST(l_discount AS DECIMAL(12,2)) AS VARCHAR), '0+$', '') END AS discount FROM p""",
    "f2_date_serial_text": f"""WITH {DATES}, s AS (SELECT serial, strftime(day, '%Y-%m-%d') || CASE quarter WHEN 0 THEN '' WHEN 1 THEN ' 06:00:00' WHEN 2 THEN ' 12:00:00' ELSE ' 18:00:00' END AS shown FROM serials)
SELECT serial, shown, shown AS shown_1904 FROM s""",
    "f3_f4_date_formats": "SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN regexp_matches(p_name, '[ydhsmYDHSM]') WHEN 4 THEN true ELSE false END AS custom, p_size BETWEEN 14 AND 22 OR p_size BETWEEN 27 AND 36 OR p_size BETWEEN 45 AND 47 OR p_size BETWEEN 50 AND 58 AS builtin FROM part",
    "f5_clamp_cell": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN length(text) > 400 THEN left(text, 400) || '…' ELSE text END AS clamped FROM documents",
    "f6_as_number": f"WITH {MIX} SELECT row_idx, number FROM mix",
    "f7_f8_columns": """WITH i AS (SELECT p_partkey, CAST(p_partkey % 18278 AS INTEGER) AS i FROM part)
SELECT p_partkey, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(64 + i // 26) || chr(65 + i % 26)
  ELSE chr(65 + (i - 702) // 676) || chr(65 + (i - 702) // 26 % 26) || chr(65 + (i - 702) % 26) END AS letters, i AS column, -1 AS none FROM i""",
    "f9_human_bytes": f"WITH o AS (SELECT o_orderkey, o_orderkey * o_orderkey * 37 % 50000000 AS n FROM orders) SELECT o_orderkey, {HUMAN.format(n='n')} AS shown FROM o",
    "f10_f13_file_header": f"WITH {PAGES} SELECT response_id, file_type AS type_badge, coalesce(file_name, '(unnamed)') AS name, false AS gzip, {HUMAN.format(n='n')} AS meta FROM pages_t WHERE file_type <> 'UNKNOWN'",
    "f11_suggested_name": f"""WITH {PAGES} SELECT response_id,
  coalesce(CASE WHEN response_id % 2 = 0 THEN nullif(file_name, '') END, 'response' || CASE response_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.xls' WHEN 3 THEN '.tsv' WHEN 4 THEN '.csv' ELSE '.bin' END) AS suggested_name,
  CASE response_id % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'Excel' WHEN 2 THEN 'Excel' WHEN 3 THEN 'TSV' WHEN 4 THEN 'CSV' ELSE 'File' END AS caption, response_id % 6 BETWEEN 1 AND 4 AS tabular FROM pages_n""",
    "f12_csv_quote": """SELECT doc_id, CASE WHEN text LIKE '%,%' OR text LIKE '%"%' OR position(chr(10) IN text) > 0 OR position(chr(13) IN text) > 0 THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS quoted FROM documents""",
    "x13_boolerr_text": """SELECT p_partkey, CASE WHEN p_partkey % 2 <> 0 THEN CASE WHEN p_size <> 0 THEN 'TRUE' ELSE 'FALSE' END
  WHEN p_size = 0 THEN '#NULL!' WHEN p_size = 7 THEN '#DIV/0!' WHEN p_size = 15 THEN '#VALUE!' WHEN p_size = 23 THEN '#REF!' WHEN p_size = 29 THEN '#NAME?' WHEN p_size = 36 THEN '#NUM!' WHEN p_size = 42 THEN '#N/A' ELSE '#ERR!' END AS shown FROM part""",
    "c2_delimiter_of_orders": f"WITH {ORDERS} SELECT response_id, file_type, CASE WHEN file_type = 'UNKNOWN' THEN ',' ELSE d END AS delimiter FROM order_bodies",
    "c3_order_cells": f"WITH {ORDERS} SELECT response_id, 0 AS sheet_idx, CAST(row_idx AS INTEGER) AS row_idx, unnest([0, 1, 2, 3, 4, 5]) AS col_idx, unnest(f) AS text FROM told",
    "c4_quoted_fields": "SELECT doc_id // 50 AS response_id, CAST(row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS INTEGER) AS row_idx, CAST(doc_id AS VARCHAR) AS doc_id, lang, CASE WHEN length(text) > 32768 THEN left(text, 32768) || '…' ELSE text END AS text, 3 AS n FROM documents",
    "c1_encodings": r"SELECT doc_id AS response_id, 'é;' || CASE WHEN doc_id % 5 = 4 THEN regexp_replace(text, '[^\x00-\xff]', '?', 'g') ELSE text END AS text FROM documents",
    "c3_large_bodies": f"WITH {EXPORTS} SELECT response_id, CAST(row_idx AS INTEGER) AS row_idx, array_to_string(f, '|') AS cells FROM exported",
    "c5_blank_rows": f"""WITH {EXPORTS}, n AS (SELECT response_id, count(*) AS n FROM exported GROUP BY 1)
SELECT response_id, CAST(response_id AS VARCHAR) || '.csv' AS name, CAST(least(n, 5000) AS INTEGER) AS n_rows, 4 AS n_cols, n >= 5000 AS truncated, CAST(row_idx AS INTEGER) AS last_row, f[1] AS last_key
FROM n JOIN exported USING (response_id) WHERE row_idx = least(n, 5000) - 1""",
    "g7_large_export": f"""WITH {EXPORTS}, lines AS (
  SELECT response_id, row_idx, CAST(f[3] AS DECIMAL(12,2)) AS price,
         array_to_string(list_transform(f, lambda x: CASE WHEN regexp_matches(x, '[,"\n\r]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), ',') AS line FROM exported)
SELECT response_id, CAST(CASE WHEN row_idx = 0 THEN 0 ELSE row_number() OVER (PARTITION BY response_id, row_idx = 0 ORDER BY price DESC, row_idx) END AS INTEGER) AS line_no, line FROM lines""",
    "c6_capped_rows": f"""WITH {ORDERS} SELECT response_id, CAST(response_id AS VARCHAR) AS name, CAST(least(n_rows, 4) AS INTEGER) AS n_rows, 5 AS n_cols, true AS truncated
  FROM order_bodies WHERE file_type <> 'UNKNOWN'""",
    "x1_sheet_catalogue": "SELECT DISTINCT l_suppkey AS response_id, 0 AS sheet_idx, 'Lines' AS name, 'xl/worksheets/sheet1.xml' AS part FROM lineitem",
    "x2_missing_sheets": """SELECT DISTINCT l_suppkey AS response_id, 1 AS seq, 'Sheet "Lost" could not be located inside the container' AS message FROM lineitem""",
    "x4_style_is_date": "SELECT DISTINCT l_suppkey AS response_id, unnest([0, 1]) AS style_idx, unnest([false, true]) AS is_date FROM lineitem",
    "x3_x5_cell_text": f"WITH {BOOKS} SELECT response_id, CAST(row_n AS INTEGER) AS row_n, cell_n, text FROM shown",
    "x6_place_rows": f"""WITH {BOOKS}, capped AS (
  SELECT response_id, n, n + greatest(0, coalesce(max(CASE WHEN declared IS NOT NULL THEN least(declared - 1, 500) END - n) OVER (PARTITION BY response_id ORDER BY n), 0)) AS row_idx FROM book_rows
), ended AS (
  SELECT *, coalesce(max(CASE WHEN row_idx + 1 >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY response_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM capped
)
SELECT response_id, CAST(n AS INTEGER) AS n, CAST(row_idx AS INTEGER) AS row_idx, row_idx + 1 >= 500 AS truncated FROM ended WHERE over = 0""",
    "x7_place_columns": f"WITH {BOOKS} SELECT response_id, CAST(row_n AS INTEGER) AS row_n, cell_n, cell_n AS col_idx FROM shown",
    "x8_last_cell_wins": """SELECT l_orderkey % 97 AS response_id, 0 AS sheet_idx, CAST(l_orderkey % 50 AS INTEGER) AS row_idx, l_linenumber AS col_idx, CAST(l_partkey AS VARCHAR) AS text FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey % 97, l_orderkey % 50, l_linenumber ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    "x9_cut_wide_rows": """WITH cap AS (SELECT max(l_partkey) - 2 AS cap FROM lineitem), cuts AS (
  SELECT l_suppkey AS response_id, min(l_orderkey // 10) AS cut_at FROM lineitem, cap WHERE l_partkey >= cap GROUP BY 1
), kept AS (
  SELECT l_suppkey AS response_id, count(*) AS kept, max(l_orderkey // 10) AS last_row FROM lineitem LEFT JOIN cuts ON l_suppkey = response_id
  WHERE cut_at IS NULL OR l_orderkey // 10 < cut_at GROUP BY 1
)
SELECT coalesce(kept.response_id, cuts.response_id) AS response_id, coalesce(kept, -1) AS kept, coalesce(last_row, -1) AS last_row, coalesce(cut_at, -1) AS cut_at FROM kept FULL JOIN cuts ON kept.response_id = cuts.response_id""",
    "x10_assembled_cells": f"WITH {BOOKS} SELECT response_id, sheet_idx, CAST(row_idx AS INTEGER) AS row_idx, col_idx, text FROM book_cells",
    "x11_dense_rows": f"""WITH {BOOKS}, chosen AS (SELECT * FROM book_cells), lists AS (
  SELECT response_id, row_idx, string_agg(text, '|' ORDER BY col_idx) AS cells, count(*) AS width FROM chosen GROUP BY ALL
), every AS (
  SELECT response_id, unnest(range(CAST(max(row_idx) + 1 AS BIGINT))) AS row_idx FROM chosen GROUP BY response_id
)
SELECT e.response_id, CAST(e.row_idx AS INTEGER) AS row_idx, coalesce(cells, '') AS cells, CAST(coalesce(width, 0) AS INTEGER) AS width FROM every e LEFT JOIN lists l ON e.response_id = l.response_id AND e.row_idx = l.row_idx""",
    "x15_out_of_bounds": "SELECT l_orderkey, count(*) AS cells FROM lineitem WHERE l_orderkey < 900 AND l_partkey < 150 GROUP BY 1",
    "x17_all_cells": f"""WITH {ORDERS}, {EARLY_BOOKS} SELECT response_id, CAST(sum(len(f)) AS BIGINT) AS cells, CAST(sum(length(array_to_string(f, ''))) AS BIGINT) AS chars FROM told GROUP BY response_id
UNION ALL
SELECT -1 - o_custkey, count(*) * 3, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderstatus) + length(regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''))) AS BIGINT) FROM orders GROUP BY o_custkey
UNION ALL
SELECT -1000000000 - response_id, count(*), CAST(sum(length(text)) AS BIGINT) FROM xls_cells GROUP BY response_id""",
    "g1_to_wide": f"""WITH {ORDERS} SELECT response_id, 0 AS sheet_idx, CAST(row_idx AS INTEGER) AS row_idx, f[1] AS line, f[2] AS part, f[3] AS line_2, f[4] AS "D", f[5] AS "E", f[6] AS "F", '' AS "G" FROM told""",
    "g2_g3_header": f"WITH {ORDERS} SELECT response_id, CAST(row_idx + 1 AS INTEGER) AS source_row, 'line,part,quantity,price,flag,shipped' AS header, f[4] AS price FROM told WHERE row_idx > 0",
    "g4_filter": f"""WITH {ORDERS} SELECT response_id, CAST(row_idx + 1 AS INTEGER) AS source_row FROM told WHERE row_idx > 0 AND f[5] = 'R'
UNION ALL SELECT response_id, CAST(row_idx + 1 AS INTEGER) FROM told WHERE row_idx > 0 AND len(list_filter(f, lambda c: position('7.5' IN c) > 0)) > 0""",
    "g5_sort": f"""WITH {MIX} SELECT response_id, row_idx,
  CAST(row_number() OVER (PARTITION BY response_id ORDER BY number IS NULL, number, lower(text), row_idx) AS INTEGER) AS rank,
  CAST(row_number() OVER (PARTITION BY response_id ORDER BY number IS NULL DESC, CASE WHEN number IS NULL THEN lower(text) END DESC, number DESC, row_idx) AS INTEGER) AS rank_down FROM mix""",
    "g6_row_counts": f"""WITH {ORDERS}, c AS (SELECT response_id, count(*) FILTER (WHERE row_idx > 0) AS total, count(*) FILTER (WHERE row_idx > 0 AND f[5] = 'R') AS shown FROM told GROUP BY 1)
SELECT response_id, CASE WHEN total = shown THEN total || CASE WHEN total = 1 THEN ' row' ELSE ' rows' END ELSE shown || ' of ' || total || ' rows' END || ' · 6 cols' AS counts FROM c""",
    "g7_csv_lines": f"WITH {ORDERS} SELECT response_id, CAST(row_idx AS INTEGER) AS line_no, array_to_string(f, ',') AS line FROM told",
    "g8_numeric_cells": f"""WITH {ORDERS}, c AS (SELECT response_id, unnest([0, 1, 2, 3, 4, 5]) AS col_idx, row_idx FROM told)
SELECT response_id, col_idx, count(*) FILTER (WHERE row_idx > 0 AND col_idx < 4) AS numeric, count(*) AS total FROM c GROUP BY ALL""",
    "g9_column_widths": f"""WITH {ORDERS}, c AS (SELECT response_id, unnest([0, 1, 2, 3, 4, 5]) AS col_idx, unnest(f) AS text FROM told WHERE row_idx <= 3)
SELECT response_id, col_idx, CAST(max(length(text)) AS INTEGER) AS width FROM c GROUP BY ALL""",
    "g10_notices": f"""WITH {ORDERS}, t AS (
  SELECT response_id, n_rows - CASE WHEN response_id % 3 = 2 AND response_id % 5 <> 0 THEN 1 ELSE 0 END >= 4 AS cut FROM order_bodies WHERE file_type <> 'UNKNOWN')
SELECT response_id, concat_ws(' · ', CASE WHEN response_id % 3 = 0 THEN 'first · second' END, CASE WHEN cut THEN '"' || response_id || '" truncated at the row/column cap' END) AS notice FROM t WHERE cut OR response_id % 3 = 0""",
    "g11_sample_head": f"WITH {ORDERS} SELECT response_id, count(*) AS n, CAST(max(row_idx) + 1 AS INTEGER) AS last FROM told WHERE row_idx BETWEEN 1 AND 2 GROUP BY 1",
    "a1_sheet_shape": f"WITH {BOOKS} SELECT response_id, 0 AS sheet_idx, 'Lines' AS name, CAST(max(row_idx) + 1 AS INTEGER) AS n_rows, CAST(max(col_idx) + 1 AS INTEGER) AS n_cols, false AS truncated FROM book_cells GROUP BY 1",
    "a2_triage_summary": f"""WITH {PAGES}, {ORDERS}, every AS (
  SELECT file_type, CASE WHEN file_type = 'UNKNOWN' THEN 0 ELSE n END AS n FROM pages_t UNION ALL SELECT file_type, CASE WHEN file_type = 'UNKNOWN' THEN 0 ELSE n END FROM order_bodies)
SELECT file_type, count(*) AS files, CAST(sum(n) AS BIGINT) AS wire_bytes, CAST(sum(n) AS BIGINT) AS expanded_bytes, CAST(0 AS BIGINT) AS compressed FROM every GROUP BY 1""",
    "a3_open_summary": f"WITH {STATUS} SELECT file_type, status, count(*) AS files FROM status GROUP BY ALL",
    "t1_triage_stream": f"WITH {PAGES} SELECT response_id, file_type FROM pages_t WHERE file_type <> 'UNKNOWN'",
    "t2_latest_per_view": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
