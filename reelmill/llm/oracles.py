"""DuckDB texts for the queries that SQL can express."""

from __future__ import annotations

from reelmill.llm.common import UPPER
from reelmill.llm.importance import BUCKETS, SEED
from reelmill.llm.sharding import MULTIPLIER
from reelmill.llm.spelling import MODULUS

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS shingle FROM s),
met AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM met JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT a, v FROM reach JOIN links ON b = u
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k),
hit AS (
  SELECT doc_id, item_id, i, di.k AS k FROM di JOIN bw ON di.k = bw.k AND array_to_string(w[i : i + di.k - 1], ' ') = win
), places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _jump(shards: int) -> str:
    return f"""(
  WITH RECURSIVE j(doc_id, at_, to_, state) AS (
    SELECT DISTINCT doc_id, -1::BIGINT, 0::BIGINT, doc_id::HUGEINT FROM documents
    UNION ALL
    SELECT doc_id, to_, floor((to_ + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next_ // 8589934592) + 1)::DOUBLE))::BIGINT, next_
    FROM (SELECT *, (state * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next_ FROM j WHERE to_ < {shards})
  ) SELECT doc_id, max(at_) AS shard FROM j GROUP BY doc_id)"""


# The table of the 32-bit cyclic redundancy check for half bytes follows from its polynomial.
SHARDS = f"""
WITH steps AS (SELECT list_transform(range(16), lambda n: list_reduce(list_concat([n::BIGINT], [0::BIGINT, 0, 0, 0]),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
halves AS (
  SELECT doc_id, text, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: (strpos('0123456789ABCDEF', c) - 1)::BIGINT) AS h
  FROM documents
), ordered AS (
  SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN []::BIGINT[] ELSE
    list_transform(range(len(h)), lambda i: h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) END AS h
  FROM halves
), sized AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], h), lambda c, x: xor(c // 16, t[xor(c % 16, x) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM ordered, steps
), a AS (SELECT * FROM {_jump(40)}), b AS (SELECT * FROM {_jump(41)})
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY a.shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, b.shard::INTEGER AS grown_shard
FROM sized JOIN a USING (doc_id) JOIN b USING (doc_id)
"""

_STEPS = """steps AS (SELECT list_transform(range(16), lambda n: list_reduce(list_concat([n::BIGINT], [0::BIGINT, 0, 0, 0]),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def _crc32(text: str) -> str:
    """The CRC-32 of a text that is not empty, by half bytes (low before high) of the table ``steps``."""
    digits = f"list_transform(string_split(hex(encode({text})), ''), lambda d: (strpos('0123456789ABCDEF', d) - 1)::BIGINT)"
    turned = "list_transform(range(len(h)), lambda i: h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END])"
    return f"""(SELECT xor(list_reduce(list_concat([4294967295::BIGINT], {turned}), lambda c, x: xor(c // 16, t[xor(c % 16, x) + 1])),
    4294967295)::BIGINT FROM (SELECT {digits} AS h))"""


def _features(table: str, id_col: str) -> str:
    return f"""(
  SELECT id, len(w) AS n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM (SELECT {id_col} AS id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}))"""


IMPORTANCE = f"""
WITH {_STEPS}, d AS MATERIALIZED (SELECT * FROM {_features('documents', 'doc_id')}), b AS MATERIALIZED (SELECT * FROM {_features('benchmark', 'item_id')}),
known AS MATERIALIZED (
  SELECT f, {_crc32('f')} % {BUCKETS} AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b), steps
), s AS (SELECT bucket, count(*) AS n FROM d JOIN known USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN known USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS s, (SELECT count(*) FROM b)::DOUBLE AS t),
gains AS (
  SELECT r AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * (sums.t + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) q(r) LEFT JOIN s ON s.bucket = r LEFT JOIN t ON t.bucket = r, sums
), weights AS (
  SELECT id, max(n_words) AS n_words, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN known USING (f) JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

ARCHIVES = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END::BIGINT AS refers_to
FROM p JOIN g USING (h)
"""

SPELLING = f"""
WITH RECURSIVE {_STEPS}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL
), told AS (SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM runs, steps),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % {MODULUS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM told)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, first(other ORDER BY m DESC, other) AS other FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)
), paths(word, at_, steps) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT p.word, f.form, steps + 1 FROM paths p JOIN formed f ON f.word = at_ WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN (SELECT word, arg_max(at_, steps) AS root FROM paths GROUP BY word) USING (word)
"""

SQL: dict[str, str] = {"op3_near_duplicates": NEAR_DUPLICATES, "op4_shards": SHARDS, "op5_contamination": CONTAMINATION,
                       "op11_importance": IMPORTANCE, "op12_warc": ARCHIVES, "op13_spelling": SPELLING}
