"""The logical tables expressed over the driver's Parquet tables.

One SQL text per view, shared word for word by Spark and by the SQL checks.
``{TS}`` and ``{STR}`` are the only engine-specific names.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

AS_OF = datetime(2024, 1, 31)

VIEWS: dict[str, str] = {}

# One row per (user, movie): the newest order line wins. Votes for movies with
# key % 23 = 7 are booked on the movie before, which leaves movies without votes.
VIEWS["fx_rating"] = """
SELECT user_id, movie_id, rating, updated_at FROM (
  SELECT v.user_id, v.movie_id, v.rating, v.updated_at,
         row_number() OVER (PARTITION BY v.user_id, v.movie_id
                            ORDER BY v.l_orderkey DESC, v.l_linenumber DESC, v.l_partkey DESC, v.l_suppkey DESC,
                                     v.l_extendedprice DESC, v.l_quantity DESC) AS rn
  FROM (SELECT o.o_custkey AS user_id,
               l.l_partkey - CASE WHEN l.l_partkey % 23 = 7 THEN 1 ELSE 0 END AS movie_id,
               CAST(ceil(l.l_quantity / 5) AS INT) AS rating,
               CAST('2024-01-01 00:00:00' AS {TS}) + INTERVAL '1' MINUTE * CAST((l.l_orderkey * 29 + l.l_linenumber * 13) % 43200 AS INT) AS updated_at,
               l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey) v) x
WHERE rn = 1
"""

VIEWS["fx_user_click"] = """
SELECT event_id AS id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS movie_id, ts AS created_at
FROM events WHERE event_type IN ('view', 'click')
"""

VIEWS["fx_user_collect_movie"] = """
SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS movie_id, min(ts) AS created_at
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2
"""

VIEWS["fx_movie_comment"] = """
SELECT event_id AS comment_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS movie_id, ts AS created_at,
       CASE WHEN event_type = 'error' THEN ts END AS deleted_at
FROM events WHERE event_type IN ('signup', 'error')
"""

VIEWS["fx_movie"] = """
SELECT p.p_partkey AS movie_id, p.p_name AS title,
       CASE WHEN p.p_size % 11 = 0 THEN NULL ELSE 1970 + p.p_size END AS year,
       CASE WHEN p.p_size % 11 = 0 THEN NULL ELSE DATE '2023-01-01' + CAST(p.p_partkey * 7 % 390 AS INT) END AS release_date,
       CASE WHEN p.p_size % 10 = 0 THEN NULL ELSE p.p_size * 4 END AS duration_min,
       d.text AS summary,
       coalesce(r.rating_sum, 0) AS rating_sum, CAST(coalesce(r.rating_count, 0) AS INT) AS rating_count,
       CASE WHEN p.p_type = 'PROMO' THEN 'draft' WHEN p.p_type = 'ECONOMY' AND p.p_size > 25 THEN 'offline' ELSE 'published' END AS status,
       CASE WHEN p.p_partkey % 17 = 5 THEN CAST('2024-01-15 00:00:00' AS {TS}) END AS deleted_at
FROM part p
LEFT JOIN documents d ON d.doc_id = p.p_partkey
LEFT JOIN (SELECT movie_id, CAST(sum(rating) AS BIGINT) AS rating_sum, count(*) AS rating_count FROM fx_rating GROUP BY movie_id) r
  ON r.movie_id = p.p_partkey
"""

VIEWS["fx_user"] = """
SELECT c_custkey AS user_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'male' WHEN 'AUTOMOBILE' THEN 'female' WHEN 'MACHINERY' THEN 'Female ' ELSE 'unknown' END AS gender,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE DATE '1950-01-01' + CAST(c_custkey * 37 % 25000 AS INT) END AS birth,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS profession,
       CAST('2024-01-30 12:00:00' AS {TS}) - INTERVAL '1' DAY * CAST(c_custkey * 11 % 1500 AS INT) AS created_at,
       CASE WHEN c_acctbal < 0 THEN 'banned' ELSE 'active' END AS status,
       CASE WHEN c_custkey % 31 = 4 THEN CAST('2024-01-20 00:00:00' AS {TS}) END AS deleted_at
FROM customer
"""

VIEWS["fx_tag_dict"] = """
SELECT CAST(row_number() OVER (ORDER BY tag_name) AS BIGINT) AS tag_id, tag_name, type FROM (
  SELECT DISTINCT p_brand AS tag_name, 'static' AS type FROM part
  UNION SELECT DISTINCT p_type, 'static' FROM part
  UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'dynamic' FROM part
  UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'dynamic' FROM part) t
"""

# Tags of movies with key % 41 = 9 sit on the movie before: movies without tags.
VIEWS["fx_movie_tag"] = """
SELECT p.movie_id, t.tag_id,
       CAST((p.movie_id * 7 + t.tag_id * 3) % 10 AS DECIMAL(10, 4)) AS weight,
       CAST((p.movie_id * 3 + t.tag_id * 5) % 40 AS INT) AS vote_up,
       CAST((p.movie_id + t.tag_id) % 7 AS DECIMAL(10, 4)) AS hot_score
FROM (SELECT k.movie_id, k.p_brand AS tag_name FROM
        (SELECT p_partkey - CASE WHEN p_partkey % 41 = 9 THEN 1 ELSE 0 END AS movie_id, p_brand FROM part) k
      UNION SELECT p_partkey - CASE WHEN p_partkey % 41 = 9 THEN 1 ELSE 0 END, p_type FROM part
      UNION SELECT p_partkey - CASE WHEN p_partkey % 41 = 9 THEN 1 ELSE 0 END, split_part(p_name, ' ', 1) FROM part
      UNION SELECT p_partkey - CASE WHEN p_partkey % 41 = 9 THEN 1 ELSE 0 END, split_part(p_name, ' ', 2) FROM part) p
JOIN fx_tag_dict t ON t.tag_name = p.tag_name
"""

# Collected tags of users with key % 7 = 6 are booked on the user before.
VIEWS["fx_user_collect_tag"] = """
SELECT u.user_id, t.tag_id, CASE WHEN t.type = 'static' THEN 1 ELSE 0 END AS is_static,
       CAST('2024-01-02 00:00:00' AS {TS}) + INTERVAL '1' MINUTE * CAST((u.user_id * 17 + t.tag_id) % 40000 AS INT) AS created_at
FROM (SELECT c_custkey - CASE WHEN c_custkey % 7 = 6 THEN 1 ELSE 0 END AS user_id, c_custkey * 5 % 37 + 1 AS tag_id FROM customer
      UNION SELECT c_custkey - CASE WHEN c_custkey % 7 = 6 THEN 1 ELSE 0 END, (c_custkey * 11 + 3) % 37 + 1 FROM customer) u
JOIN fx_tag_dict t ON t.tag_id = u.tag_id
"""

VIEWS["fx_person"] = """
SELECT s_suppkey + 1 AS person_id, CASE WHEN s_suppkey % 19 = 3 THEN '  ' ELSE s_name END AS person_name FROM supplier
"""

VIEWS["fx_movie_person"] = """
SELECT DISTINCT l_partkey * 100000 + l_suppkey + 1 AS movie_person_id, l_partkey AS movie_id, l_suppkey + 1 AS person_id,
       CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN 'director' WHEN 3 THEN 'writer' ELSE 'actor' END AS person_role
FROM lineitem
"""

VIEWS["fx_dict_region"] = """
SELECT n_nationkey + 1 AS region_id, n_name AS name_en,
       CASE n_nationkey % 3 WHEN 0 THEN concat('cn_', n_name) WHEN 1 THEN ' ' END AS name_cn FROM nation
"""

VIEWS["fx_movie_region"] = """
SELECT DISTINCT l.l_partkey AS movie_id, s.s_nationkey + 1 AS region_id
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
"""

VIEWS["fx_dict_language"] = """
SELECT CAST(row_number() OVER (ORDER BY lang) AS BIGINT) AS lang_id, lang AS name_en, CAST(NULL AS {STR}) AS name_cn FROM (SELECT DISTINCT lang FROM documents) t
"""

VIEWS["fx_movie_language"] = """
SELECT x.movie_id, x.lang_id, max(x.is_primary) AS is_primary FROM (
  SELECT d.doc_id AS movie_id, l.lang_id, 1 AS is_primary FROM documents d JOIN fx_dict_language l ON l.name_en = d.lang
  UNION ALL SELECT doc_id, doc_id % 4 + 1, 0 FROM documents) x
GROUP BY x.movie_id, x.lang_id
"""

VIEWS["fx_movie_embeddings"] = """
SELECT vec_id + 1 AS id, vec_id AS movie_id, concat('vec ', vec_id) AS chunk_text,
       CASE WHEN vec_id % 37 = 11 THEN NULL ELSE embedding END AS vec FROM embeddings
"""

VIEWS["fx_item_vectors_alt"] = "SELECT vec_id AS movie_id, embedding AS vec FROM embeddings"

VIEWS["fx_user_vectors"] = "SELECT vec_id AS user_id, embedding AS vec FROM embeddings"

VIEWS["fx_rag_queries"] = "SELECT vec_id AS query_id, embedding AS vec FROM embeddings"

VIEWS["fx_ops_task"] = """
SELECT event_id + 1 AS id, CASE WHEN event_type IN ('view', 'click') THEN 'train_job' WHEN event_type = 'purchase' THEN 'rag_embedding_job' ELSE 'rag_rebuild_job' END AS task_type,
       CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'processing' WHEN 'signup' THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN event_id % 5 = 4 THEN event_id END AS parent_task_id,
       CASE WHEN event_id % 50 = 0 THEN concat('ref-', event_id) END AS task_ref_override,
       props AS payload,
       concat('{"total_movies": ', event_id % 40, ', "processed_movies": ', event_id % 45, '}') AS progress,
       CASE WHEN event_id % 6 = 0 THEN concat('{"elapsed_ms": ', event_id % 9000, '}') ELSE '{}' END AS result,
       ts AS created_at,
       CASE WHEN event_type <> 'view' THEN ts + INTERVAL '1' SECOND END AS started_at,
       CASE WHEN event_type IN ('click', 'signup', 'error') THEN ts + INTERVAL '1' SECOND * CAST(1 + event_id % 600 AS INT) END AS finished_at
FROM events
"""

# Search texts taken from the catalogue: whole titles, single words in other case,
# swapped words, words with a wildcard, language names; plus the empty text and a miss.
VIEWS["fx_search_requests"] = """
SELECT CAST(row_number() OVER (ORDER BY sort_by, sort_order, query) AS INT) AS request_id, query, sort_by, sort_order FROM (
  SELECT DISTINCT p_name AS query, 'default' AS sort_by, 'desc' AS sort_order FROM part
  UNION SELECT DISTINCT upper(split_part(p_name, ' ', 1)), 'time', 'asc' FROM part
  UNION SELECT DISTINCT concat(split_part(p_name, ' ', 2), '  ', split_part(p_name, ' ', 1)), 'rating', 'desc' FROM part
  UNION SELECT DISTINCT concat(substr(p_name, 1, 1), '_', substr(split_part(p_name, ' ', 1), 3)), 'collect', 'desc' FROM part
  UNION SELECT DISTINCT concat('%', split_part(p_name, ' ', 2), '%'), 'duration', 'asc' FROM part
  UNION SELECT DISTINCT concat('zz', n_name), 'default', 'asc' FROM nation
  UNION SELECT DISTINCT substr(p_name, 1, 1), 'collect', 'asc' FROM part
  UNION SELECT '', 'default', 'desc'
  UNION SELECT '   ', 'rating', 'asc'
  UNION SELECT '', 'time', 'desc'
  UNION SELECT '', 'duration', 'desc') q
"""

VIEWS["fx_raw_requests"] = """
SELECT event_id AS request_id,
       CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat('k', user_id) END AS query,
       CASE event_id % 7 WHEN 0 THEN 'Favourite' WHEN 1 THEN ' bayesian_rating' WHEN 2 THEN 'release_date' WHEN 3 THEN 'bogus' WHEN 4 THEN NULL WHEN 5 THEN 'duration' ELSE '' END AS sort_by,
       CASE event_id % 5 WHEN 0 THEN 'ASC' WHEN 1 THEN NULL WHEN 2 THEN 'up' ELSE 'desc' END AS sort_order,
       CASE event_id % 11 WHEN 0 THEN 'week' WHEN 1 THEN 'half-year' WHEN 2 THEN 'month' WHEN 3 THEN 'decade' END AS time_window,
       CASE event_id % 4 WHEN 0 THEN DATE '2024-01-10' + CAST(event_id % 19 AS INT) END AS start_date,
       CASE event_id % 8 WHEN 0 THEN DATE '2024-01-20' WHEN 1 THEN DATE '2024-01-05' END AS end_date,
       CASE event_id % 3 WHEN 0 THEN CAST(event_id % 90 AS INT) END AS duration_min,
       CASE event_id % 2 WHEN 0 THEN CAST(event_id % 120 AS INT) END AS duration_max,
       CASE WHEN event_type = 'click' THEN concat(user_id, ',', event_id % 47, ',', user_id) END AS tag_ids,
       CAST(event_id % 30 - 1 AS INT) AS n, CAST(event_id % 50 - 2 AS INT) AS row_offset
FROM events
"""

# One generated answer per query; its kind of (mal)formation follows from the id.
VIEWS["fx_generated_answers"] = """
SELECT query_id, CAST(query_id % 7 AS INT) AS variant,
       concat('answer text', CASE query_id % 7
         WHEN 0 THEN concat(b, '{"cited_movie_ids":[', query_id, ',"', query_id, '"]}', e)
         WHEN 1 THEN concat(b, '{"cited_movie_ids":[999999999]}', e)
         WHEN 2 THEN concat(b, '{"cited_movie_ids":[]')
         WHEN 3 THEN ' without markers'
         WHEN 4 THEN concat(b, '{"cited_movie_ids":[]}', e)
         WHEN 5 THEN concat(b, '{"cited_movie_ids":[true]}', e)
         ELSE concat(b, 'not json', e) END) AS answer
FROM (SELECT query_id, concat(chr(10), '<<<RAG_STRUCTURED_OUTPUT_BEGIN>>>', chr(10)) AS b,
             concat(chr(10), '<<<RAG_STRUCTURED_OUTPUT_END>>>') AS e FROM fx_rag_queries) q
"""

VIEWS["fx_raw_interactions"] = """
SELECT user_id, movie_id, 'rating' AS action_type,
       CASE WHEN (user_id + movie_id) % 97 = 0 THEN NULL WHEN (user_id + movie_id) % 89 = 0 THEN 11 ELSE rating END AS rating, updated_at AS ts
FROM fx_rating
UNION ALL
SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), event_type, CAST(NULL AS INT), ts FROM events
"""

ENGINE_TYPES = {
    "spark": {"TS": "TIMESTAMP_NTZ", "STR": "STRING"},
    "duckdb": {"TS": "TIMESTAMP", "STR": "VARCHAR"},
}

_VIEW_REF = re.compile(r"\bfx_[a-z_]+\b")


def view_text(name: str, engine: str) -> str:
    text = VIEWS[name].strip()
    for key, value in ENGINE_TYPES[engine].items():
        text = text.replace("{%s}" % key, value)
    return text


@lru_cache(maxsize=None)
def needed_views(text: str) -> tuple[str, ...]:
    """All views a text uses, each after the ones it depends on."""
    out: list[str] = []
    for name in _VIEW_REF.findall(text):
        if name in VIEWS and name not in out:
            for inner in needed_views(VIEWS[name]):
                if inner not in out:
                    out.append(inner)
            if name not in out:
                out.append(name)
    return tuple(out)


def with_views(sql: str) -> str:
    """Put the views a DuckDB text needs in front of it as CTEs."""
    names = needed_views(sql)
    body = sql.strip()
    if not names:
        return body
    head = ",\n".join(f"{n} AS ({view_text(n, 'duckdb')})" for n in names)
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
