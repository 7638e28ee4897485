from oracle.features import STATIC_TAGS
from oracle.interactions import LABELS4
from oracle.recall import knn

NAME = "coalesce(nullif(trim(name_cn), ''), nullif(trim(name_en), ''))"
STRIP = r"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
FLAT = r"trim(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '\s+', ' ', 'g'))"


def people(role: str) -> str:
    return f"""(SELECT movie_id, string_agg(person_name, ', ' ORDER BY first_id, person_name) AS v FROM (
  SELECT mp.movie_id, p.person_name, min(mp.movie_person_id) AS first_id FROM fx_movie_person mp JOIN fx_person p ON p.person_id = mp.person_id
  WHERE mp.person_role = '{role}' AND trim(coalesce(p.person_name, '')) <> '' GROUP BY 1, 2) d GROUP BY movie_id)"""


REGIONS = f"""(SELECT movie_id, string_agg(n, ', ' ORDER BY first_id, n) AS v FROM (SELECT mr.movie_id, d.n, min(mr.region_id) AS first_id FROM fx_movie_region mr
  JOIN (SELECT region_id, {NAME} AS n FROM fx_dict_region) d ON d.region_id = mr.region_id WHERE d.n IS NOT NULL GROUP BY 1, 2) g GROUP BY movie_id)"""
LANGUAGES = f"""(SELECT movie_id, string_agg(n, ', ' ORDER BY main DESC, first_id, n) AS v FROM (SELECT ml.movie_id, d.n, max(CASE WHEN ml.is_primary = 1 THEN 1 ELSE 0 END) AS main,
  min(ml.lang_id) AS first_id FROM fx_movie_language ml JOIN (SELECT lang_id, {NAME} AS n FROM fx_dict_language) d ON d.lang_id = ml.lang_id WHERE d.n IS NOT NULL GROUP BY 1, 2) g GROUP BY movie_id)"""
TAGS = """(SELECT movie_id, string_agg(tag_name, ', ' ORDER BY rn) AS v FROM (SELECT mt.movie_id, td.tag_name,
  row_number() OVER (PARTITION BY mt.movie_id ORDER BY coalesce(mt.vote_up, 0) DESC, coalesce(mt.hot_score, 0) DESC, td.tag_id) AS rn
  FROM fx_movie_tag mt JOIN fx_tag_dict td ON td.tag_id = mt.tag_id WHERE trim(coalesce(td.tag_name, '')) <> '') r WHERE rn <= 4 GROUP BY movie_id)"""

DOCS = f"""(SELECT m.movie_id, {STRIP.format(c='m.title')} AS title, m.year, m.duration_min, m.rating_sum::DOUBLE / nullif(m.rating_count, 0) AS rating_avg,
  coalesce(m.rating_count, 0) AS rating_count, {STRIP.format(c='m.summary')} AS summary, coalesce(d.v, '') AS directors, coalesce(a.v, '') AS actors,
  coalesce(r.v, '') AS regions, coalesce(l.v, '') AS languages, coalesce(t.v, '') AS top_tags
FROM fx_movie m LEFT JOIN {people('director')} d ON d.movie_id = m.movie_id LEFT JOIN {people('actor')} a ON a.movie_id = m.movie_id
LEFT JOIN {REGIONS} r ON r.movie_id = m.movie_id LEFT JOIN {LANGUAGES} l ON l.movie_id = m.movie_id LEFT JOIN {TAGS} t ON t.movie_id = m.movie_id
WHERE m.deleted_at IS NULL)"""

RATE = "CAST(CAST(floor(rating_avg * 10 + 0.5) / 10 AS DECIMAL(10,1)) AS VARCHAR)"
LINES = [
    ("movie_title", FLAT.format(c="title")), ("release_year", FLAT.format(c="year")), ("director", FLAT.format(c="directors")),
    ("duration_minutes", FLAT.format(c="duration_min")), ("average_rating", f"coalesce({RATE}, '')"), ("rating_count", FLAT.format(c="rating_count")),
    ("country_or_region", FLAT.format(c="regions")), ("language", FLAT.format(c="languages")), ("top_vote_tags", FLAT.format(c="top_tags")),
    ("actors", FLAT.format(c="actors")), ("summary", f"trim(substr({FLAT.format(c='summary')}, 1, 1200))"),
]
CHUNKS = "SELECT movie_id, concat_ws(chr(10), " + ", ".join(f"'{k}: ' || {v}" for k, v in LINES) + f") AS chunk_text FROM {DOCS} d"

OLD = "(SELECT id, movie_id, chunk_text, vec FROM fx_movie_embeddings)"
NEW = "(SELECT vec_id * 3 AS movie_id, concat('new ', vec_id) AS chunk_text, embedding AS vec FROM embeddings)"
HEAD = "id, movie_id, chunk_text, round(vec[1]::DOUBLE, 6) AS first_value"
ALIVE = "(SELECT movie_id FROM fx_movie WHERE deleted_at IS NULL)"
ADDED = f"""SELECT (SELECT max(id) FROM {OLD} o) + row_number() OVER (ORDER BY movie_id) AS id, movie_id, chunk_text, vec FROM {NEW} n
WHERE movie_id NOT IN (SELECT movie_id FROM {OLD} o)"""

NEIGHBOURS = "SELECT query_id AS movie_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, '{s}' AS source FROM {k} n"
PRIMARY = "(SELECT movie_id, vec FROM fx_movie_embeddings WHERE vec IS NOT NULL)"
SHOWN = "(SELECT v.movie_id, v.vec FROM fx_item_vectors_alt v JOIN fx_movie m ON m.movie_id = v.movie_id WHERE m.status = 'published' AND m.deleted_at IS NULL)"
MISSING = f"(SELECT * FROM {SHOWN} s WHERE movie_id NOT IN (SELECT movie_id FROM {PRIMARY} p))"
FIRST = NEIGHBOURS.format(s="rag", k=knn(PRIMARY, "movie_id", PRIMARY, "movie_id", 10, "q.movie_id <> c.movie_id"))
SECOND = NEIGHBOURS.format(s="two_tower", k=knn(MISSING, "movie_id", SHOWN, "movie_id", 10, "q.movie_id <> c.movie_id"))
SECOND_ALL = NEIGHBOURS.format(s="two_tower", k=knn(SHOWN, "movie_id", SHOWN, "movie_id", 10, "q.movie_id <> c.movie_id"))

EVIDENCE = f"""(SELECT n.query_id, n.item_id AS movie_id, n.score, CAST(n.rank AS INTEGER) AS rank, m.title, m.year, m.rating_sum::DOUBLE / nullif(m.rating_count, 0) AS rating_avg,
  coalesce(m.rating_count, 0) AS rating_count, coalesce(m.summary, '') AS summary, e.chunk_text
FROM {knn('fx_rag_queries', 'query_id', PRIMARY, 'movie_id', 8)} n JOIN fx_movie m ON m.movie_id = n.item_id JOIN fx_movie_embeddings e ON e.movie_id = n.item_id
WHERE m.deleted_at IS NULL AND m.movie_id > 0)"""

CONTEXT = f"""SELECT q.query_id, coalesce(c.context, 'No supporting movie evidence was retrieved.') AS context FROM fx_rag_queries q LEFT JOIN (
  SELECT query_id, string_agg('[' || no || '] movie_id=' || movie_id || ', title=' || coalesce(title, 'None') || ', year=' || coalesce(CAST(year AS VARCHAR), 'None')
    || ', rating_avg=' || coalesce({RATE} || '/10', 'unknown') || ', rating_count=' || rating_count || chr(10) || 'summary: ' || summary || chr(10)
    || 'retrieved_chunk: ' || chunk_text, chr(10) || chr(10) ORDER BY no) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS no FROM {EVIDENCE} e) b GROUP BY query_id) c ON c.query_id = q.query_id"""

AUDIT = f"""WITH ev AS MATERIALIZED (SELECT query_id, movie_id FROM {EVIDENCE} e), a AS (SELECT *, strpos(answer, chr(10) || '<<<RAG_STRUCTURED_OUTPUT_BEGIN>>>' || chr(10)) AS b FROM fx_generated_answers),
t AS (SELECT *, CASE WHEN b > 0 THEN substr(answer, b + 35) END AS tail FROM a), p AS (SELECT *, strpos(tail, chr(10) || '<<<RAG_STRUCTURED_OUTPUT_END>>>') AS e FROM t),
j AS (SELECT *, CASE WHEN e > 0 AND json_valid(substr(tail, 1, e - 1)) THEN CAST(substr(tail, 1, e - 1) AS JSON) END AS data FROM p),
item AS (SELECT query_id, variant, unnest(CAST(json_extract(data, '$.cited_movie_ids') AS JSON[])) AS x FROM j WHERE data IS NOT NULL),
verdict AS (SELECT query_id, variant, max(CASE WHEN json_type(x) = 'BOOLEAN' THEN 2 WHEN NOT EXISTS (SELECT 1 FROM ev WHERE ev.query_id = item.query_id
    AND ev.movie_id = CAST(CASE WHEN json_type(x) = 'BOOLEAN' THEN NULL ELSE json_extract_string(x, '$') END AS BIGINT)) THEN 1 ELSE 0 END) AS bad,
  string_agg(DISTINCT json_extract_string(x, '$'), ',') AS cited FROM item GROUP BY 1, 2)
SELECT j.query_id, j.variant, CASE WHEN tail IS NULL THEN 'begin_marker_missing' WHEN e = 0 THEN 'end_marker_missing' WHEN data IS NULL THEN 'json_invalid'
  WHEN v.bad = 2 THEN 'movie_id_invalid' WHEN v.bad = 1 THEN 'out_of_evidence' ELSE 'ok' END AS status,
  CASE WHEN v.bad = 0 THEN v.cited ELSE '' END AS cited_ids FROM j LEFT JOIN verdict v ON v.query_id = j.query_id AND v.variant = j.variant"""

TASKS = "(SELECT * FROM fx_ops_task WHERE task_type NOT IN ('rag_embedding_job'))"
STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
CNT = "coalesce(nullif(CAST(json_extract_string(progress, '$.{k}') AS BIGINT), 0), CAST(json_extract_string(result, '$.{k}') AS BIGINT), 0)"
TOTAL, DONE = CNT.format(k="total_movies"), CNT.format(k="processed_movies")
MODEL = "coalesce(json_extract_string(payload, '$.component'), 'unknown_component') || '/' || coalesce(json_extract_string(payload, '$.model'), 'unknown_model')"

ENUMS = {
    ("movie", "status"): "'draft', 'published', 'offline'", ("user", "status"): "'active', 'banned', 'deleted'", ("user", "gender"): "'male', 'female', 'unknown'",
    ("tag_dict", "type"): "'static', 'dynamic'", ("movie_person", "person_role"): "'director', 'actor', 'writer', 'producer'",
    ("ops_task", "status"): "'pending', 'processing', 'completed', 'failed'",
}
PKS = {"movie": "movie_id", "user": "user_id", "rating": "user_id,movie_id", "user_collect_movie": "user_id,movie_id", "movie_tag": "movie_id,tag_id", "movie_person": "movie_person_id"}
FKS = {
    ("rating", "movie_id"): ("movie", "movie_id"), ("rating", "user_id"): ("user", "user_id"), ("user_click", "movie_id"): ("movie", "movie_id"),
    ("movie_tag", "tag_id"): ("tag_dict", "tag_id"), ("movie_person", "person_id"): ("person", "person_id"),
    ("movie_embeddings", "movie_id"): ("movie", "movie_id"), ("movie_language", "movie_id"): ("movie", "movie_id"),
}
KEYS = " UNION ALL ".join(
    [f"""SELECT 'enum' AS "check", '{t}' AS "table", '{c}' AS "column", count(*) AS bad_rows FROM fx_{t} WHERE {c} IS NOT NULL AND {c} NOT IN ({v})""" for (t, c), v in ENUMS.items()]
    + [f"SELECT 'primary_key', '{t}', '{k}', count(*) FROM (SELECT 1 FROM fx_{t} GROUP BY {k} HAVING count(*) > 1) d" for t, k in PKS.items()]
    + [f"SELECT 'foreign_key', '{t}', '{c}', count(*) FROM fx_{t} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_{o} y WHERE y.{k} = x.{c})" for (t, c), (o, k) in FKS.items()]
)
CANDIDATES = f"(SELECT DISTINCT user_id, movie_id FROM {LABELS4} l)"
COVER = [
    ("movie_stats", "movie_id", "SELECT movie_id FROM fx_movie"), ("item_static_tags", "movie_id", f"SELECT movie_id FROM ({STATIC_TAGS}) s"),
    ("user_profile", "user_id", "SELECT user_id FROM fx_user"), ("user_birth", "user_id", "SELECT user_id FROM fx_user WHERE birth IS NOT NULL"),
]

SQL = {
    "movie_documents": f"SELECT * REPLACE (round(rating_avg, 6) AS rating_avg) FROM {DOCS} d",
    "movie_chunks": CHUNKS,
    "embedding_missing": f"SELECT movie_id FROM fx_movie WHERE deleted_at IS NULL AND movie_id NOT IN (SELECT movie_id FROM {PRIMARY} p)",
    "embedding_prune": f"""SELECT id, movie_id, CASE WHEN movie_id IN {ALIVE} THEN 'kept' ELSE 'removed' END AS outcome FROM fx_movie_embeddings""",
    "embedding_upsert": f"""SELECT {HEAD} FROM (SELECT o.id, o.movie_id, coalesce(n.chunk_text, o.chunk_text) AS chunk_text, CASE WHEN n.movie_id IS NULL THEN o.vec ELSE n.vec END AS vec
  FROM {OLD} o LEFT JOIN {NEW} n ON n.movie_id = o.movie_id UNION ALL {ADDED}) u""",
    "embedding_insert_missing": f"SELECT {HEAD} FROM (SELECT * FROM {OLD} o UNION ALL {ADDED}) u",
    "embedding_rebuild_summary": f"""SELECT count(*) AS total_movies, count(p.movie_id) AS completed_jobs, count(*) - count(p.movie_id) AS failed_jobs,
  (SELECT count(*) FROM fx_movie_embeddings WHERE movie_id NOT IN {ALIVE}) AS pruned_embeddings FROM {ALIVE} m LEFT JOIN {PRIMARY} p ON p.movie_id = m.movie_id""",
    "embedding_normalized": """SELECT id, movie_id, CAST(i - 1 AS INTEGER) AS dim, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS value FROM (
  SELECT id, movie_id, vec::DOUBLE[] AS v, unnest(range(1, 65)) AS i FROM fx_movie_embeddings WHERE vec IS NOT NULL) x""",
    "similar_items": f"SELECT movie_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, source FROM ({FIRST} UNION ALL {SECOND}) u",
    "similar_items_fallback": f"SELECT movie_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, source FROM ({SECOND_ALL}) u",
    "rag_evidence": f"SELECT * REPLACE (round(score, 6) AS score, round(rating_avg, 6) AS rating_avg) FROM {EVIDENCE} e",
    "rag_context": CONTEXT,
    "citation_audit": AUDIT,
    "task_report": f"""SELECT t.id, t.task_type, t.status, t.parent_task_id, t.payload, t.progress, t.result, {STAMP.format(c='t.created_at')} AS created_at, {STAMP.format(c='t.started_at')} AS started_at,
  {STAMP.format(c='t.finished_at')} AS finished_at, coalesce(t.task_ref_override, t.task_type || '_' || t.id) AS task_ref,
  CASE WHEN p.id IS NOT NULL THEN coalesce(p.task_ref_override, p.task_type || '_' || p.id) END AS parent_task_ref,
  (SELECT count(*) FROM {TASKS} x) AS total, 35 < (SELECT count(*) FROM {TASKS} x) AS has_more
FROM (SELECT * FROM {TASKS} t ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 30 OFFSET 5) t LEFT JOIN fx_ops_task p ON p.id = t.parent_task_id""",
    "task_progress": f"""SELECT id, task_type, status,
  CASE WHEN coalesce(json_extract_string(result, '$.elapsed_ms'), CAST(epoch_us(finished_at) - epoch_us(started_at) AS VARCHAR)) IS NULL THEN NULL ELSE
    greatest(coalesce(CAST(json_extract_string(result, '$.elapsed_ms') AS BIGINT), CAST(floor((epoch_us(finished_at) - epoch_us(started_at)) / 1000) AS BIGINT)), 0) END AS elapsed_ms,
  CASE WHEN task_type = 'rag_rebuild_job' AND {TOTAL} > 0 THEN round(least(greatest({DONE}, 0) / ({TOTAL})::DOUBLE, 1.0) * 100.0, 2)
    WHEN status = 'pending' THEN 0.0 WHEN status IN ('completed', 'failed') THEN 100.0 END::DOUBLE AS progress_percent,
  CASE task_type WHEN 'train_job' THEN {MODEL} || ' ' || status
    WHEN 'rag_rebuild_job' THEN CASE WHEN {TOTAL} > 0 THEN 'full_rebuild ' || {DONE} || '/' || {TOTAL} ELSE 'full_rebuild ' || status END
    ELSE task_type || ' ' || status END AS summary FROM fx_ops_task""",
    "qc_interactions": f"""SELECT user_id, movie_id, action_type, rating, {STAMP.format(c='ts')} AS ts, reason FROM (SELECT *, CASE WHEN action_type = 'rating' AND rating IS NULL THEN 'rating_missing'
  WHEN action_type = 'rating' AND NOT rating BETWEEN 1 AND 10 THEN 'rating_out_of_range'
  WHEN action_type NOT IN ('rating', 'view', 'like', 'collect', 'share', 'comment', 'dislike') THEN 'unknown_action' END AS reason FROM fx_raw_interactions) r WHERE reason IS NOT NULL""",
    "qc_keys": KEYS,
    "qc_vectors": "SELECT id, movie_id, 'empty_vector' AS reason FROM fx_movie_embeddings WHERE vec IS NULL",
    "qc_feature_coverage": " UNION ALL ".join(
        f"""SELECT '{n}' AS "check", count(*) AS total, count(*) FILTER (WHERE {k} NOT IN ({s})) AS missing FROM (SELECT DISTINCT {k} FROM {CANDIDATES} c) d""" for n, k, s in COVER
    ),
}
