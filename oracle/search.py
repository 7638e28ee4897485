from oracle.stats import STATS

MOVIES = f"""(SELECT m.*, s.collect_count, s.bayesian_rating FROM fx_movie m LEFT JOIN ({STATS}) s ON s.movie_id = m.movie_id
WHERE m.status = 'published' AND m.deleted_at IS NULL)"""
ASKED = "(SELECT request_id, trim(query) AS query, sort_by, sort_order FROM fx_search_requests WHERE trim(query) <> '')"

TERMS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
TEXT = "concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))"

FULL_STEPS = f"""movies AS MATERIALIZED (SELECT * FROM {MOVIES} m), asked AS MATERIALIZED (SELECT * FROM {ASKED} a),
qterm AS MATERIALIZED (SELECT DISTINCT request_id, unnest({TERMS.format(t='query')}) AS term FROM asked),
tf AS MATERIALIZED (SELECT term, movie_id, count(*) AS tf FROM (SELECT movie_id, unnest({TERMS.format(t=TEXT)}) AS term FROM movies) t
  WHERE term IN (SELECT term FROM qterm) GROUP BY term, movie_id),
idf AS (SELECT term, log10((SELECT count(*) FROM movies)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term),
fulltext AS MATERIALIZED (SELECT q.request_id, t.movie_id, sum(t.tf * i.idf * i.idf) AS score FROM qterm q JOIN tf t ON t.term = q.term JOIN idf i ON i.term = q.term
  GROUP BY 1, 2 HAVING sum(t.tf * i.idf * i.idf) > 0)"""


def like_steps(requests: str, name: str) -> str:
    words = r"list_distinct(list_filter(regexp_split_to_array({q}, '\s+'), lambda w: w <> ''))".format(q="query")
    hit = lambda f, p: f"(lower(coalesce(m.{f}, '')) LIKE '%' || lower({p}) || '%')"
    return f"""{name}_token AS MATERIALIZED (SELECT request_id, query, unnest({words}) AS token FROM {requests} a),
{name}_hit AS MATERIALIZED (SELECT t.token, m.movie_id, {hit('title', 't.token')} AS in_title FROM (SELECT DISTINCT token FROM {name}_token) t CROSS JOIN movies m
  WHERE {hit('title', 't.token')} OR {hit('summary', 't.token')}),
{name}_all AS MATERIALIZED (SELECT t.request_id, t.query, h.movie_id, sum(CASE WHEN h.in_title THEN 2 ELSE 1 END) AS points
  FROM {name}_token t JOIN {name}_hit h ON h.token = t.token
  GROUP BY t.request_id, t.query, h.movie_id
  HAVING count(*) = (SELECT count(*) FROM {name}_token x WHERE x.request_id = t.request_id)),
{name} AS MATERIALIZED (SELECT a.request_id, a.movie_id, (CASE WHEN {hit('title', 'a.query')} THEN 10 ELSE 0 END + CASE WHEN {hit('summary', 'a.query')} THEN 4 ELSE 0 END
    + least(coalesce(m.rating_count, 0), 10000) / 10000.0::DOUBLE + a.points)::DOUBLE AS score
  FROM {name}_all a JOIN movies m ON m.movie_id = a.movie_id)"""


ORDERS = {
    "rating": "coalesce(bayesian_rating, 0) {o}",
    "collect": "coalesce(collect_count, 0) {o}",
    "duration": "(duration_min IS NULL) ASC, coalesce(duration_min, 0) {o}",
    "time": "(release_date IS NULL) ASC, release_date {o}",
}


def listing(mode: str, order: str, n: int = 20, offset: int = 0, where: str = "true") -> str:
    keys = ORDERS[mode].format(o=order) + ", coalesce(rating_count, 0) DESC, movie_id DESC" if mode in ORDERS else "movie_id DESC"
    return f"""SELECT movie_id, 0.0::DOUBLE AS score, CAST(rn AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (ORDER BY {keys}) AS rn FROM {MOVIES} m WHERE {where}) r
WHERE rn > {offset} AND rn <= {offset + n}"""


CHAIN = f"{FULL_STEPS}, missed AS (SELECT * FROM asked WHERE request_id NOT IN (SELECT request_id FROM fulltext)), {like_steps('missed', 'liked')}"
KEY = """CASE sort_by WHEN 'rating' THEN coalesce(bayesian_rating, 0) WHEN 'collect' THEN coalesce(collect_count, 0)::DOUBLE WHEN 'duration' THEN coalesce(duration_min, 0)::DOUBLE
 WHEN 'time' THEN coalesce(date_diff('day', DATE '1970-01-01', release_date), 0)::DOUBLE ELSE {other} END * CASE sort_order WHEN 'asc' THEN 1 ELSE -1 END"""
MISSING = "((sort_by = 'duration' AND duration_min IS NULL) OR (sort_by = 'time' AND release_date IS NULL))"

STRIP = r"regexp_replace(coalesce(m.summary, ''), '^\s+|\s+$', '', 'g')"

SQL = {
    "search_browse": f"""SELECT movie_id, 0.0::DOUBLE AS score FROM {MOVIES} m WHERE movie_id IN (SELECT movie_id FROM fx_movie_tag WHERE tag_id IN (3, 8, 30))
  AND release_date >= DATE '2023-03-01' AND release_date <= DATE '2023-12-31' AND duration_min >= 40 AND duration_min <= 180""",
    "search_fulltext": f"WITH {FULL_STEPS} SELECT request_id, movie_id, round(score, 6) AS score FROM fulltext",
    "search_like": f"WITH movies AS MATERIALIZED (SELECT * FROM {MOVIES} m), {like_steps(ASKED, 'liked')} SELECT request_id, movie_id, round(score, 6) AS score FROM liked",
    "search_auto": f"""WITH {CHAIN},
scored AS (SELECT *, 'fulltext' AS strategy FROM fulltext UNION ALL SELECT *, 'like' FROM liked),
texts AS (SELECT s.request_id, s.movie_id, s.score, s.strategy, row_number() OVER (PARTITION BY s.request_id ORDER BY {MISSING} ASC, {KEY.format(other='round(score, 9)')} ASC,
  CASE WHEN sort_by <> 'default' THEN round(score, 9) END DESC NULLS LAST, coalesce(m.rating_count, 0) DESC, s.movie_id DESC) AS pos
  FROM scored s JOIN movies m ON m.movie_id = s.movie_id JOIN asked a ON a.request_id = s.request_id),
blank AS (SELECT b.request_id, m.movie_id, 0.0::DOUBLE AS score, 'browse' AS strategy, row_number() OVER (PARTITION BY b.request_id ORDER BY {MISSING} ASC, {KEY.format(other='0.0')} ASC,
  CASE WHEN sort_by <> 'default' THEN coalesce(m.rating_count, 0) END DESC NULLS LAST, m.movie_id DESC) AS pos
  FROM (SELECT * FROM fx_search_requests WHERE trim(query) = '') b CROSS JOIN movies m)
SELECT request_id, movie_id, round(score, 6) AS score, strategy, CAST(pos AS INTEGER) AS pos FROM (SELECT * FROM texts UNION ALL SELECT * FROM blank) u WHERE pos <= 20""",
    "search_sort_rating": listing("rating", "DESC"),
    "search_sort_collect": listing("collect", "DESC"),
    "search_sort_duration": listing("duration", "ASC"),
    "search_sort_time": listing("time", "DESC"),
    "search_page": f"""WITH page AS ({listing('rating', 'ASC', 7, 3)})
SELECT p.movie_id, p.pos, m.title, m.year, CAST(m.release_date AS VARCHAR) AS release_date, m.duration_min,
  CASE WHEN length({STRIP}) > 300 THEN substr({STRIP}, 1, 300) || '...' ELSE {STRIP} END AS summary,
  round(m.rating_sum::DOUBLE / nullif(m.rating_count, 0), 6) AS rating_avg, m.rating_count, round(coalesce(m.bayesian_rating, 0), 6) AS bayesian_rating,
  coalesce(m.collect_count, 0) AS collect_count, p.score, (SELECT count(*) FROM {MOVIES} x) AS total
FROM page p JOIN {MOVIES} m ON m.movie_id = p.movie_id""",
}

_SORT = {
    "": "default", "default": "default", "composite": "default", "relevance": "default", "score": "default", "rating": "rating",
    "bayesian_rating": "rating", "collect": "collect", "collect_count": "collect", "favorite": "collect", "favourite": "collect",
    "duration": "duration", "duration_min": "duration", "time": "time", "release_date": "time",
}
_WINDOW = {"week": "weekly", "weekly": "weekly", "month": "monthly", "monthly": "monthly", "half_year": "half_year", "halfyear": "half_year", "half-year": "half_year"}


def _case(value: str, table: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


SQL["search_request_modes"] = f"""WITH a AS (SELECT *, lower(trim(coalesce(query, ''))) AS q, lower(trim(coalesce(sort_by, ''))) AS s, lower(trim(coalesce(sort_order, ''))) AS o,
    lower(trim(coalesce(time_window, ''))) AS w FROM fx_raw_requests),
b AS (SELECT *, {_case('s', _SORT)} AS sort_mode, CASE o WHEN '' THEN 'desc' ELSE o END AS ord, {_case('w', _WINDOW)} AS win FROM a),
c AS (SELECT *, CASE WHEN w <> '' THEN CASE win WHEN 'weekly' THEN DATE '2024-01-24' WHEN 'monthly' THEN DATE '2024-01-01' WHEN 'half_year' THEN DATE '2023-08-04' END ELSE start_date END AS rs,
    CASE WHEN w <> '' THEN DATE '2024-01-31' ELSE end_date END AS re,
    list_distinct(list_filter(string_split(coalesce(tag_ids, ''), ','), lambda t: trim(t) <> '')) AS tags FROM b),
d AS (SELECT *, CASE WHEN sort_mode IS NULL THEN 'sort_by' WHEN ord NOT IN ('asc', 'desc') THEN 'sort_order' WHEN w <> '' AND win IS NULL THEN 'time_window'
    WHEN w <> '' AND (start_date IS NOT NULL OR end_date IS NOT NULL) THEN 'time_window' WHEN rs > re THEN 'start_date' WHEN duration_min > duration_max THEN 'duration_min'
    WHEN n <= 0 THEN 'n' WHEN row_offset < 0 THEN 'offset' END AS error,
  CASE WHEN q <> '' AND len(tags) > 0 THEN 'mixed' WHEN q <> '' THEN 'query_only' WHEN len(tags) > 0 THEN 'tag_only'
    WHEN rs IS NOT NULL OR re IS NOT NULL OR duration_min IS NOT NULL OR duration_max IS NOT NULL THEN 'filter_only' ELSE 'browse' END AS mode FROM c),
e AS (SELECT * EXCLUDE (tag_ids), CASE WHEN tag_ids IS NULL THEN '' ELSE
    CASE WHEN split_part(tag_ids, ',', 1) = split_part(tag_ids, ',', 2) THEN split_part(tag_ids, ',', 1) ELSE split_part(tag_ids, ',', 1) || ',' || split_part(tag_ids, ',', 2) END END AS tag_text FROM
    (SELECT d.*, d.tag_ids AS tag_ids2 FROM d) d2)
SELECT request_id, error, CASE WHEN error IS NULL THEN sort_mode END AS sort_by, CASE WHEN error IS NULL THEN ord END AS sort_order,
  CASE WHEN error IS NULL THEN rs END AS release_start, CASE WHEN error IS NULL THEN re END AS release_end,
  CASE WHEN error IS NULL THEN tag_text END AS tag_ids, CASE WHEN error IS NULL THEN mode END AS mode FROM e"""
