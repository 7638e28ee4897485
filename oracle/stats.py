AVG = "(m.rating_sum * 1.0::DOUBLE) / nullif(m.rating_count, 0)"
ACTIONS = """(SELECT movie_id, created_at FROM fx_user_click
   UNION ALL SELECT movie_id, created_at FROM fx_movie_comment WHERE deleted_at IS NULL)"""


def trending(window: str, days: int, n: int) -> str:
    return f"""
SELECT '{window}' AS "window", movie_id, round(coalesce(score, 0), 6) AS score, CAST(rk AS INTEGER) AS rank FROM (
  SELECT movie_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, cnt DESC, rating_count DESC NULLS LAST, movie_id DESC) AS rk
  FROM (SELECT m.movie_id, m.rating_count, coalesce(a.cnt, 0) AS cnt,
          0.55::DOUBLE * {AVG} + 0.20::DOUBLE * log10(coalesce(m.rating_count, 0) + 1) + 0.25::DOUBLE * log10(coalesce(a.cnt, 0) + 1) AS score
        FROM fx_movie m LEFT JOIN (
          SELECT movie_id, count(*) AS cnt FROM {ACTIONS} x
          WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '{days}' DAY GROUP BY movie_id) a ON a.movie_id = m.movie_id
        WHERE m.status = 'published') s) t
WHERE rk <= {n}"""


ALL_TIME = """
SELECT 'all_time' AS "window", movie_id, round(coalesce(rating_count, 0)::DOUBLE, 6) AS score, CAST(rk AS INTEGER) AS rank FROM (
  SELECT movie_id, rating_count, row_number() OVER (ORDER BY rating_count DESC NULLS LAST, movie_id DESC) AS rk
  FROM fx_movie WHERE status = 'published') t WHERE rk <= 200"""

BAYES = """CASE WHEN coalesce(m.rating_count, 0) <= 0 THEN 0.0::DOUBLE ELSE
  (m.rating_count::DOUBLE / (m.rating_count + 100)) * (m.rating_sum::DOUBLE / m.rating_count) + (100.0::DOUBLE / (m.rating_count + 100)) * g.c END"""

STATS = f"""SELECT m.movie_id, coalesce(cs.collect_count, 0) AS collect_count, {BAYES} AS bayesian_rating
FROM fx_movie m CROSS JOIN (SELECT avg({AVG}) AS c FROM fx_movie m WHERE m.status = 'published' AND m.deleted_at IS NULL AND m.rating_count > 0) g
LEFT JOIN (SELECT movie_id, count(*) AS collect_count FROM fx_user_collect_movie GROUP BY movie_id) cs ON cs.movie_id = m.movie_id
WHERE m.deleted_at IS NULL"""

INDEX_SCORES = f"""SELECT tag_type, tag_id, movie_id, max(score) AS score FROM (
  SELECT 'genre' AS tag_type, mt.tag_id, mt.movie_id, {BAYES} * ln(coalesce(mt.vote_up, 0) + 1) AS score
  FROM fx_movie_tag mt JOIN fx_movie m ON m.movie_id = mt.movie_id JOIN fx_tag_dict td ON td.tag_id = mt.tag_id
  CROSS JOIN (SELECT avg({AVG}) AS c FROM fx_movie m WHERE m.status = 'published' AND m.rating_count > 0) g
  WHERE m.status = 'published'
  UNION ALL
  SELECT 'director', mp.person_id, mp.movie_id, {BAYES} * ln(coalesce(m.rating_count, 0) + 1)
  FROM fx_movie_person mp JOIN fx_movie m ON m.movie_id = mp.movie_id
  CROSS JOIN (SELECT avg({AVG}) AS c FROM fx_movie m WHERE m.status = 'published' AND m.rating_count > 0) g
  WHERE m.status = 'published' AND mp.person_role = 'director') s
WHERE score > 0 GROUP BY 1, 2, 3"""


def index(depth: int) -> str:
    return f"""SELECT * FROM (SELECT tag_type, tag_id, movie_id, score,
  row_number() OVER (PARTITION BY tag_type, tag_id ORDER BY score DESC, movie_id DESC) AS rank FROM ({INDEX_SCORES}) i) r WHERE rank <= {depth}"""


ACTIVITY = """SELECT m.movie_id, coalesce(c.n, 0) AS comment_count, coalesce(k.n, 0) AS click_count,
  coalesce(k.n1, 0) AS click_1h, coalesce(k.n24, 0) AS click_24h
FROM fx_movie m
LEFT JOIN (SELECT movie_id, count(*) AS n FROM fx_movie_comment WHERE deleted_at IS NULL GROUP BY movie_id) c ON c.movie_id = m.movie_id
LEFT JOIN (SELECT movie_id, count(*) AS n,
             count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR) AS n1,
             count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '24' HOUR) AS n24
           FROM fx_user_click GROUP BY movie_id) k ON k.movie_id = m.movie_id"""

HIST = ", ".join(f"count(*) FILTER (WHERE rating = {i}) AS rating_{i}_count" for i in range(1, 11))

SQL = {
    "trending_weekly": trending("weekly", 7, 200),
    "trending_all_windows": " UNION ALL ".join(
        f"SELECT * FROM ({trending(w, d, 200)}) {w}"
        for w, d in {"daily": 1, "weekly": 7, "monthly": 30, "half_year": 180, "one_year": 365}.items()
    ) + f" UNION ALL SELECT * FROM ({ALL_TIME}) all_t",
    "trending_all_time": ALL_TIME,
    "search_stats": f"SELECT movie_id, collect_count, round(bayesian_rating, 6) AS bayesian_rating FROM ({STATS}) s",
    "tag_index": f"SELECT tag_type, tag_id, movie_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({index(1000)}) t",
    "movie_activity_stats": ACTIVITY,
    "movie_rating_rollup": f"SELECT movie_id, CAST(sum(rating) AS BIGINT) AS rating_sum, count(rating) AS rating_count, {HIST} FROM fx_rating GROUP BY movie_id",
    "precompute_summary": f"""SELECT 'search_stats' AS "table", count(*) AS "rows" FROM ({STATS}) a
UNION ALL SELECT 'feature_movie', count(*) FROM fx_movie
UNION ALL SELECT 'feature_user', count(*) FROM fx_user
UNION ALL SELECT 'trending', count(*) FROM (TRENDING) p WHERE movie_id > 0
UNION ALL SELECT 'tag_index', count(*) FROM ({index(1000)}) i""",
}
SQL["precompute_summary"] = SQL["precompute_summary"].replace("(TRENDING)", f"({SQL['trending_all_windows']})")
