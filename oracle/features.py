from oracle.interactions import IX, LABELS4
from oracle.stats import ACTIONS, ACTIVITY

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
TODAY = "DATE '2024-01-31'"

BASE = """(SELECT movie_id, coalesce(rating_sum::DOUBLE / nullif(rating_count, 0), 0) AS rating_avg, rating_count, year, duration_min FROM fx_movie)"""

AGE_A = f"floor(date_diff('day', birth, {TODAY}) / 365.0)"
AGE_B = (
    f"greatest(2024 - year(birth) - CASE WHEN month(birth) * 100 + day(birth) > 131 THEN 1 ELSE 0 END, 0)"
)
REG = f"date_diff('second', created_at, {NOW}) / 86400.0"


def ordered(table_sql: str, key: str, value: str, order: str, n: int, out: str) -> str:
    return f"""SELECT {key}, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY rn) AS {out} FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({table_sql}) t) r WHERE rn <= {n} GROUP BY {key}"""


STATIC_TAGS = "SELECT mt.* FROM fx_movie_tag mt JOIN fx_tag_dict td ON td.tag_id = mt.tag_id WHERE td.type = 'static'"

CTR = f"""(SELECT p.user_id, p.movie_id, coalesce(avg(CASE WHEN tc.total IS NULL THEN 0.0 ELSE coalesce(k.n, 0)::DOUBLE / tc.total END) FILTER (WHERE t.tag_id IS NOT NULL), 0.0) AS ctr
FROM (SELECT DISTINCT user_id, movie_id FROM {LABELS4} l) p
LEFT JOIN ({STATIC_TAGS}) t ON t.movie_id = p.movie_id
LEFT JOIN (SELECT user_id, count(*) AS total FROM fx_user_click GROUP BY user_id) tc ON tc.user_id = p.user_id
LEFT JOIN (SELECT c.user_id, s.tag_id, count(*) AS n FROM fx_user_click c JOIN ({STATIC_TAGS}) s ON s.movie_id = c.movie_id GROUP BY 1, 2) k
  ON k.user_id = p.user_id AND k.tag_id = t.tag_id
GROUP BY p.user_id, p.movie_id)"""

Z_COLUMNS = ["rating_avg", "rating_count", "year", "duration_min", "comment_count", "click_count"]


def z(c: str) -> str:
    return f"""round(coalesce(({c} - (SELECT avg({c}::DOUBLE) FROM rows_)) /
  (SELECT CASE WHEN stddev_pop({c}::DOUBLE) > 1e-8 THEN stddev_pop({c}::DOUBLE) ELSE 1.0 END FROM rows_), 0.0), 6) AS {c}"""


HOT = f"(SELECT movie_id, count(*) AS n FROM {ACTIONS} a WHERE created_at >= {NOW} - INTERVAL '30' DAY GROUP BY movie_id)"
HIST = ", ".join(f"count(*) FILTER (WHERE rating = {i}) AS c{i}" for i in range(1, 11))
SHARES = ",\n  ".join(
    f"round(coalesce(r.c{i}, 0)::DOUBLE / greatest(coalesce(r.total, 0), 1), 6) AS v{i + 2:02d}_share_{i}" for i in range(1, 11)
)
VECTOR = f"""SELECT m.movie_id, round(coalesce(m.rating_sum::DOUBLE / nullif(m.rating_count, 0), 0) / 10.0, 6) AS v01_rating,
  round(ln(1.0::DOUBLE + coalesce(m.rating_count, 0)), 6) AS v02_votes,
  {SHARES},
  round(ln(1.0::DOUBLE + coalesce(c.n, 0)), 6) AS v13_collects, round(ln(1.0::DOUBLE + coalesce(h.n, 0)), 6) AS v14_hot,
  round(CASE WHEN coalesce(m.year, 0) <= 0 THEN 0.0 ELSE greatest(0.0, least(1.5, (m.year - 1900) / 200.0::DOUBLE)) END::DOUBLE, 6) AS v15_year,
  round(ln(1.0::DOUBLE + coalesce(m.duration_min, 0)) / ln(241.0::DOUBLE), 6) AS v16_duration,
  round(ln(1.0::DOUBLE + greatest(coalesce(date_diff('day', m.release_date, {TODAY}), 0), 0)) / ln(43801.0::DOUBLE), 6) AS v17_age
FROM fx_movie m
LEFT JOIN (SELECT movie_id, count(*) AS total, {HIST} FROM fx_rating GROUP BY movie_id) r ON r.movie_id = m.movie_id
LEFT JOIN (SELECT movie_id, count(*) AS n FROM fx_user_collect_movie GROUP BY movie_id) c ON c.movie_id = m.movie_id
LEFT JOIN {HOT} h ON h.movie_id = m.movie_id"""

FLAGS = ["user_collection", "user_high_rating_similar", "user_interest_tag", "item_similar_by_tags", "two_tower"]


def flags(names: list[str]) -> str:
    return ", ".join(f"CASE WHEN p.source = '{n}' THEN 1.0 ELSE 0.0 END::DOUBLE AS src_{n}" for n in names)


MATRIX4 = f"""SELECT p.user_id, p.movie_id, round(p.recall_score, 6) AS recall_score, round(b.rating_avg, 6) AS movie_rating_avg,
  coalesce(b.rating_count, 0)::DOUBLE AS movie_rating_count, coalesce(a.comment_count, 0)::DOUBLE AS movie_comment_count,
  coalesce(a.click_count, 0)::DOUBLE AS movie_click_count, coalesce(a.click_1h, 0)::DOUBLE AS movie_click_1h,
  coalesce(a.click_24h, 0)::DOUBLE AS movie_click_24h, coalesce(b.year, 0)::DOUBLE AS movie_year,
  coalesce(b.duration_min, 0)::DOUBLE AS movie_duration_min, round(k.ctr, 6) AS user_static_tag_ctr, {flags(FLAGS)}
FROM {LABELS4} p LEFT JOIN {BASE} b ON b.movie_id = p.movie_id LEFT JOIN ({ACTIVITY}) a ON a.movie_id = p.movie_id
LEFT JOIN {CTR} k ON k.user_id = p.user_id AND k.movie_id = p.movie_id"""

MATRIX2 = f"""SELECT p.user_id, p.movie_id, round(p.recall_score, 6) AS recall_score, 1.0::DOUBLE AS has_user, 0.0::DOUBLE AS has_seed_movie,
  500.0::DOUBLE AS req_n, {flags(FLAGS[:4])}, round(b.rating_avg, 6) AS movie_rating_avg,
  round(CASE WHEN b.rating_count > 0 THEN ln(1.0::DOUBLE + b.rating_count) ELSE 0.0 END, 6) AS movie_log_rating_cnt,
  coalesce(b.year, 0)::DOUBLE AS movie_year, coalesce(b.duration_min, 0)::DOUBLE AS movie_duration_min
FROM {LABELS4} p LEFT JOIN {BASE} b ON b.movie_id = p.movie_id"""

SQL = {
    "lookup_semi": "SELECT movie_id, title, status FROM fx_movie WHERE movie_id IN (SELECT movie_id FROM fx_user_collect_movie)",
    "movie_base_features": f"SELECT movie_id, round(rating_avg, 6) AS rating_avg, rating_count, year, duration_min FROM {BASE} b",
    "item_stats_vector": VECTOR,
    "item_tags_top": ordered("SELECT * FROM fx_movie_tag", "movie_id", "tag_id", "weight DESC, hot_score DESC, tag_id DESC", 12, "tag_ids"),
    "item_static_tags": ordered(STATIC_TAGS, "movie_id", "tag_id", "weight DESC, hot_score DESC, tag_id DESC", 12, "tag_ids"),
    "user_profile_buckets": f"""SELECT user_id, CASE lower(trim(gender)) WHEN 'male' THEN 1 WHEN 'female' THEN 2 ELSE 0 END AS gender_idx,
  CASE WHEN birth IS NULL THEN 0 WHEN a <= 17 THEN 1 WHEN a <= 24 THEN 2 WHEN a <= 34 THEN 3 WHEN a <= 44 THEN 4 WHEN a <= 54 THEN 5 ELSE 6 END AS age_bucket,
  CASE WHEN created_at IS NULL THEN 0 WHEN r < 30 THEN 1 WHEN r < 180 THEN 2 WHEN r < 365 THEN 3 WHEN r < 1095 THEN 4 ELSE 5 END AS register_bucket,
  CASE WHEN NOT usable THEN 1 ELSE CASE lower(trim(gender)) WHEN 'male' THEN 2 WHEN 'female' THEN 3 ELSE 1 END END AS gender_idx_multitask,
  label AS age_label,
  CASE label WHEN 'unknown' THEN 1 WHEN 'lt18' THEN 2 WHEN '18_24' THEN 3 WHEN '25_34' THEN 4 WHEN '35_44' THEN 5 WHEN '45_54' THEN 6 ELSE 7 END AS age_idx_multitask
FROM (SELECT *, CASE WHEN NOT usable OR b IS NULL OR b <= 0 THEN 'unknown' WHEN b < 18 THEN 'lt18' WHEN b < 25 THEN '18_24' WHEN b < 35 THEN '25_34'
        WHEN b < 45 THEN '35_44' WHEN b < 55 THEN '45_54' ELSE '55_plus' END AS label
      FROM (SELECT *, {AGE_A} AS a, {AGE_B} AS b, floor({REG}) AS r, status = 'active' AND deleted_at IS NULL AS usable FROM fx_user) u) v""",
    "user_recent_sequence": ordered(f"SELECT * FROM {IX} x", "user_id", "movie_id", "ts DESC NULLS LAST, movie_id DESC, action_type", 50, "movie_ids"),
    "user_short_history": ordered("SELECT * FROM fx_user_click", "user_id", "movie_id", "created_at DESC NULLS LAST, movie_id DESC", 10, "movie_ids"),
    "user_long_interest_tags": ordered(
        f"""SELECT user_id, tag_id, max(priority) AS priority, max(seen_at) AS seen_at FROM (
  SELECT c.user_id, c.tag_id, 3 AS priority, c.created_at AS seen_at FROM fx_user_collect_tag c JOIN fx_tag_dict td ON td.tag_id = c.tag_id
  WHERE c.is_static = 1 AND td.type = 'static'
  UNION ALL SELECT r.user_id, t.tag_id, 2, r.updated_at FROM fx_rating r JOIN ({STATIC_TAGS}) t ON t.movie_id = r.movie_id WHERE r.rating >= 8) u
GROUP BY user_id, tag_id""", "user_id", "tag_id", "priority DESC, seen_at DESC NULLS LAST, tag_id DESC", 100, "tag_ids"),
    "user_static_tag_ctr": f"SELECT user_id, movie_id, round(ctr, 6) AS user_static_tag_ctr FROM {CTR} c",
    "feature_zscore": f"""WITH rows_ AS (SELECT b.*, a.comment_count, a.click_count FROM {BASE} b JOIN ({ACTIVITY}) a ON a.movie_id = b.movie_id)
SELECT movie_id, {', '.join(z(c) for c in Z_COLUMNS)} FROM rows_""",
    "feature_movie": """SELECT m.movie_id, round(coalesce(m.rating_sum::DOUBLE / nullif(m.rating_count, 0), 0), 6) AS rating_avg,
  coalesce(m.year, 0) AS year, coalesce(m.duration_min, 0) AS duration_min, coalesce(t.tag_ids, '') AS tag_ids
FROM fx_movie m LEFT JOIN (SELECT movie_id, string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY weight DESC, hot_score DESC, tag_id DESC) AS tag_ids
  FROM fx_movie_tag GROUP BY movie_id) t ON t.movie_id = m.movie_id""",
    "feature_user": """SELECT u.user_id, u.gender, u.birth, strftime(u.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(t.tag_ids, '') AS tag_ids
FROM fx_user u LEFT JOIN (SELECT user_id, string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY tag_id) AS tag_ids FROM fx_user_collect_tag GROUP BY user_id) t ON t.user_id = u.user_id""",
    "rank_matrix_multitask": MATRIX4,
    "rank_matrix_binary": MATRIX2,
}
