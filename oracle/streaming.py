ACTIONS = """(SELECT event_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS movie_id FROM events WHERE event_type IN ({kinds}))"""
SHOWN = ACTIONS.format(kinds="'view', 'click', 'signup'")
CLICKS = ACTIONS.format(kinds="'view', 'click'")


def mark(rows: str) -> str:
    """Watermark in whole milliseconds."""
    return f"(SELECT floor(epoch_us(max(ts)) / 1000) / 1000.0 - 3600 FROM {rows} w)"


def buckets(rows: str) -> str:
    return f"""(SELECT movie_id, b, count(*) AS n FROM (SELECT movie_id, CAST(floor(epoch_us(ts) / 600000000) * 600 AS BIGINT) AS b FROM {rows} r) x
  WHERE b + 600 <= {mark(rows)} GROUP BY movie_id, b)"""


SQL = {
    "stream_trending_counts": f"""SELECT movie_id, b - k * 600 AS window_start, CAST(sum(n) AS BIGINT) AS n FROM {buckets(SHOWN)} x CROSS JOIN range(0, 144) r(k)
WHERE b - k * 600 + 86400 <= {mark(SHOWN)} GROUP BY 1, 2""",
    "stream_click_buckets": f"""WITH closed AS ({buckets(CLICKS)[1:-1]}), last_ AS (SELECT epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1000000 AS t)
SELECT movie_id, CAST(sum(CASE WHEN b >= t - 3600 THEN n ELSE 0 END) AS BIGINT) AS n_1h, CAST(sum(n) AS BIGINT) AS n_24h FROM closed CROSS JOIN last_
WHERE b >= t - 86400 AND b < t GROUP BY movie_id""",
    "stream_feature_refresh": """SELECT m.movie_id, round(coalesce(m.rating_sum::DOUBLE / nullif(m.rating_count, 0), 0), 6) AS rating_avg,
  coalesce(m.year, 0) AS year, coalesce(m.duration_min, 0) AS duration_min, coalesce(t.tag_ids, '') AS tag_ids
FROM fx_movie m LEFT JOIN (SELECT movie_id, string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY weight DESC, hot_score DESC, tag_id DESC) AS tag_ids
  FROM fx_movie_tag GROUP BY movie_id) t ON t.movie_id = m.movie_id
WHERE m.movie_id IN (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) FROM events)""",
}
