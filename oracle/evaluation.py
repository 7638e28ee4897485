from oracle.interactions import LABELS2, LABELS4, NEGATIVES, PAIRS
from oracle.recall import COSINE, unit
from oracle.stats import STATS

TASKS = ("click", "collect", "comment", "rating")


def auc(rows: str, by: str = "") -> str:
    """Rank-sum form with average ranks."""
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {head}(sum(CASE WHEN label > 0.5 THEN avg_rank ELSE 0 END) - count(*) FILTER (WHERE label > 0.5) * (count(*) FILTER (WHERE label > 0.5) + 1) / 2.0)
  / (count(*) FILTER (WHERE label > 0.5) * (count(*) FILTER (WHERE label <= 0.5))::DOUBLE) AS auc
FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}score) - 1) / 2.0::DOUBLE AS avg_rank FROM {rows} r) a {tail}"""


SAMPLES = f"""(SELECT user_id, movie_id, click, collect, "comment", rating FROM {LABELS4} p
  UNION ALL SELECT user_id, movie_id, 0, 0, 0, 0 FROM ({NEGATIVES}) n)"""
SCORED2 = f"(SELECT l.label, round(coalesce(s.bayesian_rating, 0), 6) AS score FROM {LABELS2} l LEFT JOIN ({STATS}) s ON s.movie_id = l.movie_id)"
SCORED4 = "(" + " UNION ALL ".join(
    f"""SELECT '{t}' AS task, "{t}" AS label, score FROM scored""" for t in TASKS
) + ")"
HEAD4 = f"scored AS MATERIALIZED (SELECT l.*, round(coalesce(s.bayesian_rating, 0), 6) AS score FROM {SAMPLES} l LEFT JOIN ({STATS}) s ON s.movie_id = l.movie_id)"

HIT = f"""WITH pairs AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, weight DESC, movie_id DESC) AS rn FROM {PAIRS} p),
scores AS MATERIALIZED (SELECT q.user_id, c.movie_id, {COSINE} AS score FROM {unit('fx_user_vectors', 'user_id')} q CROSS JOIN {unit('fx_movie_embeddings', 'movie_id')} c),
target AS (SELECT s.* FROM scores s JOIN pairs p ON p.user_id = s.user_id AND p.movie_id = s.movie_id WHERE p.n >= 2 AND p.rn = 1),
place AS (SELECT t.user_id, 1 + count(s.movie_id) AS rank FROM target t LEFT JOIN scores s ON s.user_id = t.user_id AND s.movie_id <> t.movie_id
    AND (s.score > t.score + 1e-12 OR (abs(s.score - t.score) <= 1e-12 AND s.movie_id < t.movie_id))
    AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.user_id = s.user_id AND p.movie_id = s.movie_id AND NOT (p.n >= 2 AND p.rn = 1))
  GROUP BY t.user_id)
SELECT round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS hr, count(*) AS n FROM place"""

SQL = {
    "auc_exact": f"SELECT round(auc, 6) AS auc FROM ({auc(SCORED2)}) x",
    "auc_by_task": f"WITH {HEAD4}, per_task AS ({auc(SCORED4, 'task')}) SELECT task, round(auc, 6) AS auc FROM per_task UNION ALL SELECT 'mean', round(avg(auc), 6) FROM per_task",
    "hit_rate_at_k": HIT,
}
