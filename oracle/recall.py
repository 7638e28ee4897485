from oracle.interactions import CF, IX, PAIRS
from oracle.stats import index


def ranked(rows: str, by: str, order: str, n: int, extra: str = "") -> str:
    return f"(SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rank FROM (SELECT *{extra}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {rows} q) w WHERE rn <= {n})"


def unit(rows: str, key: str) -> str:
    return f"(SELECT {key}, v, sqrt(list_dot_product(v, v)) AS size FROM (SELECT {key}, vec::DOUBLE[] AS v FROM {rows} t WHERE vec IS NOT NULL) z)"


COSINE = "list_dot_product(q.v, c.v) / (q.size * c.size)"


def knn(queries: str, query_key: str, corpus: str, corpus_key: str, k: int, where: str = "true") -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT q.{query_key} AS query_id, c.{corpus_key} AS item_id, {COSINE} AS score FROM {unit(queries, query_key)} q CROSS JOIN {unit(corpus, corpus_key)} c WHERE {where}) s) r WHERE rank <= {k})"""


def scaled(c: str) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY user_id)", f"max({c}) OVER (PARTITION BY user_id)"
    return f"CASE WHEN {hi} - {lo} <= 1e-12 THEN 0.0 ELSE ({c} - {lo}) / ({hi} - {lo}) END"


def build(DEPTH: int, PER_KEY: int, PREFS: int, RECENT: int, LIST_N: int, VECTOR_K: int) -> dict[str, str]:
    """The texts at the given sizes."""
    GENRE = ranked(
        """(SELECT user_id, 'genre' AS tag_type, tag_id, count(*) AS weight FROM (
      SELECT c.user_id, c.tag_id FROM fx_user_collect_tag c JOIN fx_tag_dict td ON td.tag_id = c.tag_id
      UNION ALL SELECT r.user_id, mt.tag_id FROM fx_rating r JOIN fx_movie_tag mt ON mt.movie_id = r.movie_id JOIN fx_tag_dict td ON td.tag_id = mt.tag_id
      WHERE r.rating >= 8) u GROUP BY user_id, tag_id)""", "user_id", "weight DESC, tag_id DESC", PREFS)

    DIRECTOR = ranked(
        f"""(SELECT e.user_id, 'director' AS tag_type, p.person_id AS tag_id, count(*) AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, movie_id DESC, action_type) AS rn FROM {IX} x) e
      JOIN fx_movie_person p ON p.movie_id = e.movie_id WHERE e.rn <= {RECENT} AND p.person_role = 'director' GROUP BY 1, 2, 3)""",
        "user_id", "weight DESC, tag_id DESC", PREFS)

    TOP = ranked(
        f"(SELECT user_id, tag_type, tag_id, weight FROM {GENRE} g UNION ALL SELECT user_id, tag_type, tag_id, weight FROM {DIRECTOR} d)",
        "user_id", "weight DESC, tag_id DESC, tag_type DESC", PREFS)

    EXCLUDED = f"""(SELECT user_id, movie_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC NULLS LAST, movie_id DESC) AS rn
      FROM (SELECT user_id, movie_id, max(ts) AS last_ts FROM {IX} x GROUP BY user_id, movie_id) g) r WHERE rn <= {RECENT})"""

    TAG = f"""(SELECT user_id, item_id, score, 'tag_inverted' AS source FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rn FROM (
        SELECT p.user_id, i.movie_id AS item_id, sum(i.score) AS score FROM {TOP} p JOIN ({index(DEPTH)}) i ON i.tag_type = p.tag_type AND i.tag_id = p.tag_id
        WHERE i.rank <= {PER_KEY} AND p.user_id IN (SELECT user_id FROM fx_user)
          AND NOT EXISTS (SELECT 1 FROM {EXCLUDED} e WHERE e.user_id = p.user_id AND e.movie_id = i.movie_id)
        GROUP BY p.user_id, i.movie_id) s) r WHERE rn <= {LIST_N * 4})"""

    VECTOR = f"""(SELECT n.query_id AS user_id, n.item_id, n.score, 'two_tower' AS source FROM {knn('fx_user_vectors', 'user_id', 'fx_movie_embeddings', 'movie_id', VECTOR_K)} n
    WHERE n.query_id IN (SELECT user_id FROM fx_user) AND NOT EXISTS (SELECT 1 FROM {EXCLUDED} e WHERE e.user_id = n.query_id AND e.movie_id = n.item_id))"""

    MERGED = f"""(SELECT user_id, item_id, score, source FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY score DESC, no) AS rn FROM (
        SELECT *, 0 AS no FROM {TAG} a UNION ALL SELECT *, 1 FROM {VECTOR} b) u) r WHERE rn = 1)"""

    CF_STEPS = f"""merged AS MATERIALIZED (SELECT * FROM {MERGED} m), pw AS MATERIALIZED (SELECT * FROM {CF} c),
    item AS MATERIALIZED (SELECT movie_id, sqrt(sum(weight * weight)) AS size, sum(weight) AS popularity FROM pw GROUP BY movie_id),
    cand AS MATERIALIZED (SELECT m.user_id, m.item_id, m.score, i.popularity FROM merged m JOIN item i ON i.movie_id = m.item_id
      WHERE m.user_id IN (SELECT user_id FROM pw WHERE weight > 0)),
    need AS MATERIALIZED (SELECT c.user_id, c.item_id, h.movie_id AS hist_id, h.weight FROM cand c JOIN pw h ON h.user_id = c.user_id AND h.weight > 0),
    dots AS MATERIALIZED (SELECT a.movie_id AS item_id, b.movie_id AS hist_id, sum(a.weight * b.weight) AS dot FROM pw a JOIN pw b ON b.user_id = a.user_id
      WHERE a.movie_id IN (SELECT item_id FROM cand) GROUP BY 1, 2),
    sims AS (SELECT d.item_id, d.hist_id, d.dot / (x.size * y.size) AS sim FROM dots d JOIN item x ON x.movie_id = d.item_id JOIN item y ON y.movie_id = d.hist_id
      WHERE x.size > 0 AND y.size > 0),
    near AS (SELECT n.*, coalesce(s.sim, 0.0) AS sim, row_number() OVER (PARTITION BY n.user_id, n.item_id ORDER BY round(coalesce(s.sim, 0.0), 9) DESC, n.hist_id) AS rn
      FROM need n LEFT JOIN sims s ON s.item_id = n.item_id AND s.hist_id = n.hist_id),
    cf AS (SELECT user_id, item_id, sum(greatest(sim, 0.0) * weight) / sum(weight) AS cf FROM near WHERE rn <= 30 GROUP BY user_id, item_id),
    mixed AS MATERIALIZED (SELECT user_id, item_id, 0.72::DOUBLE * {scaled('cf')} + 0.18::DOUBLE * {scaled('score')} + 0.10::DOUBLE * {scaled('popularity')} AS score
      FROM (SELECT c.user_id, c.item_id, f.cf, c.score, c.popularity FROM cand c JOIN cf f ON f.user_id = c.user_id AND f.item_id = c.item_id) z)"""

    SHUFFLED = """SELECT user_id, CAST(rn AS INTEGER) AS pos, item_id FROM (SELECT user_id, item_id,
      row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', 0, user_id, item_id)), item_id) AS rn FROM {rows} s) r WHERE rn <= {n}"""

    FINAL = SHUFFLED.format(rows="mixed", n=500)

    return {
        "user_genre_preferences": f"SELECT * FROM {GENRE} g",
        "user_director_preferences": f"SELECT * FROM {DIRECTOR} g",
        "user_top_preferences": f"SELECT * FROM {TOP} g",
        "user_excluded_items": f"SELECT * FROM {EXCLUDED} e",
        "recall_tag": f"SELECT user_id, item_id, round(score, 6) AS score, source FROM {TAG} t",
        "recall_vector": f"SELECT user_id, item_id, round(score, 6) AS score, source FROM {VECTOR} t",
        "recall_merged": f"SELECT user_id, item_id, round(score, 6) AS score, source FROM {MERGED} t",
        "minmax_scale": f"SELECT user_id, item_id, source, round({scaled('score')}, 6) AS score FROM {MERGED} m",
        "rank_fallback": f"""SELECT user_id, item_id, round(score, 6) AS score, 'fallback' AS reason, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank
    FROM (SELECT user_id, item_id, {scaled('score')} AS score FROM {MERGED} m) s""",
        "rank_item_cf": f"""WITH {CF_STEPS} SELECT user_id, item_id, round(score, 6) AS score, 'cf_item_knn' AS reason,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank FROM mixed""",
        "rerank_shuffle": SHUFFLED.format(rows=MERGED, n=500),
        "recommend_users": f"WITH {CF_STEPS} {FINAL}",
        "recommend_page": f"""WITH {CF_STEPS} SELECT user_id, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos > 10 AND pos <= 20), '') AS items,
      count(*) AS total, count(*) > 20 AS has_next FROM ({FINAL}) f GROUP BY user_id""",
    }


SQL = build(1000, 200, 20, 300, 500, 300)
