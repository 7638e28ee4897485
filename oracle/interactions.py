IX = """(SELECT user_id, movie_id, 'view' AS action_type, CAST(NULL AS INTEGER) AS rating, created_at AS ts FROM fx_user_click WHERE movie_id IS NOT NULL
 UNION ALL SELECT user_id, movie_id, 'rating', rating, updated_at FROM fx_rating WHERE movie_id IS NOT NULL
 UNION ALL SELECT user_id, movie_id, 'comment', NULL, created_at FROM fx_movie_comment WHERE movie_id IS NOT NULL AND deleted_at IS NULL
 UNION ALL SELECT user_id, movie_id, 'collect', NULL, created_at FROM fx_user_collect_movie WHERE movie_id IS NOT NULL)"""

STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def stamp(column: str) -> str:
    return STAMP.format(c=column)


def weight(view: str, comment: str, collect: str, rating: str) -> str:
    return f"CASE action_type WHEN 'view' THEN {view} WHEN 'comment' THEN {comment} WHEN 'collect' THEN {collect} ELSE {rating} END"


CF = f"""(SELECT user_id, movie_id, greatest(-1.0, least(2.0, coalesce(sum({weight('0.2', '0.6', '1.0', '(rating - 5) * 0.2')}), 0)))::DOUBLE AS weight
FROM {IX} x GROUP BY user_id, movie_id)"""

PAIRS = f"""(SELECT user_id, movie_id, sum(w)::DOUBLE AS weight, max(ts) AS last_ts
FROM (SELECT *, {weight('0.2', '0.7', '1.2', 'greatest((rating - 5) * 0.2, 0.0)')} AS w FROM {IX} x
      WHERE action_type <> 'rating' OR rating BETWEEN 1 AND 10) y
WHERE w > 0 GROUP BY user_id, movie_id)"""

LABELS2 = f"""(SELECT user_id, movie_id, action_type, rating, strength::DOUBLE AS strength, ts,
  CAST(CASE WHEN action_type = 'rating' THEN rating >= 8 ELSE strength >= 0.8 END AS INTEGER) AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY priority DESC, abs(strength) DESC, ts DESC) AS rn FROM (
    SELECT *, {weight('0.2', '0.7', '1.2', '(rating - 5) * 0.2')} AS strength,
      CASE action_type WHEN 'rating' THEN 4 WHEN 'collect' THEN 3 WHEN 'comment' THEN 2 ELSE 1 END AS priority FROM {IX} x) s) t WHERE rn = 1)"""

LABELS4 = f"""(SELECT user_id, movie_id, 1 AS click, collect, "comment", rating,
  CASE p WHEN 5 THEN 'user_high_rating_similar' WHEN 4 THEN 'user_collection' ELSE 'recent_interaction' END AS source,
  CASE p WHEN 5 THEN 1.0 WHEN 4 THEN 1.0 WHEN 3 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.6 END::DOUBLE AS recall_score FROM (
  SELECT user_id, movie_id, max(CASE WHEN action_type = 'collect' THEN 1 ELSE 0 END) AS collect,
    max(CASE WHEN action_type = 'comment' THEN 1 ELSE 0 END) AS "comment",
    max(CASE WHEN action_type = 'rating' AND rating >= 5 THEN 1 ELSE 0 END) AS rating,
    max(CASE WHEN action_type = 'rating' AND rating >= 5 THEN 5 WHEN action_type = 'collect' THEN 4 WHEN action_type = 'comment' THEN 3
             WHEN action_type = 'rating' THEN 2 ELSE 1 END) AS p
  FROM {IX} x WHERE action_type <> 'rating' OR rating IS NOT NULL GROUP BY user_id, movie_id) g)"""

RECENT = " UNION ALL ".join(
    f"SELECT * FROM (SELECT * FROM {IX} x WHERE action_type = '{a}' ORDER BY ts DESC NULLS LAST, action_type, user_id, movie_id LIMIT 300000) {a}_rows"
    for a in ("view", "rating", "comment", "collect")
)

KCORE_USER, KCORE_ITEM, KCORE_ROUNDS = 38, 36, 14


def kcore_steps() -> str:
    steps = [f"k0 AS MATERIALIZED (SELECT * FROM {IX} x)"]
    for i in range(1, KCORE_ROUNDS + 1):
        p = f"k{i - 1}"
        steps.append(
            f"k{i} AS MATERIALIZED (SELECT * FROM {p} WHERE user_id IN (SELECT user_id FROM {p} GROUP BY user_id HAVING count(*) >= {KCORE_USER})"
            f" AND movie_id IN (SELECT movie_id FROM {p} GROUP BY movie_id HAVING count(*) >= {KCORE_ITEM}))"
        )
    return "WITH " + ",\n".join(steps)


def kcore() -> str:
    return f"{kcore_steps()} SELECT user_id, movie_id, action_type, rating, {stamp('ts')} AS ts FROM k{KCORE_ROUNDS}"


LEARNED = f"""{kcore_steps()},
every AS MATERIALIZED (SELECT user_id, movie_id, weight, last_ts FROM {PAIRS} p),
ranked AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, weight DESC, movie_id DESC) AS rn
  FROM every SEMI JOIN k{KCORE_ROUNDS} USING (user_id, movie_id)),
pairs AS MATERIALIZED (SELECT user_id, movie_id, CASE WHEN n >= 2 AND rn = 1 THEN 'test' ELSE 'train' END AS fold FROM ranked)"""

ORIGINS = f"""{LEARNED},
cu AS MATERIALIZED (SELECT DISTINCT user_id FROM pairs WHERE fold = 'train'),
cm AS MATERIALIZED (SELECT DISTINCT movie_id FROM pairs WHERE fold = 'train'),
past AS MATERIALIZED (SELECT user_id, movie_id FROM every WHERE (user_id, movie_id) NOT IN (SELECT (user_id, movie_id) FROM pairs WHERE fold = 'test')),
hu AS MATERIALIZED (SELECT DISTINCT user_id FROM past WHERE movie_id IN (FROM cm) AND user_id NOT IN (FROM cu)),
hm AS MATERIALIZED (SELECT DISTINCT movie_id FROM past WHERE user_id IN (FROM cu) AND movie_id NOT IN (FROM cm)),
tags AS MATERIALIZED (SELECT DISTINCT tag_id FROM fx_movie_tag WHERE movie_id IN (FROM cm))
SELECT 'user' AS kind, user_id AS id, 'core' AS origin FROM cu
UNION ALL SELECT 'user', user_id, 'history' FROM hu
UNION ALL SELECT DISTINCT 'user', user_id, 'tags' FROM fx_user_collect_tag
  WHERE tag_id IN (FROM tags) AND user_id NOT IN (FROM cu) AND user_id NOT IN (FROM hu)
UNION ALL SELECT 'movie', movie_id, 'core' FROM cm
UNION ALL SELECT 'movie', movie_id, 'history' FROM hm
UNION ALL SELECT DISTINCT 'movie', movie_id, 'tags' FROM fx_movie_tag
  WHERE tag_id IN (FROM tags) AND movie_id NOT IN (FROM cm) AND movie_id NOT IN (FROM hm)"""


def hashed(text: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


NEGATIVES = f"""WITH seen AS MATERIALIZED (SELECT DISTINCT user_id, movie_id FROM {LABELS4} p),
pool AS MATERIALIZED (SELECT movie_id, row_number() OVER (ORDER BY movie_id) - 1 AS idx FROM (SELECT DISTINCT movie_id FROM seen WHERE movie_id > 0) m),
users AS (SELECT user_id, count(*) * 2 AS need FROM seen GROUP BY user_id),
tries AS (SELECT user_id, need, unnest(range(0, need * 6)) AS i FROM users),
drawn AS (SELECT user_id, need, idx, min(i) AS i FROM (
  SELECT user_id, need, i, {hashed("concat_ws('|', user_id, i, 20260402)")} % (SELECT count(*) FROM pool) AS idx FROM tries) t GROUP BY user_id, need, idx),
picked AS MATERIALIZED (SELECT user_id, movie_id FROM (
  SELECT d.user_id, p.movie_id, d.need, row_number() OVER (PARTITION BY d.user_id ORDER BY d.i) AS rn
  FROM drawn d JOIN pool p ON p.idx = d.idx
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = d.user_id AND s.movie_id = p.movie_id)) r WHERE rn <= need),
short AS (SELECT u.user_id, u.need - coalesce(g.got, 0) AS missing FROM users u
  LEFT JOIN (SELECT user_id, count(*) AS got FROM picked GROUP BY user_id) g ON g.user_id = u.user_id WHERE coalesce(g.got, 0) < u.need),
fill AS (SELECT user_id, movie_id FROM (
  SELECT s.user_id, p.movie_id, s.missing, row_number() OVER (PARTITION BY s.user_id ORDER BY p.idx) AS rn FROM short s CROSS JOIN pool p
  WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_id = s.user_id AND x.movie_id = p.movie_id)
    AND NOT EXISTS (SELECT 1 FROM picked x WHERE x.user_id = s.user_id AND x.movie_id = p.movie_id)) r WHERE rn <= missing)
SELECT user_id, movie_id, CASE WHEN (user_id + movie_id) % 2 = 0 THEN 'two_tower' ELSE 'item_similar_by_tags' END AS source
FROM (SELECT * FROM picked UNION ALL SELECT * FROM fill) o"""

PAIRWISE = f"""WITH pos AS MATERIALIZED (SELECT DISTINCT user_id, movie_id FROM {PAIRS} p),
pool AS MATERIALIZED (SELECT movie_id, row_number() OVER (ORDER BY movie_id) - 1 AS idx FROM (SELECT DISTINCT movie_id FROM fx_movie) m),
tries AS (SELECT p.user_id, p.movie_id, k, {hashed("concat_ws('|', p.user_id, p.movie_id, k, 20260105)")} % (SELECT count(*) FROM pool) AS idx
  FROM pos p CROSS JOIN range(0, 21) r(k)),
marked AS (SELECT t.user_id, t.movie_id, t.k, q.movie_id AS negative_id, h.user_id IS NOT NULL AS hit
  FROM tries t JOIN pool q ON q.idx = t.idx LEFT JOIN pos h ON h.user_id = t.user_id AND h.movie_id = q.movie_id)
SELECT user_id, movie_id, negative_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY k) AS rn FROM marked WHERE NOT hit OR k = 20) x WHERE rn = 1"""

RESAMPLE = f"""WITH units AS MATERIALIZED (SELECT user_id, movie_id, CAST(round(weight * 1000) AS BIGINT) AS units FROM {PAIRS} p),
placed AS MATERIALIZED (SELECT *, sum(units) OVER (ORDER BY user_id, movie_id ROWS UNBOUNDED PRECEDING) - units AS low FROM units WHERE units > 0),
draws AS (SELECT d AS draw_no, {hashed("concat_ws('|', d, 20260105)")} % (SELECT CAST(sum(units) AS BIGINT) FROM placed) AS target
  FROM range(0, (SELECT count(*) FROM placed)) r(d))
SELECT d.draw_no, p.user_id, p.movie_id FROM draws d ASOF JOIN placed p ON d.target >= p.low"""


def split(rows: str, key: str, by: str | None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    n = f"count(*) OVER ({part})"
    return f"""SELECT {key}{', ' + by if by else ''}, CASE WHEN rn <= CASE WHEN n <= 1 THEN n ELSE greatest(1, least(n - 1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT))) END
  THEN 'train' ELSE 'test' END AS fold
FROM (SELECT *, row_number() OVER ({part} ORDER BY code) AS rn, {n} AS n FROM (
  SELECT *, md5(concat_ws('|', {key}, 20260404)) AS code FROM {rows} x) c) r"""


SQL = {
    "interactions_union": f"SELECT user_id, movie_id, action_type, rating, {stamp('ts')} AS ts FROM {IX} x",
    "interactions_recent": f"SELECT user_id, movie_id, action_type, rating, {stamp('ts')} AS ts FROM (SELECT * FROM ({RECENT}) r ORDER BY ts DESC NULLS LAST, action_type, user_id, movie_id LIMIT 300000) o",
    "cf_pair_weights": f"SELECT user_id, movie_id, round(weight, 6) AS weight FROM {CF} p",
    "implicit_pair_strength": f"SELECT user_id, movie_id, round(weight, 6) AS weight, {stamp('last_ts')} AS last_ts FROM {PAIRS} p",
    "rank_labels_binary": f"SELECT user_id, movie_id, action_type, rating, round(strength, 6) AS strength, {stamp('ts')} AS ts, label FROM {LABELS2} l",
    "rank_labels_multitask": f"SELECT * FROM {LABELS4} l",
    "interaction_summary": f"SELECT action_type, count(*) AS n_rows, count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS movies FROM {IX} x GROUP BY action_type",
    "kcore_filter": kcore(),
    "learned_folds": f"{LEARNED} SELECT fold, count(*) AS n_pairs, count(DISTINCT user_id) AS n_users, count(DISTINCT movie_id) AS n_movies FROM pairs GROUP BY fold",
    "learned_origins": ORIGINS,
    "negatives_global": NEGATIVES,
    "negatives_pairwise": PAIRWISE,
    "weighted_resample": RESAMPLE,
    "holdout_last": f"""SELECT user_id, movie_id, round(weight, 6) AS weight, CASE WHEN n >= 2 AND rn = 1 THEN 'test' ELSE 'train' END AS fold FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, weight DESC, movie_id DESC) AS rn FROM {PAIRS} p) r""",
    "split_random": split(LABELS2, "user_id, movie_id", None),
    "split_stratified": split(LABELS2, "user_id, movie_id", "label"),
    "split_group": f"""SELECT l.user_id, l.movie_id, f.fold FROM {LABELS2} l JOIN ({split(f'(SELECT DISTINCT user_id FROM {LABELS2} l)', 'user_id', None)}) f ON f.user_id = l.user_id""",
    "rank_gbt_folds": f"""SELECT fold, 'label' AS task, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS positives,
  count(*) FILTER (WHERE label = 0) AS negatives FROM ({split(LABELS2, "user_id, movie_id", "label")}) s GROUP BY fold""",
    "rank_multitask_folds": f"""WITH l AS MATERIALIZED (SELECT * FROM {LABELS4} p), n AS MATERIALIZED ({NEGATIVES}),
  every AS MATERIALIZED (SELECT user_id, click, collect, "comment", rating FROM l UNION ALL SELECT user_id, 0, 0, 0, 0 FROM n),
  f AS ({split("(SELECT DISTINCT user_id FROM every)", "user_id", None)})
  SELECT fold, task, count(*) AS n_rows, count(*) FILTER (WHERE y > 0.5) AS positives, count(*) FILTER (WHERE y <= 0.5) AS negatives
  FROM (SELECT fold, unnest(['click', 'collect', 'comment', 'rating']) AS task, unnest([click, collect, "comment", rating]) AS y
    FROM every JOIN f USING (user_id)) e GROUP BY fold, task""",
    "vocab_index": f"SELECT 'movie' AS kind, movie_id AS id, row_number() OVER (ORDER BY movie_id) AS idx FROM (SELECT movie_id FROM fx_movie UNION SELECT movie_id FROM {IX} x) m"
    f" UNION ALL SELECT 'user', user_id, row_number() OVER (ORDER BY user_id) FROM (SELECT DISTINCT user_id FROM {IX} x) u"
    " UNION ALL SELECT 'tag', tag_id, 1 + row_number() OVER (ORDER BY tag_id) FROM (SELECT DISTINCT tag_id FROM fx_movie_tag) t",
    "label_distribution": " UNION ALL ".join(
        f"""SELECT '{t}' AS task, count(*) FILTER (WHERE "{t}" > 0.5) AS pos, count(*) FILTER (WHERE "{t}" <= 0.5) AS neg,
 round(CASE WHEN count(*) FILTER (WHERE "{t}" > 0.5) = 0 THEN 1.0 ELSE greatest(1.0, least(20.0, count(*) FILTER (WHERE "{t}" <= 0.5)::DOUBLE / count(*) FILTER (WHERE "{t}" > 0.5))) END::DOUBLE, 6) AS weight FROM {LABELS4} l"""
        for t in ("click", "collect", "comment", "rating")
    ),
}
