"""Hand-made cases and properties."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions.arrays import pad_or_truncate
from reelmill.functions.text import grams, one_decimal, words
from reelmill.functions.times import age_bucket, age_label, calendar_age, parse_moment
from reelmill.operators import knn as knn_module
from reelmill.operators import delivery, documents, evaluation, evidence, interactions, ranking, samples, search
from reelmill.operators.knn import knn
from reelmill.operators.ordering import newest, with_position
from reelmill.operators.vectors import load_vectors
from reelmill.operators.recall import merge_candidates


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# --- metrics ---------------------------------------------------------------------


def brute_auc(pairs):
    pos = [s for y, s in pairs if y > 0.5]
    neg = [s for y, s in pairs if y <= 0.5]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_across_classes(spark):
    rows = [(1.0, 0.3), (0.0, 0.3), (1.0, 0.9), (0.0, 0.1), (0.0, 0.9), (1.0, 0.3), (0.0, 0.2)]
    df = spark.createDataFrame(rows, "label double, score double")
    assert evaluation.auc(df, "label", "score").first()["auc"] == pytest.approx(brute_auc(rows))
    flipped = evaluation.auc(df.withColumn("score", -F.col("score")), "label", "score").first()["auc"]
    assert flipped == pytest.approx(1 - brute_auc(rows))


def test_auc_by_group_and_missing_class(spark):
    rng = np.random.default_rng(3)
    rows = [(t, float(rng.integers(0, 2)), float(rng.integers(0, 6))) for t in ("a", "b") for _ in range(60)]
    df = spark.createDataFrame(rows, "task string, label double, score double")
    got = dict(values(evaluation.auc(df, "label", "score", ["task"]), "task", "auc"))
    for t in ("a", "b"):
        assert got[t] == pytest.approx(brute_auc([(y, s) for g, y, s in rows if g == t]))
    with pytest.raises(Exception, match="both classes"):
        evaluation.auc(df.filter("label > 0.5"), "label", "score").collect()


# --- ages and small functions -----------------------------------------------------


def test_age_variants(spark):
    now = datetime(2024, 1, 31)
    births = [date(2006, 1, 31), date(2006, 2, 1), date(1999, 2, 5), date(2030, 1, 1), None]
    df = spark.createDataFrame([(b,) for b in births], "birth date")
    out = df.select(age_bucket(F.col("birth"), now).alias("a"), calendar_age(F.col("birth"), now).alias("c"),
                    age_label(calendar_age(F.col("birth"), now)).alias("l"))
    assert values(out, "a", "c", "l") == [(2, 18, "18_24"), (2, 17, "lt18"), (3, 24, "18_24"), (1, 0, "unknown"), (0, None, "unknown")]


def test_small_expressions(spark):
    df = spark.createDataFrame([([3, 0, -1, 5],)], "v array<bigint>")
    assert df.select(pad_or_truncate(F.col("v"), 3).alias("p")).first()["p"] == [3, 5, 0]
    one = spark.range(1)
    assert one.select(one_decimal(F.lit(7.25)).alias("x")).first()["x"] == "7.3"
    assert one.select(words(F.lit("  b a  b ")).alias("x")).first()["x"] == ["b", "a"]
    assert sorted(one.select(grams(F.lit("abab"), 2).alias("x")).first()["x"]) == ["ab", "ba"]
    assert one.select(grams(F.lit("a"), 3).alias("x")).first()["x"] == []
    stamps = one.select(*[parse_moment(F.lit(t)).alias(f"c{i}") for i, t in enumerate(
        ["2024-01-02 03:04:05", "2024-01-02", "2024-01-02T03:04:05", " ", None])]).first()
    assert list(stamps) == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), None, None]


# --- samples ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def hot_pairs(spark):
    """One user owns a third of all pairs."""
    rng = np.random.default_rng(11)
    rows = {(1, int(m)) for m in range(1, 1501)}
    while len(rows) < 4500:
        rows.add((int(rng.integers(2, 80)), int(rng.integers(1, 4000))))
    return spark.createDataFrame(sorted(rows), "user_id bigint, movie_id bigint").repartition(5)


def test_global_negatives_are_new_distinct_and_complete(spark, hot_pairs):
    seen = {tuple(r) for r in hot_pairs.collect()}
    pool = {m for _, m in seen}
    got = [tuple(r) for r in samples.global_negatives(hot_pairs).select("user_id", "movie_id").collect()]
    assert len(got) == len(set(got)) and not set(got) & seen
    assert {m for _, m in got} <= pool
    per_user = {}
    for u, _ in got:
        per_user[u] = per_user.get(u, 0) + 1
    for u in {u for u, _ in seen}:
        mine = len({m for x, m in seen if x == u})
        assert per_user[u] == min(2 * mine, len(pool) - mine)


def test_kcore_is_stable_and_maximal(spark, hot_pairs):
    ix = hot_pairs.filter("user_id < 40")
    kept = {tuple(r) for r in samples.kcore(ix, 20, 2).collect()}
    rows = {tuple(r) for r in ix.collect()}
    while True:
        users, items = {}, {}
        for u, m in rows:
            users[u] = users.get(u, 0) + 1
            items[m] = items.get(m, 0) + 1
        left = {(u, m) for u, m in rows if users[u] >= 20 and items[m] >= 2}
        if left == rows:
            break
        rows = left
    assert kept == rows


@pytest.mark.parametrize("n", [2, 3, 7, 1000])
def test_random_split_is_exact(spark, n):
    out = samples.split(spark.range(n).withColumnRenamed("id", "k"), ["k"])
    sizes = dict(values(out.groupBy("fold").count(), "fold", "count"))
    cut = max(1, min(n - 1, int(n * 0.8)))
    assert sizes == {"train": cut, "test": n - cut}


def test_stratified_split_keeps_a_single_row_in_train(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(21)], "k bigint, label int")
    got = dict(((l, f), c) for l, f, c in values(samples.split(df, ["k"], "label", "stratified").groupBy("label", "fold").count(), "label", "fold", "count"))
    assert got == {(1, "train"): 1, (0, "train"): 16, (0, "test"): 4}


def test_group_split_never_divides_a_group(spark, hot_pairs):
    out = samples.split(hot_pairs, ["user_id", "movie_id"], "user_id", "group")
    assert out.groupBy("user_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert out.count() == hot_pairs.count()


def test_weighted_resample_follows_the_weights(spark):
    pairs = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (2, 3, 3.0), (2, 4, 0.0)], "user_id bigint, movie_id bigint, weight double")
    counts = dict(values(samples.weighted_resample(pairs, 9000).groupBy("movie_id").count(), "movie_id", "count"))
    assert sum(counts.values()) == 9000 and 4 not in counts
    assert counts[1] == pytest.approx(5000, rel=0.06) and counts[2] == pytest.approx(1000, rel=0.15)


def test_newest_with_one_crowded_hour(spark):
    rows = [(i, datetime(2024, 1, 1, 5, 0, 0)) for i in range(400)] + [(1000 + i, datetime(2024, 1, 2, i, 0, 0)) for i in range(5)]
    df = spark.createDataFrame(rows + [(5000, None)], "k bigint, ts timestamp_ntz")
    got = [r["k"] for r in newest(df, "ts", ["k"], 8).collect()]
    assert got == [1004, 1003, 1002, 1001, 1000, 0, 1, 2]
    assert newest(df, "ts", ["k"], 1000).count() == 406


def test_positions_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(i * 37 % 501,) for i in range(501)], "v bigint").repartition(7)
    got = with_position(df, [F.col("v").asc()]).orderBy("v").collect()
    assert [r["pos"] for r in got] == list(range(1, 502))


def test_rating_source_wins_the_label(spark):
    t = datetime(2024, 1, 1)
    ix = spark.createDataFrame(
        [(1, 1, "view", None, t), (1, 1, "collect", None, t), (1, 1, "rating", 7, t), (1, 2, "view", None, t), (1, 2, "collect", None, None),
         (1, 3, "rating", 4, t), (1, 3, "dislike", None, t)], "user_id bigint, movie_id bigint, action_type string, rating int, ts timestamp_ntz")
    got = {r["movie_id"]: (r["action_type"], r["label"], r["strength"]) for r in interactions.binary_labels(ix, None).collect()}
    assert got == {1: ("rating", 0, 0.4), 2: ("collect", 1, 1.2), 3: ("rating", 0, -0.2)}
    four = {r["movie_id"]: (r["click"], r["collect"], r["rating"], r["source"]) for r in interactions.multitask_labels(ix).collect()}
    assert four[1] == (1, 1, 1, "user_high_rating_similar") and four[3] == (1, 0, 0, "recent_interaction")


# --- vectors --------------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 1000])
def test_knn_equals_brute_force_with_duplicates(spark, block):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(60, 6)).round(1)
    corpus[10] = corpus[11] = corpus[50]
    queries = rng.normal(size=(20, 6))
    queries[3] = 0
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "item_id bigint, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vec array<double>")
    got = {}
    for r in knn(q, c, 5, block_rows=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], round(r["score"], 9)))
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    scores = unit(queries) @ unit(corpus).T
    for i, row in enumerate(scores):
        want = sorted(((-round(s, 9), j) for j, s in enumerate(row)))[:5]
        assert sorted(s for _, s in got[i]) == sorted(-s for s, _ in want)
        if i != 3:
            assert [j for j, _ in got[i]] == [j for _, j in want]


def test_load_vectors_rejects(spark):
    blob = np.array([3, 4], "<f4").tobytes()
    df = spark.createDataFrame([(2, blob), (3, b""), (4, np.array([1, 2, 3], "<f4").tobytes()), (5, None), (6, bytes(8))], "id bigint, vec binary")
    good, bad = load_vectors(df)
    assert {r["id"]: [round(x, 6) for x in r["vec"]] for r in good.collect()} == {2: [0.6, 0.8], 6: [0.0, 0.0]}
    assert dict(values(bad, "id", "reason")) == {3: "empty_vector", 4: "wrong_dimension", 5: "empty_vector"}


def test_co_strength_in_many_blocks(spark, hot_pairs):
    pairs = hot_pairs.filter("movie_id < 300").withColumn("weight", (F.col("movie_id") % 5 - 1).cast("double")).filter("weight != 0")
    got = {(r["item_id"], r["hist_id"]): r["dot"] for r in ranking.co_strength(pairs, pairs, item_block=40, user_block=9, step=500).collect()}
    rows = [tuple(r) for r in pairs.collect()]
    want = {}
    by_user = {}
    for u, m, w in rows:
        by_user.setdefault(u, []).append((m, w))
    for items in by_user.values():
        for a, x in items:
            for b, y in items:
                want[a, b] = want.get((a, b), 0.0) + x * y
    assert got == pytest.approx(want)


# --- search and evidence ------------------------------------------------------------------


@pytest.fixture(scope="module")
def movies(spark):
    return spark.createDataFrame(
        [(1, "Blue 100% Ring", "a story", 10), (2, "bl_ue", "the ring\nof blue fire", 0), (3, "Red", None, 20000), (4, "bXue", "blue-ringed", 1)],
        "movie_id bigint, title string, summary string, rating_count int",
    )


def brute_like(movie, query):
    import re

    def like(text, pattern):
        body = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern.lower())
        return re.search(body, (text or "").lower(), re.S) is not None

    title, summary, votes = movie[1], movie[2], movie[3]
    tokens = list(dict.fromkeys(query.split()))
    phrase_t, phrase_s = like(title, query), like(summary, query)
    if not (phrase_t or phrase_s or all(like(title, t) or like(summary, t) for t in tokens)):
        return None
    return 10 * phrase_t + 4 * phrase_s + min(votes, 10000) / 10000 + sum(2 if like(title, t) else 1 if like(summary, t) else 0 for t in tokens)


def test_like_scores_equal_brute_force(spark, movies):
    texts = ["blue", "b_ue", "ring blue", "Blue 100%", "r%g", "%", "_", "e", "the ring", "the  ring", "zzz", "blue blue", "of%fire", "g\\", "ring of"]
    requests = spark.createDataFrame(list(enumerate(texts)), "request_id bigint, query string")
    got = {(r["request_id"], r["movie_id"]): round(r["score"], 6) for r in search.like_scores(movies, requests).collect()}
    want = {}
    for i, text in enumerate(texts):
        for m in movies.collect():
            score = brute_like(tuple(m), text)
            if score is not None:
                want[i, m["movie_id"]] = round(score, 6)
    assert got == want


def test_request_validation():
    ok = search.normalise_request(" x ", sort_by="Favourite", time_window="half-year", today=date(2024, 1, 31), tag_ids=[2, 2, 1])
    assert (ok.sort_by, ok.release_start, ok.tag_ids, ok.mode) == ("collect", date(2023, 8, 4), (2, 1), "mixed")
    for bad in ({"sort_by": "nope"}, {"sort_order": "up"}, {"n": 0}, {"offset": -1}, {"time_window": "decade"},
                {"time_window": "week", "start_date": date(2024, 1, 1)}, {"duration_min": 5, "duration_max": 4}):
        with pytest.raises(ValueError):
            search.normalise_request(**bad)


def test_search_falls_through_to_substrings(spark, cat):
    page, total = search.search(cat, search.normalise_request("idge", n=3))
    rows = page.orderBy("pos").collect()
    assert total.first()["total"] >= len(rows) > 0
    assert [r["pos"] for r in rows] == list(range(1, len(rows) + 1))


def test_citation_audit_cases(spark):
    begin, end = evidence.BEGIN_MARK, evidence.END_MARK
    body = lambda ids: f'x{begin}{{"cited_movie_ids": {ids}}}{end}'
    cases = {
        1: (body('[7, "7", 9.0, " 9 "]'), "ok", [7, 9]),
        2: (body("[7, 8]"), "out_of_evidence", []),
        3: (body("[true]"), "movie_id_invalid", []),
        4: (body("[7.5]"), "movie_id_invalid", []),
        5: (body('["x"]'), "movie_id_invalid", []),
        6: (body("[]"), "ok", []),
        7: (body("3"), "ids_invalid", []),
        8: (f"x{begin}[1]{end}", "root_not_object", []),
        9: (f"x{begin}{{{end}", "json_invalid", []),
        10: (body("[7]") + " more", "trailing_text", []),
        11: (f"x{begin}{{}}", "end_marker_missing", []),
        12: ("x", "begin_marker_missing", []),
        13: (f"x{begin}  {end}", "payload_missing", []),
        14: (body("[8, true]"), "out_of_evidence", []),
    }
    answers = spark.createDataFrame([(1, k, v[0]) for k, v in cases.items()], "query_id bigint, variant int, answer string")
    found = spark.createDataFrame([(1, 7), (1, 9)], "query_id bigint, movie_id bigint")
    got = {r["variant"]: (r["status"], r["cited_ids"]) for r in evidence.audit_citations(answers, found, ["query_id", "variant"]).collect()}
    assert got == {k: (v[1], v[2]) for k, v in cases.items()}


def test_context_without_evidence(spark):
    queries = spark.createDataFrame([(1,)], "query_id bigint")
    empty = spark.createDataFrame([], "query_id bigint, rank int, movie_id bigint, title string, year int, rating_avg double, rating_count int, summary string, chunk_text string")
    assert evidence.context(empty, queries).first()["context"] == evidence.NO_EVIDENCE


def test_upsert_keeps_ids_and_numbers_new_rows(spark):
    old = spark.createDataFrame([(5, 10, "a"), (9, 11, "b")], "id bigint, movie_id bigint, chunk_text string")
    new = spark.createDataFrame([(11, "B"), (3, "c"), (40, "d")], "movie_id bigint, chunk_text string")
    assert sorted(values(documents.upsert(old, new), "id", "movie_id", "chunk_text")) == [(5, 10, "a"), (9, 11, "B"), (10, 3, "c"), (11, 40, "d")]
    assert sorted(values(documents.insert_missing(old, new), "id", "movie_id", "chunk_text")) == [(5, 10, "a"), (9, 11, "b"), (10, 3, "c"), (11, 40, "d")]


# --- ranking and delivery -------------------------------------------------------------------


def brute_cf(pairs, candidates, neighbours):
    items = {}
    for (u, m), w in pairs.items():
        items.setdefault(m, {})[u] = w
    norm = {m: sum(w * w for w in v.values()) ** 0.5 for m, v in items.items()}
    raw = {}
    for u, m, s in candidates:
        liked = {h: w for (x, h), w in pairs.items() if x == u and w > 0}
        if m not in items or not liked:
            continue
        sims = []
        for h, w in liked.items():
            dot = sum(x * items[h].get(v, 0.0) for v, x in items[m].items())
            size = norm[m] * norm[h]
            sims.append((-round(dot / size if size else 0.0, 9), h, w))
        top = sorted(sims)[:neighbours]
        den = sum(w for _, _, w in top)
        raw[u, m] = (sum(max(0.0, -s) * w for s, _, w in top) / den, s, sum(items[m].values()))
    out = {}
    for u, m in raw:
        mine = [v for (x, _), v in raw.items() if x == u]
        scale = lambda i: 0.0 if max(v[i] for v in mine) - min(v[i] for v in mine) <= 1e-12 else (
            (raw[u, m][i] - min(v[i] for v in mine)) / (max(v[i] for v in mine) - min(v[i] for v in mine)))
        out[u, m] = 0.72 * scale(0) + 0.18 * scale(1) + 0.10 * scale(2)
    return out


def test_item_similarity_ranker_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pairs = {(int(u), int(m)): float(rng.choice([-0.6, 0.2, 1.0, 1.6])) for u in range(1, 13) for m in rng.choice(30, 12, replace=False)}
    candidates = [(int(u), int(m), float(rng.random())) for u in range(1, 15) for m in rng.choice(34, 9, replace=False)]
    p = spark.createDataFrame([(u, m, w) for (u, m), w in pairs.items()], "user_id bigint, movie_id bigint, weight double")
    c = spark.createDataFrame(candidates, "user_id bigint, item_id bigint, score double")
    for neighbours in (3, 30):
        got = {(r["user_id"], r["item_id"]): r["score"] for r in ranking.ItemCFRanker(p, neighbours).rank(c).collect()}
        assert got == pytest.approx(brute_cf(pairs, candidates, neighbours), abs=1e-6)


def test_merge_prefers_score_then_first_recaller(spark):
    schema = "user_id bigint, item_id bigint, score double, source string"
    a = spark.createDataFrame([(1, 1, 0.5, "a"), (1, 2, 0.1, "a")], schema)
    b = spark.createDataFrame([(1, 1, 0.5, "b"), (1, 2, 0.7, "b")], schema)
    assert sorted(values(merge_candidates([a, b]), "item_id", "score", "source")) == [(1, 0.5, "a"), (2, 0.7, "b")]


def test_delivery_truncation_and_pages(spark):
    ranked = spark.createDataFrame([(1, i, float(i), "x") for i in range(50)], "user_id bigint, item_id bigint, score double, reason string")
    after = delivery.deliver(ranked, delivery.SeededShuffle(4), 10)
    before = delivery.deliver(ranked, delivery.SeededShuffle(4), 10, "before")
    assert {r["item_id"] for r in before.collect()} == set(range(40, 50))
    assert {r["item_id"] for r in after.collect()} != set(range(40, 50))
    whole = [r["item_id"] for r in after.orderBy("pos").collect()]
    pages = [delivery.page(after, n, 4).first() for n in (1, 2, 3, 4)]
    assert sum((p["items"] for p in pages), []) == whole
    assert [p["has_next"] for p in pages] == [True, True, False, False]
    assert all(p["total"] == 10 for p in pages)


def test_minmax_of_equal_scores_is_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "user_id bigint, score double")
    assert sorted(values(ranking.minmax(df, ["score"], "user_id"), "user_id", "score")) == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 1.0)]


def test_vectors_of_other_dimensions_are_left_out(spark):
    from reelmill.operators.knn import knn

    items = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0] * 5), (3, [1.0, 1.0, 0.0]), (4, [1.0] * 4)], "item_id long, vec array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [1.0] * 4)], "query_id long, vec array<double>")
    assert sorted((r.query_id, r.item_id) for r in knn(asked, items, 5).collect()) == [(7, 1), (7, 3)]


def test_rating_without_value_has_no_weight(spark):
    from reelmill.operators.interactions import cf_pair_weights

    rows = [(1, 1, "rating", None), (1, 2, "view", None), (2, 1, "rating", 10)]
    df = spark.createDataFrame(rows, "user_id long, movie_id long, action_type string, rating int")
    assert sorted(tuple(r) for r in cf_pair_weights(df).collect()) == [(1, 1, 0.0), (1, 2, 0.2), (2, 1, 1.0)]


def test_elapsed_of_an_unstarted_task_is_unknown(spark):
    from reelmill.operators.reports import task_progress

    row = (1, "train_job", "pending", None, None, None, None, None)
    df = spark.createDataFrame([row], "id long, task_type string, status string, payload string, progress string, result string, started_at timestamp, finished_at timestamp")
    assert task_progress(df).first()["elapsed_ms"] is None


def test_vector_blocks_bound_the_memory_of_a_task(spark, monkeypatch):
    steps = knn_module.query_steps(knn_module.BLOCK_ROWS, knn_module.BLOCK_ROWS)
    assert max(s.stop - s.start for s in steps) * knn_module.BLOCK_ROWS <= knn_module.CELLS and steps[-1].stop >= knn_module.BLOCK_ROWS
    rows = [(i, [float(i * 7 % 11), float(i * 5 % 13), 1.0]) for i in range(60)]
    queries = spark.createDataFrame(rows, "query_id bigint, vec array<double>")
    corpus = queries.withColumnRenamed("query_id", "item_id")
    want = sorted(tuple(r) for r in knn_module.knn(queries, corpus, 4).select("query_id", "item_id", "rank").collect())
    monkeypatch.setattr(knn_module, "CELLS", 30)
    monkeypatch.setattr(knn_module, "BEST_ROWS", 40)
    assert sorted(tuple(r) for r in knn_module.knn(queries, corpus, 4).select("query_id", "item_id", "rank").collect()) == want


def test_search_reads_texts_once(spark, tmp_path, monkeypatch):
    """Texts are split once and nothing but found tokens is shuffled towards the requests; hits of title and summary stay apart."""
    movies = spark.createDataFrame(
        [(1, "Blue lake", "red lake house", 5), (2, "red", None, 2), (3, None, "blueish red", 0), (4, "green", "a redder_x", 1)],
        "movie_id long, title string, summary string, rating_count int")
    requests = spark.createDataFrame([(1, "red"), (2, "lake BLUE"), (3, "blue  lake"), (4, "r_d"), (5, "none")], "request_id int, query string")
    written = []
    real = search.stored
    monkeypatch.setattr(search, "stored", lambda df, name: (written.append(name), real(df, name))[1])
    got = {(r.request_id, r.movie_id): r.score for r in search.like_scores(movies, requests).collect()}
    assert written == ["movies", "words", "tokens", "matched"]
    assert got == pytest.approx({
        (1, 1): 5 + 5e-4, (1, 2): 12 + 2e-4, (1, 3): 5, (1, 4): 5 + 1e-4, (2, 1): 4 + 5e-4, (3, 1): 4 + 5e-4,
        (4, 1): 5 + 5e-4, (4, 2): 12 + 2e-4, (4, 3): 5, (4, 4): 5 + 1e-4})
