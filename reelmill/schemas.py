"""Declared schemas of the logical tables; readers project and cast to them."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "movie": "movie_id BIGINT, title STRING, year INT, release_date DATE, duration_min INT, summary STRING,"
    " rating_sum BIGINT, rating_count INT, status STRING, deleted_at TIMESTAMP_NTZ",
    "user": "user_id BIGINT, gender STRING, birth DATE, profession STRING, created_at TIMESTAMP_NTZ,"
    " status STRING, deleted_at TIMESTAMP_NTZ",
    "rating": "user_id BIGINT, movie_id BIGINT, rating INT, updated_at TIMESTAMP_NTZ",
    "user_click": "id BIGINT, user_id BIGINT, movie_id BIGINT, created_at TIMESTAMP_NTZ",
    "user_collect_movie": "user_id BIGINT, movie_id BIGINT, created_at TIMESTAMP_NTZ",
    "movie_comment": "comment_id BIGINT, user_id BIGINT, movie_id BIGINT, created_at TIMESTAMP_NTZ,"
    " deleted_at TIMESTAMP_NTZ",
    "movie_tag": "movie_id BIGINT, tag_id BIGINT, weight DECIMAL(10,4), vote_up INT, hot_score DECIMAL(10,4)",
    "tag_dict": "tag_id BIGINT, tag_name STRING, type STRING",
    "user_collect_tag": "user_id BIGINT, tag_id BIGINT, is_static INT, created_at TIMESTAMP_NTZ",
    "person": "person_id BIGINT, person_name STRING",
    "movie_person": "movie_person_id BIGINT, movie_id BIGINT, person_id BIGINT, person_role STRING",
    "dict_region": "region_id BIGINT, name_en STRING, name_cn STRING",
    "movie_region": "movie_id BIGINT, region_id BIGINT",
    "dict_language": "lang_id BIGINT, name_en STRING, name_cn STRING",
    "movie_language": "movie_id BIGINT, lang_id BIGINT, is_primary INT",
    "movie_embeddings": "id BIGINT, movie_id BIGINT, chunk_text STRING, vec ARRAY<FLOAT>",
    "ops_task": "id BIGINT, task_type STRING, status STRING, parent_task_id BIGINT, task_ref_override STRING,"
    " payload STRING, progress STRING, result STRING, created_at TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ,"
    " finished_at TIMESTAMP_NTZ",
}
