"""The jobs as queries, each run twice into a folder of its own, and the SQL of their output."""

import os

from pyspark.sql import DataFrame, SparkSession

from jobs import search_watch, thread_digest
from quarry.plans.queries import PRUNE, TERMS
from quarry.stored import Stored

HERE = os.path.dirname(os.path.abspath(__file__))


def job1_thread_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stored(spark, "thread-digest").path
    config = thread_digest.read_config(f"{HERE}/thread_digest.json")
    for _ in range(2):
        rows = thread_digest.run(spark, f"{sf_dir}/conversations.parquet", f"{path}/output", config)
    return rows


def job2_search_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stored(spark, "search-watch").path
    config = search_watch.read_config(f"{HERE}/search_watch.json")
    for _ in range(2):
        rows = search_watch.run(spark, f"{sf_dir}/documents.parquet", f"{path}/output", f"{path}/checkpoint", config)
    return rows.drop("batch")


QUERIES = {"job1_thread_digest": job1_thread_digest, "job2_search_watch": job2_search_watch}

#: The start of a text, in front of a word that begins with the first word of three letters or more of a search.
BEFORE = r"'(?is)^(.*?(?:^|[^\p{{L}}\p{{N}}_]))(?:{0})'"

ORACLE_SQL = {
    "job1_thread_digest": f"""WITH RECURSIVE {PRUNE}, kc AS (SELECT * FROM c WHERE post_id IN (SELECT id FROM tp) AND (post_id, id) IN (SELECT (post_id, id) FROM up)),
rk AS (SELECT *, row_number() OVER (PARTITION BY post_id, up ORDER BY created, id) AS r FROM (SELECT kc.*, x.id AS up FROM kc LEFT JOIN kc x ON x.post_id = kc.post_id AND x.id = kc.parent)),
dn AS (SELECT post_id, id, id AS root, 0 AS depth, [r] AS path FROM rk WHERE up IS NULL UNION ALL SELECT k.post_id, k.id, d.root, d.depth + 1, list_append(d.path, k.r) FROM dn d JOIN rk k ON k.post_id = d.post_id AND k.up = d.id),
od AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY path) AS place, repeat('> ', least(depth + 1, 6)) AS q FROM dn),
al AS (
  SELECT id AS post_id, 0 AS place, id, NULL::VARCHAR AS root, NULL::BIGINT AS depth, '### ' || title || chr(10) || selftext AS text FROM tp WHERE selftext <> '' OR id IN (SELECT post_id FROM kc)
  UNION ALL
  SELECT post_id, place, id, root, depth, q || '**u/' || author || '** (' || score || ') · c/' || id || CASE WHEN depth >= 6 THEN ' · [d' || (depth + 1) || ']' ELSE '' END || chr(10)
    || array_to_string(list_transform(string_split(body, chr(10)), lambda x: q || CASE WHEN regexp_matches(x, '^\\s*(#|>|---\\s*$)') THEN '\\' || x ELSE x END), chr(10)) || chr(10) || rtrim(q)
  FROM od JOIN kc USING (post_id, id)),
us AS (SELECT *, length(text) // 4 AS tokens, coalesce(sum(length(text) // 4) OVER (PARTITION BY post_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM al)
SELECT post_id, place::INT AS place, id, root, depth::INT AS depth, text, tokens, used, used + tokens <= 400 AS shown,
       strftime(to_timestamp(1704067200 + substr(post_id, 2)::BIGINT * 3600) AT TIME ZONE 'UTC', '%Y-%m') AS month FROM us""",
    "job2_search_watch": f"""WITH v AS (SELECT DISTINCT doc_id AS pid, text, sha256(text) AS version FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT *, {TERMS.format('text')} AS t, ' ' || array_to_string({TERMS.format('text')}, ' ') || ' ' AS line FROM v),
h AS (SELECT *, 'plain' AS search, regexp_extract(text, {BEFORE.format('the')}, 1) AS pre FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'of')
  UNION ALL SELECT *, 'phrases', regexp_extract(text, {BEFORE.format('the')}, 1) FROM t WHERE contains(line, ' of the ') OR contains(line, ' in the ')
  UNION ALL SELECT *, 'without', regexp_extract(text, {BEFORE.format('der')}, 1) FROM t WHERE list_contains(t, 'der') AND NOT (list_contains(t, 'la') OR list_contains(t, 'el'))),
s AS (SELECT *, greatest(length(pre) - 133, 0) AS s FROM h)
SELECT pid, 'd' || pid AS id, version, length(text) // 4 AS tokens, search, CASE WHEN s > 0 THEN '…' ELSE '' END || substring(text, s + 1, 400) || CASE WHEN s + 400 < length(text) THEN '…' ELSE '' END AS shown FROM s""",
}
