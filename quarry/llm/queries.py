"""The queries of this subpackage and the SQL that DuckDB runs for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession

from . import ann, conversations, decontam, fingerprints, langid, licenses, lines, minhash, passages, pieces, pii, warc
from .scratch import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("target_uri")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(spark, table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


#: The tokenizer's model file on the driver.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(spark, table(spark, sf_dir, "documents"), line_words=passages.LINE_WORDS)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(spark, table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(spark, table(spark, sf_dir, "documents"), MODEL_PATH)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"), conversations.damage())


QUERIES = {"op1_warc": op1_warc, "op2_lines": op2_lines, "op3_ann": op3_ann, "op4_licenses": op4_licenses, "op5_langid": op5_langid, "op6_decontam": op6_decontam, "op7_passages": op7_passages, "op8_pii": op8_pii, "op9_pieces": op9_pieces, "op10_minhash": op10_minhash, "op11_fingerprints": op11_fingerprints, "op12_conversations": op12_conversations}

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m""",
    "op2_lines": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text <> ''),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda t: t <> ''))) AS ws FROM l),
c AS (SELECT ws, min((doc_id, pos)) AS rank, row_number() OVER () AS k FROM w WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT k, unnest(ws) AS t FROM c),
-- two sets that match share one of the first words of each in one order of all words
f AS (SELECT t, count(*) AS f FROM t GROUP BY t),
o AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY f, t) AS i FROM t JOIN f USING (t)),
p AS (SELECT o.k, o.t FROM o JOIN c USING (k) WHERE i <= len(ws) - ceil(len(ws) * 4 / 5.0) + 1),
q AS (SELECT DISTINCT a.k AS x, b.k AS y FROM p a JOIN p b ON a.t = b.t AND a.k <> b.k),
m AS (SELECT DISTINCT q.y FROM q JOIN c x ON x.k = q.x JOIN c y ON y.k = q.y
      WHERE x.rank < y.rank AND len(list_intersect(x.ws, y.ws)) * 9 >= (len(x.ws) + len(y.ws)) * 4),
r AS (SELECT w.doc_id, w.pos, w.line, c.k IS NOT NULL AND (m.y IS NOT NULL OR c.rank <> (w.doc_id, w.pos)) AS gone
      FROM w LEFT JOIN c ON c.ws = w.ws LEFT JOIN m ON m.y = c.k)
SELECT d.doc_id, CASE WHEN coalesce(n, 0) = 0 THEN d.text ELSE coalesce(kept, '') END AS text, coalesce(n, 0)::INT AS n_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id) s USING (doc_id)""",
    "op10_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       coalesce(c.m, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op12_conversations": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
-- CRC-32, bit by bit over the bytes of the key
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS fault FROM raw),
g AS (SELECT conv_id, turn, role0, text0, copy, CASE WHEN fault = 4 THEN 'user' ELSE role0 END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text
      FROM f JOIN (VALUES (1), (2)) AS copies(copy) ON fault <> 0 AND (copy = 1 OR fault = 3)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS i FROM g),
u AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substring(role, 1, 1) AS first, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM t),
v AS (SELECT *, blank OR again AS go, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM u),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
        count(*) FILTER (cut AND NOT go) AS truncated, count(*) FILTER (i > 1 AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM v GROUP BY conv_id),
-- cost, edits and repaired turns from turn i on: after nothing (z), a system (s), a user (x) and an assistant (y) turn
dp AS (
  SELECT conv_id, n + 1 AS i, {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS z, {'c': 10::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']} AS s,
         {'c': 5::BIGINT, 'a': 'I', 'o': ['assistant:']} AS x, {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS y FROM n
  UNION ALL
  SELECT conv_id, i, list_min([z, {'c': x.c + 5, 'a': 'I' || x.a, 'o': list_prepend('user:', x.o)}]), list_min([s, {'c': x.c + 5, 'a': 'I' || x.a, 'o': list_prepend('user:', x.o)}]), x, y
  FROM (
    SELECT conv_id, i, z, s, list_min([x, {'c': y.c + 5, 'a': 'I' || y.a, 'o': list_prepend('assistant:', y.o)}]) AS x, list_min([y, {'c': x.c + 5, 'a': 'I' || x.a, 'o': list_prepend('user:', x.o)}]) AS y
    FROM (
      SELECT dp.conv_id, v.i,
        list_min(list_filter([{'c': z.c + 2, 'a': 'D' || z.a, 'o': z.o}, CASE WHEN NOT go THEN {'c': x.c + 1 + more, 'a': 'R' || x.a, 'o': list_prepend('user:' || text, x.o)} END,
          CASE WHEN NOT go AND first = 's' THEN {'c': s.c + more, 'a': 'K' || s.a, 'o': list_prepend(role || ':' || text, s.o)} WHEN NOT go AND first = 'u' THEN {'c': x.c + more, 'a': 'K' || x.a, 'o': list_prepend(role || ':' || text, x.o)} END], lambda w: w IS NOT NULL)) AS z,
        list_min(list_filter([{'c': s.c + 2, 'a': 'D' || s.a, 'o': s.o}, CASE WHEN NOT go THEN {'c': x.c + 1 + more, 'a': 'R' || x.a, 'o': list_prepend('user:' || text, x.o)} END,
          CASE WHEN NOT go AND first = 'u' THEN {'c': x.c + more, 'a': 'K' || x.a, 'o': list_prepend(role || ':' || text, x.o)} END], lambda w: w IS NOT NULL)) AS s,
        list_min(list_filter([{'c': x.c + 2, 'a': 'D' || x.a, 'o': x.o}, CASE WHEN NOT go THEN {'c': y.c + 1 + more, 'a': 'R' || y.a, 'o': list_prepend('assistant:' || text, y.o)} END,
          CASE WHEN NOT go AND first = 'a' THEN {'c': y.c + more, 'a': 'K' || y.a, 'o': list_prepend(role || ':' || text, y.o)} END], lambda w: w IS NOT NULL)) AS x,
        list_min(list_filter([{'c': y.c + 2, 'a': 'D' || y.a, 'o': y.o}, CASE WHEN NOT go THEN {'c': x.c + 1 + more, 'a': 'R' || x.a, 'o': list_prepend('user:' || text, x.o)} END,
          CASE WHEN NOT go AND first = 'u' THEN {'c': x.c + more, 'a': 'K' || x.a, 'o': list_prepend(role || ':' || text, x.o)} END], lambda w: w IS NOT NULL)) AS y
      FROM dp JOIN v ON v.conv_id IS NOT DISTINCT FROM dp.conv_id AND v.i = dp.i - 1)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(z.c, 0) AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(array_to_string(z.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN dp ON dp.i = 1 AND dp.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
