"""The queries of the library over the provided tables, and the SQL that DuckDB runs for each that SQL can express."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.functions import analysis, text
from quarry.operators import forest, fulltext, hits, sampling, spans, verdicts
from quarry.plans import filtering, ingest, judging, readonly, report, scoring
from quarry.sources import adapter as A, chunks as chunk_source
from quarry.stored import Stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# ── SQL that many oracles begin with ─────────────────────────────────────────
P = """p AS (SELECT 'd' || doc_id AS id, doc_id AS pid, lang AS sub, source AS link_flair, substring(text, 1, 80) AS title, text AS selftext,
  'u' || (doc_id % 97) AS author, n_chars % 100 AS score, 1704067200 + doc_id * 600 AS created FROM documents)"""
C = """c AS (SELECT 'c' || conv_id || '_' || turn AS id, 'c' || conv_id AS post_id, CASE WHEN turn >= 2 THEN 'c' || conv_id || '_' || (turn // 2) END AS parent,
  role AS author, ('0x' || substr(sha1('c' || conv_id || '_' || turn), 1, 4))::BIGINT % 20 - 4 AS score, 1704067200 + conv_id * 3600 + turn * 60 AS created, text AS body
  FROM conversations WHERE turn >= 1)"""
TP = """tp AS (SELECT 'c' || conv_id AS id, conv_id AS pid, role AS author, text AS selftext, substring(text, 1, 40) AS title FROM conversations WHERE turn = 0)"""
K = """k AS (SELECT (user_id % 10)::VARCHAR AS sub, event_type AS kind, 'f' || event_id AS file, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + trunc(value * 600)::BIGINT AS e, event_id % 3000 AS est,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 1700 END AS n_rows, CASE WHEN event_id % 5 <> 0 THEN floor(epoch(ts))::BIGINT + event_id % 300000 END AS fin FROM events),
w AS (SELECT DISTINCT sub, kind, (SELECT min(s) - 86400 FROM k) AS after, (SELECT max(s) + 86400 FROM k) AS before FROM k)"""
TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def h_sql(x: str) -> str:
    return f"('0x' || substr(sha1({x}), 1, 4))::BIGINT"


def prob_sql(q: str, state: str) -> str:
    return f"('0x' || substr(sha1('{q}' || chr(31) || {state}), 1, 8))::BIGINT / 4294967295.0"


def prob(q: str, state: Column) -> Column:
    return scoring.hash_probability(F.lit(q), state)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# ── search ───────────────────────────────────────────────────────────────────
SEARCHES = [("q1", "the AND of", "list_contains(t, 'the') AND list_contains(t, 'of')"), ("q2", "and to in", "list_contains(t, 'and') AND list_contains(t, 'to') AND list_contains(t, 'in')"), ("q3", "der OR la", "list_contains(t, 'der') OR list_contains(t, 'la')"), ("q4", "de NOT la", "list_contains(t, 'de') AND NOT list_contains(t, 'la')")]
HITS_SQL = f"tt AS (SELECT *, {TERMS.format('selftext')} AS t FROM p), h AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS query FROM tt WHERE {sql}" for n, _, sql in SEARCHES) + ")"


def post_postings(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.build_postings(A.posts(spark, d), "post", "id", ["selftext"])


def some_hits(spark: SparkSession, d: str) -> DataFrame:
    """id, query for all searches."""
    return fulltext.search_texts(A.posts(spark, d), "post", "id", ["selftext"], {name: q for name, q, _ in SEARCHES}).withColumnRenamed("doc", "id")


@query("flagship_search_ranked", f"""WITH {P}, {HITS_SQL}, m AS (SELECT id, string_agg(query, '|' ORDER BY query) AS matched, count(*) AS n FROM h GROUP BY id)
SELECT p.id, p.sub, p.score, m.n::INT AS n, m.matched FROM m JOIN p ON p.id = m.id WHERE p.created >= 1704067200 + 6000""")
def flagship(spark, d):
    posts = hits.post_filters(A.posts(spark, d), after=A.EPOCH + 6000)
    ranked = hits.matched_posts(some_hits(spark, d), posts.select("id", "sub", "score"))
    return ranked.select("id", "sub", "score", "n", F.array_join("matched_by", "|").alias("matched"))


def fts(name: str, q: str, sql: str, cols=("selftext",)):
    @query(name, f"WITH {P}, tt AS (SELECT id, {TERMS.format('title')} AS ti, {TERMS.format('selftext')} AS t FROM p) SELECT id FROM tt WHERE {sql}")
    def run(spark, d, q=q, cols=cols):
        postings = fulltext.build_postings(A.posts(spark, d), "post", "id", list(cols))
        return fulltext.search(postings, "post", list(cols), q).select(F.col("doc").alias("id"))


fts("fts_and", "the of and", "list_contains(t, 'the') AND list_contains(t, 'of') AND list_contains(t, 'and')")
fts("fts_or", "der OR la OR el", "list_contains(t, 'der') OR list_contains(t, 'la') OR list_contains(t, 'el')")
fts("fts_not", "de NOT (la OR le)", "list_contains(t, 'de') AND NOT (list_contains(t, 'la') OR list_contains(t, 'le'))")
fts("fts_phrase", '"of the"', "contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
fts("fts_phrase3", '"in the of" OR "of the in" OR "the in of" OR "to of the"', "list_bool_or(list_transform(['in the of', 'of the in', 'the in of', 'to of the'], lambda x: contains(' ' || array_to_string(t, ' ') || ' ', ' ' || x || ' ')))")
fts("fts_prefix", "thin*", "len(list_filter(t, lambda x: starts_with(x, 'thin'))) > 0")
fts("fts_near", "NEAR(this that, 4)", "len(list_filter(range(1, len(t) + 1), lambda i: t[i] IN ('this', 'that') AND (list_contains(t[i + 1:i + 5], CASE t[i] WHEN 'this' THEN 'that' ELSE 'this' END)))) > 0")
fts("fts_column", "title:the selftext:and", "list_contains(ti, 'the') AND list_contains(t, 'and')", ("title", "selftext"))


@query("fts_two_sided", f"""WITH {TP}, {C}, a AS (SELECT id FROM tp WHERE list_contains({TERMS.format('title')}, 'the') AND list_contains({TERMS.format('selftext')}, 'the')
  OR list_contains({TERMS.format('selftext')}, 'the') OR list_contains({TERMS.format('title')}, 'the')),
b AS (SELECT id, post_id FROM c WHERE list_contains({TERMS.format('body')}, 'the'))
SELECT id, bool_or(own) AS text_match, sum(via)::BIGINT AS n_comments FROM (SELECT id, true AS own, 0 AS via FROM a UNION ALL SELECT post_id, false, 1 FROM b) GROUP BY id""")
def fts_two_sided(spark, d):
    posts, comments = A.threads_posts(spark, d), A.comments(spark, d)
    postings = fulltext.build_postings(posts, "post", "id", ["title", "selftext"]).unionByName(fulltext.build_postings(comments, "comment", "id", ["body"]))
    own, via = fulltext.two_sided(postings, comments, "the")
    both = own.select("id", F.lit(True).alias("own"), F.lit(0).alias("via")).unionByName(via.select(F.col("post_id").alias("id"), F.lit(False).alias("own"), F.lit(1).alias("via")))
    return both.groupBy("id").agg(F.bool_or("own").alias("text_match"), F.sum("via").alias("n_comments"))


@query("tokenize_terms", f"WITH {P} SELECT id, len({TERMS.format('selftext')})::INT AS n_terms, len(list_distinct({TERMS.format('selftext')}))::INT AS n_distinct FROM p")
def tokenize_terms(spark, d):
    t = analysis.plain_terms(F.col("selftext"))
    return A.posts(spark, d).select("id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("tokenize_stemmed")
def tokenize_stemmed(spark, d):
    terms = A.posts(spark, d).select("id", analysis.porter_terms(F.col("selftext")).alias("t"))
    return terms.select("id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_stems"))


@query("postings_build", f"""WITH {P}, t AS (SELECT id, unnest({TERMS.format('selftext')}) AS term, generate_subscripts({TERMS.format('selftext')}, 1) - 1 AS pos FROM p)
SELECT id AS doc, term, count(*)::INT AS n, min(pos)::INT AS first, max(pos)::INT AS last FROM t GROUP BY ALL""")
def postings_build(spark, d):
    return post_postings(spark, d).select("doc", "term", F.size("positions").alias("n"), F.array_min("positions").alias("first"), F.array_max("positions").alias("last"))


@query("zero_hit_hint", f"""WITH {P}, v AS (SELECT DISTINCT unnest({TERMS.format('selftext')}) AS term FROM p),
q AS (SELECT unnest(['thinking', 'zzzz', 'therefor', 'the']) AS word), x AS (SELECT word, substring(word, 1, n) AS prefix FROM q, (SELECT unnest(range(1, 40)) AS n) WHERE n <= len(word) AND n > greatest(3, len(word) - 5) OR n = len(word)),
m AS (SELECT word, prefix, list_sort(list(DISTINCT term)) AS ts FROM x JOIN v ON starts_with(term, prefix) GROUP BY ALL),
b AS (SELECT word, arg_max(prefix, len(prefix)) AS prefix, arg_max(ts, len(prefix)) AS ts FROM m GROUP BY word)
SELECT q.word, b.prefix, array_to_string(b.ts[1:3], ',') AS terms FROM q LEFT JOIN b USING (word) WHERE b.prefix IS NULL OR b.prefix <> q.word""")
def zero_hit_hint(spark, d):
    vocabulary = A.posts(spark, d).select(F.explode(analysis.plain_terms(F.col("selftext"))).alias("term")).distinct()
    return fulltext.zero_hit_hints(vocabulary, "thinking* OR zzzz* OR therefor* the*").select("word", "prefix", F.array_join("terms", ",").alias("terms"))


@query("flair_search", f"WITH {P} SELECT id FROM p WHERE contains(lower(link_flair), 'rc1')")
def flair_search(spark, d):
    return hits.by_flair(A.posts(spark, d), ":x: RC1")


@query("hits_accumulate", f"WITH {P}, {HITS_SQL} SELECT DISTINCT id, query FROM h")
def hits_accumulate(spark, d):
    found = some_hits(spark, d)
    return hits.accumulate(found, found.where("query <> 'q1'"), ["id", "query"])


@query("hits_new", f"WITH {P}, {HITS_SQL}, f AS (SELECT id, min(query) AS query FROM h WHERE id NOT IN (SELECT id FROM h WHERE query = 'q4') GROUP BY id), q AS (SELECT DISTINCT query FROM h WHERE query <> 'q4') SELECT q.query, count(f.id) AS n_new FROM q LEFT JOIN f USING (query) GROUP BY q.query")
def hits_new(spark, d):
    found = some_hits(spark, d)
    return hits.new_by_query(found.where("query <> 'q4'").withColumn("ord", F.substring("query", 2, 1).cast("int")), found.where("query = 'q4'")).select("query", "n_new")


@query("query_totals", f"WITH {P}, {HITS_SQL} SELECT query, count(*) AS n FROM h GROUP BY query")
def query_totals(spark, d):
    return hits.query_totals(some_hits(spark, d))


@query("hits_distinct_posts", f"WITH {P}, {HITS_SQL} SELECT count(DISTINCT id) AS n FROM h")
def hits_distinct_posts(spark, d):
    return some_hits(spark, d).agg(F.count_distinct("id").alias("n"))


@query("sql_surface", f"WITH {P} SELECT id, score FROM p WHERE pid IN (SELECT pid FROM p WHERE score > 90 AND sub = 'en' AND title LIKE '%the%')")
def sql_surface(spark, d):
    posts = A.posts(spark, d)
    posts.createOrReplaceTempView("posts")
    found, _ = readonly.select_posts(spark, "SELECT pid FROM posts WHERE score > 90 AND sub = 'en' AND title LIKE '%the%'", posts)
    return found.select("id", "score")


def stored_index(spark, d) -> readonly.Index:
    """The index of posts and of comments, written and read back."""
    path = Stored(spark, "index").path
    both = fulltext.build_postings(A.posts(spark, d), "post", "id", ["title", "selftext"]).unionByName(fulltext.build_postings(A.comments(spark, d), "comment", "id", ["body"]))
    fulltext.write_postings(both, path)
    return readonly.Index(fulltext.read_postings(spark, path), {"posts": ("post", ("title", "selftext")), "comments": ("comment", ("body",))})


@query("sql_match", f"""WITH {P}, tt AS (SELECT *, {TERMS.format('title')} AS ti, {TERMS.format('selftext')} AS t FROM p),
m AS (SELECT * FROM tt WHERE list_contains(t, 'the') AND list_contains(t, 'of') AND NOT contains(' ' || array_to_string(ti, ' ') || ' ', ' in the ') AND score > 20)
SELECT sub, count(*) AS n, max(score) AS best, count(*) FILTER (contains(' ' || array_to_string(t, ' ') || ' ', ' to the ')) AS phrases FROM m GROUP BY sub""")
def sql_match(spark, d):
    A.posts(spark, d).createOrReplaceTempView("posts")
    return readonly.select(spark, """
        SELECT p.sub, count(*) AS n, max(p.score) AS best, count(x.id) AS phrases
        FROM posts p JOIN fts_posts('selftext:the AND selftext:of') m ON m.id = p.id
        LEFT JOIN fts_posts('selftext:"to the"') x ON x.id = p.id
        WHERE p.score > 20 AND p.id NOT IN (SELECT id FROM fts_posts('title:"in the"'))
        GROUP BY p.sub""", stored_index(spark, d))  # fmt: skip


@query("sql_match_sides", f"""WITH {TP}, {C}, {P} SELECT p.pid FROM p WHERE p.pid IN (SELECT tp.pid FROM tp JOIN c ON c.post_id = tp.id WHERE list_contains({TERMS.format('c.body')}, 'the')) AND list_contains({TERMS.format('p.selftext')}, 'and')""")
def sql_match_sides(spark, d):
    """What no query of one document says: a title or text with one word, and a comment with another."""
    posts = A.posts(spark, d)
    posts.createOrReplaceTempView("posts")
    A.comments(spark, d).createOrReplaceTempView("comments")
    return readonly.select_posts(spark, """
        SELECT p.pid FROM posts p JOIN fts_posts('selftext:and') m ON m.id = p.id
        WHERE concat('c', p.pid) IN (SELECT c.post_id FROM comments c JOIN fts_comments('the') f ON f.id = c.id)""", posts, index=stored_index(spark, d))[0].select("pid")  # fmt: skip


@query("fts_stored", f"WITH {P}, tt AS (SELECT id, {TERMS.format('selftext')} AS t FROM p) SELECT id FROM tt WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'thin'))) > 0 OR list_contains(t, 'der') AND NOT contains(' ' || array_to_string(t, ' ') || ' ', ' in der ')")
def fts_stored(spark, d):
    index = stored_index(spark, d)
    return index.search("posts", 'selftext:the selftext:thin* OR (selftext:der NOT selftext:"in der")')


@query("sql_ignored_rows", f"WITH {P} SELECT count(*) AS ignored FROM (SELECT pid + 100000000 * (pid % 3) AS k FROM p) WHERE k NOT IN (SELECT pid FROM p)")
def sql_ignored_rows(spark, d):
    posts = A.posts(spark, d)
    posts.createOrReplaceTempView("posts")
    return readonly.select_posts(spark, "SELECT pid + 100000000 * (pid % 3) FROM posts", posts)[1]


# ── text functions ───────────────────────────────────────────────────────────
BOT_SQL = "CASE n % 8 WHEN 0 THEN author || '_bot' WHEN 1 THEN author || '-Bot_2' WHEN 2 THEN 'FooBot7' WHEN 3 THEN 'robot' WHEN 4 THEN 'Bot-1' WHEN 5 THEN 'AutoModerator' WHEN 6 THEN 'bottle' ELSE author END"


def varied(spark, d) -> DataFrame:
    return A.comments(spark, d).withColumn("n", A.hashed(F.concat(F.lit("v"), F.col("id"))))


V = C + f", v AS (SELECT *, {h_sql(chr(39) + 'v' + chr(39) + ' || id')} AS n FROM c)"


@query("flag_bot_authors", f"""WITH {V}, x AS (SELECT id, {BOT_SQL} AS name FROM v)
SELECT id, name, lower(name) IN ('automoderator', 'sneakpeekbot', 'remindmebot', 'savevideo', 'stabbot', 'haikusbot') OR regexp_matches(name, '(?i)[_-]bot[_-]?[0-9]*$') OR regexp_matches(name, '[a-z0-9]Bot[0-9]*$') OR regexp_matches(name, '(?i)^bot[_-]?[0-9]*$') AS bot FROM x""")
def flag_bot_authors(spark, d):
    rows = varied(spark, d).select("id", F.expr(BOT_SQL).alias("name"))
    return rows.select("id", "name", text.is_bot(F.col("name")).alias("bot"))


ASK_SQL = "CASE n % 6 WHEN 0 THEN 'How ' || body WHEN 1 THEN body || '?' WHEN 2 THEN '  What a ' || body WHEN 3 THEN '- does it ' || body WHEN 4 THEN body || '? ' || repeat('x', 149) ELSE body END"


@query("flag_questions", f"""WITH {V}, x AS (SELECT id, trim({ASK_SQL}, ' ' || chr(10) || chr(9)) AS t FROM v)
SELECT id, contains(right(t, 150), '?') OR (regexp_matches(t, '(?i)^[^\\p{{L}}\\p{{N}}_]*(how|what|when|where|why|who|which|is|are|can|should|does|do|will|has|have)([^\\p{{L}}\\p{{N}}_]|$)')
  AND NOT regexp_matches(t, '(?i)^[^\\p{{L}}\\p{{N}}_]*(what an?|how (cute|cool|nice|pretty|beautiful|adorable|awesome|lovely|gorgeous))([^\\p{{L}}\\p{{N}}_]|$)')) AS asks FROM x""")
def flag_questions(spark, d):
    return varied(spark, d).select("id", text.is_question(F.expr(ASK_SQL)).alias("asks"))


REACT_SQL = "CASE n % 8 WHEN 0 THEN 'Thanks!' WHEN 1 THEN ' thank you so much :) ' WHEN 2 THEN 'HAHAHA' WHEN 3 THEN 'so cute!!' WHEN 4 THEN 'this is it' WHEN 5 THEN 'Love him' WHEN 6 THEN '[deleted]' ELSE body END"


@query("flag_reactions", f"""WITH {V}, x AS (SELECT id, {REACT_SQL} AS t FROM v)
SELECT id, t IN ('', '[deleted]', '[removed]') AS gone, regexp_matches(t, '(?i)^[^a-z0-9_]*(thanks?( (you|so much))?|thank you|ty|tysm|lol|lmao|haha[a-z0-9_]*|omg|aww+|so cute|cute|same|this|agreed?|nice|wow|love (it|him|her|this)|beautiful|gorgeous|adorable)[^a-z0-9_]*$')
  AND NOT regexp_matches(t, '[^\\x00-\\x7F]') AS reaction FROM x""")
def flag_reactions(spark, d):
    t = F.expr(REACT_SQL)
    return varied(spark, d).select("id", text.is_gone(t).alias("gone"), text.is_reaction(t).alias("reaction"))


IMG_SQL = "CASE n % 5 WHEN 0 THEN '[i.redd.it]' WHEN 1 THEN ' [imgur.com] ![img](abc) ' WHEN 2 THEN '![GIF](x|y)' WHEN 3 THEN '[i.redd.it] look' ELSE body END"


@query("flag_image_only", f"WITH {V} SELECT id, regexp_matches({IMG_SQL}, '(?i)^\\s*((\\[(i\\.redd\\.it|preview\\.redd\\.it|i\\.imgur\\.com|imgur\\.com|giphy\\.com|media\\.giphy\\.com|tenor\\.com)\\]|!\\[(img|gif)\\]\\([^)]*\\))\\s*)+$') AS image FROM v")
def flag_image_only(spark, d):
    return varied(spark, d).select("id", text.is_image_only(F.expr(IMG_SQL)).alias("image"))


URL_SQL = "CASE page_id % 7 WHEN 0 THEN 'https://v.redd.it/abc' WHEN 1 THEN url || '/a.JPG' WHEN 2 THEN url || '/a.png?w=1' WHEN 3 THEN 'https://i.redd.it/x' WHEN 4 THEN url || '.gifv' ELSE url END"


@query("media_kind", f"SELECT page_id, CASE WHEN contains(u, 'v.redd.it') THEN 'video' WHEN regexp_matches(u, '(?i)i\\.redd\\.it|reddit\\.com/gallery|imgur\\.com|\\.(jpe?g|png|gif|webp)(\\?|$)') THEN 'image' END AS kind FROM (SELECT page_id, {URL_SQL} AS u FROM pages)")
def media_kind(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.media_kind(F.expr(URL_SQL)).alias("kind"))


@query("flair_name", "SELECT doc_id, source AS flair, lower(source) AS flair_key FROM documents")
def flair_name(spark, d):
    raw = F.concat(F.lit(" :ab-c: "), F.col("source"), F.lit(" :x_1:"))
    return A.table(spark, d, "documents").select("doc_id", text.flair_name(raw).alias("flair"), text.flair_key(raw).alias("flair_key"))


@query("permalink", f"WITH {P} SELECT id, 'https://www.reddit.com/r/' || sub || '/comments/' || id || '/' AS link, strftime(to_timestamp(created) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM p")
def permalink(spark, d):
    from quarry.functions.dates import day

    return A.posts(spark, d).select("id", text.permalink(F.col("sub"), F.col("id")).alias("link"), day(F.col("created")).alias("day"))


SHORT_SQL = "CASE page_id % 6 WHEN 0 THEN 'https://github.com/a/b/?x=1.' WHEN 1 THEN 'https://old.reddit.com/r/ab/comments/x1y2/title/?s=1' WHEN 2 THEN 'https://www.youtube.com/watch?t=1&v=abc' ELSE url END"


@query("short_url", f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN '[github.com/a/b].' WHEN 1 THEN '[reddit.com/r/ab/comments/x1y2]' WHEN 2 THEN '[youtube.com/watch?v=abc]'
  ELSE '[' || lower(regexp_extract(url, '^https?://(?:www\\.)?([^/]+)', 1)) || ']' || regexp_extract(url, '^https?://[^/]+.*?([.,;:!?]*)$', 1) END AS short FROM pages""")
def short_url(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.short_url(F.expr(SHORT_SQL)).alias("short"))


@query("clean_text", f"""WITH {V} SELECT id, trim(CASE n % 3 WHEN 0 THEN 'see the label [x.example.com] ok, ' || body WHEN 1 THEN '[y.example.org]. ' || body ELSE body END, ' ' || chr(10)) AS cleaned FROM v""")
def clean_text(spark, d):
    t = F.expr("CASE n % 3 WHEN 0 THEN ' see [the label](http://www.X.example.com/p?q=(1)) ok, ' || body WHEN 1 THEN '[https://y.example.org/z](https://y.example.org/z). ' || body ELSE body END")
    return varied(spark, d).select("id", text.clean(t).alias("cleaned"))


MARK_SQL = "CASE n % 4 WHEN 0 THEN '# ' || body WHEN 1 THEN 'a' || chr(13) || chr(10) || ' > b' || chr(10) || '---' || chr(10) || body WHEN 2 THEN '--- x' ELSE body END"


@query("escape_markdown", f"WITH {V} SELECT id, array_to_string(list_transform(string_split(replace({MARK_SQL}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\\s*(#|>|---\\s*$)') THEN '\\' || x ELSE x END), chr(10)) AS escaped FROM v")
def escape_markdown(spark, d):
    return varied(spark, d).select("id", text.escape_markdown(F.expr(MARK_SQL)).alias("escaped"))


@query("token_estimate", "SELECT doc_id, floor(1000 * (length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 3.7 + length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))))::BIGINT AS milli_tokens FROM documents")
def token_estimate(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.floor(text.estimated_tokens(F.col("text")) * 1000).alias("milli_tokens"))


@query("token_cap", """WITH x AS (SELECT doc_id, text, unnest(range(1, least(length(text), 400) + 1)) AS i FROM documents), y AS (SELECT doc_id, i, length(regexp_replace(substring(text, 1, i), '[^\\x00-\\x7F]', '', 'g')) AS a FROM x)
SELECT d.doc_id, substring(d.text, 1, coalesce(max(y.i) FILTER (y.a / 3.7 + y.i - y.a <= 50.05), 0)) AS capped FROM documents d LEFT JOIN y USING (doc_id) GROUP BY d.doc_id, d.text""")
def token_cap(spark, d):
    return A.table(spark, d, "documents").select("doc_id", text.capped(F.col("text"), F.lit(50.05)).alias("capped"))


@query("hit_window", """WITH x AS (SELECT doc_id, text, coalesce(nullif(strpos(lower(text), lower(regexp_extract(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(there|with|ende)', 1))), 0), 0) AS dummy, regexp_extract(text, '(?is)^(.*?(?:^|[^\\p{L}\\p{N}_]))(?:there|with|ende)', 1) AS pre, regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(there|with|ende)') AS m FROM documents),
y AS (SELECT doc_id, text, greatest(CASE WHEN m THEN length(pre) ELSE 0 END - 133, 0) AS s FROM x)
SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substring(text, s + 1, 400) || CASE WHEN s + 400 < length(text) THEN '…' ELSE '' END AS shown FROM y""")
def hit_window(spark, d):
    return A.table(spark, d, "documents").select("doc_id", text.hit_window(F.col("text"), text.query_stems(["therefor AND with", "title:endetest"])).alias("shown"))


# ── spans ────────────────────────────────────────────────────────────────────
KEYS = ["sub", "kind"]
ISLANDS = """SELECT sub, kind, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s > r + {1} OR r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY sub, kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i
  FROM (SELECT *, max(e) OVER (PARTITION BY sub, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {0})) GROUP BY sub, kind, i"""
GAPS = """SELECT * FROM (SELECT sub, kind, lag(e) OVER (PARTITION BY sub, kind ORDER BY s, e) AS s, s AS e FROM (
  SELECT m.sub, m.kind, greatest(m.s, w.after) AS s, least(m.e, w.before) AS e FROM {0} m JOIN w USING (sub, kind) WHERE m.e > w.after AND m.s < w.before
  UNION ALL SELECT sub, kind, after, after FROM w UNION ALL SELECT sub, kind, before, before FROM w)) WHERE e > s"""


@query("day_counts", "SELECT event_type AS kind, (floor(epoch(ts))::BIGINT // 86400) * 86400 AS day, count(*) AS n FROM events GROUP BY ALL")
def day_counts(spark, d):
    return spans.day_counts(A.table(spark, d, "events").select(F.col("event_type").alias("kind"), A.event_seconds().alias("created")), ["kind"])


@query("span_merge", f"WITH {K}, i AS ({ISLANDS.format('k', 0)}) SELECT sub, kind, s AS \"start\", e AS \"end\" FROM i")
def span_merge(spark, d):
    return spans.islands(A.chunks(spark, d).select(*KEYS, "start", "end"), KEYS)


@query("span_gaps", f"WITH {K}, kk AS (SELECT * FROM k WHERE e > s), i AS ({ISLANDS.format('kk', 0)}), g AS ({GAPS.format('i')}) SELECT sub, kind, s AS \"start\", e AS \"end\" FROM g")
def span_gaps(spark, d):
    return spans.gaps(A.chunks(spark, d).select(*KEYS, "start", "end"), A.windows(spark, d), KEYS)


FETCH = f"t AS (SELECT sub, kind, s, CASE WHEN fin IS NULL THEN e ELSE least(e, fin - 172800) END AS e FROM k), tk AS (SELECT * FROM t WHERE e > s), ti AS ({ISLANDS.format('tk', 0)}), tg AS ({GAPS.format('ti')}), f AS ({ISLANDS.format('tg', 86399)})"


@query("span_to_fetch", f"WITH {K}, {FETCH} SELECT sub, kind, s AS \"start\", e AS \"end\" FROM f")
def span_to_fetch(spark, d):
    return spans.to_fetch(A.chunks(spark, d), A.windows(spark, d), KEYS)


def key_days(spark, d) -> DataFrame:
    return spans.day_counts(A.chunks(spark, d).select(*KEYS, F.col("start").alias("created")), KEYS)


DAYS = "dd AS (SELECT sub, kind, (s // 86400) * 86400 AS day, count(*) AS n FROM k GROUP BY ALL)"


@query("uncached_items", f"WITH {K}, {FETCH}, {DAYS} SELECT sub, kind, sum(n)::BIGINT AS n FROM dd WHERE EXISTS (SELECT 1 FROM f WHERE f.sub = dd.sub AND f.kind = dd.kind AND dd.day < f.e AND dd.day + 86400 > f.s) GROUP BY ALL")
def uncached_items(spark, d):
    return spans.uncached_items(key_days(spark, d), spans.to_fetch(A.chunks(spark, d), A.windows(spark, d), KEYS), KEYS)


@query("chunk_plan", f"""WITH RECURSIVE {K}, {DAYS}, o AS (SELECT *, row_number() OVER (PARTITION BY sub, kind ORDER BY day) AS r FROM dd),
z AS (SELECT sub, kind, 0::BIGINT AS r, after AS st, 0::BIGINT AS acc, NULL::BIGINT AS cs, NULL::BIGINT AS ce, NULL::BIGINT AS cn FROM w
  UNION ALL SELECT z.sub, z.kind, o.r, CASE WHEN z.acc + o.n >= 30 AND o.day + 86400 < w.before THEN o.day + 86400 ELSE z.st END, CASE WHEN z.acc + o.n >= 30 AND o.day + 86400 < w.before THEN 0 ELSE z.acc + o.n END,
    CASE WHEN z.acc + o.n >= 30 AND o.day + 86400 < w.before THEN z.st END, CASE WHEN z.acc + o.n >= 30 AND o.day + 86400 < w.before THEN o.day + 86400 END, CASE WHEN z.acc + o.n >= 30 AND o.day + 86400 < w.before THEN z.acc + o.n END
  FROM z JOIN o ON o.sub = z.sub AND o.kind = z.kind AND o.r = z.r + 1 JOIN w ON w.sub = z.sub AND w.kind = z.kind)
SELECT sub, kind, cs AS "start", ce AS "end", cn AS est FROM z WHERE cs IS NOT NULL
UNION ALL SELECT z.sub, z.kind, z.st, w.before, z.acc FROM z JOIN w USING (sub, kind) WHERE z.r = (SELECT coalesce(max(r), 0) FROM o WHERE o.sub = z.sub AND o.kind = z.kind)""")
def chunk_plan(spark, d):
    return spans.plan_chunks(key_days(spark, d), A.windows(spark, d), KEYS, items=30)


@query("chunk_supersede")
def chunk_supersede(spark, d):
    return spans.superseded(A.chunks(spark, d), KEYS)


@query("coverage_holes", f"""WITH {K}, dn AS (SELECT sub, kind, s, e FROM k WHERE fin IS NOT NULL), kk AS (SELECT * FROM dn WHERE e > s), i AS ({ISLANDS.format('kk', 0)}),
w2 AS (SELECT w.sub, w.kind, w.after, max(dn.e) AS before FROM w JOIN dn USING (sub, kind) GROUP BY ALL), g AS ({GAPS.format('i').replace('JOIN w ', 'JOIN w2 w ').replace('FROM w', 'FROM w2')})
SELECT sub, kind, s AS "start", e AS "end" FROM g""")
def coverage_holes(spark, d):
    return spans.holes(A.chunks(spark, d), A.windows(spark, d), KEYS)


@query("fetch_order", f"WITH {K} SELECT file, est FROM k WHERE fin IS NULL ORDER BY est DESC, s, file")
def fetch_order(spark, d):
    return spans.fetch_order(A.chunks(spark, d)).select("file", "est")


@query("fetch_order_all", f"WITH {K} SELECT file, est FROM k WHERE fin IS NULL")
def fetch_order_all(spark, d):
    return spans.fetch_order(A.chunks(spark, d)).select("file", "est")


@query("short_chunks", f"WITH {K} SELECT file, est, n_rows AS rows FROM k WHERE n_rows < 0.7 * est AND est - n_rows >= 500")
def short_chunks(spark, d):
    return spans.short_chunks(A.chunks(spark, d)).select("file", "est", "rows")


@query("cache_listing", f"WITH {K}, kk AS (SELECT * FROM k WHERE fin IS NOT NULL), i AS ({ISLANDS.format('kk', 0)}), r AS (SELECT sub, kind, sum(n_rows)::BIGINT AS rows FROM kk GROUP BY ALL) SELECT i.sub, i.kind, i.s AS \"start\", i.e AS \"end\", r.rows FROM i JOIN r USING (sub, kind)")
def cache_listing(spark, d):
    return chunk_source.cache_listing(A.chunks(spark, d))


@query("newest_wins_dedupe", "SELECT user_id, event_type, event_id, floor(epoch(ts))::BIGINT AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def newest_wins_dedupe(spark, d):
    return chunk_source.newest_wins(A.table(spark, d, "events").select("user_id", "event_type", "event_id", A.event_seconds().alias("at")), ["user_id", "event_type"], ["at", "event_id"])


# ── joins of posts, comments and hits ────────────────────────────────────────
@query("comments_semi_posts", f"WITH {C}, {TP} SELECT id FROM c WHERE post_id IN (SELECT id FROM tp WHERE pid % 3 = 0)")
def comments_semi_posts(spark, d):
    posts = A.threads_posts(spark, d).where("pid % 3 = 0").select(F.col("id").alias("post_id"))
    return A.comments(spark, d).join(posts, "post_id", "left_semi").select("id")


@query("comment_hit_flag", f"WITH {C} SELECT id, list_contains({TERMS.format('body')}, 'the') AS hit FROM c")
def comment_hit_flag(spark, d):
    c = A.comments(spark, d)
    found = fulltext.search(fulltext.build_postings(c, "comment", "id", ["body"]), "comment", ["body"], "the").select(F.col("doc").alias("id"), F.lit(True).alias("h"))
    return c.join(found, "id", "left").select("id", F.col("h").isNotNull().alias("hit"))


def exclusions(spark) -> DataFrame:
    empty = spark.createDataFrame([], "pattern string, sub string")
    e = hits.exclude_flair(hits.exclude_flair(hits.exclude_flair(hits.exclude_flair(empty, "SRC1"), "src2", "EN"), "src3"), "Src1")
    return hits.include_flair(e, "SRC3")


@query("flair_exclusion_anti", f"WITH {P} SELECT id FROM p WHERE NOT (lower(link_flair) = 'src1' OR (lower(link_flair) = 'src2' AND sub = 'en'))")
def flair_exclusion_anti(spark, d):
    return hits.without_excluded(A.posts(spark, d), exclusions(spark)).select("id")


@query("flair_exclusion_count", f"WITH {P} SELECT count(*) AS n FROM p WHERE lower(link_flair) = 'src1' OR (lower(link_flair) = 'src2' AND sub = 'en')")
def flair_exclusion_count(spark, d):
    return hits.without_excluded(A.posts(spark, d), exclusions(spark), "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("hit_carry_over", f"WITH {P}, {HITS_SQL}, n AS (SELECT id FROM p WHERE pid % 4 <> 0) SELECT id, query, false AS lost FROM h WHERE id IN (SELECT id FROM n) UNION ALL SELECT DISTINCT id, NULL, true FROM h WHERE id NOT IN (SELECT id FROM n)")
def hit_carry_over(spark, d):
    kept, lost = hits.carry_over(some_hits(spark, d), A.posts(spark, d).where("pid % 4 <> 0"))
    return kept.select("id", "query", F.lit(False).alias("lost")).unionByName(lost.select("id", F.lit(None).cast("string").alias("query"), F.lit(True).alias("lost")))


@query("find_post", f"WITH {P} SELECT id, pid FROM p WHERE pid = 17 UNION ALL SELECT id, pid FROM p WHERE id = 'd20'")
def find_post(spark, d):
    posts = A.posts(spark, d).select("id", "pid")
    return hits.find_post(posts, "P17").unionByName(hits.find_post(posts, " t3_d20"))


# ── forests ──────────────────────────────────────────────────────────────────
ASKS = f"{TP}, {C}, qa AS (SELECT id, contains(right(trim(selftext), 150), '?') OR regexp_matches(selftext, '(?i)^[^a-z0-9_]*(how|what|when|where|why|who|which|is|are|can|should|does|do|will|has|have)([^\\p{{L}}\\p{{N}}_]|$)') AND NOT regexp_matches(selftext, '(?i)^[^a-z0-9_]*(what an?|how (cute|cool|nice|pretty|beautiful|adorable|awesome|lovely|gorgeous))([^\\p{{L}}\\p{{N}}_]|$)') AS asks FROM (SELECT id, selftext FROM tp UNION ALL SELECT id, body FROM c))"
PRUNE = f"""{ASKS}, pr AS (SELECT c.*, c.score < 0 OR c.body IN ('', '[deleted]', '[removed]') OR (length(c.body) < 200 AND c.score <= 2 AND NOT (coalesce(q.asks, false) AND NOT contains(c.body, '?'))) AS prunable
  FROM c LEFT JOIN qa q ON q.id = CASE WHEN c.parent IS NULL THEN c.post_id ELSE c.parent END),
up AS (SELECT post_id, id, parent FROM pr WHERE NOT prunable UNION SELECT pr.post_id, pr.id, pr.parent FROM up JOIN pr ON pr.post_id = up.post_id AND pr.id = up.parent)"""


def post_asks(spark, d) -> DataFrame:
    return A.threads_posts(spark, d).select(F.col("id").alias("post_id"), text.is_question(F.col("selftext")).alias("asks"))


@query("prune_forest", f"WITH RECURSIVE {PRUNE} SELECT DISTINCT post_id, id FROM up")
def prune_forest(spark, d):
    return forest.prune(A.comments(spark, d), post_asks(spark, d), short_chars=200).select("post_id", "id")


@query("post_survival", f"WITH RECURSIVE {PRUNE} SELECT id FROM tp WHERE pid % 2 = 0 OR id IN (SELECT post_id FROM up)")
def post_survival(spark, d):
    kept = forest.prune(A.comments(spark, d), post_asks(spark, d), short_chars=200)
    posts = A.threads_posts(spark, d).withColumn("selftext", F.when(F.col("pid") % 2 == 0, F.col("selftext")).otherwise(""))
    return forest.surviving_posts(posts, kept).select("id")


ORDER = f"""{C}, rk AS (SELECT *, row_number() OVER (PARTITION BY post_id, up ORDER BY created, id) AS r FROM (SELECT c.*, x.id AS up FROM c LEFT JOIN c x ON x.post_id = c.post_id AND x.id = c.parent)),
dn AS (SELECT post_id, id, id AS root, 0 AS depth, [r] AS path FROM rk WHERE up IS NULL UNION ALL SELECT k.post_id, k.id, d.root, d.depth + 1, list_append(d.path, k.r) FROM dn d JOIN rk k ON k.post_id = d.post_id AND k.up = d.id),
od AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY path) AS place FROM dn)"""


@query("thread_preorder", f"WITH RECURSIVE {ORDER} SELECT post_id, id, root, depth::INT AS depth, place::INT AS place FROM od")
def thread_preorder(spark, d):
    return forest.reading_order(A.comments(spark, d)).select("post_id", "id", "root", "depth", "place")


@query("render_thread", f"""WITH RECURSIVE {ORDER}, ln AS (SELECT od.*, repeat('> ', least(depth + 1, 6)) AS q, c.author, c.score, c.body FROM od JOIN c USING (post_id, id))
SELECT post_id, root, string_agg(q || '**u/' || author || '** (' || score || ') · c/' || id || chr(10) || array_to_string(list_transform(string_split(body, chr(10)), lambda x: q || CASE WHEN regexp_matches(x, '^\\s*(#|>|---\\s*$)') THEN '\\' || x ELSE x END), chr(10)) || chr(10) || rtrim(q), chr(10) ORDER BY place) AS text FROM ln GROUP BY ALL""")
def render_thread(spark, d):
    return forest.render_threads(forest.reading_order(A.comments(spark, d)))


@query("thread_chars", f"WITH RECURSIVE {ORDER} SELECT post_id, root, sum(length(c.body))::BIGINT AS chars FROM od JOIN c USING (post_id, id) GROUP BY ALL")
def thread_chars(spark, d):
    return forest.thread_chars(forest.reading_order(A.comments(spark, d)))


# ── statistics of flairs and subs ────────────────────────────────────────────
@query("flair_stats", f"WITH {P}, {HITS_SQL} SELECT sub, link_flair AS flair, count(*) AS n_posts, count(*) FILTER (id IN (SELECT id FROM h)) AS n_hits, count(*) FILTER (pid % 5 = 0) AS n_kept FROM p GROUP BY ALL")
def flair_stats(spark, d):
    posts = A.posts(spark, d)
    return hits.flair_stats(posts, some_hits(spark, d), posts.where("pid % 5 = 0"))


@query("flair_tail", f"WITH {P}, s AS (SELECT sub, link_flair AS flair, count(*) AS n_posts FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY n_posts DESC, flair) AS k FROM s) SELECT sub, count(*) AS n_more, sum(n_posts)::BIGINT AS n_posts FROM r WHERE k > 12 GROUP BY sub")
def flair_tail(spark, d):
    posts = A.posts(spark, d)
    return hits.flair_tail(hits.flair_stats(posts, posts.limit(0), posts.limit(0)), 12)


@query("flair_newest_titles", f"WITH {P} SELECT sub, link_flair AS flair, r::INT AS rank, substring(title, 1, 90) AS title FROM (SELECT *, row_number() OVER (PARTITION BY sub, link_flair ORDER BY created DESC, id) AS r FROM p) WHERE r <= 3")
def flair_newest_titles(spark, d):
    return hits.newest_titles(A.posts(spark, d), 3)


@query("scope", f"WITH {P} SELECT sub, min(created) AS first, max(created) AS last, count(*) AS n FROM p GROUP BY sub")
def scope(spark, d):
    return hits.scope(A.posts(spark, d))


@query("peek_topn", f"WITH {P}, {HITS_SQL} SELECT id, score, substring(title, 1, 90) AS title FROM p WHERE id IN (SELECT id FROM h WHERE query = 'q1') ORDER BY score DESC, id LIMIT 10")
def peek_topn(spark, d):
    return hits.peek(A.posts(spark, d), some_hits(spark, d).where("query = 'q1'"), 10)


# ── selection ────────────────────────────────────────────────────────────────
def matched(spark, d) -> DataFrame:
    rows = hits.matched_posts(some_hits(spark, d), A.posts(spark, d))
    return rows.withColumn("text_match", F.col("pid") % 3 != 0)


@query("round_robin_pick")
def round_robin_pick(spark, d):
    return sampling.round_robin(matched(spark, d), 60)


@query("stratified_sample", f"""WITH {P}, {HITS_SQL}, m AS (SELECT DISTINCT p.id, pid % 3 <> 0 AS tm, pid FROM p JOIN h USING (id)),
s AS (SELECT id, tm, row_number() OVER (PARTITION BY tm ORDER BY sha1(id), id) AS r FROM m), a AS (SELECT id, CASE WHEN tm THEN 'hit in the post' ELSE 'found only through comments' END AS label FROM s WHERE r <= 10),
b AS (SELECT id, 'borderline last run' AS label FROM m WHERE pid % 10 = 0 AND id NOT IN (SELECT id FROM a) ORDER BY sha1(id), id LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b""")
def stratified_sample(spark, d):
    return sampling.stratified(matched(spark, d), 30, A.posts(spark, d).where("pid % 10 = 0").select("id"))


@query("recall_audit", f"WITH {P}, {HITS_SQL}, x AS (SELECT id FROM tt WHERE list_contains(t, 'is') AND id NOT IN (SELECT id FROM h) ORDER BY sha1(id), id LIMIT 40) SELECT id FROM x")
def recall_audit(spark, d):
    matching = fulltext.search(post_postings(spark, d), "post", ["selftext"], "is").select(F.col("doc").alias("id"))
    return hits.missed(matching, some_hits(spark, d)).limit(40)


@query("recall_estimate", f"WITH {P} SELECT round(rate, 6) AS rate, round(rate * 123, 6) AS expected FROM (SELECT count(*) FILTER (pid % 7 = 0) / count(*) AS rate FROM p)")
def recall_estimate(spark, d):
    r = verdicts.recall_estimate(A.posts(spark, d).withColumn("kept", F.col("pid") % 7 == 0), 123)
    return r.select(F.round("rate", 6).alias("rate"), F.round("expected", 6).alias("expected"))


@query("budget_takewhile", f"""WITH {P}, e AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, length(selftext) AS ch, length(title) AS lc, length(id) AS ic FROM p),
u AS (SELECT *, 500 + coalesce(sum(ch // 4) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, coalesce(sum(lc) OVER (ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND 100 FOLLOWING), 0) + coalesce(sum(ic) OVER (ORDER BY rank ROWS BETWEEN 101 FOLLOWING AND 1100 FOLLOWING), 0) AS li FROM e)
SELECT id, rank::INT AS rank, rank < coalesce((SELECT min(rank) FROM u WHERE rank > 1 AND used + (ch + li) // 4 > 20000), 1000000000) AS shown FROM u""")
def budget_takewhile(spark, d):
    rows = A.posts(spark, d).select("id", "score", F.length("selftext").alias("chars"), F.length("title").alias("line_chars"), F.length("id").alias("id_chars"))
    return sampling.budget(rows, [F.desc("score"), F.col("id")], 500, 20000).select("id", F.col("rank").cast("int").alias("rank"), "shown")


# ── model verdicts ───────────────────────────────────────────────────────────
QS = verdicts.Questions(q=("q one", "q two"), must="must", nots=("not one",))
JUDGED = f"""{P}, jp AS (SELECT *, CASE WHEN {h_sql("'f' || id")} % 10 = 0 THEN NULL ELSE [{', '.join(prob_sql(q, 'id') for q in QS.all)}] END AS pr FROM p),
jv AS (SELECT *, CASE WHEN pr IS NULL THEN NULL WHEN pr[4] >= 0.7 THEN 'not' WHEN pr[1] < 0.35 THEN 'must' END AS excluded, greatest(pr[2], pr[3]) AS vscore FROM jp)"""


def judged(spark, d) -> DataFrame:
    """Posts with the stand-in model's probabilities; it fails on every tenth."""
    failed = A.hashed(F.concat(F.lit("f"), F.col("id"))) % 10 == 0
    rows = A.posts(spark, d).withColumn("probs", F.when(~failed, scoring.hash_probabilities(list(QS.all), F.col("id"))))
    return scoring.judge(rows, QS).withColumn("post_id", F.col("id")).withColumn("judged", F.lit(True))


def milli(c: str) -> Column:
    return F.floor(F.col(c) * 10000).cast("long")


@query("verdicts", f"WITH {JUDGED} SELECT id, floor(vscore * 10000)::BIGINT AS score, excluded, CASE WHEN pr IS NOT NULL THEN excluded IS NULL AND vscore >= 0.5 END AS keep FROM jv")
def post_verdicts(spark, d):
    return judged(spark, d).select("id", milli("verdict.score").alias("score"), "verdict.excluded", "verdict.keep")


THREADS = f"""{JUDGED}, th AS (SELECT 'd' || (conv_id * 8 + turn) % (SELECT count(*) FROM documents) AS post_id, 'c' || conv_id || '_' || turn AS root, length(text) AS chars, {h_sql("'h' || conv_id || '_' || turn")} % 3 = 0 AS has_hit FROM conversations),
ts AS (SELECT th.*, CASE WHEN pr IS NULL OR (excluded IS NULL AND vscore >= 0.5) THEN 'a' WHEN vscore >= 0.2 THEN 'b' WHEN has_hit THEN 'c' END AS st FROM th JOIN jv ON jv.id = th.post_id WHERE excluded IS NULL AND chars >= 25),
tv AS (SELECT *, CASE WHEN {h_sql("'g' || root")} % 12 = 0 THEN NULL ELSE [{', '.join(prob_sql(q, 'root') for q in QS.q)}] END AS q FROM ts WHERE st IS NOT NULL)"""


def some_threads(spark, d) -> DataFrame:
    n = A.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    c = A.table(spark, d, "conversations")
    key = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(F.concat(F.lit("d"), ((F.col("conv_id") * 8 + F.col("turn")) % n).cast("string")).alias("post_id"), F.concat(F.lit("c"), key).alias("root"), F.length("text").alias("chars"), (A.hashed(F.concat(F.lit("h"), key)) % 3 == 0).alias("has_hit"))


def judged_threads(spark, d, posts: DataFrame) -> DataFrame:
    rows = verdicts.thread_sets(posts, some_threads(spark, d)).join(posts.select("post_id", F.col("verdict").alias("post_verdict")), "post_id")
    q = F.when(A.hashed(F.concat(F.lit("g"), F.col("root"))) % 12 != 0, scoring.hash_probabilities(list(QS.q), F.col("root")))
    return rows.withColumn("verdict", verdicts.thread_verdict(q, F.col("post_verdict"), QS)).drop("post_verdict")


@query("thread_sets", f"WITH {THREADS} SELECT post_id, root, st AS \"set\" FROM ts WHERE st IS NOT NULL")
def thread_sets(spark, d):
    return verdicts.thread_sets(judged(spark, d), some_threads(spark, d)).select("post_id", "root", "set")


INCLUDED = f"""{THREADS}, kt AS (SELECT post_id, count(*) AS nk, count(q) AS nr, max(q[1]) AS q1, max(q[2]) AS q2 FROM tv WHERE q IS NULL OR greatest(q[1], q[2]) >= 0.5 GROUP BY post_id),
inc AS (SELECT jv.*, coalesce(nk, 0) AS nk, coalesce(nr, 0) AS nr, CASE WHEN pr IS NULL THEN 'unjudged' WHEN excluded IS NOT NULL THEN NULL WHEN vscore >= 0.5 THEN 'post' WHEN nr > 0 THEN 'thread' WHEN nk > 0 THEN 'unjudged' END AS included,
  greatest(pr[2], q1) AS f1, greatest(pr[3], q2) AS f2 FROM jv LEFT JOIN kt ON kt.post_id = jv.id),
kp AS (SELECT *, nr > 0 OR greatest(f1, f2) >= 0.7 AS strong FROM inc WHERE included IN ('post', 'thread') AND NOT (nk = 0 AND length(selftext) < 300))"""


def all_decided(spark, d) -> DataFrame:
    posts = judged(spark, d)
    return verdicts.decided(posts, judged_threads(spark, d, posts).select("post_id", "verdict"))


@query("inclusion", f"WITH {INCLUDED} SELECT id, included, nk::BIGINT AS n_kept, nr::BIGINT AS n_kept_real FROM inc")
def inclusion(spark, d):
    return all_decided(spark, d).select("id", "included", "n_kept", "n_kept_real")


@query("facets", f"WITH {INCLUDED} SELECT id, floor(f1 * 10000)::BIGINT AS f1, floor(f2 * 10000)::BIGINT AS f2, floor(coalesce(greatest(f1, f2), -1) * 10000)::BIGINT AS best FROM inc")
def facets(spark, d):
    f = lambda k: F.floor(F.element_at("facets", k) * 10000).cast("long")
    return all_decided(spark, d).select("id", f(1).alias("f1"), f(2).alias("f2"), milli("facet_score").alias("best"))


@query("thread_combine", f"""WITH {C}, pp AS (SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY created, id) AS part, CASE WHEN {h_sql("'x' || id")} % 9 = 0 THEN NULL ELSE [{prob_sql('q one', 'id')} * 0.7, {prob_sql('q two', 'id')} * 0.7] END AS pr FROM c),
b AS (SELECT *, max(greatest(pr[1], pr[2])) OVER (PARTITION BY post_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pp)
SELECT post_id, CASE WHEN bool_or(pr IS NULL) THEN NULL ELSE floor(max(pr[1]) * 10000)::BIGINT END AS q1, CASE WHEN bool_or(pr IS NULL) THEN NULL ELSE floor(max(pr[2]) * 10000)::BIGINT END AS q2 FROM b WHERE coalesce(before < 0.5, true) GROUP BY post_id""")
def thread_combine(spark, d):
    part = F.row_number().over(Window.partitionBy("post_id").orderBy("created", "id"))
    p = F.when(A.hashed(F.concat(F.lit("x"), F.col("id"))) % 9 != 0, F.transform(scoring.hash_probabilities(list(QS.q), F.col("id")), lambda x: x * 0.7))
    parts = A.comments(spark, d).select("post_id", part.alias("part"), p.alias("probs"))
    f = lambda k: F.floor(F.element_at("q", k) * 10000).cast("long")
    return verdicts.combine_parts(parts, ["post_id"], 0.5).select("post_id", f(1).alias("q1"), f(2).alias("q2"))


@query("borderline", f"WITH {JUDGED} SELECT id FROM jv WHERE pr[2] BETWEEN 0.3 AND 0.7 OR pr[3] BETWEEN 0.3 AND 0.7")
def borderline(spark, d):
    return verdicts.borderline(judged(spark, d))


GATE = "(SELECT greatest(count(*) // 125, 2) FROM documents)"


@query("flair_gate", f"""WITH {JUDGED}, g AS (SELECT id, sub, link_flair AS flair, coalesce(excluded IS NULL AND vscore >= 0.93, false) AS kept, row_number() OVER (PARTITION BY sub, link_flair ORDER BY sha1(id), id) AS r, count(*) OVER (PARTITION BY sub, link_flair) AS n FROM jv),
bad AS (SELECT sub, flair FROM g WHERE n > 8 AND r <= 7 GROUP BY ALL HAVING NOT bool_or(kept)) SELECT g.id, g.sub, g.flair FROM g JOIN bad USING (sub, flair) WHERE g.r > 7 AND g.n > 8""")
def flair_gate(spark, d):
    kept = F.coalesce(F.col("verdict.excluded").isNull() & (F.col("verdict.score") >= 0.93), F.lit(False))
    return verdicts.flair_gate_skips(judged(spark, d).withColumn("kept", kept), min_posts=8, samples=(3, 4))


@query("question_counts", f"WITH {INCLUDED} SELECT 1 AS question, count(*) FILTER (f1 >= 0.5) AS n_pass, count(*) FILTER (f1 >= 0.5 AND NOT f2 >= 0.5) AS n_only FROM kp UNION ALL SELECT 2, count(*) FILTER (f2 >= 0.5), count(*) FILTER (f2 >= 0.5 AND NOT f1 >= 0.5) FROM kp")
def question_counts(spark, d):
    return verdicts.question_counts(verdicts.kept_posts(all_decided(spark, d)), QS)


@query("exclusion_counts", f"WITH {JUDGED} SELECT count(*) FILTER (excluded = 'must') AS n_must, count(*) FILTER (excluded = 'not') AS n_not, count(*) FILTER (pr[4] >= 0.7) AS not_1 FROM jv")
def exclusion_counts(spark, d):
    return verdicts.exclusion_counts(judged(spark, d), QS)


@query("set_counts", f"WITH {THREADS} SELECT st AS \"set\", count(*) AS judged, count(*) FILTER (q IS NULL OR greatest(q[1], q[2]) >= 0.5) AS kept FROM tv GROUP BY st")
def set_counts(spark, d):
    return verdicts.set_counts(judged_threads(spark, d, judged(spark, d)))


@query("query_table", f"""WITH {INCLUDED}, {HITS_SQL}, hn AS (SELECT id, count(*) AS n FROM h GROUP BY id)
SELECT query, count(*) AS hits, count(*) FILTER (p.pid % 2 = 0) AS judged, count(k.id) AS kept, count(k.id) FILTER (hn.n = 1) AS only, count(k.id) FILTER (k.strong AND p.pid % 3 = 0) AS new_strong FROM h JOIN p USING (id) JOIN hn USING (id) LEFT JOIN kp k ON k.id = h.id GROUP BY query""")
def query_table(spark, d):
    kept = verdicts.kept_posts(all_decided(spark, d))
    return verdicts.query_table(some_hits(spark, d), A.posts(spark, d).where("pid % 2 = 0"), kept, kept.where("strong and pid % 3 = 0"))


@query("score_histogram", f"WITH {JUDGED}, n AS (SELECT least(floor(vscore * 10)::INT, 9) AS bin, count(*) AS n FROM jv WHERE vscore IS NOT NULL GROUP BY 1) SELECT r::INT AS bin, coalesce(n.n, 0) AS n FROM (SELECT unnest(range(10)) AS r) LEFT JOIN n ON n.bin = r")
def score_histogram(spark, d):
    return verdicts.histogram(judged(spark, d).select(F.col("verdict.score").alias("score")), "score")


@query("flair_kept", f"WITH {INCLUDED} SELECT link_flair AS flair, count(*) AS n_judged, count(*) FILTER (id IN (SELECT id FROM kp)) AS n_kept FROM inc GROUP BY ALL ORDER BY n_judged DESC, flair LIMIT 15")
def flair_kept(spark, d):
    rows = all_decided(spark, d)
    return verdicts.kept_by_flair(rows, verdicts.kept_posts(rows))


@query("strong_keeps", f"WITH {INCLUDED} SELECT id, strong FROM kp")
def strong_keeps(spark, d):
    return verdicts.kept_posts(all_decided(spark, d)).select("id", "strong")


@query("lone_drops", f"WITH {INCLUDED} SELECT id FROM inc WHERE included IN ('post', 'thread') AND nk = 0 AND length(selftext) < 300")
def lone_drops(spark, d):
    return all_decided(spark, d).where(F.col("included").isin("post", "thread") & verdicts.is_lone()).select("id")


@query("new_strong", f"WITH {INCLUDED} SELECT id FROM kp WHERE strong AND pid % 3 <> 0")
def new_strong(spark, d):
    strong = verdicts.kept_posts(all_decided(spark, d)).where("strong").select("id")
    return strong.join(A.posts(spark, d).where("pid % 3 = 0").select("id"), "id", "left_anti")


@query("nearest_drops", f"WITH {INCLUDED} SELECT id, floor(vscore * 10000)::BIGINT AS score, excluded FROM inc WHERE pr IS NOT NULL AND included IS NULL ORDER BY vscore DESC, id LIMIT 20")
def nearest_drops(spark, d):
    return verdicts.nearest_drops(all_decided(spark, d)).select("id", milli("verdict.score").alias("score"), "verdict.excluded")


@query("same_author", f"WITH {P}, r AS (SELECT id, author, row_number() OVER (ORDER BY score DESC, id) AS rank FROM p), l AS (SELECT author, list(id ORDER BY rank) AS ids FROM r GROUP BY author) SELECT r.id, array_to_string(list_filter(l.ids, lambda x: x <> r.id)[1:3], ',') AS others FROM r JOIN l USING (author)")
def same_author(spark, d):
    rank = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("score"), "id"))
    return verdicts.same_author(A.posts(spark, d).withColumn("rank", rank)).select("id", F.array_join("others", ",").alias("others"))


@query("decision_memo", f"WITH {P}, x AS (SELECT id, title AS state FROM p), k AS (SELECT DISTINCT state FROM x WHERE {h_sql('state')} % 2 = 0) SELECT id, floor({prob_sql('q one', 'x.state')} * 10000)::BIGINT AS q1, k.state IS NOT NULL AS known FROM x LEFT JOIN k USING (state)")
def decision_memo(spark, d):
    states = A.posts(spark, d).select("id", F.col("title").alias("state"))
    answers = filtering.Answers(spark, scoring.HashScorer())
    even = states.where(A.hashed(F.col("state")) % 2 == 0)
    answers.ask(even, ["q one"])  # an earlier run
    known = answers.keyed(states, ["q one"]).join(answers.work.save(answers.table()).select(F.col("key").alias("__key")), "__key", "left_semi").select("id", F.lit(True).alias("known"))
    scored = answers.answered(states, ["q one"]).join(known, "id", "left")
    return scored.select("id", F.floor(F.element_at("probs", 1) * 10000).cast("long").alias("q1"), F.coalesce("known", F.lit(False)).alias("known"))


KEEN = verdicts.Questions(q=("q one", "q two"), must="must", nots=("not one",), keep_at=0.93)
FILTER = f"""{P}, fp AS (SELECT id, sub, link_flair AS flair, sub || chr(10) || title AS state FROM p),
fq AS (SELECT *, CASE WHEN {h_sql("'f' || state")} % 200 = 0 THEN NULL ELSE [{', '.join(prob_sql(q, 'state') for q in KEEN.all)}] END AS pr FROM fp),
fv AS (SELECT *, CASE WHEN pr IS NULL THEN NULL WHEN pr[4] >= 0.7 THEN 'not' WHEN pr[1] < 0.35 THEN 'must' END AS excluded, greatest(pr[2], pr[3]) AS vscore FROM fq),
ft AS (SELECT 'd' || (conv_id * 8 + turn) % (SELECT count(*) FROM documents) AS post_id, 'c' || conv_id || '_' || turn AS root, text, length(text) AS chars, {h_sql("'h' || conv_id || '_' || turn")} % 3 = 0 AS has_hit FROM conversations),
fs AS (SELECT ft.*, CASE WHEN pr IS NULL OR (excluded IS NULL AND vscore >= 0.93) THEN 'a' WHEN vscore >= 0.2 THEN 'b' WHEN has_hit THEN 'c' END AS st FROM ft JOIN fv ON fv.id = ft.post_id WHERE excluded IS NULL AND chars >= 25),
fk AS (SELECT *, substring(text, 300 * (part - 1) + 1, 300) AS state FROM (SELECT *, unnest(range(1, (chars + 299) // 300 + 1)) AS part FROM fs WHERE st IS NOT NULL)),
fl AS (SELECT *, CASE WHEN {h_sql("'f' || state")} % 200 = 0 THEN NULL ELSE [{', '.join(prob_sql(q, 'state') for q in KEEN.q)}] END AS pr FROM fk),
fm AS (SELECT *, max(greatest(pr[1], pr[2])) OVER (PARTITION BY post_id, root ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fl),
fn AS (SELECT post_id, root, st, CASE WHEN bool_or(pr IS NULL) THEN NULL ELSE [max(pr[1]), max(pr[2])] END AS q FROM fm WHERE coalesce(before < 0.93, true) GROUP BY ALL),
fo AS (SELECT post_id, count(*) AS nk, count(q) AS nr, max(q[1]) AS q1, max(q[2]) AS q2 FROM fn WHERE q IS NULL OR greatest(q[1], q[2]) >= 0.93 GROUP BY post_id),
fi AS (SELECT fv.*, coalesce(nk, 0) AS nk, coalesce(nr, 0) AS nr, CASE WHEN pr IS NULL THEN 'unjudged' WHEN excluded IS NOT NULL THEN NULL WHEN vscore >= 0.93 THEN 'post' WHEN nr > 0 THEN 'thread' WHEN nk > 0 THEN 'unjudged' END AS included,
  greatest(pr[2], q1) AS f1, greatest(pr[3], q2) AS f2, row_number() OVER (PARTITION BY sub, flair ORDER BY sha1(id), id) AS r, count(*) OVER (PARTITION BY sub, flair) AS n FROM fv LEFT JOIN fo ON fo.post_id = fv.id),
fb AS (SELECT sub, flair FROM fi WHERE n > 8 AND r <= 7 GROUP BY ALL HAVING count(included) = 0),
fj AS (SELECT fi.*, NOT (r > 7 AND n > 8 AND fb.flair IS NOT NULL) AS judged FROM fi LEFT JOIN fb ON fb.sub = fi.sub AND fb.flair = fi.flair)"""


def keen_run(spark, d) -> filtering.Outcome:
    """A filter run over documents as posts and turns as their threads, each in parts of 300 characters."""
    posts, parts = keen_inputs(spark, d)
    return filtering.FilterRun(posts, parts, KEEN, filtering.Answers(spark, scoring.HashScorer(200))).run(min_posts=8, samples=(3, 4))


@query("filter_run", f"WITH {FILTER} SELECT id, judged, CASE WHEN judged THEN included END AS included, CASE WHEN judged THEN nk END AS n_kept, CASE WHEN judged THEN nr END AS n_kept_real, CASE WHEN judged THEN floor(coalesce(greatest(f1, f2), -1) * 10000)::BIGINT END AS best FROM fj")
def filter_run(spark, d):
    return keen_run(spark, d).posts.select("id", "judged", "included", "n_kept", "n_kept_real", milli("facet_score").alias("best"))


@query("filter_threads", f"WITH {FILTER} SELECT fn.post_id, root, st AS \"set\", floor(greatest(q[1], q[2]) * 10000)::BIGINT AS score, greatest(q[1], q[2]) >= 0.93 AS keep FROM fn JOIN fj ON fj.id = fn.post_id AND judged")
def filter_threads(spark, d):
    return keen_run(spark, d).threads.select("post_id", "root", "set", milli("verdict.score").alias("score"), "verdict.keep")


@query("gate_skips", f"WITH {FILTER} SELECT id, sub, flair FROM fj WHERE NOT judged")
def gate_skips(spark, d):
    return keen_run(spark, d).skipped


@query("verdict_rows", f"""WITH {FILTER}, fg AS (SELECT post_id, count(*) AS n, string_agg(root || ' ' || st || ' ' || CASE WHEN q IS NULL THEN '?' WHEN greatest(q[1], q[2]) >= 0.93 THEN '+' ELSE '-' END, ',' ORDER BY root) AS threads FROM fn GROUP BY post_id)
SELECT fj.id, p.pid, CASE WHEN judged THEN included END AS included, coalesce(judged AND included IN ('post', 'thread') AND nk = 0 AND length(p.selftext) < 300, false) AS lone, NOT judged AS flair_skipped,
  CASE WHEN judged THEN floor(round(coalesce(greatest(f1, f2), -1), 4) * 1000 + 0.000001)::BIGINT ELSE -1000 END AS best, CASE WHEN judged THEN excluded END AS excluded, CASE WHEN judged THEN coalesce(fg.threads, '') ELSE '' END AS threads
FROM fj JOIN p ON p.id = fj.id LEFT JOIN fg ON fg.post_id = fj.id""")
def verdict_rows(spark, d):
    rows = report.verdict_rows(keen_run(spark, d))
    said = F.transform("threads", lambda t: F.concat_ws(" ", t.root, t.set, F.when(t.verdict.isNull(), "?").when(t.verdict.keep, "+").otherwise("-")))
    return rows.select("id", "pid", "included", "lone", "flair_skipped", F.floor(F.col("score") * 1000 + 1e-6).alias("best"), "post.excluded", F.array_join(said, ",").alias("threads"))


def keen_report(spark, d) -> report.Report:
    outcome = keen_run(spark, d)
    turns = A.table(spark, d, "conversations")
    root = F.concat_ws("_", F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn").cast("string"))
    texts = turns.select(root.alias("root"), F.col("turn").alias("place"), F.lit(1).alias("n_comments"), F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> "))).alias("text"))
    return report.report(outcome, outcome.threads.select("post_id", "root").join(texts, "root"), some_hits(spark, d), KEEN, budget=20_000)


@query("report_order", f"""WITH {FILTER}, fr AS (SELECT p.id, fj.nk, greatest(f1, f2) AS best, p.score FROM fj JOIN p ON p.id = fj.id WHERE judged AND included IN ('post', 'thread') AND NOT (nk = 0 AND length(p.selftext) < 300))
SELECT id, row_number() OVER (ORDER BY best DESC, score DESC, id)::BIGINT AS rank FROM fr""")
def report_order(spark, d):
    return keen_report(spark, d).entries.select("id", F.col("rank").cast("long").alias("rank"))


@query("report_lines")
def report_lines(spark, d):
    """The report itself, line by line."""
    lines = keen_report(spark, d).lines()
    return spark.createDataFrame(list(enumerate(lines, 1)), "n int, line string")


SAMPLED = f"""{HITS_SQL}, sm AS (SELECT DISTINCT p.id, pid % 3 <> 0 AS tm, pid FROM p JOIN h USING (id)), ss AS (SELECT id, tm, row_number() OVER (PARTITION BY tm ORDER BY sha1(id), id) AS r FROM sm),
sp AS (SELECT id, CASE WHEN tm THEN 'hit in the post' ELSE 'found only through comments' END AS label FROM ss WHERE r <= 20)"""


def keen_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    posts = A.posts(spark, d).withColumn("state", F.concat("sub", F.lit("\n"), "title"))
    n = A.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    key = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    threads = A.table(spark, d, "conversations").select(F.concat(F.lit("d"), ((F.col("conv_id") * 8 + F.col("turn")) % n).cast("string")).alias("post_id"), F.concat(F.lit("c"), key).alias("root"), F.length("text").alias("chars"), (A.hashed(F.concat(F.lit("h"), key)) % 3 == 0).alias("has_hit"), "text")
    return posts, threads.where("chars > 0").withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(F.col("chars") / 300).cast("int")))).withColumn("state", F.expr("substring(text, 300 * (part - 1) + 1, 300)")).drop("text")


def keen_dry_run(spark, d):
    pool = matched(spark, d)
    return judging.dry_run(sampling.stratified(pool, 40), *keen_inputs(spark, d), KEEN, filtering.Answers(spark, scoring.HashScorer(200)))


@query("judge_sample", f"""WITH {FILTER}, {SAMPLED}, sk AS (SELECT post_id, count(*) AS n, count(*) FILTER (q IS NULL OR greatest(q[1], q[2]) >= 0.93) AS k FROM fn GROUP BY post_id)
SELECT label, sp.id, CASE WHEN excluded IS NOT NULL THEN 'EXCLUDED by ' || excluded WHEN included = 'post' THEN 'KEEP' WHEN included = 'thread' THEN 'KEEP via thread' WHEN included = 'unjudged' THEN 'UNJUDGED' ELSE 'drop' END AS decision,
  CASE WHEN pr IS NULL THEN '[failed]' ELSE printf('[Must %.2f | Q1 %.2f Q2 %.2f | Not1 %.2f]', pr[1], pr[2], pr[3], pr[4]) END AS probs, coalesce(sk.n, 0) AS n_threads, coalesce(sk.k, 0) AS n_kept
FROM sp JOIN fi ON fi.id = sp.id LEFT JOIN sk ON sk.post_id = sp.id""")
def judge_sample(spark, d):
    return keen_dry_run(spark, d)[0].drop("threads")


@query("judge_totals", f"""WITH {FILTER}, {SAMPLED} SELECT count(*) AS n, count(included) AS kept, count(*) FILTER (included = 'thread') AS via, count(*) FILTER (excluded = 'must' AND vscore >= 0.93) AS must_only, count(*) FILTER (excluded = 'not') AS excluded,
  count(*) FILTER (included IS NOT NULL AND f1 >= 0.93 AND NOT coalesce(f2 >= 0.93, false)) AS only_1, count(*) FILTER (included IS NOT NULL AND f2 >= 0.93 AND NOT coalesce(f1 >= 0.93, false)) AS only_2 FROM sp JOIN fi USING (id)""")
def judge_totals(spark, d):
    return judging.dry_run_totals(keen_dry_run(spark, d)[1], KEEN)


@query("recall_audit_sides", f"""WITH {TP}, {C}, a AS (SELECT id FROM tp WHERE list_contains({TERMS.format('title')}, 'in') OR list_contains({TERMS.format('selftext')}, 'in')), b AS (SELECT post_id FROM c WHERE list_contains({TERMS.format('body')}, 'in')),
x AS (SELECT id, bool_or(own) AS text_match, sum(via)::BIGINT AS n_comments FROM (SELECT id, true AS own, 0 AS via FROM a UNION ALL SELECT post_id, false, 1 FROM b) GROUP BY id)
SELECT * FROM x WHERE id NOT IN (SELECT id FROM tp WHERE list_contains({TERMS.format('selftext')}, 'the'))""")
def recall_audit_sides(spark, d):
    posts, comments = A.threads_posts(spark, d), A.comments(spark, d)
    own = fulltext.build_postings(posts, "post", "id", ["title", "selftext"])
    found = fulltext.two_sided(own.unionByName(fulltext.build_postings(comments, "comment", "id", ["body"])), comments, "in")
    earlier = fulltext.search(own, "post", ["title", "selftext"], "selftext:the").select(F.col("doc").alias("id"))
    return hits.missed_on_both_sides(*found, earlier)


@query("thread_order", f"WITH {THREADS} SELECT ts.post_id, root, st AS \"set\", row_number() OVER (ORDER BY st, CASE WHEN st = 'c' THEN vscore ELSE 0 END DESC, ts.post_id, root)::BIGINT AS place FROM ts JOIN jv ON jv.id = ts.post_id WHERE st IS NOT NULL")
def thread_order(spark, d):
    posts = judged(spark, d)
    return verdicts.thread_order(verdicts.thread_sets(posts, some_threads(spark, d)), posts).select("post_id", "root", "set", F.col("place").cast("long").alias("place"))


@query("show_posts", f"""WITH RECURSIVE {ORDER}, {TP}, ln AS (SELECT od.*, repeat('> ', least(depth + 1, 6)) AS q, c.author, c.score, c.body FROM od JOIN c USING (post_id, id)),
tx AS (SELECT post_id, root, string_agg(q || '**u/' || author || '** (' || score || ') · c/' || id || chr(10) || array_to_string(list_transform(string_split(body, chr(10)), lambda x: q || CASE WHEN regexp_matches(x, '^\\s*(#|>|---\\s*$)') THEN '\\' || x ELSE x END), chr(10)) || chr(10) || rtrim(q), chr(10) ORDER BY place) AS text FROM ln GROUP BY ALL),
th AS (SELECT tx.post_id, string_agg(tx.text, chr(10) ORDER BY c.created, root) AS threads FROM tx JOIN c ON c.id = tx.root GROUP BY tx.post_id),
r AS (SELECT * FROM (VALUES (1, 'P3', 3), (2, 'c7', 7), (3, 'nothing', NULL), (4, 't3_c3', 3)) AS v(n, ref, pid))
SELECT n::INT AS n, ref, id, '# P' || tp.pid || ' ' || title || chr(10) || 'r/' || author || ' | u/' || author || ' | ' || strftime(to_timestamp(1704067200 + tp.pid * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d') || ' | score ' || ({h_sql('selftext')} % 50)
  || ' | https://www.reddit.com/r/' || author || '/comments/' || id || '/' || chr(10) || chr(10) || selftext || chr(10) || chr(10) || coalesce(threads || chr(10), '') || chr(10) || '---' || chr(10) AS text
FROM r LEFT JOIN tp ON tp.pid = r.pid LEFT JOIN th ON th.post_id = tp.id""")
def show_posts(spark, d):
    return judging.show(A.threads_posts(spark, d), A.comments(spark, d), ["P3", "c7", "nothing", "t3_c3"])


@query("prune_counts", f"""WITH RECURSIVE {PRUNE}, kp AS (SELECT DISTINCT post_id, id FROM up) SELECT (SELECT count(*) FROM tp) AS posts_in, (SELECT count(*) FROM tp WHERE selftext <> '' OR id IN (SELECT post_id FROM kp)) AS posts,
  (SELECT count(*) FROM c WHERE post_id IN (SELECT id FROM tp)) AS comments_in, (SELECT count(*) FROM kp JOIN c USING (post_id, id) WHERE post_id IN (SELECT id FROM tp)) AS comments""".replace("< 200", "< 40"))
def prune_counts(spark, d):
    posts = A.threads_posts(spark, d).select("id", "sub", F.lit("").alias("title"), "selftext", "author", F.lit(None).cast("string").alias("author_flair_text"), F.lit("").alias("link_flair_text"), "score", F.col("created").alias("created_utc"), F.lit(0).alias("num_comments"), F.lit(False).alias("over_18"), "url")
    comments = A.comments(spark, d).select("id", F.concat(F.lit("t3_"), "post_id").alias("link_id"), F.when(F.col("parent").isNotNull(), F.concat(F.lit("t1_"), "parent")).otherwise(F.concat(F.lit("t3_"), "post_id")).alias("parent_id"), "author", F.col("flair").alias("author_flair_text"), "score", F.col("created").alias("created_utc"), "body")
    counts = ingest.build_counted(posts, comments, Stored(spark, "build").path)
    return spark.createDataFrame([counts], "posts_in long, posts long, comments_in long, comments long")


@query("download_totals", f"WITH {K}, z AS (SELECT min(s) + 864000 AS a, max(s) - 864000 AS b FROM k) SELECT sub, kind, coalesce(sum(n_rows) FILTER (fin IS NOT NULL), 0)::BIGINT AS cached, count(*) FILTER (fin IS NULL) AS chunks, coalesce(sum(est) FILTER (fin IS NULL), 0)::BIGINT AS est FROM k, z WHERE s < b AND e > a GROUP BY sub, kind")
def download_totals(spark, d):
    chunks = A.chunks(spark, d)
    ends = chunks.agg(F.min("start").alias("a"), F.max("start").alias("b")).first()
    return spans.totals(chunks, ends.a + 864000, ends.b - 864000, ["sub", "kind"])


@query("sub_catalogue", f"""WITH {K}, ks AS (SELECT 's' || sub AS sub, CASE WHEN kind IN ('click', 'view') THEN 'posts' ELSE 'comments' END AS kind, s, e, fin FROM k),
dc AS (SELECT sub, kind, s // 86400 * 86400 AS day, count(*) AS n FROM ks GROUP BY ALL), td AS (SELECT sub, kind, s, e FROM ks WHERE fin IS NULL),
ms AS (SELECT sub, sum(n) AS missing FROM dc WHERE EXISTS (SELECT 1 FROM td WHERE td.sub = dc.sub AND td.kind = dc.kind AND dc.day < td.e AND dc.day + 86400 > td.s) GROUP BY sub),
pk AS (SELECT DISTINCT sub, true AS found FROM ks UNION ALL SELECT 'nowhere', false)
SELECT pk.sub, found, CASE WHEN found THEN coalesce(sum(n) FILTER (kind = 'posts'), 0)::BIGINT END AS posts, CASE WHEN found THEN coalesce(sum(n) FILTER (kind = 'comments'), 0)::BIGINT END AS comments, CASE WHEN found THEN coalesce(any_value(missing), 0)::BIGINT END AS missing,
  CASE WHEN found THEN coalesce(any_value(missing), 0)::BIGINT // 15 END AS busy_s, CASE WHEN found THEN coalesce(any_value(missing), 0)::BIGINT // 300 END AS quiet_s FROM pk LEFT JOIN dc ON dc.sub = pk.sub LEFT JOIN ms ON ms.sub = pk.sub GROUP BY pk.sub, found""")
def sub_catalogue(spark, d):
    chunks = A.chunks(spark, d).withColumn("sub", F.concat(F.lit("s"), "sub")).withColumn("kind", F.when(F.col("kind").isin("click", "view"), "posts").otherwise("comments"))
    days = spans.day_counts(chunks.withColumn("created", F.col("start")), ["sub", "kind"])
    todo = chunks.where("finished_at is null").select("sub", "kind", "start", "end")
    return spans.catalogue(chunks.select("sub").distinct(), days, todo, "S", ["nowhere", "s3"])


@query("post_state", f"""WITH {TP}, {C}, ls AS (SELECT post_id, '- ' || replace(substring(body, 1, 400), chr(10), ' ') AS line, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, body DESC) AS k FROM c WHERE parent IS NULL),
lt AS (SELECT *, sum(length(line)) OVER (PARTITION BY post_id ORDER BY k) AS used FROM ls), tops AS (SELECT post_id, string_agg(line, chr(10) ORDER BY k) AS lines FROM lt WHERE used <= 3000 GROUP BY post_id)
SELECT id, 'Subreddit: r/' || author || chr(10) || 'Post title: ' || title || chr(10) || CASE WHEN selftext <> '' THEN 'Post text:' || chr(10) || selftext || chr(10) ELSE '' END || coalesce('Top comments:' || chr(10) || lines || chr(10), '') AS state FROM tp LEFT JOIN tops ON tops.post_id = tp.id""")
def post_state(spark, d):
    tops = A.comments(spark, d).where("parent is null").groupBy(F.col("post_id").alias("id")).agg(F.collect_list(F.struct("score", "body")).alias("tops"))
    posts = A.threads_posts(spark, d).join(tops, "id", "left").withColumn("hits", F.expr("cast(array() as array<struct<score: bigint, body: string>>)")).withColumn("tops", F.coalesce("tops", "hits"))
    return scoring.post_states(posts, text.query_stems(["the and"])).select("id", "state")


def tokens_sql(x: str) -> str:
    plain = f"length(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'))"
    return f"({plain} / 3.7 + (length({x}) - {plain}))"


@query("thread_state", f"""WITH RECURSIVE {ORDER}, {TP},
hd AS (SELECT id, 'A comment thread under the post "' || title || '" in r/' || author || '.' || CASE WHEN selftext <> '' THEN ' The post says: ' || substring(selftext, 1, 800) ELSE '' END || chr(10) || 'The thread:' || chr(10) AS head FROM tp),
ln AS (SELECT od.post_id, root, row_number() OVER (PARTITION BY od.post_id, root ORDER BY place) AS i, repeat('  ', depth) || 'u/' || author || ': ' || body || chr(10) AS line FROM od JOIN c USING (post_id, id)),
lk AS (SELECT ln.*, head, 3800 - {tokens_sql('head')} AS room, {tokens_sql('line')} AS n FROM ln JOIN hd ON hd.id = ln.post_id),
fold AS (SELECT post_id, root, i, 0 AS part, n AS used FROM lk WHERE i = 1
  UNION ALL SELECT lk.post_id, lk.root, lk.i, CASE WHEN used + n > room THEN part + 1 ELSE part END, CASE WHEN used + n > room THEN n ELSE used + n END FROM fold JOIN lk ON lk.post_id = fold.post_id AND lk.root = fold.root AND lk.i = fold.i + 1)
SELECT lk.post_id, lk.root, part::INT AS part, any_value(head) || string_agg(line, '' ORDER BY lk.i) AS state FROM fold JOIN lk ON lk.post_id = fold.post_id AND lk.root = fold.root AND lk.i = fold.i GROUP BY ALL""")
def thread_state(spark, d):
    return scoring.thread_states(forest.reading_order(A.comments(spark, d)), A.threads_posts(spark, d))


@query("nested_results")
def nested_results(spark, d):
    postings = fulltext.build_postings(A.threads_posts(spark, d), "post", "id", ["selftext"])
    found = fulltext.search_all(postings, "post", ["selftext"], {name: q for name, q, _ in SEARCHES}).withColumnRenamed("doc", "id")
    return nested(spark, d, found, found)


def nested(spark, d, found: DataFrame, text_hits: DataFrame) -> DataFrame:
    rows = hits.matched_posts(found, A.threads_posts(spark, d))
    return hits.nested_results(rows, A.comments(spark, d), text_hits, A.comments(spark, d).where("score > 5"))


@query("nested_results_flat", f"WITH {TP}, {C} SELECT tp.id, c.id AS comment_id, c.score > 5 AS hit FROM tp JOIN c ON c.post_id = tp.id WHERE tp.pid % 2 = 0")
def nested_results_flat(spark, d):
    found = A.threads_posts(spark, d).where("pid % 2 = 0").select("id", F.lit("q").alias("query"))
    return nested(spark, d, found, found.limit(0)).select("id", F.explode("comments").alias("c")).select("id", F.col("c.id").alias("comment_id"), "c.hit")
