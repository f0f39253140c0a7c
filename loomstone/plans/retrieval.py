"""Queries of filters, nearest neighbours, joins and merged rankings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings, search, sessions, tables, vectors, windows
from ..operators.shared import folder, held
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


DIST = "list_sum(list_transform(range(1, len(q.v) + 1), lambda i: pow(e.embedding[i]::DOUBLE - q.v[i]::DOUBLE, 2)))"
Q0 = "(SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q"


def _vectors(s, d):
    return V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query(s, d, i=0):
    return _vectors(s, d).filter(F.col("id") == i).first().vector


def _r(c, n=6):
    return F.round(c, n).alias(c)


@add("top01_knn", f"SELECT vec_id AS id, label, round({DIST}, 6) AS distance, round(1 - {DIST} / 2, 6) AS score FROM embeddings e, {Q0} ORDER BY {DIST}, vec_id LIMIT 10")
def top01(s, d):
    return search.knn(_vectors(s, d), _query(s, d), 10).select("id", "label", _r("distance"), _r("score"))


@add("flt01_pushed_filter_knn", f"SELECT vec_id AS id, label, round({DIST}, 6) AS distance FROM embeddings e, {Q0} WHERE label = 3 ORDER BY {DIST}, vec_id LIMIT 5")
def flt01(s, d):
    return search.knn(_vectors(s, d), _query(s, d), 5, where=tables.condition_on("label", 3)).select("id", "label", _r("distance"))


@add("flt03_faithful_postfilter", f"WITH near AS (SELECT vec_id AS id, label, {DIST} AS distance FROM embeddings e, {Q0} ORDER BY 3, 1 LIMIT 20) SELECT id, label, round(distance, 6) AS distance FROM near WHERE label IN (0, 1, 2) ORDER BY near.distance, id LIMIT 10")
def flt03(s, d):
    return search.filtered_knn(_vectors(s, d), _query(s, d), F.col("label").isin(0, 1, 2), 10, faithful=True).select("id", "label", _r("distance"))


@add("flt04_exact_prefilter", f"SELECT vec_id AS id, label, round({DIST}, 6) AS distance FROM embeddings e, {Q0} WHERE label IN (0, 1, 2) ORDER BY {DIST}, vec_id LIMIT 10")
def flt04(s, d):
    return search.filtered_knn(_vectors(s, d), _query(s, d), F.col("label").isin(0, 1, 2), 10).select("id", "label", _r("distance"))


@add("join09_knn_batch", "WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, e.vec_id AS id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: pow(e.embedding[i]::DOUBLE - q.v[i]::DOUBLE, 2))) AS distance FROM embeddings e, q) SELECT query_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY p.distance, id) AS rank FROM p QUALIFY rank <= 5")
def join09(s, d):
    q = _vectors(s, d).filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.knn_batch(_vectors(s, d), q).select("query_id", "id", _r("distance"), F.col("rank").cast("long").alias("rank"))


def _index(s, d):
    return vectors.build(_vectors(s, d), folder(s, "ivf"))


def _asked(s, d):
    return _vectors(s, d).filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


@add("top01_index_exact", SQL["join09_knn_batch"].replace("rank <= 5", "rank <= 10"))
def top01_index(s, d):
    """Through the index: cells that can't hold one of the nearest aren't read."""
    return vectors.search(s, _index(s, d), _asked(s, d), 10).select("query_id", "id", _r("distance"), F.col("rank").cast("long").alias("rank"))


@add("flt03_index_filtered", SQL["join09_knn_batch"].replace("FROM embeddings e, q)", "FROM embeddings e, q WHERE e.label IN (0, 1, 2))"))
def flt03_index(s, d):
    return vectors.search(s, _index(s, d), _asked(s, d), 5, where=F.col("label").isin(0, 1, 2)).select("query_id", "id", _r("distance"), F.col("rank").cast("long").alias("rank"))


@add("top01_index_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def top01_recall(s, d):
    """Whether the fewest probed cells that measuring finds reach a recall of 0.9 against exact search."""
    _, share = vectors.tuned(s, _index(s, d), _asked(s, d), 10)
    return _asked(s, d).agg(F.count("*").alias("queries"), F.lit(share >= 0.9).alias("reached"))


@add("flt02_session_scan", f"SELECT id, content, memory_type FROM ({V.MEMORIES}) WHERE session_id = 3 AND memory_type = 'user' ORDER BY id LIMIT 100")
def flt02(s, d):
    return V.memories(s, d).filter(tables.condition_on("session_id", 3) & tables.condition_on("memory_type", "user")).orderBy("id").limit(100).select("id", "content", "memory_type")


@add("flt06_find_symbol", f"SELECT id, name, path FROM ({V.SYMBOLS}) WHERE name = 'widget' OR ends_with(name, '.widget') ORDER BY id LIMIT 1")
def flt06(s, d):
    return search.symbol(V.symbols(s, d), "widget", [F.col("id")]).select("id", "name", "path")


@add("flt11_intervention_policy", f"SELECT id, memory_type, importance FROM ({V.ENTRIES}) WHERE memory_type = 'error' OR importance > 2.5 OR contains(content, '99')")
def flt11(s, d):
    policy = [{"field": "memory_type", "operator": "equals", "value": "error"}, {"field": "importance", "operator": "greater_than", "value": 2.5}, {"field": "content", "operator": "contains", "value": 99}]
    return V.entries(s, d).filter(search.any_condition(policy)).select("id", "memory_type", "importance")


@add("src01_commit_scan", f"SELECT hash, author, message, strftime(stamp, '%Y-%m-%d') AS day FROM ({V.COMMITS}) ORDER BY stamp DESC, hash LIMIT 100")
def src01(s, d):
    return V.commits(s, d).orderBy(F.desc("stamp"), "hash").limit(100).select("hash", "author", "message", F.date_format("stamp", "yyyy-MM-dd").alias("day"))


@add("src03_file_history", f"WITH f AS ({V.FILES}), c AS ({V.COMMITS}) SELECT hash, author, message FROM c WHERE hash IN (SELECT hash FROM f WHERE path LIKE 'src/m7/%') ORDER BY stamp DESC, hash LIMIT 50")
def src03(s, d):
    own = V.commit_files(s, d).filter(F.startswith("path", F.lit("src/m7/"))).select("hash").distinct()
    return V.commits(s, d).join(own, "hash", "left_semi").orderBy(F.desc("stamp"), "hash").limit(50).select("hash", "author", "message")


@add("src04_author_scan", f"SELECT hash, author FROM ({V.COMMITS}) WHERE contains(lower(author), 'build') ORDER BY stamp DESC, hash LIMIT 100")
def src04(s, d):
    return V.commits(s, d).filter(F.contains(F.lower("author"), F.lit("BUILD".lower()))).orderBy(F.desc("stamp"), "hash").limit(100).select("hash", "author")


@add("src05_pattern_scan", f"WITH f AS ({V.FILES}), c AS ({V.COMMITS}) SELECT hash, message FROM c WHERE regexp_matches(message, '(?i)urgent') OR hash IN (SELECT hash FROM f WHERE regexp_matches(path, '(?i)M1/F1\\d*\\.py')) ORDER BY stamp DESC, hash LIMIT 100")
def src05(s, d):
    own = V.commit_files(s, d).filter(F.rlike("path", F.lit(r"(?i)M1/F1\d*\.py"))).select("hash").distinct().withColumn("hit", F.lit(True))
    return V.commits(s, d).join(own, "hash", "left").filter(F.rlike("message", F.lit("(?i)urgent")) | F.coalesce("hit", F.lit(False))).orderBy(F.desc("stamp"), "hash").limit(100).select("hash", "message")


@add("join01_project_lookup", f"SELECT id, path, coalesce(r_name, '') AS project_path FROM ({V.SYMBOLS}) LEFT JOIN region ON id % 7 = r_regionkey")
def join01(s, d):
    p = V.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("project"), F.col("r_name").alias("project_path"))
    return V.symbols(s, d).withColumn("project", F.col("id") % 7).join(p, "project", "left").select("id", "path", F.coalesce("project_path", F.lit("")).alias("project_path"))


@add("join02_unindexed_commits", f"SELECT hash, author FROM ({V.COMMITS}) WHERE hash NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def join02(s, d):
    known = V.table(s, d, "lineitem").filter("l_linenumber = 4").select(F.col("l_orderkey").alias("hash"))
    return V.commits(s, d).join(known, "hash", "left_anti").select("hash", "author")


@add("join03_unexplored_sessions", "SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view') AND conv_id <> 1")
def join03(s, d):
    seen = V.table(s, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("session_id"))
    return V.memories(s, d).filter("session_id <> 1").select("session_id").distinct().join(seen, "session_id", "left_anti")


@add("set03_deleted_files", "SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def set03(s, d):
    now = V.table(s, d, "part").filter("p_size < 40").select(F.col("p_partkey").alias("path"))
    return V.table(s, d, "lineitem").select(F.col("l_partkey").alias("path")).distinct().join(now, "path", "left_anti")


@add("join06_relevant_retrieved", f"SELECT query_id, rank, item_id FROM ({V.RUNS}) r WHERE EXISTS (SELECT 1 FROM ({V.QRELS}) q WHERE q.query_id = r.query_id AND q.item_id = r.item_id AND relevance >= 0.5)")
def join06(s, d):
    return V.runs(s, d).join(V.qrels(s, d).filter("relevance >= 0.5"), ["query_id", "item_id"], "left_semi").select("query_id", "rank", "item_id")


@add("top06_recent_context", f"SELECT id, content FROM ({V.MEMORIES}) WHERE session_id = 5 ORDER BY nth DESC LIMIT 10")
def top06(s, d):
    return V.memories(s, d).filter("session_id = 5").orderBy(F.desc("nth")).limit(10).select("id", "content")


@add("top07_history", f"SELECT id, memory_type, content FROM ({V.MEMORIES}) WHERE session_id = 5 ORDER BY nth LIMIT 50")
def top07(s, d):
    return V.memories(s, d).filter("session_id = 5").orderBy("nth").limit(50).select("id", "memory_type", "content")


WORDS = "list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> ''))"


@add("top08_keyword_overlap", f"SELECT id, CAST(len(list_intersect({WORDS}, ['the', 'in', 'of', 'that'])) AS INT) AS overlap FROM ({V.MEMORIES}) WHERE len(list_intersect({WORDS}, ['the', 'in', 'of', 'that'])) > 0 ORDER BY overlap DESC, id LIMIT 10")
def top08(s, d):
    return search.overlap_search(V.memories(s, d), "The in OF that", 10).select("id", "overlap")


HITS_OF = f"len(list_intersect({WORDS}, {WORDS.replace('content', 'query')}))"


@add("top08_overlap_batch", f"WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark), m AS (SELECT query_id, id, CAST({HITS_OF} AS INT) AS overlap FROM ({V.MEMORIES}), q) SELECT query_id, id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY m.overlap DESC, id) AS rank FROM m WHERE m.overlap > 0 QUALIFY rank <= 10")
def top08_batch(s, d):
    """Every benchmark text as a query over all turns, by posting lists."""
    q = V.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return postings.overlap_batch(s, postings.build(V.memories(s, d), folder(s, "postings")), q).select("query_id", "id", "overlap", F.col("rank").cast("long").alias("rank"))


@add("top10_token_budget", f"SELECT id, session_id, CAST(sum(length(content) // 4) OVER (PARTITION BY session_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ({V.MEMORIES}) QUALIFY upto <= 400")
def top10(s, d):
    return windows.within_budget(V.memories(s, d), "session_id", F.floor(F.length("content") / 4), 400, F.col("nth")).select("id", "session_id", "upto")


@add("set01_first_of_each", f"WITH a AS (SELECT id, 0 AS source_rank FROM ({V.MEMORIES}) WHERE nth < 3), b AS (SELECT id, 1 AS source_rank FROM ({V.MEMORIES}) WHERE memory_type = 'user') SELECT id, min(source_rank) AS source_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def set01(s, d):
    m = V.memories(s, d).select("id", "nth", "memory_type")
    return search.first_of_each([m.filter("nth < 3"), m.filter("memory_type = 'user'")]).select("id", "source_rank")


@add("set02_hybrid_merge", f"WITH v AS (SELECT vec_id AS id, (1 - {DIST} / 2) * 0.7 AS score, 0 AS part FROM embeddings e, {Q0} ORDER BY {DIST}, vec_id LIMIT 20), k AS (SELECT vec_id AS id, 0.5 * 0.3 AS score, 1 AS part FROM embeddings WHERE label = 1), u AS (SELECT * FROM v UNION ALL SELECT * FROM k) SELECT id, round(u.score, 6) AS score, part FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY u.score DESC, part) = 1 ORDER BY u.score DESC, id LIMIT 30")
def set02(s, d):
    near = search.knn(_vectors(s, d), _query(s, d), 20).select("id", "score")
    words = _vectors(s, d).filter("label = 1").select("id", F.lit(None).cast("double").alias("score"))
    return search.merged([(near, 0.7), (words, 0.3)], 30).select("id", _r("score"), "part")


KEY = "list_filter(string_split_regex(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))"


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


KEYWORDS = KEY.format(t="text", stop=sql_list(T.KEYWORD_STOP))
TECH = f"CASE WHEN list_contains({sql_list(T.TECH_TERMS)}, word) THEN 3 ELSE 1 END"


def keywords_sql(source: str, id: str) -> str:
    return f"SELECT id, word, CAST(sum({TECH}) AS BIGINT) AS n, row_number() OVER (PARTITION BY id ORDER BY sum({TECH}) DESC, word) AS rank FROM (SELECT {id} AS id, unnest({KEYWORDS}) AS word FROM {source}) GROUP BY id, word QUALIFY rank <= 20"


@add("b05_keywords", keywords_sql("documents", "doc_id"))
def b05(s, d):
    return sessions.keywords(V.table(s, d, "documents"), "doc_id", "text").select("id", "word", "n", F.col("rank").cast("long").alias("rank"))


PAIRS = f"WITH k AS ({keywords_sql('conversations', 'conv_id * 1000 + turn')}), n AS (SELECT id, count(*) AS n FROM k GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM k a JOIN k b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2), j AS (SELECT a, b, CAST(c AS DOUBLE) / (x.n + y.n - c) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b)"


def _turn_keywords(s, d):
    t = V.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return sessions.keywords(t, "id", "text").select("id", "word").transform(held)


@add("join05_keyword_jaccard", PAIRS + " SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE j.jaccard > 0.3")
def join05(s, d):
    k = _turn_keywords(s, d)
    return sessions.similar(k, k).select("a", "b", _r("jaccard"))


@add("cq04_duplicate_check", PAIRS.replace("a.id < b.id", "a.id % 20 = 0 AND b.id <> a.id") + " SELECT a, b, round(jaccard, 6) AS jaccard, row_number() OVER (PARTITION BY a ORDER BY j.jaccard DESC, b) AS rank, max(j.jaccard) OVER (PARTITION BY a) >= 0.8 AS is_duplicate FROM j WHERE j.jaccard > 0.3 QUALIFY rank <= 5")
def cq04(s, d):
    k = _turn_keywords(s, d)
    return sessions.duplicates(k.filter("id % 20 = 0"), k).select("a", "b", _r("jaccard"), F.col("rank").cast("long").alias("rank"), "is_duplicate")
