"""Queries of composite surfaces, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite, postings, search, vectors
from ..operators.shared import folder
from . import views as V
from .retrieval import DIST, Q0, WORDS, _query, _vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


ASK = "the in of that"
HITS = f"CAST(len(list_intersect({WORDS}, ['the', 'in', 'of', 'that'])) AS INT)"


@add("cq01_session_context", f"WITH m AS (SELECT *, {HITS} AS o FROM ({V.MEMORIES}) WHERE session_id = 5), a AS (SELECT id, 0 AS source_rank FROM m WHERE o > 0 ORDER BY o DESC, id LIMIT 10), b AS (SELECT id, 1 AS source_rank FROM m ORDER BY nth DESC LIMIT 10) SELECT id, min(source_rank) AS source_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def cq01(s, d):
    return composite.session_context(V.memories(s, d), 5, ASK).select("id", "source_rank")


@add("cq02_code_context", f"WITH m AS (SELECT *, {HITS} AS o FROM ({V.MEMORIES})), a AS (SELECT id, 0 AS source_rank FROM m WHERE memory_type = 'system' ORDER BY id LIMIT 5), b AS (SELECT id, 1 AS source_rank FROM m WHERE o > 0 ORDER BY o DESC, id LIMIT 5) SELECT id, min(source_rank) AS source_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def cq02(s, d):
    return composite.code_context(V.memories(s, d), ASK, ["system"]).select("id", "source_rank")


TIERS = f"WITH m AS (SELECT *, {HITS} AS o, row_number() OVER (ORDER BY nth DESC) AS age FROM ({V.MEMORIES}) WHERE session_id = 7), a AS (SELECT id, content, 'working' AS layer, 0 AS r FROM m WHERE age <= 2 ORDER BY age LIMIT 5), b AS (SELECT id, content, 'short_term' AS layer, 1 AS r FROM m WHERE age > 2 AND age <= 4 ORDER BY o DESC, id LIMIT 5), c AS (SELECT id, content, 'long_term' AS layer, 2 AS r FROM m WHERE age > 4 AND o > 0 ORDER BY o DESC, id LIMIT 10), u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY r, id LIMIT 10)"


def _tiered(s, d):
    return composite.tiered(V.memories(s, d), 7, ASK, 10, 2, 2)


@add("cq05_tiered_retrieve", TIERS + " SELECT id, layer FROM u")
def cq05(s, d):
    return _tiered(s, d).select("id", "layer")


@add("top10_context_text", TIERS + ", t AS (SELECT r, id, CASE layer WHEN 'working' THEN '[Current Context]' WHEN 'short_term' THEN '[Recent History]' ELSE '[Background Knowledge]' END || chr(10) || content || chr(10) || chr(10) AS line FROM u), bud AS (SELECT *, sum(length(line)) OVER (ORDER BY r, id ROWS UNBOUNDED PRECEDING) AS upto FROM t) SELECT array_to_string(list(line ORDER BY r, id), '') AS text FROM bud WHERE upto <= 2000")
def top10(s, d):
    return composite.context_text(_tiered(s, d), 500, F.col("source_rank"), F.col("id"))


HYBRID = f"""WITH n AS (SELECT vec_id AS id, (1 - {DIST} / 2) * 0.7 AS score, 0 AS part FROM embeddings e, {Q0} ORDER BY {DIST}, vec_id LIMIT 20), w AS (SELECT doc_id AS id, 0.5 * 0.3::DOUBLE AS score, 1 AS part FROM (SELECT doc_id, text AS content FROM documents) WHERE {HITS} > 0 ORDER BY {HITS} DESC, doc_id LIMIT 20)
 SELECT id, round(u.score, 6) AS score, part FROM (SELECT * FROM n UNION ALL SELECT * FROM w) u QUALIFY row_number() OVER (PARTITION BY id ORDER BY u.score DESC, part) = 1 ORDER BY u.score DESC, id LIMIT 10"""


@add("cq06_hybrid_query", HYBRID)
def cq06(s, d):
    texts = V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return composite.hybrid(_vectors(s, d), _query(s, d), texts, ASK).select("id", F.round("score", 6).alias("score"), "part")


def _reasoned() -> str:
    """Whether there is a reason to retrieve, of columns q and recent."""
    from .texts import CONF, _complexity_sql

    return f"({CONF} < 0.4 OR {_complexity_sql('q')} > 0.5 OR recent < 3)"


ROUTED = f"""WITH q0 AS (SELECT item_id AS query_id, text || CASE WHEN item_id % 2 = 0 THEN '' ELSE ' and api vs maybe?' END AS q, item_id % 100 AS session_id, item_id % 7 AS recent, ['adaptive', 'hybrid', 'vectors', 'keywords', 'tiers'][item_id % 5 + 1] AS strategy FROM benchmark),
 q AS (SELECT *, CASE WHEN strategy <> 'adaptive' THEN strategy WHEN {_reasoned()} THEN 'hybrid' ELSE 'none' END AS route, list_distinct(list_filter(string_split_regex(lower(q), '\\s+'), lambda w: w <> '')) AS own FROM q0),
 n AS (SELECT query_id, e.vec_id AS id, list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: pow(e.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE, 2))) AS distance FROM q JOIN embeddings v ON v.vec_id = query_id, embeddings e WHERE route IN ('hybrid', 'vectors')),
 near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n.distance, id) AS r FROM n QUALIFY r <= 12),
 w AS (SELECT query_id, doc_id AS id, len(list_intersect(own, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')))) AS overlap FROM q, documents WHERE route IN ('hybrid', 'keywords')),
 words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w.overlap DESC, id) AS r FROM w WHERE w.overlap > 0 QUALIFY r <= 12),
 h AS (SELECT query_id, id, (1 - distance / 2) * 0.7 AS score, 0 AS part FROM near UNION ALL SELECT query_id, id, 0.5 * 0.3::DOUBLE, 1 FROM words),
 h1 AS (SELECT h.* FROM h JOIN q USING (query_id) WHERE route = 'hybrid' QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY h.score DESC, part) = 1),
 m AS (SELECT session_id, id, list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> '')) AS has, row_number() OVER (PARTITION BY session_id ORDER BY nth DESC) AS age FROM ({V.MEMORIES})),
 t AS (SELECT query_id, id, age, len(list_intersect(own, has)) AS overlap FROM q JOIN m USING (session_id) WHERE route = 'tiers'),
 t3 AS (SELECT query_id, id, 'working' AS layer, 0 AS p FROM t WHERE age <= 2 UNION ALL SELECT query_id, id, 'short_term', 1 FROM (SELECT * FROM t WHERE age BETWEEN 3 AND 4) UNION ALL SELECT query_id, id, 'long_term', 2 FROM t WHERE age > 4 AND overlap > 0),
 a AS (SELECT query_id, id::VARCHAR AS id, h1.score AS score, NULL::VARCHAR AS layer, row_number() OVER (PARTITION BY query_id ORDER BY h1.score DESC, h1.id) AS rank FROM h1
  UNION ALL SELECT query_id, id::VARCHAR, 1 - distance / 2, NULL, r FROM near JOIN q USING (query_id) WHERE route = 'vectors'
  UNION ALL SELECT query_id, id::VARCHAR, overlap::DOUBLE, NULL, r FROM words JOIN q USING (query_id) WHERE route = 'keywords'
  UNION ALL SELECT query_id, id, NULL::DOUBLE, layer, row_number() OVER (PARTITION BY query_id ORDER BY p, id) FROM t3)
 SELECT query_id, route, a.id, round(a.score, 6) AS score, layer, rank FROM a JOIN q USING (query_id) WHERE rank <= 6"""


@add("cq06_routed_queries", ROUTED)
def cq06_routed(s, d):
    """Every benchmark text as a query, by its strategy; adaptive ones decide for themselves."""
    b = V.table(s, d, "benchmark")
    e = _vectors(s, d)
    q = b.join(e.select(F.col("id").alias("item_id"), F.col("vector").alias("query_vector")), "item_id", "left")
    i = F.col("item_id")
    text = F.concat("text", F.when(i % 2 == 0, "").otherwise(" and api vs maybe?"))
    strategy = F.element_at(F.array(*map(F.lit, postings.STRATEGIES)), (i % 5 + 1).cast("int"))
    q = q.select(i.alias("query_id"), text.alias("query"), "query_vector", (i % 100).alias("session_id"), strategy.alias("strategy"), F.lit(None).cast("double").alias("history"), (i % 7).alias("recent"))
    docs = V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    found = postings.retrieved(q, vectors.build(e, folder(s, "ivf")), postings.build(docs, folder(s, "postings")), V.memories(s, d), 6, 2, 2)
    return found.select("query_id", "route", "id", F.round("score", 6).alias("score"), "layer", F.col("rank").cast("long").alias("rank"))


NEAR1 = DIST.replace("q.v", "z.v")


@add("cq07_rag_query", f"""WITH n AS (SELECT vec_id AS id, 1 - {NEAR1} / 2 AS score FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 1) z ORDER BY {NEAR1}, vec_id LIMIT 5), r AS (SELECT n.id, n.score, source, text, row_number() OVER (ORDER BY n.score DESC, n.id) AS k FROM n JOIN documents ON doc_id = n.id)
 SELECT array_to_string(list('[' || k || '] Source: ' || source || chr(10) || 'Content: ' || left(text, 500) || '...' || chr(10) ORDER BY k), chr(10)) AS context, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM r""")
def cq07(s, d):
    near = search.knn(_vectors(s, d), _query(s, d, 1), 5).select("id", "score")
    docs = V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    return composite.answer_context(near.join(docs, "id"))
