"""Queries of upkeep, projects, interventions, sources and parsers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registered
from ..functions import scoring as S
from ..functions import text as T
from ..operators import chunks, composite, evaluate, graph, search, sessions, tables, triples, upkeep, windows
from ..operators.shared import folder
from ..sources import code, files, git
from . import views as V
from .retrieval import DIST, Q0, WORDS, _query, _vectors, keywords_sql
from .stats import LEVELS, LIST, WALK, WINDOWS
from .texts import SHINGLES, SIG

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _r(c, n=6):
    return F.round(c, n).alias(c)


# sources and parsers on texts made from the tables


def _code_files(s, d):
    body = F.concat(F.lit("import os\nfrom sys import path as p\n\n@deco\ndef f"), F.col("p_partkey"), F.lit("(a: int, *, b=1) -> str:\n    \"\"\"Doc.\"\"\"\n    return g"), F.col("p_size"), F.lit("(a)\n\n\nclass C"), F.col("p_partkey"), F.lit("(Base):\n    async def m(self):\n        await h(self)\n"))
    return V.table(s, d, "part").select(F.concat(F.lit("src/p"), F.col("p_partkey"), F.lit(".py")).alias("path"), body.alias("content"), F.lit("python").alias("kind"))


PY = "SELECT 'src/p' || p_partkey || '.py' AS path, p_partkey AS k, p_size AS z FROM part"


@add("prs01_python_symbols", f"""WITH p AS ({PY}) SELECT path, 'f' || k AS name, 'function' AS symbol_type, 'def f' || k || '(a: int, *, b=1) -> str' AS signature, 4 AS start_line, 7 AS end_line, false AS is_async FROM p
 UNION ALL SELECT path, 'C' || k, 'class', 'class C' || k || '(Base)', 10, 12, false FROM p UNION ALL SELECT path, 'C' || k || '.m', 'method', 'async def m(self)', 11, 12, true FROM p""")
def prs01(s, d):
    return code.symbols(_code_files(s, d)).select("path", "name", "symbol_type", "signature", "start_line", "end_line", "is_async")


@add("prs02_script_symbols", "SELECT p_partkey || '.js' AS path, n AS name, t AS symbol_type, l AS start_line FROM part, (VALUES ('run', 'function', 1), ('K', 'class', 4)) v(n, t, l)")
def prs02(s, d):
    body = F.lit("async function run(a) {\n  if (a) { return '}'; }\n}\nexport class K extends B {\n  m() { return 1; }\n}\n")
    return code.symbols(V.table(s, d, "part").select(F.concat(F.col("p_partkey"), F.lit(".js")).alias("path"), body.alias("content"), F.lit("javascript").alias("kind"))).select("path", "name", "symbol_type", "start_line")


@add("prs03_imports", f"SELECT path, m AS module, n AS names FROM ({PY}), (VALUES ('os', ''), ('sys', 'path')) v(m, n)")
def prs03(s, d):
    return code.imports(_code_files(s, d)).select("path", "module", F.array_join("names", ",").alias("names"))


@add("prs04_calls", f"SELECT path, 'g' || z AS callee FROM ({PY}) UNION ALL SELECT path, 'h' FROM ({PY})")
def prs04(s, d):
    return code.calls(_code_files(s, d))


@add("prs05_symbol_chunks", f"SELECT path, 'from sys import path' || chr(10) || 'import os' AS head, count(*) AS n FROM ({PY}), range(3) GROUP BY ALL")
def prs05(s, d):
    f = _code_files(s, d)
    return code.chunks(code.symbols(f), code.imports(f)).groupBy("path", F.substring_index("text", "\n\n", 1).alias("head")).agg(F.count("*").alias("n"))


@add("prs07_extracted_triples")
def prs07(s, d):
    from ..operators.composite import mapped_texts

    ask = lambda: lambda texts: ['[{"subject":"t","relation":"has","object":"%d"}]' % len(t) for t in texts]
    return triples.parsed(mapped_texts(V.table(s, d, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id", "text", ask, "string"), "id", "value")


@add("b03_external_embedder", "SELECT item_id AS id, length(text) AS first FROM benchmark")
def b03(s, d):
    from ..operators.composite import mapped_texts

    ask = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    return mapped_texts(V.table(s, d, "benchmark"), "item_id", "text", ask, "array<double>").select("id", F.col("value")[0].cast("long").alias("first"))


@add("b19_json_of_reply", "SELECT event_id, props AS body FROM events")
def b19(s, d):
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("so "), "props", F.lit(" then")))
    return V.table(s, d, "events").select("event_id", triples.json_of(reply).alias("body"))


@add("src08_code_section", f"SELECT path, 'class C' || k || '(Base):' || chr(10) || '    async def m(self):' || chr(10) || '        await h(self)' AS section FROM ({PY})")
def src08(s, d):
    cut = F.udf(lambda text, name: git.section(text, cls=name), "string")
    own = _code_files(s, d).withColumn("k", F.regexp_extract("path", r"p(\d+)", 1))
    return own.select("path", cut("content", F.concat(F.lit("C"), "k")).alias("section"))


@add("src11_kind_by_suffix", f"SELECT id, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.ts') THEN 'javascript' ELSE 'text' END AS kind FROM ({V.SYMBOLS})")
def src11(s, d):
    return V.symbols(s, d).select("id", files.kind_of(F.col("path")).alias("kind"))


@add("flt10_glob_filter", f"SELECT id, path FROM ({V.SYMBOLS}) WHERE (path LIKE '%.py' OR path LIKE '%.ts') AND NOT path LIKE 'src/Brand#1/%'")
def flt10(s, d):
    p = F.col("path")
    return V.symbols(s, d).filter(files.matches(p, ("*.py", "*.ts")) & ~files.matches(p, ("src/Brand#1/*",))).select("id", "path")


@add("src10_session_decisions", "SELECT conv_id AS session_id, turn - 1 AS nth, text AS content FROM conversations WHERE turn > 0")
def src10(s, d):
    rows = V.table(s, d, "conversations").filter("turn > 0")
    item = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.col("text"))
    own = rows.select(F.col("conv_id").alias("session_id"), F.col("turn"), item.alias("d"))
    lists = own.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "d"))), lambda x: x["d"]).alias("decisions"))
    turns = own.withColumn("k", F.row_number().over(windows.Window.partitionBy("session_id").orderBy("turn")) - 1).select("session_id", F.col("k").alias("nth"), "turn")
    return files.decisions(lists).join(turns, ["session_id", "nth"]).select("session_id", (F.col("turn") - 1).alias("nth"), "content")


@add("chk03_code_chunks")
def chk03(s, d):
    return chunks.chunked(_code_files(s, d).select(F.col("path").alias("id"), F.col("content").alias("text"), F.lit("code").alias("kind")), "id", "text", "kind")


@add("chk05_oversize_split")
def chk05(s, d):
    big = F.concat(F.lit("def a():\n"), F.replace("text", F.lit(" "), F.lit("\n  ")), F.lit("\ndef b():\n  x"))
    return chunks.chunked(V.table(s, d, "documents").select(F.col("doc_id").alias("id"), big.alias("text"), F.lit("code").alias("kind")), "id", "text", "kind")


# retrieval variants


@add("flt05_global_search", f"SELECT vec_id AS id, round({DIST}, 6) AS distance, coalesce(r_name, '') AS project FROM embeddings e LEFT JOIN region ON r_regionkey = label, {Q0} WHERE label IN (0, 2, 7) ORDER BY {DIST}, vec_id LIMIT 10")
def flt05(s, d):
    near = search.knn(_vectors(s, d), _query(s, d), 10, where=F.col("label").isin(0, 2, 7))
    p = V.table(s, d, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("project"))
    return near.join(p, "label", "left").select("id", _r("distance"), F.coalesce("project", F.lit("")).alias("project"))


@add("top09_by_project", f"SELECT vec_id AS id, label, round({DIST}, 6) AS distance FROM embeddings e, {Q0} WHERE label IN (4, 5) ORDER BY {DIST}, vec_id LIMIT 10")
def top09(s, d):
    return search.knn(_vectors(s, d), _query(s, d), 10, where=F.col("label").isin(4, 5)).select("id", "label", _r("distance"))


@add("top02_unfiltered_search", f"SELECT vec_id AS id, round(1 - {DIST} / 2, 6) AS score FROM embeddings e, {Q0} ORDER BY {DIST}, vec_id LIMIT 5")
def top02(s, d):
    return search.knn(_vectors(s, d), _query(s, d), 5).select("id", _r("score"))


@add("prj03_true_scores", f"SELECT vec_id AS id, label, round(1 - {DIST} / 2, 6) AS score FROM embeddings e, {Q0}")
def prj03(s, d):
    q = F.array(*map(F.lit, _query(s, d)))
    return _vectors(s, d).select("id", "label", F.round(S.similarity(S.squared_distance(F.col("vector"), q)), 6).alias("score"))


@add("set04_jaccard", f"WITH t AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM benchmark), x AS (SELECT item_id, {SHINGLES} AS sh FROM t) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)))::DOUBLE, 6) AS jaccard FROM x a JOIN x b ON b.item_id = a.item_id + 1")
def set04(s, d):
    x = V.table(s, d, "benchmark").select("item_id", T.shingles(F.col("text")).alias("s"))
    y = x.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("s").alias("t"))
    return x.join(y, "item_id").select(F.col("item_id").alias("a"), "b", F.round(T.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@add("join04_gone_files", f"SELECT DISTINCT path FROM ({V.FILES}) WHERE path NOT IN (SELECT path FROM ({V.FILES}) WHERE deletions < 4)")
def join04(s, d):
    f = V.commit_files(s, d)
    return f.select("path").distinct().join(f.filter("deletions < 4"), "path", "left_anti")


@add("join07_ranks_with_relevance", f"SELECT r.query_id, rank, r.item_id, coalesce(relevance, 0) AS rel FROM ({V.RUNS}) r LEFT JOIN ({V.QRELS}) q ON q.query_id = r.query_id AND q.item_id = r.item_id")
def join07(s, d):
    return evaluate.judged(V.runs(s, d), V.qrels(s, d)).select("query_id", "rank", "item_id", "rel")


@add("win01_reciprocal_rank", LIST + " SELECT query_id, round(mrr, 6) AS mrr FROM m")
def win01(s, d):
    return evaluate.whole_list(V.runs(s, d), V.qrels(s, d)).select("query_id", _r("mrr"))


@add("ev04_dcg", f"SELECT r.query_id, round(sum(coalesce(relevance, 0) / log2(rank + 1)), 6) AS dcg FROM ({V.RUNS}) r LEFT JOIN ({V.QRELS}) q ON q.query_id = r.query_id AND q.item_id = r.item_id GROUP BY 1")
def ev04(s, d):
    return evaluate.judged(V.runs(s, d), V.qrels(s, d), by_query=True).groupBy("query_id").agg(F.round(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)), 6).alias("dcg"))


@add("win08_merge_decision", WINDOWS + """, c AS (SELECT session_id, id, count(*) OVER (PARTITION BY session_id, win) >= 4 AND count(*) OVER (PARTITION BY session_id) >= 10 AS merge FROM w) SELECT id, merge FROM c""")
def win08(s, d):
    own = windows.anchored_windows(V.entries(s, d), "session_id", "created_at", "id", 24)
    return upkeep.merged_windows(own, "session_id", "window").select("id", "merge")


@add("win09_line_numbers", "SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def win09(s, d):
    return V.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), "line")


@add("join10_task_dependency_states", f"SELECT d.task, dep, state FROM ({V.DEPS}) d LEFT JOIN ({V.TASKS}) t ON t.task = dep")
def join10(s, d):
    return V.deps(s, d).join(V.tasks(s, d).select(F.col("task").alias("dep"), "state"), "dep", "left").select("task", "dep", "state")


# upkeep


@add("rm04_global_rows", "SELECT doc_id, 'global:demo:' || source AS source, 'demo' AS project_name FROM documents")
def rm04(s, d):
    return upkeep.enriched(V.table(s, d, "documents"), "demo").select("doc_id", "source", "project_name")


@add("rm05_register_projects", "SELECT n_name AS name, n_regionkey AS version, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS path FROM nation WHERE n_nationkey % 4 <> 0")
def rm05(s, d):
    n = V.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("version"), F.lit("old").alias("path"), "n_nationkey")
    now = tables.upserted(n, n.filter("version = 1").withColumn("path", F.lit("new")), ["name"], "version")
    return tables.deleted(now, n.filter("n_nationkey % 4 = 0"), "name").select("name", "version", "path")


@add("rm06_project_list", "SELECT count(*) AS n, array_to_string(list(n_name ORDER BY n_name), ',') AS names FROM nation")
def rm06(s, d):
    return V.table(s, d, "nation").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@add("rm07_unknown_contents", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def rm07(s, d):
    h = V.table(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return h.join(h.filter("doc_id % 2 = 0").select("h"), "h", "left_anti").select("doc_id")


@add("rm08_task_results", "SELECT conv_id, turn, 'Task: ' || role || chr(10) || 'Result: ' || left(text, 200) AS content FROM conversations")
def rm08(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Task: "), "role", F.lit("\nResult: "), F.left("text", F.lit(200))).alias("content"))


@add("rm09_access_counts", "SELECT c_custkey AS id, count(event_id) AS accesses, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last_accessed FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def rm09(s, d):
    log = V.table(s, d, "events").select(F.col("user_id").alias("id"), "ts")
    return upkeep.accessed(V.table(s, d, "customer").select(F.col("c_custkey").alias("id")), log).select("id", "accesses", F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss").alias("last_accessed"))


@add("rm10_needs_retrieval", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value / 100 < 0.7 ELSE value / 100 < 0.3 OR value / 50 > 1.5 END AS needed FROM events")
def rm10(s, d):
    v = F.col("value")
    return V.table(s, d, "events").select("event_id", upkeep.needs_retrieval(F.when(F.col("event_id") % 3 == 0, v / 100), v / 100, v / 50).alias("needed"))


@add("rm11_triple_json", "SELECT event_id, event_type AS relation, value AS confidence FROM events")
def rm11(s, d):
    text = F.to_json(F.struct(F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("relation"), F.col("value").alias("confidence")))
    back = F.from_json(text, "subject string, relation string, confidence double")
    return V.table(s, d, "events").select("event_id", back["relation"].alias("relation"), back["confidence"].alias("confidence"))


@add("rm13_last_n", f"SELECT id FROM ({V.ENTRIES}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 5")
def rm13(s, d):
    return windows.newest(V.entries(s, d), "session_id", "id", 5).select("id")


@add("rm14_partial_batches", f"SELECT session_id, count(*) % 5 AS waiting FROM ({V.ENTRIES}) GROUP BY session_id HAVING count(*) % 5 > 0")
def rm14(s, d):
    return windows.batches(V.entries(s, d), "session_id", "id", 5).filter("not complete").groupBy("session_id").agg(F.count("*").alias("waiting"))


@add("rm01_generic_memory", f"SELECT memory_type, source, count(*) AS n FROM (SELECT memory_type, 'chat' AS source FROM ({V.MEMORIES}) UNION ALL SELECT 'generic', source FROM documents) GROUP BY ALL")
def rm01(s, d):
    own = V.memories(s, d).select("id", "content", "memory_type", F.lit("chat").alias("source"))
    new = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.lit("generic").alias("memory_type"), "source")
    return tables.appended(own, new).groupBy("memory_type", "source").agg(F.count("*").alias("n"))


@add("rm02_repo_and_index_stats", f"SELECT (SELECT count(*) FROM ({V.COMMITS})) AS commits, (SELECT count(DISTINCT author) FROM ({V.COMMITS})) AS authors, (SELECT count(DISTINCT path) FROM ({V.FILES})) AS files, (SELECT count(*) FROM ({V.SYMBOLS})) AS symbols, (SELECT max(strftime(stamp, '%Y-%m-%d')) FROM ({V.COMMITS})) AS last")
def rm02(s, d):
    c = V.commits(s, d).agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"), F.max(F.date_format("stamp", "yyyy-MM-dd")).alias("last"))
    f = V.commit_files(s, d).agg(F.count_distinct("path").alias("files"))
    return c.join(F.broadcast(f), F.lit(True)).join(F.broadcast(V.symbols(s, d).agg(F.count("*").alias("symbols"))), F.lit(True)).select("commits", "authors", "files", "symbols", "last")  # one row each


@add("rm12_index_state", "SELECT l_partkey AS path, max(l_linenumber) AS version, CAST(sum(l_quantity) AS DOUBLE) AS size FROM lineitem GROUP BY 1")
def rm12(s, d):
    """Nothing yet, then rows as JSON and back."""
    kinds = "path long, version int, size double"
    rows = V.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_linenumber").cast("int").alias("version"), F.sum("l_quantity").cast("double").alias("size"))
    at = folder(s, "state")
    state = tables.load_or_new(s, at, kinds)
    tables.write_snapshot(tables.as_json(state.union(rows)), at)
    return tables.of_json(tables.load_or_new(s, at, "json string"), kinds)


LATE = f"CAST(len(list_intersect({WORDS}, ['the', 'in', 'of', 'that'])) AS INT)"


@add("rm15_long_term_keywords", f"SELECT id, {LATE} AS overlap FROM ({V.MEMORIES}) WHERE memory_type = 'user' AND {LATE} > 0 ORDER BY {LATE} DESC, id LIMIT 10")
def rm15(s, d):
    return composite.long_term(V.memories(s, d).filter("memory_type = 'user'"), "the in of that").select("id", "overlap")


@add("rm15_long_term_vectors", f"SELECT vec_id AS id, round(1 - {DIST} / 2, 6) AS score FROM embeddings e, {Q0} ORDER BY {DIST}, vec_id LIMIT 10")
def rm15_vectors(s, d):
    return composite.long_term(_vectors(s, d), query_vector=_query(s, d)).select("id", _r("score"))


@add("rm16_recent_text", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY nth DESC) AS age FROM ({V.MEMORIES})),
 p AS (SELECT *, CAST(len(list_intersect({WORDS}, ['recent'])) AS INT) AS o FROM m WHERE age > 2 AND age <= 52),
 x AS (SELECT session_id, 0 AS later, age AS pos, '[Current] ' || content AS line FROM m WHERE age <= 2 UNION ALL SELECT session_id, 1, 0, chr(10) || '--- Recent History ---' || chr(10) FROM m WHERE age = 1
  UNION ALL SELECT session_id, 2, row_number() OVER (PARTITION BY session_id ORDER BY o DESC, id) AS pos, '[Previous] ' || left(content, 300) || '...' FROM p QUALIFY pos <= 3)
 SELECT session_id, array_to_string(list(line ORDER BY later, pos), chr(10) || chr(10)) AS text FROM x GROUP BY session_id""")
def rm16(s, d):
    return upkeep.recent_text(V.memories(s, d), working=2)


@add("rm17_tier_sizes", f"""WITH n AS (SELECT session_id, count(*) AS n FROM ({V.ENTRIES}) GROUP BY 1), b AS (SELECT *, greatest(n - 2, 0) // 2 AS batches FROM n), m AS (SELECT *, CASE WHEN batches >= 4 THEN ((batches - 4) // 2 + 1) * 2 ELSE 0 END AS moved FROM b)
 SELECT session_id, least(n, 2) AS working, greatest(n - 2, 0) % 2 AS waiting, batches - moved AS short_term, moved AS long_term FROM m""")
def rm17(s, d):
    n = V.entries(s, d).groupBy("session_id").agg(F.count("*").alias("n"))
    return n.select("session_id", *(c.alias(k) for k, c in upkeep.tier_sizes(F.col("n"), 2, 2, 4, 0.5).items()))


@add("rm21_injected_segments", "WITH t AS (SELECT item_id AS id, range(0, length(text)) AS t FROM benchmark), x AS (SELECT id, t, unnest(range(0, len(t), 192)) AS p FROM t) SELECT id, p // 192 AS segment, list_concat(CASE WHEN p > 0 THEN t[greatest(least(p + 64, len(t)) - 16, 0) + 1:least(p + 64, len(t))] ELSE [] END, list_concat(t[p + 1:p + 256], list_transform(range(0, greatest(p + 256 - len(t), 0)), lambda i: 0))) AS input FROM x")
def rm21(s, d):
    tokens = V.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.when(F.length("text") > 0, F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1)).otherwise(F.array().cast("array<bigint>")).alias("tokens"))
    return windows.injected(windows.segments(tokens, "id", "tokens", 256, 64), "id", 16).select("id", F.col("segment").cast("long").alias("segment"), "input")


@add("rm25_captured_output", f"SELECT id, 'agent' AS source, 'thought' AS memory_type, 'planning' AS context FROM ({V.MEMORIES})")
def rm25(s, d):
    return upkeep.captured(V.memories(s, d).select("id", "content"), "thought", "agent", "planning").select("id", "source", "memory_type", "context")


@add("rm37_fingerprint_stats", f"WITH {SIG}, h AS (SELECT item_id, left(sha256(array_to_string(sig, ',')), 16) AS hash FROM sig) SELECT count(DISTINCT hash) AS fingerprints, (SELECT count(DISTINCT word) FROM ({keywords_sql('benchmark', 'item_id')})) AS keywords FROM h")
def rm37(s, d):
    own = sessions.fingerprints(V.table(s, d, "benchmark"), "item_id", "text")
    kept = tables.upserted(own.limit(0), own, ["hash"], "id")
    return kept.agg(F.count("*").alias("fingerprints")).join(F.broadcast(sessions.keywords(V.table(s, d, "benchmark"), "item_id", "text").agg(F.count_distinct("word").alias("keywords"))), F.lit(True))


@add("rm18_success_rate", "SELECT c_custkey AS id, round(CASE WHEN count(event_id) = 0 THEN 0.5 ELSE count(*) FILTER (event_type <> 'error') / count(event_id)::DOUBLE END, 6)::DOUBLE AS rate FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def rm18(s, d):
    e = V.table(s, d, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    g = V.table(s, d, "customer").join(e, "c_custkey", "left").groupBy(F.col("c_custkey").alias("id")).agg(F.count("event_id").alias("n"), F.count_if(F.col("event_type") != "error").alias("good"))
    return g.select("id", F.round(upkeep.success_rate(F.col("good"), F.col("n")), 6).alias("rate"))


@add("rm19_sources", "SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def rm19(s, d):
    return V.table(s, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@add("rm22_segment_stats", "SELECT sum((n_chars + 1919) // 1920)::BIGINT AS segments, sum(n_chars)::BIGINT AS tokens FROM documents")
def rm22(s, d):
    return V.table(s, d, "documents").agg(F.sum(windows.segment_count(F.col("n_chars"), 2048, 128)).alias("segments"), F.sum("n_chars").alias("tokens"))


@add("rm23_early_stopping", """WITH RECURSIVE e AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 r(user_id, k, event_id, best, bad) AS (SELECT user_id, k, event_id, value, 0 FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id, least(r.best, e.value), CASE WHEN e.value < r.best THEN 0 ELSE r.bad + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 WHERE r.bad < 2)
 SELECT user_id, event_id FROM r""")
def rm23(s, d):
    return upkeep.early_stopped(V.table(s, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id")


@add("rm29_cancelled_tasks", f"WITH RECURSIVE d AS ({V.DEPS}), t AS ({V.TASKS}), g(task) AS (SELECT task FROM t WHERE state = 'failed' UNION SELECT d.task FROM g JOIN d ON d.dep = g.task) SELECT task FROM g WHERE task NOT IN (SELECT task FROM t WHERE state = 'failed')")
def rm29(s, d):
    return upkeep.cancelled(V.tasks(s, d), V.deps(s, d))


@add("rm31_graph_export", f"SELECT task, array_to_string(list(dep ORDER BY dep), ',') AS deps FROM ({V.DEPS}) GROUP BY task")
def rm31(s, d):
    return V.deps(s, d).groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dep")), lambda x: x.cast("string")), ",").alias("deps"))


@add("rm32_current_phase", LEVELS + " SELECT min(level) AS phase FROM l JOIN t ON t.task = l.task WHERE state <> 'completed'")
def rm32(s, d):
    return graph.levels(V.tasks(s, d), V.deps(s, d)).join(V.tasks(s, d), "task").filter("state <> 'completed'").agg(F.min("level").alias("phase"))


@add("rm34_time_left", f"SELECT id, round(greatest(0, 300 - date_diff('microsecond', created_at, TIMESTAMP '2024-01-15 00:00:00') / 1e6), 3)::DOUBLE AS seconds FROM ({V.ENTRIES}) WHERE created_at <= TIMESTAMP '2024-01-15 00:00:00'")
def rm34(s, d):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return V.entries(s, d).filter(F.col("created_at") <= at).select("id", F.round(upkeep.time_left(F.col("created_at"), at), 3).alias("seconds"))


@add("rm35_session_interventions", f"SELECT id, memory_type FROM ({V.ENTRIES}) WHERE session_id = 8 AND memory_type = 'error' ORDER BY created_at DESC LIMIT 20")
def rm35(s, d):
    return V.entries(s, d).filter("session_id = 8 and memory_type = 'error'").orderBy(F.desc("created_at")).limit(20).select("id", "memory_type")


KINDS = "(['read', 'delete', 'write', 'drop', 'undelete', 'DROP'])[CAST(o_orderkey % 6 AS INT) + 1]"


@add("rm36_default_policies", f"SELECT o_orderkey, {KINDS} AS operation_type, {KINDS} IN ('delete', 'drop') AS destructive_ops, o_totalprice / 1000 > 100 AS expensive_ops, o_orderkey % 5 > 3 AS error_escalation FROM orders")
def rm36(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("read", "delete", "write", "drop", "undelete", "DROP"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = V.table(s, d, "orders").select("o_orderkey", kind.alias("operation_type"), (F.col("o_totalprice") / 1000).alias("estimated_cost"), (F.col("o_orderkey") % 5).alias("error_count"))
    return rows.select("o_orderkey", "operation_type", *(search.any_condition(c).alias(n) for n, c in upkeep.POLICIES.items()))


@add("rm38_mark_explored", "SELECT user_id AS session_id, event_type AS explorer, max(event_id) AS version FROM events GROUP BY 1, 2")
def rm38(s, d):
    e = V.table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("explorer"), F.col("event_id").alias("version"))
    return tables.upserted(e.limit(0), e, ["session_id", "explorer"], "version")


@add("rm39_point_lookup", "SELECT event_id, event_type FROM events WHERE event_id = 77")
def rm39(s, d):
    return V.table(s, d, "events").filter(tables.condition_on("event_id", 77)).select("event_id", "event_type")


@add("rm41_qrels_from_tags", "SELECT q.label AS tag, count(*) AS items FROM (SELECT DISTINCT label FROM embeddings) q JOIN embeddings e ON e.label = q.label GROUP BY 1")
def rm41(s, d):
    e = V.table(s, d, "embeddings")
    return e.select("label").distinct().join(e.select("label", "vec_id"), "label").groupBy(F.col("label").alias("tag")).agg(F.count("*").alias("items"))


@add("sc02_keyword_score", "SELECT conv_id AS session_id, round(sum(len(list_intersect(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3)), ['erer', 'inst'])) / 2.0::DOUBLE), 6) AS score FROM conversations GROUP BY conv_id")
def sc02(s, d):
    words = sessions.query_words("erer inst")
    hits = F.size(F.array_intersect(T.score_words(F.col("content")), T.strings(words)))
    return V.memories(s, d).groupBy("session_id").agg(F.round(S.keyword_score(F.sum(hits), F.lit(len(words))), 6).alias("score"))


@add("sc04_project_bonus", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 1.0 ELSE 0.0 END + CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0.3 END::DOUBLE AS bonus FROM nation")
def sc04(s, d):
    folder = F.when(F.col("n_nationkey") % 2 == 0, "/a/b/").otherwise("/a/b/c")
    bonus = S.project_bonus(F.col("n_regionkey").cast("string"), F.lit("2"), T.path_bonus(F.lit("/a/b"), folder))
    return V.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), bonus.alias("bonus"))


@add("st02_state_upsert", "SELECT l_partkey AS path, max(l_linenumber) AS version FROM lineitem GROUP BY 1")
def st02(s, d):
    f = V.table(s, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("version"))
    return tables.upserted(f.filter("version < 4"), f.filter("version >= 4"), ["path"], "version").select("path", "version")


@add("st04_reset_state", "SELECT event_id FROM events WHERE event_type <> 'click'")
def st04(s, d):
    e = V.table(s, d, "events").select("event_id", "event_type")
    return tables.deleted(e, e.filter("event_type = 'click'"), "event_id").select("event_id")


@add("snk11_delete_document", "SELECT doc_id FROM documents WHERE source <> 'src1'")
def snk11(s, d):
    x = V.table(s, d, "documents").select("doc_id", "source")
    return tables.deleted(x, x.filter("source = 'src1'"), "doc_id").select("doc_id")


@add("snk07_keyed_json", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def snk07(s, d):
    e = V.table(s, d, "events").select(F.to_json(F.struct("user_id", "event_id")).alias("j")).select(F.from_json("j", "user_id long, event_id long").alias("r")).select("r.*")
    return tables.upserted(e.limit(0), e, ["user_id"], "event_id")


@add("ev07_average_precision", LIST + " SELECT query_id, round(ap, 6) AS ap FROM m")
def ev07(s, d):
    return evaluate.whole_list(V.runs(s, d), V.qrels(s, d)).select("query_id", _r("ap"))


@add("gr02_ancestors_of_one", WALK + " SELECT task, count(*) AS n FROM c GROUP BY task")
def gr02(s, d):
    return graph.closure(V.deps(s, d)).groupBy("task").agg(F.count("*").alias("n"))


@add("top10_budget_function", f"SELECT id, session_id, CAST(sum(length(content) // 4) OVER (PARTITION BY session_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ({V.MEMORIES}) QUALIFY upto <= 400")
def top10_function(s, d):
    """The budget as a table function with a partition for each session."""
    registered.register(s)
    rows = V.memories(s, d).select("id", "session_id", "nth", F.floor(F.length("content") / 4).cast("long").alias("cost"))
    return s.sql("SELECT id, session_id, upto FROM within_budget(TABLE({rows}) PARTITION BY (session_id) ORDER BY (nth), 'cost', 400)", rows=rows)


@add("agg09_percentile_function", "SELECT event_type, list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p95 FROM events GROUP BY event_type")
def agg09_function(s, d):
    """A grouped aggregate for metrics of one's own."""
    registered.register(s)
    return s.sql("SELECT event_type, latency_at(value, 0.95D) AS p95 FROM {e} GROUP BY event_type", e=V.table(s, d, "events"))
