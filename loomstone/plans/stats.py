"""Queries of aggregates, ordered computations, evaluation, graphs and state, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import evaluate, graph, sessions, tables, windows
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


def _r(c, n=6):
    return F.round(c, n).alias(c)


def _n(c):
    return F.col(c).cast("long").alias(c)


AGE = f"date_diff('microsecond', created_at, TIMESTAMP '{V.AS_OF}')"


@add("agg01_store_stats", f"SELECT 'all' AS kind, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ({V.ENTRIES}) UNION ALL SELECT memory_type, count(*), count(DISTINCT session_id) FROM ({V.ENTRIES}) GROUP BY memory_type")
def agg01(s, d):
    e = V.entries(s, d)
    cols = [F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions")]
    return e.agg(F.lit("all").alias("kind"), *cols).union(e.groupBy(F.col("memory_type").alias("kind")).agg(*cols))


@add("agg02_repo_stats", f"WITH last AS (SELECT * FROM ({V.COMMITS}) ORDER BY stamp DESC, hash LIMIT 1000), t AS (SELECT count(*) AS total FROM ({V.COMMITS})) SELECT author, count(*) AS n, any_value(total) AS total FROM last, t GROUP BY author ORDER BY n DESC, author LIMIT 5")
def agg02(s, d):
    c = V.commits(s, d)
    total = V.table(s, d, "orders").join(V.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("total"))
    top = c.orderBy(F.desc("stamp"), "hash").limit(1000).groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(5)
    return top.join(F.broadcast(total), F.lit(True))


@add("agg03_file_summary", f"SELECT path, count(*) FILTER (symbol_type = 'small') AS small, count(*) FILTER (symbol_type = 'economy') AS economy, array_to_string(list(name ORDER BY name, id), ',') AS names FROM ({V.SYMBOLS}) GROUP BY path")
def agg03(s, d):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "id"))), lambda x: x["name"]), ",")
    return V.symbols(s, d).groupBy("path").agg(F.count_if(F.col("symbol_type") == "small").alias("small"), F.count_if(F.col("symbol_type") == "economy").alias("economy"), names.alias("names"))


@add("agg04_context_summary", "SELECT conv_id, string_agg(role || ': ' || n, ', ' ORDER BY role) AS summary FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def agg04(s, d):
    n = V.table(s, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return n.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("role", F.lit(": "), F.col("n").cast("string")))), ", ").alias("summary"))


@add("agg05_term_counts", "SELECT item_id, t AS token, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS t FROM benchmark) GROUP BY ALL")
def agg05(s, d):
    return V.table(s, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("n"))


@add("agg07_all_keywords", "SELECT DISTINCT t AS word FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM conversations)")
def agg07(s, d):
    from ..functions.text import plain_words

    return V.table(s, d, "conversations").select(F.explode(plain_words(F.col("text"))).alias("word")).distinct()


@add("agg08_exploration_stats", f"SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT content) AS decisions, round(avg(length(content)), 6) AS mean_chars, max(nth) AS deepest FROM ({V.MEMORIES})")
def agg08(s, d):
    return V.memories(s, d).agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("content").alias("decisions"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"), F.max("nth").alias("deepest"))


@add("agg09_latency_by_index", "SELECT event_type AS kind, count(*) AS runs, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95, CASE WHEN count(*) >= 100 THEN list_sort(list(value))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] ELSE max(value) END AS p99, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest FROM events GROUP BY event_type")
def agg09(s, d):
    return evaluate.latency(V.table(s, d, "events").withColumnRenamed("event_type", "kind"), "kind", "value").withColumn("mean", F.round("mean", 6))


@add("agg11_retrieval_history", "WITH q AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS good, avg(value) AS latency FROM events GROUP BY user_id) SELECT sum(n)::BIGINT AS total, round(sum(good) / sum(n)::DOUBLE, 9) AS success_rate, round(avg(latency), 6) AS mean_latency FROM q")
def agg11(s, d):
    q = V.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("good"), F.avg("value").alias("latency"))
    return q.agg(F.sum("n").alias("total"), F.round(F.sum("good") / F.sum("n"), 9).alias("success_rate"), F.round(F.avg("latency"), 6).alias("mean_latency"))


@add("agg12_latency_ema", "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, x: 0.7 * a + 0.3 * x), 6) AS ema FROM events GROUP BY user_id")
def agg12(s, d):
    return windows.ema(V.table(s, d, "events"), "user_id", "value", F.col("ts"), F.col("event_id")).select("user_id", F.round("ema", 6).alias("ema"))


@add("agg13_layer_stats", f"SELECT session_id, count(*) AS size, round(count(*) / 50.0::DOUBLE, 6) AS utilisation, count(*) FILTER (length(content) > 9) AS compressed FROM ({V.ENTRIES}) GROUP BY session_id")
def agg13(s, d):
    return V.entries(s, d).groupBy("session_id").agg(F.count("*").alias("size"), F.round(F.count("*") / 50, 6).alias("utilisation"), F.count_if(F.length("content") > 9).alias("compressed"))


@add("agg15_stage_metrics", "SELECT o_orderpriority AS stage, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS greatest, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY 1")
def agg15(s, d):
    return V.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("greatest"), F.max_by("o_totalprice", "o_orderkey").alias("last"))


@add("agg16_run_summary", "SELECT count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) AS total, round(avg(o_totalprice), 4) AS mean FROM orders")
def agg16(s, d):
    return V.table(s, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("ok"), F.count_if(F.col("o_orderstatus") != "F").alias("failed"), F.count("*").alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@add("agg17_index_counts", f"SELECT count(DISTINCT path) AS files, count(DISTINCT hash) AS commits FROM ({V.FILES})")
def agg17(s, d):
    return V.commit_files(s, d).agg(F.count_distinct("path").alias("files"), F.count_distinct("hash").alias("commits"))


@add("agg18_progress", f"SELECT role, avg(CASE WHEN state IN ('completed', 'failed', 'cancelled') THEN 1.0 ELSE 0.0 END)::DOUBLE AS progress FROM ({V.TASKS}) GROUP BY role")
def agg18(s, d):
    return V.tasks(s, d).groupBy("role").agg(F.avg(F.when(F.col("state").isin("completed", "failed", "cancelled"), 1.0).otherwise(0.0)).alias("progress"))


@add("flt07_importance_gate", f"SELECT id, round(importance * exp(-({AGE} / 1e6 / 3600) / 168) + least(accesses * 0.1::DOUBLE, 0.5), 6) AS effective FROM ({V.ENTRIES}) WHERE importance * exp(-({AGE} / 1e6 / 3600) / 168) + least(accesses * 0.1::DOUBLE, 0.5) >= 0.3")
def flt07(s, d):
    e = S.effective_importance(F.col("importance"), F.col("created_at"), F.col("accesses"), V.as_of())
    return V.entries(s, d).withColumn("effective", e).filter("effective >= 0.3").select("id", _r("effective"))


SQL["sc05_effective_importance"] = SQL["flt07_importance_gate"].split(" WHERE ")[0]


@add("sc05_effective_importance", SQL["sc05_effective_importance"])
def sc05(s, d):
    return V.entries(s, d).select("id", F.round(S.effective_importance(F.col("importance"), F.col("created_at"), F.col("accesses"), V.as_of()), 6).alias("effective"))


@add("flt08_retention", f"SELECT id FROM ({V.ENTRIES}) WHERE created_at > TIMESTAMP '2024-02-13 00:00:00' - INTERVAL 30 DAY OR importance > 0.7")
def flt08(s, d):
    cut = F.lit("2024-02-13 00:00:00").cast("timestamp") - F.expr("INTERVAL 30 DAYS")
    return V.entries(s, d).filter((F.col("created_at") > cut) | (F.col("importance") > 0.7)).select("id")


@add("flt09_confident_triples", "SELECT l_orderkey AS subject, l_returnflag AS relation, l_partkey AS object, 1 - l_discount * 10 AS confidence FROM lineitem WHERE 1 - l_discount * 10 >= 0.75")
def flt09(s, d):
    return V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("object"), (1 - F.col("l_discount") * 10).alias("confidence")).filter("confidence >= 0.75")


@add("st12_expired_interventions", f"SELECT id, session_id FROM ({V.ENTRIES}) WHERE memory_type = 'error' AND created_at + INTERVAL 300 SECOND < TIMESTAMP '2024-01-15 00:00:00'")
def st12(s, d):
    return V.entries(s, d).filter((F.col("memory_type") == "error") & (F.col("created_at") + F.expr("INTERVAL 300 SECONDS") < F.lit("2024-01-15").cast("timestamp"))).select("id", "session_id")


@add("win03_first_decisions", f"SELECT id FROM ({V.MEMORIES}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY nth) <= 3")
def win03(s, d):
    return windows.first_n(V.memories(s, d), "session_id", "nth", 3).select("id")


@add("win04_until_indexed", f"WITH c AS (SELECT *, hash % 97 = 5 AS known FROM ({V.COMMITS})) SELECT hash FROM (SELECT hash, max(known::INT) OVER (ORDER BY stamp DESC, hash ROWS UNBOUNDED PRECEDING) AS met FROM c) WHERE met = 0")
def win04(s, d):
    return windows.until_known(V.commits(s, d).withColumn("known", F.col("hash") % 97 == 5), "known", "stamp", "hash", descending=("stamp",)).select("hash")


@add("win05_working_memory", f"SELECT id, session_id FROM ({V.ENTRIES}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 10")
def win05(s, d):
    return windows.newest(V.entries(s, d), "session_id", "id", 10).select("id", "session_id")


@add("win06_compression_batches", f"SELECT session_id, batch, count(*) AS n, min(id) AS first FROM (SELECT id, session_id, (row_number() OVER (PARTITION BY session_id ORDER BY id) - 1) // 5 AS batch FROM ({V.ENTRIES})) GROUP BY ALL HAVING count(*) = 5")
def win06(s, d):
    return windows.batches(V.entries(s, d), "session_id", "id", 5).filter("complete").groupBy("session_id", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first"))


WINDOWS = f"""WITH RECURSIVE e AS (SELECT id, session_id, created_at, importance, memory_type, content, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS k FROM ({V.ENTRIES})),
 w(session_id, k, id, start, win) AS (SELECT session_id, k, id, created_at, 0 FROM e WHERE k = 1 UNION ALL SELECT e.session_id, e.k, e.id, CASE WHEN e.created_at - w.start > INTERVAL 24 HOUR THEN e.created_at ELSE w.start END, CASE WHEN e.created_at - w.start > INTERVAL 24 HOUR THEN w.win + 1 ELSE w.win END FROM w JOIN e ON e.session_id = w.session_id AND e.k = w.k + 1)"""


@add("win07_anchored_windows", WINDOWS + ' SELECT session_id, id, win AS "window" FROM w')
def win07(s, d):
    return windows.anchored_windows(V.entries(s, d), "session_id", "created_at", "id", 24).select("session_id", "id", "window")


@add("agg14_consolidated", WINDOWS + """ SELECT w.session_id, win AS "window", count(*) AS merged_count, max(importance) AS importance, arg_max(memory_type, (importance, -w.id)) AS kind, array_to_string(list(w.id ORDER BY e.id), ',') AS ids FROM w JOIN e ON e.id = w.id GROUP BY ALL HAVING count(*) >= 4""")
def agg14(s, d):
    e = V.entries(s, d)
    own = windows.anchored_windows(e, "session_id", "created_at", "id", 24)
    return windows.consolidated(e.join(own.drop("session_id"), "id"), ["session_id", "window"], "content", "importance", "memory_type", "id", "id").select("session_id", "window", "merged_count", "importance", "kind", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@add("top12_flush_oldest", f"SELECT id FROM ({V.ENTRIES}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id) <= floor(count(*) OVER (PARTITION BY session_id) * 0.3)")
def top12(s, d):
    return windows.oldest_share(V.entries(s, d), "session_id", "id", 0.3).filter("flush").select("id")


@add("top11_evict_history", f"SELECT id FROM ({V.ENTRIES}) QUALIFY NOT (count(*) OVER () > 1000 AND row_number() OVER (ORDER BY id) <= floor(count(*) OVER () * 0.25))")
def top11(s, d):
    e = V.entries(s, d)
    n = e.count()
    if n <= 1000:
        return e.select("id")
    return e.select("id").join(e.select("id").orderBy("id").limit(int(n * 0.25)), "id", "left_anti")


@add("ev01_metrics_at_k", f"""WITH q AS ({V.QRELS}), r AS ({V.RUNS}), k AS (SELECT unnest([1, 3, 5, 10]) AS k), rel AS (SELECT query_id, count(*) FILTER (relevance >= 0.5) AS relevant FROM q GROUP BY 1),
 j AS (SELECT r.query_id, rank, r.item_id, coalesce(relevance, 0) AS rel FROM r LEFT JOIN q ON q.query_id = r.query_id AND q.item_id = r.item_id),
 got AS (SELECT query_id, k, count(DISTINCT CASE WHEN rel >= 0.5 THEN item_id END) AS found, avg(CASE WHEN rel >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS p, sum(rel / log2(rank + 1)) AS dcg FROM j, k WHERE rank <= k GROUP BY 1, 2),
 best AS (SELECT query_id, k, sum(relevance / log2(n + 1)) AS idcg FROM (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, item_id) AS n FROM q), k WHERE n <= k GROUP BY 1, 2),
 m AS (SELECT best.query_id, best.k, coalesce(CASE WHEN relevant > 0 THEN found / relevant::DOUBLE END, 0) AS recall, CASE WHEN relevant > 0 THEN coalesce(p, 0) ELSE 0 END AS precision, coalesce(dcg, 0) AS dcg, coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0) AS ndcg FROM best JOIN rel USING (query_id) LEFT JOIN got ON got.query_id = best.query_id AND got.k = best.k)
 SELECT query_id, k, round(recall, 6) AS recall, round(m.precision, 6) AS precision, round(coalesce(CASE WHEN m.precision + m.recall > 0 THEN 2 * m.precision * m.recall / (m.precision + m.recall) END, 0), 6) AS f1, round(dcg, 6) AS dcg, round(ndcg, 6) AS ndcg FROM m""")
def ev01(s, d):
    return evaluate.at_k(V.runs(s, d), V.qrels(s, d)).select("query_id", "k", *(_r(c) for c in ("recall", "precision", "f1", "dcg", "ndcg")))


LIST = f"""WITH q AS ({V.QRELS}), r AS ({V.RUNS}), rel AS (SELECT query_id, count(*) FILTER (relevance >= 0.5) AS relevant FROM q GROUP BY 1),
 j AS (SELECT r.query_id, rank, coalesce(relevance, 0) >= 0.5 AS hit FROM r LEFT JOIN q ON q.query_id = r.query_id AND q.item_id = r.item_id),
 h AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM j),
 g AS (SELECT query_id, min(CASE WHEN hit THEN rank END) AS first, sum(CASE WHEN hit THEN hits / rank::DOUBLE END) AS s FROM h GROUP BY 1),
 m AS (SELECT rel.query_id, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(CASE WHEN relevant > 0 THEN s / relevant END, 0) AS ap FROM rel LEFT JOIN g ON g.query_id = rel.query_id)"""


@add("ev06_mrr_ap", LIST + " SELECT query_id, round(mrr, 6) AS mrr, round(ap, 6) AS ap FROM m")
def ev06(s, d):
    return evaluate.whole_list(V.runs(s, d), V.qrels(s, d)).select("query_id", _r("mrr"), _r("ap"))


@add("ev08_map", LIST + " SELECT round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap FROM m")
def ev08(s, d):
    return evaluate.macro(evaluate.whole_list(V.runs(s, d), V.qrels(s, d))).select(_r("mrr"), _r("ap"))


@add("agg10_macro_average", SQL["ev01_metrics_at_k"].split(" SELECT query_id, k, round(recall")[0] + " SELECT k, round(avg(recall), 6) AS recall, round(avg(m.precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY k")
def agg10(s, d):
    return evaluate.macro(evaluate.at_k(V.runs(s, d), V.qrels(s, d)), "k").select("k", _r("recall"), _r("precision"), _r("ndcg"))


@add("gr01_dependents", f"SELECT dep AS task, count(*) AS dependents FROM ({V.DEPS}) GROUP BY dep")
def gr01(s, d):
    return V.deps(s, d).groupBy(F.col("dep").alias("task")).agg(F.count("*").alias("dependents"))


WALK = f"WITH RECURSIVE d AS ({V.DEPS}), c(task, dep) AS (SELECT task, dep FROM d UNION SELECT c.task, d.dep FROM c JOIN d ON c.dep = d.task)"


@add("gr02_closure", WALK + " SELECT task, dep FROM c")
def gr02(s, d):
    return graph.closure(V.deps(s, d))


@add("gr03_ready", f"WITH d AS ({V.DEPS}), t AS ({V.TASKS}) SELECT task, role, state FROM t WHERE state = 'pending' AND NOT EXISTS (SELECT 1 FROM d WHERE d.task = t.task AND d.dep NOT IN (SELECT task FROM t WHERE state = 'completed'))")
def gr03(s, d):
    return graph.ready(V.tasks(s, d), V.deps(s, d))


LEVELS = f"WITH RECURSIVE d AS ({V.DEPS}), t AS ({V.TASKS}), walk(task, level) AS (SELECT task, 0 FROM t UNION SELECT d.task, w.level + 1 FROM walk w JOIN d ON d.dep = w.task), l AS (SELECT task, max(level) AS level FROM walk GROUP BY task)"


LOOPS = "SELECT task, dep FROM d UNION SELECT 2, 5 UNION SELECT 1, 6 UNION SELECT 7, 7"


@add("gr04_cycles", f"WITH RECURSIVE d AS ({V.DEPS}), e AS ({LOOPS}), walk(start, last, path, closed) AS (SELECT dep, dep, [dep], false FROM (SELECT DISTINCT dep FROM e) UNION ALL SELECT w.start, e.dep, list_append(w.path, e.dep), e.dep = w.start FROM walk w JOIN e ON e.task = w.last WHERE NOT w.closed AND e.dep >= w.start AND (e.dep = w.start OR NOT list_contains(w.path, e.dep))) SELECT start, array_to_string(path[1:len(path) - 1], ',') AS path FROM walk WHERE closed")
def gr04(s, d):
    e = V.deps(s, d).union(s.createDataFrame([(2, 5), (1, 6), (7, 7)], "task long, dep long")).distinct()
    return graph.cycles(e).select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@add("gr05_topological_sort", LEVELS + " SELECT task, row_number() OVER (ORDER BY level, task) AS nth FROM l")
def gr05(s, d):
    return graph.sorted_topologically(V.tasks(s, d), V.deps(s, d)).select("task", F.col("nth").cast("long").alias("nth"))


@add("gr06_phases", LEVELS + " SELECT level, count(*) AS n, array_to_string(list(task ORDER BY task), ',') AS tasks FROM l GROUP BY level")
def gr06(s, d):
    return graph.levels(V.tasks(s, d), V.deps(s, d)).groupBy("level").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("task")), lambda x: x.cast("string")), ",").alias("tasks"))


@add("gr07_critical_path", LEVELS + ", b AS (SELECT d.task, min(d.dep) AS dep FROM d JOIN l x ON x.task = d.task JOIN l y ON y.task = d.dep AND y.level = x.level - 1 GROUP BY d.task), p(task, nth) AS (SELECT * FROM (SELECT task, level FROM l ORDER BY level DESC, task LIMIT 1) UNION ALL SELECT b.dep, p.nth - 1 FROM p JOIN b ON b.task = p.task) SELECT task, nth FROM p")
def gr07(s, d):
    return graph.critical_path(V.tasks(s, d), V.deps(s, d))


REACH = f"WITH RECURSIVE d AS ({V.DEPS}), e AS ({LOOPS}), c(task, dep) AS (SELECT task, dep FROM e UNION SELECT c.task, e.dep FROM c JOIN e ON c.dep = e.task)"


def _looped(s, d):
    return V.deps(s, d).union(s.createDataFrame([(2, 5), (1, 6), (7, 7)], "task long, dep long")).distinct()


@add("gr04_components", REACH + " SELECT a.task, min(a.dep) AS component FROM c a JOIN c b ON a.task = b.dep AND a.dep = b.task GROUP BY a.task")
def gr04_components(s, d):
    return graph.components(_looped(s, d))


@add("gr04_shortest_cycles", REACH + ", m AS (SELECT a.task, min(a.dep) AS component FROM c a JOIN c b ON a.task = b.dep AND a.dep = b.task GROUP BY a.task), walk(component, last, n) AS (SELECT component, task, 0 FROM m WHERE task = component UNION SELECT w.component, e.dep, w.n + 1 FROM walk w JOIN e ON e.task = w.last JOIN m ON m.task = e.dep AND m.component = w.component WHERE w.n < (SELECT count(*) FROM m) AND (w.n = 0 OR w.last <> w.component)) SELECT component, CAST(min(n) AS INT) AS length FROM walk WHERE n > 0 AND last = component GROUP BY component")
def gr04_shortest(s, d):
    return graph.shortest_cycles(_looped(s, d)).select("component", F.size("path").alias("length"))


@add("gr08_capacity_phases")
def gr08(s, d):
    return graph.scheduled(V.tasks(s, d), V.deps(s, d), {"role0": 2, "role1": 3})


@add("gr09_bottlenecks", LEVELS + " SELECT 'high_fanout' AS type, dep AS task, count(*) AS n FROM d GROUP BY dep HAVING count(*) > 3 UNION ALL SELECT 'long_chain', NULL, max(level) + 1 FROM l HAVING max(level) + 1 > 5")
def gr09(s, d):
    return graph.bottlenecks(V.tasks(s, d), V.deps(s, d))


@add("gr10_suggestions", LEVELS + " SELECT 'agent_scaling' AS type, level AS phase, role, count(*) AS n FROM l JOIN t ON t.task = l.task GROUP BY level, role HAVING count(*) > 2 UNION ALL SELECT 'increase_parallelism', NULL, NULL, count(DISTINCT level) FROM l HAVING count(DISTINCT level) > count(*) / 2")
def gr10(s, d):
    return graph.suggestions(V.tasks(s, d), V.deps(s, d))


@add("gr10_deep_plan", "SELECT 'increase_parallelism' AS type, NULL::INT AS phase, NULL::VARCHAR AS role, count(*) AS n FROM nation")
def gr10_deep(s, d):
    """A chain: each nation waits for the one before."""
    t = V.table(s, d, "nation").select(F.col("n_nationkey").alias("task"), F.lit("role").alias("role"))
    return graph.suggestions(t, t.filter("task > 0").select("task", (F.col("task") - 1).alias("dep")))


@add("rm28_unlocked", f"WITH d AS ({V.DEPS}), t AS ({V.TASKS}) SELECT task FROM t WHERE state = 'pending' AND EXISTS (SELECT 1 FROM d WHERE d.task = t.task AND d.dep IN (2, 3)) AND NOT EXISTS (SELECT 1 FROM d WHERE d.task = t.task AND d.dep NOT IN (SELECT task FROM t WHERE state = 'completed'))")
def rm28(s, d):
    return graph.unlocked(V.tasks(s, d), V.deps(s, d), s.createDataFrame([(2,), (3,)], "task long")).select("task")


@add("rm33_schedule", LEVELS + " SELECT level AS phase, count(*) AS n, count(*) * 2 AS minutes FROM l GROUP BY level")
def rm33(s, d):
    return graph.schedule(V.tasks(s, d), V.deps(s, d))


@add("gr11_duration", f"SELECT role, count(*) * 2 AS minutes FROM ({V.TASKS}) GROUP BY role")
def gr11(s, d):
    return V.tasks(s, d).groupBy("role").agg((F.count("*") * 2).alias("minutes"))


@add("sc07_parallel_factor", LEVELS + " SELECT round(count(*) / count(DISTINCT level)::DOUBLE, 6) AS factor FROM l")
def sc07(s, d):
    return graph.levels(V.tasks(s, d), V.deps(s, d)).agg(F.round(F.count("*") / F.count_distinct("level"), 6).alias("factor"))


SNAP = "(SELECT l_partkey AS path, max(l_linenumber) AS mtime, md5(CAST(max(l_linenumber) // 3 AS VARCHAR)) AS hash FROM lineitem WHERE {w} GROUP BY l_partkey)"


def _snapshot(s, d, where):
    g = V.table(s, d, "lineitem").filter(where).groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_linenumber").alias("mtime"))
    return g.withColumn("hash", F.md5(F.floor(F.col("mtime") / 3).cast("string").cast("binary")))


@add("st01_file_changes", f"SELECT coalesce(k.path, s.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted' WHEN s.mtime > k.mtime AND s.hash <> k.hash THEN 'changed' ELSE 'same' END AS status FROM {SNAP.format(w='l_suppkey % 5 < 3')} k FULL JOIN {SNAP.format(w='l_suppkey % 5 > 0')} s ON k.path = s.path")
def st01(s, d):
    return tables.file_changes(_snapshot(s, d, "l_suppkey % 5 < 3"), _snapshot(s, d, "l_suppkey % 5 > 0"))


@add("st03_commit_state", f"SELECT count(DISTINCT hash) AS total, max(strftime(stamp, '%Y-%m-%d')) AS last, arg_max(hash, (stamp, hash)) AS last_hash FROM (SELECT * FROM ({V.COMMITS}) WHERE hash % 3 = 0 UNION ALL SELECT * FROM ({V.COMMITS}) WHERE hash % 2 = 0)")
def st03(s, d):
    c = V.commits(s, d)
    both = c.filter("hash % 3 = 0").union(c.filter("hash % 2 = 0"))
    return both.agg(F.count_distinct("hash").alias("total"), F.max(F.date_format("stamp", "yyyy-MM-dd")).alias("last"), F.max_by("hash", F.struct("stamp", "hash")).alias("last_hash"))


@add("snk02_delete_ids", f"SELECT id, memory_type FROM ({V.ENTRIES}) WHERE id % 10 <> 0")
def snk02(s, d):
    e = V.entries(s, d)
    return tables.deleted(e, e.filter("id % 10 = 0"), "id").select("id", "memory_type")


@add("snk03_clear_session", f"SELECT count(*) FILTER (session_id = 8) AS cleared, count(*) FILTER (session_id <> 8) AS kept FROM ({V.ENTRIES})")
def snk03(s, d):
    return V.entries(s, d).agg(F.count_if(F.col("session_id") == 8).alias("cleared"), F.count_if(F.col("session_id") != 8).alias("kept"))


@add("snk06_upsert", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def snk06(s, d):
    e = V.table(s, d, "events").select("user_id", "event_type", "event_id", "value")
    return tables.upserted(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@add("snk09_append", f"SELECT id, memory_type FROM ({V.ENTRIES}) WHERE id < 500 UNION ALL SELECT id, memory_type FROM ({V.ENTRIES}) WHERE id >= 500")
def snk09(s, d):
    e = V.entries(s, d).select("id", "memory_type")
    return tables.appended(e.filter("id < 500"), e.filter("id >= 500"))


STAMP = "CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'no time' WHEN conv_id % 5 = 2 THEN '2024-01-1' || (conv_id % 10) || 'T00:00:00Z' ELSE '2024-01-1' || (conv_id % 10) || 'T06:00:00' END"
DECAY = f"CASE WHEN conv_id % 5 < 2 THEN 0.5 ELSE 1 / (1 + date_diff('microsecond', CAST(replace({STAMP}, 'Z', '') AS TIMESTAMP), TIMESTAMP '{V.AS_OF}') / 1e6 / 86400 / 7) END"


def _sessions(s, d):
    day = (F.col("session_id") % 10).cast("string")
    c = F.col("session_id") % 5
    stamp = F.when(c == 0, None).when(c == 1, "no time").when(c == 2, F.concat(F.lit("2024-01-1"), day, F.lit("T00:00:00Z"))).otherwise(F.concat(F.lit("2024-01-1"), day, F.lit("T06:00:00")))
    return V.table(s, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct().withColumn("stamp", stamp).withColumn("project", F.concat(F.lit("p"), F.col("session_id") % 3)).withColumn("folder", F.when(F.col("session_id") % 2 == 0, "/a/b").otherwise("/a/bc"))


@add("sc01_time_decay", f"SELECT DISTINCT conv_id AS session_id, round({DECAY}, 6)::DOUBLE AS decay FROM conversations")
def sc01(s, d):
    return _sessions(s, d).select("session_id", F.round(S.time_decay(F.col("stamp"), V.as_of()), 6).alias("decay"))


SQUERY = "The with of erer inst that there"
Q = "list_value(" + ", ".join(f"'{w}'" for w in sessions.query_words(SQUERY)) + ")"


def _score_sql() -> str:
    from .texts import SCOREW

    words = f"list_distinct({SCOREW})"
    return f"""WITH h AS (SELECT conv_id, sum(len(list_intersect({words}, {Q}))) / {len(sessions.query_words(SQUERY))}::DOUBLE AS kw FROM conversations GROUP BY conv_id),
 sc AS (SELECT conv_id AS session_id, kw, least((kw * 0.3::DOUBLE + (CASE WHEN conv_id % 3 = 1 THEN 1.0 ELSE 0.0 END + CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 0.0 END)) * {DECAY} / 1.3::DOUBLE, 1.0) AS score FROM h)"""


@add("sc03_relevance", _score_sql() + " SELECT session_id, round(kw, 6) AS keyword_score, round(sc.score, 6)::DOUBLE AS score FROM sc")
def sc03(s, d):
    return sessions.relevance(V.memories(s, d), _sessions(s, d), SQUERY, "p1", "/a/b/", V.as_of()).select("session_id", _r("keyword_score"), _r("score"))


@add("cq03_explore_related", _score_sql() + f", m AS (SELECT session_id, id, nth, row_number() OVER (PARTITION BY session_id ORDER BY nth) AS n FROM ({V.MEMORIES})) SELECT sc.session_id, id, round(sc.score, 6)::DOUBLE AS score FROM sc JOIN m ON m.session_id = sc.session_id WHERE n <= 4 AND sc.session_id <> 2 AND sc.score >= 0.1 AND sc.session_id % 7 <> 3 ORDER BY sc.score DESC, sc.session_id, nth LIMIT 25")
def cq03(s, d):
    scores = sessions.relevance(V.memories(s, d), _sessions(s, d), SQUERY, "p1", "/a/b/", V.as_of())
    seen = scores.filter("session_id % 7 = 3").select("session_id")
    return sessions.explored(scores, V.memories(s, d), "2", seen, 0.1, 4, 25).select("session_id", "id", _r("score"))
