"""An inverted index over texts, and many queries in one plan.

Below its folder an index has `postings` (word, id, a row for each distinct word of a
text, in hash buckets of words), `words` (each word's number of texts) and `texts`
(each id with its words).  Searching by shared words needs no scan of the texts:

1. A query's words are ordered from rare to frequent.  Its rarest ones, until they
   meet k texts, give candidates; those are compared whole, and the k-th best has
   `least` words in common.
2. A text that shares `least` of m words has one of the m - least + 1 rarest.  So only the
   posting lists of those are read further; frequent words are compared, not looked up.

The result is that of comparing every query with every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import composite
from .shared import held

BUCKETS = 64


def _bucket(word: str = "word") -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int").alias("bucket")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    """The posting lists; without rows they have no file that tells the schema."""
    id = spark.read.parquet(f"{path}/texts").schema["id"].dataType
    return spark.read.schema(T.StructType([T.StructField("word", T.StringType()), T.StructField("id", id), T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/postings")


def build(rows: DataFrame, path: str, id: str = "id", text: str = "content") -> str:
    """Indexes all rows by the words between white space, lower-cased; null texts have none, ids are distinct.

    A frequent word's list is dealt out over tasks and files of its bucket.
    """
    words = F.array_distinct(X.plain_words(F.col(text)))
    rows.select(F.col(id).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("words")).write.parquet(f"{path}/texts")
    texts = rows.sparkSession.read.parquet(f"{path}/texts")
    listed = texts.select("id", F.explode("words").alias("word")).withColumn("bucket", _bucket())
    listed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{path}/postings")
    _postings(rows.sparkSession, path).groupBy("word").agg(F.count("*").alias("texts")).write.parquet(f"{path}/words")
    return path


def query_words(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, word, texts, nth, m, met): each query's distinct words that stand in some text, the rarest first; met: how many texts the words before hold at most."""
    own = queries.select("query_id", F.explode(F.array_distinct(X.plain_words(F.col("query")))).alias("word")).join(words, "word")
    rare = Window.partitionBy("query_id").orderBy("texts", "word")
    before = F.coalesce(F.sum("texts").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.select("query_id", "word", "texts", F.row_number().over(rare).alias("nth"), F.count("*").over(Window.partitionBy("query_id")).alias("m"), before.alias("met"))


def _compared(candidates: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, id, overlap) of candidates (query_id, id), compared by the numbers of all words that queries ask for."""
    return candidates.join(asked, "query_id").join(texts, "id").select("query_id", "id", F.size(F.array_intersect("numbers", "own")).alias("overlap"))


def _known(postings: DataFrame, words: DataFrame) -> DataFrame:
    """(id, numbers): of every text its words among the queries' (word, number); sets of numbers are compared several times faster than sets of words."""
    return postings.join(words, "word").groupBy("id").agg(F.collect_list("number").alias("numbers"))


def overlap_batch(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, overlap, rank): for every query (query_id, query) the k texts with most words in common, ties by id; texts without a common word are left out."""
    asked_all = held(query_words(queries, spark.read.parquet(f"{path}/words")))
    numbers = held(asked_all.select("word").distinct().withColumn("number", F.monotonically_increasing_id()))
    buckets = [r.bucket for r in asked_all.select(_bucket()).distinct().collect()]
    # a partition filter: only buckets of the queries' words are read
    postings = _postings(spark, path).filter(F.col("bucket").isin(buckets)).select("word", "id")
    asked = asked_all.join(numbers, "word").groupBy("query_id").agg(F.collect_list("number").alias("own"))
    texts = held(_known(postings, numbers))
    first = asked_all.filter(F.col("met") < k)
    near = held(_compared(first.join(postings, "word").select("query_id", "id").distinct(), asked, texts))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "id"))
    bound = near.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("overlap").alias("least"))
    more = asked_all.join(bound, "query_id", "left").filter((F.col("met") >= k) & (F.col("nth") <= F.col("m") - F.coalesce("least", F.lit(1)) + 1))
    rest = more.join(postings, "word").select("query_id", "id").distinct().join(near, ["query_id", "id"], "left_anti")
    return near.union(_compared(rest, asked, texts)).withColumn("rank", nth).filter(F.col("rank") <= k)


# --- routed queries

STRATEGIES = ("adaptive", "hybrid", "vectors", "keywords", "tiers")


def routed(queries: DataFrame, uncertainty_threshold: float = 0.6, complexity_threshold: float = 0.5) -> DataFrame:
    """queries (query_id, query, strategy, history, recent) with reasons, and route: what retrieves.

    An `adaptive` query is retrieved, by vectors and keywords, if there is a reason to:
    an unsure or complex query, poor history, little recent context; else its route is
    `none`.  Other strategies are their own route.
    """
    reasons = X.retrieval_reasons(F.col("query"), F.col("history"), F.col("recent"), uncertainty_threshold, complexity_threshold)
    own = queries.withColumn("reasons", reasons)
    route = F.when(F.col("strategy") != "adaptive", F.col("strategy")).when(F.size("reasons") > 0, "hybrid").otherwise("none")
    return own.withColumn("route", route)


def tiered_batch(memories: DataFrame, queries: DataFrame, k: int = 10, working: int = 10, short: int = 50) -> DataFrame:
    """(query_id, id, layer, source_rank, rank): composite.tiered for every query (query_id, query, session_id).

    Long-term rows are met by session and word, never a session's rows by all of its queries.
    """
    half = max(1, k // 2)
    aged = memories.select("session_id", "id", "content", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("nth"))).alias("age"))
    asked = queries.select("query_id", "session_id", F.array_distinct(X.plain_words(F.col("query"))).alias("own"))
    top = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    recent = aged.filter(F.col("age") <= working + short).join(asked, "session_id").withColumn("overlap", F.size(F.array_intersect("own", F.array_distinct(X.plain_words(F.col("content"))))))
    first = recent.filter(F.col("age") <= working).withColumn("n", top("age")).filter(F.col("n") <= half).select("query_id", "id", F.lit("working").alias("layer"), F.lit(0).alias("source_rank"))
    second = recent.filter(F.col("age") > working).withColumn("n", top(F.desc("overlap"), "id")).filter(F.col("n") <= half).select("query_id", "id", F.lit("short_term").alias("layer"), F.lit(1).alias("source_rank"))
    older = aged.filter(F.col("age") > working + short).select("session_id", "id", F.explode(F.array_distinct(X.plain_words(F.col("content")))).alias("word"))
    hits = older.join(asked.select("query_id", "session_id", F.explode("own").alias("word")), ["session_id", "word"]).groupBy("query_id", "id").agg(F.count("*").alias("overlap"))
    third = hits.withColumn("n", top(F.desc("overlap"), "id")).filter(F.col("n") <= k).select("query_id", "id", F.lit("long_term").alias("layer"), F.lit(2).alias("source_rank"))
    each = Window.partitionBy("query_id", "id").orderBy("source_rank")
    own = first.union(second).union(third).withColumn("n", F.row_number().over(each)).filter("n = 1").drop("n")
    return own.withColumn("rank", top("source_rank", "id")).filter(F.col("rank") <= k)


def merged_batch(near: DataFrame, words: DataFrame, k: int = 10, weights: tuple[float, float] = (0.7, 0.3), default: float = 0.5) -> DataFrame:
    """(query_id, id, score, part, rank): vectors (query_id, id, distance) and keywords (query_id, id) merged as composite.hybrid does, for every query."""
    a = near.select("query_id", "id", ((1 - F.col("distance") / 2) * weights[0]).alias("score"), F.lit(0).alias("part"))
    b = words.select("query_id", "id", F.lit(default * weights[1]).alias("score"), F.lit(1).alias("part"))
    best = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "part")
    one = a.union(b).withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def retrieved(queries: DataFrame, vectors_path: str, postings_path: str, memories: DataFrame, k: int = 10, working: int = 10, short: int = 50) -> DataFrame:
    """(query_id, route, id, score, layer, rank): every query (query_id, query, query_vector, session_id, strategy, history, recent) by its route, all in one plan.

    Ids of vectors, texts and memories are cast to text.  A query whose route is `none`, or that
    finds nothing, has no rows.
    """
    from . import vectors

    spark = queries.sparkSession
    asked = held(routed(queries))
    of = lambda *routes: asked.filter(F.col("route").isin(*routes))
    near = held(vectors.search(spark, vectors_path, of("hybrid", "vectors").select("query_id", "query_vector"), 2 * k))
    words = held(overlap_batch(spark, postings_path, of("hybrid", "keywords").select("query_id", "query"), 2 * k))
    both = asked.filter("route = 'hybrid'").select("query_id")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, score, layer: df.select("query_id", F.col("id").cast("string").alias("id"), score.cast("double").alias("score"), layer.alias("layer"), F.col("rank").cast("int").alias("rank"))
    parts = [
        row(merged_batch(near.join(both, "query_id"), words.join(both, "query_id"), k), F.col("score"), none("string")),
        row(near.join(asked.filter("route = 'vectors'").select("query_id"), "query_id").filter(F.col("rank") <= k), 1 - F.col("distance") / 2, none("string")),
        row(words.join(asked.filter("route = 'keywords'").select("query_id"), "query_id").filter(F.col("rank") <= k), F.col("overlap"), none("string")),
        row(tiered_batch(memories, of("tiers"), k, working, short), none("double"), F.col("layer")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).join(asked.select("query_id", "route"), "query_id").select("query_id", "route", "id", "score", "layer", "rank")


def contexts(found: DataFrame, content: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """(query_id, text): for every query of `found` (query_id, id, layer, rank) its rows' contents with their headings, in order, as far as 4 * max_tokens characters reach; rows without layer are background.

    content: (id, content) with ids as text.  A query has at most k rows, and so has a group here.
    """
    head = F.create_map(*(F.lit(x) for kv in composite.PREFIX.items() for x in kv))[F.coalesce("layer", F.lit("long_term"))]
    lined = found.join(content, "id").withColumn("line", F.concat(head, F.lit("\n"), "content", F.lit("\n\n")))
    upto = F.sum(F.length("line")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = lined.withColumn("upto", upto).filter(F.col("upto") <= 4 * max_tokens)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "").alias("text"))
