"""Queries that users ask: contexts, tiered and hybrid retrieval, answers with sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search, windows


def session_context(memories: DataFrame, session, query: str, k: int = 10) -> DataFrame:
    """Relevant and recent rows of a session (relevant ones first, each id once): id, part (0 relevant, 1 recent)."""
    own = memories.filter(F.col("session_id") == session)
    relevant = search.overlap_search(own, query, k).select("id", "content", "memory_type")
    recent = own.orderBy(F.desc("nth")).limit(k).select("id", "content", "memory_type")
    return search.first_of_each([relevant, recent])


def code_context(memories: DataFrame, query: str, kinds: list[str], k: int = 5) -> DataFrame:
    """Rows of the given kinds and rows that share words with the query, each id once."""
    typed = memories.filter(F.col("memory_type").isin(kinds)).orderBy("id").limit(k).select("id", "content")
    return search.first_of_each([typed, search.overlap_search(memories, query, k).select("id", "content")])


def tiered(memories: DataFrame, session, query: str, k: int = 10, working: int = 10, short: int = 50) -> DataFrame:
    """Up to 5 of the newest, up to 5 of the short-term ones by shared words, the rest from long-term ones with shared words; layer, each id once."""
    own = memories.filter(F.col("session_id") == session).withColumn("age", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("nth"))))
    half = max(1, k // 2)
    first = own.filter(F.col("age") <= working).orderBy("age").limit(half)
    second = search.overlap_search(own.filter((F.col("age") > working) & (F.col("age") <= working + short)), query, half, keep_zero=True)
    third = search.overlap_search(own.filter(F.col("age") > working + short), query, k)
    parts = [p.select("id", "content").withColumn("layer", F.lit(n)) for p, n in ((first, "working"), (second, "short_term"), (third, "long_term"))]
    return search.first_of_each(parts).orderBy("source_rank", "id").limit(k)


PREFIX = {"working": "[Current Context]", "short_term": "[Recent History]", "long_term": "[Background Knowledge]"}


def context_text(rows: DataFrame, max_tokens: int, *order: Column) -> DataFrame:
    """(text): the longest prefix of rows (layer, content), with their headings, within 4 * max_tokens characters."""
    head = F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv))[F.col("layer")]
    lined = rows.withColumn("line", F.concat(head, F.lit("\n"), "content", F.lit("\n\n"))).withColumn("all", F.lit(1)).withColumn("key", F.struct(*order))
    kept = windows.within_budget(lined, "all", F.length("line"), max_tokens * 4, F.col("key"))
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "").alias("text"))


def hybrid(vectors: DataFrame, query_vector: list[float], texts: DataFrame, query: str, k: int = 10, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Nearest vectors and shared words merged; ids with scores."""
    near = search.knn(vectors, query_vector, 2 * k).select("id", "score")
    words = search.overlap_search(texts, query, 2 * k).select("id", F.lit(None).cast("double").alias("score"))
    return search.merged([(near, weights[0]), (words, weights[1])], k)


def long_term(rows: DataFrame, query: str = "", k: int = 10, query_vector: list[float] | None = None) -> DataFrame:
    """From long-term memory: the nearest vectors if there is a query vector, else most shared words first."""
    return search.knn(rows, query_vector, k) if query_vector is not None else search.overlap_search(rows, query, k)


def answer_context(results: DataFrame, cut: int = 500) -> DataFrame:
    """(context, sources) of results (id, score, source, content), the best first: what a language model is shown, and the distinct sources in order.  Results are a top-k, so they are one row."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "source", F.left("content", F.lit(cut)).alias("c"))))
    lines = F.transform("r", lambda x, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] Source: "), x["source"], F.lit("\nContent: "), x["c"], F.lit("...\n")))
    return results.agg(best.alias("r")).select(F.array_join(lines, "\n").alias("context"), F.array_join(F.array_sort(F.array_distinct(F.transform("r", lambda x: x["source"]))), ",").alias("sources"))


def mapped_texts(rows: DataFrame, id: str, text: str, client: Callable[[], Callable[[list[str]], list]], kind: str) -> DataFrame:
    """(id, value): texts through an external service in batches.  `client` is made once per task and takes a list of texts."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

    value: DataType = _parse_datatype_string(kind)
    sent = rows.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ask(b.column("text").to_pylist()), to_arrow_type(value))], ["id", "value"])

    return sent.mapInArrow(run, StructType([sent.schema["id"], StructField("value", value)]))
