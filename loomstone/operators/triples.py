"""Triples from model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "array<struct<subject:string,relation:string,object:string,confidence:double>>"


def json_of(reply: Column) -> Column:
    """A fenced block's content, else from the first bracket to the last of its kind, else the reply."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.regexp_replace(F.when(fenced != "", fenced).when(bare != "", bare).otherwise(reply), r"^\s+|\s+$", "")


def parsed(replies: DataFrame, id: str, reply: str, least: float = 0.0) -> DataFrame:
    """Rows (id, subject, relation, object, confidence), confidence 1 if absent; items without one of the three, and replies that aren't JSON, have none."""
    body = json_of(F.col(reply))
    items = F.when(F.startswith(body, F.lit("[")), F.from_json(body, ITEM)).otherwise(F.from_json(body, f"struct<triples:{ITEM}>")["triples"])
    rows = replies.select(F.col(id).alias("id"), F.explode(items).alias("t")).select("id", *(F.trim(f"t.{c}").alias(c) for c in ("subject", "relation", "object")), F.coalesce("t.confidence", F.lit(1.0)).alias("confidence"))
    return rows.filter(F.col("subject").isNotNull() & F.col("relation").isNotNull() & F.col("object").isNotNull() & (F.col("confidence") >= least))


def distinct(triples: DataFrame) -> DataFrame:
    """Triples that differ in more than case; of equal ones the most confident."""
    keys = [F.lower(c).alias(f"k_{c}") for c in ("subject", "relation", "object")]
    best = triples.groupBy(*keys).agg(F.max_by(F.struct("subject", "relation", "object", "confidence"), F.struct("confidence", "subject", "relation", "object")).alias("t"))
    return best.select("t.*")
