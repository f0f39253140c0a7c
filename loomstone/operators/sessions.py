"""Cross-session discovery: keywords, duplicates, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from .shared import held, parts
from .windows import numbered


def keyword_counts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, word, n): technical terms count three times."""
    # dealt out by id once: counting and ranking then need no further shuffle
    words = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).repartition(parts(docs, 2), "id").select("id", F.explode(T.keyword_words(F.col("text"))).alias("word"))
    return words.groupBy("id", "word").agg(F.sum(T.keyword_weight(F.col("word"))).alias("n"))


def keywords(docs: DataFrame, id: str, text: str, most: int = 20) -> DataFrame:
    """(id, word, n, rank): the `most` heaviest words, ties by word."""
    order = Window.partitionBy("id").orderBy(F.desc("n"), "word")
    return keyword_counts(docs, id, text).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _numbers(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, number): every word of both tables, the rarest of `right` first."""
    side = lambda d, n: d.filter("word IS NOT NULL").select("word", F.lit(n).cast("long").alias("often"))
    words = side(right, 1) if left is right else side(left, 0).union(side(right, 1))
    return numbered(words.groupBy("word").agg(F.sum("often").alias("often")), "number", F.col("often"), F.col("word")).select("word", "number")


def _sets(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(id, words, bits0, bits1): sets (id, word) as sorted numbers, the rarest first, and 128 bits that their hashes set."""
    h = F.pmod(F.xxhash64("number"), F.lit(128))
    bits = [F.coalesce(F.bit_or(F.when(F.floor(h / 64) == x, F.expr("shiftleft(1L, int(pmod(xxhash64(number), 64)))"))), F.lit(0).cast("long")).alias(f"bits{x}") for x in range(2)]
    return held(rows.filter("id IS NOT NULL").join(numbers, "word").groupBy("id").agg(F.sort_array(F.collect_set("number")).alias("words"), *bits))


def _meeting(left: DataFrame, right: DataFrame, least: float, where: Column | None = None) -> DataFrame:
    """Pairs of sets above `least`, once each, with jaccard; columns of the sides begin with a_ and b_.

    Prefix filter: words in order of rarity; a pair above `least` has some number of words
    in common, by the two sizes, so it shares one of each set's rarest n - that + 1.
    Of those that do, most are told apart by bits of their words' hashes: a bit that only
    one set has is a word that the other lacks.  Prefixes carry their whole set, so pairs
    that are left are compared where they meet, at the first word that they share:
    what is shuffled follows the number of sets, not that of pairs.
    """

    def prefix(d: DataFrame, k: str) -> DataFrame:
        n = F.size("words")
        return d.select(*(F.col(c).alias(f"{k}_{c}") for c in d.columns), n.alias(f"{k}_n"), F.posexplode(F.slice("words", F.lit(1), (n - F.floor(n * least)).cast("int"))).alias(f"{k}_nth", "word"))

    shared = F.floor((F.col("a_n") + F.col("b_n")) * (least / (1 + least)) - 1e-9) + 1  # words at least that a pair above it shares
    lacks = lambda a, b: sum(F.bit_count(F.col(f"{a}_bits{x}").bitwiseAND(F.bitwise_not(f"{b}_bits{x}"))) for x in range(2))
    fits = (F.col("a_nth") <= F.col("a_n") - shared) & (F.col("b_nth") <= F.col("b_n") - shared) & (F.col("a_n") - lacks("a", "b") >= shared) & (F.col("b_n") - lacks("b", "a") >= shared)
    both = F.array_intersect("a_words", "b_words")
    met = prefix(left, "a").join(prefix(right, "b"), "word").filter(fits if where is None else where & fits)
    jaccard = F.when(F.array_min(both) == F.col("word"), F.size(both) / (F.col("a_n") + F.col("b_n") - F.size(both)))
    # exploded, or Spark would move the comparison into the join's condition, before what tells pairs apart
    return met.select("*", F.explode(F.array(jaccard)).alias("jaccard")).filter(F.col("jaccard") > least)


def similar(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, jaccard) of word sets (id, word) with more than `least` in common, a < b if both sides are one table.

    Sets without a common word have similarity 0.
    """
    same, numbers = left is right, _numbers(left, right)
    sets = _sets(left, numbers)
    pairs = _meeting(sets, sets if same else _sets(right, numbers), least, F.col("a_id") < F.col("b_id") if same else None)
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "jaccard")


def fingerprints(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, hash): of each text's MinHash signature."""
    signature = T.minhash(T.shingles(F.col(text)))
    return rows.select(F.col(id).alias("id"), F.left(F.sha2(F.array_join(signature, ",").cast("binary"), 256), F.lit(16)).alias("hash"))


def duplicates(new: DataFrame, known: DataFrame, threshold: float = 0.8, least: float = 0.3, most: int = 5) -> DataFrame:
    """(a, b, jaccard, rank, is_duplicate): the `most` similar known ids of each new one but itself; is_duplicate holds for the new one as a whole."""
    numbers, bits = _numbers(new, known), ["bits0", "bits1"]
    own, others = _sets(new, numbers), _sets(known, numbers)
    # equal sets are compared once; of a set's ids the least can be among the first, and one more in place of the new one itself
    least_ids = others.withColumn("n", F.row_number().over(Window.partitionBy("words").orderBy("id"))).filter(F.col("n") <= most + 1)
    classes = least_ids.groupBy("words", *bits).agg(F.collect_list("id").alias("ids"))
    met = _meeting(own.select("words", *bits).distinct(), classes, least).select(F.col("a_words").alias("words"), F.explode("b_ids").alias("b"), "jaccard")
    best = Window.orderBy(F.desc("jaccard"), "b")
    first = met.withColumn("n", F.row_number().over(best.partitionBy("words"))).filter(F.col("n") <= most + 1)
    pairs = own.select(F.col("id").alias("a"), "words").join(first, "words").filter("a <> b").select("a", "b", "jaccard")
    ranked = pairs.withColumn("rank", F.row_number().over(best.partitionBy("a"))).withColumn("is_duplicate", F.max("jaccard").over(Window.partitionBy("a")) >= threshold)
    return ranked.filter(F.col("rank") <= most)


def query_words(query: str) -> list[str]:
    """Words of a query as scoring takes them."""
    import re

    from ..functions.words import SCORE_STOP

    words = re.sub(r"[^\w\s]", " ", query.lower()).split()
    return sorted({w for w in words if len(w) >= 3 and w not in SCORE_STOP})


def relevance(decisions: DataFrame, sessions: DataFrame, query: str, project: str, folder: str, as_of) -> DataFrame:
    """Score of every session (session_id, project, folder, stamp) from its decisions (session_id, content): keywords, project and age."""
    words = query_words(query)
    hits = F.size(F.array_intersect(T.score_words(F.col("content")), T.strings(words)))
    matched = decisions.groupBy("session_id").agg(F.sum(hits).alias("hits"))
    kw = S.keyword_score(F.coalesce("hits", F.lit(0)), F.lit(len(words)))
    bonus = S.project_bonus(F.col("project"), F.lit(project), T.path_bonus(F.lit(folder), F.col("folder")))
    score = S.relevance(kw, bonus, S.time_decay(F.col("stamp"), as_of)) if words else F.lit(0.0)
    return sessions.join(matched, "session_id", "left").withColumn("keyword_score", kw).withColumn("score", score)


def explored(scores: DataFrame, decisions: DataFrame, current: str, seen: DataFrame, least: float, per_session: int, limit: int) -> DataFrame:
    """Decisions of the best sessions, walked by score until `limit`: not the current one, not those in `seen`, at least `least` relevant, `per_session` of each."""
    fit = scores.filter((F.col("session_id") != current) & (F.col("score") >= least)).join(seen, "session_id", "left_anti")
    first = Window.partitionBy("session_id").orderBy("nth")
    own = decisions.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_session)
    return fit.join(own, "session_id").orderBy(F.desc("score"), "session_id", "nth").limit(limit)
