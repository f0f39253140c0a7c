"""Text functions as Column expressions; they stay in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import EMBED_STOP, KEYWORD_STOP, SCORE_STOP, TECH_TERMS


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def raw_identifiers(text: Column) -> Column:
    """Lower-cased `[a-z_][a-z0-9_]*` tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))


def is_term(token: Column) -> Column:
    """Neither a stop word nor a single character."""
    return (F.length(token) > 1) & ~token.isin(EMBED_STOP)


def identifiers(text: Column) -> Column:
    return F.filter(raw_identifiers(text), is_term)


def bucket(token: Column, dim: int) -> Column:
    """md5 of a token, read as a whole number, modulo dim."""
    h, out = F.md5(token.cast("binary")), F.lit(0).cast("long")
    for k in range(4):
        word = F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
        out = F.pmod(out * F.lit((1 << 32) % dim) + word, F.lit(dim))
    return out


def sign(gram: Column) -> Column:
    """1 if md5(gram + "sign") is even, else -1."""
    last = F.conv(F.substring(F.md5(F.concat(gram, F.lit("sign")).cast("binary")), 32, 1), 16, 10).cast("int")
    return F.when(last % 2 == 0, 1).otherwise(-1)


def char_grams(text: Column, low: int = 1, high: int = 2) -> Column:
    """All character n-grams of a lower-cased text, repeats included."""
    t = F.lower(text)

    def grams(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, every).otherwise(F.array().cast("array<string>"))

    each = [grams(n) for n in range(low, high + 1)]
    return F.flatten(F.array(*each))


def normalised_words(text: Column) -> Column:
    """Words of a lower-cased text in which all but letters, digits, _ and white space is blank."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def keyword_words(text: Column, least: int = 3) -> Column:
    return F.filter(normalised_words(text), lambda w: (F.length(w) >= least) & ~w.isin(KEYWORD_STOP))


def keyword_weight(word: Column) -> Column:
    return F.when(word.isin(TECH_TERMS), 3).otherwise(1)


def score_words(text: Column, least: int = 3) -> Column:
    return F.filter(normalised_words(text), lambda w: (F.length(w) >= least) & ~w.isin(SCORE_STOP))


def plain_words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k words; a text of fewer words has its words."""
    w = plain_words(text)
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.array_distinct(F.when(F.size(w) < k, w).otherwise(many))


def minhash(shingle_set: Column, n: int = 128) -> Column:
    """For seeds 12345, 13345, ... the least md5 of "seed:shingle", as hex text, whose order is that of the numbers; null slots without shingles."""
    seeds = F.array(*(F.lit(str(i * 1000 + 12345)) for i in range(n)))
    return F.transform(seeds, lambda s: F.array_min(F.transform(shingle_set, lambda x: F.md5(F.concat(s, F.lit(":"), x).cast("binary")))))


def equal_share(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures; 0 if their lengths differ."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(same / F.size(a), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def preview(text: Column, n: int = 100, more: str = "...") -> Column:
    """The first n characters, and `more` if that is not all."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(more))).otherwise(text)


def one_line_preview(text: Column, n: int = 100) -> Column:
    head = F.trim(F.replace(F.left(text, F.lit(n)), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(text) > n, F.concat(head, F.lit("..."))).otherwise(head)


def query_hash(query: Column) -> Column:
    return F.left(F.md5(F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")).cast("binary")), F.lit(16))


# Patterns of query complexity, and the factors' weights.
COMPLEXITY = {
    "factual_question": (r"^(what|who|when|where|why|how)\s+(is|are|was|were|did|do|does)", 0.2),
    "comparison": (r"\b(compare|versus|vs|difference|similarities?|better|worse)\b", 0.25),
    "multi_hop": (r"\b(and|also|as well as|in addition to)\b.*\?", 0.2),
    "specific_entity": (r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", 0.1),
    "temporal": (r"\b(20\d\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", 0.05),
    "technical": (r"\b(api|database|algorithm|framework|architecture|implementation)\b", 0.15),
}
VAGUE = ["something", "someone", "somewhere", "somehow", "maybe", "perhaps"]


def complexity(query: Column) -> Column:
    """Weighted sum of length, pattern families (case ignored) and question mark; at most 1."""
    parts = F.least(F.size(plain_words(query)) / 20, F.lit(1.0)) * 0.15
    for pattern, weight in COMPLEXITY.values():
        parts = parts + F.least(F.regexp_count(query, F.lit("(?i)" + pattern)) * 0.3, F.lit(1.0)) * weight
    return F.least(parts + F.when(F.trim(query).endswith("?"), 0.7).otherwise(0.3) * 0.1, F.lit(1.0))


def confidence(query: Column) -> Column:
    vague = sum((F.when(F.lower(query).contains(t), 1).otherwise(0) for t in VAGUE), F.lit(0)) / len(VAGUE)
    return 1.0 - F.least((complexity(query) * 2.0 + vague * 1.5) / 3.0, F.lit(1.0))


def retrieval_reasons(query: Column, history: Column, recent: Column, uncertainty_threshold: float = 0.6, complexity_threshold: float = 0.5) -> Column:
    """Why to retrieve; empty: no need.  history: success rate or null; recent: context entries of the last hour, null without context."""
    return F.array_compact(
        F.array(
            F.when(confidence(query) < float(1 - Decimal(str(uncertainty_threshold))), F.lit("low_confidence")),
            F.when(complexity(query) > complexity_threshold, F.lit("high_complexity")),
            F.when(history < uncertainty_threshold, F.lit("poor_history")),
            F.when(recent.isNull(), F.lit("no_context")).when(recent < 3, F.lit("insufficient_context")),
        )
    )


LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go"}


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), suffix), F.lit("unknown"))


def path_bonus(a: Column, b: Column) -> Column:
    """0.5 for equal folders, 0.3 if one holds the other, else 0."""
    a, b = F.rtrim(a, F.lit("/")), F.rtrim(b, F.lit("/"))
    inside = F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 0.5).when(inside, 0.3).otherwise(0.0)


def document_id(source: Column, content: Column) -> Column:
    return F.left(F.md5(F.concat(source, F.lit(":"), F.left(content, F.lit(100))).cast("binary")), F.lit(12))


def count_of(text: Column, part: str) -> Column:
    """Places of a part that doesn't overlap itself."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")
