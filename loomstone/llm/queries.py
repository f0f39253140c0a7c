"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose crc32 modulo 7 is not 2."""
    from . import lm
    from .shared import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.fit(docs.filter(fold("doc_id", 7) != 2))
    return lm.score(docs, model).select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; labels of rows whose crc32 modulo 5 is 0 are held out."""
    from . import toxicity
    from .shared import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return toxicity.scored(docs, models).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "contrast")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what a mix of their sources takes of them."""
    from . import mixing

    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' urls judged by the fixed rules."""
    from . import urls

    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    from . import decontam

    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the number of lines and sentences they lose, and what is left."""
    from . import lines

    out = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_cut", F.length("text").cast("long").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("digest"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and near-duplicate component."""
    from . import simhash
    from .shared import checkpointed

    prints = checkpointed(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return simhash.near_duplicates(prints).select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with base phrases and the licenses whose templates a line meets."""
    from . import licenses

    return licenses.scanned(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    from . import warc

    path, manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(path, manifest).drop("url", "payload")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by base rules and an isolation forest."""
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base spans and those that contexts reveal."""
    from . import pii

    out = pii.extracted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    each = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]  # noqa: B023
    return out.select("doc_id", *each, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_found"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their variants."""
    from . import spelling

    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of all documents."""
    from . import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring, "op2_toxicity": op2_toxicity, "op3_mixing": op3_mixing, "op4_url_filters": op4_url_filters, "op5_decontamination": op5_decontamination, "op6_line_dedup": op6_line_dedup, "op7_simhash_near_dedup": op7_simhash_near_dedup, "op8_license_scan": op8_license_scan, "op9_warc": op9_warc, "op10_quality_rules": op10_quality_rules, "op11_pii": op11_pii, "op12_spelling_variants": op12_spelling_variants, "op13_phrase_collocations": op13_phrase_collocations}
LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op4_sql() -> str:
    from .urls import RULES

    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, {LOWER.format(t="regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r(verdict, rh, rp) AS (VALUES {rules}),
 m AS (SELECT page_id, host, path, verdict, rh || rp AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
 SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1"""


def op8_sql() -> str:
    import math

    from .licenses import PHRASES, SLACK, TEMPLATES, THRESHOLD

    as_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    starts, labels = [], []
    for phrase, label in PHRASES.items():
        q = phrase.split()
        starts.append(f"list_filter(range(0, greatest(len(w) - {len(q) - 1}, 0)), lambda i: w[i + 1:i + {len(q)}] = {as_list(q)})")
        labels.append(f"CASE WHEN len({starts[-1]}) > 0 THEN '{label}' END")
    tokens = ", ".join(f"({k}, '{label}', '{w}', {len(own)}, {math.ceil(THRESHOLD * len(own) - 1e-9)}, {math.ceil(SLACK * len(text.split()))})" for k, (label, text) in enumerate(TEMPLATES) for own in [sorted(set(text.split()))] for w in own)
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL))), ',')"
    return f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 t(k, label, token, m, need, width) AS (VALUES {tokens}),
 x AS (SELECT r, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM w),
 n AS (SELECT r, label, m, need, count(DISTINCT x.token) OVER (PARTITION BY r, k ORDER BY p RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS n FROM x JOIN t ON x.token = t.token),
 met AS (SELECT r, list(DISTINCT label) AS more, max(n / m::DOUBLE) AS best FROM n WHERE n >= need GROUP BY r),
 s AS (SELECT r, doc_id, w, list_concat({starts[0]}, {", ".join(starts[1:])}) AS places FROM w)
 SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, {joined(f"[{', '.join(labels)}]")} AS base_labels, {joined(f"list_concat([{', '.join(labels)}], coalesce(more, []))")} AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score FROM s LEFT JOIN met USING (r)"""


OP9_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
 SELECT page_id, strlen(t) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(p.h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
 FROM p JOIN f ON f.h = p.h"""

def op13_sql() -> str:
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format(t="coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
 n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
 g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: {{'k': k, 'phrase': array_to_string(w[i:i + k - 1], ' ')}})))) AS g FROM w),
 c AS (SELECT lang, g.k AS k, g.phrase AS phrase, count(*) AS a, string_split(g.phrase, ' ') AS v FROM g GROUP BY ALL HAVING count(*) >= 30),
 cuts AS (SELECT lang, k, phrase, a, v, unnest(range(1, k)) AS cut FROM c WHERE k > 1),
 s AS (SELECT x.lang, x.k, x.phrase, x.a, x.v, x.cut, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * x.a) // (l.a + r.a) AS BIGINT) AS score
  FROM cuts x JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(x.v[1:x.cut], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(x.v[x.cut + 1:], ' ')),
 best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 spots AS (SELECT lang, a, v, k, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: [i, m])))) AS s FROM best WHERE k > 2),
 inside AS (SELECT lang, array_to_string(v[s[1]:s[1] + s[2] - 1], ' ') AS phrase, max(a) AS f FROM spots GROUP BY ALL),
 kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f::HUGEINT < 80 * b.a::HUGEINT),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
 SELECT lang, rank, phrase, a, l, r, n.n AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


SQL: dict[str, str] = {"op4_url_filters": op4_sql(), "op8_license_scan": op8_sql(), "op9_warc": OP9_SQL, "op13_phrase_collocations": op13_sql()}
