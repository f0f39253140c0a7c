"""Queries of text functions, embeddings and chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import bands, chunks, embed, windows
from ..operators.shared import folder
from . import views as V
from .retrieval import KEYWORDS, TECH, sql_list

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


UNIT = "SELECT id, CAST(bucket AS INT) AS bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM s WHERE v <> 0"


@add("b01_hashed_tf", f"WITH t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'), lambda t: length(t) > 1 AND NOT list_contains({sql_list(T.EMBED_STOP)}, t)) AS t FROM documents), e AS (SELECT id, len(t) AS n, unnest(t) AS tok FROM t), s AS (SELECT id, CAST('0x' || md5(tok) AS UHUGEINT) % 384 AS bucket, sum(1.0::DOUBLE / n) AS v FROM e GROUP BY 1, 2) {UNIT}")
def b01(s, d):
    return embed.hashed_tf(V.table(s, d, "documents"), "doc_id", "text").select("id", F.col("bucket").cast("int").alias("bucket"), _r("value"))


@add("b02_hashed_char_grams", "WITH grams AS (SELECT item_id AS id, unnest(list_concat(list_transform(range(1, length(text) + 1), lambda i: substring(lower(text), i, 1)), list_transform(range(1, length(text)), lambda i: substring(lower(text), i, 2)))) AS gram FROM benchmark), s AS (SELECT id, CAST('0x' || md5(gram) AS UHUGEINT) % 384 AS bucket, sum(CASE WHEN CAST('0x' || md5(gram || 'sign') AS UHUGEINT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM grams GROUP BY 1, 2), " + f"u AS ({UNIT}) SELECT * FROM u")
def b02(s, d):
    return embed.hashed_grams(V.table(s, d, "benchmark"), "item_id", "text").select("id", F.col("bucket").cast("int").alias("bucket"), _r("value"))


@add("agg06_weighted_keywords", f"SELECT id, word, CAST(sum({TECH}) AS BIGINT) AS n FROM (SELECT doc_id AS id, unnest({KEYWORDS}) AS word FROM documents) GROUP BY id, word")
def agg06(s, d):
    from ..operators.sessions import keyword_counts

    return keyword_counts(V.table(s, d, "documents"), "doc_id", "text")


SCOREW = f"list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains({sql_list(T.SCORE_STOP)}, w))"


@add("b06_score_words", f"SELECT conv_id, turn, CAST(len({SCOREW}) AS INT) AS n, array_to_string({SCOREW}, ' ') AS words FROM conversations")
def b06(s, d):
    w = T.score_words(F.col("text"))
    return V.table(s, d, "conversations").select("conv_id", "turn", F.size(w).alias("n"), F.array_join(w, " ").alias("words"))


PLAIN = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
SHINGLES = "list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)"


@add("b07_shingles", f"WITH t AS (SELECT item_id, {PLAIN} AS w FROM benchmark) SELECT item_id, unnest({SHINGLES}) AS shingle FROM t")
def b07(s, d):
    return V.table(s, d, "benchmark").select("item_id", F.explode(T.shingles(F.col("text"))).alias("shingle"))


@add("b08_minhash", f"WITH t AS (SELECT item_id, {PLAIN} AS w FROM benchmark), x AS (SELECT item_id, {SHINGLES} AS sh FROM t) SELECT item_id, i AS slot, list_min(list_transform(sh, lambda q: md5((i * 1000 + 12345) || ':' || q))) AS least FROM x, (SELECT unnest(range(0, 128)) AS i)")
def b08(s, d):
    return V.table(s, d, "benchmark").select("item_id", F.posexplode(T.minhash(T.shingles(F.col("text")))).alias("slot", "least")).select("item_id", F.col("slot").cast("long").alias("slot"), "least")


SIG = f"t AS (SELECT item_id, {PLAIN} AS w FROM benchmark), x AS (SELECT item_id, {SHINGLES} AS sh FROM t), sig AS (SELECT item_id, list_transform(range(0, 128), lambda i: list_min(list_transform(sh, lambda q: md5((i * 1000 + 12345) || ':' || q)))) AS sig FROM x)"


@add("b09_fingerprint_hash", f"WITH {SIG} SELECT item_id, left(sha256(array_to_string(sig, ',')), 16) AS hash FROM sig")
def b09(s, d):
    sig = T.minhash(T.shingles(F.col("text")))
    return V.table(s, d, "benchmark").select("item_id", F.left(F.sha2(F.array_join(sig, ",").cast("binary"), 256), F.lit(16)).alias("hash"))


@add("b10_minhash_similarity", f"WITH {SIG}, one AS (SELECT sig AS q FROM sig WHERE item_id = 0) SELECT item_id, round(len(list_filter(range(1, 129), lambda i: sig[i] = q[i])) / 128.0, 6)::DOUBLE AS similarity FROM sig, one")
def b10(s, d):
    sig = V.table(s, d, "benchmark").select("item_id", T.minhash(T.shingles(F.col("text"))).alias("sig"))
    first = sig.filter("item_id = 0").first().sig
    return sig.select("item_id", F.round(T.equal_share(F.col("sig"), T.strings(first)), 6).alias("similarity"))


@add("b11_query_hash", "SELECT conv_id, turn, left(md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 16) AS hash FROM conversations")
def b11(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", T.query_hash(F.col("text")).alias("hash"))


def _complexity_sql(q: str) -> str:
    parts = [f"least(len({PLAIN.replace('text', q)}) / 20.0::DOUBLE, 1.0) * 0.15"]
    plain = f"regexp_replace({q}, '[^\\x00-\\x7F]', '_', 'g')"  # accented letters are parts of words
    for pattern, weight in T.COMPLEXITY.values():
        parts.append(f"least(len(regexp_extract_all({plain}, '(?i){pattern}')) * 0.3::DOUBLE, 1.0) * {weight}")
    return f"least({' + '.join(parts)} + CASE WHEN ends_with(trim({q}), '?') THEN 0.7 ELSE 0.3 END * 0.1::DOUBLE, 1.0)"


QUERY = "replace(text, '.', CASE WHEN turn % 2 = 0 THEN ' and api vs maybe?' ELSE '.' END)"


def _queries(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", F.replace("text", F.lit("."), F.when(F.col("turn") % 2 == 0, " and api vs maybe?").otherwise(".")).alias("q"))


@add("b12_query_complexity", f"SELECT conv_id, turn, round({_complexity_sql('q')}, 6)::DOUBLE AS complexity FROM (SELECT conv_id, turn, {QUERY} AS q FROM conversations)")
def b12(s, d):
    return _queries(s, d).select("conv_id", "turn", F.round(T.complexity(F.col("q")), 6).alias("complexity"))


VAGUE = " + ".join(f"CASE WHEN contains(lower(q), '{t}') THEN 1 ELSE 0 END" for t in T.VAGUE)
CONF = f"(1.0 - least(({_complexity_sql('q')} * 2.0 + (({VAGUE}) / 6.0::DOUBLE) * 1.5) / 3.0, 1.0))"


@add("b13_confidence", f"SELECT conv_id, turn, round({CONF}, 6)::DOUBLE AS confidence FROM (SELECT conv_id, turn, {QUERY} AS q FROM conversations)")
def b13(s, d):
    return _queries(s, d).select("conv_id", "turn", F.round(T.confidence(F.col("q")), 6).alias("confidence"))


@add("b14_retrieve_reasons", f"SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN {CONF} < 0.4 THEN 'low_confidence' END, CASE WHEN {_complexity_sql('q')} > 0.5 THEN 'high_complexity' END, CASE WHEN turn % 5 = 1 THEN 'poor_history' END, CASE WHEN turn % 3 = 0 THEN 'no_context' WHEN turn < 3 THEN 'insufficient_context' END], lambda r: r IS NOT NULL), ',') AS reasons FROM (SELECT conv_id, turn, {QUERY} AS q FROM conversations)")
def b14(s, d):
    history = F.when(F.col("turn") % 5 == 1, 0.5).when(F.col("turn") % 5 == 2, 0.9)
    recent = F.when(F.col("turn") % 3 != 0, F.col("turn"))
    return _queries(s, d).select("conv_id", "turn", F.array_join(T.retrieval_reasons(F.col("q"), history, recent), ",").alias("reasons"))


@add("b15_rough_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def b15(s, d):
    return V.table(s, d, "documents").select("doc_id", S.rough_tokens(F.col("text")).alias("tokens"))


@add("b16_language", f"SELECT id, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.ts') THEN 'typescript' WHEN ends_with(path, '.rs') THEN 'rust' ELSE 'unknown' END AS language FROM ({V.SYMBOLS})")
def b16(s, d):
    return V.symbols(s, d).select("id", T.language_of(F.col("path")).alias("language"))


@add("b17_import_lines", "SELECT conv_id, array_to_string(list('from ' || role || ' import t' || turn ORDER BY turn), chr(10)) AS imports FROM conversations GROUP BY conv_id")
def b17(s, d):
    line = F.concat(F.lit("from "), F.col("role"), F.lit(" import t"), F.col("turn").cast("string"))
    return V.table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("imports"))


@add("b18_path_relation", "WITH p AS (SELECT DISTINCT 'src/' || p_brand AS b, 'src/' || p_brand || CASE WHEN p_size % 3 = 0 THEN '/' WHEN p_size % 3 = 1 THEN '/x' ELSE 'c' END AS a FROM part) SELECT a, b, CASE WHEN rtrim(a, '/') = b THEN 0.5 WHEN starts_with(a, b || '/') THEN 0.3 ELSE 0.0 END::DOUBLE AS bonus FROM p")
def b18(s, d):
    p = V.table(s, d, "part").select(F.concat(F.lit("src/"), "p_brand").alias("b"), F.when(F.col("p_size") % 3 == 0, "/").when(F.col("p_size") % 3 == 1, "/x").otherwise("c").alias("x")).distinct()
    a = F.concat("b", "x")
    return p.select(a.alias("a"), "b", T.path_bonus(a, F.col("b")).alias("bonus"))


@add("b20_prompt", "SELECT conv_id, array_to_string(list('[' || role || '] ' || left(text, 200) ORDER BY turn), chr(10) || chr(10)) AS prompt FROM conversations GROUP BY conv_id")
def b20(s, d):
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.left("text", F.lit(200)))
    return V.table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("prompt"))


@add("prj01_commit_text", f"WITH f AS (SELECT hash, array_to_string(list(path ORDER BY path), ', ') AS files FROM ({V.FILES}) GROUP BY hash) SELECT c.hash, concat_ws(chr(10) || chr(10), 'Commit: ' || message, 'Author: ' || author, 'Files: ' || files) AS text FROM ({V.COMMITS}) c LEFT JOIN f ON f.hash = c.hash")
def prj01(s, d):
    files = V.commit_files(s, d).groupBy("hash").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("files"))
    label = lambda l, c: F.concat(F.lit(l), F.col(c))
    return V.commits(s, d).join(files, "hash", "left").select("hash", F.concat_ws("\n\n", label("Commit: ", "message"), label("Author: ", "author"), label("Files: ", "files")).alias("text"))


@add("prj02_symbol_text", f"SELECT id, concat_ws(chr(10), 'Type: ' || symbol_type, 'Name: ' || name, 'File: ' || path) AS text FROM ({V.SYMBOLS})")
def prj02(s, d):
    label = lambda l, c: F.concat(F.lit(l), F.col(c))
    return V.symbols(s, d).select("id", F.concat_ws("\n", label("Type: ", "symbol_type"), label("Name: ", "name"), label("File: ", "path")).alias("text"))


@add("prj04_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview, CASE WHEN length(text) > 100 THEN trim(replace(left(text, 100), chr(10), ' ')) || '...' ELSE trim(replace(text, chr(10), ' ')) END AS one_line FROM documents")
def prj04(s, d):
    return V.table(s, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.one_line_preview(F.col("text")).alias("one_line"))


@add("prj05_change_text", "SELECT doc_id, '[' || upper(lang) || '] ' || source || chr(10) || left(text, 1000) || '...' AS text FROM documents")
def prj05(s, d):
    return V.table(s, d, "documents").select("doc_id", F.concat(F.lit("["), F.upper("lang"), F.lit("] "), "source", F.lit("\n"), F.left("text", F.lit(1000)), F.lit("...")).alias("text"))


@add("sc12_document_id", "SELECT doc_id, left(md5(source || ':' || left(text, 100)), 12) AS id FROM documents")
def sc12(s, d):
    return V.table(s, d, "documents").select("doc_id", T.document_id(F.col("source"), F.col("text")).alias("id"))


@add("sc11_content_hash", "SELECT page_id, md5(html) AS hash FROM pages")
def sc11(s, d):
    return V.table(s, d, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("hash"))


@add("sc13_line_counts", "SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS added, (length(html) - length(replace(html, '<p><b>', ''))) // 6 AS headers FROM pages")
def sc13(s, d):
    return V.table(s, d, "pages").select("page_id", T.count_of(F.col("html"), "<p>").alias("added"), T.count_of(F.col("html"), "<p><b>").alias("headers"))


TOKENS = "list_transform(range(0, n_chars % 50), lambda i: i + doc_id)"


def _tokens(s, d):
    n = (F.col("n_chars") % 50).cast("int")
    return V.table(s, d, "documents").select("doc_id", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i + F.col("doc_id"))).otherwise(F.array().cast("array<long>")).alias("tokens"))


SEG = f"t AS (SELECT doc_id, {TOKENS} AS t FROM documents), g AS (SELECT doc_id, t, unnest(range(0, len(t), 12)) AS start_pos FROM t)"


@add("win10_segments", f"WITH {SEG} SELECT doc_id, start_pos // 12 AS segment, start_pos, least(start_pos + 16, len(t)) AS end_pos, array_to_string(list_concat(t[start_pos + 1:start_pos + 16], list_transform(range(0, greatest(start_pos + 16 - len(t), 0)), lambda i: 0)), ' ') AS tokens FROM g")
def win10(s, d):
    return windows.segments(_tokens(s, d), "doc_id", "tokens", 16, 4).select("doc_id", F.col("segment").cast("long").alias("segment"), F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), F.array_join("tokens", " ").alias("tokens"))


@add("win11_segment_arithmetic", "SELECT doc_id, (n_chars + 1919) // 1920 AS segments, round(CASE WHEN n_chars > 0 THEN n_chars::DOUBLE * n_chars / (((n_chars + 1919) // 1920) * 4194304) ELSE 1.0 END, 9) AS ratio FROM documents")
def win11(s, d):
    n = F.col("n_chars")
    return V.table(s, d, "documents").select("doc_id", windows.segment_count(n, 2048, 128).alias("segments"), F.round(windows.flops_ratio(n, 2048, 128), 9).alias("ratio"))


@add("win12_merge_segments", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents WHERE n_chars % 50 > 0")
def win12(s, d):
    return windows.joined_segments(windows.segments(_tokens(s, d), "doc_id", "tokens", 16, 4), "doc_id", 4).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@add("sc08_curriculum", "WITH m AS (SELECT greatest(max(n_chars), 512) AS longest FROM documents), s AS (SELECT i AS stage, CAST(floor(512 * pow(longest / 512::DOUBLE, i / 4::DOUBLE) + 1e-6) AS BIGINT) AS length, least(512 * CAST(pow(2, i // 2) AS INT), 2048) AS segment, round(1e-4 * (1 - i / 4.0::DOUBLE) + 1e-5 * (i / 4.0::DOUBLE), 9)::DOUBLE AS rate FROM m, (SELECT unnest(range(0, 5)) AS i)), b AS (SELECT *, coalesce(lag(length) OVER (ORDER BY stage), -1) AS below FROM s) SELECT stage, length, segment, rate, count(n_chars) AS n FROM b LEFT JOIN documents ON n_chars > below AND n_chars <= length GROUP BY ALL")
def sc08(s, d):
    return windows.curriculum(V.table(s, d, "documents"), "n_chars", 5)


@add("sc09_adaptive_segment", "SELECT doc_id, CAST(CASE WHEN n_chars < 2048 THEN 512 WHEN n_chars < 8192 THEN 1024 WHEN n_chars < 32768 THEN 1536 ELSE 2048 END AS INT) AS size FROM documents")
def sc09(s, d):
    return V.table(s, d, "documents").select("doc_id", S.segment_size(F.col("n_chars")).alias("size"))


@add("sc10_compression", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text, round(CASE WHEN length(text) > 2000 THEN 2003 ELSE length(text) END / length(text)::DOUBLE, 9) AS ratio FROM documents")
def sc10(s, d):
    short = T.preview(F.col("text"), 2000)
    return V.table(s, d, "documents").select("doc_id", short.alias("text"), F.round(F.length(short) / F.length("text"), 9).alias("ratio"))


@add("sc06_l2_normalised", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def sc06(s, d):
    v = F.col("embedding")
    return V.table(s, d, "embeddings").select("vec_id", F.round(S.norm(v), 5).alias("norm"), F.round(S.normalised(v)[0], 6).alias("first"))


MD = "regexp_replace(html, '<h1>|<p>', chr(10) || '# ', 'g')"


@add("chk04_markdown_chunks")
def chk04(s, d):
    docs = V.table(s, d, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("html", "<h1>|<p>", "\n# ").alias("text"))
    return chunks.chunked(docs.withColumn("kind", F.lit("markdown")), "id", "text", "kind")


@add("chk01_chunks_by_type")
def chk01(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("text", "markdown", "code"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return chunks.chunked(V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\ndef f").alias("text"), kind.alias("kind")), "id", "text", "kind")


@add("chk02_text_chunks")
def chk02(s, d):
    return chunks.chunked(V.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("text").alias("kind")), "id", "text", "kind")


@add("prs06_triples", "SELECT event_id AS id, 'u' || user_id AS subject, event_type AS relation, CAST(value AS VARCHAR) AS object, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM events WHERE event_id % 3 <> 0")
def prs06(s, d):
    from ..operators import triples

    item = F.concat(F.lit('{"subject": " u'), F.col("user_id"), F.lit('", "relation": "'), F.col("event_type"), F.lit('"'), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(', "object": "'), F.col("value").cast("string"), F.lit('"'))).otherwise(""), F.when(F.col("event_id") % 2 == 0, ', "confidence": 0.5').otherwise(""), F.lit("}"))
    reply = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('Here:\n```json\n{"triples": ['), item, F.lit("]}\n```"))).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    return triples.parsed(V.table(s, d, "events").select(F.col("event_id").alias("id"), reply.alias("reply")), "id", "reply")


CUT = "regexp_replace(text, '\\s*\\S+\\s*$', '')"
BANDED = "x{k} AS (SELECT item_id, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM (SELECT item_id, {plain} AS w FROM (SELECT item_id, {text} AS text FROM benchmark))), s{k} AS (SELECT item_id, sh, list_transform(range(0, 128), lambda i: list_min(list_transform(sh, lambda q: md5((i * 1000 + 12345) || ':' || q)))) AS sig FROM x{k}), b{k} AS (SELECT item_id, b, array_to_string(sig[b * 8 + 1:b * 8 + 8], ',') AS key FROM s{k}, (SELECT unnest(range(0, 16)) AS b))"


@add("b08_banded_probe", f"WITH {BANDED.format(k=1, plain=PLAIN, text='text')}, {BANDED.format(k=2, plain=PLAIN, text=CUT)}, met AS (SELECT DISTINCT n.item_id AS id, o.item_id AS other FROM b2 n JOIN b1 o ON n.b = o.b AND n.key = o.key) SELECT m.id, m.other, round(len(list_intersect(n.sh, o.sh)) / len(list_distinct(list_concat(n.sh, o.sh)))::DOUBLE, 9) AS jaccard FROM met m JOIN s2 n ON n.item_id = m.id JOIN s1 o ON o.item_id = m.other WHERE len(list_intersect(n.sh, o.sh)) / len(list_distinct(list_concat(n.sh, o.sh)))::DOUBLE >= 0.6")
def b08_probe(s, d):
    """Benchmark texts without their last word, looked up among the whole ones."""
    items = V.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    path = bands.add(items, folder(s, "bands"))
    new = items.withColumn("content", F.regexp_replace("content", r"\s*\S+\s*$", ""))
    return bands.probed(s, path, new, 0.6).select("id", "other", F.round("jaccard", 9).alias("jaccard"))
