"""Personal data, spelling variants and phrases against brute-force versions on small hostile tables."""

import hashlib
import os
import random
import re
import resource
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import copies, phrases, pii, queries, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)
    return df.withColumns({c: F.lit(1) for c in ("id", "n", "word", "root", "score", "a", "f1", "phrase", "kind", "h")}) if extra else df


# 11: personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain_spans(t):
    return [(k, m.start(), m.end()) for k, rx in PLAIN.items() for m in re.finditer(rx, t or "") if sound(k, m[0])]


def private_texts(seed):
    rng = random.Random(seed)
    bits = ["a@b.c", "@", ".", "x.y@", "é@b.co", "1.2.3.4", "300.1.1.1", "0001.02.3.255", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0) 171-555.1234", "+", "-", " ", "\n", "12", "a_b%+", "\U0001f600", "à", "::1", "fe80::1", "(", ")", "+1", "0" * 400, "9 9"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(600)]


def test_base_spans_are_those_of_the_plain_patterns():
    for t in private_texts(1) + ["a@b.c@d.e@f.g", "1.2.3.4.5.6.7.8", "1" * 300 + ".1.1.1"]:
        raw = t.encode()
        at = lambda k: len(raw[:k].decode())  # noqa: B023, E731
        assert [(pii.KINDS[k], at(s), at(e)) for k, s, e in pii.base_spans(raw)] == plain_spans(t), t


def test_places_are_apart_from_base_spans_and_one_another():
    for t in private_texts(2):
        base = pii.base_spans(t.encode())
        own = pii.places(t.encode(), base)
        for i, (_, s, e) in enumerate(own):
            assert s < e and all(e <= a or s >= b for _, a, b in base + [x for j, x in enumerate(own) if j != i])


def test_long_texts_take_time_by_their_length():
    for t in (b"a" * 2_000_000, b"1" * 2_000_000, b"1." * 1_000_000, b"a@" * 1_000_000, b"+1" * 1_000_000, b"+1" + b" " * 2_000_000, b":" * 2_000_000, b"1 " * 1_000_000, b" (at) " * 300_000, b"a@b." * 500_000):
        began = time.time()
        pii.places(t, pii.base_spans(t))
        assert time.time() - began < 15


def private_rows():
    rng = random.Random(5)
    noise = lambda n: " ".join(rng.choice("the of and meeting value was is in 12 2024 3456789 plan note".split()) for _ in range(n))
    rows = [(None, None, None), (1, "", "en"), (2, " \n", "en"), (3, "x" * 100_000 + " a@b.cc", "en")]
    for k in range(40):
        rows.append((10 + k, f"{noise(20)} mail me at user{k}@mail{k}.org please {noise(9)}\nphone: +49 171 555 {1000 + k} home {noise(5)} client ip= 10.0.{k}.7, {noise(4)}", "en"))
    rows += [(60, f"{noise(8)} mail me at jane (at) example (dot) org please {noise(3)}", "en"), (61, f"{noise(4)} phone: 0171-555-8899 home", "en"), (62, "We mail me at john@localhost please", "en"), (63, f"{noise(3)} client ip= fe80::1:2:3, {noise(3)}", "en")]
    rows += [(70 + k, noise(60), "en") for k in range(40)]
    return rows + rows[4:8]


def revealed(df):
    return {(r.doc_id, s.kind, s.start, s.end) for r in df.collect() for s in r.spans if not s.base}


def test_contexts_reveal_identifiers_that_no_pattern_finds(spark):
    rows = private_rows()
    docs = docs_of(spark, rows, True).repartition(5)
    out = pii.extracted(docs).collect()
    assert len(out) == len(rows)
    assert sorted(((r.doc_id, sorted((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in out), key=str) == sorted(((i, sorted(plain_spans(t))) for i, t, _ in rows), key=str)
    text = {i: t for i, t, _ in rows}
    got = {(r.doc_id, s.kind, text[r.doc_id][s.start : s.end]) for r in out for s in r.spans if not s.base}
    assert got == {(60, "email", "jane (at) example (dot) org"), (61, "phone", "0171-555-8899"), (62, "email", "john@localhost"), (63, "ip", "fe80::1:2:3")}
    shown = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert "mail me at [email] please" in shown[60] and "phone: [phone]" in shown[61] and shown[1] == "" and shown[None] is None and shown[70] == text[70]


def test_new_instances_make_further_patterns(spark):
    """Numbers found beside a learned context stand beside another, which then reveals more."""
    rows = [(k, f"call desk +49 171 555 {1000 + k} today", "en") for k in range(9)]
    rows += [(20 + k, f"call desk 0171 555 {2000 + k} now", "en") for k in range(4)] + [(30 + k, f"reach us 0171 555 {2000 + k} ok", "en") for k in range(4)] + [(40, "reach us 0171 555 7777 ok", "en")]
    docs = docs_of(spark, rows)
    assert {i for i, *_ in revealed(pii.extracted(docs, rounds=1))} == {20, 21, 22, 23}
    assert {i for i, *_ in revealed(pii.extracted(docs, rounds=3))} == {20, 21, 22, 23, 30, 31, 32, 33, 40}


def test_private_data_of_nothing(spark):
    assert pii.extracted(docs_of(spark, [])).count() == 0
    assert [r.spans for r in pii.extracted(docs_of(spark, [(1, None, None), (1, None, None)])).collect()] == [[], []]


def test_private_query(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = plain_spans(r.text)
        digest = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        want[r.doc_id] = (*(sum(k == x for k, _, _ in own) for x in pii.KINDS), hashlib.sha256(digest.encode()).hexdigest())
    got = queries.op11_pii(spark, sf).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got} == want and len(got) == len(want)


# 12: spelling variants


def edits(a, b):
    """Whether two different words are one edit apart, by definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, one_in=97):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    close = {w: [v for v in n if edits(v, w)] for w in n}
    form = {w: min(close[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return sorted(out, key=str)


def variant_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Hello", "HELLO", "l'hôtel", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500, "×÷abÀ"]
    rows = [(None, None, None), (5, "", "en"), (6, "12 34 .,", "en")]
    for i in range(400):
        text = " ".join(w[: rng.randint(3, len(w))] if rng.random() < 0.2 and len(w) < 100 else w for w in rng.choices(base, k=25))
        rows.append((rng.randint(0, 300) if i % 9 else None, text, "en"))
    return rows + rows[:40]


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_all_pairs_of_words(spark, seed):
    rows = variant_rows(seed)
    got = tuples(spelling.variants(docs_of(spark, rows, seed == 2)), "word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(rows)
    assert got == want
    assert len(want) > 50 and sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_variants_of_nothing(spark):
    assert spelling.variants(docs_of(spark, [])).count() == 0
    assert spelling.variants(docs_of(spark, [(1, None, None), (2, "a b c", "en")])).count() == 0


def test_chains_of_forms_are_followed_to_their_end(spark):
    forms = spark.createDataFrame([(k, k + 1 if k < 63 else None) for k in range(64)], "id long, form long")
    assert {(r.id, r.root) for r in spelling.rooted(forms).collect()} == {(k, 63) for k in range(64)}


# 13: phrases


def plain_collocations(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", low(t)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {}
        for p, a in own.items():
            if len(p) > 1 and a >= least:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                found[p] = (score, a, own[p[:k]], own[p[k:]])
        covered = {q for p in found for n in range(2, len(p)) for i in range(len(p) - n + 1) for q in [p[i : i + n]] if 100 * found[p][1] >= 80 * found[q][1]}
        best = sorted((-s, -a, " ".join(p).encode(), " ".join(p), l, r) for p, (s, a, l, r) in found.items() if p not in covered)[:top]
        out += [(lang, i, p, -a, l, r, total[lang], -s) for i, (s, a, _, p, l, r) in enumerate(best, 1)]
    return sorted(out, key=str)


def phrase_rows(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["The", "cat", "sat", "été", "\U0001f600", "a\u00a0b", "x-1", "no", "of", "in"] + [f"w{k}" for k in range(400)]
    fixed = ["the cat sat on", "new york city hall", "à la carte", "of the"]
    rows = [(1, None, "en"), (2, "", None), (3, " \t .,;:!?\n\x0b\x0c\r", "en"), (4, "lone", "zz"), (5, "The cat\tsat  on. The cat", "und"), (6, "a b a b a b a b a b " * 2000, "en")]
    for i in range(n):
        bits = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        rows.append((i, "".join(b + rng.choice([" ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "! "]) for b in bits), rng.choice(["en", "en", "en", "de", None])))
    return rows + rows[:30]


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("least,top,bits", [(3, 50, None), (2, 100000, 16), (5, 7, 21)])
def test_phrases_match_plain_counts(spark, least, top, bits):
    rows = phrase_rows(least)
    got = tuples(phrases.collocations(docs_of(spark, rows, least == 3), least=least, top=top, bits=bits), *PHRASE)
    want = plain_collocations(rows, least, top)
    assert got == want and len(want) > 10


def test_phrases_of_few_texts(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


def test_a_wide_sketch_drops_rare_runs_and_a_narrow_one_loses_none(spark):
    """Runs that reach the exact count: nearly only the frequent ones by a wide sketch, more by a narrow one, every frequent one by both."""
    rows = phrase_rows(7, 2000)
    docs = docs_of(spark, rows).repartition(6)
    reached, real = {}, phrases._surviving
    for bits in (16, 24):
        out = phrases.frequencies(docs, least=20, bits=bits)
        reached[bits] = {(r.lang, r.phrase): r.n for r in out.filter("k > 0").collect()}
        path = phrases.mounted(phrases.scratch(spark, "x")).rsplit("/", 1)[0]
    assert reached[16] == reached[24] and len(reached[16]) > 400
    import glob

    narrow, wide = sorted(glob.glob(f"{path}/sketch-*"), key=os.path.getmtime)[-2:]
    passed = {}
    for bits, at in ((16, narrow), (24, wide)):
        rows_ = docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        blocks = rows_.mapInArrow(real(at, bits), phrases.BLOCK).coalesce(1).sortWithinPartitions("shard")
        passed[bits] = blocks.mapInArrow(phrases._adding(1), phrases.COUNTS).filter("k > 0").select("lang", "phrase").distinct().count()
    assert len(reached[24]) <= passed[24] <= 1.01 * len(reached[24]) and passed[24] < passed[16]


# near copies of the pipeline


def test_near_copies_of_many_files_need_few_descriptors(tmp_path):
    n, own = 700, np.arange(20, dtype=np.uint64)
    for k in range(n):
        own.tofile(f"{tmp_path}/f{k}")
    rows = pa.RecordBatch.from_pydict({"cell": [k // 2 for k in range(n)], "i": [0] * n, "j": [0] * n, "node": list(range(n)), "file": [f"f{k}" for k in range(n)], "start": [0] * n, "size": [20] * n})
    limits = resource.getrlimit(resource.RLIMIT_NOFILE)
    used = max(map(int, os.listdir("/proc/self/fd")))
    resource.setrlimit(resource.RLIMIT_NOFILE, (used + 40, limits[1]))
    try:
        edges = [(a, b) for out in copies.verified(str(tmp_path))(iter([rows])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    assert sorted(map(sorted, edges)) == [[2 * k, 2 * k + 1] for k in range(n // 2)]
