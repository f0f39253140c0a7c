"""Each operator against a brute-force version on small hostile tables: nulls, empty and long texts, ties, repeated rows, clashing columns; and empty tables."""

import itertools
import math
import os
import pickle
import re
import subprocess
import sys
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from loomstone.llm import components, copies, decontam, licenses, lines, lm, mixing, quality, simhash, toxicity, urls, warc
from loomstone.llm import tokens as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.withColumn("score", F.lit(1)).withColumn("__id", F.lit(2)).withColumn("label", F.lit("x")) if extra else df


ROWS = [
    (1, "The cat sat on the mat. The cat sat on the mat.\nA line 12 of text", "a"), (2, "", "a"), (3, None, None), (4, "the Cat  sat\ton the mat", "b"),
    (5, "word " * 3000, "b"), (6, "été à la\u00a0plage É", None), (6, "été à la\u00a0plage É", None), (None, "nobody owns this text here", "c"), (8, "\n\n \x0b\x0c", "c"), (9, "x", "a"),
]


# words and hashes


def test_words_and_hashes_match_python():
    texts = [(t or "").encode() for _, t, _ in ROWS] + [b"a" * 3_000_000, b"A b\rC\nd", *(b"abcdefghijklmnopqrstuvwxyz"[:k] for k in range(1, 27)), b"x" * 511, b"x" * 512, b"x" * 520]
    for separators, rx in ((tk.SPACE, rb"[^\x20\x09-\x0D]+"), (tk.NOT_ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = tk.words(pa.array(texts, pa.binary()), separators, lower=True)
        got = [[bytes(w.buf[a:b]) for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])] for lo, hi in zip(w.first, w.first[1:])]
        assert got == [re.findall(rx, t.lower()) for t in texts]
        of = {}
        for word, h in zip(itertools.chain(*got), w.hashes().tolist()):
            assert of.setdefault(word, h) == h
        assert len(set(of.values())) == len(of)


def test_slices_keep_every_row():
    b = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in (0, 5, 100, 0, 7)], pa.binary())], ["t"])
    assert [r for s in tk.slices(b, "t", 10) for r in s.column(0).to_pylist()] == b.column(0).to_pylist()
    assert [s.num_rows for s in tk.slices(b.slice(1), "t", 10)] == [1, 1, 2]


# 1: language model


def kneser_ney(texts, order, rx=WORD, base=None):
    """A plain model: token -> probability after a context; word counts; n-gram counts.  base: the distribution below the words."""
    counts = [Counter() for _ in range(order + 1)]
    raw = Counter()
    for t in texts:
        s = ["<s>"] * (order - 1) + rx.findall(low(t)) + ["</s>"]
        raw.update(s[order - 1 :])
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order, 1, -1):
        for g in counts[k]:
            counts[k - 1][g[1:]] += 1
    d = [None] + [[0, *lm.discounts([sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)])] for n in range(1, order + 1)]
    vocabulary = len(raw)

    def p(word, context):
        n = len(context) + 1
        own = {g: c for g, c in counts[n].items() if g[:-1] == context}
        total = sum(own.values())
        below = p(word, context[1:]) if n > 1 else base(word) if base else 1 / (vocabulary + 1)
        if not total:
            return below
        c = own.get((*context, word), 0)
        return (max(c - d[n][min(c, 3)], 0) + sum(d[n][min(x, 3)] for x in own.values()) * below) / total

    return p, raw, counts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_matches_a_plain_model(spark, order):
    train, test = ROWS[:6], ROWS
    model = lm.fit(docs_of(spark, train, True), order, shard_bytes=4000)
    got = {(r.doc_id, i): r for i, r in enumerate(lm.score(docs_of(spark, test, True), model).collect())}
    p, raw, _ = kneser_ney([t for _, t, _ in train], order)
    n, v = sum(raw.values()), len(raw)
    assert (model.tokens, model.types) == (n, v)
    want = defaultdict(list)
    for i, t, _ in test:
        s = ["<s>"] * (order - 1) + WORD.findall(low(t)) + ["</s>"]
        own = range(order - 1, len(s))
        want[i].append((len(own), sum(raw[s[k]] > 0 for k in own), sum(math.log10((raw[s[k]] + 1) / (n + v + 1)) for k in own), sum(math.log10(p(s[k], tuple(s[k - order + 1 : k]))) for k in own)))
    found = defaultdict(list)
    for (i, _), r in got.items():
        found[i].append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert found.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(found[i]), sorted(want[i])):
            assert a == pytest.approx(b, rel=1e-9)
    words = [*raw, "never-seen"]
    assert sum(p(w, ("<s>",) * (order - 1)) for w in words) == pytest.approx(1)


def test_lm_of_many_files_needs_few_descriptors(spark, tmp_path):
    train = docs_of(spark, [(i, " ".join(f"w{(i * 37 + k * k) % 911}" for k in range(60)), "a") for i in range(400)])
    model = lm.fit(train, shard_bytes=1600)
    assert len([f for p in (model.path, model.vocabulary.path) for f in os.listdir(p) if not f.endswith((".index", ".npy"))]) == 512
    texts = [r.text for r in train.orderBy("doc_id").limit(40).collect()]
    (tmp_path / "model").write_bytes(pickle.dumps((model, texts)))
    code = """
import pickle, resource, sys, pyarrow as pa
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
from loomstone.llm import lm, tokens as tk
model, texts = pickle.load(open(sys.argv[1], "rb"))
batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], ["__text"])
print([s for b in lm.scorer(model, [], tk.SPACE)(iter([batch])) for s in b.column("score").to_pylist()])
"""
    got = subprocess.run([sys.executable, "-c", code, str(tmp_path / "model")], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(lm.__file__)) + "/..")
    assert got.returncode == 0, got.stderr
    want = [r.score for r in lm.score(train.filter("doc_id < 40"), lm.fit(train)).orderBy("doc_id").collect()]
    assert eval(got.stdout) == pytest.approx(want, rel=1e-9)


def test_lm_shards_within_files(spark, monkeypatch):
    train = docs_of(spark, [(i, " ".join(f"w{(i * 37 + k * k) % 911}" for k in range(60)), "a") for i in range(100)])
    want = sorted(r.score for r in lm.score(train, lm.fit(train)).collect())
    monkeypatch.setattr(lm, "FILE_BITS", 2)
    model = lm.fit(train, shard_bytes=500)
    assert model.file_bits == 2 < model.bits
    assert sorted(r.score for r in lm.score(train, model).collect()) == pytest.approx(want, rel=1e-9)


def test_arrays_of_counts_and_keys():
    counts = np.array([1, 254, 255, 7, 1 << 40], np.uint64)
    assert lm.values_at(np.arange(5), *lm.fewer(counts)).tolist() == counts.tolist()
    sums = np.array([(a + 2 * b + max(r, 3 * c), a, b, c) for a in (0, 1, 7, 8, 15, 16) for b in (0, 1, 2, 3, 4) for c in (0, 1, 2) for r in ((0,) if not c else (3, 8, 9, 900))])
    assert lm.sums_at(np.arange(len(sums)), *lm.coded(sums)).tolist() == sums.tolist()
    rng = np.random.default_rng(1)
    for n in (1, 2, 15, 16, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64) >> np.uint64(9))  # agree in the first 10 bits
        absent = np.setdiff1d(rng.integers(0, 1 << 63, 500, np.uint64) >> np.uint64(9), keys)
        arrays = lm.bucketed(keys, 10)
        assert lm.places(*arrays, keys, 10).tolist() == [*range(len(keys))]
        assert (lm.places(*arrays, absent, 10) == -1).all()


def test_lm_without_rows(spark):
    empty = docs_of(spark, ROWS).limit(0)
    model = lm.fit(empty)
    assert (model.tokens, model.types) == (0, 0)
    assert lm.score(empty, model).count() == 0
    assert lm.score(docs_of(spark, ROWS[:2]), model).select("score").first()[0] == pytest.approx(0)


# 2: toxicity


def test_toxicity_finds_marked_texts(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(700):
        t = rng.choice(words, 40).tolist()
        if i % 4 == 0:
            for k in rng.choice(40, 3):
                t[k] = "nasty" if k % 2 else "Vile!"
        rows.append((i, " ".join(t), "a"))
        labels.append((i, int(i % 4 == 0) if i % 50 else 7, i))
    rows += [(1000, None, "a"), (1001, "", "a"), (1001, "", "a"), (None, "nasty vile nasty", None)]
    docs = docs_of(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, toxic int, text long")
    models = toxicity.fit(docs, table.filter("doc_id % 5 <> 0 or doc_id is null"))
    got = toxicity.scored(docs.drop("source").withColumn("contrast", F.lit(1)), models).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if r.doc_id is not None and r.doc_id < 700 and r.predicted != (r.doc_id % 4 == 0)]
    assert len(wrong) < 14
    assert all(0 <= r.score <= 1 for r in got) and all(r.predicted == (r.score >= 0.5) for r in got)
    assert [r.predicted for r in got if r.doc_id is None] == [1] and {r.predicted for r in got if (r.doc_id or 0) >= 1000} == {0}
    kept = toxicity.kept(docs, models)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_toxicity_matches_plain_likelihoods(spark):
    rng = np.random.default_rng(5)
    classes = [[" ".join(rng.choice([*[f"w{k}" for k in range(12)], *(["vile", "You vile"] if y else ["kind"])], 15)) for _ in range(30)] for y in (0, 1)]
    tables = [docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]) for texts in classes]
    both = tables[0].union(tables[1])
    words = lm.vocabulary(both, separators=tk.NOT_ALNUM)
    models = toxicity.Toxicity(tuple(lm.fit(x, separators=tk.NOT_ALNUM, words=words) for x in tables), lm.fit(both, separators=tk.NOT_ALNUM, words=words), 1.0, 0.0, 2.5, 0.7)
    ps, _, _ = kneser_ney(classes[0] + classes[1], 3, ALNUM)
    own = [kneser_ney(texts, 3, ALNUM, lambda w: ps(w, ())) for texts in classes]

    def apart(gram):
        n = len(gram)
        a, b = (c[n][gram] for _, _, c in own)
        x, y = (sum(c[n].values()) for _, _, c in own)
        part = lambda k, q: k * math.log(k / ((a + b) * q)) if k else 0
        return math.sqrt(2 * (part(b, y / (x + y)) + part(a, x / (x + y)))) >= 2.5 and abs(math.log((b + 0.5) / (y + 1)) - math.log((a + 0.5) / (x + 1))) >= 0.7

    texts, shared, apart_ = [*classes[0][:3], *classes[1][:3], "Vile never seen, you kind w1", "", None], 0, 0
    for t, got in zip(texts, toxicity.contrast(models, pa.array([(t or "").encode() for t in texts]))):
        s = ["<s>", "<s>", *ALNUM.findall(low(t)), "</s>"]
        total = [0.0, 0.0]
        for k in range(2, len(s)):
            told = apart((s[k],)) or apart((s[k - 1], s[k]))
            shared, apart_ = shared + (not told), apart_ + told
            for y in (0, 1):
                total[y] += math.log((own[y][0] if told else ps)(s[k], (s[k - 2], s[k - 1])))
        assert got == pytest.approx((total[1] - total[0]) / (len(s) - 2), abs=1e-9)
    assert shared and apart_


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ROWS, True)
    models = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scored(docs, models).collect()} == {0.5}
    one = toxicity.fit(docs, spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int"))
    assert toxicity.kept(docs, one).count() == len(ROWS)


def test_toxicity_keeps_all_without_labels(spark):
    docs = docs_of(spark, ROWS, True)
    for labels in ([], [(1, 1)]):
        assert toxicity.kept(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).count() == len(ROWS)


# 3: mixing


def targets(sizes, cycle, epochs):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    out, left, total = {}, set(names), sum(sizes.values())
    while left:
        level = (total - sum(out.values())) / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] >= epochs * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in left}
        out |= {s: epochs * sizes[s] for s in over}
        left -= over
    return out


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "hot" if i % 3 else f"s{i % 21}") for i in range(900)] + ROWS
    docs = docs_of(spark, rows)
    got = mixing.mixed(docs, per_block=50).collect()
    again = mixing.mixed(docs.repartition(7), per_block=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and r.copies <= 3
    want = targets(sizes, (1, 2, 3), 3)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest[s] / 2, 1e-6)
    repeated = mixing.repeated(docs, per_block=50)
    assert Counter(r.doc_id for r in repeated.collect()) == Counter({k: v for k, v in Counter(itertools.chain(*([r.doc_id] * r.copies for r in got))).items()})
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.repeated(docs.filter("text is null")).count() == 0


def test_mixing_of_many_sources_and_capped_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * (0 if k % 9 == 0 else int(rng.integers(1, 40)) ** 2 // 20)), f"s{int(rng.integers(0, 30)) ** 2 % 200}") for k in range(500)]
    for epochs in (3.0, 1.5, 0.5):
        got = mixing.mixed(docs_of(spark, rows), epochs=epochs, per_block=10).collect()
        sizes = Counter()
        for r in got:
            sizes[r.source] += r.size
        want = targets(sizes, (1, 2, 3), epochs)
        assert all(r.target == pytest.approx(want[r.source]) and r.copies <= math.ceil(epochs) for r in got)
        assert any(want[s] == epochs * sizes[s] for s in sizes if sizes[s])


def test_word_count(spark):
    got = docs_of(spark, ROWS).select("text", mixing.n_words(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [len(WORD.findall(r.text or "")) for r in got]


# 4: urls


def test_urls_match_all_rules(spark):
    hosts = ["example.com", "a.example.com", "EXAMPLE.com", "b.a.example.com", "notexample.com", "com", "x.net", "example.net", "org", "", "a..com", "example.com:80", "com\x01evil", "x.com\x01y", "b.x.com\x01y", "a\x01com", "com\x02", "\x03.com", "com\x03\x06evil", "a\x00.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x=/de/", "/de/8#f", "/de/", "/es/1", "/a?/en/"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate(itertools.product(hosts, paths))] + [(None, None), (7, "no scheme"), (7, "x://y://z/en/"), (9, "")] + [(10_000 + k, "http://hot.com/en/1") for k in range(300)]
    rules = [*urls.RULES, ("block", "a.example.com", "/"), ("allow", "A.example.com", "/"), ("block", "com", None), ("block", "x.com\x01y", "/e")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = urls.judged(pages, urls.rules_table(spark, rules), parts=16).collect()

    def one(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in ((v, low(h), p) for v, h, p in rules if p is not None) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: (x[0], x[1], x[3])) if fit else None
        return host, path, best and best[2], best[3] if best else "allow"

    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *one(u)) for i, u in rows)
    assert urls.judged(pages.limit(0), urls.rules_table(spark)).count() == 0
    assert {r.verdict for r in urls.judged(pages, urls.rules_table(spark).limit(0), default="block").collect()} == {"block"}


# 5: decontamination


def shingles(words, k=5):
    k = min(k, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def best_window(words, item):
    k = min(5, len(item))
    best = 0.0
    for i in range(max(1, len(words) - len(item) + 1)):
        window = words[i : i + len(item)]
        a, b = Counter(tuple(window[j : j + k]) for j in range(len(window) - k + 1)), shingles(item)
        both = sum((a & b).values())
        best = max(best, both / max(1, sum((a | b).values())))
    return best


def test_leaks_match_all_windows(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((3, 12, 25, 25, 40, 60))] + [(90, None), (91, "..."), (2, None)]
    rows = [(None, None, "a"), (0, "", "a"), (1, "v1", "a")]
    for i in range(2, 60):
        t = rng.choice(vocabulary, 80).tolist()
        own = items[i % 6][1].split()
        if i % 4:
            own = own[i % 3 :] if i % 4 == 1 else own
            if i % 4 == 3 and len(own) > 30:
                own[0] = "changed"
            t[10:10] = own
        rows.append((i, (" ".join(t) if i % 5 else ", ".join(t)).upper(), "a"))
    rows += [rows[7], (70, items[4][1][:-4], "a")]
    docs = docs_of(spark, rows, True)
    table = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(1))
    got = decontam.leaks(docs, table).collect()
    words = {k: ALNUM.findall(low(t)) for k, t in items if t and ALNUM.findall(low(t))}
    want = {(i, k) for i, t, _ in rows for k, w in words.items() if (s := ALNUM.findall(low(t))) and best_window(s, w) >= decontam.SIMILAR}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 40
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert r.similarity == pytest.approx(best_window(ALNUM.findall(low(text)), words[r.item_id]))
    clean = decontam.clean(docs, table)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _, _ in rows if i not in {d for d, _ in want})
    assert decontam.leaks(docs.limit(0), table).count() == 0 and decontam.clean(docs, table.limit(0)).count() == len(rows)


def test_blocks_hold_all_within_the_radius():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        p = int(rng.integers(0, 2**63))
        q = p ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, decontam.RADIUS + 1), replace=False))
        assert any(decontam.NEAR[p >> 8 * b & 255, q >> 8 * b & 255] for b in range(8))


def test_similar_windows_lie_within_the_radius():
    """Windows whose shingles have a similarity of 0.8 or more: how far their fingerprints are apart."""
    rng = np.random.default_rng(11)
    far = []
    for _ in range(300):
        h = rng.integers(0, 2**64, 60, np.uint64)
        n, edits = int(rng.integers(25, 61)), int(rng.integers(0, 3))
        x, y = h[:n], h[:n].copy()
        y[rng.choice(n, edits, replace=False)] = rng.integers(0, 2**64, edits, np.uint64)
        if decontam.weighted(decontam.shingled(x, 5), decontam.shingled(y, 5)) >= 0.8:
            far.append(int(np.bitwise_count(decontam.printed(decontam.signs(x).sum(axis=0, keepdims=True)) ^ decontam.printed(decontam.signs(y).sum(axis=0, keepdims=True)))[0]))
    assert len(far) > 100 and max(far) <= decontam.RADIUS


def test_items_in_files(spark):
    table = spark.createDataFrame([(k, f"alpha{k} beta gamma delta eps zeta eta") for k in range(20)], "item_id int, text string")
    path, n = decontam.written(table, "item_id", "text", 300)
    assert n > 3 and sorted(i for k in range(n) for i in decontam.opened(path, k).ids) == [*range(20)]


def test_long_texts_and_repeated_items():
    rng = np.random.default_rng(12)
    item = [f"i{x}" for x in rng.integers(0, 10**6, 800)]
    items = decontam.Items(decontam.indexed([7], [" ".join(item).encode()]))
    assert sum(a.nbytes for a in (items.h, items.first, items.prints, items.keys, items.starts, items.of)) < 30 * 800

    def held(text):
        w = tk.words(pa.array([text.encode()]), tk.NOT_ALNUM, lower=True)
        return decontam.searched(items, w, w.hashes())

    assert held(" ".join(["x"] * 7 + item * 20)) == [(0, 0, 1.0, 7)]
    filler = [f"f{k % 1000}" for k in range(300_000)]
    assert held(" ".join([*filler, *item, *filler])) == [(0, 0, 1.0, 300_000)]
    assert held(" ".join([*filler, *item[:500], *filler])) == []


# 6: line dedup


def line_keys(line):
    w = WORD.findall(low(line))
    if not w:
        return []
    m = ["<*>" if re.search("[0-9]", x) else x for x in w]
    out = [(len(m), *m)]
    if len(m) >= 4:
        rest = len(m) - 1
        for k in range(4):
            a, b = 1 + rest * k // 4, 1 + rest * (k + 1) // 4
            if a < b:
                out.append((len(m), k, *m[:a], *m[b:]))
    return out


def test_line_dedup_matches_a_plain_tree(spark):
    long = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    base = "shared line of nine words that stands in many texts"
    names = ["alice", "bob", "carol", "dora", "emil", "fritz", "gerda", "hans", "ida", "jo", "karl", "lisa"]
    general = "user alice logged in from the old house with a red key today".split()
    rows = []
    for i in range(30):
        g = general.copy()
        g[1] = g[1] if i % 2 else "bob"
        g[5:8] = [f"x{i % 4}", "new", "place"]
        own = [f"own line number {'abcdefghijklmnopqrstuvwxyz'[i % 26]} {chr(97 + i % 7)} of text that is here", base, "", "ok", " ".join(g), f"build {i} took {i * 7} ms on node n{i} and then it stopped all at once"]
        if i in (3, 17):
            own.append(long.upper())
        if i < 12:
            own.append(f"user {names[i]} logged in")
        if i % 5 == 0:
            own.append(f"opening {chr(97 + i)} words of mine that are one. Then comes a passage sentence that many of us share! And é one {i} more of them, which has quite enough words? Short one. rest {chr(97 + i)} of it all is mine again and again")
        rows.append((i, "\n".join(own), "a"))
    rows += [(None, base, "a"), (40, None, "a"), (41, "", "a"), (42, "\n\n", "a"), (3, rows[3][1], "a"), (50, "only\nonly\nonly\nonly", "b")]
    docs = docs_of(spark, rows).withColumn("n_lines", F.lit("mine"))
    got = lines.deduplicated(docs)
    first, need = defaultdict(set), {}

    def sentences(line):
        found = [m[0] for m in re.finditer(r"[^\x20\x09-\x0D].*?(?:[.!?](?=[\x20\x09-\x0D]|$)|$)", line)]
        return [s.rstrip() for s in found if 8 <= len(WORD.findall(s)) < len(WORD.findall(line))]

    for i, t, _ in rows:
        keys = {}
        for l in (t or "").split("\n"):
            for k in line_keys(l):
                keys[k] = len(WORD.findall(l))
            for s in sentences(l):
                keys[line_keys(s)[0]] = len(WORD.findall(s))
        for k, n in keys.items():
            first[k].add(i if i is not None else lines.LAST)
            need[k] = next(d for w, d in ((50, 2), (8, 3), (1, 10)) if n >= w)
    recurs = {k: min(first[k]) for k in first if len(first[k]) >= need[k]}
    want = []
    for i, t, _ in rows:
        hit = lambda keys: any(recurs.get(k, lines.LAST) < (i if i is not None else lines.LAST) for k in keys)  # noqa: B023, E731
        keep = []
        for l in (t or "").split("\n"):
            if not hit(line_keys(l)):
                for s in sentences(l):
                    if hit(line_keys(s)[:1]):
                        l = l.replace(s + " ", "", 1) if s + " " in l else l.replace(s, "", 1).rstrip(" ")
                keep.append(l)
        want.append((i, None if t is None else "\n".join(keep)))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
    assert sum(r.n_dropped for r in got.collect()) > 60 and sum(r.n_cut for r in got.collect()) >= 8
    assert [r.doc_id for r in got.collect() if r.text and "logged in\n" in f"{r.text}\n"] == [0]
    held = [r.doc_id for r in got.collect() if r.text and "passagebc" in low(r.text)]
    assert held == [3, 3]
    assert lines.deduplicated(docs.limit(0)).count() == 0
    named = lines.deduplicated(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")).collect()
    assert sum(r.n_dropped for r in named) > 60


def test_passages_of_two_documents_go(spark):
    rng = np.random.default_rng(15)
    word = ("".join(x) for x in itertools.product("abcdefghij", repeat=4))
    fresh = lambda n: [next(word) for _ in range(n)]
    short = [w + "." if k % 5 == 4 else w for k, w in enumerate(fresh(60))]  # sentences of 5 words
    plain, lines_, below = fresh(50), fresh(66), fresh(49)
    texts = []
    for k in range(8):
        own = fresh(30) + (short if k in (1, 4) else []) + fresh(9) + (plain if k in (2, 3, 6) else []) + fresh(12) + (below if k in (0, 5) else []) + fresh(7)
        text = " ".join(own)
        if k in (4, 7):
            text += "\n" + "\n".join(" ".join(lines_[a : a + 6]) for a in range(0, 66, 6)) + "\n" + " ".join(fresh(20))
        texts.append(text)
    order = rng.permutation(8).tolist()
    got = {r.doc_id: r.text for r in lines.deduplicated(docs_of(spark, [(k, texts[k], "a") for k in order])).collect()}
    seen = set()
    for k in range(8):
        w = texts[k].split()
        gone = np.zeros(len(w), bool)
        mine = {tuple(w[a : a + 50]): a for a in range(len(w) - 49)}
        for run, a in mine.items():
            if run in seen:
                gone[a : a + 50] = True
        seen |= mine.keys()
        assert got[k].split() == [x for x, g in zip(w, gone) if not g]
        assert gone.sum() == {4: 60, 3: 50, 6: 50, 7: 66}.get(k, 0)


# 7: near-duplicates


def plain_print(t):
    w = WORD.findall(low(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_components(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(200)]
    rows = list(ROWS)
    for g in range(25):
        base = rng.choice(vocabulary, 300).tolist()
        for c in range(5):
            t = base.copy()
            for _ in range(c):
                t[int(rng.integers(0, 300))] = "edit"
            rows.append((100 + g * 10 + c, " ".join(t), "a"))
    docs = docs_of(spark, rows, True)
    prints = simhash.fingerprints(docs).checkpoint()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in prints.collect()) == Counter((i, plain_print(t or "")) for i, t, _ in rows)
    got = simhash.near_duplicates(prints).collect()
    p = {plain_print(t or "") for _, t, _ in rows}
    of = roots(p, [(a, b) for a, b in itertools.combinations(p, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for i, t, _ in rows:
        r = of[plain_print(t or "")]
        least[r] = min(least.get(r, 1 << 60), i if i is not None else 1 << 60)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, x if (x := least[of[plain_print(t or "")]]) < 1 << 60 else None) for i, t, _ in rows)
    one = simhash.one_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in one.collect()) == sorted(x if x < 1 << 60 else -1 for x in least.values())
    assert simhash.one_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4, 512])
def test_near_copies_match_all_pairs(spark, monkeypatch, most):
    rng = np.random.default_rng(14)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = [*ROWS, (50, " ", "a"), (51, "\n", "a"), (52, "one two", "a"), (53, "One\ttwo", "a"), (54, "two one", "a")]
    for g in range(20):
        base = rng.choice(vocabulary, 250).tolist()
        for c in range(8):
            t = base.copy()
            for _ in range(c):
                t[int(rng.integers(0, 250))] = f"edit{int(rng.integers(0, 1000))}"
            rows.append((100 + g * 10 + c, " ".join(t), "a"))

    def shingled(t):
        w = WORD.findall(low(t))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    sets = [shingled(t) for _, t, _ in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    prints = [plain_print(t or "") for _, t, _ in rows]
    assert sum((prints[a] ^ prints[b]).bit_count() > 4 for a, b in pairs) > 50
    least = {}
    for k, r in roots(range(len(rows)), pairs).items():
        i = rows[k][0] if rows[k][0] is not None else 1 << 60
        least[r] = min(least.get(r, 1 << 60), i)
    docs = docs_of(spark, rows, True)
    links = copies.links
    monkeypatch.setattr(copies, "links", lambda texts: links(texts, most))
    one = corpus_pipeline.without_copies(spark, docs, "")
    assert one.columns == docs.columns and sorted(r.doc_id if r.doc_id is not None else 1 << 60 for r in one.collect()) == sorted(least.values())
    assert corpus_pipeline.without_copies(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("width, groups, most", [(2, 6, 8), (4, 7, 2048), (3, 5, 16)])
def test_links_are_whole(spark, width, groups, most):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(60):
        f = int(rng.integers(0, 2**63))
        fps.add(f)
        for _ in range(8):
            fps.add(f ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 6), replace=False)))
    signed = sorted(fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components.connected(simhash.links(df, 4, width, groups, most)).collect()}
    want = roots(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if (a ^ b).bit_count() <= 4])
    assert {n: got.get(n, n) for n in signed} == want


def test_groups_keep_compared_pairs_below_the_square():
    rng = np.random.default_rng(3)
    for n, groups in ((40_000, 6), (40_000, 7)):
        e = simhash.embedded(rng.integers(0, 2**64, n, np.uint64), 2)
        pairs = 0
        for m in simhash.masks(2, groups, 4):
            c = np.diff(tk.runs(np.sort(e & np.uint64(m))), append=n)
            pairs += int((c * (c - 1) // 2).sum())
        assert pairs == pytest.approx(simhash.chance_pairs(n, groups), rel=0.5)  # groups differ in size by a segment
    of = lambda n: simhash.chance_pairs(n, simhash.fitting(n))
    assert of(10**10) <= of(10**7) * 1000**1.35
    assert simhash.fitting(10**10) > simhash.fitting(10**9) > simhash.fitting(10**6)


def test_popcounts_bound_hamming():
    rng = np.random.default_rng(6)
    x, y = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    for width in (1, 2, 3, 4, 8):
        a, b = simhash.embedded(x, width), simhash.embedded(y, width)
        assert (np.bitwise_count(a ^ b) <= np.bitwise_count(x ^ y)).all()


def test_components_of_a_long_chain(spark):
    edges = [(k + 1, k) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 901), (902, 901)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500, 901: 900, 902: 900}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 8: licenses


def test_licenses_match_all_pairs(spark):
    mit = licenses.TEMPLATES[0][1]
    rows = ROWS + [
        (20, "Released under the MIT License. Cc by-nc, cc by nc cc by nc 4.0!", "a"), (21, mit.upper() + "\nmore", "a"), (22, "x y " * 90 + mit.replace("obtaining", "getting") + " z" * 50, "a"), (27, "/*\n * " + "\n * ".join(textwrap.wrap(mit, 60)) + "\n */\n", "a"), (28, " filler".join(mit.split()), "a"), (29, (mit + " ") * 30, "a"), (30, "under the mit license under the mit license under the mit license", "a"), (23, " ".join(mit.split()[:15]), "a"),
        (24, "Licensed under the Apache License, Version 2.0.\nCC BY NC", "a"), (24, "Licensed under the Apache License, Version 2.0.\nCC BY NC", "a"), (25, "This work is licensed\nunder the gnu general public license version 3", "b"), (26, "apache license version 20", "b"),
    ]
    got = licenses.scanned(docs_of(spark, rows, True)).collect()
    score = []

    def one(t):
        t = low(t)
        w = ALNUM.findall(t)
        starts, own, best = [], set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            q = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(q)] == q]
            starts += at
            own |= {label} if at else set()
        more = set(own)
        for label, text in licenses.TEMPLATES:
            words, width = set(text.split()), math.ceil(1.25 * len(text.split()))
            most = max(len(words & set(w[k : k + width])) for k in range(max(1, len(w))))
            if most >= math.ceil(0.95 * len(words) - 1e-9):
                more.add(label)
                best = max(best, most / len(words))
        score.append(1.0 if starts else best)
        return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(more))

    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got) == Counter((i, *one(t)) for i, t, _ in rows)
    assert sorted(r.score for r in got) == pytest.approx(sorted(score))
    assert [{r.labels for r in got if r.doc_id == i} for i in (22, 23, 27, 28)] == [{"mit"}, {""}, {"mit"}, {""}]
    themselves = licenses.scanned(docs_of(spark, [(k, text, "a") for k, (_, text) in enumerate(licenses.TEMPLATES)])).collect()
    assert all(r.labels == licenses.TEMPLATES[r.doc_id][0] for r in themselves)
    overlapping = licenses.scanned(docs_of(spark, [(1, "a b a b a (x) a.b", "a")]), phrases={"a b a": "l"}, templates=[]).first()
    assert (overlapping.n_base, overlapping.first_word, overlapping.last_word) == (2, 0, 2)
    assert licenses.scanned(docs_of(spark, rows).limit(0)).count() == 0
    assert {r.labels for r in licenses.scanned(docs_of(spark, rows), phrases={}, templates=[]).collect()} == {""}


# 9: WARC


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    rows = [(k, f"http://h/{k}\n", ["", "same", "a longer same page", f"page {k} é"][k % 4]) for k in range(60)] + [(None, None, "same"), (None, "u", None), (59, "again", "page 59 é"), (3, "other", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1))
    path, manifest = warc.write(pages, str(tmp_path / "a"), least=least, shard_bytes=8000, roll=2000)
    got = warc.read(path, manifest, payloads=True).collect()
    top = {}
    for i, _, t in rows:
        top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, t in rows:
        t = t or ""
        of = top[t] if len(t.encode()) >= least and top[t] != (-1 if i is None else i) else None
        want[(i, len(t.encode()), warc.digest(t.encode()), "response" if of is None else "revisit", of)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(warc.digest(bytes(r.payload)) == r.payload_digest for r in got if r.record_type == "response")
    files = {r.file: (r.records, r.bytes, r.sha1) for r in manifest.collect()}
    assert len(files) > 3 and sum(n for n, *_ in files.values()) == len(rows)
    again = warc.write(pages.repartition(5), str(tmp_path / "b"), least=least, shard_bytes=8000, roll=2000)[1]
    assert {r.file: (r.records, r.bytes, r.sha1) for r in again.collect()} == files
    for name in files:
        assert (tmp_path / "a" / name).read_bytes() == (tmp_path / "b" / name).read_bytes()
    assert warc.read(*warc.write(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_warc_shards_follow_bytes_not_ids(spark, tmp_path):
    rng = np.random.default_rng(9)
    text = lambda: "".join(map(chr, rng.integers(97, 123, 400)))
    html = [text() for _ in range(300)]

    def shards(ids, name):
        pages = spark.createDataFrame([(i, f"u{k}", html[k]) for k, i in enumerate(ids)], "page_id long, url string, html string")
        path, manifest = warc.write(pages, str(tmp_path / name), shard_bytes=9000)
        assert sorted(r.page_id for r in warc.read(path, manifest).collect()) == sorted(ids)
        return len({r.file.rpartition("-")[0] for r in manifest.collect()})

    n = shards(range(300), "even")
    assert n > 20
    hashed = rng.integers(-(2**63), 2**63 - 1, 300).tolist()
    for ids, name in (([*range(299), 1 << 60], "outlier"), (hashed, "hashed"), ([-9 * 10**18, 9 * 10**18, *range(298)], "wide"), ([7] * 150 + [*range(100, 250)], "repeated")):
        assert n <= 2 * shards(ids, name) <= 4 * n


# 10: quality


def plain_counts(t):
    w = WORD.findall(t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for l in (t or "").split("\n"):
        if WORD.search(l):
            dup += l in seen
            seen.add(l)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(cover)


def test_forest_paths_match_a_plain_walk():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 3)), 1)
    forest = quality.grow(x, trees=20, points=64, seed=3)
    points = np.concatenate([x[:40], [[9.0, -9.0, 0.0], [0.0, 0.0, 0.0]]])

    def depth(t, node, p):
        f = forest.feature[t, node]
        if f < 0:
            return forest.path[t, node]
        return depth(t, forest.left[t, node] + (p[f] >= forest.split[t, node]), p)

    def norm(n):
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    want = [2 ** (-sum(depth(t, 0, p) for t in range(20)) / (20 * norm(64))) for p in points]
    assert forest.scores(points) == pytest.approx(want)
    assert forest.scores(points)[-2] > np.quantile(forest.scores(x), 0.99)
    again = quality.grow(x, trees=20, points=64, seed=3)
    assert (again.scores(points) == forest.scores(points)).all()
    y = np.r_[np.ones(200, int), np.zeros(100, int)]
    lost = quality.calibrated(forest, x, y, 0.05)
    assert (lost.scores(x[:200]) >= lost.threshold).sum() <= 10


def test_quality_counts_and_verdicts(spark):
    rng = np.random.default_rng(7)
    good = [(100 + i, " ".join("abcdefghij"[: int(rng.integers(2, 9))] + chr(97 + int(rng.integers(0, 26))) for _ in range(int(rng.integers(20, 200)))), "a") for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{chr(97 + k % 26)}{'###%%%'[: 1 + k % 5]}" for k in range(30 + i)), "a") for i in range(40)]
    rows = ROWS + good + bad + [(7, "a\r\na\r\nb\nb\nb \n<%>", "c")]
    docs = docs_of(spark, rows).withColumn("anomaly", F.lit(1)).withColumn("quality", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in good + bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.judged(docs, quality.fit(docs.drop("quality"), labels)).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got) == Counter((i, *plain_counts(t)) for i, t, _ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) and 0 < r.anomaly <= 1
    assert sum(r.kept for r in got if r.doc_id and 100 <= r.doc_id < 1000) >= 298
    assert sum(r.kept for r in got if r.doc_id and r.doc_id >= 1000) <= 4
    empty = quality.fit(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality.judged(docs, empty).collect())
    assert quality.judged(docs.limit(0), empty).count() == 0
