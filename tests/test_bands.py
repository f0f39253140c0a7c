"""The store of signatures by bands against comparing all pairs."""

import random

from loomstone.operators import bands


def sets(t):
    w = (t or "").lower().split()
    return set(w) if len(w) < 3 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}


def test_probes_find_nearly_all_similar_sets_and_no_other(spark, tmp_path):
    rng = random.Random(1)
    known = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(60))) for k in range(120)]
    known += [(200 + k, known[0][1]) for k in range(40)] + [(300, None), (301, ""), (302, "one two")]
    new = []
    for k in range(120):
        words = known[k][1].split()
        for _ in range(k % 4):
            words[rng.randrange(60)] = f"x{rng.randrange(99)}"
        new.append((1000 + k, " ".join(words)))
    new += [(2000, None), (2001, "One  TWO"), (2002, "nothing like this here")]
    path, schema = str(tmp_path / "store"), "id long, content string"
    bands.add(spark.createDataFrame(known[:100], schema), path)
    bands.add(spark.createDataFrame(known[80:], schema), path)  # 20 come twice
    got = {(r.id, r.other): (round(r.jaccard, 9), r.copies) for r in bands.probed(spark, path, spark.createDataFrame(new, schema), 0.6).collect()}
    members: dict = {}
    for i, t in known[:100] + known[80:]:
        if sets(t):
            members.setdefault(frozenset(sets(t)), []).append(i)
    want = {}
    for i, t in new:
        for s, ids in members.items():
            j = len(s & sets(t)) / len(s | sets(t)) if sets(t) else 0
            if j >= 0.6:
                want[i, min(ids)] = (round(j, 9), len(ids))
    assert set(got.items()) <= set(want.items())
    high = {k for k, (j, _) in want.items() if j >= 0.8}
    assert len(high) > 60 and len(high & got.keys()) >= 0.95 * len(high)
    assert got[1000, 0] == (1.0, 41) and got[2001, 302] == (1.0, 1)
    assert spark.read.parquet(f"{path}/bands").count() == 16 * len(members)
