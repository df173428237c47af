import random

import numpy as np

from echoplane.llm import components as c
from echoplane.llm import simhash as m


def _out(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    df.createOrReplaceTempView("docs_for_simhash")
    rows = m.assign(df).collect()
    return {r._id: (f"{r.fp % 2**64:016x}", r._component) for r in rows}


def _texts():
    rng = random.Random(2)
    words = [f"Word{k}" for k in range(300)] + ["É"]
    base = [rng.choices(words, k=rng.randint(60, 200)) for _ in range(12)]
    texts = {}
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w)
    return texts | {200: None, 201: "", 202: "one", 203: "ONE", 204: "one two", 205: "x " * 3000, 206: "\n\t "}


def test_matches_brute_force(spark, monkeypatch):
    texts = _texts()
    want = m.brute_force(texts)
    assert _out(spark, texts) == want
    monkeypatch.setattr(m, "HOT", 5)  # keys are dealt again, to the last level
    assert _out(spark, texts) == want


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for b in base]))
    a, b = m.link_forest(fp)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp) <= 3)
    pairs = near[near[:, 0] < near[:, 1]]
    assert len(a) < len(fp)
    got, want = (dict(zip(*c.local_stars(x, y))) for x, y in ((a, b), (pairs[:, 0], pairs[:, 1])))
    assert got == want


def test_components(spark, monkeypatch):
    path = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5000, 400)] + [(7, 1000 + i) for i in range(50)]
    want = {i: 0 for i in [*range(1, 61), *range(1000, 1050)]} | {200: 100, 300: 100, 5000: 400}
    for few in (c.FEW, -1):
        monkeypatch.setattr(c, "FEW", few)
        got = {r.node: r.component for r in c.components(spark.createDataFrame(path, "u long, v long").repartition(7)).collect()}
        assert got == want
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "z z y", 3), (9, "q q r s", None)], "doc_id long, text string, fp int")
    rows = m.keep_first(df).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(5, "a b c d"), (5, "z z y"), (9, "q q r s")]
    assert m.keep_first(df.limit(0)).count() == 0


def test_repeated_and_missing_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(rng.choices([f"v{k}" for k in range(500)], k=40)) for _ in range(4))
    rows = [(None, a, 1), (None, b, 2), (None, c, 3), (5, a, 4), (6, b, 5), (8, d, 6), (8, a, 7), (9, d, 8), (9, d, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = {(r._id, r.fp): r._component for r in m.assign(df).collect()}
    fp = {t: int(m.text_fingerprints([t.encode()])[0].astype("int64")) for t in (a, b, c, d)}
    assert got == {(m.NULL_ID, fp[a]): 5, (m.NULL_ID, fp[b]): 6, (m.NULL_ID, fp[c]): m.NULL_ID, (5, fp[a]): 5, (6, fp[b]): 6, (8, fp[d]): 8, (8, fp[a]): 5, (9, fp[d]): 8}
    assert sorted(r.n for r in m.keep_first(df).collect()) == [3, 4, 5, 6]
    assert [r.n for r in m.keep_first(df.where("n = 8")).collect()] == [8]


def test_wide_tables_bring_all_near_fingerprints_together(spark, monkeypatch):
    rng = np.random.default_rng(3)
    flips = lambda: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 9), dtype=np.uint64))
    fp = np.unique(np.array([b ^ flips() for b in rng.integers(0, 2**64, 50, dtype=np.uint64) for _ in range(6)]))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp) <= 11)
    want = {(x, y) for x, y in zip(a.tolist(), b.tolist()) if x < y}
    nodes = spark.createDataFrame(list(zip(fp.view(np.int64).tolist(), range(len(fp)))), "fp long, id long").repartition(3)
    for hot in (m.HOT, 12):  # all keys as they are, or the larger ones dealt again
        monkeypatch.setattr(m, "HOT", hot)
        got = {(min(r.u, r.v), max(r.u, r.v)) for r in m.links(nodes, 11, 100).collect()}
        assert got == want and len(want) > 400
    near = np.bitwise_count(fp[:, None] ^ fp) + np.where(np.eye(len(fp), dtype=bool), 99, 0)
    a, b = m.near_pairs(fp, 11, 1, 1000)
    assert sorted(a.tolist()) == [i for i in range(len(fp)) if near[i].min() <= 11]
    assert all(near[i, j] == near[i].min() for i, j in zip(a, b))
