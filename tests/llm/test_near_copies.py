import random

import numpy as np

import corpus_pipeline
from echoplane.llm import near_copies as m
from echoplane.llm import simhash


def _texts():
    rng = random.Random(6)
    words = [f"Word{k}" for k in range(400)] + ["É"]
    base = [rng.choices(words, k=rng.randint(5, 150)) for _ in range(10)]
    common = rng.choices(words, k=30)
    texts = {}
    for i in range(260):
        w = list(base[0] if i % 3 == 0 else rng.choice(base)) if i % 5 else rng.choices(words, k=25) + common
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w)
    return texts | {300: None, 301: "", 302: "one", 303: "ONE", 304: "one two", 305: "x " * 3000, 306: "\n\t "}


def test_matches_brute_force(spark, monkeypatch):
    texts = _texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = m.brute_force(texts)
    assert {r.doc_id for r in m.keep_first(df).collect()} == want and 20 < len(want) < 240
    monkeypatch.setattr(m, "SAMPLE_DOCS", 1)  # no shingle is known to be common: large groups
    monkeypatch.setattr(m, "COMMON", 10**9)
    links = m.links
    monkeypatch.setattr(m, "links", lambda docs, sets, width, similar: links(docs, sets, width, similar, 2, 7))  # and many blocks
    assert {r.doc_id for r in m.keep_first(df).collect()} == want


def test_the_stage_finds_what_fingerprints_of_three_bits_do_not(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(900)]
    rows, n = [], 0
    for _ in range(20):
        w = rng.choices(words, k=120)
        other = list(w)
        for k in (20, 70):
            other[k] = "changed"
        rows += [(n, " ".join(w), "s"), (n + 1, " ".join(other), "s")]
        n += 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_copies(spark, df, "").collect()
    assert sorted(r.doc_id for r in out) == list(range(0, n, 2))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "z z y", 3), (9, "q q r s", None), (9, "q q r s", None)], "doc_id long, text string, s int")
    assert sorted((r.doc_id, r.text) for r in m.keep_first(df).collect()) == [(5, "a b c d"), (5, "z z y"), (9, "q q r s")]
    assert m.keep_first(df.limit(0)).count() == 0


def test_the_stage_finds_links_by_fingerprints(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(900)]
    texts = []
    for _ in range(20):
        w = rng.choices(words, k=120)
        other = list(w)
        for k in (20, 70):
            other[k] = "changed"
        texts += [" ".join(w), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = m.ordered_sets([t.encode() for t in texts], np.zeros(0, np.uint64))
    name, fp = np.array([m.set_name(s) for s in sets]).view(np.int64).tolist(), m.fingerprints(sets)
    differ = np.bitwise_count(fp[::2] ^ fp[1::2])
    want = {tuple(sorted(name[2 * k : 2 * k + 2])) for k in np.flatnonzero(differ <= 11).tolist()}
    found, real = [], m.by_fingerprints
    monkeypatch.setattr(m, "by_fingerprints", lambda *x: found.append(real(*x)) or found[-1])
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()) == list(range(0, 40, 2))
    assert {tuple(r) for r in found[0].select("u", "v").collect()} == want and len(want) > 15 and differ.max() > 3


def test_links_that_no_fingerprints_show(spark, monkeypatch):
    texts = _texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, bits, each: links(nodes, bits, each).limit(0))
    assert {r.doc_id for r in m.keep_first(df).collect()} == m.brute_force(texts)
