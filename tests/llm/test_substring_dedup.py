import random

import numpy as np

from echoplane.llm import substring_dedup as m


def _run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, bucket string").repartition(3)
    from pyspark.sql import functions as F

    out = m.dedup_substrings(df, **kw).withColumn("sha", F.sha2("kept", 256)).collect()
    return {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in out}


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)] + ["é ü", "x" * 300]
    shared = " ".join(rng.choices(words, k=70))
    texts = {}
    for i in range(60):
        body = rng.choices(words, k=rng.randint(0, 150))
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), shared)
        texts[i] = rng.choice([" ", "\n", "\t \r\n"]).join(body)
    texts |= {100: None, 101: "", 102: "a " * 500, 103: "a " * 300, 104: texts[3], 105: texts[3] + " tail", 106: " ".join(words[:19])}
    assert _run(spark, texts) == m.brute_force(texts)
    with monkeypatch.context() as c:
        c.setattr(m, "MOST_BYTES", 300)  # most buckets are too large to gather
        assert _run(spark, texts) == m.brute_force(texts)
    monkeypatch.setattr(m, "_common_seeds", lambda *a: np.sort(np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)))
    assert _run(spark, texts, window=8, seed=3) == m.brute_force(texts, 8)


def test_copies_keep_only_the_first(spark):
    text = " ".join(f"t{k}" for k in range(50))
    out = _run(spark, {i: text for i in range(30)})
    assert out[0][1] == 0 and all(out[i][1] == 50 for i in range(1, 30))


def test_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "doc_id long, text string")
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in m.dedup_substrings(df).collect())
    assert rows == [(-1, 30), (1, 0), (1, 0), (2, 0)]
    assert m.dedup_substrings(df.limit(0)).count() == 0


def test_settled_spans_go_to_any_bucket():
    import pyarrow as pa

    rng = random.Random(6)
    page = " ".join(f"p{k}" for k in range(120))
    got = {}
    for c in range(60):
        texts = [page + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
        batch = pa.RecordBatch.from_pydict({"_id": list(range(c * 12, c * 12 + 12)), "_th": [rng.getrandbits(62) for _ in texts], "text": texts})
        for b in m._bundles(20, 3, 32, np.zeros(0, np.uint64))(iter([batch])):
            for bucket, bundle in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[bucket] = got.get(bucket, 0) + len(bundle)
    sizes = sorted(got.values())
    assert sizes[-1] < 5 * sizes[len(sizes) // 2]
