import numpy as np
from pyspark.sql import functions as F

from echoplane.llm import quality_classifier as m

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = m.classify(docs, m.fit(docs, labels.where(~held_out))).join(labels.where(held_out), "doc_id").collect()
    clean = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in got if r.quality == 0]
    assert len(clean) > 50 and np.mean(clean) > 0.98 and np.mean(junk) < 0.12
    toxic = [r.keep for r in got if r.toxic == 1 and r.quality == 1]
    assert np.mean(toxic) < 0.5


def test_no_labels_needed(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = m.classify(docs, m.fit(docs)).join(labels, "doc_id").collect()
    assert np.mean([r.keep for r in got if r.quality == 1 and r.toxic == 0]) > 0.98
    assert np.mean([r.keep for r in got if r.quality == 0]) < 0.12


def test_em_finds_the_bad_labeller():
    rng = np.random.default_rng(0)
    truth = (rng.random(4000) < 0.3).astype(int)
    right = [0.95, 0.9, 0.6, 0.9]
    votes = np.stack([np.where(rng.random(4000) < r, truth, 1 - truth) for r in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = m.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, prior, rates = m.expectation_maximisation(patterns, counts.astype(float))
    accuracy = rates[:, 0, 0] / rates[:, 0, :2].sum(axis=1)
    assert abs(prior[1] - 0.3) < 0.05 and np.argmin(accuracy) == 2 and abs(accuracy[2] - 0.6) < 0.06


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "x" * 50000, None), (2, "Plain words are here.", "d")] * 3, "doc_id long, text string, pattern string")
    kept = m.keep_good(df)
    assert kept.columns == df.columns and kept.count() <= 12
    assert m.classify(df, m.fit(df)).count() == 12
    assert m.keep_good(df.limit(0)).count() == 0


def test_em_by_definition():
    """The same estimates, document by document."""
    rng = np.random.default_rng(4)
    votes = rng.integers(0, 4, (60, len(m.LABELLERS)))
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, prior, rates = m.expectation_maximisation(patterns, counts.astype(float), 3)
    guess = np.full((3, 4), 0.1)
    guess[[0, 1, 2], [0, 1, 2]], guess[:, 3] = 0.8, 1.0
    first = {j: guess.copy() for j in range(votes.shape[1])}
    for j, name in enumerate(m.LABELLERS):
        if name not in ("insults", "labels"):
            first[j][m.TOXIC] = guess[m.CLEAN]
        first[j] = first[j] / first[j].sum(axis=1, keepdims=True)
    share, rate = [0.6, 0.25, 0.15], {j: first[j].copy() for j in first}
    for _ in range(3):
        post = []
        for v in votes:
            p = [share[k] * np.prod([rate[j][k, v[j]] for j in rate]) for k in range(3)]
            post.append([x / sum(p) for x in p])
        share = [(sum(q[k] for q in post) + 1) / (len(votes) + 3) for k in range(3)]
        for j in rate:
            for k in range(3):
                seen = [sum(q[k] for q, v in zip(post, votes) if v[j] == x) + 4.0 * first[j][k, x] for x in range(4)]
                rate[j][k] = np.array(seen) / sum(seen)
    assert np.allclose(posterior[back.ravel()], post) and np.allclose(prior, share) and all(np.allclose(rates[j], rate[j]) for j in rate)


def test_odd_labels_and_the_bound_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "Plain words are here, and they go on for a while. " * 3 if i % 2 else "#### $$$$ **** |||| <<<< " * 9) for i in range(60)] + [(None, "x"), (1, "# $")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 0, 1), (2, None, None), (2, 0, None), (4, 0, 0), (4, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.keep for r in m.classify(docs.where("doc_id is not null and length(text) > 5"), m.fit(docs, labels)).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(60))
    monkeypatch.setattr(m, "TRAIN_BYTES", 1)  # one document, and still a model
    assert m.fit(docs, labels).any()


def test_a_tie_is_kept(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert m.keep_good(docs.limit(0)).count() == 0
    rows = m.classify(docs, np.zeros((m.FEATURES, 3))).collect()
    assert all(abs(r.p_clean - 1 / 3) < 1e-9 and not r.keep for r in rows)
    even = np.zeros((m.FEATURES, 3))
    even[:, m.TOXIC] = -1e3
    assert all(r.p_clean == 0.5 and r.keep for r in m.classify(docs, even).collect())
