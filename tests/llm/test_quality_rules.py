import random
from collections import Counter

import numpy as np

from echoplane.llm import quality_rules as m

SF = "/root/testdata/sf0.01"


def test_statistics_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["é", "#a*", "|", "\x1d", "x\x00y", "<b>"]
    texts = {}
    for i in range(120):
        w = rng.choices(words[: rng.choice([2, 10, 36])], k=rng.randint(0, 90))
        if i % 3 == 0:
            w += w[: rng.randint(0, 30)]
        texts[i] = "".join(x + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]) for x in w)
    texts |= {200: None, 201: "", 202: "a " * 7, 203: "a " * 8, 204: "a " * 9, 205: "b c " * 5000, 206: "x\nx\n\n\n \nx ", 207: "a b c d e f g h i a b c d e f g h"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_words int").repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in m.judge(df).collect()}
    assert got == {i: m.brute_force(t) for i, t in texts.items()}


def test_verdicts_follow_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = m.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.15


def test_model_weighs_rules_by_accuracy():
    rng = np.random.default_rng(1)
    good = rng.random(3000) < 0.7
    cols = {"a": 0.95, "b": 0.9, "c": 0.55, "d": 0.92}
    votes = {n: [None if rng.random() < 0.3 else int(g if rng.random() < r else not g) for g in good] for n, r in cols.items()}
    model = m.Model(list(cols)).fit(list(Counter(zip(*votes.values())).items()), 25)
    gap = {n: r[1][0] / (r[1][0] + r[1][1]) for n, r in model.rates.items()}
    assert abs(model.good - 0.7) < 0.06 and min(gap, key=gap.get) == "c"


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2)], "doc_id long, text string, h int")
    assert m.judge(df).count() == 3 and not m.judge(df).where("kept").count()
    assert m.judge(df.limit(0)).count() == 0
