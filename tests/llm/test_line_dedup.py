import random

import numpy as np
from pyspark.sql import functions as F

from echoplane.llm import line_dedup as m


def _texts(seed=3):
    rng = random.Random(seed)
    lines = [f"The shared line number {k}" for k in range(25)] + ["short", "", "  ", "éééééééééé", "ÉCOLE ÉCOLE", "x y long enough", "\x1d separators stay \x1d"]
    texts = {}
    for i in range(50):
        own = [rng.choice(lines) for _ in range(rng.randint(0, 12))] + [f"own line of {i} and so on"] * 2
        own = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", "\r", " \x0b"]) for x in own]
        texts[i] = "\n".join(own)
    return texts | {90: None, 91: "", 92: "\n\n", 93: "The shared line number 1\n" * 2000}


def _out(df):
    rows = df.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    return {r.doc_id: (r._n_lines, r._n_dropped, r.sha) for r in rows}


def test_matches_brute_force(spark, monkeypatch):
    texts = _texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert _out(m.dedup_lines(df)) == m.brute_force(texts)
    monkeypatch.setattr(m, "MOST_BYTES", 200)  # most shards are too large to gather
    assert _out(m.dedup_lines(df)) == m.brute_force(texts)


def test_settled_lines_go_to_any_shard():
    import pyarrow as pa

    page = "\n".join(f"line {k} of the page that is everywhere" for k in range(40))
    got = {}
    for c in range(60):
        batch = pa.RecordBatch.from_pydict({"_id": list(range(c * 9, c * 9 + 9)), "text": [page + f"\nown line number {c}.{k}" for k in range(9)]})
        for b in m._chunk_sums(32)(iter([batch])):
            for shard, bundle in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[shard] = got.get(shard, 0) + len(bundle)
    sizes = sorted(got.values())
    assert sizes[-1] < 5 * sizes[len(sizes) // 2]


def test_deleting_what_has_no_id(spark):
    line = "a line that is long enough"
    df = spark.createDataFrame([(None, line), (4, line), (7, line)], "doc_id long, text string")
    index = m.LineIndex.empty(spark, 2).insert(df).delete(spark.createDataFrame([(None,), (4,)], "doc_id long"))
    assert [(r["n"], r["first"]) for r in index.refs.collect()] == [(1, 7)] and index.filters.count() == 1


def test_odd_rows(spark):
    line = "a line that is long enough"
    df = spark.createDataFrame([(None, line, 1, "s"), (4, line, 2, None), (4, line, 3, "s"), (7, line, 4, "t")], "doc_id long, text string, _id long, `a.b` string")
    rows = {r.asDict()["_id"]: r for r in m.dedup_lines(df).collect()}
    assert [rows[k].text for k in (1, 2, 3, 4)] == ["", line, line, ""] and rows[4]["a.b"] == "t"
    assert m.dedup_lines(df.limit(0)).count() == 0


def test_index_is_reversible(spark):
    texts = _texts(5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).cache()
    first, rest = df.where("doc_id % 2 = 1"), df.where("doc_id % 2 = 0")
    one = m.LineIndex.empty(spark, 3).insert(first)
    both = one.insert(rest)
    assert _out(both.apply(df)) == m.brute_force(texts)
    back = both.delete(rest.select("doc_id"))
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, one.refs.collect()))
    assert _out(back.apply(first)) == m.brute_force({i: t for i, t in texts.items() if i % 2})


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20000).astype(np.uint64)
    f = m.CuckooFilter(20000)
    assert f.insert(h) and f.contains(h).all()
    assert f.contains(rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01
    f.delete(h[:10000])
    assert f.contains(h[10000:]).all() and f.contains(h[:10000]).mean() < 0.02
    f.delete(h[10000:])
    assert not f.table.any()
