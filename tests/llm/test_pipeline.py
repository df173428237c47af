import hashlib

import corpus_pipeline as p
from echoplane.llm import bpe, line_dedup, near_copies

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name == "quality classifier":
            assert all(before[i] == t for i, t in after.items()) and 0.5 < len(after) / len(before) < 1
        elif name == "line dedup":
            want = line_dedup.brute_force(before)
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()} == {i: x[2] for i, x in want.items()}
        elif name == "SimHash near-dedup":
            assert set(after) == near_copies.brute_force(before)
        elif name == "benchmark decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            text = {i: " ".join(t.split()) for i, t in before.items()}
            assert not any(" ".join(x.split()) in text[i] for i in after for x in items.values())
            assert len(before) - len(after) < 0.1 * len(before)
        else:
            want = bpe.brute_force(before)
            assert {r.doc_id: r.n_tokens for r in docs.collect()} == {i: x[0] for i, x in want.items()}
            assert all(r.decoded == (before[r.doc_id] or "") for r in docs.collect())


def test_run(spark):
    out = p.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 50


def test_odd_tables(spark, tmp_path):
    text = " ".join(f"Word{k} goes on here." for k in range(40))
    rows = [(None, text, "en"), (None, text + " more", "en"), (3, text, None), (3, "An entirely different text, which is long enough to be kept as it is.", "en"), (4, None, "en"), (5, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for part in (docs, docs.limit(0)):
        out = part
        for name, stage in p.STAGES:
            before = out
            out = stage(spark, out, SF)
            out.write.mode("overwrite").parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
            if name == "SimHash near-dedup" and part is docs:
                left = [(r.doc_id, r.text) for r in out.collect()]
                assert (3, rows[3][1]) in left and sum(t is not None and t.startswith("Word0") for _, t in left) == 1
            if name != p.STAGES[-1][0]:
                assert out.columns == before.columns
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and (part is docs or out.count() == 0)
