import random
import shutil

import pytest
from pyspark.sql import functions as F

from echoplane.llm import bpe as m


def _texts():
    rng = random.Random(9)
    pool = ["the", "Schlüssel", "don't", "we'll", "ÉCOLE", "x²", "½", "١٢٣", "漢字", "🙂👍🏽", "é", " ", " ", "\x85", "\x1c", "​", "\x00", "'s", "''", "...", "#*$", "<|endoftext|>", "<|endof", "\n\n", "\t", "  ", "   a", "ǅ", "ⅷ", "_", "12345", "a" * 200, "﻿", "İ", "᠎"]
    texts = {i: "".join(rng.choice(pool) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.randint(0, 60))) for i in range(300)}
    return texts | {900: None, 901: "", 902: " ", 903: "aab" * 20000, 904: "<|endoftext|>", 905: "word " * 3000, 906: "word word" * 50}


def test_same_as_the_library(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, ids string").repartition(3)
    out = m.encode_corpus(df)
    rows = out.select("doc_id", F.size("ids").alias("n"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("a"), F.sha2("decoded", 256).alias("b"), "decoded").collect()
    assert {r.doc_id: (r.n, r.a, r.b) for r in rows} == m.brute_force(texts)
    assert all(r.decoded == (texts[r.doc_id] or "") for r in rows)


def test_merging_alone_gives_the_same():
    codec, want = m.Codec(m.Vocabulary(m.default_vocabulary())), m.brute_force(_texts())
    assert {i: len(codec.encode(t or "")) for i, t in _texts().items()} == {i: x[0] for i, x in want.items()}


@pytest.mark.parametrize("n", [0, 1, 500])
def test_transducer(n, tmp_path):
    rng = random.Random(n)
    words = {b"".join(rng.choice([b"a", b"b", b"re", b"ing", b"\xc3\xa9"]) for _ in range(rng.randint(0, 6))): [rng.randrange(9) for _ in range(rng.randint(0, 4))] for _ in range(n)}
    (tmp_path / "t").write_bytes(m.Transducer.compile(words))
    t = m.Transducer.open(str(tmp_path / "t"))
    assert all(t.lookup(w) == ids for w, ids in words.items()) and t.n_words == len(words)
    assert t.numbers(sorted(words)).tolist() == list(range(len(words)))
    assert t.lookup(b"zz") is None and t.lookup(b"aaaaaaaaaaaaaaaaaaa") is None
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert n < 100 or t.n_states < len(prefixes) / 2  # ends are shared


def test_odd_rows(spark, tmp_path):
    path = shutil.copy(m.default_vocabulary(), tmp_path / "v.json")
    df = spark.createDataFrame([(None, "a a", 1), (2, "a a", 1), (2, "a a", 1)], "doc_id long, text string, decoded int")
    rows = m.encode_corpus(df, str(path), ("doc_id", "decoded")).toPandas()
    assert len(rows) == 3 and [list(x) for x in rows["ids"]] == [[64, 257]] * 3
    assert m.encode_corpus(df.limit(0)).count() == 0
