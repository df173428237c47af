import random
import time

import numpy as np

from echoplane.llm import decontaminate as m


def _data():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)] + ["Über", "naïve,"]
    items = {i: " ".join(rng.choices(words, k=rng.randint(14, 60))) for i in range(12)} | {50: None, 51: "", 52: "w1 w2 w3", 53: " ".join(words[:9])}
    docs = {}
    for d in range(80):
        body = rng.choices(words, k=rng.randint(0, 200))
        if d % 2:
            own = items[rng.randrange(12)].split()
            k = rng.choice([len(own), len(own), 14])
            piece = own[:k] if rng.random() < 0.5 else own[-k:]
            piece = [rng.choice(words) if rng.random() < rng.choice([0, 0, 0.1]) else w.upper() + rng.choice(["", "."]) for w in piece]
            at = rng.randint(0, len(body))
            body[at:at] = piece
        docs[d] = rng.choice([" ", "\n", "  "]).join(body)
    return docs | {90: None, 91: "", 92: items[53], 93: "w0 " * 5000}, items


def test_finds_what_brute_force_finds(spark):
    docs, items = _data()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in m.overlaps(d, b).collect()}
    want = m.brute_force(docs, items)
    assert got <= want and len(got) >= 0.97 * len(want) and (92, 53) in got
    short = {x for x in want if len((items[x[1]] or "").split()) < m.LEAST_WORDS}
    assert short == {x for x in got if len((items[x[1]] or "").split()) < m.LEAST_WORDS}


def test_recall_over_dense_substitutions():
    """Passages with 8 to 20 % of their words changed at random places, runs of four masks or not."""
    rng = random.Random(12)
    words = [f"q{k}" for k in range(5000)]
    items, docs = {}, {}
    for i in range(300):
        own = rng.sample(words, rng.randint(15, 60))
        items[i] = " ".join(own)
        changed = set(rng.sample(range(len(own)), int(len(own) * rng.uniform(0.08, 0.2))))
        docs[i] = " ".join(rng.choices(words, k=20) + [rng.choice(words) if k in changed else w for k, w in enumerate(own)] + rng.choices(words, k=20))
    block = m.Block(list(items.items()))
    got = {(d, block.ids[i]) for d, i, *_ in block.matches(list(docs.values()))}
    want = {(i, i) for i in items if (i, i) in m.brute_force({i: docs[i]}, {i: items[i]})}
    assert len(want) > 280 and got <= want | {(d, i) for d, i in got if d != i} and len(got & want) >= 0.95 * len(want)


def test_repeated_words_are_not_multiplied_out():
    rng = random.Random(3)
    for n, kinds in ((60, 1), (80, 2), (120, 3)):
        text, own = (" ".join(rng.choice("abc") if rng.random() < 0.04 else "abc"[j % kinds] for j in range(k)) for k in (3 * n, n))
        block = m.Block([(7, own)])
        [(_, _, start, length, equal)] = block.matches([text])
        best = max(block._verify(np.array(_hashes(text)), 0, s)[2] for s in range(-n + 1, 3 * n) if block._verify(np.array(_hashes(text)), 0, s))
        assert equal == best and (0, 7) in m.brute_force({0: text}, {7: own})
    began = time.time()
    [found] = m.Block([(0, "word " * 10_000)]).matches(["word " * 1_000_000])
    assert found == (0, 0, 0, 10_000, 10_000) and time.time() - began < 20


def _hashes(text):
    joined, _ = m.normal_words([text])
    return m.slice_hashes(joined, *m.word_spans(joined))


def test_equal_words_on_all_diagonals():
    rng = np.random.default_rng(1)
    for n, k, kinds in ((50, 7, 2), (7, 50, 3), (400, 90, 2), (1, 1, 1)):
        a, b = rng.integers(0, kinds, n).astype(np.uint64), rng.integers(0, kinds, k).astype(np.uint64)
        want = [sum(0 <= j + s < n and a[j + s] == b[j] for j in range(k)) for s in range(-k + 1, n)]
        assert m.equal_words(a, b).tolist() == want


def test_blocks_do_not_matter(spark, monkeypatch):
    docs, items = _data()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    one = sorted(map(tuple, m.overlaps(d, b).collect()))
    left = sorted(r.doc_id for r in m.decontaminate(d, b).collect())
    monkeypatch.setattr(m, "BLOCK_BYTES", 800)
    assert sorted(map(tuple, m.overlaps(d, b).collect())) == one
    assert left == sorted(set(docs) - {x[0] for x in one}) == sorted(r.doc_id for r in m.decontaminate(d, b).collect())


def test_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(20))
    b = spark.createDataFrame([(1, text), (1, text), (None, text)], "item_id long, text string")
    d = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, "other", None)], "doc_id long, text string, item_id int")
    assert [tuple(r) for r in m.decontaminate(d, b).collect()] == [(3, "other", None)]
    assert m.decontaminate(d.limit(0), b).count() == 0 and m.decontaminate(d, b.limit(0)).count() == 3
    assert m.overlaps(d, b.limit(0)).count() == 0


def test_substitutions_anywhere_in_the_item():
    rng = random.Random(5)
    for n, subs in [(15, 1), (15, 2), (15, 3), (18, 2), (22, 3), (30, 5), (30, 6)]:
        own = [f"i{k}" for k in range(n)]
        block = m.Block([(0, " ".join(own))])
        # As many words whole as a seed needs, so that only the verification decides.
        for _ in range(40):
            at = rng.randint(0, n - 7)
            free = [k for k in range(n) if not at <= k < at + 7]
            gone = rng.sample(free, subs)
            text = " ".join(f"x{k}" if k in gone else w for k, w in enumerate(own))
            [found] = block.matches([f"a b c {text} d e"])
            assert found[:2] == (0, 0) and (0, 0) in m.brute_force({0: text}, {0: " ".join(own)})
    assert m.Block([(0, "a b c d e f g h i j")]).matches(["a b c d e f g x y z"]) == []
