import random
import time

from echoplane.llm import license_scan as m


def test_longest_increasing():
    rng = random.Random(0)
    for _ in range(200):
        v = [rng.randrange(30) for _ in range(rng.randint(0, 12))]
        got = [v[k] for k in m.longest_increasing(v)]
        best = 0
        for bits in range(1 << len(v)):
            x = [y for k, y in enumerate(v) if bits >> k & 1]
            if all(a < b for a, b in zip(x, x[1:])):
                best = max(best, len(x))
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


def test_planted_licenses_are_found(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(200)] + ["the", "of", "license", "software", "version"]
    docs, want = {}, {}
    for i in range(160):
        body = rng.choices(words, k=rng.randint(0, 200))
        if i % 4:
            name = rng.choice(list(m.TEMPLATES))
            text = m.TEMPLATES[name].split()
            for _ in range(rng.randint(0, len(text) // 12)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if i % 5 == 0:
                text = [t.upper() for t in text]
            at = rng.randint(0, len(body))
            body[at:at] = text * (2 if i % 7 == 0 else 1)
            want[i] = (name, 2 if i % 7 == 0 else 1)
        docs[i] = rng.choice([" ", "\n# ", "  "]).join(body)
    docs |= {300: None, 301: "", 302: "the of " * 20000, 303: "license"}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, license string").repartition(4)
    got: dict = {}
    for r in m.scan_licenses(df).collect():
        assert r.coverage >= m.COVER and m.brute_force(docs[r.doc_id], m.TEMPLATES[r.license])
        got.setdefault(r.doc_id, []).append(r.license)
    for i, (name, n) in want.items():
        assert got.get(i, []).count(name) == n, (i, name, n, got.get(i))
    assert not set(got) - set(want)
    assert m.scan_licenses(df.limit(0)).count() == 0


def test_nothing_else_is_there():
    rng = random.Random(3)
    pool = m.normal_words(" ".join(m.TEMPLATES.values()))
    scanner = m.Scanner(m.TEMPLATES)
    for _ in range(60):
        text = b" ".join(rng.choices(pool, k=60)).decode()
        assert {x[0] for x in scanner.scan(text)} <= {n for n, t in m.TEMPLATES.items() if m.brute_force(text, t)}


def test_one_signal_word_replaced():
    assert [x[0] for x in m.Scanner(m.TEMPLATES).scan("Distributed under the MIT License.")] == ["MIT line"]
    for name, text in m.TEMPLATES.items():
        scanner, words = m.Scanner({name: text}), text.split()
        for k, w in enumerate(words):
            if set(m.normal_words(w)) - m.FUNCTION_WORDS:
                changed = " ".join(["some", "words", *words[:k], "other", *words[k + 1 :], "after", "it"])
                assert m.brute_force(changed, text) and len(scanner.scan(changed)) == 1, (name, k)


def test_every_template_at_the_bound():
    """As many words replaced as the coverage allows, anywhere: found, with place and coverage; one more is not."""
    rng = random.Random(4)
    for name, text in m.TEMPLATES.items():
        words = m.normal_words(text)
        may = int((1 - m.COVER) * len(words) + 1e-9)
        for extra in (0, 1):
            # Spread out, so that words that occur often in a template still find their anchors.
            at = sorted(rng.sample(range(1, len(words) - 1), min(may + extra, len(words) - 2)))
            changed = [b"zz%d" % k if k in at else w for k, w in enumerate(words)]
            doc = b" ".join([b"before", b"it", *changed, b"after", b"it"]).decode()
            found = [x for x in m.Scanner({name: text}).scan(doc)]
            if extra and len(at) > may:
                assert not found and not m.brute_force(doc, text), name
            elif found or len(set(words)) == len(words):
                [(_, start, end, n, coverage)] = found
                assert n == len(words) - len(at) and abs(coverage - n / len(words)) < 1e-12 and coverage >= m.COVER - 1e-9, name
                assert (start, end) == (2, 2 + len(words)), name


def test_common_words_is_the_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = (rng.choices([b"a", b"b", b"c", b"d"], k=rng.randint(0, 30)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        bits: dict = {}
        for k, w in enumerate(b):
            bits[w] = bits.get(w, 0) | 1 << k
        assert m.common_words(a, bits, len(b)) == row[-1]


def test_work_is_bounded_on_shuffled_words():
    rng = random.Random(7)
    pool = m.normal_words(" ".join(m.TEMPLATES.values()))
    text = b" ".join(rng.choices(pool, k=100_000)).decode()
    began = time.time()
    m.Scanner(m.TEMPLATES).scan(text)
    assert time.time() - began < 60
