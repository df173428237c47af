import base64
import math
import random

from pyspark.sql import functions as F

from echoplane.llm import secret_scan as m

SF = "/root/testdata/sf0.01"


def _got(spark, df):
    df.select("doc_id", "text").createOrReplaceTempView("d")
    out = m.scan(df)
    rows = out.select("doc_id", *(F.expr(f"size(filter(base, s -> s.kind = {k}))") for k in range(3)), F.sha2(F.expr(m._digest("base")), 256), F.expr(m._digest("base")), F.expr(m._digest("spans"))).collect()
    return {r[0]: tuple(r)[1:] for r in rows}


def test_base_spans_match_brute_force(spark):
    rng = random.Random(8)
    pool = ["password", "Secret", "api_key", "APIKEY", "tokens", "=", ": ", " = ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "x" * 12, "é🙂", " ", "\n", "secret=", "deadbeef", "AKIAAKIA", ".", "token = secret : "]
    texts = {i: "".join(rng.choices(pool, k=rng.randint(0, 40))) for i in range(200)}
    texts |= {300: None, 301: "", 302: "password=" + "a" * 5000, 303: ("🙂 AKIA" + "B" * 16 + " ") * 700}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, base string").repartition(3)
    got = _got(spark, df)
    assert {i: x[:5] for i, x in got.items()} == {i: m.brute_force(t) for i, t in texts.items()}


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices(["un", "be", "schaft", "keit", "ing", "tion", "er"], k=rng.randint(6, 9))) for _ in range(600)]
    texts, planted = {}, {}
    for i in range(150):
        body = rng.choices(words, k=20)
        if i % 3 == 0:
            secret = base64.urlsafe_b64encode(rng.randbytes(30)).decode()
            body[5] = secret
            planted[i] = " ".join(body).index(secret)
        if i % 5 == 0:
            body[9] = "Some_snake_case_name_of_it"
        texts[i] = " ".join(body)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = _got(spark, df)
    hit = [i for i, a in planted.items() if f"random:{a}:{a + 40}" in got[i][5]]
    assert len(hit) > 0.8 * len(planted)
    assert sum(len(x[5].split(",")) for x in got.values() if x[5]) - len(hit) <= 0.1 * len(hit) + 2


def test_battery(spark):
    import hashlib

    rng = random.Random(3)
    tokens = [hashlib.sha256(rng.randbytes(8)).hexdigest()[: rng.choice([20, 32, 64])] for _ in range(300)] + ["aaaaaaaaaaaaaaaaaaaa", "abababababababababab", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    df = spark.createDataFrame([(t,) for t in tokens], "tok string")
    rows = {r[0]: r[1] for r in df.select("tok", F.expr(m.battery("tok"))).collect()}
    p = [rows[t].p_serial for t in tokens[:300]]
    assert 0.4 < sum(p) / 300 < 0.6 and sum(rows[t].score < 0.05 for t in tokens[:300]) < 30
    assert all(rows[t].score < 0.01 for t in tokens[300:])
    z = spark.range(-40, 41).select((F.col("id") / 10).alias("z")).select("z", F.expr(m.upper_tail("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(r.z / math.sqrt(2))) < 1e-6 for r in z)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "token: abcdefghijkl"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(r.base[0].z if r.base else 0 for r in m.scan(df).collect()) == [0, 0, 19]
    assert m.scan(df.limit(0)).count() == 0
