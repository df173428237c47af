"""Secret scans with a randomness test battery, in DataFrame operations only.

Base spans come from three patterns (assignments, access keys, hexadecimal runs). The
battery then looks at every other run of MIN_CHARS or more characters of the base-64
alphabets. Its encoding is inferred (hexadecimal, base 32 or base 64), which fixes its
alphabet, and three tests ask whether it looks like uniform random symbols of it:
chi-squared of the symbols' frequencies, the number of runs above and below the middle of
the alphabet, and the serial correlation of neighbours. Its score is the Bonferroni
combination of their p-values; ordinary words score next to nothing.

Control of false discoveries: runs of small letters (a capital may come first) are
words, and show how ordinary strings score; capitals alone may be base 32, and are tested. Within each class of lengths, a score's
p-value is the share of words, of that length or shorter (the tests are weaker there, so
this is the cautious side), that score as high; the Benjamini-Hochberg rule at FDR sets
the class's threshold. The table of scores by class has a few thousand rows at most,
whatever the input.

Spans are found in the row: the text is split by a pattern, and lengths of pieces and
matches add up to places, block by block so that the work does not grow with the square
of a text's matches.

Defined results for odd rows: a null text is empty and has no spans; decimal numbers are
no secrets; rows with equal doc_id are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut

MIN_CHARS = 16
FDR = 0.05
BINS = 200
#: kind -> (pattern, group whose length counts, least length); \\x20 stands for a blank.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # Shorter runs are dropped in any case, so they need not be found.
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
KINDS = (*BASE, "random")
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_CHARS},}}"
#: Alphabets, in their own order. The two forms of base 64 are taken as one.
HEX_LOW, HEX_UP = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BLOCK = 128


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(name: str, pattern: str, group: int = 0) -> list[Column]:
    """Columns <name>_m (matches), <name>_g (their groups) and <name>_p (the pieces between)."""
    p, none = _literal(pattern), "cast(array() as array<string>)"
    hit = f"t rlike {p}"
    cols = [F.expr(f"case when {hit} then regexp_extract_all(t, {p}, 0) else {none} end").alias(f"{name}_m")]
    if group:
        cols.append(F.expr(f"case when {hit} then regexp_extract_all(t, {p}, {group}) else {none} end").alias(f"{name}_g"))
    return [*cols, F.expr(f"case when {hit} then split(t, {p}) else {none} end").alias(f"{name}_p")]


def _blocks(name: str) -> Column:
    """Places at which each block of _BLOCK matches begins to count, minus the first piece."""
    n, gap = f"size({name}_m)", f"length({name}_p[j]) + length({name}_m[j])"
    sums = f"transform(sequence(0, cast(({n} - 1) div {_BLOCK} as int)), b -> aggregate(sequence(b * {_BLOCK}, least({n}, (b + 1) * {_BLOCK}) - 1), 0L, (a, j) -> a + {gap}))"
    return F.expr(f"case when {n} = 0 then array(0L) else {sums} end").alias(f"{name}_b")


def _start(name: str, i: str) -> str:
    """SQL for the place at which match i starts."""
    gap = f"length({name}_p[j]) + length({name}_m[j])"
    whole = f"aggregate(slice({name}_b, 1, cast({i} div {_BLOCK} as int)), 0L, (a, x) -> a + x)"
    first = f"cast(({i} div {_BLOCK}) * {_BLOCK} as int)"
    rest = f"(case when {i} % {_BLOCK} = 0 then 0L else aggregate(sequence({first}, greatest({first}, {i} - 1)), 0L, (a, j) -> a + {gap}) end)"
    return f"({whole} + {rest} + length({name}_p[{i}]))"


def _spans(name: str, keep: str, extra: str = "") -> str:
    """SQL for an array of spans of the matches i for which keep holds."""
    places = f"filter(transform({name}_m, (m, i) -> case when {keep} then i end), i -> i is not null)"
    start = _start(name, "i")
    return f"transform({places}, i -> struct({start} as a, {KINDS.index(name)} as kind, {start} + length({name}_m[i]) as z{extra}))"


def upper_tail(z: str) -> str:
    """SQL for P(Z > z): the rational approximation of the error function with errors under 1.5e-7."""
    t = f"(1 / (1 + 0.3275911D * abs({z}) / sqrt(2D)))"
    poly = f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))))"
    tail = f"(0.5D * {poly} * exp(-({z}) * ({z}) / 2))"
    return f"(case when {z} >= 0 then {tail} else 1 - {tail} end)"


def battery(token: str) -> str:
    """SQL for struct(score, p_chi, p_runs, p_serial) of the string that token names."""
    t = token
    alphabet = f"(case when {t} rlike '^[0-9a-f]+$' then '{HEX_LOW}' when {t} rlike '^[0-9A-F]+$' then '{HEX_UP}' when {t} rlike '^[A-Z2-7]+$' then '{BASE32}' else '{BASE64}' end)"
    # Each step is a lambda over a one-element array, which gives its value a name.
    step = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    x = f"transform(split(translate({t}, '-_', '+/'), ''), c -> cast(locate(c, al) - 1 as double))"
    equal = "aggregate(array_distinct(x), 0D, (a, v) -> a + power(cast(size(filter(x, u -> u = v)) as double), 2))"
    chi = f"({equal} * k / n - n)"
    z_chi = "((cbrt(chi / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))))"
    high = "cast(size(filter(x, u -> u >= k / 2)) as double)"
    changes = "aggregate(sequence(1, size(x) - 1), 0D, (a, i) -> a + case when (x[i] >= k / 2) <> (x[i - 1] >= k / 2) then 1 else 0 end)"
    mean_runs = "(2 * n1 * (n - n1) / n + 1)"
    z_runs = f"((1 + {changes} - {mean_runs}) / sqrt(greatest(1e-9D, ({mean_runs} - 1) * ({mean_runs} - 2) / (n - 1))))"
    # All symbols in one half of the alphabet: as likely as so many equal tosses of a coin.
    p_runs = f"(case when n1 = 0 or n1 = n then power(2D, 1 - n) else {step('z', z_runs, '2 * ' + upper_tail('abs(z)'))} end)"
    mean = "(aggregate(x, 0D, (a, v) -> a + v) / n)"
    cov = "aggregate(sequence(1, size(x) - 1), 0D, (a, i) -> a + (x[i] - mu) * (x[i - 1] - mu))"
    var = "aggregate(x, 0D, (a, v) -> a + (v - mu) * (v - mu))"
    p_serial = step("mu", mean, step("va", var, f"case when va = 0 then 0D else {step('z', f'(({cov} / va + 1 / n) * sqrt(n))', '2 * ' + upper_tail('abs(z)'))} end"))
    p_chi = step("chi", chi, step("z", z_chi, upper_tail("z")))
    tests = step("n1", high, f"struct({p_chi} as p_chi, {p_runs} as p_runs, {p_serial} as p_serial)")
    score = step("p", tests, "struct(least(1D, 3 * least(p.p_chi, p.p_runs, p.p_serial)) as score, p.p_chi as p_chi, p.p_runs as p_runs, p.p_serial as p_serial)")
    return step("al", alphabet, step("k", "cast(length(al) as double)", step("x", x, step("n", "cast(size(x) as double)", score))))


def _length_class(n: str) -> str:
    """Half octaves of length."""
    return f"least(40, cast(floor(2 * log2({n})) as int))"


def scored(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, base (spans), found (candidate spans with class and bin) and words (class and bin)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", *(c for n, (p, g, _) in BASE.items() for c in _matches(n, p, g)), *_matches("random", CANDIDATE))
    rows = rows.select("*", *(_blocks(n) for n in KINDS))
    base = [_spans(n, f"length({n}_{'g' if g else 'm'}[i]) >= {least}") for n, (_, g, least) in BASE.items()]
    rows = rows.select("*", F.expr(f"array_sort(concat({', '.join(base)}))").alias("base"))
    word, number = "'^[A-Za-z]?[a-z]+$'", "'^[0-9]+$'"
    binned = lambda t: f"transform(array({battery(t)}), b -> struct({_length_class(f'length({t})')} as class, cast(floor(b.score * {BINS}) as int) as bin))[0]"
    extra = f", {binned('random_m[i]')} as s"
    mine = f"not (random_m[i] rlike {word}) and not (random_m[i] rlike {number})"
    rows = rows.select(
        "doc_id",
        "base",
        F.expr(_spans("random", mine, extra)).alias("found"),
        F.expr(f"transform(filter(random_m, m -> m rlike {word}), m -> {binned('m')})").alias("words"),
    )
    # What a base span covers is found already.
    free = "filter(found, f -> not exists(base, b -> b.a < f.z and f.a < b.z))"
    return rows.withColumn("found", F.when(F.size("base") == 0, F.col("found")).otherwise(F.expr(free)))


def thresholds(rows: DataFrame) -> DataFrame:
    """(class, least): the least bin of each length class that the false-discovery rule lets pass."""
    pick = lambda c, tag: rows.select(F.explode(c).alias("s"), F.lit(tag).alias("word"))
    all_ = pick(F.expr("transform(found, f -> f.s)"), 0).unionAll(pick(F.col("words"), 1))
    # At most 41 * (BINS + 1) rows from here on.
    table = all_.groupBy(F.col("s.class").alias("class"), F.col("s.bin").alias("bin")).agg(F.sum(1 - F.col("word")).alias("t"), F.sum("word").alias("w"))
    table = cut(table.coalesce(1))
    a, b = table.alias("a"), table.alias("b")
    # For each class and bin: candidates of the class that score as high, and words up to that length.
    up = F.col("b.bin") >= F.col("a.bin")
    per = a.join(F.broadcast(b), F.col("b.class") <= F.col("a.class")).groupBy("a.class", "a.bin").agg(
        F.sum(F.when(up & (F.col("b.class") == F.col("a.class")), F.col("b.t")).otherwise(0)).alias("t_up"),
        F.sum(F.when(F.col("b.class") == F.col("a.class"), F.col("b.t")).otherwise(0)).alias("t_all"),
        F.sum(F.when(up, F.col("b.w")).otherwise(0)).alias("w_up"),
        F.sum("b.w").alias("w_all"),
    )
    p = (F.col("w_up") + 1) / (F.col("w_all") + 1)
    return per.where((F.col("t_up") > 0) & (p * F.col("t_all") <= FDR * F.col("t_up"))).groupBy("class").agg(F.min("bin").alias("least"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base and all spans of each row, as arrays of (a, kind, z)."""
    rows = cut(scored(docs))
    # At most 41 classes: they become part of the expression.
    passed = [x for r in thresholds(rows).collect() for x in (F.lit(r["class"]), F.lit(r.least))]
    held = rows.withColumn("least", F.create_map(*passed) if passed else F.expr("cast(map() as map<int, int>)"))
    more = "transform(filter(found, f -> f.s.bin >= least[f.s.class]), f -> struct(f.a as a, f.kind as kind, f.z as z))"
    return held.select("doc_id", "base", F.expr(f"array_sort(concat(base, {more}))").alias("spans"))


def _digest(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.a, ':', s.z)), ',')"


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over documents."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *(count(k) for k in range(3)), F.sha2(F.expr(_digest("base")), 256).alias("base_sha256"), F.expr(_digest("spans")).alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str, str]:
    """(n_assign, n_access, n_hex, base_sha256, base spans) by definition; for tests."""
    found = []
    patterns = {"assign": (re.compile(BASE["assign"][0], re.A), 2, 12), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile(r"[0-9a-f]+"), 0, 16)}
    for k, (p, g, least) in patterns.items():
        found += [(m.start(), KINDS.index(k), m.end()) for m in p.finditer(text or "") if len(m[g]) >= least]
    spans = ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(found))
    n = [sum(k == j for _, k, _ in found) for j in range(3)]
    return (*n, hashlib.sha256(spans.encode()).hexdigest(), spans)
