"""Quality rules with weak supervision, in DataFrame operations only.

Each rule looks at a few statistics of a document and votes 1 (good), 0 (bad), or null
(it abstains). How often a rule gives each vote on good and on bad documents is
estimated by expectation-maximisation, from the counts of vote patterns over all
documents; a document is kept if its posterior probability of being good is KEEP or more
and the base rule does not fail it. No rule has to pass by itself.

The statistics are worked out once, and written; the patterns are counted in one
aggregation and are at most 3**len(RULES) rows, which the rounds of
expectation-maximisation then run over.

Repeated 8-word windows are found by hashes inside the row, and where hashes of a document
repeat, its windows are sorted by hash and compared word by word.

Defined results for odd rows: a null text is empty and, having under 20 words, fails the
base rule; rows with equal doc_id are judged one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP = 0.5
ROUNDS = 12
#: White space, as a regular expression's class and as characters.
_SPACE, _BLANKS = "[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: name -> (condition for bad, condition for good) over the statistics; null means never.
RULES = {
    "symbols": ("n_symbols > 0.5 * n_words", None),
    "capitals": ("n_upper > 0.5 * word_chars", None),
    "tables": ("n_pipes > 0.12 * n_words", None),
    "lines": ("n_dup_lines > 0.6 * n_lines", None),
    "variety": ("n_distinct < 0.15 * n_words", "n_distinct > 0.4 * n_words"),
    "letters": (None, "n_upper + n_symbols + n_marks < 0.1 * word_chars"),
    "word_length": ("word_chars > 25 * n_words or word_chars < 2 * n_words", None),
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers that the rules look at, for each row of docs."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    has = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = base.select(
        "doc_id",
        F.expr(f"filter(split(t, '{_SPACE}+'), w -> w <> '')").alias("words"),
        F.expr(f"filter(split(t, '\\n'), x -> x rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')").alias("lines"),
        F.length(F.translate("t", _BLANKS, "")).cast("long").alias("word_chars"),
        has(SYMBOLS).cast("long").alias("n_symbols"),
        has(upper).cast("long").alias("n_upper"),
        has("!?").cast("long").alias("n_marks"),
    )
    rows = rows.select("*", F.expr("transform(words, w -> xxhash64(w))").alias("h"), F.size("words").cast("long").alias("n_words"))
    window = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    rows = rows.select("*", F.expr(f"case when n_words > {WINDOW} then transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({window})) else array() end").alias("wh"))
    # Where hashes repeat: places in order of hash, those equal to a neighbour, and the words that they cover.
    rows = rows.select("*", F.expr("case when size(array_distinct(wh)) < size(wh) then array_sort(transform(wh, (x, i) -> struct(x as x, i as i))) else array() end").alias("s"))
    same = lambda a, b: f"s[{a}].x = s[{b}].x and slice(words, s[{a}].i + 1, {WINDOW}) = slice(words, s[{b}].i + 1, {WINDOW})"
    near = f"(k > 0 and {same('k', 'greatest(k - 1, 0)')}) or (k < size(s) - 1 and {same('k', 'least(k + 1, size(s) - 1)')})"
    found = f"array_sort(filter(transform(s, (x, k) -> case when {near} then x.i end), x -> x is not null))"
    covered = f"aggregate({found}, struct(0L as n, {-WINDOW} as upto), (a, p) -> struct(a.n + least({WINDOW}, p - a.upto) as n, p as upto), a -> a.n)"
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr(f"case when size(s) = 0 then 0L else {covered} end").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        "n_marks",
        F.expr("cast(size(filter(words, w -> w = '|')) as long)").alias("n_pipes"),
        F.expr("cast(size(array_distinct(h)) as long)").alias("n_distinct"),
    )


def votes(stats: DataFrame, rules: dict[str, tuple[str | None, str | None]] = RULES) -> DataFrame:
    """stats with a column v_<rule> for each rule: 1, 0, or null. All abstain on texts without words."""
    for name, (bad, good) in rules.items():
        vote = F.when(F.expr(f"n_words > 0 and ({bad or 'false'})"), F.lit(0)).when(F.expr(f"n_words > 0 and ({good or 'false'})"), F.lit(1))
        stats = stats.withColumn(f"v_{name}", vote.cast("int"))
    return stats


class Model:
    """Share of good documents, and for each rule the odds that its votes give."""

    def __init__(self, names: list[str], rules: dict[str, tuple[str | None, str | None]] | None = None):
        self.names, self.good = names, 0.6
        # First guess: a rule that says bad seldom errs, one that says good is right more often than not.
        self.rates = {}  # rule -> class -> P(vote 1, vote 0, null)
        for n in names:
            bad, good = (rules or {}).get(n, ("", ""))
            one, zero = ((0.6, 0.3) if good is not None else (0.001, 0.001)), ((0.02, 0.25) if bad is not None else (0.001, 0.001))
            self.rates[n] = {c: (one[k], zero[k], 1 - one[k] - zero[k]) for k, c in enumerate((1, 0))}

    def posterior(self) -> Column:
        logit = F.lit(math.log(self.good / (1 - self.good)))
        for n in self.names:
            g, b = self.rates[n][1], self.rates[n][0]
            one, zero, none = (F.lit(math.log(x / y)) for x, y in zip(g, b))
            v = F.col(f"v_{n}")
            logit = logit + F.when(v == 1, one).when(v == 0, zero).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def fit(self, patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> Model:
        """Expectation-maximisation over patterns: the rules' votes, and how many documents have them."""
        first = {n: dict(r) for n, r in self.rates.items()}
        total = float(sum(n for _, n in patterns))
        if not total:
            return self
        pseudo = max(4.0, 0.002 * total)
        place = {1: 0, 0: 1, None: 2}
        for _ in range(rounds):
            seen = {n: {c: [0.0, 0.0, 0.0] for c in (1, 0)} for n in self.names}
            mass = {1: 0.0, 0: 0.0}
            for pattern, count in patterns:
                logit = math.log(self.good / (1 - self.good))
                for n, v in zip(self.names, pattern):
                    logit += math.log(self.rates[n][1][place[v]] / self.rates[n][0][place[v]])
                good = count / (1 + math.exp(-logit))
                for c, w in ((1, good), (0, count - good)):
                    mass[c] += w
                    for n, v in zip(self.names, pattern):
                        seen[n][c][place[v]] += w
            self.good = min(0.99, max(0.01, mass[1] / total))
            for n in self.names:
                for c in (1, 0):
                    self.rates[n][c] = tuple((x + pseudo * y) / (mass[c] + pseudo) for x, y in zip(seen[n][c], first[n][c]))
        return self


def judge(docs: DataFrame, rules: dict[str, tuple[str | None, str | None]] = RULES) -> DataFrame:
    """The statistics of docs with votes, p_good, base_failed and kept."""
    voted = cut(votes(statistics(docs), rules))
    names = list(rules)
    # At most 3**len(rules) rows, whatever the input.
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*(f"v_{n}" for n in names)).agg(F.count(F.lit(1)).alias("n")).collect()]
    model = Model(names, rules).fit(sorted(patterns, key=repr))
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return voted.withColumn("p_good", model.posterior()).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over documents."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) by definition; for tests."""
    t = text or ""
    blank = str.maketrans({c: " " for c in _BLANKS})
    w = [x for x in t.translate(blank).split(" ") if x]
    lines = [x for x in t.split("\n") if x.translate(blank).strip(" ")]
    windows: dict[tuple, list[int]] = {}
    for k in range(len(w) - WINDOW + 1):
        windows.setdefault(tuple(w[k : k + WINDOW]), []).append(k)
    hit = {k + d for places in windows.values() if len(places) > 1 for k in places for d in range(WINDOW)}
    return (len(w), sum(map(len, w)), sum(c in SYMBOLS for c in t), len(lines) - len(set(lines)), len(hit), len(w) < MIN_WORDS or 100 * len(hit) > MAX_REPEAT_PERCENT * len(w))
