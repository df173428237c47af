"""Quality classifier: a weak-label model trains a hashed linear scorer.

Heuristic labellers vote clean, junk or toxic on each document, or abstain; the labels
table, where it is given, is one more labeller. Expectation-maximisation over the counts
of vote patterns estimates how often each labeller gives each vote in each class, and
from that the posterior class of every pattern. A softmax scorer over hashed features
(words, beginnings of words, word shapes and binned statistics of the text) is then
trained on the posteriors of at most TRAIN_DOCS documents and scores every document.

Patterns are counted over all documents; there are at most 4**len(LABELLERS) of them, so
that is what the driver gets. TRAIN_DOCS and TRAIN_BYTES are the only bounds on the data:
labelled documents first, then others, by least hashes of their ids, train the scorer.
Their features are worked out where the texts are; documents are never shuffled.

Defined results for odd rows: null and empty texts have no words, and get the scores of
the features that they share with others (clean, unless the corpus says otherwise); a
null doc_id is like any other, but does not train; rows with equal ids are scored one by
one, and the first of their vote patterns trains; of several labels of an id the least
severe counts, labels without id or verdict none; a document whose class clean has a
probability of exactly one half is kept; an empty table gives an empty result; other
columns pass through `keep_good` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import U, as_bytes, bounded_batches, chunks, cut, mix, pack, release, slice_hashes, unpack, word_spans, words_joined

CLASSES = ("clean", "junk", "toxic")
CLEAN, JUNK, TOXIC, ABSTAIN = 0, 1, 2, 3
LABELLERS = ("symbols", "capitals", "tables", "repeats", "variety", "prose", "insults", "labels")
#: Documents that train the scorer, at most, and bytes of their texts, the last document's apart.
TRAIN_DOCS = 4_000
TRAIN_BYTES = 64 << 20
FEATURES = 1 << 16
#: Texts of fewer words are judged with less weight on each word.
SHORT = 24
EPOCHS = 100
EM_ROUNDS = 30
#: English insults.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = 1
_EDGE = np.zeros(256, np.uint8)  # class of a byte at the end of a word
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&<>", b"|", b"-+=_/@")):
    _EDGE[list(_s)] = _k + 1


class Features:
    """Statistics and hashed features of a chunk of documents."""

    def __init__(self, texts: list[bytes]):
        text, self.n = words_joined(texts)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        starts, ends = word_spans(text)
        low = text.lower()
        self.h = slice_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.head = mix(slice_hashes(low, starts, np.minimum(ends, starts + 5)) + U(1)) if len(starts) else self.h
        raw = np.frombuffer(text, np.uint8)
        if len(starts):
            last, before = raw[ends - 1], raw[np.maximum(ends - 2, starts)]
            # Prose: the word goes on in small letters, and ends in one or in a point or comma.
            plain = ((_EDGE[before] == 1) | (raw[np.maximum(ends - 2, starts)] >= 128)) & ((_EDGE[last] == 1) | (_EDGE[last] == 4) | (last >= 128) | (ends - starts == 1) & (_EDGE[last] == 2))
            plain |= (ends - starts == 2) & (_EDGE[before] == 2) & ((_EDGE[last] == 1) | (_EDGE[last] == 4))
            self.shape = (_EDGE[raw[starts]].astype(np.int64) * 16 + _EDGE[before]) * 16 + _EDGE[last]
        else:
            self.shape, plain = np.zeros(0, np.int64), np.zeros(0, bool)
        bounds = np.concatenate([[0], np.cumsum(self.n)])
        edge = np.concatenate([starts, [len(raw)]])[bounds]

        def per_doc(lut):
            total = np.concatenate([[0], np.cumsum(lut[raw])])
            return total[edge[1:]] - total[edge[:-1]]

        words = np.maximum(self.n, 1)
        pipes = np.bincount(self.doc, (ends - starts == 1) & (raw[starts] == 124) if len(starts) else None, len(texts))
        same = np.zeros(len(self.h), bool)
        same[1:] = (self.h[1:] == self.h[:-1]) & (self.doc[1:] == self.doc[:-1])
        order = np.lexsort((self.h, self.doc))
        new = np.ones(len(order), bool)
        new[1:] = (self.h[order][1:] != self.h[order][:-1]) | (self.doc[order][1:] != self.doc[order][:-1])
        insults = np.zeros(len(self.h), bool)
        bare = np.array([w.encode() for w in INSULTS])
        for end in (b"", b".", b","):
            x = [w + end for w in bare.tolist()]
            at = np.cumsum([0, *map(len, x)])
            insults |= np.isin(self.h, slice_hashes(b"".join(x), at[:-1], at[1:]))
        self.stats = np.stack(
            [
                per_doc(_SYMBOL) / words,
                np.maximum(per_doc(_UPPER) - 1, 0) / np.maximum(per_doc(_LETTER), 1),  # a text may begin with a capital
                pipes / words,
                np.bincount(self.doc, same, len(texts)) / words,
                np.bincount(self.doc[order], new, len(texts)) / words,
                np.bincount(self.doc, plain, len(texts)) / words,
                np.bincount(self.doc, insults, len(texts)) / words,
            ],
            axis=1,
        )

    def votes(self) -> np.ndarray:
        """One vote a labeller, the labels table's left at ABSTAIN."""
        symbols, capitals, tables, repeats, variety, prose, insults = self.stats.T
        when = lambda bad, vote: np.where(bad & (self.n >= 3), vote, ABSTAIN)
        return np.stack(
            [
                when(symbols > 0.5, JUNK),
                when(capitals > 0.6, JUNK),
                when(tables > 0.12, JUNK),
                when((repeats > 0.2) & (self.n >= 5), JUNK),
                np.where(variety > 0.4, when(self.n >= 20, CLEAN), when((variety < 0.15) & (self.n >= 20), JUNK)),
                when(prose > 0.85, CLEAN),
                when(insults * self.n >= 2, TOXIC),
                np.full(len(self.n), ABSTAIN),
            ],
            axis=1,
        )

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value) triples: shares of words, and binned statistics."""
        # The few words of a short text say little: they weigh as if it had SHORT words.
        share = 1.0 / np.maximum(self.n, SHORT)[self.doc]
        bins = np.minimum(np.log2(1 + self.stats * np.array([8, 8, 16, 16, 8, 8, 200])) * 3, 31).astype(np.int64)
        k = bins.shape[1]
        binned = 8192 + np.arange(k) * 32 + bins
        top = U(FEATURES - 16384)
        doc = np.concatenate([self.doc, self.doc, self.doc, np.repeat(np.arange(len(self.n)), k + 1)])
        feature = np.concatenate(
            [
                (self.h % top).astype(np.int64) + 16384,
                (self.head % top).astype(np.int64) + 16384,
                self.shape,
                np.concatenate([binned, np.full((len(self.n), 1), 16383)], axis=1).ravel(),
            ]
        )
        return doc, feature, np.concatenate([share, share, share, np.ones(len(self.n) * (k + 1))])


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (4 ** np.arange(votes.shape[1]))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """patterns (P, L) of votes and how many documents have each -> posterior (P, 3), class
    shares (3,) and rates (L, 3 classes, 4 votes). A vote's first guess is right 4 times in 5;
    only insults and labels tell toxic documents from clean ones."""
    k, n_l = len(CLASSES), patterns.shape[1]
    guess = np.full((k, 4), 0.1)
    guess[np.arange(k), np.arange(k)] = 0.8
    guess[:, ABSTAIN] = 1.0  # at first an abstention says nothing
    rates = np.repeat(guess[None], n_l, axis=0)
    if n_l == len(LABELLERS):
        rates[[k for k, x in enumerate(LABELLERS) if x not in ("insults", "labels")], TOXIC] = guess[CLEAN]
    guess = rates / rates.sum(axis=2, keepdims=True)
    prior = np.array([0.6, 0.25, 0.15])
    one_hot = patterns[:, :, None] == np.arange(4)
    posterior = np.zeros((len(patterns), k))
    for _ in range(rounds):
        log = np.log(prior) + np.einsum("plv,lkv->pk", one_hot, np.log(rates))
        posterior = np.exp(log - log.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        weight = posterior * counts[:, None]
        prior = (weight.sum(axis=0) + 1) / (weight.sum() + k)
        seen = np.einsum("plv,pk->lkv", one_hot, weight)
        pseudo = guess * max(4.0, 0.002 * counts.sum())
        rates = (seen + pseudo) / (seen + pseudo).sum(axis=2, keepdims=True)
    return posterior, prior, rates


def train(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights (FEATURES, 3) of a softmax scorer, by full-batch Adagrad."""
    weights, seen = np.zeros((FEATURES, len(CLASSES))), np.full((FEATURES, len(CLASSES)), 1e-9)
    for _ in range(EPOCHS):
        p = _softmax(scores(doc, feature, value, weights, len(target)))
        error = (p - target) / len(target)
        grad = np.stack([np.bincount(feature, error[doc, c] * value, FEATURES) for c in range(len(CLASSES))], axis=1) + 1e-7 * weights
        seen += grad**2
        weights -= 0.5 * grad / np.sqrt(seen)
    return weights


def scores(doc, feature, value, weights, n_docs) -> np.ndarray:
    return np.stack([np.bincount(doc, weights[feature, c] * value, n_docs) for c in range(len(CLASSES))], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def vote_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern): the labellers' votes on each document, as base-4 digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, 2 << 20):
            votes = Features(as_bytes(table.column("text").combine_chunks())).votes()
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(_pattern(votes))], names=["doc_id", "pattern"])

    return _rows(docs).mapInArrow(run, "doc_id long, pattern long")


def _rows(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame | None = None) -> np.ndarray:
    """The scorer's weights."""
    votes = vote_table(docs)
    if labels is not None:
        told = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, JUNK).when(F.col("quality") == 1, CLEAN).otherwise(ABSTAIN)
        said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(told).alias("said"))
        votes = votes.join(said, "doc_id", "left").select("doc_id", (F.col("pattern") + F.coalesce(F.col("said") - ABSTAIN, F.lit(0)) * 4 ** (len(LABELLERS) - 1)).alias("pattern"))
    votes = cut(votes)
    counted = votes.groupBy("pattern").count().collect()
    if not counted:
        return np.zeros((FEATURES, len(CLASSES)))
    codes = np.array([r.pattern for r in counted], np.int64)
    digits = codes[:, None] // 4 ** np.arange(len(LABELLERS)) % 4
    posterior, _, _ = expectation_maximisation(digits, np.array([r["count"] for r in counted], float))
    by_code = dict(zip(codes.tolist(), posterior.tolist()))

    ids = votes.where("doc_id is not null").groupBy("doc_id").agg(F.min("pattern").alias("pattern"))
    untold = F.floor(F.col("pattern") / 4 ** (len(LABELLERS) - 1)) == ABSTAIN  # labelled documents come first
    picked = cut(ids.orderBy(untold, F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS))
    # At most TRAIN_DOCS pairs of numbers: these may be broadcast. Rows that repeat an id count once.
    texts = _rows(docs).join(F.broadcast(picked), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1 << 20):
            texts = as_bytes(part.column("text").combine_chunks())
            d, f, v = Features(texts).sparse()
            key, back = np.unique(d * FEATURES + f, return_inverse=True)
            value, cuts = np.bincount(back, v).astype(np.float32), np.searchsorted(key // FEATURES, np.arange(len(texts) + 1))
            packed = [pack((key[a:b] % FEATURES).astype(np.uint16), value[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), part.column("pattern").combine_chunks(), pa.array([len(t) for t in texts], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "pattern", "size", "features"])

    made = cut(texts.select("doc_id", "pattern", "text").mapInArrow(features, "doc_id long, pattern long, size long, features binary"))
    made = made.dropDuplicates(["doc_id"])
    # The first documents that fill TRAIN_BYTES: a running sum over TRAIN_DOCS rows at most.
    before = F.sum("size").over(W.orderBy(untold, F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1))
    sample = made.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < TRAIN_BYTES)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        parts = [unpack(x.as_py()) for x in table.column("features")]
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(f) for f, _ in parts])
        feature, value = np.concatenate([f for f, _ in parts]).astype(np.int32), np.concatenate([v for _, v in parts])
        target = np.array([by_code[p] for p in table.column("pattern").to_pylist()])
        del parts
        weights = train(doc, feature, value, target)
        del doc, feature, value
        release()
        return pa.table([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    sample = sample.select("doc_id", "pattern", "features")
    row = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(learn, "weights binary").first()
    return np.frombuffer(row.weights, np.float32).reshape(FEATURES, len(CLASSES)) if row else np.zeros((FEATURES, len(CLASSES)))


def _probabilities(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    f = Features(texts)
    return _softmax(scores(*f.sparse(), weights, len(texts)))


def classify(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, p_clean, p_junk, p_toxic, keep): keep unless another class is likelier than not."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for table in chunks(batches, 2 << 20):
            p = _probabilities(as_bytes(table.column("text").combine_chunks()), held.value)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *(pa.array(p[:, c]) for c in range(3)), pa.array(p[:, CLEAN] >= 0.5)], names=["doc_id", "p_clean", "p_junk", "p_toxic", "keep"])

    return _rows(docs).mapInArrow(run, "doc_id long, p_clean double, p_junk double, p_toxic double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs without the documents that the classifier rejects."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            for table in chunks([batch], 2 << 20):
                p = _probabilities(as_bytes(table.column("text").cast(pa.string()).combine_chunks()), held.value)
                yield from table.filter(pa.array(p[:, CLEAN] >= 0.5)).combine_chunks().to_batches()

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document's class probabilities and verdict."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, fit(docs, labels))
