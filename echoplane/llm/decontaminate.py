"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and freed of punctuation. Each seed of MASKS is a row of word
positions of which only those marked 1 are hashed, so that two passages that differ in
an ignored place hash alike. Hashes of every position of every benchmark item are
joined with hashes of every position of every document; each hit fixes how the item
lies along the document (a diagonal), and is verified there: the item's overlap with the
document is scored +1 for an equal and -PENALTY for another word, and the best-scoring
run must have MIN_WORDS equal words, or LEAST_WORDS that are 80 % of the item's words.
Runs with a positive score have over 80 % equal words. Where the run falls short, the
whole overlap counts: LEAST_WORDS equal words that are 80 % of the item's are enough,
wherever the others lie. Items of fewer than LEAST_WORDS words, for which no share of
equal words says anything, are found where all their words stand in a row.

Repeated seeds are not multiplied out. Hits of a document and an item are counted first,
from how often each has a seed; where that is more than there are diagonals, the number
of equal words on every diagonal is worked out at once (by convolution for frequent
words) and diagonals are verified from the one with most on, until none can do better.

The benchmark is the small side: it is sent to the tasks in blocks of BLOCK_BYTES at
most (or one item), whatever its size, and each block is met with all documents. The
documents are never shuffled.

Defined results for odd rows: null and empty texts match nothing; rows with equal ids
are judged one by one; of several overlaps of a document and an item the one with most
equal words counts, then that on the least diagonal; other columns pass through
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U, bounded_batches, chunks, mix, slice_hashes, word_spans, words_joined

MASKS = ("1110111", "11011011", "110101011", "1100110011")
PENALTY = 4
LEAST_WORDS = 8
MIN_WORDS = 12
COVER = 0.8
BLOCK_BYTES = 16 << 20
#: Characters that are not part of a word here.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DROP = PUNCTUATION.encode()
_FACTOR = np.random.default_rng(11).integers(0, 2**63, 32).astype(np.uint64) * U(2) + U(1)


def normal_words(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """As `words_joined`, in lower case and without punctuation."""
    return words_joined([(t or "").lower().encode("utf-8", "replace").translate(None, _DROP) for t in texts])


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position where it fits."""
    n = max(0, len(h) - len(mask) + 1)
    g = np.zeros(n, np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            g += h[k : k + n] * _FACTOR[k]
    return mix(g)


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    g = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        g += h[k : k + len(g)] * _FACTOR[k]
    return mix(g)


def equal_words(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Equal words on each diagonal, from own's last word on the first of words to the other way round."""
    n, m = len(words), len(own)
    out = np.zeros(n + m - 1, np.int64)
    names, code = np.unique(own, return_inverse=True)
    at = np.searchsorted(names, words)
    mine = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == words)
    at = at[mine]
    order = np.argsort(at, kind="stable")
    mine, edges = mine[order], np.searchsorted(at[order], np.arange(len(names) + 1))
    by = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[by], np.arange(len(names) + 1))
    size = 1 << (n + m - 1).bit_length()
    for c in range(len(names)):
        p, q = mine[edges[c] : edges[c + 1]], by[cuts[c] : cuts[c + 1]]
        if len(p) * len(q) <= 8 * (n + m):
            np.add.at(out, (p[:, None] - q[None] + m - 1).ravel(), 1)
        else:
            x, y = np.zeros(size), np.zeros(size)
            x[p], y[m - 1 - q] = 1, 1
            out += np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[: n + m - 1]).astype(np.int64)
    return out


class Block:
    """A block of benchmark items, ready to be met with documents."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        text, counts = normal_words([t for _, t in items])
        starts, ends = word_spans(text)
        self.ids = [i for i, _ in items]
        self.h = slice_hashes(text, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        item = np.repeat(np.arange(len(items)), counts)
        long_enough = counts >= LEAST_WORDS
        self.seeds = []
        for mask in MASKS:
            g = seed_hashes(self.h, mask)
            at = np.arange(len(g))
            at = at[(item[at] == item[at + len(mask) - 1]) & long_enough[item[at]]] if len(at) else at
            at = at[np.lexsort((at, item[at], g[at]))]
            # A row for each seed of an item: its places are at[start : start + count].
            new = np.ones(len(at), bool)
            new[1:] = (g[at][1:] != g[at][:-1]) | (item[at][1:] != item[at][:-1])
            start = np.flatnonzero(new)
            known = np.zeros(1 << 20, bool)
            known[(g[at] >> U(44)).astype(np.int64)] = True
            self.seeds.append((mask, g[at][start], item[at][start], start, np.diff(np.append(start, len(at))), at, known))
        self.short = {}
        for k in np.flatnonzero((counts > 0) & (counts < LEAST_WORDS)).tolist():
            own = self.h[self.first[k] : self.first[k + 1]]
            self.short.setdefault(len(own), {}).setdefault(int(_run_hashes(own, len(own))[0]), []).append(k)

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, words, equal words) for each text and item that overlap."""
        text, counts = normal_words(texts)
        starts, ends = word_spans(text)
        if not len(starts) or not len(self.h):
            return []
        h = slice_hashes(text, starts, ends)
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        found = self._short(h, first, doc)
        light, heavy = self._diagonals(h, first, doc)
        for d, i, s in light:
            self._offer(found, h[first[d] : first[d + 1]], d, i, s)
        for d, i in heavy:
            words, own = h[first[d] : first[d + 1]], self.h[self.first[i] : self.first[i + 1]]
            same = equal_words(words, own)
            shifts = np.arange(len(same)) - len(own) + 1
            order = np.lexsort((shifts, -same))
            for s, most in zip(shifts[order].tolist(), same[order].tolist()):
                # No diagonal from here on has more equal words than the best overlap so far.
                if most < LEAST_WORDS or (best := found.get((d, i))) and best[0] <= (-most, s):
                    break
                self._offer(found, words, d, i, s)
        return [(d, i, *found[d, i][1]) for d, i in sorted(found)]

    def _offer(self, found: dict, words: np.ndarray, d: int, i: int, shift: int) -> None:
        if run := self._verify(words, i, shift):
            rank = (-run[2], shift)
            if (d, i) not in found or rank < found[d, i][0]:
                found[d, i] = rank, run

    def _short(self, h: np.ndarray, first: np.ndarray, doc: np.ndarray) -> dict:
        """Overlaps with short items: the first place that holds all their words in a row."""
        found: dict = {}
        for n, table in self.short.items():
            if len(h) < n:
                continue
            g = _run_hashes(h, n)
            known = np.array(sorted(table), np.uint64)
            at = np.flatnonzero((known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g) & (doc[: len(g)] == doc[n - 1 :]))
            for p in at.tolist():
                d = int(doc[p])
                for i in table[int(g[p])]:
                    if np.array_equal(h[p : p + n], self.h[self.first[i] : self.first[i + 1]]):
                        found.setdefault((d, i), ((-n, int(p - first[d])), (int(p - first[d]), n, n)))
        return found

    def _diagonals(self, h: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[list, list]:
        """(document, item, shift) of the diagonals that seeds hit, and (document, item) where they hit
        more often than there are diagonals."""
        rows = []
        for mask, keys, items, at0, n_at, places, known in self.seeds:
            g = seed_hashes(h, mask)
            at = np.flatnonzero(known[(g >> U(44)).astype(np.int64)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            if not len(keys) or not len(at):
                continue
            at = at[keys[np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)] == g[at]]
            if not len(at):
                continue
            at = at[np.lexsort((at, g[at], doc[at]))]
            new = np.ones(len(at), bool)
            new[1:] = (g[at][1:] != g[at][:-1]) | (doc[at][1:] != doc[at][:-1])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(at)))
            lo, hi = np.searchsorted(keys, g[at][start], "left"), np.searchsorted(keys, g[at][start], "right")
            # A row for each seed that a document and an item share.
            own = np.repeat(np.arange(len(start)), hi - lo)
            entry = np.arange(len(own)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[own]
            rows.append((doc[at][start][own], items[entry], start[own], n[own], at0[entry], n_at[entry], at, places))
        if not rows:
            return [], []
        pair = np.concatenate([r[0] * len(self.ids) + r[1] for r in rows])
        hits = np.concatenate([r[3] * r[5] for r in rows])
        each, back = np.unique(pair, return_inverse=True)
        total = np.bincount(back, hits.astype(float), len(each))
        d, i = each // len(self.ids), each % len(self.ids)
        dense = total > 2 * (np.diff(first)[d] + np.diff(self.first)[i]) + 64
        heavy, out, s = list(zip(d[dense].tolist(), i[dense].tolist())), [], 0
        for r in rows:
            some = np.flatnonzero(~dense[back[s : s + len(r[0])]])
            s += len(r[0])
            rd, ri, a0, n, b0, m = (x[some] for x in r[:6])
            row = np.repeat(np.arange(len(some)), n * m)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            where, place = r[6][a0[row] + k // m[row]], r[7][b0[row] + k % m[row]]
            out.append(np.stack([rd[row], ri[row], (where - first[rd[row]]) - (place - self.first[ri[row]])]))
        return list(zip(*np.unique(np.concatenate(out, axis=1), axis=1).tolist())), heavy

    def _verify(self, h: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """The best-scoring run of the item laid over the document at shift: (start, words, equal)."""
        own = self.h[self.first[item] : self.first[item + 1]]
        a, b = max(0, -shift), min(len(own), len(h) - shift)
        equal = own[a:b] == h[a + shift : b + shift]
        total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
        gain = total - np.minimum.accumulate(total)
        end = int(np.argmax(gain))
        start = int(np.argmin(total[: end + 1]))
        same = int(equal[start:end].sum())
        if same >= MIN_WORDS or same >= LEAST_WORDS and same >= COVER * len(own) - 1e-9:
            return start + a + shift, end - start, same
        at = np.flatnonzero(equal)
        if len(at) >= LEAST_WORDS and len(at) >= COVER * len(own) - 1e-9:
            return int(at[0]) + a + shift, int(at[-1] - at[0]) + 1, len(at)
        return None


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, read one after the other, in blocks of bounded size."""
    held, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, n_equal): each document and item that overlap."""
    sc, out = docs.sparkSession.sparkContext, None
    schema = "doc_id long, item_id long, start long, n_words long, n_equal long"
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in blocks(benchmark):
        held = sc.broadcast(items)

        def run(batches, held=held):
            block = Block(held.value)
            for table in chunks(batches, 4 << 20):
                ids = table.column("doc_id").to_pylist()
                m = block.matches(table.column("text").to_pylist())
                cols = [[ids[x[0]] for x in m], [block.ids[x[1]] for x in m], *([x[k] for x in m] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "n_words", "n_equal"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that overlap an item."""
    sc = docs.sparkSession.sparkContext
    for items in blocks(benchmark):
        held = sc.broadcast(items)

        def run(batches, held=held):
            block = Block(held.value)
            for batch in batches:
                for table in chunks([batch], 4 << 20):
                    gone = {x[0] for x in block.matches(table.column("text").cast(pa.string()).to_pylist())}
                    yield from table.filter(pa.array([k not in gone for k in range(table.num_rows)], pa.bool_())).combine_chunks().to_batches()

        docs = bounded_batches(docs).mapInArrow(run, docs.schema)
    return docs


def op5(spark, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that overlap, over all documents."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def brute_force(docs: dict[int, str | None], items: dict[int, str | None]) -> set[tuple[int, int]]:
    """Pairs with an overlap on any diagonal at all, seeds or not; for tests."""
    out = set()
    words = lambda t: (t or "").lower().translate(str.maketrans("", "", PUNCTUATION)).encode().split()
    for i, t in items.items():
        own = words(t)
        for d, x in docs.items():
            w = words(x)
            if len(own) < LEAST_WORDS:
                if own and any(w[k : k + len(own)] == own for k in range(len(w))):
                    out.add((d, i))
                continue
            for shift in range(-len(own) + 1, len(w)):
                best = score = same = whole = 0
                for k in range(len(own)):
                    if 0 <= k + shift < len(w):
                        eq = own[k] == w[k + shift]
                        whole += eq
                        score, same = (score + 1, same + 1) if eq else (score - PENALTY, same)
                        if score <= 0:
                            score = same = 0
                        elif score > best:
                            best = score
                            if same >= MIN_WORDS:
                                out.add((d, i))
                if whole >= LEAST_WORDS and 5 * whole >= 4 * len(own):
                    out.add((d, i))
    return out
