"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. The minimiser of a window is
the least-hashed run of SEED words inside it; consecutive windows with the same
minimiser form a super-k-mer, which travels as one packed string to the bucket of
its minimiser. Equal windows have equal minimisers, so each bucket can sort its
windows and find, exactly (equal hashes are compared byte by byte), which of them
start earlier elsewhere. Words covered by such a window are removed.

How it stays bounded when a passage or a pair of words is everywhere:

* a map task keeps only the first of equal super-k-mers of its chunk: the windows of
  the others are repeats of it, whatever the rest of the corpus holds, so a bucket
  gets each text at most once a chunk;
* seeds that a sample of the documents shows to be common are ranked after all other
  seeds, so that a window uses one only if it has no other. The sample steers where
  windows are sorted and never what is found;
* a bucket is read as a stream. One that passes MOST_BYTES in spite of all that is not
  gathered: its windows leave one by one and are sorted by Spark, by their text, which
  needs no more memory for a window that is everywhere.

Defined results for odd rows: a null text has no words; a null doc_id sorts after all
others; rows with equal doc_id and equal text are one document and share its result;
rows with equal doc_id and different texts are ordered by a hash of the text. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import (
    Rolling, U, as_bytes, chunks, cut, keyed, merge_intervals, mix, pack, release, runs, shuffle_partitions,
    slice_hashes, slices_equal, unpack, word_spans, words_joined,
)

WINDOW = 20
SEED = 3
#: Raw bytes of packed strings that a bucket holds on average, at most.
BUCKET_BYTES = 10 << 20
#: Bytes of packed strings (compressed) that a task gathers for a bucket, at most.
MOST_BYTES = 24 << 20
#: Bytes of text that a map task works on at a time.
MAP_BYTES = 7 << 20
#: Documents in the sample that finds common seeds, about.
SAMPLE_DOCS = 4000
_TOP = U(1 << 63)


def _sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    span = 1
    while span * 2 <= width:
        g = np.minimum(g[: len(g) - span], g[span:])
        span *= 2
    rest = width - span
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


class _SuperKmers:
    """The super-k-mers of a chunk of documents, in order of (id, text hash, start)."""

    def __init__(self, table: pa.Table, window: int, seed: int, common: np.ndarray):
        table = table.sort_by([("_id", "ascending"), ("_th", "ascending")])
        self.id, self.th = (table.column(c).to_numpy() for c in ("_id", "_th"))
        self.text, counts = words_joined(as_bytes(table.column("text").combine_chunks()))
        self.starts, self.ends = word_spans(self.text)
        n = len(self.starts)
        first_word = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(len(counts)), counts)
        self.h = slice_hashes(self.text, self.starts, self.ends) if n else np.zeros(0, np.uint64)
        if n < window:
            self.doc = self.at = self.n_windows = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        g = self.h[: n - seed + 1].copy()
        for k in range(1, seed):
            g = mix(g * U(0x9E3779B97F4A7C15) + self.h[k : n - seed + 1 + k])
        g >>= U(1)
        if len(common):
            at = np.searchsorted(common, g)
            g[common[np.minimum(at, len(common) - 1)] == g] |= _TOP
        least = _sliding_min(g, window - seed + 1)
        whole = doc[: n - window + 1] == doc[window - 1 :]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1])
        a, b = runs(whole, new)
        self.key, self.doc, self.at, self.n_windows = least[a], doc[a], a, b - a
        self.word = a - first_word[self.doc]

    def repeats(self, window: int) -> np.ndarray:
        """For each super-k-mer, whether an equal one is earlier in the chunk."""
        last = self.at + self.n_windows + window - 1
        whole = Rolling(self.h).of(self.at, last)
        order = np.argsort(whole, kind="stable")
        same = np.concatenate([[False], whole[order][1:] == whole[order][:-1]])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        out = np.zeros(len(order), bool)
        i, j = order[same], head[same]
        equal = slices_equal(self.text, self.starts[self.at[i]], self.ends[last[i] - 1], self.starts[self.at[j]], self.ends[last[j] - 1])
        later = (self.id[self.doc[i]] != self.id[self.doc[j]]) | (self.th[self.doc[i]] != self.th[self.doc[j]]) | (self.word[i] != self.word[j])
        out[i] = equal & later
        return out


def _bundles(window: int, seed: int, n_buckets: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, MAP_BYTES):
            s = _SuperKmers(table, window, seed, common)
            if not len(s.at):
                continue
            again = s.repeats(window)
            # Windows of repeats within the chunk are settled: one interval for each run of them.
            k = np.flatnonzero(again)
            cuts = np.ones(len(k), bool)
            cuts[1:] = (s.doc[k][1:] != s.doc[k][:-1]) | (s.word[k][1:] > (s.word + s.n_windows)[k][:-1] + window - 1)
            first = np.flatnonzero(cuts)
            settled_doc, settled_from = s.doc[k][first], s.word[k][first]
            settled_to = (s.word + s.n_windows)[k][np.concatenate([first[1:] - 1, [len(k) - 1]])] + window - 1 if len(k) else settled_from
            k = np.flatnonzero(~again)
            bucket = (mix(s.key[k]) % U(n_buckets)).astype(np.int64)
            k = k[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
            view, ids, out = memoryview(s.text), (s.id, s.th), ([], [])
            for a, b in zip(edges[:-1], edges[1:]):
                rows = k[a:b]
                f, t = s.starts[s.at[rows]], s.ends[s.at[rows] + s.n_windows[rows] + window - 2]
                text = b" ".join([view[x:y] for x, y in zip(f.tolist(), t.tolist())]) + b" "
                out[0].append(int(bucket[a]))
                out[1].append(pack(ids[0][s.doc[rows]], ids[1][s.doc[rows]], s.word[rows].astype(np.int32), s.n_windows[rows].astype(np.int32), text, level=3))
            if len(settled_doc):  # a bundle of its own, to any bucket
                out[0].append(int(mix(s.th[settled_doc[:1]].view(np.uint64) + U(1))[0] % U(n_buckets)))
                out[1].append(pack(ids[0][settled_doc], ids[1][settled_doc], settled_from.astype(np.int32), settled_to.astype(np.int32), level=3))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["bucket", "bundle"])

    return run


_SPANS = "_id long, _th long, from int, to int, window binary"


def _rows_of(id_, th, start, end, windows: list[bytes] | None = None) -> pa.RecordBatch:
    cols = [pa.array(id_, pa.int64()), pa.array(th, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), pa.binary()) if windows is None else pa.array(windows, pa.binary())], names=["_id", "_th", "from", "to", "window"])


def _buckets(window: int, most: int):
    """Bundles in order of buckets -> intervals of words to remove, and windows of buckets too large to gather."""
    settle = _settle(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, spills = None, [], 0, False
        for batch in batches:
            for bucket, bundle in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    if held:
                        yield settle(held)
                    now, held, size, spills = bucket, [], 0, False
                parts = bundle.as_py()
                held.append(parts)
                size += len(parts)
                if size > most or spills:
                    spills = True
                    for x in held:
                        yield from _windows(unpack(x), window)
                    held = []
        if held:
            yield settle(held)

    return run


def _windows(parts: tuple, window: int) -> Iterator[pa.RecordBatch]:
    """A bundle's windows one by one, each with its text."""
    if len(parts) == 4:
        yield _rows_of(*parts)
        return
    id_, th, word, n_windows, text = parts
    starts, ends = word_spans(text)
    first = np.cumsum(n_windows.astype(np.int64) + window - 1) - (n_windows + window - 1)
    owner = np.repeat(np.arange(len(id_)), n_windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = first[owner] + offset
    for s in range(0, len(owner), 8192):
        p, a = owner[s : s + 8192], at[s : s + 8192]
        start = word[p] + offset[s : s + 8192]
        yield _rows_of(id_[p], th[p], start, start + window, [text[x:y] for x, y in zip(starts[a].tolist(), ends[a + window - 1].tolist())])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of text, id, text hash and start -> those that start earlier elsewhere."""
    text, head = None, None
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (i, t, f, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_id", "_th", "from", "window")))):
            if w != text:
                text, head = w, (i, t, f)
            keep[k] = (i, t, f) != head
        yield batch.select(["_id", "_th", "from", "to"]).filter(pa.array(keep))


def _settle(window: int):
    """A bucket's bundles -> intervals of words to remove."""

    def run(bundles: list[bytes]) -> pa.RecordBatch:
        parts = [unpack(x) for x in bundles]
        done = [p for p in parts if len(p) == 4]  # settled in their chunks
        parts = [p for p in parts if len(p) == 5]
        if not parts:
            return _rows_of(*(np.concatenate([p[i] for p in done]) for i in range(4)))
        id_, th, word, n_windows = (np.concatenate([p[i] for p in parts]) for i in range(4))
        text = b"".join(p[4] for p in parts)
        done = [np.concatenate([p[i] for p in done]) if done else np.zeros(0, np.int64) for i in range(4)]
        del parts
        starts, ends = word_spans(text)
        n_words = n_windows.astype(np.int64) + window - 1
        first_word = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        order = np.lexsort((word, th, id_))
        # The windows, in order of (id, text hash, start): equal hashes keep this order below.
        owner = np.repeat(order, n_windows[order])
        at = np.cumsum(n_windows[order])
        offset = np.arange(len(owner)) - np.repeat(at - n_windows[order], n_windows[order])
        first = first_word[owner] + offset
        h = Rolling(slice_hashes(text, starts, ends)).of(first, first + window)
        by = np.argsort(h, kind="stable")
        same = np.concatenate([[False], h[by][1:] == h[by][:-1]])
        head = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
        i, j = by[same], head[same]
        flag = np.zeros(len(owner), bool)
        begin, end = starts[first], ends[first + window - 1]
        equal = slices_equal(text, begin[i], end[i], begin[j], end[j])

        def later(i, j):
            p, q = owner[i], owner[j]
            return (id_[p] != id_[q]) | (th[p] != th[q]) | (word[p] + offset[i] != word[q] + offset[j])

        flag[i] = equal & later(i, j)
        if not equal.all():  # different windows with one hash: settle those by their bytes
            odd = np.isin(h, h[i[~equal]])
            seen: dict[bytes, int] = {}
            for w in np.flatnonzero(odd):
                f = seen.setdefault(text[begin[w] : end[w]], int(w))
                flag[w] = f != w and bool(later(np.array([w]), np.array([f]))[0])
        a, b = runs(flag, offset == 0)
        p = owner[a]
        cols = [
            np.concatenate([id_[p], done[0]]),
            np.concatenate([th[p], done[1]]),
            np.concatenate([word[p] + offset[a], done[2]]).astype(np.int32),
            np.concatenate([word[p] + offset[b - 1] + window, done[3]]).astype(np.int32),
        ]
        del text, h, by, owner, offset, first, begin, end
        release()
        return _rows_of(*cols)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(_id, _th, from, to): word intervals of docs covered by windows that start earlier elsewhere."""
    spark = docs.sparkSession
    rows = keyed(docs)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()
    # A super-k-mer of (window - seed + 2) / 2 windows repeats window - 1 words of its neighbour.
    spread = 1 + 2 * (window - 1) / (window - seed + 2)
    n_buckets = max(4 * shuffle_partitions(spark), math.ceil((total.b or 0) * spread / BUCKET_BYTES))
    common = _common_seeds(rows, total.n, window, seed, n_buckets)
    bundles = rows.mapInArrow(_bundles(window, seed, n_buckets, common), "bucket long, bundle binary")
    found = cut(bundles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(window, MOST_BYTES), _SPANS))
    plain, large = found.where("window is null").drop("window"), found.where("window is not null")
    if large.isEmpty():
        return plain
    ordered = large.repartition("window").sortWithinPartitions("window", "_id", "_th", "from")
    return plain.union(ordered.mapInArrow(_again, "_id long, _th long, from int, to int"))


def _common_seeds(rows: DataFrame, n: int, window: int, seed: int, n_buckets: int) -> np.ndarray:
    """Seeds that would fill a fair part of a bucket, from a sample of the documents. There are
    at most as many as their least share allows: 65536, and so half a megabyte."""
    if not n:
        return np.zeros(0, np.uint64)

    def keys(batches):
        for table in chunks(batches, MAP_BYTES):
            s = _SuperKmers(table, window, seed, np.zeros(0, np.uint64))
            if len(s.at):
                k, c = np.unique(s.key[~s.repeats(window)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["k", "c"])

    picked = rows.sample(False, min(1.0, SAMPLE_DOCS / n), 7) if n > SAMPLE_DOCS else rows
    counts = picked.mapInArrow(keys, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    counts = cut(counts.where(F.col("c") > 8))  # what few documents hold says nothing of the corpus
    total = counts.agg(F.sum("c")).first()[0] or 0
    found = counts.where(F.col("c") > total / min(8 * n_buckets, 65536)).select("k")
    return np.sort(np.array([r.k for r in found.collect()], np.int64).view(np.uint64))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs' rows as (doc_id, n_words, n_removed, kept): the words kept, joined by a space."""
    spans = (
        repeated_spans(docs, window, seed)
        .groupBy("_id", "_th")
        .agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    )
    rows = keyed(docs).withColumn("doc_id", F.col("_id"))
    joined = rows.join(spans, ["_id", "_th"], "left").select("doc_id", "text", "spans")

    def cut_out(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for t, spans in zip(as_bytes(batch.column("text")), batch.column("spans")):
                w = t.split()
                n_words.append(len(w))
                if spans.is_valid:
                    x = spans.values.flatten()
                    out, at = [], 0
                    for a, b in merge_intervals(x[0].to_numpy(), x[1].to_numpy()):
                        out += w[at:a]
                        at = b
                    w = out + w[at:]
                n_removed.append(n_words[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(cut_out, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(2**63 - 1), F.col("doc_id")))


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over documents."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The definition, word by word; for tests."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        drop = set()
        for s in range(len(w) - window + 1):
            if (t := tuple(w[s : s + window])) in seen:
                drop.update(range(s, s + window))
            seen.add(t)
        kept = b" ".join(x for k, x in enumerate(w) if k not in drop)
        out[i] = (len(w), len(drop), hashlib.sha256(kept).hexdigest())
    return out
