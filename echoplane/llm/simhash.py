"""SimHash near-dedup with pivot distance tables.

A document's fingerprint has a bit set where more than half of its 3-word shingles'
XXH64 values (seed 42) have it set. Documents whose fingerprints differ in MAX_BITS bits
or fewer are linked; linked documents form components.

Links are found over distinct fingerprints, so exact copies cost nothing. Each
fingerprint gets a table of Hamming distances to reference fingerprints (pivots):

* under each of MAX_BITS + 1 disjoint masks, distances to REFERENCES pivots. Two linked
  fingerprints agree under at least one mask, and so have there the same distances: that
  row of the table is the key by which candidates meet. A key that more than HOT distinct
  fingerprints share is dealt again by the distances under masks that split the remaining
  bits, as often as needed; no pair is lost by that, and none is capped;
* over all bits, distances to PIVOTS pivots. By the triangle inequality a pair whose
  largest coordinate difference is over MAX_BITS cannot be linked and is discarded; what
  survives is verified on the fingerprints.

Within a key only a spanning forest of the links is emitted, never all pairs.

Where `keep_first` is asked for a similarity, the same tables bring candidates together at more
bits (`links` with bits and each), and `near_copies` verifies them on the sets of shingles.

Defined results for odd rows: a null text has no words and fingerprint zero; a null
doc_id takes part and sorts last, and its component_id is null only if all ids of the
component are null; rows with equal doc_id, or none, are linked by their texts only, as
any others are; `keep_first` keeps exactly one row of each component, by least doc_id,
then text hash, then hash of the whole row; other columns are ignored by `fingerprints`
and kept by `keep_first`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, U, as_bytes, bounded_batches, chunks, cut, mix, pack, release, shuffle_partitions, unpack, word_spans, words_joined
from .components import components
from .rows import ROW, first_rows, named_rows

SHINGLE = 3
MAX_BITS = 3
REFERENCES = 12
PIVOTS = 8
#: Distinct fingerprints that may share a key before it is dealt again.
HOT = 20_000
#: Fingerprints (with their copies for each mask) that a bucket holds on average.
BUCKET_ROWS = 200_000
#: Hashes that vote at a time.
VOTES = 1 << 17
#: Fingerprints that are compared with the others of their key at a time.
ROWS = 64
_rng = np.random.default_rng(2024)
_REFERENCE = _rng.integers(0, 2**64, REFERENCES, dtype=np.uint64)
_PIVOT = _rng.integers(0, 2**64, PIVOTS, dtype=np.uint64)


def vote(votes: np.ndarray, doc: np.ndarray, h: np.ndarray) -> None:
    """Adds the set bits of each hash to the row of votes of its document; doc is sorted."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    votes[doc[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)


def majority(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprints, as uint64: bits that more than half of each row's n hashes have set."""
    return np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def text_fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    text, counts = words_joined([t.lower() for t in texts])
    starts, ends = word_spans(text)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    last = np.minimum(at + shingle, first[doc] + counts[doc]) - 1
    votes = np.zeros((len(texts), 64), np.int64)
    digest, block = xxhash.xxh64_intdigest, VOTES
    for s in range(0, len(doc), block):
        d = doc[s : s + block]
        pairs = zip(starts[at[s : s + block]].tolist(), ends[last[s : s + block]].tolist())
        h = np.fromiter((digest(text[a:b], 42) for a, b in pairs), np.uint64, len(d))
        vote(votes, d, h)
    return majority(votes, n)


def fingerprints(docs: DataFrame, *names: str) -> DataFrame:
    """(_id, fp): each row's id (nulls as NULL_ID) and fingerprint, as a signed long; with names,
    these long columns of docs in place of _id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, 4 << 20):
            fp = text_fingerprints(as_bytes(table.column("text").combine_chunks()))
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in kept), pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    kept = names or ("_id",)
    ids = [F.col(c) for c in names] or [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id")]
    rows = bounded_batches(docs).select(*ids, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*kept, "fp")))


def split_mask(mask: int, parts: int = MAX_BITS + 1) -> list[int]:
    """mask's bits in parts runs of nearly equal size."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(x.tolist()) for x in np.array_split(np.array(bits, dtype=object), parts)]


def masks(path: int, level: int, bits: int = MAX_BITS) -> list[int]:
    """The masks that follow a path of choices (four bits a level) made so far."""
    free, chosen = 2**64 - 1, split_mask(2**64 - 1, bits + 1)
    for k in range(level):
        free &= ~chosen[path >> (4 * k) & 15]
        chosen = split_mask(free, bits + 1)
    return chosen


#: Levels after which so few bits are free that a key has few fingerprints in any case.
MAX_LEVEL = 5
#: The same where candidates are asked for, which many more masks deal.
WIDE_LEVEL = 1


def _deal(level: int, n_buckets: int, bits: int):
    """(key, path, fp, id) -> the same for the keys of the next masks, packed by bucket."""

    def run(batches):
        for batch in batches:
            key, path, fp, id_ = (batch.column(c).to_numpy() for c in ("key", "path", "fp", "id"))
            keys, paths, rows = [], [], []
            for p in np.unique(path).tolist():
                at = np.flatnonzero(path == p)
                for band, m in enumerate(masks(p, level, bits)):
                    x = fp[at].view(np.uint64) & U(m)
                    table = np.zeros(len(at), np.uint64)
                    for r in _REFERENCE:
                        table = (table << U(5)) | np.bitwise_count(x ^ (r & U(m))).astype(np.uint64)
                    keys.append(mix(mix(table) + key[at].view(np.uint64) * U(0x9E3779B97F4A7C15) + U(band + 1)))
                    paths.append(np.full(len(at), p | band << (4 * level)))
                    rows.append(at)
            if not keys:
                continue
            k, p, at = np.concatenate(keys), np.concatenate(paths), np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array((k % U(n_buckets)).astype(np.int64)), pa.array(k.view(np.int64)), pa.array(p), pa.array(fp[at]), pa.array(id_[at])], names=["bucket", "key", "path", "fp", "id"])

    return run


def _bundle(batches):
    """Rows of a task -> one packed row for each bucket and block of rows."""
    held, size = [], 0

    def out():
        t = pa.Table.from_batches(held)
        b, k, f, i = (t.column(c).to_numpy() for c in ("bucket", "key", "fp", "id"))
        order = np.argsort(b, kind="stable")
        b, k, f, i = b[order], k[order], f[order], i[order]
        edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])).tolist()
        return pa.RecordBatch.from_arrays([pa.array(b[edges[:-1]]), pa.array([pack(k[x:y], f[x:y], i[x:y]) for x, y in zip(edges, edges[1:])], pa.binary())], names=["bucket", "bundle"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 1 << 20:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def link_forest(fp: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fp: pairs of positions."""
    coords = np.bitwise_count(fp[:, None] ^ _PIVOT).astype(np.int8)
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = left
            for j in range(PIVOTS):  # the largest coordinate difference must not pass bits
                near = near[np.abs(coords[near, j] - coords[u, j]) <= bits]
                if len(near) < 64:
                    near = near[(np.abs(coords[near] - coords[u]) <= bits).all(axis=1)]
                    break
            hit = near[np.bitwise_count(fp[near] ^ fp[u]) <= bits]
            if len(hit):
                a.append(np.full(len(hit), u))
                b.append(hit)
                queue += hit.tolist()
                left = left[~np.isin(left, hit, assume_unique=True)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def near_pairs(fp: np.ndarray, bits: int, each: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions: each of fp and all that differ in at most bits bits, or the `each` nearest
    where there are more. More than run of them are compared in runs of neighbours by value."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(fp, kind="stable")
    for s in range(0, len(fp), run):
        at = order[s : s + run]
        coords = np.bitwise_count(fp[at] ^ _PIVOT[:, None]).astype(np.int8)
        # The first coordinate bounds what a block of rows is compared with at all.
        spread = np.argsort(-coords.std(axis=1))
        o = np.argsort(coords[spread[0]], kind="stable")
        at, coords = at[o], np.ascontiguousarray(coords[spread][:, o])
        x = fp[at]
        for p in range(0, len(x), ROWS):
            own, c = x[p : p + ROWS], coords[:, p : p + ROWS]
            lo, hi = np.searchsorted(coords[0], [c[0, 0] - bits, c[0, -1] + bits + 1])
            far = np.zeros((len(own), hi - lo), bool)
            for k in range(PIVOTS):  # the largest coordinate difference must not pass bits
                far |= np.abs(c[k][:, None] - coords[k, lo:hi]) > bits
            near = (np.bitwise_count(own[:, None] ^ x[lo:hi]) <= bits) & ~far
            i, j = np.divmod(np.flatnonzero(near), hi - lo)
            j += lo
            i, j = i[i + p != j], j[i + p != j]
            d = np.bitwise_count(own[i] ^ x[j])
            edges = np.searchsorted(i, np.arange(len(own) + 1))
            for r in np.flatnonzero(np.diff(edges) > each).tolist():
                u, v = edges[r], edges[r + 1]
                nearest = j[u:v][np.argpartition(d[u:v], each - 1)[:each]]
                a.append(np.full(each, at[p + r]))
                b.append(at[nearest])
            few = (np.diff(edges) <= each)[i]
            a.append(at[p + i[few]])
            b.append(at[j[few]])
    return np.concatenate(a), np.concatenate(b)


def _link(bits: int, each: int | None, run: int):
    """A bucket's bundles -> links (u, v) between ids."""

    def link(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("bundle")]
        key, fp, id_ = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(key, kind="stable")
        key, fp, id_ = key[order], fp[order].view(np.uint64), id_[order]
        coords = np.bitwise_count(fp[:, None] ^ _PIVOT).astype(np.int8)
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(edges)
        u, v = [], []
        # Small groups all at once: each row against the one d places on.
        group = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(key)) - edges[:-1][group]
        small = sizes[group] <= 8
        for d in range(1, 8):
            i = np.flatnonzero(small & (place + d < sizes[group]))
            i = i[(np.abs(coords[i] - coords[i + d]) <= bits).all(axis=1)]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
            u.append(id_[i])
            v.append(id_[i + d])
        for g in np.flatnonzero(sizes > 8).tolist():
            s, e = edges[g], edges[g + 1]
            a, b = near_pairs(fp[s:e], bits, each, run) if each else link_forest(fp[s:e], bits)
            u.append(id_[s:e][a])
            v.append(id_[s:e][b])
        out = pa.table([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
        del parts, coords, key, fp
        release()
        return out

    return link


def links(nodes: DataFrame, bits: int = MAX_BITS, each: int | None = None) -> DataFrame:
    """nodes (fp, id), fp distinct -> links (u, v) between ids that connect all fingerprints
    that differ in bits bits (15 at most) or fewer. With each, the pairs themselves, as candidates of a
    closer look: all of them, but for fingerprints that more than `each` others are near to under one key,
    which name their nearest, and for keys that are hot at the last level, which are compared in runs of HOT."""
    spark = nodes.sparkSession
    last = WIDE_LEVEL if each else MAX_LEVEL
    rows = nodes.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("path"), "fp", "id")
    total, found = nodes.count() * (bits + 1), None
    for level in range(last + 1):
        n_buckets = max(4 * shuffle_partitions(spark), math.ceil(total / BUCKET_ROWS))
        dealt = rows.mapInArrow(_deal(level, n_buckets, bits), "bucket long, key long, path long, fp long, id long")
        if level < last:
            # Read for the counts of keys, for those that are settled and for those that are dealt again.
            dealt = cut(dealt)
            hot = cut(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT))
        more = level < last and (n_hot := hot.agg(F.sum("n")).first()[0])
        now = dealt.join(hot.select("key"), "key", "left_anti") if more else dealt
        new = now.select("bucket", "key", "fp", "id").mapInArrow(_bundle, "bucket long, bundle binary").groupBy("bucket").applyInArrow(_link(bits, each, HOT), "u long, v long")
        found = new if found is None else found.union(new)
        if not more:
            return found
        rows = cut(dealt.join(hot.select("key"), "key", "left_semi").select("key", "path", "fp", "id"))
        total = n_hot * (bits + 1)
    return found


def assign(docs: DataFrame) -> DataFrame:
    """(_id, fp, _component) for each row of docs; ids as `fingerprints` has them."""
    prints = cut(fingerprints(docs))
    return prints.join(roots(prints), "fp").select("_id", "fp", "_component")


def roots(prints: DataFrame) -> DataFrame:
    """prints (_id, fp) -> (fp, _root, _component) for each fingerprint: its component's least
    fingerprint, which names it, and least id. Ids may repeat, so the graph is of fingerprints."""
    nodes = cut(prints.groupBy("fp").agg(F.min("_id").alias("id")))
    parts = components(links(nodes.select("fp", F.col("fp").alias("id")))).withColumnRenamed("node", "fp")
    named = cut(nodes.join(parts, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("_root")))
    least = named.groupBy("_root").agg(F.min("id").alias("_component"))
    return cut(named.join(least, "_root").select("fp", "_root", "_component"))


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over documents."""
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    known = lambda c: F.when(F.col(c) != F.lit(NULL_ID), F.col(c))
    return out.select(known("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("_component").alias("component_id"))


def keep_first(docs: DataFrame, similar: tuple[int, int] | None = None, width: int | None = None) -> DataFrame:
    """docs with one document of each component, the one with the smallest id. By default documents are
    linked by their fingerprints' bits. Where a Jaccard similarity of word shingles is asked for
    (as a fraction; runs of 5 words unless width says otherwise), fingerprints that differ in few bits make
    candidates; `near_copies` verifies them and finds the links that no such bits show."""
    if similar:
        from . import near_copies  # it builds on this module

        return near_copies.keep_first(docs, width or near_copies.WIDTH, similar)
    prints = cut(fingerprints(named_rows(docs), *ROW))
    return first_rows(docs, prints.join(roots(prints).select("fp", "_root"), "fp"))


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[str, int]]:
    """The definition, pair by pair; for tests."""
    prints = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}
