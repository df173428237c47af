"""Near copies by the Jaccard similarity of word shingles: the engine behind `simhash.keep_first`
where it is asked for a similarity instead of a number of bits.

A document is the set of its distinct runs of WIDTH words, lower-cased in ASCII (of all its
words where it has fewer). Documents whose sets have a Jaccard similarity of SIMILAR or more
are linked; linked documents form components. Equal sets, empty ones too, are one node.

Links are found through fingerprints first: each set has a SimHash fingerprint, a bit being set
where more than half of the shingles' hashes have it set, and the pivot distance tables of `simhash`
bring together all fingerprints that differ in PRINT_BITS bits or fewer. What they bring together is
verified on the sets. At a similarity of 0.8 fingerprints differ in 10 bits on average and in up to
20, where all keys of a table would hold all texts, so some links stay unseen.

Those links are found exactly, on the sets: under any common
order of shingles, two sets as similar as that share one among the first
n - ceil(SIMILAR * n) + 1 of each, and those are the keys by which sets meet. Shingles that
are common in a sample come last in the order, so keys are rare; the sample steers how many
candidates there are, never what is found. Candidates that fingerprints have connected are
settled and not looked at again. Bounds discard candidates that cannot be similar:
sizes, and words of parities (each element in which two sets differ flips one bit at most;
a set of n elements has two to four bits an element). What survives is verified on the sets,
which are worked out again for the documents in question only: neither sets nor texts are
written or shuffled for the others. As components are all that is asked for, each set is
verified against one candidate first, and then only what that leaves in different
components: a set travels a few times, however many copies it has.

A key that more than SMALL sets share links them to ANCHORS of its members first; what is
still in different components is then compared in its group, in pairs of blocks of BLOCK
members, which give a spanning forest of the links, never all pairs.

Odd rows are treated as `simhash.keep_first` does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U, as_bytes, bounded_batches, chunks, cut, mix, pack, release, shuffle_partitions, slice_hashes, unpack, word_spans, words_joined
from . import simhash
from .components import components
from .rows import ROW, first_rows, named_rows

WIDTH = 5
#: As a fraction.
SIMILAR = (4, 5)
#: Bits in which the fingerprints of candidates differ at most, and near ones that a fingerprint
#: names where a key gives it more.
PRINT_BITS = 11
NEAREST = 4
SAMPLE_DOCS = 4_000
#: Documents of the sample that make a shingle common, and common ones that are kept at most.
COMMON = 3
MOST_COMMON = 1 << 17
SMALL = 16
ANCHORS = 4
#: Least and most bits of parities.
BITS = (128, 1 << 16)
BUCKET_ROWS = 400_000
BLOCK = 4096
BLOCK_BYTES = 32 << 20
#: Times that some of the large groups are compared before all that are left are.
ROUNDS = 2
#: Rows that are named to all tasks at most (24 bytes each).
FEW = 1_000_000
_FACTOR = np.random.default_rng(5).integers(0, 2**63, 64).astype(np.uint64) * U(2) + U(1)


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, repeats too."""
    joined, counts = words_joined([t.lower() for t in texts])
    starts, ends = word_spans(joined)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = slice_hashes(joined, starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    words = np.minimum(counts[doc], width)
    g = words.astype(np.uint64)
    for k in range(width):
        g += np.where(k < words, h[np.minimum(at + k, len(h) - 1)] * _FACTOR[k], U(0))
    return doc, mix(g)


def ordered_sets(texts: list[bytes], common: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Each text's set, in the common order: shingles of common last, then by hash."""
    doc, h = shingles(texts, width)
    late = np.isin(h, common)
    order = np.lexsort((h, late, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return np.split(h, np.searchsorted(doc, np.arange(1, len(texts))))


def set_name(s: np.ndarray) -> np.uint64:
    return mix(np.array([np.add.reduce(mix(s)) + U(len(s))], np.uint64))[0]


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprint of each set, as uint64."""
    n = np.array([len(s) for s in sets], np.int64)
    doc, h = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    votes = np.zeros((len(sets), 64), np.int64)
    for s in range(0, len(h), simhash.VOTES):
        simhash.vote(votes, doc[s : s + simhash.VOTES], h[s : s + simhash.VOTES])
    return simhash.majority(votes, n)


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of s falls to each of some classes, a power of two of them, packed."""
    bits = min(BITS[1], max(BITS[0], 1 << (2 * len(s)).bit_length()))
    odd = np.bincount((mix(s) >> U(40)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities over fewer classes: each class has the sum of those that it joins."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def prefix(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """Elements of a set of n among which a similar one shares one."""
    a, b = similar
    return n + (-a * n) // b + 1 if n else 0


def enough(shared, total, similar: tuple[int, int] = SIMILAR):
    """Whether sets with total elements together are similar if they share so many."""
    a, b = similar
    return (a + b) * shared >= a * total


def _may(n: np.ndarray, x: list[bytes], m: np.ndarray, y: list[bytes], similar: tuple[int, int]) -> np.ndarray:
    """Whether sets of n and m elements with parities x and y can be similar, row by row."""
    ok = enough(np.minimum(n, m), n + m, similar)
    size = np.array([(len(p), len(q)) for p, q in zip(x, y)], np.int64).reshape(-1, 2)
    for p, q in np.unique(size[ok], axis=0).tolist():
        rows = np.flatnonzero(ok & (size[:, 0] == p) & (size[:, 1] == q))
        u, v = (np.frombuffer(b"".join([c[k] for k in rows.tolist()]), np.uint64).reshape(len(rows), -1) for c in (x, y))
        words = min(p, q) // 8
        differ = np.bitwise_count(folded(u, words) ^ folded(v, words)).astype(np.int64).sum(axis=1)
        ok[rows] = enough((n[rows] + m[rows] - differ) // 2, n[rows] + m[rows], similar)
    return ok


def common_shingles(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Hashes of shingles that are common in a sample of docs, at most MOST_COMMON."""
    total = docs.count()
    texts = bounded_batches(docs).select(F.col("text").cast("string").alias("text"))
    if total > SAMPLE_DOCS:
        texts = texts.sample(SAMPLE_DOCS / total, seed=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, 4 << 20):
            sets = ordered_sets(as_bytes(table.column("text").combine_chunks()), np.zeros(0, np.uint64), width)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    counts = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64))


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(ROW, set, n, fp, wide) for each row: its set's name, size, fingerprint and parities."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, 4 << 20):
            sets = ordered_sets(as_bytes(table.column("text").combine_chunks()), none, width)
            name = np.array([set_name(s) for s in sets], np.uint64).view(np.int64)
            wide = pa.array([parities(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ROW), pa.array(name), pa.array([len(s) for s in sets], pa.int64()), pa.array(fingerprints(sets).view(np.int64)), wide], names=[*ROW, "set", "n", "fp", "wide"])

    rows = named_rows(bounded_batches(docs)).select(*ROW, "text")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*ROW, "set", "n", "fp")) + ", wide binary")


def _deal(n_buckets: int, common, width: int, similar: tuple[int, int]):
    """Texts -> the keys of their sets, packed by bucket; a set once a block."""

    def out(held):
        sizes = np.array([len(x[1]) for x in held.values()], np.int64)
        key = np.concatenate([x[1] for x in held.values()])
        name = np.repeat(np.array(list(held), np.uint64), sizes)
        n = np.repeat(np.array([x[0] for x in held.values()], np.int32), sizes)
        bucket = (mix(key) % U(n_buckets)).astype(np.int64)
        # Half of the key is enough: what meets by chance in a bucket is one more candidate.
        o = np.argsort(bucket, kind="stable")
        bucket, key, name, n = bucket[o], key[o].astype(np.uint32), name[o], n[o]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([pack(key[x:y], name[x:y], n[x:y]) for x, y in zip(edges, edges[1:])], pa.binary())], names=["bucket", "bundle"])

    def run(batches):
        held, size = {}, 0
        for table in chunks(batches, 4 << 20):
            for s in ordered_sets(as_bytes(table.column("text").combine_chunks()), common.value, width):
                if len(s) and (name := int(set_name(s))) not in held:
                    held[name] = (len(s), s[: prefix(len(s), similar)].copy())
                    size += len(held[name][1])
            if size >= 1 << 20:
                yield out(held)
                held, size = {}, 0
                release()
        if held:
            yield out(held)

    return run


def _meet(similar: tuple[int, int], small: int):
    """A bucket's bundles -> candidates (u, v), and the members of keys that many sets share."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("bundle")]
        key, name, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        o = np.lexsort((name, key))
        o = o[np.concatenate([[True], (key[o][1:] != key[o][:-1]) | (name[o][1:] != name[o][:-1])])]
        key, name, n = key[o], name[o].view(np.int64), n[o].astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(edges)
        group = np.repeat(np.arange(len(sizes)), sizes)
        place, size = np.arange(len(key)) - edges[:-1][group], sizes[group]
        del group
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        fits = lambda i, j: enough(np.minimum(n[i], n[j]), n[i] + n[j], similar)
        # Small groups: each against the one d places on. Large ones: each against the first ANCHORS.
        for d in range(1, small):
            i = np.flatnonzero((size <= small) & (place + d < size))
            i = i[fits(i, i + d)]
            u.append(name[i])
            v.append(name[i + d])
        for a in range(ANCHORS):
            i = np.flatnonzero((size > small) & (place > a))
            j = i - place[i] + a
            ok = fits(i, j)
            u.append(name[j[ok]])
            v.append(name[i[ok]])
        u, v = np.concatenate(u), np.concatenate(v)
        u, v = np.minimum(u, v), np.maximum(u, v)
        o = np.lexsort((v, u))
        o = o[np.concatenate([[True], (u[o][1:] != u[o][:-1]) | (v[o][1:] != v[o][:-1])])] if len(o) else o
        u, v = u[o], v[o]
        big = sizes > small
        large = [pack(np.sort(name[s:e])) for s, e in zip(edges[:-1][big].tolist(), edges[1:][big].tolist())]
        none = pa.nulls(len(large), pa.int64())
        out = pa.table([pa.concat_arrays([pa.array(u), none]), pa.concat_arrays([pa.array(v), none]), pa.concat_arrays([pa.nulls(len(u), pa.binary()), pa.array(large, pa.binary())])], names=["u", "v", "large"])
        del key, name, n, o
        release()
        return out

    return run


def _likely(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The candidates that sizes and parities let pass."""
    side = sets.select("set", "n", "wide")
    both = pairs.select("u", "v").distinct().join(side.toDF("u", "n", "x"), "u").join(side.toDF("v", "m", "y"), "v")

    def bounded(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            ok = _may(batch.column("n").to_numpy(), x, batch.column("m").to_numpy(), y, similar)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    return cut(both.select("u", "v", "n", "m", "x", "y").mapInArrow(bounded, "u long, v long"))


def _elements(wanted: DataFrame, docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(set, s) for the sets of wanted, worked out from one document of each."""
    rows = cut(wanted.join(sets.select("set", "row"), "set").select("set", "row.*"))
    few = F.broadcast(rows) if rows.count() <= FEW else rows
    texts = named_rows(bounded_batches(docs)).select(*ROW, "text").join(few, list(ROW)).select("set", "text")

    def run(batches):
        for table in chunks(batches, 4 << 20):
            found = ordered_sets(as_bytes(table.column("text").combine_chunks()), np.zeros(0, np.uint64), width)
            yield pa.RecordBatch.from_arrays([table.column("set").combine_chunks(), pa.array([np.sort(s).tobytes() for s in found], pa.binary())], names=["set", "s"])

    # Rows that are equal in all columns give a set more than once.
    return texts.mapInArrow(run, "set long, s binary").dropDuplicates(["set"])


def _alike(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> bool:
    return bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y), similar))


def _similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    wanted = pairs.select(F.col("u").alias("set")).union(pairs.select(F.col("v").alias("set"))).distinct()
    known = _elements(wanted, docs, sets, width)
    both = pairs.join(known.toDF("u", "a"), "u").join(known.toDF("v", "b"), "v")

    def run(batches):
        for batch in batches:
            ok = [_alike(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), similar) for a, b in zip(batch.column("a"), batch.column("b"))]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return cut(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components; parts is (set, root)."""
    p = pairs.join(parts.toDF("u", "ru"), "u", "left").join(parts.toDF("v", "rv"), "v", "left")
    return p.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """Links (u, v) that connect all sets that the similar ones among the candidates connect."""
    pairs = _likely(pairs, sets, similar)
    first = cut(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    found = _similar(first, docs, sets, width, similar)
    rest = cut(_apart(pairs.join(first, ["u", "v"], "left_anti"), components(found).toDF("set", "root")))
    return found if rest.isEmpty() else found.union(_similar(rest, docs, sets, width, similar))


def by_fingerprints(docs: DataFrame, sets: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links (u, v) between similar sets that the pivot tables of their fingerprints bring together; a set whose
    fingerprint another one has is a candidate with the least such set."""
    nodes = cut(sets.groupBy("fp").agg(F.min("set").alias("id")))
    equal = sets.join(nodes, "fp").where("id <> set").select(F.col("id").alias("u"), F.col("set").alias("v"))
    near = simhash.links(nodes, PRINT_BITS, NEAREST).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return _verified(near.union(equal), docs, sets, width, similar)


def _across(similar: tuple[int, int]):
    """A pair of blocks of a large group -> links that connect the components of its similar sets. Sets that
    are connected by now are not compared, and no more links leave than there are components."""

    def run(table: pa.Table) -> pa.Table:
        name, root, n, own, p, q = (table.column(c).to_numpy() for c in ("set", "root", "n", "own", "p", "q"))
        u, v = [], []
        if len(np.unique(root)) > 1:
            _, part = np.unique(root, return_inverse=True)
            wide = table.column("wide").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
            left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
            for i in left.tolist():
                j = right[(part[right] != part[i]) & (right > i if p[0] == q[0] else True) & enough(np.minimum(n[i], n[right]), n[i] + n[right], similar)]
                if not len(j):
                    continue
                j = j[_may(np.full(len(j), n[i]), [wide[i]] * len(j), n[j], [wide[k] for k in j.tolist()], similar)]
                for k in j.tolist():
                    if part[k] != part[i] and _alike(sets[i], sets[k], similar):
                        u.append(min(name[i], name[k]))
                        v.append(max(name[i], name[k]))
                        part[part == part[k]] = part[i]
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _live(similar: tuple[int, int]):
    """A pair of blocks of a large group -> (g, set) of those that may be similar to one of another component."""

    def run(table: pa.Table) -> pa.Table:
        root, n, own, p, q = (table.column(c).to_numpy() for c in ("root", "n", "own", "p", "q"))
        live = np.zeros(len(n), bool)
        if len(np.unique(root)) > 1:
            wide = table.column("wide").to_pylist()
            left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
            for i in left.tolist():
                j = right[(root[right] != root[i]) & (right > i if p[0] == q[0] else True) & enough(np.minimum(n[i], n[right]), n[i] + n[right], similar)]
                if len(j):
                    j = j[_may(np.full(len(j), n[i]), [wide[i]] * len(j), n[j], [wide[k] for k in j.tolist()], similar)]
                    live[i] |= len(j) > 0
                    live[j] = True
        return table.select(["g", "set"]).filter(pa.array(live))

    return run


def _groups(large: DataFrame, found: DataFrame, docs: DataFrame, sets: DataFrame, width: int, similar: tuple[int, int], block: int) -> DataFrame:
    """found, and the links within large groups of keys that it does not yet make up for.

    Parities show first which members may have a link to another component at all; only their sets
    are compared. Groups of one family of copies have most members in common, so they are not
    compared all at once: each set names one of its groups, those are compared as wholes, and
    the others only if they still have members in different components."""

    def members(batches):
        for batch in batches:
            for x in batch.column("large"):
                (name,) = unpack(x.as_py())
                g = mix(np.array([np.add.reduce(mix(name.view(np.uint64))) + U(len(name))], np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g, len(name))), pa.array(name)], names=["g", "set"])

    def open_groups(left: DataFrame) -> DataFrame:
        """left with root and the number of blocks, without groups that are one component."""
        parts = components(found).toDF("set", "root")
        m = left.join(parts, "set", "left").withColumn("root", F.coalesce("root", "set"))
        size = m.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("e")).where("lo <> hi")
        blocks = F.ceil(F.greatest(F.col("c") / block, 8 * F.col("e") / BLOCK_BYTES)).cast("int")
        return cut(m.join(size.select("g", blocks.alias("nb")), "g"))

    def cells(m: DataFrame):
        """m, a row for each pair of blocks, grouped by pair."""
        m = m.join(sets.select("set", "wide"), "set")
        m = m.withColumn("own", F.pmod(F.xxhash64("set"), F.col("nb")).cast("int")).withColumn("_o", F.explode(F.expr("sequence(0, nb - 1)")))
        m = m.withColumn("p", F.least("own", "_o")).withColumn("q", F.greatest("own", "_o")).drop("_o", "nb")
        return m.groupBy("g", "p", "q")

    # Keys that the same sets share are one group.
    left = cut(large.mapInArrow(members, "g long, set long").distinct().join(sets.select("set", "n"), "set").select("g", "set", "n"))
    live = cells(open_groups(left)).applyInArrow(_live(similar), "g long, set long").distinct()
    left = cut(left.join(live, ["g", "set"], "left_semi"))
    for last in [False] * ROUNDS + [True]:
        if left.isEmpty() or (now := open_groups(left)).isEmpty():
            break
        if not last:
            named = cut(now.groupBy("set").agg(F.min("g").alias("g")).select("g").distinct())
            left = cut(now.join(named, "g", "left_anti").select("g", "set", "n"))
            now = now.join(named, "g", "left_semi")
        known = _elements(now.select("set").distinct(), docs, sets, width)
        found = cut(found.union(cells(now.join(known, "set")).applyInArrow(_across(similar), "u long, v long")))
    return found


def links(docs: DataFrame, sets: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between sets of docs that connect all similar ones; sets has (set, n, fp, wide, row)."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    total = (sets.agg(F.sum("n")).first()[0] or 0) * (1 - similar[0] / similar[1])
    n_buckets = max(4 * shuffle_partitions(spark), math.ceil(total / BUCKET_ROWS))
    bundles = bounded_batches(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(_deal(n_buckets, common, width, similar), "bucket long, bundle binary")
    met = cut(bundles.groupBy("bucket").applyInArrow(_meet(similar, small), "u long, v long, large binary"))
    known = cut(by_fingerprints(docs, sets, width, similar))
    unseen = _apart(met.where("u is not null").select("u", "v"), components(known).toDF("set", "root"))
    found = cut(known.union(_verified(unseen, docs, sets, width, similar)))
    large = met.where("large is not null").select("large")
    if large.isEmpty():
        return found
    return _groups(large, found, docs, sets, width, similar, block)


def keep_first(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs with one document of each component, the one with the smallest id."""
    rows = cut(described(docs, width))
    sets = rows.groupBy("set").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("wide").alias("wide"), F.min(F.struct(*ROW)).alias("row"))
    parts = components(links(docs, cut(sets), width, similar)).toDF("set", "_root")
    return first_rows(docs, rows.select(*ROW, "set").join(parts, "set", "left").withColumn("_root", F.coalesce("_root", "set")))


def brute_force(texts: dict[int, str | None], width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> set[int]:
    """The ids that stay, pair by pair; for tests."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) * similar[1] >= similar[0] * len(x | y) and x and y:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in ids if find(i) == i}
