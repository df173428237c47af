"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

The key of a line is the line without white space (0x20, 0x09-0x0D) at its ends and
with A-Z in lower case. A key of MIN_CHARS code points or more that several documents
hold loses its lines in all of them but the one with the smallest doc_id. Keys are
carried as 128-bit digests, which are taken as equal where they are equal, and dealt to
shards by digest. Each shard has an exact table
``digest -> (documents that hold it, smallest of them)`` and, before it, a cuckoo filter
of the table's keys: a key that the filter does not know is new and needs no look-up,
and keys can be taken out again, which lets `LineIndex` insert and delete documents.

A map task sums up each chunk first: a shard gets a key at most once a chunk, however
many documents hold it, because in the chunk all holders but the smallest lose the line
in any case. A shard is read as a stream; one that passes MOST_BYTES all the same is
summed up by Spark, key by key.

Defined results for odd rows: a null or empty text is one empty line and stays; rows
with the same doc_id are one document; a null doc_id is one document that sorts last;
other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import NULL_ID, U, as_bytes, bounded_batches, chunks, cut, mix, pack, release, shuffle_partitions, unpack

MIN_CHARS = 10
#: Bytes of text whose keys a shard holds on average, at most.
SHARD_BYTES = 32 << 20
#: Bytes of keys and counts that a task gathers for a shard, at most: eight times the average.
MOST_BYTES = 128 << 20
_D = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def line_key(line: bytes) -> bytes | None:
    """The line's key, or None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or not key.isascii() and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return key


def digests(text: bytes) -> list[bytes | None]:
    """The digest of each line's key."""
    return [None if (k := line_key(x)) is None else xxhash.xxh3_128_digest(k) for x in text.split(b"\n")]


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets and may be deleted.

    Works on arrays of 64-bit hashes. Where an insertion finds no room, the caller
    rebuilds a larger filter from its exact table, so that none is ever lost."""

    SLOTS = 4

    def __init__(self, capacity: int):
        self.n = 1 << max(2, math.ceil(math.log2(max(1, capacity) / (self.SLOTS * 0.7))))
        self.table = np.zeros((self.n, self.SLOTS), np.uint16)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(h, np.uint64)
        tag = ((h >> U(48)).astype(np.uint16)) | np.uint16(1)
        one = (h & U(self.n - 1)).astype(np.int64)
        return tag, one, self._other(one, tag)

    def _other(self, at, tag):
        return at ^ (mix(np.asarray(tag, np.uint64)) & U(self.n - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        tag, one, two = self._places(h)
        return ((self.table[one] == tag[:, None]) | (self.table[two] == tag[:, None])).any(axis=1)

    def insert(self, h: np.ndarray) -> bool:
        """Adds all; False if there was no room for one."""
        tag, one, two = self._places(h)
        left = np.arange(len(tag))
        for at in (one, two, one, two):  # in bulk: the k-th newcomer of a bucket takes its k-th free slot
            if not len(left):
                return True
            b = at[left]
            order = np.argsort(b, kind="stable")
            b, who = b[order], left[order]
            new = np.concatenate([[True], b[1:] != b[:-1]])
            rank = np.arange(len(b)) - np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
            free = self.table[b] == 0
            nth = np.cumsum(free, axis=1)
            fits = rank < nth[:, -1]
            slot = np.argmax(nth == (rank + 1)[:, None], axis=1)
            self.table[b[fits], slot[fits]] = tag[who[fits]]
            left = who[~fits]
        rng = np.random.default_rng(0)
        for i in left.tolist():  # the few others push fingerprints to their second places
            t, at = tag[i], int(one[i])
            for _ in range(500):
                empty = np.flatnonzero(self.table[at] == 0)
                if len(empty):
                    self.table[at, empty[0]] = t
                    break
                k = int(rng.integers(self.SLOTS))
                t, self.table[at, k] = self.table[at, k], t
                at = int(self._other(np.array([at]), np.array([t]))[0])
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Takes out one fingerprint for each hash; each must have been inserted."""
        tag, one, two = self._places(h)
        for t, a, b in zip(tag, one.tolist(), two.tolist()):
            for at in (a, b):
                k = np.flatnonzero(self.table[at] == t)
                if len(k):
                    self.table[at, k[0]] = 0
                    break


class Shard:
    """One shard: the exact reference counts and the cuckoo filter before them."""

    def __init__(self, capacity: int, filter_: CuckooFilter | None = None, refs: dict[bytes, list[int]] | None = None):
        self.refs = refs if refs is not None else {}
        self.filter = filter_ or CuckooFilter(2 * capacity)

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        return mix(keys["hi"] ^ (keys["lo"] * U(0x9E3779B97F4A7C15)))

    def insert(self, keys: np.ndarray, count: np.ndarray, first: np.ndarray) -> None:
        """Adds count holders, the smallest of them first, to each of the (distinct) keys."""
        h = self.hashes(keys)
        known = self.filter.contains(h)
        fresh = ~known
        raw, refs, count, first = keys.view("V16"), self.refs, count.tolist(), first.tolist()
        for i in np.flatnonzero(known).tolist():
            k = raw[i].tobytes()
            if (r := refs.get(k)) is None:  # the filter took another key for this one
                refs[k] = [count[i], first[i]]
                fresh[i] = True
            else:
                r[0] += count[i]
                r[1] = min(r[1], first[i])
        for i in np.flatnonzero(~known).tolist():
            refs[raw[i].tobytes()] = [count[i], first[i]]
        # Past three fifths of its slots a filter is slow to fill: a larger one takes over.
        if len(self.refs) > 0.6 * self.filter.table.size or not self.filter.insert(h[fresh]):
            self.rebuild()

    def rebuild(self) -> None:
        keys, size = np.frombuffer(b"".join(self.refs), _D), 3 * len(self.refs) + 64
        while True:
            self.filter = CuckooFilter(size)
            if self.filter.insert(self.hashes(keys)):
                return
            size *= 2


def _chunk_sums(n_shards: int):
    """Documents -> (shard, bundle): for each chunk and shard the keys, their holders' count and
    the smallest holder; with them (in one bundle) the lines that are settled in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            table = table.sort_by("_id")
            held: dict[bytes, list[int]] = {}  # count, smallest, latest
            settled: list[tuple[int, bytes]] = []
            for i, t in zip(table.column("_id").to_pylist(), as_bytes(table.column("text").combine_chunks())):
                for d in dict.fromkeys(digests(t)):
                    if d is None:
                        continue
                    if (r := held.get(d)) is None:
                        held[d] = [1, i, i]
                    elif r[2] != i:
                        r[0] += 1
                        r[2] = i
                        settled.append((i, d))
            if not held:
                continue
            keys = np.frombuffer(b"".join(held), _D)
            sums = np.array(list(held.values()), np.int64)
            shard = (mix(Shard.hashes(keys)) % U(n_shards)).astype(np.int64)
            out, drop_id = ([], []), np.array([x[0] for x in settled], np.int64)
            drop_key = np.frombuffer(b"".join(x[1] for x in settled), _D)
            for s in np.unique(shard).tolist():
                at = shard == s
                out[0].append(s)
                out[1].append(pack(keys[at], sums[at, 0], sums[at, 1]))
            if settled:  # a bundle of its own, to any shard
                out[0].append(int(mix(drop_id[:1].view(np.uint64) + U(1))[0] % U(n_shards)))
                out[1].append(pack(drop_id, drop_key))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["shard", "bundle"])

    return run


def _lost(ids: np.ndarray, keys: np.ndarray, open_: bool = False) -> pa.RecordBatch:
    """Rows (_id, key, open): lines that go, or that are still to be settled."""
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), data, pa.array(np.full(len(keys), open_))], names=["_id", "key", "open"])


def _shards(most: int):
    """Bundles in order of shards -> (_id, key, open): lines that go. A shard's bundles are gathered as long
    as they take no more than most bytes; keys of a larger one leave as open rows, for Spark to sum up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, spills = None, [], 0, False
        for batch in batches:
            for shard, bundle in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != now:
                    if held:
                        yield _drops(held)
                    now, held, size, spills = shard, [], 0, False
                x = bundle.as_py()
                parts = unpack(x)
                if len(parts) == 2:
                    yield _lost(*parts)
                    continue
                held.append(parts)
                size += parts[0].nbytes + parts[1].nbytes + parts[2].nbytes
                if size > most or spills:
                    spills = True
                    for keys, _, first in held:
                        yield _lost(first, keys, True)
                    held = []
        if held:
            yield _drops(held)

    return run


def _drops(parts: list[tuple]) -> pa.RecordBatch:
    """A shard's bundles -> the lines that go."""
    shard = Shard(max(len(p[0]) for p in parts))
    for p in parts:
        shard.insert(*p)
    ids, keys = [], []
    for key, _, first in parts:
        least = np.fromiter((shard.refs[k.tobytes()][1] for k in key.view("V16")), np.int64, len(key))
        lost = least < first
        ids.append(first[lost])
        keys.append(key[lost])
    out = _lost(np.concatenate(ids), np.concatenate(keys))
    del shard, parts
    release()
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.col("text").cast("string").alias("text"))


def _n_shards(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first().b or 0
    return max(4 * shuffle_partitions(docs.sparkSession), math.ceil(size / SHARD_BYTES))


def drop_table(docs: DataFrame) -> DataFrame:
    """(_id, key): the digests of the lines that each document loses."""
    bundles = _rows(docs).mapInArrow(_chunk_sums(_n_shards(docs)), "shard long, bundle binary")
    found = cut(bundles.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards(MOST_BYTES), "_id long, key binary, open boolean"))
    plain, large = found.where("not open").select("_id", "key"), found.where("open").select("_id", "key")
    if large.isEmpty():
        return plain
    # Minima are combined before the exchange, and Spark splits a key that very many rows hold.
    least = large.groupBy("key").agg(F.min("_id").alias("least"))
    return plain.union(large.join(least, "key").where("_id > least").select("_id", "key"))


def _apply_drops(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs with text cut, and the columns n_lines and n_dropped."""
    lost = drops.groupBy("_id").agg(F.array_join(F.collect_list(F.hex("key")), "").alias("_keys"))
    rest = [c for c in docs.columns if c != "text"]
    # The other columns travel as one struct, so that no name of theirs can clash.
    rows = bounded_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest"), F.col("text").cast("string").alias("_text"))
    joined = rows.join(lost, "_id", "left").select("_rest", "_text", "_keys")
    kind = T.StructType([joined.schema["_rest"], joined.schema["_text"], T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])

    def apply(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, keys in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_keys").to_pylist()):
                n_lines.append((t or b"").count(b"\n") + 1)
                n_dropped.append(0)
                if keys:
                    raw = bytes.fromhex(keys)
                    gone = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                    lines = t.split(b"\n")
                    left = [x for x, d in zip(lines, digests(t)) if d not in gone]
                    n_dropped[-1] = len(lines) - len(left)
                    t = b"\n".join(left)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["_rest", "_text", "_n_lines", "_n_dropped"])

    out = joined.mapInArrow(apply, kind)
    return out.select(*(F.col("_text").alias("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns), "_n_lines", "_n_dropped")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines cut from text, and the columns _n_lines (before) and _n_dropped."""
    return _apply_drops(docs, drop_table(docs))


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over documents."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


class LineIndex:
    """A line dedup that documents can join and leave.

    ``postings`` (key, doc_id) and ``refs`` (shard, key, n, first) are the exact tables,
    ``filters`` (shard, filter) has one cuckoo filter a shard. `insert` and `delete` return
    a new index; `apply` cuts from documents what the index's other documents make
    repeats. Inserting and then deleting documents restores the tables."""

    def __init__(self, postings: DataFrame, refs: DataFrame, filters: DataFrame, n_shards: int):
        self.postings, self.refs, self.filters, self.n_shards = postings, refs, filters, n_shards

    @classmethod
    def empty(cls, spark, n_shards: int) -> LineIndex:
        make = spark.createDataFrame
        return cls(make([], "key binary, _id long"), make([], "shard long, key binary, n long, first long"), make([], "shard long, filter binary"), n_shards)

    def _postings(self, docs: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                keys, ids = [], []
                for i, t in zip(batch.column("_id").to_pylist(), as_bytes(batch.column("text"))):
                    own = [d for d in dict.fromkeys(digests(t)) if d is not None]
                    keys += own
                    ids += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "_id"])

        return _rows(docs).mapInArrow(run, "key binary, _id long").distinct()

    def _shard(self, key) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_shards))

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs' documents too (those that it has already are left alone)."""
        new = cut(self._postings(docs).join(self.postings, ["key", "_id"], "left_anti"))
        sums = new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).withColumn("shard", self._shard("key"))

        # The filters first: keys that they do not know are new, only the others meet the exact table.
        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            keys = np.frombuffer(b"".join(left.column("key").to_pylist()), _D)
            known = np.zeros(len(keys), bool)
            f = CuckooFilter(len(keys))
            if right.num_rows:
                (f.table,) = unpack(right.column("filter")[0].as_py())
                f.n = len(f.table)
                known = f.contains(Shard.hashes(keys))
            return left.append_column("known", pa.array(known))

        probed = cut(sums.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "key binary, n long, first long, shard long, known boolean"))
        maybe = probed.where("known").drop("known")
        both = self.refs.join(maybe.select("key"), "key", "left_semi").select("shard", "key", "n", "first").unionByName(maybe.select("shard", "key", "n", "first"))
        met = both.groupBy("shard", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        refs = self.refs.join(maybe.select("key"), "key", "left_anti").select("shard", "key", "n", "first")
        refs = cut(refs.unionByName(met).unionByName(probed.where("not known").select("shard", "key", "n", "first")))
        # Only shards that got a key have a new filter.
        touched = probed.select("shard").distinct()
        filters = self.filters.join(touched, "shard", "left_anti").unionByName(self._filters(refs.join(touched, "shard", "left_semi")))
        return LineIndex(cut(self.postings.unionByName(new)), refs, cut(filters), self.n_shards)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id is in ids; a null there stands for the one without."""
        gone_ids = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id")).distinct()
        gone = cut(self.postings.join(gone_ids, "_id", "left_semi").select("key", "_id"))
        postings = cut(self.postings.join(gone_ids, "_id", "left_anti").select("key", "_id"))
        touched = gone.groupBy("key").agg(F.count(F.lit(1)).alias("less"))
        # A key may lose its smallest holder; the next one comes from the postings that are left.
        heirs = postings.join(touched.select("key"), "key", "left_semi").groupBy("key").agg(F.min("_id").alias("heir"))
        after = self.refs.join(touched, "key", "left").join(heirs, "key", "left")
        refs = cut(
            after.select("shard", "key", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), F.when(F.col("less").isNotNull(), F.col("heir")).otherwise(F.col("first")).alias("first"))
        )
        dead = refs.where("n = 0").select("shard", "key")

        def take_out(left: pa.Table, right: pa.Table) -> pa.Table:
            if right.num_rows and left.num_rows:
                f = CuckooFilter(1)
                (f.table,) = unpack(left.column("filter")[0].as_py())
                f.table = f.table.copy()
                f.n = len(f.table)
                f.delete(Shard.hashes(np.frombuffer(b"".join(right.column("key").to_pylist()), _D)))
                return pa.table([left.column("shard"), pa.array([pack(f.table)], pa.binary())], names=["shard", "filter"])
            return left.select(["shard", "filter"])

        filters = cut(self.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(take_out, "shard long, filter binary"))
        return LineIndex(postings, refs.where("n > 0"), filters, self.n_shards)

    def _filters(self, refs: DataFrame) -> DataFrame:
        def build(table: pa.Table) -> pa.Table:
            shard = Shard(1, refs=dict.fromkeys(table.column("key").to_pylist()))
            shard.rebuild()
            return pa.table([table.column("shard").slice(0, 1), pa.array([pack(shard.filter.table)], pa.binary())], names=["shard", "filter"])

        return refs.groupBy("shard").applyInArrow(build, "shard long, filter binary")

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs, which the index holds, with repeated lines cut, as `dedup_lines` does."""
        lost = self.postings.join(self.refs.where("n > 1").select("key", "first"), "key").where("_id > first").select("_id", "key")
        return _apply_drops(docs, lost)


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int, str]]:
    """The definition; for tests."""
    key = lambda x: (k if len(k := "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))) >= 10 else None)
    holders: dict[str, set[int]] = {}
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) is None or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
