"""Byte-level BPE encoding and decoding with a minimal acyclic transducer.

Texts are split into pretokens by the pattern that byte-level vocabularies use. The
corpus's frequent pretokens are compiled into a minimal acyclic transducer: words share
their beginnings and, as equal states are merged, their ends; each arc carries the number
of words that sort before it, and the sum along a word's path numbers its row of token
ids. The automaton is a file, of a size that the lexicon's bounds; Spark hands it to every
executor, also to those that come later, and the workers of an executor map it and share
its pages. Pretokens that it does not hold are merged exactly, pair by pair in
order of rank. What the lexicon holds changes speed and never results.

The counts that choose the lexicon cover all documents; it has at most LEXICON_WORDS
words, which bounds what the driver compiles.

Defined results for odd rows: a null text is empty and has no tokens; special tokens in a
text become their own ids, as in the tokenizers library; rows that repeat are encoded one
by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import mmap
import os
import re
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, checkpoint_dir, chunks, cut, pack, release, shuffle_partitions, unpack

#: Most words in the lexicon, and how often a word must occur to be in it.
LEXICON_WORDS = 60_000
MIN_COUNT = 8
#: Pretokens that a worker remembers.
CACHE = 300_000
#: Bytes of text whose words a bucket of counts holds on average, at most.
BUCKET_BYTES = 64 << 20
#: Stands for the rank of a pair that does not merge.
NO_RANK = 1 << 40


def _letters_and_numbers(top: int) -> tuple[str, str]:
    """Character classes of the Unicode letters and numbers below top, as ranges."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(top):
        if (k := unicodedata.category(chr(c))[0]) in found:
            if found[k] and found[k][-1][1] == c - 1:
                found[k][-1][1] = c
            else:
                found[k].append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found[k]) for k in "LN")


#: Unicode's white space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def pretoken_pattern(top: int = 0x110000) -> re.Pattern:
    """GPT-2's published pattern, in terms of explicit classes, for texts of characters below top."""
    letter, number = _letters_and_numbers(top)
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


class Splitter:
    """Splits texts into pretokens. Ranges of astral characters make matching slow, so texts without
    any are left to a pattern without them, which splits them alike."""

    def __init__(self):
        self.short, self.full = pretoken_pattern(0x10000).findall, None

    def __call__(self, text: str) -> list[str]:
        if len(text.encode("utf-16-le", "replace")) == 2 * len(text):
            return self.short(text)
        if self.full is None:
            self.full = pretoken_pattern().findall
        return self.full(text)


def byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Merges, token bytes and special tokens of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        back = {c: b for b, c in chars.items()}
        self.byte_id = [vocab[chars[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    def merge(self, word: bytes) -> list[int]:
        """The word's tokens: the pair of least rank is merged until none is left."""
        ids, merges = [self.byte_id[b] for b in word], self.merges
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = at = None
            for k in range(len(ids) - 1):
                m = merges.get((ids[k], ids[k + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word of at most 64 bytes, as packed uint32, all words at a time: in each
        round every word merges its pair of least rank."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64)):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            if not len(own):
                continue
            raw = b"".join(words[k].ljust(high, b"\0") for k in own.tolist())
            ids = np.array(self.byte_id, np.int64)[np.frombuffer(raw, np.uint8).reshape(-1, high)]
            n = lengths[own].copy()
            ranks, new = self._pairs(ids[:, :-1], ids[:, 1:])
            ranks[np.arange(high - 1) >= n[:, None] - 1] = NO_RANK
            live = np.arange(len(own))
            while len(live):
                r = ranks[live]
                at = r.argmin(axis=1)
                ok = r[np.arange(len(live)), at] < NO_RANK
                live, at = live[ok], at[ok]
                if not len(live):
                    break
                ids[live, at] = new[live, at]
                # What follows the merged pair moves up by one place.
                move = np.arange(high) > at[:, None]
                take = np.minimum(np.arange(high) + move, high - 1)
                ids[live] = np.take_along_axis(ids[live], take, axis=1)
                ranks[live] = np.take_along_axis(ranks[live], np.minimum(take[:, :-1], high - 2), axis=1)
                new[live] = np.take_along_axis(new[live], np.minimum(take[:, :-1], high - 2), axis=1)
                n[live] -= 1
                for side in (at - 1, at):  # the two pairs that the new token is in
                    fits = (side >= 0) & (side < n[live] - 1)
                    rows, cols = live[fits], side[fits]
                    ranks[rows, cols], new[rows, cols] = self._pairs(ids[rows, cols], ids[rows, cols + 1])
                ranks[live, n[live] - 1] = NO_RANK
            packed = ids.astype("<u4")
            for k, row, size in zip(own.tolist(), packed, n.tolist()):
                out[k] = row[:size].tobytes()
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged tokens of pairs, NO_RANK for those that do not merge."""
        if not hasattr(self, "_table"):
            size = 1 << 19
            keys, rank, token = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int64), np.zeros(size, np.int64)
            for (x, y), (r, t) in self.merges.items():
                key = x << 32 | y
                at = (key * 0x9E3779B97F4A7C15 % 2**64) >> 45
                while keys[at] >= 0:
                    at = (at + 1) % size
                keys[at], rank[at], token[at] = key, r, t
            self._table = keys, rank, token
        keys, rank, token = self._table
        key = (a << 32 | b).ravel()
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)
        left = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) % len(keys)
            left = left[(keys[at[left]] != key[left]) & (keys[at[left]] >= 0)]
        found = keys[at] == key
        return np.where(found, rank[at], NO_RANK).reshape(a.shape), token[at].reshape(a.shape)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        import heapq

        after, before = list(range(1, len(ids))) + [-1], [-1] + list(range(len(ids) - 1))
        heap = []

        def offer(k):
            if k >= 0 and (j := after[k]) >= 0 and (m := self.merges.get((ids[k], ids[j]))):
                heapq.heappush(heap, (m[0], k, m[1], ids[k], ids[j]))

        for k in range(len(ids) - 1):
            offer(k)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            after[j] = -1
            offer(before[k])
            offer(k)
        return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton over bytes, laid out in one buffer.

    Layout: six counts, then the arcs' keys (state and byte, in order), their targets and
    outputs, the rows' offsets and the token ids (all uint32), and the states' final flags.
    A word's number is the sum of its arcs' outputs: the words that sort before it."""

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        register: dict[tuple, int] = {}
        arcs: list[list[tuple[int, int]]] = []
        final: list[bool] = []
        below: list[int] = []  # words that a state accepts
        path: list[list] = [[False, []]]  # the states of the latest word, not yet merged: final, arcs

        def freeze(depth: int, word: bytes) -> None:
            """Merges what hangs below depth with an equal state, or keeps it as a new one."""
            while len(path) > depth + 1:
                ends, own = path.pop()
                key = (ends, tuple(own))
                if (state := register.get(key)) is None:
                    state = register[key] = len(arcs)
                    arcs.append(own)
                    final.append(ends)
                    below.append(ends + sum(below[t] for _, t in own))
                path[-1][1].append((word[len(path) - 1], state))

        latest, ordered = b"", sorted(words)
        for word in ordered:
            shared = len(os.path.commonprefix([latest, word]))
            freeze(shared, latest)
            path += [[False, []] for _ in range(len(word) - shared)]
            path[-1][0] = True
            latest = word
        freeze(0, latest)
        root = len(arcs)
        arcs.append(path[0][1])
        final.append(path[0][0])
        first, targets, outputs, keys = [0], [], [], []
        for s, own in enumerate(arcs):
            passed = int(final[s])
            for b, t in own:
                keys.append(s << 8 | b)
                targets.append(t)
                outputs.append(passed)
                passed += below[t]
            first.append(len(targets))
        rows = np.cumsum([0, *(len(words[w]) for w in ordered)])
        ids = [i for w in ordered for i in words[w]]
        head = struct.pack("<6I", root, len(arcs), len(targets), len(ordered), len(ids), 0)
        numbers = np.array([*keys, *targets, *outputs, *rows.tolist(), *ids], "<u4").tobytes()
        return head + numbers + bytes(map(int, final))

    def __init__(self, data):
        """data is a buffer: nothing of it is copied, so workers that map one file share its pages."""
        self.root, self.n_states, n_arcs, self.n_words, n_ids, _ = struct.unpack_from("<6I", data)
        at, parts = 24, []
        for n in (n_arcs, n_arcs, n_arcs, self.n_words + 1, n_ids):
            parts.append(np.frombuffer(data, "<u4", n, at))
            at += 4 * n
        self.keys, self.targets, self.outputs, self.rows, self.ids = parts
        self.final = np.frombuffer(data, np.uint8, self.n_states, at)

    @classmethod
    def open(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among all words, or -1; all words a byte further at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts, text = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words) + b"\0", np.uint8)
        out, state = np.zeros(len(words), np.int64), np.full(len(words), self.root, np.int64)
        alive, depth = np.arange(len(words)), 0
        while len(alive) and len(self.keys):
            alive = alive[lengths[alive] > depth]
            key = (state[alive] << 8 | text[starts[alive] + depth]).astype(np.uint32)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            state[alive[~found]] = -1
            alive, arc = alive[found], arc[found]
            out[alive] += self.outputs[arc]
            state[alive] = self.targets[arc]
            depth += 1
        if not len(self.keys):
            state[lengths > 0] = -1
        return np.where((state >= 0) & (self.final[state] > 0), out, -1)

    def lookup(self, word: bytes) -> list[int] | None:
        n = int(self.numbers([word])[0])
        return None if n < 0 else self.ids[self.rows[n] : self.rows[n + 1]].tolist()


class _Words(dict):
    """pretoken -> its ids as little-endian uint32 bytes, filled as asked for."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        ids = self.lexicon.lookup(raw) if self.lexicon else None
        if ids is None:
            ids = self.vocabulary.merge(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[str]) -> None:
        """Gets ready for words: from the lexicon, or by merging, many at a time."""
        names = [w for w in words if w not in self]
        if len(self) + len(names) > CACHE:
            self.clear()
            names = list(words)
        raw = [w.encode("utf-8", "replace") for w in names]
        short = [k for k, x in enumerate(raw) if len(x) <= 64]
        names, raw = [names[k] for k in short], [raw[k] for k in short]
        if not names:
            return
        rest = range(len(names))
        if self.lexicon:
            n, ids = self.lexicon.numbers(raw), self.lexicon.ids
            known = np.flatnonzero(n >= 0)
            at, end = self.lexicon.rows[n[known]].tolist(), self.lexicon.rows[n[known] + 1].tolist()
            for k, a, b in zip(known.tolist(), at, end):
                self[names[k]] = ids[a:b].tobytes()
            rest = np.flatnonzero(n < 0).tolist()
        for k, packed in zip(rest, self.vocabulary.merge_many([raw[k] for k in rest])):
            self[names[k]] = packed


class Codec:
    """Encodes texts and decodes ids."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None = None):
        self.vocabulary = vocabulary
        self.words = _Words(vocabulary, lexicon)
        self.find = Splitter()
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def pretokens(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Pretokens up to each special token, with that token's id."""
        if self.special is None or not self.special.search(text):
            yield self.find(text), None
            return
        for k, part in enumerate(self.special.split(text)):
            yield (([], self.vocabulary.special[part]) if k % 2 else (self.find(part), None))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [list(self.pretokens(t)) for t in texts]
        self.words.learn({w for parts in split for words, _ in parts for w in words})
        get, out = self.words.__getitem__, []
        for parts in split:
            packed = [x for words, special in parts for x in (b"".join(map(get, words)), b"" if special is None else struct.pack("<I", special))]
            out.append(np.frombuffer(b"".join(packed), "<u4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _texts(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, special: Iterable[str] = ()) -> DataFrame:
    """(word, n): pretokens that occur MIN_COUNT times or more in docs."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first().b or 0
    n_buckets = max(4 * shuffle_partitions(docs.sparkSession), math.ceil(size / BUCKET_BYTES))
    special = tuple(special)

    def count(batches):
        find = Splitter()
        stop = re.compile("|".join(map(re.escape, special))) if special else None
        for table in chunks(batches, 4 << 20):
            counts: Counter = Counter()
            for t in table.column("text").to_pylist():
                for part in stop.split(t) if stop else (t,):
                    counts.update(find(part))
            dealt: dict[int, tuple[list[bytes], list[int]]] = {}
            for w, c in counts.items():
                if len(raw := w.encode("utf-8", "replace")) <= 64:  # longer ones are not words
                    own = dealt.setdefault(zlib.crc32(raw) % n_buckets, ([], []))
                    own[0].append(raw)
                    own[1].append(c)
            out = [(b, pack(b"\xff".join(w), np.array(c, np.int32))) for b, (w, c) in dealt.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "bundle"])

    def total(table: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for bundle in table.column("bundle"):
            words, n = unpack(bundle.as_py())
            for w, c in zip(words.split(b"\xff"), n.tolist()):
                counts[w] = counts.get(w, 0) + c
        often = [(w, c) for w, c in counts.items() if c >= MIN_COUNT]
        del counts
        release()
        return pa.table([pa.array([w for w, _ in often], pa.binary()), pa.array([c for _, c in often], pa.int64())], names=["word", "n"])

    return _texts(docs).mapInArrow(count, "bucket long, bundle binary").groupBy("bucket").applyInArrow(total, "word binary, n long")


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary) -> bytes:
    """The transducer of the most frequent words of docs, LEXICON_WORDS at most."""
    counts = cut(word_counts(docs, vocabulary.special))
    # A few dozen rows: how many words have counts of each order of magnitude (in quarters of octaves).
    order = F.floor(F.log2("n") * 4).cast("int")
    bins = sorted(counts.groupBy(order.alias("k")).count().collect(), key=lambda r: -r.k)
    total, least = 0, None
    for r in bins:
        if total + r["count"] > LEXICON_WORDS:
            break
        total, least = total + r["count"], r.k
    words = [] if least is None else [bytes(r.word) for r in counts.where(order >= least).select("word").collect()]
    return Transducer.compile({w: vocabulary.merge(w) for w in words})


def _shared_file(spark: SparkSession, data: bytes) -> str:
    """Writes data to the shared folder, has Spark give it to the executors, and returns its name there."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode_corpus(docs: DataFrame, vocabulary_path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns in keep, with ids (array of int) and decoded (the text that they decode to)."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(vocabulary_path or default_vocabulary())
    held = spark.sparkContext.broadcast(vocabulary)
    lexicon = _shared_file(spark, build_lexicon(docs, vocabulary))
    rows = bounded_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_keep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))

    def run(batches):
        codec = Codec(held.value, Transducer.open(SparkFiles.get(lexicon)))
        for table in chunks(batches, 2 << 20, "_text"):
            ids = codec.encode_batch(table.column("_text").to_pylist())
            decoded = [codec.decode(x.tolist()) for x in ids]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([table.column("_keep").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], names=["_keep", "ids", "decoded"])

    from pyspark.sql import types as T

    kind = T.StructType([rows.schema["_keep"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    out = rows.mapInArrow(run, kind)
    return out.select(*(F.col(f"_keep.`{c}`").alias(c) for c in keep), "ids", "decoded")


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over documents."""
    out = encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def brute_force(texts: dict[int, str | None], path: str | None = None) -> dict[int, tuple[int, str, str]]:
    """The tokenizers library's own answer; for tests."""
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(path or default_vocabulary()), {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, x in texts.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        out[i] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    return out
