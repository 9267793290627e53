"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte symbols. Every adjacent pair that
the vocabulary can merge waits in the bucket of its rank, by list position. A
two-level bitmap says which buckets hold anything: find-first-set on the top
level, then on the word below it, gives the lowest rank. An entry whose pair
has changed since is stale and skipped. A pre-token of n bytes so costs
O(n log n), however long it is.

Defined cases: a null text is the empty text and has no tokens; equal texts
have equal ids; lone surrogates can't occur (Spark strings are UTF-8). Extra
columns of the input are ignored, the results hold the id and what is named.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from hashlib import sha256
from struct import pack
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, spread, text_slices

#: Pre-tokens whose ids a worker keeps, about 210 bytes each, in two generations: when one is full the older one goes, but for what was met again. Results don't depend on it.
CACHE_ENTRIES = 300_000
#: As many where encoding is all that a worker does. They outlive a task, but not a query, so that the next task needn't merge them again.
LASTING_ENTRIES = 1_000_000
#: Pre-tokens merged together: their lists stay in a processor's cache.
MERGED = 1_500
#: Longer pre-tokens aren't kept.
CACHE_CHARS = 64
#: Bits in a word of the lower bitmap.
WORD_BITS = 256


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), by rank."""
    with open(path, "rb") as f:
        by_rank = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    return [by_rank[k] for k in range(len(by_rank))]


class RankQueue:
    """Buckets of list positions by rank, under a two-level bitmap of the buckets that hold any."""

    __slots__ = ("buckets", "top", "words")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket that wasn't there."""
        self.buckets[rank] = positions
        word, bit = divmod(rank, WORD_BITS)
        self.words[word] = self.words.get(word, 0) | 1 << bit
        self.top |= 1 << word

    def lowest(self) -> tuple[int, list[int]]:
        """Takes out the bucket of the lowest rank, its positions from left to right."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        self.words[word] = bits = bits ^ low
        if not bits:
            self.top ^= 1 << word
        rank = word * WORD_BITS + low.bit_length() - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Codec:
    """Encodes texts to packed little-endian 32-bit ids, and ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str, entries: int | None = None) -> None:
        self.tokens = tokens
        self.entries = entries or CACHE_ENTRIES
        self.ranks = {t: k for k, t in enumerate(tokens)}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = self._pairs()
        self.of_bytes = np.full((257, 257), -1, np.int64)  # ids of joined bytes; 256 stands between pre-tokens
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.of_bytes[token[0], token[1]] = rank
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.call = ""

    def _pairs(self) -> dict[int, int]:
        """left id << 32 | right id -> id of both joined, for all that may be merged."""
        ranks, out = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None:
                    right = ranks.get(token[cut:])
                    if right is not None:
                        out[left << 32 | right] = rank
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, which share one list and one queue.

        In each pre-token the pair of lowest rank is merged next, the leftmost
        of equals. Pre-tokens are apart by a symbol that no pair holds, so
        their order among each other doesn't matter.
        """
        if not pieces:
            return []
        pair, apart = self.pairs.get, len(self.tokens)
        ends = np.cumsum([len(p) for p in pieces])
        symbols = np.append(np.insert(np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), ends, 256), 256)
        ids = np.append(self.single, apart)[symbols].tolist()  # the last stands before the first, as ids[-1], and after the last
        n = len(ids) - 1
        after, before = list(range(1, n + 2)), list(range(-1, n))
        ranks = np.append(self.of_bytes[symbols[:-1], symbols[1:]], -1)
        rank_at = ranks.tolist()
        queue = RankQueue()
        waiting = queue.buckets.get
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        if len(places):
            first = np.concatenate([[0], np.flatnonzero(np.diff(ranks[places])) + 1, [len(places)]]).tolist()
            for i, j in zip(first, first[1:], strict=False):  # the buckets of the bytes' pairs
                queue.put(rank_at[places[i]], places[i:j].tolist())
        while queue.top:
            rank, positions = queue.lowest()
            base = rank << 32
            for k, at in enumerate(positions):
                if rank_at[at] != rank:
                    continue  # stale
                gone = after[at]
                right = after[gone]
                ids[at], ids[gone], rank_at[gone] = rank, -1, -1
                after[at], before[right] = right, at
                made = rank_at[at] = pair(base | ids[right], -1)
                if made >= 0:
                    if (bucket := waiting(made)) is None:
                        queue.put(made, [at])
                    else:
                        bucket.append(at)
                left = before[at]
                lower = pair(ids[left] << 32 | rank, -1)
                if rank_at[left] != lower:
                    rank_at[left] = lower
                    if lower >= 0:
                        if (bucket := waiting(lower)) is None:
                            queue.put(lower, [left])
                        else:
                            bucket.append(left)
                if 0 <= made < rank or 0 <= lower < rank:  # goes first
                    if k + 1 < len(positions):
                        queue.put(rank, positions[k + 1 :])
                    break
        flat = np.array(ids[:-1], np.int64)
        flat = flat[flat >= 0]
        packed, stops = flat.astype("<u4").tobytes(), (np.flatnonzero(flat == apart) * 4).tolist()
        return [packed[i:j] for i, j in zip([0, *(x + 4 for x in stops)], stops, strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.cache) > self.entries // 2:
            self.cache, self.older = {}, self.cache
        cache, older, ranks = self.cache, self.older, self.ranks
        cut = [self.find(t) for t in texts]
        here = {}
        for p in set().union(*cut).difference(cache):
            known = older.get(p)
            if known is None:
                here[p] = p.encode()
            else:
                cache[p] = known
        split = []
        for p, b in here.items():
            whole = ranks.get(b)
            if whole is None:
                split.append(p)
            else:
                cache[p] = pack("<I", whole)
        for i in range(0, len(split), MERGED):
            part = split[i : i + MERGED]
            cache.update(zip(part, self.merge([here[p] for p in part]), strict=True))
        cached = cache.__getitem__
        out = [b"".join(map(cached, pieces)) for pieces in cut]
        for p in here:
            if len(p) > CACHE_CHARS:
                del cache[p]
        return out

    def forget(self) -> None:
        """Empties the cache."""
        self.cache, self.older = {}, {}

    def begin(self, call: str) -> None:
        """Empties what another call left in the cache."""
        if call != self.call:
            self.forget()
            self.call = call

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_made: dict[tuple[int, str, int], Codec] = {}


def _worker_codec(shared, pattern: str, entries: int) -> Codec:
    """One codec for each worker process, vocabulary and size of its cache."""
    tokens = shared.value
    key = (crc32(b"\0".join(tokens)), pattern, entries)
    if key not in _made:
        _made.clear()
        _made[key] = Codec(tokens, pattern, entries)
    return _made[key]


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids binary): the ids of each whole text as little-endian unsigned 32-bit integers."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # as long as the vocabulary, not the data
    slim = spread(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_codec(shared, pattern, CACHE_ENTRIES)
        for b in batches:
            for i, j, texts in text_slices(b):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(codec.encode_all(texts), pa.binary())], ["id", "ids"])
        codec.forget()

    return slim.mapInArrow(lean(run), f"id {id_type}, ids binary").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, ranks_path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): the bytes that the ids stand for; null ids are no ids."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for b in batches:
            packed = b.column("ids")
            for i in range(0, b.num_rows, 256):
                part = packed.slice(i, 256)
                out = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, 256), part, pa.array(out, pa.binary())], ["id", "ids", "decoded"])

    return slim.mapInArrow(lean(run), f"id {id_type}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def token_digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id", lasting: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each document, encoded and decoded again in one worker.

    A `lasting` cache is larger and serves all tasks of a worker that belong to
    the same call, which takes up to 210 MB of each worker until it ends; the other
    one is emptied with the task.
    """
    entries, call = LASTING_ENTRIES if lasting else CACHE_ENTRIES, uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    slim = spread(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_codec(shared, pattern, entries)
        codec.begin(call)
        for b in batches:
            for i, j, texts in text_slices(b):
                ids = codec.encode_all(texts)
                digests = [[sha256(x).hexdigest() for x in ids], [sha256(codec.decode(x)).hexdigest() for x in ids]]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(d, pa.string()) for d in digests)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not lasting:
            codec.forget()  # a worker lives on for other stages

    return slim.mapInArrow(lean(run), f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
