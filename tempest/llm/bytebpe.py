"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token:
one hash, one displacement, one comparison.  Second tier: other pre-tokens are merged from bytes; the
parts form a linked list and the pairs that the vocabulary knows wait in a heap by rank, so a
pre-token of n bytes costs n log n, also one of a whole very long text.

The tables are built once on the driver from the rank file and broadcast; their size is that of the
vocabulary.  A task keeps the results of recent pre-tokens in a table of bounded size.

Defined results: null text is empty and has no tokens; special tokens do not exist (their strings
are ordinary text); rows that repeat stay rows of their own; an empty table gives an empty result;
``encode`` keeps all columns of the input and adds ``OUTPUT``, replacing columns of that name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.llm.batches import run_batches, slices
from tempest.llm.text import whole
from tempest.session import run_folder

OUTPUT = "token_ids"
_CACHE = 1 << 19
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_MULT = 0xBF58476D1CE4E5B9


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    if b"" in tokens:
        raise ValueError("ranks are not 0 to n - 1")
    return tokens


# ------------------------------------------------------------------ first tier

def _hash(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & _MASK


def _slot(h: int, displacement: int, n: int) -> int:
    x = ((h ^ (displacement * _STEP)) * _MULT) & _MASK
    return (x ^ (x >> 31)) % n


class PerfectHash:
    """Minimal perfect hash: n keys to the slots 0 to n - 1.

    Keys fall into buckets; a bucket's displacement sends all its keys to slots of their own, found by
    trial from the largest bucket to the smallest; a bucket of one key names its slot outright.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, -(-n // per_bucket))
        members: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            high, low = _hash(k)
            members[low % self.buckets].append((high, i))
        #: displacement, or -1 - slot
        self.shift = np.zeros(self.buckets, np.int64)
        self.value = np.zeros(n, np.int64)
        free = bytearray(b"\x01") * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for b in (b for b in order if len(members[b]) > 1):
            d = 0
            while True:
                slots = [_slot(h, d, n) for h, _ in members[b]]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, members[b], strict=True):
                free[s] = 0
                self.value[s] = i
        left = (s for s in range(n) if free[s])
        for b in (b for b in order if len(members[b]) == 1):
            s = next(left)
            self.shift[b], self.value[s] = -1 - s, members[b][0][1]

    def candidate(self, key: bytes) -> int:
        """The only key, by its number, that ``key`` can be."""
        high, low = _hash(key)
        d = int(self.shift[low % self.buckets])
        return int(self.value[-1 - d if d < 0 else _slot(high, d, self.n)])


# ------------------------------------------------------------------ both tiers

class _Known(dict):
    """Pre-token to its ids, found when first asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self[text] = self.find(text)
        return ids


class Codec:
    """Encoder and decoder over the broadcast tables."""

    def __init__(self, tokens: list[bytes], perfect: PerfectHash, pattern: str):
        import regex

        self.tokens, self.perfect = tokens, perfect
        self.find = regex.compile(pattern).findall
        self.byte = [0] * 256
        number = {t: i for i, t in enumerate(tokens)}
        for t, i in number.items():
            if len(t) == 1:
                self.byte[t[0]] = i
        # a pair of tokens to the token that it merges to
        self.merged = {}
        for t, i in number.items():
            for cut in range(1, len(t)):
                left, right = number.get(t[:cut]), number.get(t[cut:])
                if left is not None and right is not None:
                    self.merged[left << 32 | right] = i
        self.known = _Known(self.pre_token)

    def pre_token(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        i = self.perfect.candidate(data)
        return (i,) if self.tokens[i] == data else self.merge(data)

    def merge(self, data: bytes) -> tuple[int, ...]:
        get = self.merged.get
        part = [self.byte[b] for b in data]
        n = len(part)
        # what each part merges to with the next one, -1: nothing; tells entries of earlier states
        pair = [get(a << 32 | b, -1) for a, b in zip(part, part[1:], strict=False)]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pair.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            part[i], part[j], pair[j] = rank, -1, -1
            if k < n:
                before[k] = i
                r = pair[i] = get(rank << 32 | part[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = get(part[h] << 32 | rank, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | h)
        return tuple([p for p in part if p >= 0])

    def encode(self, text: str) -> list[int]:
        if len(self.known) > _CACHE:
            self.known.clear()
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LIVE: dict[str, object] = {}


def _codec(tables: tuple) -> Codec:
    """The worker's codec: tasks that follow each other in a worker share what it knows."""
    if _LIVE.get("tables") is not tables:
        _LIVE.update(tables=tables, codec=Codec(*tables))
    return _LIVE["codec"]


def tables(df: DataFrame, ranks_path: str, pattern: str):
    """The broadcast tokens, perfect hash and pattern."""
    tokens = read_ranks(ranks_path)
    return df.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with ``OUTPUT``, the ids of the whole text."""
    held = tables(docs, ranks_path, pattern)
    kept = [c for c in docs.columns if c != OUTPUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for b in slices(batches):
            ids = [codec.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(ids, pa.list_(pa.int32()))], [*kept, OUTPUT])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(OUTPUT, T.ArrayType(T.IntegerType()))])
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = [b"".join(map(tokens.value.__getitem__, ids or ())) for ids in b.column(OUTPUT).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(data, pa.binary())], [*kept, "decoded"])

    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("decoded", T.BinaryType())])
    return encoded.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, folder: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded bytes stay in the task."""
    held = tables(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        digits = [str(i) for i in range(len(codec.tokens))]
        for b in batches:
            n, a, c = [], [], []
            for t in b.column("text").to_pylist():
                ids = codec.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                c.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return run_batches(rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"),
                       folder or run_folder(docs.sparkSession, "bpe"), "round-trip")
