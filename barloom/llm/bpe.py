"""Byte-level BPE encoding and decoding.

A piece of text is merged with a segment tree over its byte positions. A leaf holds the rank of the pair that starts there (none: a large
number), inner nodes the least ``rank * width + position`` below them, so the root is the leftmost pair of least rank. A merge changes three
leaves - the merged position, the position it swallowed and the live neighbour before it - and refreshes only their ancestors.

Pieces up to ``WIDE`` bytes are merged many at a time, one NumPy row each; longer ones use one tree of Python integers. Both are O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = 1 << 60  #: no pair
WIDE = 64  #: bytes of the longest piece that is merged in a batch
MOST_FILE = 64 << 20  #: a rank file above this size is not sent to executors
MOST_CACHED = 500_000  #: pieces that a worker remembers; the cache only spares work
CHARS = 1 << 20  #: characters split at a time


class Ranks:
    """Tables of one rank file, for lookups in batches and one by one."""

    def __init__(self, raw: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte < 0).any():
            raise ValueError("the rank file lacks single bytes")
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.values = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], NONE)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """Tree of Python integers for one long piece."""
        n, pairs = len(piece), self.pairs
        width = 1 << max(1, (n - 1).bit_length())
        big = NONE * width
        live = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [big] * (2 * width)
        for i in range(n - 1):
            r = pairs.get(live[i] << 32 | live[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, r: int | None) -> None:
            node = width + i
            tree[node] = big if r is None else r * width + i
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < big:
            r, i = divmod(tree[1], width)
            gone = after[i]
            j, h = after[gone], before[i]
            live[i], live[gone], after[i] = r, -1, j
            put(gone, None)
            if j < n:
                before[j] = i
                put(i, pairs.get(r << 32 | live[j]))
            else:
                put(i, None)
            if h >= 0:
                put(h, pairs.get(live[h] << 32 | r))
        return [x for x in live if x >= 0]

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """One tree per row of an array, for pieces of at most ``width`` bytes; returns packed ids."""
        n, levels = len(pieces), width.bit_length() - 1
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        cols = np.arange(width)
        live = np.where(cols < sizes[:, None], self.byte[raw], -1)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        big = NONE
        tree = np.full((n, 2 * width), big, dtype=np.int64)
        have = cols[:-1] + 1 < sizes[:, None]
        first = np.full((n, width - 1), NONE, dtype=np.int64)
        first[have] = self.pair_ranks(live[:, :-1][have], live[:, 1:][have])
        tree[:, width:-1] = np.where(first < NONE, first * width + cols[:-1], big)
        for lv in range(levels - 1, -1, -1):
            at = 1 << lv
            tree[:, at:2 * at] = np.minimum(tree[:, 2 * at:4 * at:2], tree[:, 2 * at + 1:4 * at:2])

        def put(rows: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
            node = width + at
            tree[rows, node] = np.where(ranks < NONE, ranks * width + at, big)
            for _ in range(levels):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < big)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            nxt, prev = after[rows, gone], before[rows, at]
            live[rows, at] = rank
            live[rows, gone] = -1
            after[rows, at] = nxt
            put(rows, gone, np.full(len(rows), NONE))
            inside = nxt < sizes[rows]
            r, a, b = rows[inside], at[inside], nxt[inside]
            before[r, b] = a
            put(r, a, self.pair_ranks(rank[inside], live[r, b]))
            put(rows[~inside], at[~inside], np.full(int((~inside).sum()), NONE))
            held = prev >= 0
            r, h = rows[held], prev[held]
            put(r, h, self.pair_ranks(live[r, h], rank[held]))
            rows = rows[tree[rows, 1] < big]
        keep = live >= 0
        packed, ends = live[keep].astype("<u4").tobytes(), (4 * keep.sum(axis=1)).cumsum().tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed ids (little-endian, 32 bits) of each distinct piece."""
        out, groups = {}, {}
        for text in pieces:
            raw = text.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                out[text] = whole.to_bytes(4, "little")
            elif len(raw) > WIDE:
                out[text] = np.array(self.merge_one(raw), dtype="<u4").tobytes()
            else:
                groups.setdefault(1 << (len(raw) - 1).bit_length(), []).append((text, raw))
        for width, rows in groups.items():
            for at in range(0, len(rows), 8192):
                some = rows[at:at + 8192]
                out.update(zip((t for t, _ in some), self.merge_many([r for _, r in some], width)))
        return out


class Coder(dict):
    """Remembers pieces; one per worker process and rank file."""

    def __init__(self, raw: bytes, pattern: str):
        super().__init__()
        self.ranks, self.split = Ranks(raw), regex.compile(pattern).findall

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > MOST_CACHED:
            self.clear()
        pieces = [self.split(t) for t in texts]
        new = set().union(*pieces).difference(self.keys())
        self.update(self.ranks.merge(new))
        return [b"".join(map(self.__getitem__, p)) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_coders: dict[str, Coder] = {}


def coder(raw: bytes, pattern: str) -> Coder:
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _coders:
        _coders[key] = Coder(raw, pattern)
    return _coders[key]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def rank_file(path: str) -> bytes:
    """The rank file, read on the driver; its size is checked before it goes to executors."""
    with open(path, "rb") as f:
        raw = f.read(MOST_FILE + 1)
    if len(raw) > MOST_FILE:
        raise ValueError(f"rank file above {MOST_FILE} bytes")
    return raw


def encode(docs: DataFrame, raw: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids of each whole text as packed little-endian 32-bit integers, every match of ``pattern`` merged on its own.

    A null text counts as empty and gives empty ids; null and repeated keys keep their rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value, pattern)
        for b in batches:
            at = 0
            for some in _groups([t or "" for t in b.column(1).to_pylist()]):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(c.encode(some), pa.binary())], names=["key", "ids"])
                at += len(some)

    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"key {src.schema[0].dataType.simpleString()}, ids binary").select(F.col("key").alias(key), "ids")


def decode(encoded: DataFrame, raw: bytes, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): bytes of packed ids. Null ids count as empty; an id outside the rank file is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value, pattern)
        for b in batches:
            packed = [x or b"" for x in b.column(1).to_pylist()]
            for at in range(0, len(packed), 256):
                some = packed[at:at + 256]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), b.column(1).slice(at, len(some)), pa.array(map(c.decode, some), pa.binary())],
                                                 names=["key", "ids", "decoded"])

    src = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return src.mapInArrow(run, f"key {src.schema[0].dataType.simpleString()}, ids binary, decoded binary").withColumnRenamed("key", key)


def n_tokens(ids: Column | str) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
