"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

Tokens of both sides are cut points on one byte axis: their ends. All texts of a batch lie one after another on that axis, so a batch is one merge
of two sorted lists of ends. Binary searches on evenly spaced diagonals of the merge grid divide it into pieces of equal work that need only their
own ends and one neighbour, however long a single text is. A piece emits the overlaps that end in it (each end of the union closes exactly one) and
the places where both sides end; tokens between two such places are a group, and groups that straddle pieces are stitched from those places.

Links are counted for (text, id pair) inside the batch and packed in the order of a hash of the pair, a bijection of 32 bits. Corpus-wide counts are
a grouped sum; to return them to the texts, every batch is cut into hash ranges that meet their range of the count table, as packed slices in
groups of bounded size, and hands back one sum a text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.common import shelved

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core

MOST_FILE = 64 << 20  #: bytes of a tokenizer file that may be sent to executors
CHARS = 1 << 21  #: characters of a batch; a longer text is a batch of its own
ENCODE = 1 << 18  #: characters given to an encoder at once
PIECE = 1 << 16  #: ends merged by one piece
SHARD_PAIRS = 1 << 17  #: id pairs of one range of the count table
GROUP_ENTRIES = 1 << 22  #: (text, pair) entries that meet a range in one task
ODD = 0x9E3779B1  #: multiplier of the pair hash; odd, so it has an inverse
MOST_PIECES = 200_000  #: pieces that a worker remembers; the cache only spares work
# Fixed value: the split of byte-level BPE.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
ODDITIES = re.compile(r"[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")  #: beyond printable ASCII and the letters of Latin-1
RESULT = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def file_bytes(path: str) -> bytes:
    """A tokenizer file, read on the driver; its size is checked before it goes to executors."""
    with open(path, "rb") as f:
        raw = f.read(MOST_FILE + 1)
    if len(raw) > MOST_FILE:
        raise ValueError(f"tokenizer file above {MOST_FILE} bytes")
    return raw


class Side:
    """One tokenizer: ids of texts, and the bytes, lengths and printed ids of its tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        if not self.lengths.all():
            raise ValueError("a token without bytes")
        self.printed = np.array([f"{i}{mark}" for mark in ",|;" for i in range(len(tokens))], dtype=object)

    def joined(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def gives(self, ids: np.ndarray, known: bool, whole: bytes) -> bool:
        """Whether the bytes of the tokens are the whole text."""
        return known or (int(self.lengths[ids].sum()) == len(whole) and self.joined(ids.tolist()) == whole)


class ByteLevel(Side):
    """A byte-level BPE of the tokenizers library; gets space + text."""

    def __init__(self, raw: bytes):
        self.coder = Tokenizer.from_str(raw.decode())
        self.coder.encode_special_tokens = True
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]  # bytes shown as themselves; others follow from 256 on
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        tokens = [b"?"] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            tokens[i] = bytes(shown[c] for c in piece) if all(c in shown for c in piece) else piece.encode()
        super().__init__(tokens)
        rules = json.loads(raw)
        split = rules.get("pre_tokenizer") or {}
        self.by_piece = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.pieces: dict[str, bytes] = {}  # packed ids
        self.changed: set[str] = set()  # pieces whose tokens do not give their bytes

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether their bytes are known to be space + text.

        Where the file splits by the byte-level pattern, a text of characters that every Unicode version classes alike is split here, and the library
        encodes each distinct piece once; all other texts go to the library as they are.
        """
        plain = [self.by_piece and ODDITIES.search(t) is None for t in texts]
        rest = iter(self.coder.encode_batch_fast([" " + t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        cut = [PIECES(" " + t) if p else None for t, p in zip(texts, plain)]
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        new = list(set().union(*(ws for ws in cut if ws)).difference(self.pieces))
        for w, e in zip(new, self.coder.encode_batch_fast(new, add_special_tokens=False)):
            self.pieces[w] = np.array(e.ids, dtype="<i4").tobytes()
            if self.joined(e.ids) != w.encode():
                self.changed.add(w)
        return [(np.frombuffer(b"".join(map(self.pieces.__getitem__, ws)), "<i4").astype(np.int64), self.changed.isdisjoint(ws) if self.changed else True) if ws is not None
                else (np.array(next(rest).ids, dtype=np.int64), False) for ws in cut]


class Pieces(Side):
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, raw: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.vocab_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        return [(np.array(ids, dtype=np.int64), False) for ids in self.coder.encode(texts, num_threads=1)]


_sides: dict[str, Side] = {}


def side(kind: type[Side], raw: bytes) -> Side:
    """One tokenizer per worker process and file."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _sides:
        _sides[key] = kind(raw)
    return _sides[key]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where the merge of two sorted lists crosses every ``piece``-th diagonal, its start and end included; equal values of ``a`` first."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        take = (low < high) & (a[np.minimum(mid, len(a) - 1)] <= b[np.maximum(d - mid - 1, 0)]) if len(a) and len(b) else low < low
        low, high = np.where(take, mid + 1, low), np.where(take | (low >= high), high, mid)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece: (token of a, token of b) of each overlap that ends in it, and (i, j) of its common ends.

    An end of both sides is emitted with the token of ``b``, whose piece looks back at one end of ``a``; an end of ``a`` alone looks ahead at one of ``b``.
    """
    i, j = np.arange(i0, i1), np.arange(j0, j1)
    over = j0 + np.searchsorted(b[j0:j1], a[i0:i1], side="left")  # token of b that lies over the end of a
    alone = (over >= len(b)) | (b[np.minimum(over, len(b) - 1)] != a[i0:i1]) if len(b) else np.ones(len(i), dtype=bool)
    under = i0 + np.searchsorted(a[i0:i1], b[j0:j1], side="right")  # ends of a at or before that of b
    both = (under > 0) & (a[np.maximum(under - 1, 0)] == b[j0:j1]) if len(a) else np.zeros(len(j), dtype=bool)
    return np.concatenate([i[alone], under - both]), np.concatenate([over[alone], j]), under[both] - 1, j[both]


def aligned(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``overlaps`` of every piece of the merge."""
    i, j = diagonals(a, b, piece)
    for p in range(len(i) - 1):
        yield overlaps(a, b, int(i[p]), int(i[p + 1]), int(j[p]), int(j[p + 1]))


def printed(a: Side, b: Side, ia: np.ndarray, ib: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``; ``ga``, ``gb``: number of the last token of each group on either side."""
    mark_a, mark_b = np.zeros(len(ia), dtype=np.int64), np.zeros(len(ib), dtype=np.int64)
    mark_a[ga], mark_b[gb] = 1, 2
    starts_a = np.concatenate([[0], ga[:-1] + 1])
    starts_b = np.concatenate([[0], gb[:-1] + 1])
    size_a, size_b = ga + 1 - starts_a, gb + 1 - starts_b
    place_a = np.arange(len(ia)) + np.repeat(starts_b, size_a)  # every group's tokens of a come before its tokens of b
    place_b = np.arange(len(ib)) + np.repeat(ga + 1, size_b)
    out = np.empty(len(ia) + len(ib), dtype=object)
    out[place_a] = a.printed[mark_a * len(a.tokens) + ia]
    out[place_b] = b.printed[mark_b * len(b.tokens) + ib]
    return "".join(out.tolist())[:-1]


def _batches(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    some, size, at = [], 0, 0
    for n, t in enumerate(texts):
        if some and size + len(t) > most:
            yield at, some
            some, size, at = [], 0, n
        some.append(t)
        size += len(t)
    if some:
        yield at, some


def align_texts(texts: list[str], a: Side, b: Side, piece: int = PIECE) -> tuple[list[dict], dict[str, np.ndarray]]:
    """Results per text, and their links: distinct hashes ``pair`` in order, ``runs`` of entries of each, and of each entry its ``text`` and ``n``."""
    kept, ids = [], ([], [])
    for at, some in _batches(texts, ENCODE):
        for n, (t, x, y) in enumerate(zip(some, a.encode(some), b.encode(some)), at):
            whole = b" " + t.encode()
            if t and a.gives(*x, whole) and b.gives(*y, whole):
                kept.append(n)
                ids[0].append(x[0])
                ids[1].append(y[0])
    results = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""} for _ in texts]
    if not kept:
        none = np.zeros(0, dtype="<u4")
        return results, {"pair": none, "runs": none, "text": none, "n": none}
    ia, ib = np.concatenate(ids[0]), np.concatenate(ids[1])
    last_a, last_b = np.cumsum([len(x) for x in ids[0]]), np.cumsum([len(x) for x in ids[1]])
    keys, ends_a, ends_b = [], [], []
    links = np.zeros(len(kept), dtype=np.int64)
    for x, y, ca, cb in aligned(np.cumsum(a.lengths[ia]), np.cumsum(b.lengths[ib]), piece):
        text = np.searchsorted(last_b, y, side="right")
        links += np.bincount(text, minlength=len(kept))
        pair = (ia[x] * len(b.tokens) + ib[y]).astype(np.uint64) * np.uint64(ODD) & np.uint64(0xFFFFFFFF)
        keys.append(np.unique(pair << np.uint64(32) | text.astype(np.uint64), return_counts=True))
        ends_a.append(ca)
        ends_b.append(cb)
    ends_a, ends_b = np.concatenate(ends_a), np.concatenate(ends_b)
    group_last = np.searchsorted(ends_a, last_a - 1, side="left") + 1  # each text ends with a common end
    starts = zip([0, *last_a[:-1]], last_a, [0, *last_b[:-1]], last_b, [0, *group_last[:-1]], group_last)
    for k, (a0, a1, b0, b1, g0, g1) in enumerate(starts):
        shown = printed(a, b, ia[a0:a1], ib[b0:b1], ends_a[g0:g1] - a0, ends_b[g0:g1] - b0)
        results[kept[k]] = {"n_a": int(a1 - a0), "n_b": int(b1 - b0), "n_groups": int(g1 - g0), "n_links": int(links[k]), "groups_sha256": hashlib.sha256(shown.encode()).hexdigest()}
    every, counts = np.concatenate([k for k, _ in keys]), np.concatenate([c for _, c in keys])
    key, where = np.unique(every, return_inverse=True)
    n = np.zeros(len(key), dtype=np.int64)
    np.add.at(n, where, counts)
    pair, first, runs = np.unique(key >> np.uint64(32), return_index=True, return_counts=True)
    text = np.array(kept)[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return results, {"pair": pair.astype("<u4"), "runs": runs.astype("<u4"), "text": text.astype("<u4"), "n": n.astype("<u4")}


def align(docs: DataFrame, raw_a: bytes, raw_b: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch, docs, pair, runs, text, n): aligned batches. ``docs`` holds (key, n_a, n_b, n_groups, n_links, groups_sha256) of each text in order.

    A null or empty text, and one whose joined tokens of either side differ from space + text, has no tokens. Null and repeated keys keep their
    rows; other columns are not read; an empty table gives no batches. The product of the vocabularies must stay below 2**32.
    """
    spark = docs.sparkSession
    sides = spark.sparkContext.broadcast((raw_a, raw_b))
    if side(ByteLevel, raw_a).lengths.size * side(Pieces, raw_b).lengths.size >= 1 << 32:
        raise ValueError("too many id pairs")
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = src.schema[0].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(ByteLevel, sides.value[0]), side(Pieces, sides.value[1])
        number = TaskContext.get().partitionId() << 32
        for r in rows:
            keys = r.column(0)
            for at, some in _batches(r.column(1).to_pylist(), CHARS):
                results, links = align_texts(some, a, b)
                table = pa.Table.from_pylist(results, schema=RESULT)
                each = pa.StructArray.from_arrays([keys.slice(at, len(some)), *(c.combine_chunks() for c in table.columns)], names=["key", *table.column_names])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), each),
                                                  *(pa.array([v.tobytes()], pa.binary()) for v in links.values())], names=["batch", "docs", *links])
                number += 1

    each = f"struct<key: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>"
    return src.mapInArrow(run, f"batch long, docs array<{each}>, pair binary, runs binary, text binary, n binary")


def pair_counts(batches: DataFrame, width: int) -> DataFrame:
    """(pair, b, n, entries): links and (text, pair) entries of each hashed id pair over all batches; ``width``: ids of side b."""
    back = pow(ODD, -1, 1 << 32)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for pair, runs, n in zip(*(r.column(c).to_pylist() for c in ("pair", "runs", "n"))):
                pair, runs, n = np.frombuffer(pair, "<u4").astype(np.uint64), np.frombuffer(runs, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(np.int64)
                if len(pair):
                    total = np.add.reduceat(n, np.concatenate([[0], np.cumsum(runs)[:-1]]))
                    b = (pair * np.uint64(back) & np.uint64(0xFFFFFFFF)) % np.uint64(width)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pair.astype(np.int64), b.astype(np.int64), total, runs)], names=["pair", "b", "n", "entries"])

    got = batches.select("pair", "runs", "n").mapInArrow(run, "pair long, b long, n long, entries long")
    return got.groupBy("pair", "b").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries"))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pair")
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "pairs": [pdf["pair"].to_numpy("<i8").tobytes()], "counts": [pdf["n"].to_numpy("<i8").tobytes()], "best": [pdf["best"].to_numpy("<i8").tobytes()]})


def _meet(slices: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """Sums of one range for the texts of each slice."""
    out = []
    if len(slices):
        pairs, counts, best = (np.frombuffer(table[c].iloc[0], "<i8") for c in ("pairs", "counts", "best"))
        for r in slices.itertuples():
            at = np.repeat(np.searchsorted(pairs, np.frombuffer(r.pair, "<u4").astype(np.int64)), np.frombuffer(r.runs, "<u4"))
            n = np.frombuffer(r.n, "<u4").astype(np.int64)
            text, where = np.unique(np.frombuffer(r.text, "<u4"), return_inverse=True)
            sums = np.zeros((2, len(text)), dtype=np.int64)
            np.add.at(sums[0], where, n * best[at])
            np.add.at(sums[1], where, n * counts[at])
            out.append((r.batch, text.tobytes(), sums.tobytes()))
    return pd.DataFrame(out, columns=["batch", "text", "sums"])


def link_counts(batches: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text of stored ``align`` batches; ``width``: ids of side b.

    An id pair's count is the number of links that hold it in all texts. ``n_best``: links whose count is the highest of their b id, ties included;
    ``count_sum``: sum of counts over links. Repeated rows all count.
    """
    counts = shelved(pair_counts(batches, width), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row an id of side b at most: the vocabulary bounds what is broadcast
    total = counts.count()
    bits = max(0, (max(1, total) // SHARD_PAIRS).bit_length())
    shard = F.shiftrightunsigned(F.col("pair"), 32 - bits).cast("int")
    known = counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"), shard.alias("shard"))
    dealt = counts.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("entries") / GROUP_ENTRIES).cast("int").alias("salts"))
    salts = dict(dealt.collect())  # a number a range; how many ranges there can be follows from the vocabularies
    table = known.groupBy("shard").applyInPandas(_pack, "shard int, pairs binary, counts binary, best binary")
    table = table.join(dealt, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for batch, pair, runs, text, n in zip(*(r.column(c).to_pylist() for c in ("batch", "pair", "runs", "text", "n"))):
                pair, runs = np.frombuffer(pair, "<u4"), np.frombuffer(runs, "<u4")
                edge = np.searchsorted(pair.astype(np.uint64) >> np.uint64(32 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                ends = 4 * np.concatenate([[0], np.cumsum(runs, dtype=np.int64)])
                out = [(s, (batch ^ batch >> 32) % salts[s], batch, pair[x:y].tobytes(), runs[x:y].tobytes(), text[ends[x]:ends[y]], n[ends[x]:ends[y]]) for s, (x, y) in enumerate(zip(edge[:-1], edge[1:])) if y > x]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["shard", "salt", "batch", "pair", "runs", "text", "n"])

    slices = batches.select("batch", "pair", "runs", "text", "n").mapInArrow(cut, "shard int, salt int, batch long, pair binary, runs binary, text binary, n binary")
    sums = slices.groupBy("shard", "salt").cogroup(table.groupBy("shard", "salt")).applyInPandas(lambda s, t: _meet(s, t), "batch long, text binary, sums binary")

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        each = left.column("docs").combine_chunks().flatten()
        total = np.zeros((2, len(each)), dtype=np.int64)
        for text, some in zip(right.column("text").to_pylist(), right.column("sums").to_pylist()):
            total[:, np.frombuffer(text, "<u4")] += np.frombuffer(some, "<i8").reshape(2, -1)
        names, columns = [f.name for f in each.type], each.flatten()
        return pa.table([*columns[:5], *map(pa.array, total), columns[5]], names=[*names[:5], "n_best", "count_sum", names[5]])

    kind = batches.schema["docs"].dataType.elementType["key"].dataType.simpleString()
    got = batches.select("batch", "docs").groupBy("batch").cogroup(sums.groupBy("batch"))
    got = got.applyInArrow(lambda d, s: whole(d, s), f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return got.withColumnRenamed("key", key)


def aligned_tokens(docs: DataFrame, raw_a: bytes, raw_b: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``link_counts`` of all rows of ``docs``; the batches are written to the shared folder in between."""
    return link_counts(shelved(align(docs, raw_a, raw_b, key, text), "aligned"), side(Pieces, raw_b).lengths.size, key)
