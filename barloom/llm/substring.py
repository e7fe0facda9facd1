"""Exact repeated passages by fixed-block anchors.

A window of ``WINDOW`` words holds at least one whole reference block: ``BLOCK`` words from a multiple of ``BLOCK`` on. Blocks are indexed, every
rolling run of ``BLOCK`` words of every text probes the index, and a block that another position also probes is an anchor. Around anchors every
window is compared in full with all others; consecutive repeated windows make up the maximal exact repeats. No pair of documents is formed, so a
passage in a third of all texts costs no more than another.

Hashes travel packed: a task sorts its probes, keeps two of each at most (so frequent passages shrink before the shuffle), and sends each hash
range its differences as compressed byte planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import likely, parted, shelved
from barloom.llm.shingles import WORDS, rolling, split

WINDOW, BLOCK = 35, 18  #: 2 * BLOCK - 1 <= WINDOW
PROBE_BITS = 48  #: of a probe's hash; a false anchor only costs a comparison
PROBES = 2 << 20  #: probes of a hash range
WINDOWS, LEAST_BITS = 4 << 20, 4  #: windows of a hash range; bits that number the ranges, at least
FLUSH = 4 << 20  #: hashes that a task gathers before it sends them


def packed(v: np.ndarray, bytes_each: int) -> bytes:
    """Byte planes of unsigned integers, compressed."""
    planes = np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(len(v), 8)[:, :bytes_each].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes, bytes_each: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(bytes_each, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :bytes_each] = planes.T
    return out.view("<u8").reshape(-1)


def steps(v: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first from zero; negative ones wrap."""
    return np.diff(v, prepend=v.dtype.type(0))


def twice_at_most(v: np.ndarray) -> np.ndarray:
    """Sorted values, each at most two times."""
    v = np.sort(v)
    return v[np.concatenate([np.ones(min(2, len(v)), dtype=bool), v[2:] != v[:-2]])]


def repeated(v: np.ndarray) -> np.ndarray:
    """Sorted values that occur twice or more; sorted runs in ``v`` are merged."""
    v = np.sort(v, kind="stable")
    again = v[1:][v[1:] == v[:-1]]
    return again[np.concatenate([np.ones(min(1, len(again)), dtype=bool), again[1:] != again[:-1]])]


def occurs_again(v: np.ndarray) -> np.ndarray:
    """For each value, whether it occurs at another place too."""
    order = np.argsort(v)
    s = v[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    out = np.empty(len(v), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


PIECE = pa.schema([("part", pa.int32()), ("vals", pa.binary()), ("rows", pa.binary()), ("places", pa.binary()), ("keys", pa.list_(pa.string()))])
PIECE_SQL = "part int, vals binary, rows binary, places binary, keys array<string>"


def _sent(part: np.ndarray, order: np.ndarray, make) -> Iterator[tuple]:
    """One piece per range that has values."""
    part = part[order]
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield (int(part[a]), *make(order[a:b]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE.types)], schema=PIECE)


def _named(rows: np.ndarray, keys: list[str]) -> tuple[np.ndarray, list[str]]:
    """Row numbers within the piece, and the keys they stand for."""
    used, local = np.unique(rows, return_inverse=True)
    return local.astype(np.uint64), [keys[i] for i in used.tolist()]


def _probes(bits: int):
    """Probes (``rows`` null) and reference blocks of each text, by hash range."""
    shift = np.uint64(PROBE_BITS - bits)

    def flushed(hashes, blocks, places, counts, keys):
        v = twice_at_most(np.concatenate(hashes) >> np.uint64(64 - PROBE_BITS))
        yield _batch([*_sent((v >> shift).astype(np.int64), np.arange(len(v)), lambda o: (packed(steps(v[o]), 6), None, None, None))])
        b, at = np.concatenate(blocks) >> np.uint64(64 - PROBE_BITS), np.concatenate(places)
        row = np.repeat(np.arange(len(keys)), counts)
        part = (b >> shift).astype(np.int64)

        def piece(o):
            local, names = _named(row[o], keys)
            return packed(b[o], 6), packed(steps(local), 4), packed(at[o], 4), names

        yield _batch([*_sent(part, np.argsort(part, kind="stable"), piece)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = ([], [], [], [], []), 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = WORDS.hashes(split(text))
                if len(h) < WINDOW:
                    continue
                g = rolling(h, BLOCK)
                hashes, blocks, places, counts, keys = state
                hashes.append(g)
                blocks.append(g[::BLOCK])
                places.append(np.arange(len(g[::BLOCK]), dtype=np.uint64))
                counts.append(len(g[::BLOCK]))
                keys.append(key)
                size += len(g)
                if size >= FLUSH:
                    yield from flushed(*state)
                    state, size = ([], [], [], [], []), 0
        if size:
            yield from flushed(*state)

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Pieces of one hash range after another: those without places, those with."""
    part, plain, placed = None, [], []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in PIECE.names)):
            if row[0] != part:
                if part is not None:
                    yield plain, placed
                part, plain, placed = row[0], [], []
            (plain if row[2] is None else placed).append(row)
    if part is not None:
        yield plain, placed


FOUND = pa.schema([("key", pa.string()), ("at", pa.binary())])


def _found(piece: tuple, hit: np.ndarray) -> pa.RecordBatch | None:
    """(key, places) of the values of a piece that are hits."""
    if not hit.any():
        return None
    rows, at = np.cumsum(unpacked(piece[2], 4))[hit] & np.uint64(0xFFFFFFFF), unpacked(piece[3], 4)[hit].astype("<u4")
    order = np.argsort(rows, kind="stable")
    rows, at = rows[order], at[order]
    edges = [0, *(np.flatnonzero(rows[1:] != rows[:-1]) + 1).tolist(), len(rows)]
    keys = piece[4]
    return pa.RecordBatch.from_arrays([pa.array([keys[int(rows[a])] for a in edges[:-1]]), pa.array([at[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], schema=FOUND)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for plain, placed in _ranges(batches):
        again = repeated(np.concatenate([np.cumsum(unpacked(p[1], 6)) for p in plain])) if plain else np.zeros(0, dtype=np.uint64)
        for p in placed if len(again) else ():
            v = unpacked(p[1], 6)
            got = _found(p, again[np.minimum(np.searchsorted(again, v), len(again) - 1)] == v)
            if got is not None:
                yield got


def _windows(bits: int):
    """Windows around anchors, by hash range, with their places."""
    shift = np.uint64(64 - bits)

    def flushed(hashes, places, counts, keys):
        v, at = np.concatenate(hashes), np.concatenate(places)
        row = np.repeat(np.arange(len(keys)), counts)
        part = (v >> shift).astype(np.int64) if bits else np.zeros(len(v), dtype=np.int64)

        def piece(o):
            local, names = _named(row[o], keys)
            return v[o].tobytes(), packed(steps(local), 4), packed(at[o], 4), names

        yield _batch([*_sent(part, np.argsort(part, kind="stable"), piece)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = ([], [], [], []), 0
        for b in batches:
            for key, text, anchors in zip(*(b.column(i).to_pylist() for i in range(3))):
                h = WORDS.hashes(split(text))
                first = np.frombuffer(b"".join(anchors), dtype="<u4").astype(np.int64) * BLOCK
                near = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(near, np.maximum(first - (WINDOW - BLOCK), 0), 1)
                np.add.at(near, np.minimum(first + 1, len(h)), -1)
                start = np.flatnonzero(np.cumsum(near)[:len(h) - WINDOW + 1] > 0)
                if not len(start):
                    continue
                hashes, places, counts, keys = state
                hashes.append(rolling(h, WINDOW)[start])
                places.append(start.astype(np.uint64))
                counts.append(len(start))
                keys.append(key)
                size += len(start)
                if size >= FLUSH:
                    yield from flushed(*state)
                    state, size = ([], [], [], []), 0
        if size:
            yield from flushed(*state)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, placed in _ranges(batches):
        vals = [np.frombuffer(p[1], dtype="<u8") for p in placed]
        hits = occurs_again(np.concatenate(vals))
        for p, hit in zip(placed, np.split(hits, np.cumsum([len(v) for v in vals])[:-1])):
            got = _found(p, hit)
            if got is not None:
                yield got


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Words that lie in a window with one of these starts."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def _kept(carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                kept, total, removed, spans = [], [], [], []
                for text, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = split(text)
                    gone = covered(len(words), np.frombuffer(b"".join(starts or []), dtype="<u4").astype(np.int64))
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    if len(edges):
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    kept.append(b" ".join(words))
                    total.append(len(gone))
                    removed.append(int(gone.sum()))
                    spans.append(edges.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                                                  *(part.column(3 + i) for i in range(carried))], names=["kept", "n_words", "n_removed", "spans", *(f"c{i}" for i in range(carried))])

    return run


def _bits(n: float, each: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, n / each)))))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept, n_words, n_removed, spans, carried columns) for every row.

    A word goes when a window of ``WINDOW`` words covers it whose words also start anywhere else, in the same text too; windows are judged on the
    input. ``kept`` joins the other words by one space, ``spans`` holds removed [start, end, start, ...] in words. Null and blank texts have no
    words and keep an empty text. Rows that repeat key and text are separate places that repeat each other, as are null keys.
    Only the named columns are read. An empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(carry) + 1)]
    src = docs.select(*(F.col(c).alias(n) for c, n in zip((key, *carry), names)), F.col(text).cast("string").alias("text"))
    # never null
    src = src.select(F.concat_ws("/", F.col("c0").cast("string"), F.hex(F.xxhash64("text")), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("string")).alias("key"), "text", *names)
    words = (src.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    probes = src.select("key", "text").mapInArrow(_probes(_bits(words, PROBES)), PIECE_SQL)
    anchors = probes.repartition("part").sortWithinPartitions("part").mapInArrow(_anchors, "key string, at binary")
    anchors = shelved(anchors.groupBy("key").agg(F.collect_list("at").alias("anchors")), "anchors")  # at most one list a text, bounded by its length
    windows = anchors.agg(F.sum(F.aggregate("anchors", F.lit(0), lambda s, x: s + F.octet_length(x)))).first()[0] or 0  # 4 bytes an anchor, BLOCK windows each
    near = likely(src.select("key", "text"), anchors, "key").join(anchors, "key")  # other texts are not moved
    tried = near.select("key", "text", "anchors").mapInArrow(_windows(max(LEAST_BITS, _bits(windows / 4 * BLOCK, WINDOWS))), PIECE_SQL)
    starts = tried.repartition("part").sortWithinPartitions("part").mapInArrow(_repeats, "key string, at binary").groupBy("key").agg(F.collect_list("at").alias("starts"))
    starts = shelved(starts, "starts")
    hit, others = parted(src, starts, "key")
    none = F.lit(None).cast("array<binary>").alias("starts")
    out = hit.join(starts, "key", "left").select("key", "text", "starts", *names).unionByName(others.select("key", "text", none, *names))
    fields = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)
    out = out.mapInArrow(_kept(len(names)), f"kept string, n_words long, n_removed long, spans array<long>, {fields}")
    return out.select(F.col("c0").alias(key), "kept", "n_words", "n_removed", "spans", *(F.col(n).alias(c) for c, n in zip(carry, names[1:])))


SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM w)),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM p WHERE h IN (SELECT h FROM r)),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(x.x, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
