"""Document fingerprints by winnowing.

Rolling hashes of ``GRAM`` code points; of every ``SPAN`` consecutive hashes the least is kept, the rightmost if several are equal, with its
position. Texts that share ``GRAM + SPAN - 1`` code points in a row share a kept hash. A text shorter than one gram is a gram of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shingles import rolling

GRAM, SPAN = 8, 13  #: 20 code points in a row are enough to be seen
HASH_BITS, AT_BITS = 40, 24  #: a hash and its place share one integer, so that the least one is also the rightmost
PIECE = 1 << (AT_BITS - 1)  #: windows taken at a time; longer texts continue with the next piece
BLOCK_BYTES = 4 << 20
MOST_BLOCKS = 10_000


def winnow(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) in order of position; none for an empty text."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    grams = rolling(codes + np.uint64(1), min(GRAM, len(codes))) >> np.uint64(64 - HASH_BITS)
    windows = max(1, len(grams) - SPAN + 1)
    hashes, places = [], []
    for at in range(0, windows, PIECE):
        part = grams[at:at + PIECE + SPAN - 1]
        mask = np.uint64((1 << AT_BITS) - 1)
        best, size, span = part << np.uint64(AT_BITS) | mask - np.arange(len(part), dtype=np.uint64), 1, min(SPAN, len(part))
        while size * 2 <= span:
            best, size = np.minimum(best[:-size], best[size:]), size * 2
        if size < span:
            best = np.minimum(best[:len(best) - span + size], best[span - size:])
        best = best[np.concatenate([[True], best[1:] != best[:-1]])]
        hashes.append(best >> np.uint64(AT_BITS))
        places.append((mask - (best & mask)).astype(np.int64) + at)
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.concatenate([[True], p[1:] != p[:-1]])
    return h[new], p[new]


def as_text(h: np.ndarray, p: np.ndarray) -> str:
    """Base64 of 6 bytes a kept hash: its distance from the one before (below ``SPAN``) and the hash."""
    raw = np.zeros((len(h), 8), dtype=np.uint8)
    raw[:, 1:6] = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    raw[:, 0] = np.diff(p, prepend=0)
    return base64.b64encode(raw[:, :6].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of distinct hashes; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hashes, positions) of every whole text; a null or empty text has none. Other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                got = [winnow(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))], names=["key", "hashes", "positions"])

    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"key {src.schema[0].dataType.simpleString()}, hashes array<long>, positions array<long>").withColumnRenamed("key", key)


def _blocks_of(bounds: list[int], visits: dict[int | None, int]):
    """UDF: block of an id, ids falling and nulls last, followed by the block whose last row it follows, if it heads a block."""
    edges = np.array(sorted(bounds), dtype=np.int64)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, absent in batches:
            own = np.where(absent, len(edges) + 1, len(edges) - np.searchsorted(edges, ids.to_numpy(), side="right"))
            heads = [visits.get(None if gone else i) for i, gone in zip(ids.tolist(), absent.tolist())]
            yield pd.Series([[o] if v is None else [o, v] for o, v in zip(own.tolist(), heads)])

    return F.pandas_udf(run, "array<int>")


EDITED = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                    ("near_next", pa.float64())])
EDITED_SQL = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in falling order of id, then the head of the next block as a guest."""
    before = None
    for b in batches:
        for at in range(0, len(b), 256):
            out = []
            for block, guest, key, text in zip(*(b.slice(at, 256).column(c).to_pylist() for c in ("block", "guest", "id", "text"))):
                text = text or ""
                h, p = winnow(text)
                here = (block, key, text, h, p, np.unique(h))
                if before is not None and before[0] == block:
                    _, k, t, th, tp, known = before
                    cut = len(t) // 3
                    new = t[:len(t) - cut] + text[:cut]
                    nh, at_new = winnow(new)
                    out.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), as_text(th, tp), as_text(nh, at_new), likeness(known, np.unique(nh)), likeness(known, here[-1])))
                before = None if guest else here
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), EDITED.types)], schema=EDITED)


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last third (code points, rounded down) replaced by as many of the next row's first ones, or all. Next: falling
    keys, null keys last, equal keys by hash of their text; after the last row the first. A lone row is its own next. A null text is empty. Two
    texts without fingerprint are alike (1). Other columns are not read; an empty table gives no rows.

    Rows go to blocks between quantiles of the key, so a block's order is the table's; it also gets a copy of the head of the next block.
    """
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(MOST_BLOCKS, -(-size // BLOCK_BYTES)))
    bounds = src.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    place = lambda visits: _blocks_of(sorted(set(bounds or [])), visits)(F.coalesce("id", F.lit(0)), F.col("id").isNull())
    heads = sorted(src.select("id", place({})[0].alias("block")).groupBy("block").agg(F.max("id")).collect())  # one row a block, MOST_BLOCKS at most
    visits = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    rows = src.select("id", "text", F.posexplode(place(visits)).alias("guest", "block")).select("block", (F.col("guest") == 1).alias("guest"), "id", F.xxhash64("text").alias("tie"), "text")
    rows = rows.repartitionById(len(set(bounds or [])) + 2, "block").sortWithinPartitions("block", "guest", F.desc_nulls_last("id"), "tie", "text")
    return rows.select("block", "guest", "id", "text").mapInArrow(_edited, EDITED_SQL).withColumnRenamed("id", key)
