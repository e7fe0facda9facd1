"""Best-fit packing into sequences of several permitted lengths.

Pieces of equal length are interchangeable, so packing is planned on the histogram of lengths, which is no longer than the largest capacity, and
bins of equal history are one group. Lengths fall; a piece goes to the open bin with the least room that holds it. If none does, a bin opens at
the size of least cost for a piece. Which sizes may open is optimised jointly: every choice of permitted lengths is planned on the histogram and the
one with the least total cost is taken. At the end every bin shrinks to the least permitted length that holds its contents.

The plan is a list of slots (length, ranks, bins). Pieces get their rank among equal lengths by parts of bounded size and look up their slot.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import parts_for, shelved

CAPACITIES = (256, 512, 1024, 2048, 4096)  #: permitted sequence lengths
BIN_COST = 16  #: fixed cost of a sequence, in tokens
PART_ROWS = 200_000  #: pieces ranked together


def cost(capacity: int) -> float:
    """Of one sequence: its positions, padding included, and a fixed share."""
    return capacity + BIN_COST


def plan(histogram: dict[int, int], capacities: tuple[int, ...], opening: tuple[int, ...]) -> tuple[list[tuple], list[tuple], float]:
    """Best-fit of ``histogram`` (length: pieces) when only sizes in ``opening`` are opened.

    Returns slots (length, first rank, pieces, pieces a bin, first bin, first offset), groups (first bin, bins, capacity) and the total cost.
    """
    slots, closed = [], []
    room: list[int] = []  # sorted rooms of open bins
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room: (first bin, bins, size when opened)
    bins = 0

    def add(left: int, group: tuple[int, int, int]) -> None:
        if left == 0:
            closed.append((*group, 0))
            return
        if left not in groups:
            insort(room, left)
            groups[left] = []
        groups[left].append(group)

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect_left(room, length)
            if at < len(room):
                left = room[at]
                first, n, size = groups[left].pop()
                if not groups[left]:
                    del groups[left], room[at]
            else:  # least cost for the piece; equal costs: the larger size
                size = min((c for c in opening if c >= length), key=lambda c: (cost(c) / (c // length), -c))
                left = size
                n = -(-todo // (size // length))
                first, bins = bins, bins + n
            each = left // length
            full = min(n, todo // each)
            if full:
                slots.append((length, rank, full * each, each, first, size - left))
                add(left - each * length, (first, full, size))
                rank, todo = rank + full * each, todo - full * each
            if full < n:
                last = min(todo, each)
                if last:
                    slots.append((length, rank, last, last, first + full, size - left))
                    add(left - last * length, (first + full, 1, size))
                    rank, todo, full = rank + last, todo - last, full + 1
                if full < n:
                    add(left, (first + full, n - full, size))
    out, total = [], 0.0
    for first, n, size, left in closed + [(*g, left) for left, gs in groups.items() for g in gs]:
        fitted = min(c for c in capacities if c >= size - left)
        out.append((first, n, fitted))
        total += n * cost(fitted)
    return slots, sorted(out), total


def best_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[tuple], list[tuple], float]:
    """The cheapest plan over all choices of sizes to open; the largest size is always among them."""
    top = max(capacities)
    others = [c for c in capacities if c != top]
    choices = [(*some, top) for k in range(len(others) + 1) for some in combinations(sorted(others), k)]
    return min((plan(histogram, capacities, c) for c in choices), key=lambda p: p[2])


def _placed(slots: list[tuple], groups: list[tuple]):
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)
    width = int(table[:, 0].max(initial=0)) + 1
    start = np.searchsorted(table[:, 0], np.arange(width + 1))
    firsts, sizes = np.array([g[0] for g in groups], dtype=np.int64), np.array([g[2] for g in groups], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (0, 1))
            slot = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                here = length == n
                a, z = start[n], start[n + 1]
                slot[here] = a + np.searchsorted(table[a:z, 1], rank[here], side="right") - 1
            s = table[slot]
            nth, within = np.divmod(rank - s[:, 1], s[:, 3])
            bin_id = s[:, 4] + nth
            size = sizes[np.searchsorted(firsts, bin_id, side="right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(bin_id), pa.array(s[:, 5] + within * length), pa.array(size), b.column(0), *(b.column(i) for i in range(2, b.num_columns))],
                                             names=["bin_id", "bin_offset", "capacity", "n_tokens", *b.schema.names[2:]])

    return run


def pack(docs: DataFrame, length: Column, key: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """(key, piece, start, n_tokens, bin_id, bin_offset, capacity): where every piece of every row lies.

    ``length``: tokens of a row. A row longer than the largest capacity is cut into pieces of that size and a rest; null or non-positive
    lengths give one piece of no tokens in no bin (bin_id, bin_offset and capacity null). Null and repeated keys keep their rows: every row is packed
    on its own. Other columns are not read. An empty table gives no rows.
    """
    top = max(capacities)
    n = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    src = docs.select(F.col(key).alias("key"), n.alias("n"))
    pieces = src.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / top), F.lit(0)).cast("long"))).alias("piece"))
    pieces = pieces.select("key", "piece", (F.col("piece") * top).alias("start"), F.least(F.col("n") - F.col("piece") * top, F.lit(top)).cast("int").alias("n_tokens"))
    pieces = shelved(pieces, "pieces")
    filled = pieces.filter("n_tokens > 0")
    histogram = {r.n_tokens: r["count"] for r in filled.groupBy("n_tokens").count().collect()}  # no longer than the largest capacity
    slots, groups, _ = best_plan(histogram, capacities)
    # rank among equal lengths: within a part of a length, then offset by the parts before it
    parts = F.create_map(*(F.lit(x) for n, c in histogram.items() if c > PART_ROWS for x in (n, parts_for(c, PART_ROWS)))) if any(c > PART_ROWS for c in histogram.values()) else None
    many = F.lit(1) if parts is None else F.coalesce(parts[F.col("n_tokens")], F.lit(1))
    filled = filled.withColumn("part", F.pmod(F.xxhash64("key", "piece"), many).cast("int"))
    before = filled.groupBy("n_tokens", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("n_tokens", "part").orderBy(F.xxhash64("key", "piece"), "key", "piece")
    ranked = filled.withColumn("row", F.row_number().over(order)).join(before.select("n_tokens", "part", F.coalesce("before", F.lit(0)).alias("before")), ["n_tokens", "part"])
    kind = src.schema["key"].dataType.simpleString()
    placed = ranked.select(F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("before") + F.col("row") - 1).alias("rank"), "key", "piece", "start")
    placed = placed.mapInArrow(_placed(slots, groups), f"bin_id long, bin_offset long, capacity long, n_tokens long, key {kind}, piece long, start long")
    none = F.lit(None).cast("long")
    blank = pieces.filter("n_tokens = 0").select("key", "piece", "start", F.col("n_tokens").cast("long").alias("n_tokens"), none.alias("bin_id"), none.alias("bin_offset"), none.alias("capacity"))
    return placed.select("key", "piece", "start", "n_tokens", "bin_id", "bin_offset", "capacity").unionByName(blank).withColumnRenamed("key", key)


def words_and_end(text: str = "text") -> Column:
    """Tokens of a text for packing: its words (runs without space and the controls 9-13) and an end mark; none for an empty text."""
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.when(words > 0, words + 1).otherwise(0)
