"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation.

``SLOTS`` minima of ``BITS`` bits make a signature; its distance to another is the number of slots that differ. Cut into chunks of ``CHUNK``
slots, two signatures that differ in at most ``THRESHOLD`` slots have, by pigeonhole, a chunk with at most ``ERRORS`` wrong slots. Every chunk is
indexed once for each choice of slots that may be wrong, so all pairs under the threshold share a key. A pair at similarity 0.75 differs in a
quarter of the slots on average; the threshold lies 4.6 standard deviations above.

Only components matter, so equal sets are one class, and a bucket is first resolved against its least member (at most one confirmed pair a
document). Buckets that then still hold several components are dealt to blocks of bounded size, and each block is searched on its own; what that
joins is contracted before the blocks of a larger bucket meet each other. Every pair across components and under the threshold is compared on
whole sets, in the first bucket that it shares, unless links found before already join it. A block hands on only links that join something, fewer
than it has members; texts come only to blocks that have a pair for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import likely as _likely
from barloom.llm.common import shelved
from barloom.llm.graph import components
from barloom.llm.shingles import MIX, finish, shingle_set

WORDS, SIMILARITY = 5, 75  #: words of a shingle; per cent
SLOTS, BITS, CHUNK, ERRORS = 64, 16, 4, 1
CHUNKS = SLOTS // CHUNK
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
NTH = np.uint64(63)  #: low bits of a key: which of a signature's keys it is
BLOCK = 512  #: members of a block
PIVOT = 500  #: documents compared with one copy of a pivot
STEP = 1 << 15  #: hashes permuted at a time

_rng = np.random.default_rng(20240229)
ODD = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
XOR = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)[:, None] * np.uint64(2)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SLOTS`` minima, cut to ``BITS`` bits, per non-empty set."""
    out, i = np.zeros((len(sets), SLOTS), dtype="<u2"), 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= STEP):
            size += len(sets[j])
            j += 1
        if j == i + 1 and size > STEP:
            least = np.full((SLOTS, 1), np.uint64(2**64 - 1))
            for at in range(0, size, STEP):
                least = np.minimum(least, ((sets[i][at:at + STEP][None] ^ XOR) * ODD).min(axis=1, keepdims=True))
        else:
            starts = np.cumsum([0, *map(len, sets[i:j - 1])])
            least = np.minimum.reduceat((np.concatenate(sets[i:j])[None] ^ XOR) * ODD, starts, axis=1)
        out[i:j] = ((least >> np.uint64(16)) & np.uint64(0xFFFF)).T
        i = j
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 512):
            part = b.slice(at, 512)
            sets = [shingle_set(t, WORDS) for t in part.column(2).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digest, sig = [None] * len(sets), [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full])):
                digest[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), part.column(3)],
                                             names=["id", "doc", "n", "digest", "sig", "check"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = [c for e in (ERRORS,) for c in combinations(range(CHUNK), CHUNK - e)]
    for b in batches:
        for at in range(0, len(b), 2048):
            part = b.slice(at, 2048)
            n = len(part)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2").reshape(n, CHUNKS, CHUNK).astype(np.uint64)
            keys, nth = np.empty((n, CHUNKS, len(kept)), dtype=np.uint64), np.arange(CHUNKS * len(kept), dtype=np.uint64).reshape(CHUNKS, len(kept))
            for k, slots in enumerate(kept):
                h = np.full((n, CHUNKS), np.uint64(k + 1)) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(64)
                for s in slots:
                    h = h * MIX + sig[:, :, s]
                keys[:, :, k] = finish(h) & ~NTH | nth[:, k]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), keys[0].size))], names=["key", "id"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks, from rows sorted by block."""
    held = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        block = b.column(0).to_numpy()
        last = int(np.searchsorted(block, block[-1], side="left")) if len(block) else 0
        held = b.slice(last)
        if last:
            yield b.slice(0, last)
    if held is not None and len(held):
        yield held


def _meetings(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of ``b``) to compare: main x other and other x other of a block, of different components, within the threshold, in the first
    bucket that the pair shares."""
    block, comp, side, inner, nth = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "comp", "side", "inner", "nth"))
    sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u2").reshape(len(b), SLOTS)
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(b)]
    for s, e in zip(edges[:-1], edges[1:]):
        here = np.arange(s, e)
        main, other = here[side[s:e] == 0], here[side[s:e] != 0]
        todo = [(main, other, False)] if len(main) else []
        if len(other) > 1 and (inner[s] or not len(main)):
            todo.append((other, other, True))
        for left, right, same in todo:
            for at in range(0, len(left), 64):
                some = left[at:at + 64]
                equal = sig[some][:, None, :] == sig[right][None]
                near = (equal.sum(axis=2) >= SLOTS - THRESHOLD) & (comp[some][:, None] != comp[right][None])
                if same:
                    near &= some[:, None] < right[None]
                i, j = np.nonzero(near)
                if len(i):
                    chunk = equal[i, j].reshape(-1, CHUNKS, CHUNK)
                    right_slots = chunk.sum(axis=2)
                    first = (right_slots >= CHUNK - ERRORS).argmax(axis=1)
                    wrong = np.where(right_slots[np.arange(len(i)), first] == CHUNK, CHUNK - 1, chunk[np.arange(len(i)), first].argmin(axis=1))
                    mine = first * CHUNK + (CHUNK - 1 - wrong) == nth[s]  # keys of a chunk are numbered by the slot they leave out, last slot first
                    yield some[i[mine]], right[j[mine]]


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, id) of the rows that have a pair in their block."""
    for b in _groups(batches):
        has = np.zeros(len(b), dtype=bool)
        for x, y in _meetings(b):
            has[x] = has[y] = True
        if has.any():
            yield b.filter(pa.array(has)).select(["block", "id", "comp", "side", "inner", "nth", "sig"])


class Forest(dict):
    """Disjoint sets of components; a missing entry is its own root."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within blocks that join components still apart in this task; whole sets are compared."""
    forest = Forest()
    for b in _groups(batches):
        ids, comp = b.column("id").to_numpy(), b.column("comp").to_numpy().tolist()
        texts, sets, out = b.column("text").to_pylist(), {}, []

        def whole(i: int) -> np.ndarray:
            if ids[i] not in sets:
                sets[ids[i]] = shingle_set(texts[i], WORDS)
            return sets[ids[i]]

        for x, y in _meetings(b):
            order = np.argsort(y, kind="stable")
            x, y = x[order], y[order]
            edges = [0, *(np.flatnonzero(y[1:] != y[:-1]) + 1).tolist(), len(y)] if len(y) else [0]
            for s, e in zip(edges[:-1], edges[1:]):
                me, left, some = int(y[s]), x[s:e].tolist(), 1
                while left := [i for i in left if forest.root(comp[i]) != forest.root(comp[me])]:
                    now, left, some = left[:some], left[some:], 32  # one match often settles the rest
                    mine, others = whole(me), [whole(i) for i in now]
                    sizes = np.array([len(o) for o in others])
                    every = np.concatenate(others)
                    both = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every, np.concatenate([[0], np.cumsum(sizes[:-1])]))
                    good = 100 * both >= SIMILARITY * (sizes + len(mine) - both)
                    out += [(int(ids[i]), int(ids[me])) for i, g in zip(now, good) if g and forest.join(comp[i], comp[me])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one pivot after another, the pivot's own text first."""
    pivot, whole = None, None
    for b in batches:
        out = []
        for p, lead, i, text in zip(*(b.column(c).to_pylist() for c in ("pivot", "lead", "id", "text"))):
            if lead:
                pivot, whole = p, shingle_set(text, WORDS)
                continue
            mine = shingle_set(text, WORDS)
            both = len(np.intersect1d(whole, mine, assume_unique=True))
            if p == pivot and 100 * both >= SIMILARITY * (len(whole) + len(mine) - both):
                out.append((p, i))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. ``texts``: id, text.

    The documents compared with a pivot come to it in parts of about ``PIVOT``, each part with a copy of the pivot's text.
    """
    pairs = shelved(pairs.select("a", "b"), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT).cast("int").alias("parts"))
    leads = parts.select(F.col("a").alias("id"), F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"))
    others = pairs.join(parts, "a").select(F.col("b").alias("id"), F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("lead"))
    asked = shelved(leads.unionByName(others), "asked")
    rows = texts.join(asked, "id").select("pivot", "part", "lead", "id", "text").repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc("lead"))
    return shelved(rows.mapInArrow(_confirm, "a long, b long"), "links")


def _own_blocks(members: DataFrame) -> DataFrame:
    """Members (key, id, nth, comp, n: size of the bucket) dealt to the blocks of their bucket; each block is searched on its own."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int")
    return members.select(F.xxhash64("key", part).alias("block"), "id", "comp", F.lit(1).alias("side"), "nth", F.lit(True).alias("inner"))


def _blocks(members: DataFrame) -> DataFrame:
    """Members (key, id, nth, comp) of buckets with several components, dealt to blocks. The bucket's commonest component is its main side.

    Every main block meets every other block, and other blocks meet each other; a bucket of nothing but small components has a small main side.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max("n").alias("mains"), (F.sum("n") - F.max("n")).alias("others"))
    d = members.join(main, "key")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("id"), blocks(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    is_main = F.col("comp") == F.col("main")
    meet = F.transform(upto("others"), lambda o: F.struct(mine("mains").alias("x"), o.alias("y"), F.lit(0).alias("kind")))
    come = F.transform(upto("mains"), lambda m: F.struct(m.alias("x"), mine("others").alias("y"), F.lit(0).alias("kind")))
    cross = F.transform(F.filter(upto("others"), lambda o: o != mine("others")), lambda o: F.struct(F.least(o, mine("others")).alias("x"), F.greatest(o, mine("others")).alias("y"), F.lit(1).alias("kind")))
    d = d.select("key", "id", "nth", "comp", F.when(is_main, 0).otherwise(1).alias("side"), F.explode(F.when(is_main, meet).otherwise(F.concat(come, cross))).alias("u"))
    return d.select(F.xxhash64("key", "u").alias("block"), "id", "comp", "side", "nth", ((F.col("u.x") == 0) | (F.col("u.kind") == 1)).alias("inner"))


def _labelled(d: DataFrame, labels: DataFrame | None, col: str, out: str) -> DataFrame:
    if labels is None:
        return d.withColumn(out, F.col(col))
    names = labels.select(F.col("node").alias(col), F.col("component").alias("__c"))
    return d.join(names, col, "left").withColumn(out, F.coalesce("__c", col)).drop("__c")


def row_id(key: str = "doc_id", text: str = "text") -> Column:
    """First half of a row's identity, by its key and text; null for a null key."""
    doc = F.col(key).cast("long")
    return F.when(doc.isNotNull(), F.xxhash64(doc, F.col(text).cast("string")))


def row_check(key: str = "doc_id", text: str = "text") -> Column:
    """Second half of a row's identity: rows of equal ``row_id`` and ``row_check`` have equal key and text, to 128 bits."""
    return F.xxhash64(F.lit(7), F.col(text).cast("string"), F.col(key).cast("long"))


def _apart(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """New ids for rows whose id stands for several rows."""
    return rows.join(clashes, "id", "left").withColumn("id", F.when(F.col("clash"), F.xxhash64("id", "check")).otherwise(F.col("id"))).drop("clash")


def _classes(stands: DataFrame) -> DataFrame:
    """(id, rep): least id of each set of equal digests. Classes with over a thousandth of all rows, fewer than a thousand, are broadcast."""
    stands = shelved(stands.select("id", "digest"), "stands")
    sizes = shelved(stands.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "classes")
    most = stands.count() // 1000
    few = F.broadcast(sizes.filter(F.col("n") > most).select("digest", F.col("rep").alias("hot")))
    known = stands.join(few, "digest", "left")
    rest = known.filter("hot IS NULL").select("id", "digest").join(sizes.filter(F.col("n") <= most).select("digest", "rep"), "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return known.filter("hot IS NOT NULL").select("id", F.col("hot").alias("rep")).unionByName(rest)


def _search(units: DataFrame, sig: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` after the pairs within blocks are compared and what they join is contracted."""
    fields = "block long, id long, comp long, side int, inner boolean, nth short, sig binary"
    by_block = lambda d: d.repartition("block").sortWithinPartitions("block")
    needed = by_block(units.join(sig, "id").select("block", "id", "comp", "side", "inner", "nth", "sig")).mapInArrow(_needed, fields)
    needed = shelved(needed, "needed")
    found = by_block(needed.join(texts, "id")).mapInArrow(_linked, "a long, b long")
    joined = _labelled(_labelled(found, labels, "a", "ca"), labels, "b", "cb")
    more = shelved(components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "merged")  # components of components
    fresh = more.join(labels.select("node"), "node", "left_anti")
    return shelved(_labelled(labels, more, "component", "least").select("node", F.col("least").alias("component")).unionByName(fresh), "components")


def row_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, check, id, doc, n, group) for every row: its identity, the id it has here, key, shingles, and the least id that its text is linked
    with, over any number of links."""
    src = docs.select(row_id(key, text).alias("id"), row_check(key, text).alias("check"), F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    base = src.select("id", "doc", "text", "check").mapInArrow(_sign, "id long, doc long, n long, digest binary, sig binary, check long")
    base = shelved(base.withColumn("row", F.col("id")), "signatures")
    clashes = base.filter("id IS NOT NULL").groupBy("id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo < hi").select("id", F.lit(True).alias("clash"))
    if not clashes.isEmpty():
        clashes = shelved(clashes, "clashes")
        src, base = _apart(src, clashes), shelved(_apart(base, clashes), "signatures")
    nodes = base.filter("n > 0 AND id IS NOT NULL")
    member = shelved(_classes(nodes.groupBy("id").agg(F.min("digest").alias("digest"))), "members")
    reps = member.filter("id = rep").select("id")
    signed = shelved(nodes.join(reps, "id").select("id", "sig").dropDuplicates(["id"]), "representatives")

    keys = signed.select("id", "sig").mapInArrow(_keys, "key long, id long")
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader", "n")  # an id has a key once
    buckets = shelved(keys.join(shared, "key"), "buckets")
    near = buckets.filter("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    first = near.groupBy("id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    sig = signed.select("id", "sig")
    first = first.join(sig, "id").join(sig.select(F.col("id").alias("leader"), F.col("sig").alias("sig_l")), "leader")
    first = first.filter(_far("sig", "sig_l") <= THRESHOLD).select(F.col("leader").alias("a"), F.col("id").alias("b"))
    suspects = shelved(buckets.select("id").distinct(), "suspects")  # its size is known when the join is planned
    texts = shelved(_likely(src.select("id", "text"), suspects).join(suspects, "id").select("id", "text"), "texts")  # of representatives that share a key; all rounds read them
    links = confirmed(first, texts)
    labels = shelved(components(links), "components")

    def open_buckets(labels: DataFrame, least: int) -> DataFrame:
        """Members of buckets of ``least`` members or more that still hold several components."""
        open_ = _labelled(buckets.filter(F.col("n") >= least).select("key", "id", "n", F.col("key").bitwiseAND(int(NTH)).cast("short").alias("nth")), labels, "id", "comp")
        several = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        return shelved(open_.join(several, "key"), "open")

    labels = _search(_own_blocks(open_buckets(labels, 2)), sig, texts, labels)
    across = open_buckets(labels, BLOCK + 1)  # a smaller bucket is one block
    if not across.isEmpty():
        labels = _search(_blocks(across), sig, texts, labels)

    whole = _labelled(member.select("id", "rep"), labels, "rep", "group").select("id", "group")
    return shelved(base.select("row", "check", "id", "doc", "n").join(whole, "id", "left").withColumn("group", F.coalesce("group", "id")), "groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row.

    Null or blank texts have an empty set and are linked with nothing. A null key takes no part in links: its component is null and it is kept.
    Rows are linked by their own texts; rows that repeat a key form one document, in one component with all that any of its texts is linked
    with. Other columns are not read. An empty table gives no rows.
    """
    rows = row_groups(docs, key, text)
    least = rows.filter("doc IS NOT NULL").groupBy("doc").agg(F.min("group").alias("a"), F.max("group").alias("z")).filter("a < z").select("doc", "a")
    folded = components(rows.join(least, "doc").select("a", F.col("group").alias("b")))
    rows = shelved(_labelled(rows, folded, "group", "comp"), "folded")
    names = rows.filter("doc IS NOT NULL").groupBy("comp").agg(F.min("doc").alias("component_id"))
    out = rows.join(names, "comp", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def _far(x: str, y: str) -> Column:
    """Slots in which two packed signatures differ."""
    slot = lambda c, i: F.substring(c, 2 * i + 1, 2)
    total = F.lit(0)
    for i in range(SLOTS):
        total = total + F.when(slot(x, i) == slot(y, i), 0).otherwise(1)
    return total


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
 GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept FROM w JOIN c ON c.a = w.doc_id LEFT JOIN n USING (doc_id)"""
