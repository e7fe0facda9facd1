"""Operators of the llm subpackage against plain Python, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import bpe, graph, neardup, packing, quality, shingles, substring, topk, toxicity, urls, warc, winnow

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RAW = bpe.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
DOCS = "doc_id long, text string, key string, id long, words int, kept string, n int, score double"


def docs(spark, rows):
    """A table of documents whose other columns clash with internal names."""
    return spark.createDataFrame([(i, t, "k", 1, 2, "x", 3, 0.5) for i, t in rows], DOCS)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def family(seed=5):
    rng = random.Random(seed)
    base = prose(rng, 120, 5000).split()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, prose(rng, 9000))]
    for i in range(10, 60):  # near copies at growing distance, so that links chain and break
        w = list(base)
        for j in rng.sample(range(120), (i - 10) // 6):
            w[j] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    rows += [(60, rows[20][1]), (61, rows[20][1].upper()), (62, rows[20][1])]
    rows += [(i, prose(rng, 60)) for i in range(70, 90)]
    return rows


# ---- 1: top k -----------------------------------------------------------------------------------------------------------------
def plain_top(rows, k):
    good = {i: [int(np.floor(256.0 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in good if i % 50 == 0):
        found = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype("float32")]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # ties
    rows += [(460, None), (461, [float("nan")] * 16), (462, [None] * 16), (500, [float("inf")] * 16), (550, []), (None, rows[0][1]), (600, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, id int, part string")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_search_prunes_but_keeps_ties():
    rng = np.random.default_rng(2)
    w, q = rng.integers(-60, 60, (3000, 24)), rng.integers(-60, 60, 24)
    ids = np.arange(3000)
    scores = w @ q
    want = sorted(zip((-scores).tolist(), ids.tolist()))[:5]
    assert topk.search(ids, w, -1, q, 5, topk.LOW) == [(-s, i) for s, i in want]
    assert topk.search(ids, w, -1, q, 5, -want[4][0]) == [(-s, i) for s, i in want]
    assert topk.search(ids, w, -1, q, 5, 10 ** 9) == []


def test_search_keeps_repeated_rows_across_steps():
    rng = np.random.default_rng(3)
    w, q = rng.integers(-60, 60, (4 * topk.STEP, 24)), rng.integers(1, 60, 24)
    ids = np.arange(len(w))
    ids[:4], w[:4] = 7, 50 + np.arange(24) % 3  # the best row, four times in the first step
    w[topk.STEP + 9] = 59  # and better ones in later steps
    w[3 * topk.STEP] = 49
    want = sorted(zip((-(w @ q)).tolist(), ids.tolist()))[:5]
    assert [i for _, i in want].count(7) == 4
    assert topk.search(ids, w, -1, q, 5, topk.LOW) == [(-s, i) for s, i in want]


# ---- 2: packing ---------------------------------------------------------------------------------------------------------------
def test_packing_places_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 3, 3, 7, 30, 63, 64, 65, 200]))) for i in range(900)] + [(None, "a b"), (3, "a b c"), (3, "a b c"), (901, None), (902, "")]
    sizes = (16, 64)
    out = packing.pack(docs(spark, rows), packing.words_and_end(), capacities=sizes).collect()
    need = Counter((i, len(t.split()) + 1 if t and t.split() else 0) for i, t in rows)
    assert sum(r.n_tokens for r in out) == sum(n * c for (_, n), c in need.items())
    bins = defaultdict(list)
    for r in out:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in rs:
            assert r.bin_offset == end and r.n_tokens > 0
            end += r.n_tokens
        assert {r.capacity for r in rs} == {min(c for c in sizes if c >= end)}
    assert sorted(r.doc_id for r in out if r.bin_id is None) == [901, 902]
    assert packing.pack(docs(spark, rows).limit(0), packing.words_and_end()).count() == 0


def one_by_one(lengths, capacities, opening):
    """Best-fit decreasing, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits, key=lambda b: b[0])[0] -= n
        else:
            c = min((c for c in opening if c >= n), key=lambda c: (packing.cost(c) / (c // n), -c))
            bins.append([c - n, c])
    return sum(packing.cost(min(c for c in capacities if c >= size - left)) for left, size in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=60), st.sampled_from([(32,), (8, 32), (16, 32), (8, 16, 32)]))
def test_grouped_plan_equals_single_steps(lengths, opening):
    slots, groups, total = packing.plan(dict(Counter(lengths)), (8, 16, 32), opening)
    assert total == one_by_one(lengths, (8, 16, 32), opening)
    assert sum(s[2] for s in slots) == len(lengths)
    assert packing.best_plan(dict(Counter(lengths)), (8, 16, 32))[2] <= total


# ---- 3 and 9: classifiers -----------------------------------------------------------------------------------------------------
def test_quality_learns_and_keeps_rows(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) + "." if i % 4 else " ".join(w + "###" for w in prose(rng, 40).split())) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 800, 2)] + [(None, 1, 0), (1, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(900, None), (901, ""), (None, rows[1][1]), (5, rows[5][1])])
    model = quality.train(d, labels)
    out = quality.score(d, model)
    assert out.columns == d.columns and out.count() == 804
    got = {r.doc_id: r.score for r in out.collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= quality.CUT) == (i % 4 > 0) for i in range(800)]) > 0.98
    none = quality.train(d, labels.limit(0))
    assert all(r.score == pytest.approx(quality.CUT) for r in quality.score(d, none).select("score").collect())


def test_toxicity_grades(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        w = prose(rng, 80, 3000).split()
        for _ in range([0, 0, 1, 4][i % 4]):
            w[rng.randrange(80)] = rng.choice(["Rotter***", "vile!", "grimstem" + rng.choice("abcdef")])
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 > 1)) for i in range(0, 900) if i % 3], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(901, None), (902, ""), (None, "vile")])
    out = toxicity.grade(d, toxicity.train(d, labels)).select("doc_id", "toxicity.*").collect()
    assert len(out) == 903
    by = {r.doc_id: r for r in out}
    held = [i for i in range(900) if i % 3 == 0]
    assert np.mean([by[i].toxic == (i % 4 > 1) for i in held]) > 0.97
    assert np.mean([by[i].severity for i in held if i % 4 == 3]) > np.mean([by[i].severity for i in held if i % 4 == 2]) > np.mean([by[i].severity for i in held if i % 4 == 0])
    assert not by[901].toxic and not by[902].toxic
    assert not any(r.toxicity.toxic for r in toxicity.grade(d, toxicity.train(d, labels.limit(0))).collect())


def test_toxicity_of_a_rare_kind(spark):
    rng = random.Random(16)
    rows = [(i, prose(rng, 40, 3000) + (" vile" if i % 4 == 3 else "")) for i in range(3600)]
    rows += [(i, prose(rng, 40, 3000) + " zorrote") for i in range(3600, 3620)]  # 10 of 910 toxic texts with a label
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 3 or i >= 3600)) for i in range(3610)], "doc_id long, quality int, toxic int")
    out = toxicity.grade(docs(spark, rows), toxicity.train(docs(spark, rows), labels)).select("doc_id", "toxicity.toxic").collect()
    assert all(r.toxic for r in out if r.doc_id >= 3610)
    assert sum(r.toxic for r in out if r.doc_id < 3600 and r.doc_id % 4 != 3) < 30


# ---- 4: near duplicates -------------------------------------------------------------------------------------------------------
def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("block", [2, 512])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PIVOT", 3)
    rows = family()
    got = {tuple(r) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_edges(spark):
    rows = family()[:12]
    out = neardup.near_duplicates(docs(spark, rows + [(None, rows[8][1]), rows[8], rows[8]]))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == len(rows) + 3
    assert [(r.component_id, r.kept) for r in out.filter("doc_id IS NULL").collect()] == [(None, True)]
    assert neardup.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_every_pair_under_the_threshold_shares_a_key():
    import pyarrow as pa
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.SLOTS).astype("<u2")
        b = a.copy()
        b[rng.choice(neardup.SLOTS, neardup.THRESHOLD, replace=False)] += 1
        keys = next(neardup._keys(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["id", "sig"])]))).column("key").to_pylist()
        half = len(keys) // 2
        assert set(keys[:half]) & set(keys[half:])


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 600)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_keys_are_linked_by_every_text(spark):
    rng = random.Random(17)
    a, b, c, d = (prose(rng, 60, 5000) for _ in range(4))
    rows = docs(spark, [(1, c), (5, a), (5, b), (8, a), (9, b + " x"), (7, d), (7, d), (7, "")])
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect()}
    assert got == {(1, 1, True), (5, 5, True), (8, 5, False), (9, 5, False), (7, 7, True)}
    import corpus_pipeline
    left = corpus_pipeline.one_of_each(spark, rows, "")
    assert left.columns == rows.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, c), (5, a), (5, b), (7, d), (7, "")])


# ---- 5: fingerprints ----------------------------------------------------------------------------------------------------------
def plain_picks(text):
    """Hashes by the operator's own grams; windows and ties by definition."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    grams = [int(x) >> 24 for x in shingles.rolling(codes, min(winnow.GRAM, len(codes)))]
    span, out = min(winnow.SPAN, len(grams)), []
    for s in range(len(grams) - span + 1):
        at = max((j for j in range(s, s + span)), key=lambda j: (-grams[j], j))
        if not out or out[-1][1] != at:
            out.append((grams[at], at))
    return out


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab cé😀", max_size=400))
def test_winnowing_by_definition(text):
    h, p = winnow.winnow(text)
    assert list(zip(h.tolist(), p.tolist())) == plain_picks(text)


def test_winnowing_in_pieces_and_guarantee(monkeypatch):
    rng = random.Random(9)
    text = prose(rng, 3000)
    whole = winnow.winnow(text)
    monkeypatch.setattr(winnow, "PIECE", 1000)
    assert all((a == b).all() for a, b in zip(whole, winnow.winnow(text)))
    passage = prose(rng, 100)[:winnow.GRAM + winnow.SPAN - 1]
    a, b = prose(rng, 50) + passage + prose(rng, 50), prose(rng, 70) + passage + prose(rng, 9)
    assert set(winnow.winnow(a)[0].tolist()) & set(winnow.winnow(b)[0].tolist())


def test_short_texts_share_hashes_with_their_edited_texts():
    rng = random.Random(11)
    for n in range(30, 101):
        t, other = prose(rng, 60)[:n], "".join(rng.choice("äöüßéñ") for _ in range(n))
        new = t[:n - n // 3] + other[:n // 3]
        assert set(winnow.winnow(t)[0].tolist()) & set(winnow.winnow(new)[0].tolist()), n
    passage = prose(rng, 40)[:20]
    a, b = prose(rng, 500, 90) + passage + prose(rng, 500, 90), "é" * 3000 + passage + "ü" * 3000
    assert set(winnow.winnow(a)[0].tolist()) & set(winnow.winnow(b)[0].tolist())


def test_fingerprints_follow_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BLOCK_BYTES", 2000)
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in rng.sample(range(10 ** 6), 60)] + [(7, None), (8, ""), (9, "ab"), (10, "äöü😀x")]
    got = {r.doc_id: r for r in winnow.compared(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        new = t[:len(t) - len(t) // 3] + n[:len(t) // 3]
        a, b, c = ({h for h, _ in plain_picks(x)} for x in (t, new, n))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (pytest.approx(like(a, b)), pytest.approx(like(a, c)))
        assert len(base64.b64decode(r.fingerprint)) == 6 * len(plain_picks(t))
    lone = winnow.compared(docs(spark, [(5, "abcdef")])).collect()
    assert [(r.doc_id, r.near_next) for r in lone] == [(5, 1.0)]
    assert winnow.compared(docs(spark, rows).limit(0)).count() == 0
    ties = winnow.compared(docs(spark, [(None, "x"), (None, "y"), (1, "a"), (1, "b")])).collect()
    assert len(ties) == 4
    assert winnow.fingerprints(docs(spark, rows)).count() == len(rows)


# ---- 6: archives --------------------------------------------------------------------------------------------------------------
def test_archives_round_trip(spark):
    rng = random.Random(11)
    pages = [(i, f"http://h/{i}", rng.choice(["", "same", "x" * 50, prose(rng, 40), "é" * 33])) for i in range(120)]
    pages += [(200, None, None), (201, "http://a\r\nb: c", "\r\n\r\nWARC/1.1\r\n"), (202, "u", "x" * 50), (202, "u", "x" * 50)]
    df = spark.createDataFrame([(i, u, h, "d", "r") for i, u, h in pages], "page_id long, url string, html string, digest string, record string")
    chunks = warc.write(df, chunk=16)
    got = sorted(tuple(r) for r in warc.read(chunks).select("page", "bytes", "digest", "kind", "refers").collect())
    want = []
    for i, _, h in pages:
        top = max(j for j, _, x in pages if (x or "") == (h or ""))
        body = (h or "").encode()
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert sorted(got, key=str) == sorted(want, key=str)
    rows = chunks.orderBy("archive", F.split("record", "-")[1].cast("int"), "chunk_no").collect()
    assert max(len(r["bytes"]) - r.head - r.tail for r in rows) <= 16
    whole = b"".join(bytes(r["bytes"]) for r in rows)
    assert whole.count(b"WARC-Record-ID:") == len(pages)
    bad = chunks.withColumn("bytes", F.when(F.col("chunk_no") == 1, F.encode(F.lit("damaged"), "UTF-8")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="damaged"):
        warc.read(bad).collect()
    few = warc.read(warc.write(df, least_bytes=10)).collect()
    assert all(r.kind == "response" for r in few if r.bytes < 10)
    assert warc.read(warc.write(df.limit(0))).count() == 0


# ---- 7: repeated passages -----------------------------------------------------------------------------------------------------
def plain_kept(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[s:s + 35]) for w in words for s in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - 34):
            if seen[tuple(w[s:s + 35])] > 1:
                gone |= set(range(s, s + 35))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("flush", [500, 4 << 20])
def test_repeated_passages_equal_all_windows(spark, monkeypatch, flush):
    monkeypatch.setattr(substring, "FLUSH", flush)
    rng = random.Random(12)
    passages = [prose(rng, n) for n in (34, 35, 36, 52, 53, 90)]
    rows = [(1, None), (2, ""), (3, "x " * 200), (4, "ab " * 34), (5, prose(rng, 6000))]
    for i in range(10, 60):
        rows.append((i, " ".join([prose(rng, rng.randrange(0, 50)), rng.choice(passages), prose(rng, rng.randrange(0, 40)), rng.choice(passages)])))
    rows += [rows[20], (None, rows[21][1]), (61, rows[22][1].replace(" ", "\n\t"))]
    got = substring.remove_repeats(docs(spark, rows), carry=("key", "kept", "n"))
    assert got.columns == ["doc_id", "kept", "n_words", "n_removed", "spans", "key", "kept", "n"]
    out = sorted(((r[0], r[1], r[2], r[3]) for r in got.collect()), key=str)
    assert out == plain_kept(rows)
    assert substring.remove_repeats(docs(spark, rows).limit(0)).count() == 0


# ---- 8: URL filters -----------------------------------------------------------------------------------------------------------
def test_url_rules_and_terms(spark):
    cases = [(1, None, "", "", None, "allow"), (2, "no scheme casino", "", "", None, "block"), (3, "https://WWW.Example.com/en/a?q#f", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
             (4, "http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"), (5, "http://example.com?x=/en/", "example.com", "", None, "allow"),
             (6, "http://a.net/es/", "a.net", "/es/", "net/es/", "block"), (7, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
             (8, "http://x.org/casinos", "x.org", "/casinos", None, "allow"), (9, "http://x.org/free-bets", "x.org", "/free-bets", None, "block"),
             (10, "http://x.org/free/free", "x.org", "/free/free", None, "allow"), (11, "a://b://c/d", "b:", "//c/d", None, "allow"), (11, "http://casino.com/", "casino.com", "/", "com/", "allow")]
    df = spark.createDataFrame([(c[0], c[1], "h", "p") for c in cases], "page_id long, url string, host string, path string")
    got = sorted(tuple(r)[:5] for r in urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect())
    assert sorted(got, key=str) == sorted(((c[0], *c[2:]) for c in cases), key=str)
    assert urls.judge(df.limit(0)).count() == 0


# ---- 10: byte-level BPE -------------------------------------------------------------------------------------------------------
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_bpe_equals_the_library(text):
    c = bpe.coder(RAW, public_tokenizers.PATTERN)
    [ids] = c.encode([text])
    assert np.frombuffer(ids, dtype="<u4").tolist() == library_cached().encode_ordinary(text)
    assert c.decode(ids) == text.encode()


_library = []


def library_cached():
    if not _library:
        _library.append(library())
    return _library[0]


def test_bpe_trees_agree_on_any_length():
    rng, c = random.Random(13), bpe.coder(RAW, public_tokenizers.PATTERN)
    for n in [1, 2, 3, 7, 8, 9, 31, 63, 64, 65, 100, 700]:
        for _ in range(4):
            piece = bytes(rng.choice(b"thering") for _ in range(n))
            one = c.ranks.merge_one(piece)
            assert b"".join(map(c.ranks.token.__getitem__, one)) == piece
            if n > 1 and n <= bpe.WIDE:
                [many] = c.ranks.merge_many([piece], 1 << (n - 1).bit_length())
                assert np.frombuffer(many, dtype="<u4").tolist() == one


def test_bpe_tables(spark):
    rows = [(1, None), (2, ""), (3, "a" * 5000), (4, "Hello world's 123  \n"), (4, "Hello world's 123  \n"), (None, "x")]
    back = bpe.decode(bpe.encode(docs(spark, rows), RAW, public_tokenizers.PATTERN), RAW, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, bytes(r.decoded).decode(), r.n) for r in back.withColumn("n", bpe.n_tokens("ids")).collect()), key=str)
    assert got == sorted(((i, t or "", len(library_cached().encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert bpe.encode(docs(spark, rows).limit(0), RAW, public_tokenizers.PATTERN).count() == 0


def test_similarity_is_a_whole_number_rule():
    assert Fraction(neardup.SIMILARITY, 100) == Fraction(3, 4)
