"""Token alignment, hard negatives and the rule ledger against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import align, negatives, rules
from tests.llm.test_operators import docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RAW_A, RAW_B = (align.file_bytes(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# ---- 11: alignment ------------------------------------------------------------------------------------------------------------
def plain_tokens(text):
    """(id, start, end) of both sides, or two empty lists."""
    if not text:
        return [], []
    a = Tokenizer.from_str(RAW_A.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=RAW_B)
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte = {chr(c): c for c in keep} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in keep)}
    names = {i: p for p, i in a.get_vocab().items()}
    out = []
    for pieces in ([(i, bytes(byte[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids],
                   [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]):
        if b"".join(p for _, p in pieces) != b" " + text.encode():
            return [], []
        at, side = 0, []
        for i, p in pieces:
            side.append((i, at, at + len(p)))
            at += len(p)
        out.append(side)
    return out


def plain_alignment(rows):
    links, result = {}, []
    for n, (_, text) in enumerate(rows):
        a, b = plain_tokens(text)
        links[n] = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi) for lo, hi in zip([0, *ends], ends)]
        result.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for ls in links.values() for p in ls)
    top = Counter()
    for (_, b), c in count.items():
        top[b] = max(top[b], c)
    return sorted((-1 if i is None else i, na, nb, ng, len(links[n]), sum(count[p] == top[p[1]] for p in links[n]), sum(count[p] for p in links[n]), sha)
                  for n, ((i, _), (na, nb, ng, sha)) in enumerate(zip(rows, result)))


def texts():
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  spaces\n\nand lines\t"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"), (7, "naïve café ÷ 東京 🙂🙂 ½"), (8, "▁ under ▁ bars"), (None, "no key"), (None, None)]
    rows += [(i, prose(rng, rng.randrange(1, 60)) + rng.choice([".", " Don't!", " ünï", " x"])) for i in range(10, 40)]
    return rows + [(12, rows[14][1]), (12, rows[14][1])]


def test_alignment_equals_all_pairs(spark, monkeypatch):
    rows = texts()
    for chars, piece, pairs, entries in ((align.CHARS, align.PIECE, align.SHARD_PAIRS, align.GROUP_ENTRIES), (300, 5, 64, 40)):
        for name, value in (("CHARS", chars), ("PIECE", piece), ("SHARD_PAIRS", pairs), ("GROUP_ENTRIES", entries)):
            monkeypatch.setattr(align, name, value)
        got = align.aligned_tokens(docs(spark, rows), RAW_A, RAW_B).select(F.coalesce("doc_id", F.lit(-1)), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(tuple, got)) == plain_alignment(rows)
    assert align.aligned_tokens(docs(spark, rows).limit(0), RAW_A, RAW_B).count() == 0
    assert [r.n_a for r in align.aligned_tokens(docs(spark, [(1, ""), (2, None)]), RAW_A, RAW_B).collect()] == [0, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Zé9.'’s\n\t\r\x1c<|>_ \u2003ß×½東"), max_size=40), max_size=4))
def test_texts_encoded_by_pieces_equal_whole_texts(texts):
    a = align.side(align.ByteLevel, RAW_A)
    assert a.by_piece
    assert [x.tolist() for x, _ in a.encode(texts)] == [a.coder.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_one_very_long_text_is_cut_into_pieces():
    a, b = align.side(align.ByteLevel, RAW_A), align.side(align.Pieces, RAW_B)
    text = prose(random.Random(3), 40000, 10 ** 6)
    whole, links = align.align_texts([text, "short one"], a, b, piece=1 << 30)
    cut, same = align.align_texts([text, "short one"], a, b, piece=97)
    assert whole == cut and all((links[k] == same[k]).all() for k in links)
    assert links["n"].sum() == sum(r["n_links"] for r in whole)


ends = st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.integers(1, 9))
def test_pieces_of_a_merge_give_all_overlaps(x, y, piece):
    a, b = np.array([*x, 61]), np.array([*y, 61])
    i, j = align.diagonals(a, b, piece)
    assert (np.diff(i + j)[:-1] == piece).all() and (i[-1], j[-1]) == (len(a), len(b))
    got, common = [], []
    for ia, ib, ca, cb in align.aligned(a, b, piece):
        got += zip(ia.tolist(), ib.tolist())
        common += zip(ca.tolist(), cb.tolist())
    spans = lambda e: list(zip([0, *e.tolist()], e.tolist()))
    assert sorted(got) == [(p, q) for p, (s, e) in enumerate(spans(a)) for q, (u, v) in enumerate(spans(b)) if s < v and u < e]
    assert common == [(p, q) for p, e in enumerate(a) for q, f in enumerate(b) if e == f]


# ---- 12: hard negatives -------------------------------------------------------------------------------------------------------
def plain_negatives(rows):
    good = [(i, label, [int(np.floor(256.0 * x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, own, v in sorted({g[0]: g for g in sorted(good, reverse=True) if g[0] % 100 == 0}.values()):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, label) for i, label, w in good if i != q)
        for p, i, _ in [x for x in scored if x[2] == own][:5]:
            fits = [(n, j) for n, j, label in scored if label != own and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(q, i, r, j, -p, -n) for r, (n, j) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("ASKERS", 3), ("ZONES", 5), ("GROUP", 2), ("SORT_ROWS", 200)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in (centres[i % 4] + rng.normal(size=6)).astype("float32")], int(rng.integers(0, 3))) for i in range(1500)]
    rows += [(i, rows[100][1], i % 3) for i in range(1500, 1560)]  # equal vectors: ties on both sides of a window
    rows += [(300, rows[301][1], 1), (1501, rows[100][1], 1), (1501, rows[100][1], 1)]  # repeated ids
    rows += [(1600, None, 1), (1700, [float("nan")] * 6, 1), (1800, [None] * 6, 1), (1900, rows[0][1], None), (2000, [], 2), (2100, [1.0, 2.0], 0), (None, rows[0][1], 0), (2200, [-x for x in rows[0][1]], 9)]
    df = spark.createDataFrame([(i, v, label, 1, "s", 2) for i, v, label in rows], "vec_id long, embedding array<float>, label int, id int, block string, pack int")
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_curve_visits_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = negatives.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (400, 5))
    lo, hi = rows[:100].min(axis=0)[None], rows[:100].max(axis=0)[None]
    least, most = negatives.bounds(rows, lo, hi)
    score = rows @ rows[:100].T
    assert (least[:, 0] <= score.min(axis=1)).all() and (most[:, 0] >= score.max(axis=1)).all()
    huge = np.array([[10 ** 9, -(10 ** 9)]])
    assert negatives.bounds(huge, huge, huge)[0][0, 0] == 2 * 10 ** 18  # whole numbers beyond doubles


# ---- 13: rules ----------------------------------------------------------------------------------------------------------------
def plain_measures(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    strip = [line.strip(" \t\n\v\f\r") for line in lines]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered), len(lines),
            sum(s[0] in "-*•" for s in strip), sum(s.endswith(("...", "…")) for s in strip), sum(any(c.isalpha() for c in w) for w in words), max(map(len, words), default=0))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c\n\t#…-.é 1\r", max_size=60))
def test_measures(text):
    assert rules.measure(text) == plain_measures(text)


def rule_rows():
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c a b c"), (5, "#*$ " * 60), (6, "same line\n" * 40), (None, prose(rng, 80)), (None, None), (7, prose(rng, 30000)), (7, prose(rng, 30000)), (8, "x" * 5000 + " " + prose(rng, 70))]
    rows += [(i, "\n".join(rng.choice(["- ", "", "* "]) + prose(rng, rng.randrange(1, 30), 40) + rng.choice(["", "...", "%"]) for _ in range(rng.randrange(1, 9)))) for i in range(10, 90)]
    return rows


def verdict(text, policy):
    env = dict(zip(rules.MEASURES, plain_measures(text or "")))
    failed = {r.name for r in rules.RULES if eval(r.fails, {}, env)}
    return not failed & set(policy.hard) and len(failed & set(policy.soft)) <= policy.allowed, failed


def test_ledger_policies_and_ablations(spark):
    rows = rule_rows()
    book = rules.ledger(docs(spark, rows)).cache()
    got = sorted(((-1 if r.doc_id is None else r.doc_id, *(r[m] for m in rules.MEASURES), r.failed) for r in book.collect()))
    assert got == sorted((-1 if i is None else i, *plain_measures(t or ""), rules.mask(tuple(verdict(t, rules.POLICIES[0])[1]))) for i, t in rows)
    kept = rules.verdicts(book).collect()
    for p in rules.POLICIES:
        assert Counter(r[f"keep_{p.version}"] for r in kept) == Counter(verdict(t, p)[0] for _, t in rows)
    for r in rules.ablations(book).collect():
        p = next(p for p in rules.POLICIES if p.version == r.version)
        less = rules.Policy("", tuple(n for n in p.hard if n != r.rule), tuple(n for n in p.soft if n != r.rule), p.allowed)
        seen = [(r.rule in verdict(t, p)[1], verdict(t, p)[0], verdict(t, less)[0]) for _, t in rows]
        assert (r.n_failed, r.n_alone, r.n_kept, r.n_kept_without) == (sum(f for f, _, _ in seen), sum(w and not k for _, k, w in seen), sum(k for _, k, _ in seen), sum(w for _, _, w in seen)), r
    empty = rules.ledger(docs(spark, rows).limit(0))
    assert empty.count() == 0 and all(tuple(r)[2:] == (0, 0, 0, 0) for r in rules.ablations(empty).collect())


def test_base_failure_is_never_kept(spark):
    rows = rule_rows()
    got = rules.decided(docs(spark, rows)).collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_symbols_and_letters_drop_junk_only():
    policy = next(p for p in rules.POLICIES if p.version == rules.CURRENT)
    clean = " ".join("word" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(90))
    assert verdict(clean, policy)[0] and not verdict(clean + " ###", policy)[1] & set(policy.hard)
    assert not verdict(clean + " " + "# $ % " * 20, policy)[0] and not verdict(" ".join(str(i) for i in range(99)), policy)[0]
