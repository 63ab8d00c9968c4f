import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from helpers import ODD_TEXTS, no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tenurekit.llm import lexical_search as ls
from tenurekit.llm import vector_codes as vc
from tenurekit.llm import word_repeats as wr

# --- vector codes


def plain_codes(rows, entries=256, rounds=4):
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = math.ceil(max(len(v) for _, _, v in kept) / 4)
    whole = [[math.floor(Fraction(x) * 1024) for x in list(v) + [0.0] * (4 * size - len(v))] for _, _, v in kept]
    start = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, list(kept[k][2])))[:entries]
    parts = [[w[p * size : (p + 1) * size] for w in whole] for p in range(4)]
    books = [[parts[p][k] for k in start] for p in range(4)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])) for x in parts[p]]

    for _ in range(rounds):
        for p in range(4):
            own = defaultdict(list)
            for x, (_, e) in zip(parts[p], assign(p), strict=True):
                own[e].append(x)
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[p])]
    found = [assign(p) for p in range(4)]
    codes = ["".join(f"{found[p][k][1]:02x}" for p in range(4)) for k in range(len(kept))]
    errors = [min(sum(found[p][k][0] for p in range(4)), 2**63 - 1) for k in range(len(kept))]
    by_label = Counter()
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, min(by_label[lab], 2**63 - 1), digest) for (i, lab, _), c, e in zip(kept, codes, errors, strict=True)), key=repr)


def coded(spark, rows):
    frame = spark.createDataFrame([(i, lab, v, "z", "z") for i, lab, v in rows], "vec_id long, label int, embedding array<double>, code string, error string")
    return sorted((tuple(r) for r in vc.compress(frame).collect()), key=repr)


@pytest.mark.parametrize("m", [1, 2, 8, 32])
def test_transform_scales_distances_and_orders_by_sign_changes(m):
    rng = np.random.default_rng(m)
    x, y = rng.integers(-500, 500, (2, 20, m))
    assert (((vc.walsh_hadamard(x) - vc.walsh_hadamard(y)) ** 2).sum(1) == m * ((x - y) ** 2).sum(1)).all()
    rows = vc.walsh_hadamard(np.eye(m, dtype=np.int64))[vc.sequency_order(m)]
    assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(m))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 20), st.integers(0, 18), st.sampled_from([2, 50, 10**6, 10**30]))
def test_elimination_finds_the_first_of_the_nearest(seed, n, k, width, spread):
    rng = random.Random(seed)
    parts, entries = ([[rng.randrange(-spread, spread) for _ in range(width)] for _ in range(size)] for size in (n, k))
    kind = np.int64 if spread < 10**7 else object
    best, error = vc.nearest(np.array(parts, kind).reshape(n, width), np.array(entries, kind).reshape(k, width))
    wanted = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(entries)) for x in parts]
    assert [(int(d), int(e)) for d, e in zip(error, best, strict=True)] == wanted


def test_codes_of_random_vectors(spark):
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(12)] for _ in range(40)]
    rows = [(i, rng.choice([None, 1, 2, 3]), [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(700)]
    rng.shuffle(rows)
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, None), (2, 1, [0.5, nan, 0.0, 1.0]), (3, None, [inf, 0.0, 0.0, 0.0]), (4, 2, [0.1, None, 0.2, 0.3]), (5, 2, []), (6, 2, [0.25]),
        (7, None, [0.1, -0.2, 0.3, -0.4, 0.5]), (7, None, [0.1, -0.2, 0.3, -0.4, 0.5]), (7, 3, [0.0] * 5), (None, 3, [1.0, 2.0, 3.0, 4.0, -1e-9]), (8, None, [-0.0, 0.1, 0.0, 0.0, 0.0]),
    ]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, [(i, 1, v) for i, _, v in rows[:4]]) == []
    assert coded(spark, [(5, 1, []), (6, 1, [])]) == plain_codes([(5, 1, []), (6, 1, [])])


def test_codes_of_very_large_components(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.choice([1e300, -1e250, 1e18, 3.7, -0.001]) * rng.random() for _ in range(8)]) for i in range(300)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_do_not_depend_on_partitions_and_decode(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0, v) for i, v in enumerate(rng.normal(size=(400, 16)).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    books = vc.fit_codebooks(vc.usable(frame))
    assert (books.entries == vc.fit_codebooks(vc.usable(frame.repartition(13))).entries).all()
    whole = np.floor(np.array([v for _, _, v in rows]) * 1024).astype(np.int64)
    codes, errors = books.codes(whole)
    assert (((books.decoded(codes) - whole) ** 2).sum(axis=1) == errors).all()


# --- ranked search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text):
    return re.findall(TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, n in counted:
            m = 25 + 75 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **sizes):
    frame = spark.createDataFrame([(i, t, "z", "z") for i, t in docs], "doc_id long, text string, score string, item_id string")
    wanted = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, rank string")
    index = ls.build_index(frame.repartition(3), sizes.get("block", ls.BLOCK_BYTES))
    return sorted((tuple(r) for r in ls.search(index, wanted, chunk_bytes=sizes.get("chunk", ls.CHUNK_BYTES)).collect()), key=repr)


@pytest.mark.parametrize(("block", "chunk"), [(300, 200), (1 << 20, 1 << 20)])
def test_search_equals_brute_force(spark, block, chunk):
    rng = random.Random(block)
    words = [f"W{k}" for k in range(60) for _ in range(1 + 200 // (k + 1))]
    docs = [(k % 380, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 10, 200])))) for k in range(25)] + [(3, "w1 w2"), (99, "unknown"), (98, None), (97, "w50 w50 w51")]
    assert searched(spark, docs, items, block=block, chunk=chunk) == plain_search(docs, [x for x in items if x[1] is not None])


def test_search_of_items_with_more_terms_than_a_machine_word(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randint(1, 60)))) for k in range(150)]
    items = [(1, " ".join(f"t{k}" for k in range(300))), (2, " ".join(f"t{k}" for k in range(0, 300, 2)))]
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_equal_scores_go_by_id(spark):
    docs = [(k, "same words here") for k in range(40, 0, -1)] + [(None, "same words here")] * 3 + [(k + 100, "others altogether") for k in range(60)]
    items = [(1, "same"), (2, "words same")]
    got = searched(spark, docs, items, block=40)
    assert got == plain_search(docs, items)
    assert [r[2] for r in sorted(got, key=lambda r: r[:2])][:10] == list(range(1, 11))


def test_search_takes_odd_rows(spark):
    items = [(1, "The and one äöü"), (1, "x w1 w2"), (2, ""), (3, None), (None, "日本語 one")]
    got = sorted((tuple(r) for r in ls.ranked_search(odd_documents(spark), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == plain_search(ODD_TEXTS, [x for x in items if x[1] is not None])
    assert ls.ranked_search(no_documents(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert ls.ranked_search(odd_documents(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- word repeats


def plain_repeats(rows, window=13):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = [math.inf if i is None else i for i, _ in split]
    for rank, (_, w) in zip(order, split, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, rank), rank)
    out = []
    for rank, (i, w) in zip(order, split, strict=True):
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < rank for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def repeats(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, t, "z", "z") for i, t in rows], "doc_id long, text string, block string, texts string")
    return sorted((tuple(r) for r in wr.remove_repeated_words(frame, **sizes).collect()), key=repr)


def passages(rng, n, vocabulary, ids):
    shared = [[f"s{rng.randrange(vocabulary)}" for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(shared) if rng.random() < 0.5 else [f"s{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = "changed"
        rows.append((ids(k), rng.choice([" ", "\n", " \t "]).join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("vocabulary", "block", "most"), [(3, 200, 50), (2, 3000, 7), (50, 1 << 20, 10**6)])
def test_repeats_equal_brute_force(spark, vocabulary, block, most):
    rows = passages(random.Random(vocabulary), 200, vocabulary, lambda k: 3 * k)
    assert repeats(spark, rows, block_bytes=block, most=most) == plain_repeats(rows)


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_repeated_and_missing_ids(spark, block):
    rows = passages(random.Random(block), 150, 4, lambda k: None if k % 3 == 0 else k % 20)
    assert repeats(spark, rows, block_bytes=block, most=40) == plain_repeats(rows)


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(8)
    hot = " ".join(f"h{k}" for k in range(200))
    rows = [(k, hot if k % 3 == 0 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))) for k in range(600)]
    assert repeats(spark, rows, block_bytes=4000, most=500) == plain_repeats(rows)


def test_repeats_take_odd_rows(spark):
    got = sorted((tuple(r) for r in wr.remove_repeated_words(odd_documents(spark)).collect()), key=repr)
    assert got == plain_repeats(ODD_TEXTS)
    assert wr.remove_repeated_words(no_documents(spark)).count() == 0
    kept, clear = wr.deduplicated(odd_documents(spark))
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    clear()
    assert texts[5].startswith("The and of") and texts[6] == "" and texts[None] == ""


def test_blocks_share_no_id_unless_it_is_their_only_one():
    rng = random.Random(1)
    for most in (1, 10, 40, 1000):
        ids = sorted(rng.choices(range(30), k=120)) + [None] * 50
        blocks = list(wr.cut_blocks(((i, b"abc") for i in ids), most))
        assert [i for b in blocks for i, _ in b] == ids
        for k, b in enumerate(blocks):
            own = {i for i, _ in b}
            others = {i for j, o in enumerate(blocks) if j != k for i, _ in o}
            assert len(own) == 1 or not own & others
            assert len(own) == 1 or ids[0] not in own and ids[-1] not in own


def test_groups_follow_prefixes_of_variable_length():
    counts = np.zeros(1 << 16, np.int64)
    counts[[5, 300, 301, 70 * 256 + 7]] = [10, 4, 5, 1000]
    edges = wr.group_edges(counts, 100)
    assert [int(e) for e in edges] == [0, *((70 << 56 | 7 << 48 | (k << 48) // 10) for k in range(10))]
    assert list(wr.group_edges(np.zeros(1 << 16, np.int64))) == [0]


def test_codes_pack_and_unpack():
    codes = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (wr._unpacked(wr._packed(codes)) == codes).all()
    assert len(wr._unpacked(wr._packed(codes[:0]))) == 0
