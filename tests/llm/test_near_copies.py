import contextlib
import hashlib
import math
import os
import random
import re
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ODD_TEXTS, no_documents, odd_documents
from tenurekit.llm import epsilon_join as ej
from tenurekit.llm import minhash as mh
from tenurekit.llm import suffix_index as si
from tenurekit.llm.components import components


def plain_components(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    top = {}
    for n in sorted(nodes):
        if n not in top:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in top:
                    top[x] = n
                    stack += near[x]
    return top


# --- components


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(70)], [(0, k) for k in range(1, 60)], [(5, 4), (4, 5), (9, 8), (8, 5), (3, 3)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = plain_components({x for y in links for x in y}, links)
    assert got == {n: c for n, c in wanted.items() if n != c}


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in plain_components({x for y in links for x in y}, links).items() if n != c}


# --- MinHash


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def plain_near(rows):
    sets = {i: plain_set(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    top = plain_components(set(sets), links)
    return {(i, len(sets[i]), top[i], top[i] == i) for i in sets}


def copies(rng, n_families, size, rates):
    rows = []
    for f in range(n_families):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(5, 150))]
        for k in range(size):
            rate = rng.choice(rates)
            rows.append([w if rng.random() > rate else f"x{rng.randrange(4000)}" for w in base] if k else base)
    rng.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK_NODES", block)
    rows = copies(random.Random(block), 12, 25, (0.0, 0.005, 0.02, 0.03, 0.05, 0.1))
    got = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == plain_near(rows)


def test_bridges_between_components(spark):
    # Chains in which only neighbours are near, so most links lie off the stars.
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 120])) for k in range(60)]
    got = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == plain_near(rows)


def test_rows_that_reuse_an_id_go_by_their_own_text(spark):
    one, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "uv")
    rows = [(1, one), (1, other), (2, one + " end"), (3, other + " end"), (4, "something else altogether and more")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 1, 4, True)}
    # Each text of id 5 belongs elsewhere; only one of them is an original.
    rows = [(0, one), (5, one + " end"), (5, other), (6, other + " end")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(0, 56, 0, True), (5, 57, 0, False), (5, 56, 5, True), (6, 57, 5, False)])


def test_vectors_that_reuse_an_id_keep_their_own_links(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0, 0.01]), (4, [0.0, 1.0, 0.01]), (9, [0.0, 0.0, 1.0])]
    got = Counter(tuple(r) for r in ej.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == Counter([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False), (9, 0, 9, True)])


def test_near_duplicates_take_odd_rows(spark):
    got = Counter(tuple(r) for r in mh.near_duplicates(odd_documents(spark)).collect())
    wanted = Counter()
    for i, t in ODD_TEXTS:
        top = {6: 5, None: None}.get(i, i)
        wanted[i, len(plain_set(t)), top, i == top] += 1
    assert got == wanted
    assert mh.near_duplicates(no_documents(spark)).count() == 0


def test_sketches_tell_similarities():
    rng = np.random.default_rng(8)
    for share, low, high in ((1.0, 0, 0), (0.9, 5, 60), (0.75, 35, 120), (0.3, 138, 400)):
        n = 600
        common = int(round(2 * n * share / (1 + share)))
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = base[:n], np.concatenate([base[n - common : n], base[n : 2 * n - common]])
        bits = np.bitwise_count(mh.odd_sketch(mh.minhash(a)) ^ mh.odd_sketch(mh.minhash(b))).sum()
        assert low <= bits <= high, share


# --- epsilon grid order join


def plain_vectors(rows):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    cosine = lambda x, y: x @ y / math.sqrt((x @ x) * (y @ y))
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and cosine(good[a], good[b]) >= 0.95]
    degree = Counter(x for y in links for x in y)
    top = plain_components({i for i, _ in rows if i is not None}, links)
    return {(i, degree[i], top.get(i), i == top.get(i)) for i, _ in rows}


@pytest.mark.parametrize("kind, block", [("float", 16), ("double", 16), ("float", 512)])
def test_near_vectors(spark, kind, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 12))
    found = [centres[k % 6] * (1 + k % 3) + rng.normal(size=12) * rng.choice([0.0, 0.1, 0.25, 1]) for k in range(240)]
    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in enumerate(found)]
    rows += [(900 + k, np.float32(rng.normal(size=3)).astype(float).tolist()) for k in range(60)]
    got = ej.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), block_rows=block).collect()
    assert {tuple(r) for r in got} == plain_vectors(rows)


def test_near_vectors_take_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
        (8, [2.0, 0.0]), (9, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0]), (12, [1e-30, 0.0]), (13, [3e38, 1e30]), (None, [1.0, 0.0]),
    ]
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in ej.near_vectors(df.selectExpr("*", "1 AS node", "'x' AS part", "2 AS label")).collect()} == {
        (i, n, c, (i == c)) for i, n, c, _ in plain_vectors(rows)
    }
    assert ej.near_vectors(df.limit(0)).count() == 0
    twice = ej.near_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert [tuple(r) for r in twice] == [(1, 1, 1, True)] * 2


@pytest.mark.parametrize("sizes, near", [((5, 5), 0.05), ((150, 90), 0.05), ((150, 90), 0.9), ((64, 130), 0.0)])
@pytest.mark.parametrize("directions", [True, False])
def test_blocks_are_compared_without_a_lost_link(sizes, near, directions):
    rng = np.random.default_rng(sum(sizes))
    centres = rng.normal(size=(8, 40)) * 3.0 ** -np.arange(40)
    a, b = (ej._units(np.where(rng.random((n, 1)) < near, centres[rng.integers(8, size=n)], rng.normal(size=(n, 40))) + rng.normal(size=(n, 40)) * 0.03) for n in sizes)
    basis = ej._basis(np.concatenate([a, b]), ej.FINE) if directions else None
    out = np.zeros(sizes, bool)
    epsilon = math.sqrt(2 - 2 * ej.COSINE) + ej.SLACK
    ej._compare(a, b, *(ej._coordinates(x, basis, ej.FINE) for x in (a, b)), ej.COSINE, epsilon, out)
    assert (out == (a @ b.T >= ej.COSINE)).all()


def test_few_cosines_are_worked_out_of_unlike_vectors(monkeypatch):
    """Vectors without a structure: their leading coordinates settle nearly all pairs, so cosines are worked out of few."""
    rng, worked = np.random.default_rng(4), []
    a, b = (ej._units(rng.normal(size=(512, 64))) for _ in range(2))
    a[7] = b[400]
    wide, einsum = np.einsum, lambda spec, x, y: worked.append(len(x)) or wide(spec, x, y)
    monkeypatch.setattr(np, "einsum", einsum)
    monkeypatch.setattr(ej, "DENSE", 1)
    out = np.zeros((512, 512), bool)
    basis = ej._basis(np.concatenate([a, b]), ej.FINE)
    ej._compare(a, b, *(ej._coordinates(x, basis, ej.FINE) for x in (a, b)), ej.COSINE, math.sqrt(2 - 2 * ej.COSINE), out)
    assert [tuple(x) for x in np.argwhere(out)] == [(7, 400)]
    assert 0 < sum(worked) < out.size / 100


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 100_000))
def test_forest_connects_what_links_connect(rows, columns, seed):
    links = np.random.default_rng(seed).random((rows, columns)) < 0.2
    r, c = ej._forest(links)
    assert links[r, c].all() and len(r) < rows + columns
    every = list(zip(*[x.tolist() for x in np.nonzero(links)], strict=True))
    nodes = {("r", a) for a, _ in every} | {("c", b) for _, b in every}
    join = lambda pairs: plain_components(nodes, [(("r", a), ("c", b)) for a, b in pairs])
    assert join(every) == join(list(zip(r.tolist(), c.tolist(), strict=True)))


@pytest.mark.parametrize("tile, together", [(1, 1), (3_000, 1), (3_000, 20_000), (1e9, 1e9)])
def test_rounds_meet_every_pair_once(spark, monkeypatch, tile, together):
    monkeypatch.setattr(ej, "TILE_BYTES", tile)
    monkeypatch.setattr(ej, "LEAST_TILES", 1 if tile > 1e6 else 5)
    monkeypatch.setattr(ej, "ROUND_BYTES", together)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 12))
    rows = [(i, np.float32(centres[i % 4] + rng.normal(size=12) * rng.choice([0.0, 0.2, 2])).astype(float).tolist()) for i in range(150)]
    rows += [(900 + k, np.float32(rng.normal(size=3)).astype(float).tolist()) for k in range(30)]
    got = ej.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=16).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_vectors(rows))


@pytest.mark.parametrize("per_tile", [1, 3, 10, 40])
def test_a_round_has_every_block_twice_at_most(spark, per_tile):
    every = [(p, q) for p in range(40) for q in range(p, 40)]
    found = ej._rounds(spark.createDataFrame(every, "p long, q long"), per_tile, -(-40 // per_tile)).collect()
    assert sorted((r.id, q) for r in found for q in r.partners) == every
    assert max(Counter((r["round"], r.id) for r in found).values()) <= 2
    for work in {r.work for r in found}:
        ids = {r.id for r in found if r.work == work}
        assert {q for r in found if r.work == work for q in r.partners} <= ids


def test_shuffled_vectors_do_not_grow_with_their_pairs(spark, monkeypatch):
    """Files of shuffles while vectors without a structure are compared: a few times the vectors, not blocks times blocks."""
    monkeypatch.setattr(ej, "ROUND_BYTES", 1, raising=False)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        found = {}
        for at, name in ((at, name) for folder in folders for at, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")):
            with contextlib.suppress(FileNotFoundError):
                found[name] = os.path.getsize(f"{at}/{name}")
        return found

    before, most, done = shuffled(), [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            most[0] = max(most[0], sum(size for name, size in shuffled().items() if name not in before))

    watcher, key = threading.Thread(target=watch), "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables that Spark wouldn't broadcast
    watcher.start()
    try:
        assert ej.near_vectors(df, block_rows=32).filter("n_links > 0").count() == 0
    finally:
        spark.conf.set(key, threshold)
        done.set()
        watcher.join()
    assert 0 < most[0] < 8 * 3000 * 64 * 8, most


# --- suffix arrays


def plain_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length, group, segment, batches", [(40, 2048, 1 << 20, 4), (40, 3, 700, 3), (33, 1, 1 << 20, 2), (200, 2, 1 << 20, 5)])
def test_repeats(spark, length, group, segment, batches, monkeypatch):
    monkeypatch.setattr(si, "SEGMENT", segment)
    rng = random.Random(length + group)
    bits = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 3 * length))) for _ in range(40)]
    rows = [(k, "".join(rng.choice(bits) if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(rng.randint(1, 2 * length))) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows += [(100, "ab" * 300), (101, "c" * length), (102, "d" * (length + 1)), (103, "e" * (length - 1)), (104, None), (104, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in si.remove_repeats(docs, length, batches, group).collect())
    assert got == plain_repeats(rows, length)


def test_repeats_take_odd_rows(spark):
    got = Counter(tuple(r) for r in si.remove_repeats(odd_documents(spark)).collect())
    assert got == plain_repeats(ODD_TEXTS, 200)
    assert si.remove_repeats(no_documents(spark)).count() == 0


def test_names_of_very_many_places_are_not_taken_apart_into_all_strings(spark, monkeypatch):
    made, store = Counter(), si.stored

    def counting(df, name, *rest):
        out = store(df, name, *rest)
        made[name] += out[0].count()
        return out

    monkeypatch.setattr(si, "stored", counting)
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(240))
    sides = [["".join(rng.choice("klmnopq ") for _ in range(300)) for _ in range(300)] for _ in range(2)]
    rows = [(k, a + shared + b) for k, (a, b) in enumerate(zip(*sides, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in si.remove_repeats(docs, group=16).collect())
    assert got == plain_repeats(rows, 200)
    assert made["open-places"] >= len(rows)
    # A place has strings by the dozen; few blocks of them are shared with another place.
    assert made["findings"] + made["string-blocks"] + made["strings"] < 30 * made["open-places"]


def test_levels_merge_geometrically(spark, monkeypatch):
    monkeypatch.setattr(si, "LEVEL_ROWS", 1)
    index, seen = si.SuffixIndex(), set()
    for b in range(8):
        names = list(range(100 * b, 100 * b + 64)) + ([5, 7] if b else [])
        found = {r[0] for r in index.add(spark.createDataFrame([(n,) for n in names], "name long")).collect()}
        assert found == {n for n in names if n in seen or names.count(n) > 1}
        seen |= set(names)
        assert len(index.levels) == bin(b + 1).count("1")
    index.close(spark)
