import hashlib
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from conftest import SMALL
from helpers import ODD_TEXTS, no_documents, odd_documents
from tenurekit.llm import decontamination as dc
from tenurekit.llm import language, licence_templates, licences, quality
from tenurekit.llm import personal_data as pd_
from tenurekit.llm.common import held_out
from tenurekit.llm.queries import QUERIES
from tenurekit.llm.words import ALPHANUMERIC, SPACED, word_hashes
from tenurekit.llm import words as w
from pyspark.sql import functions as F

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def medium(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet")


# --- words


@pytest.mark.parametrize("table, pattern", [(SPACED, rb"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_word_hashes(table, pattern, chunk, monkeypatch):
    monkeypatch.setattr(w, "CHUNK", chunk)
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"aAbB \t\n\x00\x1f.9Z\xc3\xa9") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    hashes, counts = word_hashes(texts, table)
    lists = [re.findall(pattern, bytes(b + 32 if 65 <= b <= 90 else b for b in t)) for t in texts]
    assert counts.tolist() == [len(x) for x in lists]
    of = dict(zip([x for y in lists for x in y], hashes.tolist(), strict=True))
    assert [of[x] for y in lists for x in y] == hashes.tolist() and len(set(of.values())) == len(of)


# --- language


def test_language_of_held_out_documents(spark, medium):
    rows = language.identify(medium).join(medium.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 100
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert np.mean([r["lang_pred"] == r["lang"] for r in held if r["accepted"]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_takes_odd_rows(spark):
    rows = language.identify(odd_documents(spark)).collect()
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        text = dict(ODD_TEXTS)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert language.identify(no_documents(spark)).count() == 0
    unlabelled = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_prediction_is_not_moved_by_other_columns(spark, medium):
    plain = language.identify(medium).select("doc_id", "lang_pred", "score")
    swapped = medium.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, language.identify(swapped).select("doc_id", "lang_pred", "score").collect()))


def test_rare_languages_are_learnt(spark, medium):
    # One text in a thousand; a sample by hash alone of this size would hold none or one of them.
    words = "он она это как что для при все или так уже был год дом мир вода рука время слово город".split()
    rng = random.Random(3)
    rare = [(10_000_000 + k, " ".join(rng.choices(words, k=40)), "ru") for k in range(20)]
    common = medium.filter("lang IS NOT NULL").select("doc_id", "text", "lang")
    many = common.crossJoin(spark.range(20)).selectExpr("doc_id + 100000 * id AS doc_id", "text", "lang")
    docs = many.unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    rows = language.identify(docs, sample_rows=400).join(docs.select("doc_id", "lang").filter("lang = 'ru'"), "doc_id").collect()
    assert len(rows) == 20 and all(r["lang_pred"] == "ru" for r in rows)


def test_a_sample_is_bounded_whatever_repeats(spark):
    rows = [(k % 3, "some words here", "en") for k in range(3000)] + [(k, "quelques mots", "fr") for k in range(100, 700)]
    usable = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("order", F.xxhash64("doc_id"))
    chosen = [tuple(r) for r in language._chosen(usable, 40).collect()]
    assert len(chosen) == len(set(chosen)) <= 40
    assert {i for x, i in chosen if x == "en"} == {0, 1, 2} and sum(x == "fr" for x, _ in chosen) > 20


def test_shares_of_languages():
    assert language.shares({"a": 1000, "b": 1000, "c": 3}, 100) == {"c": 3, "b": 23 + 24, "a": 24 + 24}
    assert language.shares({"a": 2, "b": 1}, 100) == {"a": 2, "b": 1}
    assert language.shares({}, 10) == {}
    assert sum(language.shares({str(k): k + 1 for k in range(50)}, 20).values()) <= 20


# --- quality


def test_quality_of_held_out_documents(spark, medium):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = quality.score_documents(medium, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.97


def test_quality_takes_odd_rows(spark):
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0), (5, 1), (9, 0)], "doc_id long, quality int")
    for given in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = quality.score_documents(odd_documents(spark), given).collect()
        assert len(rows) == len(ODD_TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert quality.score_documents(no_documents(spark), labels).count() == 0


def test_discriminant_matches_plain_densities():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], 300)
    model = quality._discriminant(x, y, 0.0, 0.0)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)

    def density(k):
        p = z[y == k]
        c, d = np.cov(p.T, bias=True), z - p.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c))

    assert np.allclose(model.log_ratio(x), density(1) - density(0))


# --- personal data

_KINDS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and _luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, (pattern, good) in enumerate(_KINDS) for m in re.finditer(pattern, text) if good(m.group()))


def test_base_spans_of_random_texts():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice("a@.1 -+(%b4255.é)") for _ in range(rng.randint(0, 30)))
        assert pd_.base_spans(text) == plain_spans(text), text


def test_patterns_take_long_texts():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "1 " * 100_000, "a." * 100_000 + "@"):
        pd_._found(text)


def test_personal_data_of_all_documents(spark, medium):
    texts = {r["doc_id"]: r["text"] for r in medium.select("doc_id", "text").collect()}
    added = 0
    for r in pd_.personal_data(medium).collect():
        base = plain_spans(texts[r["doc_id"]] or "")
        counts = Counter(k for _, k, _ in base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(counts[k] for k in range(4))
        named = [f"{pd_.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(named) <= set(spans) and len(spans) == len(base) + r["n_added"]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        added += r["n_added"]
    assert added > 5


def test_secrets_are_added_and_masked(spark, medium):
    found = pd_.candidates(medium)
    model = pd_.fit_spans(found)
    text = 'ordinary words token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" mail me@x.example.com +1 (152) 555-8590 end'
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(pd_.redacted(model, F.col("t"))).collect()
    assert [r[0] for r in got] == ['ordinary words token = "<SECRET>" mail <EMAIL> <PHONE> end', None, ""]


@pytest.mark.parametrize("rare", [3, 12])
def test_rare_kinds_are_added_beside_a_hot_one(spark, rare):
    # Far more emails than the sample has rows.
    rows = [(k, " ".join(f"mail m{k}x{j}@host.example.com" for j in range(20))) for k in range(200)]
    secrets = [(1000 + k, f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}" end') for k in range(rare)]
    docs = spark.createDataFrame(rows + secrets, "doc_id long, text string")
    got = {r["doc_id"]: r["n_added"] for r in pd_.personal_data(docs, sample_rows=20).collect()}
    assert [got[i] for i, _ in secrets] == [1] * rare


def test_one_sampling_pass_for_all_kinds(spark, medium):
    # Without a sample smaller than the spans, nothing is drawn; copies of rows don't move the weights.
    found = pd_.candidates(medium)
    once, thrice = pd_.fit_spans(found), pd_.fit_spans(found.union(found).union(found))
    assert {k: 3 * n for k, n in once.counts.items()} == thrice.counts
    assert np.isfinite(once.weights).all()
    spans = found.selectExpr("doc_id", "explode(found) AS s").select("doc_id", "s.*")
    n = spans.filter(pd_._in_sample({(0, True): 40_000, (3, True): 10}, 20_000)).groupBy("kind", "base").count().collect()
    totals = {(r["kind"], r["base"]): r["count"] for r in spans.groupBy("kind", "base").count().collect()}
    got = {(r["kind"], r["base"]): r["count"] for r in n}
    assert set(got) <= {(0, True), (3, True)} and got[3, True] == totals[3, True]
    assert abs(got[0, True] / totals[0, True] - 0.5) < 0.2


def test_posterior_and_classifier_weigh_by_the_number_of_spans():
    weights = np.zeros((len(pd_.KINDS), 9))
    weights[4, -1] = -1.0  # the classifier speaks against, log-odds -1
    table = np.full((len(pd_.LABELERS), 2, 3), 1 / 3)
    model = lambda n: pd_.SpanModel(weights, {"secret": table}, {"secret": 1 / (1 + np.exp(-2.0))}, {"secret": n})  # posterior log-odds 2
    votes = sum(3**k for k in range(6))
    assert model(0).keep(4, [0.0] * 8, votes) and model(19).keep(4, [0.0] * 8, votes)
    assert not model(21).keep(4, [0.0] * 8, votes)


def test_reliabilities_find_a_planted_truth():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.4
    right = [0.95, 0.9, 0.8, 0.7, 0.6, 0.85]
    votes = np.stack([np.where(rng.random(20_000) < 0.2, 0, np.where((rng.random(20_000) < p) == truth, 1, -1)) for p in right], axis=1)
    codes = ((votes + 1) * 3 ** np.arange(5, -1, -1)).sum(1)
    patterns, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    posterior, table, prior = pd_.reliabilities(patterns, counts.astype(float))
    assert abs(prior - 0.4) < 0.03 and ((posterior[back] > 0.5) == truth).mean() > 0.95
    assert np.allclose(table[:, 1, 2] / (table[:, 1, 2] + table[:, 1, 0]), right, atol=0.05)


def test_personal_data_takes_odd_rows(spark):
    assert pd_.personal_data(odd_documents(spark)).count() == len(ODD_TEXTS)
    assert pd_.personal_data(no_documents(spark)).count() == 0


# --- decontamination


def plain_contamination(texts, items, window):
    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = defaultdict(set)
    for i, t in items:
        words = tokens(t)
        size = min(window, len(words))
        if i is not None and words:
            for k in range(len(words) - size + 1):
                windows[tuple(words[k : k + size])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in texts:
        words = tokens(t)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (g := tuple(words[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[g]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return Counter(out)


@pytest.mark.parametrize("chunk_bytes, block_bytes", [(1 << 20, 1 << 20), (40, 60)])
def test_contamination(spark, chunk_bytes, block_bytes):
    rng = random.Random(9)
    texts = ODD_TEXTS + [(100 + k, " ".join(rng.choice(["a", "B", "c-d", "é"]) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))) for k in range(20)]
    items += [(None, "a b c"), (21, None), (22, ""), (3, "a b"), (0, items[0][1]), (23, "the AND of, to")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = dc.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), 4, 20, chunk_bytes, block_bytes)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == plain_contamination(texts, items, 4)


def test_contamination_takes_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(odd_documents(spark), benchmark).filter("n_hit > 0 OR contaminated").count() == 0
    assert dc.contamination(no_documents(spark), spark.createDataFrame([(1, "the and")], "item_id long, text string")).count() == 0


def test_proximity(spark):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 25)))) for k in range(80)]
    index = dc.build_index(spark.createDataFrame(texts, "doc_id long, text string"), 200)
    for terms, within in ((["a", "h"], 2), (["a", "b", "c"], 4), (["d", "zz"], 9), (["e"], 1)):
        wanted = {}
        for i, t in texts:
            words = t.split()
            good = [k for k in range(len(words)) if words[k] in terms and set(terms) <= set(words[k : k + within])]
            if good:
                wanted[i] = good[0]
        found = dc.proximity_matches(index, terms, within).join(dc.indexed_documents(index), ["block", "row"])
        assert {r["doc_id"]: r["start"] for r in found.collect()} == wanted


# --- licences


def test_licences(spark):
    mit = "Words here.\nReleased under the MIT License.\nMore words"
    rows = [
        (1, "a/b/c/x.py", "nothing"), (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/y.py", mit),
        (4, "z.py", None), (5, "a/b/LICENSE.txt", "All rights reserved."), (6, "q/LICENSE", "no licence at all"), (7, None, "plain"),
        (8, "a/b2/w.py", ""), (9, "a/w", "this work is LICENSED under the gnu general public license, version 3!"), (9, "a/w", "twice"),
    ]
    files = spark.createDataFrame(rows, "file_id long, path string, text string").withColumn("own", F.lit(1)).withColumn("dir", F.lit("x"))
    got = {(r["file_id"], r["licence"], r["origin"], r["from_dir"]) for r in licences.scan(files).collect()}
    assert got == {
        (1, "Proprietary", "inherited", "a/b"), (2, "Apache-2.0", "own", "a"), (3, "MIT", "own", "a/b"), (4, None, "none", None),
        (5, "Proprietary", "own", "a/b"), (6, None, "none", None), (7, None, "none", None), (8, "Apache-2.0", "inherited", "a"),
        (9, "GPL-3.0", "own", "a"), (9, "Apache-2.0", "inherited", "a"),
    }
    assert licences.scan(files.limit(0)).count() == 0


def test_root_licence_reaches_every_directory(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c", "x"), (3, "d", "y"), (4, None, "z")]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    assert {r["licence"] for r in licences.scan(files).collect()} == {"MIT"}


def test_anchors_are_needed_for_the_least_cosine():
    inverse, other, vectors = licences.template_weights()
    anchors = set(licences.anchor_terms(vectors, licences.LEAST_COSINE))
    for weights in vectors.values():
        assert sum(v * v for t, v in weights.items() if t not in anchors) < licences.LEAST_COSINE**2


def test_licence_query_runs_no_python(spark):
    plan = QUERIES["op8_licences"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def wrapped(text, mark="", width=70):
    paragraphs = ["\n".join(mark + x for x in textwrap.wrap(p, width - len(mark))) for p in re.split(r"\n\s*\n", text)]
    return f"\n{mark}\n".join(paragraphs)


def test_whole_headers_and_licence_files(spark):
    whole = defaultdict(list)
    for name, text in licence_templates.WHOLE:
        whole[name].append(text)
    gpl3, apache = whole["GPL-3.0"], whole["Apache-2.0"]
    foundation = next(t for t in apache if t.startswith("Licensed to the Apache Software Foundation"))
    code = "\nimport os\n\n\ndef f(x):\n    return os.path.join(x, 'y')\n"
    holder = "Copyright (c) 2021, Jane Doe\nAll rights reserved.\n\n"
    texts = {
        "GPL-3.0": [wrapped(gpl3[2], "# ") + code, wrapped(gpl3[1], " * "), gpl3[0], "  GNU GENERAL PUBLIC LICENSE\n     Version 3\n\nsome words that follow"],
        "Apache-2.0": [wrapped(foundation, "// ") + code, apache[0], "\n".join(apache[0].splitlines()[:12]), wrapped(apache[1], "# ", 60)],
        "MIT": [wrapped(whole["MIT"][0]), "The MIT License (MIT)\r\n\r\n" + holder + whole["MIT"][0].replace("\n", "\r\n"), "// SPDX-License-Identifier: MIT\nint x;", "/* SPDX-License-Identifier: MIT */"],
        "BSD-3-Clause": [holder + wrapped(whole["BSD-3-Clause"][0], width=50), "# " + holder + wrapped(whole["BSD-3-Clause"][0], "# ") + code],
        "BSD-2-Clause": [holder + whole["BSD-2-Clause"][0]],
        "ISC": [wrapped(whole["ISC"][0], "; ") + code],
        "LGPL-2.1": [whole["LGPL-2.1"][0], wrapped(whole["LGPL-2.1"][1], "-- ") + code],
        "GPL-2.0": [whole["GPL-2.0"][0], "# SPDX-License-Identifier: GPL-2.0-or-later\n" + code],
        "Unlicense": [whole["Unlicense"][0]],
        "MPL-2.0": [whole["MPL-2.0"][0], wrapped(whole["MPL-2.0"][1], "# ") + code],
        "Proprietary": [holder + code],
        None: [code, "SPDX-License-Identifier: Unheard-Of-1.0", "The software was sold with a warranty and a copy of the license."],
    }
    rows = [(k, f"d{k}/x", t, name) for k, (name, t) in enumerate((n, t) for n, ts in texts.items() for t in ts)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string, wanted string")
    got = {r["file_id"]: r["licence"] for r in licences.scan(files.drop("wanted")).collect()}
    assert {(k, got[k]) for k, *_ in rows} == {(k, name) for k, _, _, name in rows}


def test_anchors_are_needed_for_whole_licences():
    vectors = licences.whole_weights()[2]
    anchors = set(licences.anchor_terms(dict(enumerate(vectors)), licences.LEAST_COSINE, licences.whole_rank))
    for weights in vectors:
        assert sum(v * v for t, v in weights.items() if t not in anchors) < licences.LEAST_COSINE**2


def plain_match(text, weights, names, skip=frozenset()):
    inverse, other, vectors = weights
    counts = Counter(t for t in re.findall("[a-z0-9]+", text) if t not in skip)
    norm = math.sqrt(sum((n * inverse.get(t, other)) ** 2 for t, n in counts.items()))
    if not norm:
        return None
    found = max((round(sum(n * inverse[t] * v.get(t, 0.0) for t, n in counts.items() if t in inverse) / norm, 6), name) for name, v in zip(names, vectors, strict=True))
    return found if found[0] >= licences.LEAST_COSINE else None


@pytest.mark.parametrize("kind", ["statement", "whole"])
def test_scores_of_random_texts_equal_plain_cosines(spark, kind):
    rng = random.Random(kind)
    if kind == "whole":
        weights, names, skip = licences.whole_weights(), [n for n, _ in licence_templates.WHOLE], licences.PROSE
        match, sources = lambda t: licences._whole_licence(t, licences.LEAST_COSINE, licence_templates.WHOLE), [t for _, t in licence_templates.WHOLE]
    else:
        inverse, other, vectors = licences.template_weights()
        weights, names, skip = (inverse, other, list(vectors.values())), list(vectors), frozenset()
        match, sources = lambda t: licences._statement_licence(t, licences.LEAST_COSINE, licences.TEMPLATES), [t for _, t in licences.TEMPLATES]
    texts = ["", "...", "unheard of"]
    for _ in range(250):
        words = re.findall("[a-z0-9]+", rng.choice(sources).lower())[: rng.choice([5, 60, 10**6])]
        words = [w if rng.random() > rng.choice([0.0, 0.1, 0.4]) else f"x{rng.randrange(20)}" for w in words] + ["more"] * rng.choice([0, 1, 9])
        rng.shuffle(words)
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["m"] and (r["m"]["score"], r["m"]["licence"]) for r in frame.select("id", match(F.col("text")).alias("m")).collect()}
    for k, text in enumerate(texts):
        wanted = plain_match(text, weights, names, skip)
        mine = got[k] if got[k] and got[k][0] >= licences.LEAST_COSINE else None
        assert (mine is None) == (wanted is None) and (mine is None or (abs(mine[0] - wanted[0]) < 2e-6 and mine[1] == wanted[1])), text[:200]
    assert sum(plain_match(t, weights, names, skip) is not None for t in texts) > 30


def test_licences_of_many_paragraphs_inside_files_and_very_long_texts(spark):
    mpl = next(t for n, t in licence_templates.WHOLE if n == "MPL-2.0")
    code = "\n\n".join(f"x{k} = f{k}(y{k})" for k in range(2000))
    different = " ".join(f"w{k}" for k in range(1_000_000))
    rows = [(1, code + "\n\n" + mpl + "\n\n" + code), (2, different + " gnu licence mozilla"), (3, different + ".\nReleased under the MIT License.\n" + different)]
    got = {r["id"]: r["own"] and r["own"]["licence"] for r in spark.createDataFrame(rows, "id int, text string").select("id", licences.own_licence(F.col("text")).alias("own")).collect()}
    assert mpl.count("\n\n") > licences.RUN and got == {1: "MPL-2.0", 2: None, 3: "MIT"}


# --- pipeline


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == docs.columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() <= docs.count()
        before, docs = docs, out
    text = {r["doc_id"] for r in before.select("doc_id").collect()}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == text
    direct = corpus_pipeline.run(spark, SMALL)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert Counter(map(tuple, direct.select(*columns).collect())) == Counter(map(tuple, docs.select(*columns).collect()))


def test_stage_decisions(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    good = QUERIES["op5_quality"](spark, MEDIUM).filter("predicted = 1")
    assert ids(corpus_pipeline.quality(spark, docs, MEDIUM)) == ids(good)
    assert ids(corpus_pipeline.near_dedup(spark, docs, MEDIUM)) == ids(QUERIES["op6_near_duplicates"](spark, MEDIUM).filter("kept"))
    assert ids(corpus_pipeline.decontamination(spark, docs, MEDIUM)) == ids(QUERIES["op9_decontamination"](spark, MEDIUM).filter("NOT contaminated"))
    clean = corpus_pipeline.personal_data(spark, docs, MEDIUM).collect()
    assert all(not plain_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in clean)


def test_stages_take_odd_rows(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()
    kept = corpus_pipeline.near_dedup(spark, odd_documents(spark), SMALL).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([1, 2, 3, 4, 5, None, 7, 8, 9, 10])
