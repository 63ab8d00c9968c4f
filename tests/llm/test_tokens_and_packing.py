import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ODD_TEXTS, no_documents, odd_documents
from tenurekit.llm import token_counts as tc
from tenurekit.llm.packing import LIMIT, pack, shortest_pack_first
from tenurekit.llm.tokens import token_ids
from tenurekit.session import scratch_path


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\ta1'.é<|>endoftx \x85", max_size=60))
def test_ids_are_those_of_the_library(library, text):
    assert token_ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" * 5000, " " * 5000 + "a", "a<|endoftext|>b", "<|endoftext|>", "ab " * 3000, "\n" * 2500])
def test_ids_of_odd_texts(library, text):
    assert token_ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_text_stays_text():
    assert 50256 not in token_ids("a<|endoftext|>b", special_as_text=True).tolist()


def brute_counts(ids, separator):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == separator:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 4096])
def test_scan_of_flat_files(spark, tmp_path, block_bytes, monkeypatch):
    monkeypatch.setattr(tc, "GROUP_BLOCKS", 3)
    rng = np.random.default_rng(block_bytes)
    wanted = {}
    for name, n in (("a.tok", 0), ("b.tok", 1), ("c.tok", 257), ("d.tok", 500)):
        ids = rng.choice([5, 6, 7, 9], n, p=[0.5, 0.2, 0.2, 0.1])
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
        wanted[name] = brute_counts(ids.tolist(), 9)
    files = tc.token_files(spark, str(tmp_path))
    found = tc.stitch(tc.find_separators(files, f"file://{tmp_path}", separator=9, block_bytes=block_bytes))
    got = defaultdict(list)
    for r in found.orderBy("file", "ordinal").collect():
        assert r["ordinal"] == len(got[r["file"]])
        got[r["file"]].append((r["start"], r["n_tokens"], r["ended"]))
    assert got == {k: v for k, v in wanted.items() if v}


def test_odd_size_raises(spark, tmp_path):
    (tmp_path / "a.tok").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        tc.find_separators(tc.token_files(spark, str(tmp_path)), f"file://{tmp_path}").collect()


def test_ids_beyond_the_width_raise():
    assert tc._flat(np.array([0, 65_535]), 2) == b"\x00\x00\xff\xff"
    assert tc._flat(np.array([65_536]), 4) == b"\x00\x00\x01\x00"
    assert tc._flat(np.zeros(0, np.int64), 2) == b""
    with pytest.raises(ValueError, match="65536"):
        tc._flat(np.array([1, 65_536]), 2)


def test_folders_as_arrow_spells_them():
    assert tc._uri("s3a://bucket/a") == "s3://bucket/a" and tc._uri("s3n://bucket/a") == "s3://bucket/a"
    assert tc._uri("file:/tmp/a") == "file:///tmp/a" and tc._uri("file:///tmp/a") == "file:///tmp/a"
    assert tc._uri("hdfs://host/a") == "hdfs://host/a" and tc._uri("/tmp/s3a") == "/tmp/s3a"


def test_counts_of_documents(spark, library):
    library.encode_special_tokens = True
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tc.token_counts(odd_documents(spark), block_bytes=128).collect())
    wanted = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD_TEXTS)
    library.encode_special_tokens = False
    assert got == wanted
    assert tc.token_counts(no_documents(spark)).count() == 0


def test_files_of_failed_attempts_are_not_read(spark):
    folder = scratch_path(spark, "tokens-test")
    tc.write_token_files(odd_documents(spark), folder).count()  # its rows are lost, as those of a failed attempt
    order = tc.write_token_files(odd_documents(spark), folder).persist()
    order.count()
    committed = {r[0] for r in order.select("file").distinct().collect()}
    assert len({r[0] for r in tc.token_files(spark, folder).select("file").collect()}) > len(committed)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
@settings(max_examples=200, deadline=None)
def test_patterns_hold_every_length_once(histogram):
    found = Counter()
    for items, count in shortest_pack_first(histogram, 64):
        assert sum(items) <= 64 and count > 0
        for x in items:
            found[x] += count
    assert found == Counter(histogram)


def test_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.minimum(LIMIT, 1 + rng.exponential(300, 100_000).astype(int))
    patterns = shortest_pack_first(dict(Counter(lengths.tolist())))
    assert sum(n for _, n in patterns) * LIMIT < 1.005 * lengths.sum()


def test_one_dominant_length_fills_open_sequences():
    histogram = {n: 10 for n in range(600, 901)} | {100: 10_000}
    patterns = shortest_pack_first(histogram, 1024)
    found = Counter()
    for items, count in patterns:
        assert sum(items) <= 1024 and count > 0
        for x in items:
            found[x] += count
    assert found == Counter(histogram)
    room = sum(10 * ((1024 - n) // 100) for n in range(600, 901))
    assert sum(n for _, n in patterns) == 3010 + -(-(10_000 - room) // 10)


@pytest.mark.parametrize("limit", [64, 1024])
def test_pack(spark, library, limit):
    docs = odd_documents(spark).repartition(3)
    rows = pack(docs, limit).collect()
    wanted = Counter()
    for i, t in ODD_TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), limit):
            part = ids[s : s + limit]
            wanted[i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert pack(no_documents(spark)).count() == 0
