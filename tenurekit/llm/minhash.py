"""Near copies by MinHash bands, odd sketches and exact checks, as connected groups.

A document's set holds the hashes of its distinct word shingles. MinHash values go two ways: by bands
into bucket keys, and folded into an odd sketch, a parity bitmap in which each value flips one bit. The
XOR of two sketches counts values that differ, so its population count tells high similarities apart
before any set is read.

Equal sets are one node. Buckets of any size are worked on by stars: each node is first compared with
the most popular node it shares a bucket with, popular meaning large buckets, so the original of many
copies comes first. Links are confirmed on full sets and joined to components. Then only pairs of one
bucket whose components differ are left, and those whose sketches allow the similarity are confirmed
too, block by block, so no pair of a shared bucket is passed over and no group is written out as all
its pairs.

Defined cases: a text of fewer words than a shingle is one shingle; null and empty texts, and texts of
white space, have an empty set and link with nothing; documents without an id link with nothing and
stay; equal sets share the smallest id; different sets are different nodes, so rows that share an id but not
a text go by their own text; an empty table gives no rows.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.common import as_long, drop, id_and_text, mixed, stored, text_slices
from tenurekit.llm.components import components
from tenurekit.llm.words import SPACED, word_hashes

SHINGLE = 5
#: Links have at least this many hundredths of the union in common.
PERCENT = 75
BANDS = 40
ROWS = 4
SKETCH_WORDS = 16
#: Odd sketches that differ in more bits are of sets less than about 0.5 alike; at 0.75 the count lies
#: about five standard deviations below (measured: 11.8 bits).
MOST_BITS = 137

#: Nodes of one block where nodes of a bucket meet in blocks.
BLOCK_NODES = 256

_RNG = np.random.default_rng(20_240_607)
_MASKS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_FACTORS = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_SHINGLE_FACTORS = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_PLACES = np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32)
_STEP = 2048


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    hashes, counts = word_hashes(texts, SPACED)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled[: max(0, n - k)] += hashes[k:] * _SHINGLE_FACTORS[k]
    rolled = mixed(rolled)
    out = []
    for start, count in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(rolled[start : start + count - size + 1]))
        elif count:
            whole = (hashes[start : start + count] * _SHINGLE_FACTORS[:count]).sum(dtype=np.uint64)
            out.append(mixed(np.array([whole + np.uint64(count)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set that isn't empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), _STEP):
        np.minimum(best, ((low[at : at + _STEP] ^ _MASKS) * _FACTORS).min(1), out=best)
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.astype(np.uint64).reshape(BANDS, ROWS)
    return mixed((rows * _SHINGLE_FACTORS[8 : 8 + ROWS]).sum(1, dtype=np.uint64) ^ mixed(np.arange(1, BANDS + 1, dtype=np.uint64)))


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity of the values that fall on each bit."""
    bits = (mixed(values.astype(np.uint64) | _PLACES) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    parity = (np.bincount(bits, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """Per document: size and two fingerprints of its set, band keys and odd sketch (null for an empty set), a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            sizes, prints, keys, sketches = [], [], [], []
            for found in shingle_sets(texts):
                sizes.append(len(found))
                prints.append(_prints(found))
                values = minhash(found) if len(found) else None
                keys.append(None if values is None else as_long(band_keys(values)))
                sketches.append(None if values is None else as_long(odd_sketch(values)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                    batch.column(2),
                ],
                names=["doc_id", *KEY, "keys", "sketch", "text_key"],
            )

    shape = "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>, sketch array<long>, text_key long"
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, shape)


def _bits(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for k in range(1, SKETCH_WORDS):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total


def _near(a: str, b: str) -> Column:
    return _bits(F.col(a), F.col(b)) <= MOST_BITS


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have enough in common."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (one, other))
                keep.append(similar(x, y))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = sets.select("node", "set")
    both = (
        pairs.select("a", "b")
        .join(own.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        .join(own.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    )
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


#: What tells sets apart.
KEY = ("n_shingles", "print_a", "print_b")


def _named(nodes: DataFrame) -> DataFrame:
    """Nodes by the smallest id of their documents; a further set under that id by a hash, above usual ids."""
    first = F.min(F.struct(*KEY)).alias("first")
    reused, _ = stored(nodes.groupBy("least_id").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n"), "reused-ids")
    other = F.xxhash64(*KEY).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    further = F.col("first").isNotNull() & (F.struct(*KEY) != F.col("first"))
    return nodes.join(reused, "least_id", "left").withColumn("node", F.when(further, other).otherwise(F.col("least_id"))).drop("first")


def _prints(found: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set."""
    return tuple(int(as_long(x.sum(dtype=np.uint64, keepdims=True))[0]) for x in (found, mixed(found)))


def node_sets(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """node and full set, as sorted hashes in bytes, of the heads (node, least_id and what tells sets apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            nodes, sets = [], []
            wanted = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
            for node, key, found in zip(batch.column("node").to_pylist(), wanted, shingle_sets(texts), strict=True):
                # A text under the same id may be another node's.
                if key == (len(found), *_prints(found)):
                    nodes.append(node)
                    sets.append(found.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    texts = id_and_text(docs).join(heads.withColumnRenamed("least_id", "doc_id"), "doc_id")
    return texts.select("node", *KEY, "text").mapInArrow(run, "node long, set binary")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _centres(members: DataFrame) -> DataFrame:
    """Per bucket with nodes of several labels: its most popular node, and that node's label."""
    best = F.max(F.struct("popularity", (-F.col("node")).alias("minus"), "label")).alias("best")
    found = members.groupBy("key").agg(best, F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return found.select("key", (-F.col("best.minus")).alias("centre"), F.col("best.label").alias("main"), F.col("best.popularity").alias("rank"))


def bucket_members(nodes: DataFrame) -> DataFrame:
    """key, node, popularity for every node in a bucket that it shares; popularity adds up its buckets' sizes."""
    entries = nodes.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    inside, path = stored(entries.join(shared, "key"), "bucket-entries")
    popular = inside.groupBy("node").agg(F.sum("size").alias("popularity"))
    members, _ = stored(inside.join(popular, "node").select("key", "node", "popularity"), "bucket-members")
    drop(nodes.sparkSession, path)
    return members


def star_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with the most popular centre of its buckets that its sketch allows."""
    wide = nodes.select("node", "sketch")
    to_centre = members.join(_centres(_labelled(members, None)), "key").filter("node <> centre")
    return (
        to_centre.groupBy("node", "centre").agg(F.max("rank").alias("rank"))
        .join(wide, "node").withColumnRenamed("sketch", "sketch_b")
        .join(wide.select(F.col("node").alias("centre"), F.col("sketch").alias("sketch_a")), "centre")
        .filter(_near("sketch_a", "sketch_b"))
        .groupBy(F.col("node").alias("b")).agg((-F.max(F.struct("rank", (-F.col("centre")).alias("minus")))["minus"]).alias("a"))
    )


def _against_main(known: DataFrame, centres: DataFrame) -> DataFrame:
    """Groups that set a bucket's other nodes against all of its main component, both sides in blocks."""
    others = known.join(centres.select("key", "main"), "key").filter("label <> main").select("node", "label", "main").distinct()
    nodes = known.select("node", "label").distinct()
    mains = others.groupBy("main").agg(F.count("*").alias("others"))
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    strips = F.ceil(F.col("others") / (16 * BLOCK_NODES)).cast("int")
    sizes = mains.join(nodes.withColumnRenamed("label", "main"), "main").groupBy("main", "others").agg(F.count("*").alias("size"))
    sizes = sizes.select("main", blocks.alias("blocks"), strips.alias("strips"))
    held = nodes.join(sizes, nodes["label"] == sizes["main"]).select(
        F.col("main").alias("g1"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("g2"),
        F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("g3"), F.lit(0).alias("kind"), "node", "label",
    )
    asked = others.join(sizes, "main").select(
        F.col("main").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g2"),
        F.pmod(F.xxhash64("node"), F.col("strips")).cast("int").alias("g3"), F.lit(1).alias("kind"), "node", "label",
    )
    return held.unionByName(asked).withColumn("bucket", F.lit(False))


def _among_rest(known: DataFrame, centres: DataFrame) -> DataFrame:
    """Groups that set a bucket's other nodes against each other, in pairs of blocks."""
    rest = known.join(centres.select("key", "main"), "key").filter("label <> main").select("key", "node", "label")
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"), F.count("*").alias("size")).filter("size > 1")
    placed = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = placed.select(F.col("key").alias("g1"), F.col("own").alias("g2"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("g3"), F.lit(0).alias("kind"), "node", "label")
    asked = placed.select(F.col("key").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("g2"), F.col("own").alias("g3"), F.lit(1).alias("kind"), "node", "label")
    return held.unionByName(asked).withColumn("bucket", F.lit(True))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], Iterator[dict]]]:
    """(held rows, asking rows) of each group of a stream sorted by group and kind."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from batch.slice(at, 256).to_pylist()

    for _, group in itertools.groupby(rows(), key=lambda r: (r["g1"], r["g2"], r["g3"])):
        held: list[dict] = []
        for row in group:
            if row["kind"] == 1:
                yield held, itertools.chain([row], group)
                break
            held.append(row)


_GROUP_SQL = "g1 long, g2 int, g3 int, kind int, node long, label long, near array<long>"


def _near_in_groups(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Asking nodes with the held nodes that their sketches allow, and those held nodes, by group.

    In groups of a bucket a pair counts only in the smallest bucket that both nodes share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, asking in _by_group(batches):
            out: list[dict] = []
            if held:
                sketches = np.array([r["sketch"] for r in held], np.int64).view(np.uint64)
                labels, names = (np.array([r[c] for r in held], np.int64) for c in ("label", "node"))
                used: set[int] = set()
                for row in asking:
                    bits = np.bitwise_count(sketches ^ np.array(row["sketch"], np.int64).view(np.uint64)).sum(1)
                    good = (bits <= MOST_BITS) & (labels != row["label"])
                    if row["bucket"] and row["g2"] == row["g3"]:
                        good &= names < row["node"]
                    found = np.flatnonzero(good).tolist()
                    if row["bucket"] and found:
                        own = set(row["keys"])
                        found = [k for k in found if min(own.intersection(held[k]["keys"])) == row["g1"]]
                    if found:
                        used.update(found)
                        out.append({**row, "near": names[found].tolist()})
                out += [{**held[k], "near": None} for k in sorted(used)]
            else:
                collections.deque(asking, maxlen=0)
            columns = ("g1", pa.int64()), ("g2", pa.int32()), ("g3", pa.int32()), ("kind", pa.int32()), ("node", pa.int64()), ("label", pa.int64()), ("near", pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in columns], names=[c for c, _ in columns])

    wide = groups.join(nodes.select("node", "keys", "sketch"), "node").withColumn("keys", F.when(F.col("bucket"), F.col("keys")))
    order = ["g1", "g2", "g3"]
    return wide.repartition(*order).sortWithinPartitions(*order, "kind").mapInArrow(run, _GROUP_SQL)


def _linked_in_groups(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) confirmed on full sets that join what the groups' links join; pairs already joined are passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, asking in _by_group(batches):
            full = {r["node"]: (np.frombuffer(r["set"], "<u8"), r["label"]) for r in held}
            top: dict[int, int] = {}

            def root(x: int, top: dict[int, int] = top) -> int:
                while top.get(x, x) != x:
                    x = top[x]
                return x

            links = []
            for row in asking:
                own = np.frombuffer(row["set"], "<u8")
                for name in row["near"]:
                    other, label = full[name]
                    one, two = root(row["label"]), root(label)
                    if one != two and similar(own, other):
                        top[max(one, two)] = min(one, two)
                        links.append((row["node"], name))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    order = ["g1", "g2", "g3"]
    wide = near.join(sets, "node")
    return wide.repartition(*order).sortWithinPartitions(*order, "kind").mapInArrow(run, "a long, b long")


def rest_links(members: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between nodes that share a bucket but not yet a component.

    In each bucket the component of its centre is set against the other nodes, and those against each
    other. Nodes meet in blocks, so tables hold a row per node and block, never one per pair.
    """
    known, _ = stored(_labelled(members, labels), "labelled-members")
    centres, _ = stored(_centres(known), "bucket-centres")
    groups = _against_main(known, centres).unionByName(_among_rest(known, centres))
    near, _ = stored(_near_in_groups(groups, nodes), "near-in-groups")
    return _linked_in_groups(near, sets)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id, kept for every document."""
    spark = docs.sparkSession
    signed, _ = stored(signatures(docs), "signatures")
    linkable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets_by_key, _ = stored(
        linkable.groupBy(*KEY).agg(F.min_by(F.struct("keys", "sketch"), "doc_id").alias("head"), F.min("doc_id").alias("least_id"))
        .select(*KEY, "least_id", "head.keys", "head.sketch"),
        "nodes",
    )
    nodes = _named(sets_by_key)
    members = bucket_members(nodes)
    heads = nodes.select("node", "least_id", *KEY).join(members.select("node").distinct(), "node")
    sets, sets_path = stored(node_sets(docs, heads).dropDuplicates(["node"]), "node-sets")
    stars, _ = stored(star_pairs(members, nodes), "star-pairs")
    links, _ = stored(confirmed(stars, sets), "star-links")
    labels = components(links)
    more, _ = stored(rest_links(members, nodes, labels, sets), "rest-links")
    drop(spark, sets_path)
    labels = components(links.unionByName(more))
    named = nodes.select(*KEY, "node", "least_id").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "label").select(*KEY, "component_id")
    out = signed.select("doc_id", "text_key", *KEY).join(named, list(KEY), "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return grouped(docs).drop("text_key")
