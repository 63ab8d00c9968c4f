"""Near copies among vectors: an epsilon grid order join.

Unit vectors with a cosine of at least c lie within epsilon = sqrt(2 - 2c) of each other. Each vector
gets leading coordinates on principal directions (from a bounded sample; any directions give right
results) and the length of what those leave over, a further valid coordinate. Vectors are sorted by the
grid cells of side epsilon that these coordinates fall in and cut into blocks, intervals of that order.
Pairs of intervals are refined level by level, from the whole order down to blocks and, inside a task,
to runs of a few vectors; a pair whose bounding boxes lie more than epsilon apart is left. Vectors of what
remains are held against each other by more such coordinates first: with the length of the rest they are unit
vectors too, and no cosine is above the product of these. Pairs that this leaves are compared by cosine in
double precision.

Blocks that follow each other make a tile. A task gets two tiles and the pairs of blocks to compare among them. Pairs of
tiles are taken in rounds in which no tile is met more than twice, so a round moves every vector twice at most, and its
shuffle files go when it ends: disk follows the vectors, not their pairs.

A task gives counts of links per vector and a spanning forest of its links, never the links themselves.
Equal vectors are one node with a number of copies, named by the vector, so rows that share an id but not
a vector go by their own.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and keep to themselves; vectors of different lengths are never compared; rows without an id link
with nothing and stay; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.common import drop, stored
from tenurekit.llm.components import components
from tenurekit.session import dropped_shuffles, scratch_path

COSINE = 0.95
LEAD = 8
SAMPLE_ROWS = 10_000
SAMPLE_BYTES = 32 << 20
BLOCK_ROWS = 1024
LEAF_ROWS = 64
#: Leading coordinates that vectors of two runs are compared by before their cosine is worked out.
FINE = 16
#: Rounding of products of those, in single precision, is far below this.
FINE_SLACK = 1e-5
#: From one pair in so many on, a run's cosines are worked out all at once.
DENSE = 32
#: Children of a node in the tree of intervals.
FAN = 16
#: Bytes of blocks in a tile, about; tiles that there are at least, if there are as many blocks.
TILE_BYTES = 8e6
LEAST_TILES = 24
#: Rounds that move no more bytes than this together go side by side.
ROUND_BYTES = 128e6
#: Lets rounding of coordinates never part a pair.
SLACK = 1e-6


def _units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _basis(units: np.ndarray, lead: int) -> np.ndarray:
    """Directions of largest variance, as columns."""
    centred = units - units.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(vectors[:, ::-1][:, :lead])


def _coordinates(units: np.ndarray, basis: np.ndarray | None, lead: int) -> np.ndarray:
    """Leading coordinates, padded with zeros, then the length of the rest."""
    if basis is None or basis.shape[0] != units.shape[1]:
        top = units[:, :lead]
    else:
        top = units @ basis[:, :lead]
    rest = np.sqrt(np.maximum(0, 1 - (top * top).sum(1)))
    return np.column_stack([top, np.zeros((len(units), lead - top.shape[1])), rest])


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Every row with whether it can link and two fingerprints of its vector."""
    kind = vectors.schema["embedding"].dataType.elementType
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    limit = F.lit(float("inf")).cast(kind)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < limit))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    return whole.select(
        "vec_id", F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("embedding").alias("print_a"),
        F.xxhash64(F.lit("second"), "embedding").alias("print_b"), F.size("embedding").alias("dimension"), "embedding",
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit_basis(heads: DataFrame, lead: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Principal directions of a sample, bounded in rows and bytes, of the most frequent vector length."""
    common = heads.groupBy("dimension").count().orderBy(F.desc("count"), "dimension").first()
    if common is None:
        return None
    rows = min(sample_rows, max(2, SAMPLE_BYTES // (8 * common["dimension"])))
    sample = heads.filter(F.col("dimension") == common["dimension"]).orderBy("print_a").limit(rows).select("embedding").toArrow()
    return _basis(_units(_matrix(sample["embedding"].combine_chunks())), lead)


def cut_blocks(heads: DataFrame, basis: np.ndarray | None, epsilon: float, lead: int = LEAD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the grid order: (part, seq), box of coordinates, ids, copies and vectors of up to ``block_rows`` rows."""
    kind = "float" if heads.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    number = np.float32 if kind == "float" else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dimension").to_numpy()
            cells = np.zeros((len(size), lead), np.int32)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                own = _matrix(batch.column("embedding").take(pa.array(rows)))
                cells[rows] = np.floor(_coordinates(_units(own), basis, lead)[:, :lead] / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=[*batch.schema.names, "cell"])

    shape = f"node long, copies long, dimension int, embedding array<{kind}>"
    # Worked out twice, for the ranges and for the rows: that costs less than a table of all vectors.
    placed = heads.select("node", "copies", "dimension", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).mapInArrow(place, f"{shape}, cell array<int>")
    order = ["dimension", *(F.col("cell")[k] for k in range(lead)), "node"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal seq
            ids, copies, raw = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            box = _coordinates(_units(raw), basis, lead)
            # Boxes of different lengths of vectors stand far apart.
            far = np.array([[8.0 * raw.shape[1]]])
            values = [part, seq, len(ids), np.append(far, box.min(0)), np.append(far, box.max(0)), ids.tobytes(), copies.tobytes(), raw.astype(number).tobytes()]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["part", "seq", "n", "low", "high", "ids", "copies", "vectors"])

        for batch in batches:
            size = batch.column("dimension").to_numpy()
            runs = np.flatnonzero(np.append(True, size[1:] != size[:-1])) if len(size) else []
            for first, last in zip(runs, [*runs[1:], len(size)], strict=True):
                at = int(first)
                while at < last:
                    if waiting and waiting[0][2].shape[1] != size[at]:
                        yield block()
                    take = min(last - at, block_rows - sum(len(w[0]) for w in waiting))
                    piece = batch.slice(at, take)
                    waiting.append((piece.column("node").to_numpy(), piece.column("copies").to_numpy(), _matrix(piece.column("embedding"))))
                    at += take
                    if sum(len(w[0]) for w in waiting) == block_rows:
                        yield block()
        if waiting:
            yield block()

    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("cell")
    return ranged.mapInArrow(cut, "part long, seq long, n long, low array<double>, high array<double>, ids binary, copies binary, vectors binary")


def _apart(epsilon: float):
    """Whether two boxes, given as lows and highs, lie more than epsilon apart."""
    gaps = F.zip_with(
        F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) > epsilon * epsilon


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with their number in the grid order as ``id``, and how many there are."""
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg((F.max("seq") + 1).alias("n")).collect()}
    bases, total = [], 0
    for part in sorted(sizes):
        bases.append((part, total))
        total += sizes[part]
    base = blocks.sparkSession.createDataFrame(bases or [(0, 0)], "part long, base long")
    numbered = blocks.join(F.broadcast(base), "part")  # a row per partition
    return numbered.withColumn("id", F.col("base") + F.col("seq")), total


def near_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (p, q), p <= q, of block numbers whose boxes come within epsilon; refined from the root down."""
    numbered, total = _numbered(blocks)
    level, _ = stored(numbered.select("id", "low", "high"), "intervals")
    levels = [level]
    width = len(level.first()["low"]) if total else 0
    while total > 1:
        up = levels[-1].groupBy(F.floor(F.col("id") / FAN).alias("id")).agg(
            F.array(*(F.min(F.col("low")[k]) for k in range(width))).alias("low"), F.array(*(F.max(F.col("high")[k]) for k in range(width))).alias("high")
        )
        levels.append(stored(up, "intervals")[0])
        total = math.ceil(total / FAN)
    pairs = levels[-1].select(F.col("id").alias("p"), F.col("id").alias("q"))
    for level in reversed(levels[:-1]):
        child = level.select("id", F.floor(F.col("id") / FAN).alias("up"), "low", "high")
        a = child.selectExpr("id AS a", "up AS p", "low AS a_low", "high AS a_high")
        b = child.selectExpr("id AS b", "up AS q", "low AS b_low", "high AS b_high")
        pairs = pairs.join(a, "p").join(b, "q").filter((F.col("a") <= F.col("b")) & ~_apart(epsilon)).selectExpr("a AS p", "b AS q")
        pairs, _ = stored(pairs, "interval-pairs")
    return pairs


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect all that the whole matrix connects."""
    rows_left = links.any(1)
    cols_left = np.ones(links.shape[1], bool)
    out_r: list[np.ndarray] = []
    out_c: list[np.ndarray] = []
    while rows_left.any():
        queue = [int(rows_left.argmax())]
        rows_left[queue[0]] = False
        while queue:
            r = queue.pop()
            cols = np.flatnonzero(links[r] & cols_left)
            cols_left[cols] = False
            out_r.append(np.full(len(cols), r))
            out_c.append(cols)
            for c in cols.tolist():
                more = np.flatnonzero(links[:, c] & rows_left)
                rows_left[more] = False
                out_r.append(more)
                out_c.append(np.full(len(more), c))
                queue += more.tolist()
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_r), np.concatenate(out_c)) if out_r else (empty, empty)


def _near_runs(box_a: np.ndarray, box_b: np.ndarray, epsilon: float) -> np.ndarray:
    """Whether the boxes of runs of ``LEAF_ROWS`` vectors come within epsilon, for all pairs of runs of two blocks."""
    starts_a, starts_b = (np.arange(0, len(x), LEAF_ROWS) for x in (box_a, box_b))
    low_a, low_b = np.minimum.reduceat(box_a, starts_a), np.minimum.reduceat(box_b, starts_b)
    high_a, high_b = np.maximum.reduceat(box_a, starts_a), np.maximum.reduceat(box_b, starts_b)
    gap = np.maximum(0, np.maximum(low_a[:, None] - high_b, low_b - high_a[:, None]))
    return (gap * gap).sum(2) <= epsilon * epsilon


def _compare(a: np.ndarray, b: np.ndarray, box_a: np.ndarray, box_b: np.ndarray, cosine: float, epsilon: float, out: np.ndarray) -> None:
    """Mark links between two blocks, run by run."""
    fine_a, fine_b = box_a.astype(np.float32), box_b.astype(np.float32)
    for start, near in zip(range(0, len(a), LEAF_ROWS), _near_runs(box_a, box_b, epsilon), strict=True):
        if not near.any():
            continue
        run = slice(start, start + LEAF_ROWS)
        cols = slice(None) if near.all() else np.flatnonzero(np.repeat(near, LEAF_ROWS)[: len(b)])
        maybe = fine_a[run] @ fine_b[cols].T >= cosine - FINE_SLACK
        n = np.count_nonzero(maybe)
        if n * DENSE >= maybe.size:
            out[run, cols] = a[run] @ b[cols].T >= cosine
        elif n:
            r, c = np.nonzero(maybe)
            r, c = r + start, c if isinstance(cols, slice) else cols[c]
            out[r, c] = np.einsum("ij,ij->i", a[r], b[c]) >= cosine


class _Tree:
    """Edges between numbered nodes, those left out that join what earlier ones joined."""

    def __init__(self, n: int):
        self.top = list(range(n))
        self.a: list[int] = []
        self.b: list[int] = []

    def _find(self, x: int) -> int:
        top = self.top
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            one, other = self._find(x), self._find(y)
            if one != other:
                self.top[one] = other
                self.a.append(x)
                self.b.append(y)


def _links_of(found: dict[int, dict], cosine: float, epsilon: float, basis: np.ndarray | None, kind: type) -> Iterator[pa.RecordBatch]:
    """Links among the blocks of two tiles, each block held against the ones it names."""
    sides, total = {}, 0
    for number, row in found.items():
        ids, copies = (np.frombuffer(row[x], np.int64) for x in ("ids", "copies"))
        units = _units(np.frombuffer(row["vectors"], kind).reshape(len(ids), -1))
        sides[number] = total, ids, copies, units, _coordinates(units, basis, FINE)
        total += len(ids)
    if not total:
        return
    counts, tree = np.zeros(total, np.int64), _Tree(total)
    for p, row in found.items():
        first_a, _, n_a, a, box_a = sides[p]
        for q in sorted(row["partners"]):
            first_b, _, n_b, b, box_b = sides[q]
            links = np.zeros((len(a), len(b)), bool)
            _compare(a, b, box_a, box_b, cosine, epsilon, links)
            if p == q:
                links |= links.T
                np.fill_diagonal(links, False)
            rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
            if not len(rows):
                continue
            links = links[np.ix_(rows, cols)]
            counts[first_a + rows] += links @ n_b[cols]
            if p != q:
                counts[first_b + cols] += links.T @ n_a[rows]
            r, c = _forest(links)
            tree.add(first_a + rows[r], first_b + cols[c])
    ids, linked = np.concatenate([side[1] for side in sides.values()]), np.flatnonzero(counts)
    if len(linked):
        a, b = np.array(tree.a, np.int64), np.array(tree.b, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[a], ids[linked]])),
                pa.array([*ids[b].tolist(), *[None] * len(linked)], pa.int64()),
                pa.array(np.concatenate([np.zeros(len(a), np.int64), counts[linked]])),
            ],
            names=["a", "b", "links"],
        )


def _rounds(pairs: DataFrame, per_tile: int, tiles: int) -> DataFrame:
    """(round, work, id, partners): blocks that a pair of tiles needs, with the blocks they are held against there.

    Tiles i <= j meet in round j - i or tiles - (j - i), whichever is less, so a round has every tile twice at most.
    """
    i, j = (F.floor(F.col(c) / per_tile) for c in "pq")
    sides = F.array(
        F.struct(F.col("p").alias("id"), F.col("q").alias("partner")), F.struct(F.col("q").alias("id"), F.lit(None).cast("long").alias("partner"))
    )
    met = pairs.select(F.least(j - i, F.lit(tiles) - (j - i)).alias("round"), (i * tiles + j).alias("work"), F.inline(sides))
    return met.groupBy("round", "work", "id").agg(F.collect_list("partner").alias("partners"))


def join_blocks(blocks: DataFrame, pairs: DataFrame, cosine: float, epsilon: float, basis: np.ndarray | None, kind: type) -> DataFrame:
    """(a, b, links): a forest edge between nodes a and b, or with b null a number of vectors that a links with.

    ``pairs`` (p, q) are numbers of blocks; the numbers of a node add up over its rows.
    """
    spark = blocks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, found = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if row["work"] != work:
                    yield from _links_of(found, cosine, epsilon, basis, kind)
                    work, found = row["work"], {}
                found[row["id"]] = row
        yield from _links_of(found, cosine, epsilon, basis, kind)

    numbered, total = _numbered(blocks)
    columns = ["ids", "copies", "vectors"]
    size = sum(F.length(c) for c in columns)
    each, largest = (1 + (x or 0) for x in blocks.agg(F.avg(size), F.max(size)).first())  # bytes of a block
    # Of vectors of unlike lengths, a tile of the longest ones takes a few times as much at most.
    per_tile = int(max(1, min(TILE_BYTES // each, 8 * TILE_BYTES // largest, -(-total // LEAST_TILES))))
    rounds, rounds_path = stored(_rounds(pairs, per_tile, max(1, -(-total // per_tile))), "rounds")
    # A row per round: half the number of tiles.
    loads = rounds.groupBy("round").agg(F.countDistinct("work").alias("works"), F.count("*").alias("rows")).orderBy("round").collect()
    most = max(2 * total, ROUND_BYTES // each)
    shape, path = "a long, b long, links long", scratch_path(spark, "vector-links")
    spark.createDataFrame([], shape).write.parquet(path)
    jobs: list[list] = []
    moved = 0
    for load in loads:
        if not jobs or moved + load["rows"] > most:
            jobs.append([])
            moved = 0
        jobs[-1].append(load)
        moved += load["rows"]
    for now in jobs:
        # Two rows per block and round at most.
        members = F.broadcast(rounds.filter(F.col("round").between(now[0]["round"], now[-1]["round"])).select("work", "id", "partners"))
        with dropped_shuffles(spark):
            dealt = numbered.select("id", *columns).join(members, "id").repartition(sum(x["works"] for x in now), "work")
            dealt.sortWithinPartitions("work", "id").mapInArrow(run, shape).write.mode("append").parquet(path)
    drop(spark, rounds_path)
    return spark.read.schema(shape).parquet(path)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, lead: int = LEAD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark, key = vectors.sparkSession, ["print_a", "print_b", "dimension"]
    # The vectors themselves are kept once: as heads, then as blocks, until they are compared.
    with dropped_shuffles(spark):
        parsed = nodes_of(vectors)
        rows, _ = stored(parsed.drop("embedding"), "vectors")
        full, full_path = stored(
            parsed.filter("usable").groupBy(key)
            .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
            .withColumn("node", F.xxhash64(*key)),
            "vector-heads",
        )
        heads, _ = stored(full.drop("embedding"), "heads")
        epsilon = math.sqrt(2 - 2 * cosine) + SLACK
        basis = fit_basis(full, max(lead, FINE))
        blocks, blocks_path = stored(cut_blocks(full, basis, epsilon, lead, block_rows), "blocks")
        drop(spark, full_path)
        kind = np.float32 if full.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
        found = join_blocks(blocks, near_blocks(blocks, epsilon), cosine, epsilon, basis, kind)
        drop(spark, blocks_path)
        counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("outer_links"))
        labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    grouped = heads.select(*key, "node", "least_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = grouped.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = (
        grouped.join(counts, "node", "left").join(least, "label")
        .select(*key, (F.coalesce("outer_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    linked = rows.filter("usable").select("vec_id", *key).join(named, key).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
