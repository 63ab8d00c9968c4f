"""Languages of whole texts: averaged hashed subword embeddings under a linear softmax.

Character n-grams of words, with word edges, are hashed to rows of an embedding table. A text is the
mean of its rows; a linear softmax over that mean gives the language. Table and softmax are learnt by
stochastic gradient descent in numpy from a bounded sample of texts. Half of it is dealt out evenly among the
languages, so a rare one is learnt however large the corpus, half goes by their frequencies.
Since table and softmax are linear, their product is kept: a prediction adds up one small row per n-gram.

Part of the sample is set aside to fit a temperature, so scores mean probabilities, and the lowest score
at which accepted predictions are right often enough; ``accepted`` tells which predictions pass it.

Defined cases: null texts and texts without a letter are ``und`` with score 0; texts in unknown scripts
get the likeliest learnt language and are accepted only if the score says so; without labelled texts all
are ``und``; rows without an id belong to the fold of the empty id; repeated rows count each; an empty
table gives no rows. Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.llm.common import held_out, id_and_text, slices

SAMPLE_ROWS = 3_000
BUCKETS_LOG2 = 14
WIDTH = 16
SIZES = (2, 3, 4)
EPOCHS = 6
RATE = 0.5
#: Share of accepted predictions that must be right on the texts set aside.
PRECISION = 0.99
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts as code points, everything else as 0, and where each text starts."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    return np.where(_letters()[codes], codes, 0).astype(np.uint32), np.cumsum(lengths) - lengths


def ngrams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first positions, buckets) of all n-grams of each size; inside an n-gram there are letters only."""
    blank = codes == 0
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        bad = blank[:n] & blank[size - 1 :] if size == 2 else np.zeros(n, bool)
        for k in range(1, size - 1):
            bad |= blank[k : n + k]
        hashed = np.full(n, size, np.uint32)
        for k in range(size):
            hashed = (hashed ^ codes[k : n + k]) * _FACTORS[k]
            hashed ^= hashed >> np.uint32(15)
        at = np.flatnonzero(~bad)
        yield at, (hashed[at] * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS_LOG2)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their counts."""
    codes, _ = _codes([text])
    found = [b for _, b in ngrams(codes)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@dataclasses.dataclass
class LanguageModel:
    """Product of embeddings and softmax weights by language, biases, temperature and acceptance score."""

    languages: list[str]
    product: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 1.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        codes, first = _codes(texts)
        known = np.add.reduceat(codes > 0, first) > 0 if len(first) else np.zeros(0, bool)
        sums = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for at, buckets in ngrams(codes) if self.languages else ():
            stops = np.searchsorted(at, np.append(first, len(codes)))
            rows = np.flatnonzero(np.diff(stops) > 0)
            if len(rows):
                count[rows] += np.diff(stops)[rows]
                for k in range(len(self.languages)):
                    sums[rows, k] += np.add.reduceat(self.product[k][buckets], stops[rows], dtype=np.float64)
        known &= bool(self.languages)
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if known.any():
            p = self.probabilities(sums[known] / np.maximum(1, count[known])[:, None])
            names[known] = np.array(self.languages, object)[p.argmax(1)]
            scores[known] = p.max(1)
        return names.tolist(), scores


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], aside: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> LanguageModel:
    """Learn by gradient steps, one text each, then calibrate on the texts set aside."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (1 << BUCKETS_LOG2, WIDTH))
    softmax, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    target = np.array([languages.index(x) for x in labels], np.int64)
    usable = np.array([len(b) > 0 for b, _ in bags], bool)
    learn = np.flatnonzero(usable & ~aside) if (usable & ~aside).any() else np.flatnonzero(usable)
    steps = max(1, epochs * len(learn))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            buckets, counts = bags[i]
            share = counts / counts.sum()
            mean = share @ table[buckets]
            z = mean @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            now = rate * (1 - done / steps)
            back = softmax @ p
            softmax -= now * np.outer(mean, p)
            bias -= now * p
            # Rare buckets get steps of the size of common ones: the share is raised to a half.
            table[buckets] -= now * np.outer(np.sqrt(share), back)
            done += 1
    model = LanguageModel(languages, np.ascontiguousarray((table @ softmax).T, np.float32), bias)
    _calibrate(model, bags, target, np.flatnonzero(usable & aside))
    return model


def _calibrate(model: LanguageModel, bags: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, aside: np.ndarray) -> None:
    if not len(aside):
        return
    means = np.array([model.product[:, b] @ (c / c.sum()) for b, c in (bags[i] for i in aside)])
    truth = target[aside]
    best = np.inf
    for temperature in np.geomspace(0.05, 20, 61):
        model.temperature = float(temperature)
        p = model.probabilities(means)
        # One text of doubt keeps a sample without errors from asking for certainty.
        loss = -np.log(p[np.arange(len(truth)), truth] + 1e-12).mean() - np.log(p + 1e-12).mean() / len(truth)
        if loss < best:
            best, chosen = loss, model.temperature
    model.temperature = chosen
    p = model.probabilities(means)
    order = np.argsort(-p.max(1))
    right = np.cumsum((p.argmax(1) == truth)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    model.accept = float(p.max(1)[order[good[-1]]]) if len(good) else 1.0


def shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many texts each language gives to a sample of ``total``, all it has at most.

    Half of the places are dealt out evenly, what a rare language leaves going to the others; half by frequency.
    If there are more languages than places in the even half, the most frequent ones get one each.
    """
    even, out = total - total // 2, {}
    names = sorted(counts, key=lambda x: (-counts[x], x))[:even]
    for k, name in enumerate(reversed(names)):
        out[name] = min(counts[name], even // (len(names) - k))
        even -= out[name]
    everything = sum(counts.values())
    return {x: min(counts[x], n + total // 2 * counts[x] // everything) for x, n in out.items()}


def _chosen(usable: DataFrame, sample_rows: int) -> DataFrame:
    """lang, doc_id of the sample: in each language the ids of the least hashes, at most ``sample_rows`` in all.

    Ids that a share of the hashes rules out go before anything is ordered; twice as many stay as are needed, and some more,
    so what is ordered is bounded by the sample. A repeated id counts once.
    """
    spark = usable.sparkSession
    # As many languages as the sample has places at most.
    top = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows)
    # Estimates are good to a few per cent; a language may give somewhat more than its estimate.
    counts = {r["lang"]: r["n"] + r["n"] // 8 + 1 for r in top.collect()}
    below = [(x, quota, min(1 << 30, (2 * quota + 100 << 30) // counts[x])) for x, quota in shares(counts, sample_rows).items()]
    limits = spark.createDataFrame(below, "lang string, quota int, below long")
    near = usable.join(F.broadcast(limits), "lang").filter(F.pmod("order", F.lit(1 << 30)) < F.col("below"))
    ids = near.select("lang", "quota", "doc_id", F.pmod("order", F.lit(1 << 30)).alias("rank_key")).distinct()
    ranked = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank_key", "doc_id")))
    return ranked.filter("place <= quota").select("lang", "doc_id")


def fit_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from at most ``sample_rows`` labelled texts outside the held-out fold, chosen by hash of their ids.

    The texts are shared out among the languages. An id that is repeated gives one text to a language.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("lang"), *(pa.array([f[k].astype(kind).tobytes() for f in found], pa.binary()) for k, kind in ((0, "<u2"), (1, "<u4")))],
                names=["order", "lang", "buckets", "counts"],
            )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = named.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("order", F.xxhash64("doc_id"))
    chosen = _chosen(usable.select("lang", "doc_id", "order"), sample_rows)
    texts = usable.join(F.broadcast(chosen), ["lang", "doc_id"])  # at most sample_rows ids
    sample = texts.groupBy("lang", "doc_id").agg(F.min("order").alias("order"), F.min("text").alias("text")).select("order", "lang", "text")
    rows = sample.mapInArrow(bags, "order long, lang string, buckets binary, counts binary").toArrow()
    if not rows.num_rows:
        return LanguageModel([], np.zeros((0, 1)), np.zeros(0))
    features = [(np.frombuffer(b.as_py(), "<u2"), np.frombuffer(c.as_py(), "<u4")) for b, c in zip(rows["buckets"], rows["counts"], strict=True)]
    labels = rows["lang"].to_pylist()
    order = np.lexsort((np.array(labels), rows["order"].to_numpy()))
    # Other bits than those the sample is chosen by.
    aside = (rows["order"].to_numpy()[order] >> 40) % 4 == 0
    return train([features[i] for i in order], [labels[i] for i in order], aside)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every document."""
    model = fit_languages(docs, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            lengths = [0 if n is None else n for n in pc.binary_length(texts).to_pylist()]
            for i, j in slices(lengths, 1_000_000):
                names, scores = model.predict([t or "" for t in texts.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores), pa.array((scores >= model.accept) & (np.array(names, object) != UNKNOWN))],
                    names=["doc_id", "lang_pred", "score", "accepted"],
                )

    found = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
