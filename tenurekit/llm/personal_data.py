"""Personal data in whole texts: fixed patterns, and spans that weak labelers agree on.

Base spans follow fixed patterns and always stay. Beside them, looser patterns propose further spans:
secrets, numbers that just miss a check, addresses spelled out. Regular expressions, gazetteers, context
and checks vote on every proposed span, for, against or not at all. Expectation maximisation over the
counts of vote patterns, which are few however large the corpus, estimates how reliable each labeler is
for each kind. Its posteriors train a logistic classifier of span features on bounded samples of the base and
of the proposed spans of each kind, weighted to their numbers. Which proposed spans are added is decided by the
log-odds of classifier and posterior together: the posterior weighs as much as ``PRIOR_ROWS`` spans, the
classifier as much as the kind has spans, so rare kinds lean on the votes and frequent ones on the features.

All patterns run in time proportional to the text. Positions are code points, ends exclusive.

Defined cases: null and empty texts have no spans; spans of different kinds may overlap, but an added
span inside a base span is dropped; repeated rows and ids are judged each on its own; a corpus without
proposed spans adds nothing; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tenurekit.llm.common import id_and_text, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Most spans learnt from, of each kind, base and proposed ones apart.
SAMPLE_ROWS = 50_000
#: So many spans' worth of trust in the posterior of the votes against the classifier.
PRIOR_ROWS = 10
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>"}
Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LONG_WORD = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{2,63}+)+", re.I)
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Words near a span that speak for its kind, or against any personal data.
_FOR = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "addr", "login", "client"),
    "card": ("card", "visa", "master", "amex", "credit", "debit", "pay", "account"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "cell", "whatsapp"),
    "secret": ("token", "secret", "passw", "api", "key", "auth", "bearer", "credential"),
}
_AGAINST = ("version", "isbn", "issn", "order", "invoice", "article", "page", "figure", "sha", "commit", "checksum", "digest", "serial", "doi")
#: Name endings of mail hosts, first digits of card issuers, calling codes.
_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
LABELERS = ("pattern", "check", "gazetteer", "context", "against", "spread")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, number of the kind, end) of what the fixed patterns find, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(s, 1, e) for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def proposed_spans(text: str, base: list[Span]) -> list[Span]:
    """Further spans that the looser patterns propose, none inside a base span."""
    found: list[Span] = []
    low = text.lower() if "(" in text or "[" in text else ""
    if "(at)" in low or "[at]" in low:
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and not luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    for m in _LONG_WORD.finditer(text):
        word = m.group()
        if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            found.append((m.start(), 4, m.end()))
    taken = np.array([(s, e) for s, _, e in base], np.int64).reshape(-1, 2)
    return sorted(x for x in found if not len(taken) or not ((taken[:, 0] <= x[0]) & (taken[:, 1] >= x[2])).any())


def _entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def votes_and_features(text: str, span: Span, is_base: bool) -> tuple[int, list[float]]:
    """The votes of all labelers as one number, base 3, and the span's features."""
    start, kind, end = span
    body = text[start:end]
    digits = _NOT_DIGIT.sub("", body)
    name = KINDS[kind]
    left, right = text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    around = f"{left} {right}"
    spread = _entropy(digits if kind in (1, 2, 3) and digits else body)
    if kind == 0:
        gazetteer = body.lower().rstrip(".").rpartition(".")[2].strip(" )]") in _ENDINGS
        check = 1 if is_base else 0
    elif kind == 1:
        gazetteer = body.startswith(("10.", "192.168.", "172."))
        check = 1 if is_base else -1
    elif kind == 2:
        gazetteer = digits.startswith(_ISSUERS)
        check = 1 if luhn(digits) else -1
    elif kind == 3:
        gazetteer = digits.startswith(_CALLING) if is_base else digits[:1] not in "01"
        check = 1 if len(digits) in (10, 11, 12) else -1
    else:
        gazetteer = body.lower().startswith(("sk-", "ghp_", "akia", "eyj", "xox")) or any(w in left[-16:] for w in _FOR["secret"])
        check = 1 if re.fullmatch(r"[0-9a-f]{16,128}|[0-9A-F]{16,128}", body) or len(body) >= 24 and spread > 4 else -1
    votes = (
        1 if is_base else 0,
        check,
        1 if gazetteer else 0 if kind in (1, 4) else -1,
        1 if any(w in around for w in _FOR[name]) else 0,
        -1 if any(w in around for w in _AGAINST) else 0,
        1 if spread >= (3 if kind in (0, 4) else 2) else -1,
    )
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    quoted = left[-1:] in "\"'`=:" and left != ""
    n = len(body)
    features = [math.log(n), len(digits) / n, sum(c.isupper() for c in body) / n, sum(not c.isalnum() for c in body) / n, spread, float(quoted), float(check), float(gazetteer)]
    return code, features


def _decoded(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 - 1 for k in range(len(LABELERS) - 1, -1, -1)], axis=1)


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, each labeler's table of votes by truth, and the prior: by EM.

    ``table[l, y, v]`` is how likely labeler l gives vote v - 1 when the truth is y. Starts from the
    majority; pseudo-counts lean to labelers that are right more often than not, which also fixes which
    of the two mirrored solutions is meant.
    """
    votes = _decoded(codes)
    lean = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])
    posterior = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    table, prior = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        for k in range(votes.shape[1]):
            for v in range(3):
                table[k, :, v] = weight[:, votes[:, k] == v - 1].sum(1) + lean[:, v]
        table /= table.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        log = np.array([math.log(1 - prior), math.log(prior)]) + sum(np.log(table[k][:, votes[:, k] + 1]).T for k in range(votes.shape[1]))
        now = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done = np.abs(now - posterior).max() < 1e-9
        posterior = now
        if done:
            break
    return posterior, table, prior


@dataclasses.dataclass
class SpanModel:
    """Weights of the span classifier, the reliabilities behind it and the number of spans, by kind.

    A kind that no span was seen of has no reliabilities; its spans stay if the votes for it outweigh those against.
    """

    weights: np.ndarray
    tables: dict[str, np.ndarray]
    priors: dict[str, float] = dataclasses.field(default_factory=dict)
    counts: dict[str, int] = dataclasses.field(default_factory=dict)
    known: dict[tuple[int, int], float] = dataclasses.field(default_factory=dict, repr=False)

    def odds(self, kind: int, votes: int) -> float:
        """Log-odds of the posterior of a vote pattern."""
        if (kind, votes) not in self.known:
            name, cast = KINDS[kind], _decoded(np.array([votes]))[0]
            if name in self.tables:
                log = np.log([1 - self.priors[name], self.priors[name]]) + sum(np.log(self.tables[name][k][:, v + 1]) for k, v in enumerate(cast))
                self.known[kind, votes] = float(log[1] - log[0])
            else:
                self.known[kind, votes] = float(cast.sum())
        return self.known[kind, votes]

    def keep(self, kind: int, features: list[float], votes: int) -> bool:
        learnt = float(self.weights[kind] @ np.array([*features, 1.0]))
        return self.counts.get(KINDS[kind], 0) * learnt + PRIOR_ROWS * self.odds(kind, votes) > 0


def _regression(x: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Penalised logistic weights for soft labels of weighted rows, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * (q * (1 - q) + 1e-3))[:, None]).T @ x + np.eye(len(beta)), x.T @ (weight * (q - p)) + beta)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


_CANDIDATES = pa.list_(
    pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("x", pa.list_(pa.float32()))])
)


def _found(text: str) -> list[dict]:
    base = base_spans(text)
    out = []
    for is_base, spans in ((True, base), (False, proposed_spans(text, base))):
        for span in spans:
            votes, x = votes_and_features(text, span, is_base)
            out.append({"start": span[0], "kind": span[1], "end": span[2], "base": is_base, "votes": votes, "x": x})
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all base and proposed spans of each document, with votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_found(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _CANDIDATES)], names=["doc_id", "found"])

    shape = "array<struct<start: int, kind: int, `end`: int, base: boolean, votes: int, x: array<float>>>"
    return id_and_text(docs).mapInArrow(run, f"doc_id long, found {shape}")


def _in_sample(totals: dict[tuple[int, bool], int], sample_rows: int) -> Column:
    """Spans whose hash lies in the share that leaves about ``sample_rows`` of their kind, base and proposed ones apart."""
    out = F.lit(False)
    for (kind, base), total in totals.items():
        share = min(1.0, sample_rows / total)
        here = (F.col("kind") == kind) & (F.col("base") == F.lit(base))
        out = out | (here & (F.pmod(F.xxhash64("doc_id", "start", "kind", "end", "x"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))))
    return out


def fit_spans(found: DataFrame, sample_rows: int = SAMPLE_ROWS) -> SpanModel:
    """Reliabilities from the vote patterns of all spans; the classifier from samples by hash, one per kind and base.

    All samples come from one pass. Equal spans fall into or out of a sample together and travel as one row with
    their number, so a sample holds about ``sample_rows`` rows however often spans are repeated.
    """
    spans = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")
    patterns = spans.groupBy("kind", "votes", "base").agg(F.count("*").alias("n")).toArrow().to_pandas()
    totals = {(int(k), bool(b)): int(n) for (k, b), n in patterns.groupby(["kind", "base"]).n.sum().items()}
    chosen = spans.filter(_in_sample(totals, sample_rows)).groupBy("kind", "base", "votes", "x").agg(F.count("*").alias("n"))
    sample = chosen.toArrow().to_pandas() if totals else None
    weights = np.zeros((len(KINDS), 9))
    tables, priors, counts = {}, {}, {}
    for kind, name in enumerate(KINDS):
        both = patterns[patterns.kind == kind]
        own = both.groupby("votes", as_index=False).n.sum().sort_values("votes")
        if own.empty:
            continue
        posterior, tables[name], priors[name] = reliabilities(own.votes.to_numpy(), own.n.to_numpy(dtype=float))
        counts[name] = int(own.n.sum())
        of = dict(zip(own.votes, posterior, strict=True))
        rows = sample[sample.kind == kind]
        if rows.empty:
            continue
        # Rows of a sample stand for all spans of its kind and base.
        drawn = rows.groupby("base").n.transform("sum")
        stands_for = rows.n / drawn * np.array([totals[kind, bool(b)] for b in rows.base])
        order = np.lexsort((rows.base, rows.votes, *np.stack(rows.x.to_numpy()).T))
        x = np.stack(rows.x.to_numpy()).astype(float)[order]
        weights[kind] = _regression(x, np.array([of[v] for v in rows.votes])[order], stands_for.to_numpy(dtype=float)[order])
    return SpanModel(weights, tables, priors, counts)


def _kept(model: SpanModel, found: list[dict]) -> list[Span]:
    return sorted((s["start"], s["kind"], s["end"]) for s in found if s["base"] or model.keep(s["kind"], s["x"], s["votes"]))


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts and digest of the base spans and the text of all spans, per document."""
    found, _ = stored(candidates(docs), "span-candidates")
    model = fit_spans(found, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                base = sorted((s["start"], s["kind"], s["end"]) for s in spans if s["base"])
                counts = Counter(k for _, k, _ in base)
                every = _kept(model, spans)
                rows.append((*(counts[k] for k in range(4)), hashlib.sha256(_text_of(base).encode()).hexdigest(), _text_of(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return found.mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind's mask; overlapping spans give one mask, the first one's."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, kind, end in sorted(spans):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([start, kind, end])
    for start, kind, end in merged:
        out += [text[at:start], MASKS[KINDS[kind]]]
        at = end
    return "".join([*out, text[at:]])


def redacted(model: SpanModel, text: Column) -> Column:
    """Whole texts with personal data masked; null stays null."""

    @arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masked(t, _kept(model, _found(t))) for t in (x.as_py() for x in texts)], pa.string())

    return mask(text.cast("string"))
