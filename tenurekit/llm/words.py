"""Words of many texts as 64-bit hashes, worked out over bytes without a loop over words."""

from __future__ import annotations

import functools

import numpy as np

from tenurekit.llm.common import mixed

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes hashed at once; a longer word makes its own chunk longer.
CHUNK = 1 << 20


def _table(is_word) -> bytes:
    """A byte table that lowers A-Z and turns whatever divides words into a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if is_word(b) else 32 for b in range(256))


#: Words are runs without ASCII white space.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII letters, digits and all that lies beyond ASCII.
ALPHANUMERIC = _table(lambda b: b >= 0x80 or chr(b).isascii() and chr(b).isalnum())


@functools.lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(max(CHUNK + 1, 1 << (n + 1).bit_length()))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, the empty one first; see ``substring_hash``."""
    up, _ = _powers_for(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings, the same for the same bytes wherever they stand."""
    _, down = _powers_for(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _chunk_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = codes != 32
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    return substring_hash(prefix_hashes(codes), starts, ends), starts


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each text has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - (sizes + 1)
    raw = b" ".join(texts).translate(table)
    found: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        cut = len(raw)
        if len(raw) - at > CHUNK:
            cut = raw.rfind(b" ", at, at + CHUNK)
            if cut <= at and (cut := raw.find(b" ", at + CHUNK)) < 0:
                cut = len(raw)
        h, s = _chunk_hashes(raw[at:cut])
        found.append(h)
        starts.append(s + at)
        at = cut
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at_word = np.searchsorted(np.concatenate(starts), np.append(first, len(raw) + 1))
    return np.concatenate(found), np.diff(at_word)
