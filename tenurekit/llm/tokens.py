"""Byte-level BPE ids of whole texts, the same ids as the vocabulary's own library gives.

The public vocabulary comes in two forms: rank pairs, which a fast encoder reads, and a full
tokenizer file. Runs of thousands of characters without a cut, where the fast encoder's time grows
with the square of the run, go through the other library; both give the same ids.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

VOCABULARY = "byte_bpe_50k"
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
#: Longest piece, in characters, for the fast encoder.
LONGEST_PIECE = 2000
_SPACES = re.compile(r"\s{%d}" % LONGEST_PIECE)


def vocabulary_path(name: str) -> str:
    """A path as it is, or the place of a vocabulary file by its name on this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _fast(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _full(vocabulary: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path(f"{vocabulary}.json"))
    found.encode_special_tokens = True
    return found


def _has_long_piece(text: str) -> bool:
    if len(text) < LONGEST_PIECE:
        return False
    words = text.split()
    return max(map(len, words), default=0) >= LONGEST_PIECE or _SPACES.search(text) is not None


def _ordinary(text: str, vocabulary: str) -> np.ndarray:
    if _has_long_piece(text):
        return np.array(_full(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)
    return _fast(vocabulary).encode_to_numpy(text, disallowed_special=())


def token_ids(text: str | None, vocabulary: str = VOCABULARY, special_as_text: bool = False) -> np.ndarray:
    """Ids of a whole text. ``special_as_text``: the end-of-text string is ordinary text, else its own id."""
    if not text:
        return np.zeros(0, np.uint32)
    if special_as_text or END_OF_TEXT not in text:
        return _ordinary(text, vocabulary)
    parts: list[np.ndarray] = []
    for k, part in enumerate(text.split(END_OF_TEXT)):
        if k:
            parts.append(np.array([END_OF_TEXT_ID], np.uint32))
        if part:
            parts.append(_ordinary(part, vocabulary))
    return np.concatenate(parts)
