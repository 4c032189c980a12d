"""Byte-level BPE token ids of texts as arrays of 16-bit numbers."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Vocabulary file of ranks; production runs pass the path of their own.
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Id after the last rank of the 50k vocabularies: ends a document and fills the last sequence.
END_OF_TEXT = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Encodes texts with the ranks of a vocabulary file; special tokens in a text are ordinary text."""

    def __init__(self, vocab: str) -> None:
        import tiktoken

        with open(vocab, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= END_OF_TEXT:
            raise ValueError("the vocabulary doesn't leave the id that ends a document free")
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of ``text``; none for null."""
        if not text:
            return np.zeros(0, dtype="<u2")
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=())).astype("<u2")

    def text(self, ids: np.ndarray) -> str:
        """The text of ids, without ends of documents."""
        return self.encoding.decode([int(i) for i in ids if i != END_OF_TEXT])


@lru_cache(maxsize=2)
def encoder(vocab: str = DEFAULT_VOCAB) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    return Encoder(vocab)
