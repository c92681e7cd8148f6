"""Words under the two public vocabularies that split at spaces, many in one call.

A unit is a string without spaces that has a space before it. Neither vocabulary has a token that goes on past a space
within a text, so units are encoded joined by spaces, and the tokens that begin with a space tell them apart again.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np


def default_paths() -> tuple[str, str]:
    """The public byte-level vocabulary as ranks, and that of pieces with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Coders:
    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_ = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.byte_tokens = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.byte_tokens[k] = token
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        odd = [self.pieces.is_control(k) or self.pieces.is_unknown(k) for k in range(len(names))]
        self.piece_tokens = [b"" if o else bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) else p.replace("\u2581", " ").encode() for k, (p, o) in enumerate(zip(names, odd))]
        self._opens = [np.array([t[:1] == b" " for t in table]) for table in (self.byte_tokens, self.piece_tokens)]

    def one(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids of a string with a space before it, whatever is in it."""
        return self.bytes_.encode_ordinary(" " + unit), self.pieces.encode(unit)

    def __call__(self, text: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids and n+1 bounds, under either vocabulary, of units joined by spaces. Units are not empty, and neither begin
        nor end with white space of another kind."""
        n = text.count(" ") + 1
        both = [np.array(x, np.int64) for x in self.one(text)]
        starts = [np.flatnonzero(opens[ids]) for opens, ids in zip(self._opens, both)]
        if any(len(s) != n for s in starts):  # a unit holds the mark that stands for a space among pieces
            singly = list(zip(*[self.one(u) for u in text.split(" ")]))
            sizes = [np.array([len(x) for x in xs], np.int64) for xs in singly]
            return tuple((np.array([i for x in xs for i in x], np.int64), np.append(0, np.cumsum(size))) for xs, size in zip(singly, sizes))
        return tuple((ids, np.append(s, len(ids))) for ids, s in zip(both, starts))


@cache
def coders(byte_path: str, piece_path: str) -> Coders:
    """One for each Python worker."""
    return Coders(byte_path, piece_path)
