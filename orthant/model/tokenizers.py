"""Subword tokenizers over a given vocabulary: greedy word pieces and byte-level pair merging."""

from __future__ import annotations

from functools import lru_cache

import regex

_pieces = regex.compile(r"[\p{P}\p{S}]|[^\s\p{P}\p{S}]+")
# The pattern that byte-level pair vocabularies split texts by.
_byte_pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones themselves, others from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordPieces:
    """Longest match from the left. Continuations carry `##`, or word starts carry U+2581 if the vocabulary has it."""

    def __init__(self, vocab: dict[str, int], unknown: str = "[UNK]"):
        self.vocab, self.unknown = vocab, vocab.get(unknown, 0)
        self.marked = any(t.startswith("▁") for t in vocab)
        self.names = {i: t for t, i in vocab.items()}

    def _word(self, word: str) -> list[int]:
        start, out = 0, []
        text = "▁" + word if self.marked else word
        while start < len(text):
            prefix = "##" if start and not self.marked else ""
            end = next((e for e in range(len(text), start, -1) if prefix + text[start:e] in self.vocab), None)
            if end is None:
                return [self.unknown]
            out.append(self.vocab[prefix + text[start:end]])
            start = end
        return out

    def encode(self, text: str) -> list[int]:
        return [i for word in _pieces.findall(text.lower()) for i in self._word(word)]

    def decode(self, ids: list[int]) -> str:
        tokens = [self.names.get(i, "") for i in ids]
        if self.marked:
            return "".join(tokens).replace("▁", " ").strip()
        return " ".join(tokens).replace(" ##", "")


class BytePairs:
    """Byte-level BPE: ranks maps each token's bytes to its id.

    Pairs merge by their place in order if that is given, else the one of the least id first. Parts that the
    vocabulary lacks get the unknown id, if there is one.
    """

    def __init__(self, ranks: dict[bytes, int], order: dict[tuple[bytes, bytes], int] | None = None, unknown: int | None = None):
        self.ranks, self.names = ranks, {i: t for t, i in ranks.items()}
        self.order, self.unknown = order, unknown
        self._piece = lru_cache(maxsize=100_000)(self._merge)

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self._rank(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] if self.unknown is None else self.ranks.get(p, self.unknown) for p in parts)

    def _rank(self, a: bytes, b: bytes) -> int:
        return self.ranks.get(a + b, 1 << 62) if self.order is None else self.order.get((a, b), 1 << 62)

    def encode(self, text: str) -> list[int]:
        return [i for piece in _byte_pieces.findall(text) for i in self._piece(piece.encode())]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.names.get(i, b"") for i in ids).decode("utf-8", "replace")
