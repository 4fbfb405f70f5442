"""Cached encoding of the pieces between single spaces.

For each of the three tokenizers a single space between two other characters ends a token (the
splitting pattern of the two BPE files starts a word there; no entry of the piece vocabulary holds a
space after another character, which is checked when it is loaded). So a regular text is encoded
piece by piece and equal pieces are encoded once. Any other text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cache

SPACE = "▁"
IRREGULAR = re.compile(r"\s | \s|^ | $")


class PieceCache:
    """value(ids) of pieces; forgets everything when `limit` pieces are held, so memory is bounded."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], value: Callable[[list[int]], object], limit: int = 250_000):
        self.encode_many, self.value, self.limit, self.held = encode_many, value, limit, {}

    def values(self, pieces: list[str]) -> list:
        held = self.held
        new = [p for p in dict.fromkeys(pieces) if p not in held]
        if new:
            if len(held) + len(new) > self.limit:
                self.held = held = {}
                new = [*dict.fromkeys(pieces)]
            held.update(zip(new, map(self.value, self.encode_many(new)), strict=True))
        return [held[p] for p in pieces]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def hf_tokenizer(path: str):
    """A tokenizer of the tokenizers library, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def byte_bpe(path: str):
    """Byte-level BPE of a tokenizers json, run by tiktoken, which is several times as fast.

    tiktoken merges the pair whose result has the smallest id. That is the json's order only if the
    ids of its merges rise, and only if every longer entry comes from a merge; both are checked here.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    names, special = _byte_names(), {t["content"]: t["id"] for t in read["added_tokens"]}
    vocab = read["model"]["vocab"]
    ranks = {bytes(names[c] for c in t): i for t, i in vocab.items() if t not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in read["model"]["merges"]]
    if merged != sorted(merged) or {*merged} != {i for t, i in ranks.items() if len(t) > 1}:
        raise ValueError(f"{path}: the merges aren't in the order of their ids")
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def spaced(text: str) -> list[str] | None:
    """Pieces of a regular text, each but the first with its space; None if spaces touch white space."""
    if IRREGULAR.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]
