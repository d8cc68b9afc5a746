"""Public vocabularies as encoders, kept per worker."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: How the byte-level vocabulary cuts a text before its merges: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for 256 and up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE file (tokenizers' JSON). Strings of special tokens in a text are plain text.

    Where ids rise with the merges' ranks, as in the files that this is meant for,
    tiktoken's encoder gives the same ids several times faster (a test compares both
    on all code points); other files go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab = {w: i for w, i in model["vocab"].items() if all(c in byte_of for c in w)}
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for w, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in w)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if len(vocab) == 256 + len(merged) and merged == list(range(256, 256 + len(merged))):
            import tiktoken

            ranks = {self.bytes_of[i]: i for i in vocab.values()}
            coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._encode = lambda text: coder.encode_to_numpy(text, disallowed_special=())
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self._encode = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        return self._encode(text) if text else np.zeros(0, np.uint32)


class PieceBPE:
    """A sentencepiece model with byte fallback; it puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text), np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


@lru_cache(maxsize=4)
def piece_bpe(path: str) -> PieceBPE:
    return PieceBPE(path)
