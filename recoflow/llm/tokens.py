"""Whole-text token ids by the ``tokenizers`` library, with a word cache per worker.

A vocabulary whose pre-tokeniser never joins text across white space gives a
text the ids of its words in turn, so each distinct word is encoded once. For
``word_bpe_49k`` a word of printable ASCII and Latin-1 letters is moreover cut
into the pieces of its pre-tokeniser (which lower-cases first), and each
distinct piece is encoded once by the vocabulary's model. Other words, and words that
may hold a special token, go through the library's whole ``encode``. Tests compare
with plain ``encode``.
"""

from __future__ import annotations

import os
import re

import numpy as np

# Fixed values of the public vocabulary file word_bpe_49k.json (its pre-tokeniser pattern,
# here over lower-cased printable ASCII and Latin-1 letters):
#   's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch

CACHED = 1_200_000  # words kept (and half as many pieces); a full cache is emptied


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    spare, out = 256, []
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        out.append(chr(b if shown else spare))
        spare += not shown
    return out


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Words(dict):
    """word -> ids; a word that is not there is encoded and kept."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Encoder:
    """``encode(list of texts as bytes)`` -> list of little-endian 16-bit ids as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.model = self.library.model
        self.letters = byte_letters()
        self.words = _Words(self._word)
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token by the vocabulary's model."""
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        return np.array([t.id for t in self.model.tokenize(piece)], "<u2").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not _SIMPLE(text) or "<|" in text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        parts = []
        for p in _PIECE.findall(text.lower()):
            ids = self.pieces.get(p)
            if ids is None:
                ids = self.pieces[p] = self._piece(p)
            parts.append(ids)
        return b"".join(parts)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > CACHED:
            self.words.clear()
        if len(self.pieces) > CACHED // 2:
            self.pieces.clear()
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
