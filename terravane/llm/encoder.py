"""Exact whole-text token ids at the speed of a word cache."""

from __future__ import annotations

import re
import struct

import numpy as np

from terravane.llm import common

#: Python, but not the tokenizer, takes these for white space.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The pre-tokenizer's pattern, for printable lower-case ASCII.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Encodes texts with the tokenizers library, remembering the ids of words and of their pieces.

    For vocabularies whose pre-tokenizer drops white space and never joins characters across it (such as
    ``word_bpe_49k.json``): the ids of a text are those of its white-space separated words one after another.
    A new word goes through the library's normalizer, pre-tokenizer and model; plain ASCII words are
    split by the same pattern here. Both caches are bounded and start anew when full.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tok, self.limit, self.words, self.pieces = Tokenizer.from_file(path), limit, {}, {}
        self.size = self.tok.get_vocab_size()
        self.model, self.norm, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        #: Letters of Latin-1 as the byte-level pre-tokenizer spells them.
        self.latin = {c: self.pre.pre_tokenize_str(chr(c))[0][0] for c in range(0xAA, 0x100) if chr(c).isalpha()}

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str, mapped: str | None = None) -> bytes:
        ids = [t.id for t in self.model.tokenize(mapped or piece)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.pieces) >= self.limit // 2:
            self.pieces.clear()
        self.pieces[piece] = out
        return out

    def letters(self, word: str) -> bytes:
        """A word of Latin-1 letters: normal already, but for its case, and one piece."""
        low = word.lower()
        return self.pieces.get(low) or self.piece(low, low if low.isascii() else low.translate(self.latin))

    def word(self, word: str) -> bytes:
        if "<|" in word or len(word) > 1000:  # special tokens; very long words are not kept
            return self.plain(word)
        if word.isalpha() and max(word) <= "\xff":
            return self.letters(word)
        if word[-1] in ".,!#" and word[:-1].isalpha() and max(word) <= "\xff":
            return self.letters(word[:-1]) + (self.pieces.get(word[-1]) or self.piece(word[-1]))
        if word.isascii() and word.isprintable():
            pieces = _PIECES.findall(word.lower())
        else:
            pieces = [p for p, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(word))]
        # Pieces from the pre-tokenizer are in its byte alphabet, where a letter such as \xe9 stands for a byte: a cache of their own.
        get = self.pieces.get if word.isascii() else lambda p: None
        return b"".join([get(p) or (self.piece(p) if word.isascii() else self.raw(p)) for p in pieces])

    def raw(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(c in text for c in _ODD):
            return self.plain(text)
        parts, words = text.split(), self.words
        ids = list(map(words.get, parts))
        if None in ids:
            if len(words) >= self.limit:
                words.clear()
            i = -1
            try:
                while True:
                    i = ids.index(None, i + 1)
                    word = parts[i]
                    ids[i] = words.get(word) or self.word(word)
                    if len(word) <= 1000:
                        words[word] = ids[i]
            except ValueError:
                pass
        return b"".join(ids)


_OPEN: dict[str, WordEncoder] = {}
common.KEPT["tokens"] = _OPEN.clear


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept warm from task to task."""
    common.claim("tokens")
    if path not in _OPEN:
        _OPEN[path] = WordEncoder(path)
    return _OPEN[path]
