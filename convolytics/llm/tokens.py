"""Token ids of whole texts by a ``tokenizers`` file, through a cache of words.

A tokenizer whose pre-tokenizer drops white space encodes every run of
non-space characters by itself, so the ids of a text are the ids of its words
in order. Each task keeps a bounded cache ``word -> ids`` and asks the
tokenizer only for the words it has not seen.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterable, Iterator

# Separators that str.split() honours but a regex \s may not: such texts are
# encoded whole.
_ODD_SPACES = tuple(chr(c) for c in range(0x1C, 0x20))

# Punctuation that may end a word and is encoded apart from its letters (no
# apostrophe, which can start a contraction, and no "<" of special tokens).
_TRAILING = ".,!?;:$%&*#|"


def _byte_letters() -> dict[int, int]:
    """Byte -> letter of byte-level BPE vocabularies: printable bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class _Ids(dict):
    """word -> ids as bytes; unknown words are encoded when first asked for.
    Once ``most`` words are held, those asked for from then on stay longest."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


class WordCachedEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``max_words`` bounds each cache: beyond it the cache starts anew with the
    words in use, which changes the speed and never the ids.
    """

    def __init__(self, path: str, max_words: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # matched on the raw text, before any lower-casing, also inside words
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words = _Ids(self._word, max_words)
        self.stems = _Ids(self._direct, max_words)
        self.endings = _Ids(self._whole, max_words)
        # words of letters go straight to the model where the file's steps
        # before it are the ones known here
        self.direct = self._steps_known()

    def _steps_known(self) -> bool:
        """True if composing, lower-casing and byte letters are all that the
        tokenizer does to a word of letters before its model."""
        probe = "Ab\u00c9\u00e9\u00df\u0152\u0119Zz"
        return all(self._direct(w.lower()) == self._whole(w) for w in (probe, "A", "zaP", probe * 9))

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _direct(self, lowered: str) -> bytes:
        spelt = lowered if lowered.isascii() else lowered.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Letters of the Latin blocks with closing punctuation share the ids
        of their stem; any other word is encoded whole."""
        stem = word.rstrip(_TRAILING).lower()
        latin = stem.isalpha() and (
            stem.isascii() or (max(stem) < "\u0250" and unicodedata.is_normalized("NFC", stem))
        )
        if not (latin and self.direct):
            return self._whole(word)
        closing = len(word) - len(word.rstrip(_TRAILING))
        return self.stems[stem] + self.endings[word[-closing:]] if closing else self.stems[stem]

    def encode(self, texts: Iterable[str], tail: bytes = b"") -> Iterator[bytes]:
        """The ids of each text as bytes, each followed by ``tail``."""
        for text in texts:
            lowered = text.lower()
            if any(c in text for c in _ODD_SPACES) or any(t in lowered for t in self.added):
                yield self._whole(text) + tail
            else:
                split = (lowered if text.isascii() else text).split()
                yield b"".join(map(self.words.__getitem__, split)) + tail
