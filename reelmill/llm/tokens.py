"""Token ids of whole texts by a public tokenizer file; the file's path is a parameter, read by every task."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
from tokenizers import Tokenizer
from tokenizers.models import Model

from reelmill.llm.common import CACHES

CACHE = 500_000  # pieces in each of two generations of a worker's cache, about 100 MB each; where memory is shared, callers take less
KEPT = 64  # longer pieces are not kept

# How the two tokenizer files split a text before merging. Only for characters whose class no Unicode version changed.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"  # letters and numbers among them
_SPLITS = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"),
}
# Characters that stand for bytes in both files; a byte that is no visible Latin-1 character is moved up.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_MOVED = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _VISIBLE)}
_SPACE = chr(_MOVED[0x20])


class _Known(dict):
    """Ids of known pieces in two generations; a missing piece is looked up in the old one, then encoded."""

    def __init__(self, encode: Callable[[str], bytes], most: int = CACHE):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= KEPT:
            self[piece] = ids
        return ids

    def age(self) -> None:
        """A full generation becomes the old one."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as the tokenizers library gives them without special tokens.

    Texts are split into pieces; the library's model encodes a piece when it is new. Two generations of known pieces are
    kept: a full one becomes the old one, and a piece found there is taken over, so frequent pieces stay and memory is bounded
    however many pieces there are. A text with characters beyond Latin-1, or with the string of a special token, is
    encoded whole.
    """

    def __init__(self, path: str, style: str, cache: int = CACHE):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split, self.lower = _SPLITS[style], style == "word"
        self.known = _Known(partial(_encoded, self.model), cache)  # no reference to the encoder, so that both are freed at once

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self._ids(t or "") for t in texts]

    def _ids(self, text: str) -> np.ndarray:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        self.known.age()
        pieces = self.split.findall(text.lower() if self.lower else text)
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint32)


def _encoded(model: Model, piece: str) -> bytes:
    if piece.isascii() and not piece.isspace():  # of the characters that are moved only a space can occur
        seen = piece.replace(" ", _SPACE)
    else:
        seen = piece.encode().decode("latin-1").translate(_MOVED)
    return array("I", [t.id for t in model.tokenize(seen)]).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, style: str, cache: int = CACHE) -> Encoder:
    return Encoder(path, style, cache)


CACHES.append(encoder.cache_clear)
