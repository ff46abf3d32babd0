"""Token ids of whole texts by the ``tokenizers`` library, remembering the pieces it has seen.

A text is cut only where the tokenizer's own splitting always cuts (before a space or line
break that follows a visible character), each distinct piece is encoded once by the library,
and the ids of a text are the ids of its pieces in order. The tests hold this against the
library on whole texts.
"""

from __future__ import annotations

import os
import re
from array import array

#: Pieces a worker remembers; beyond that it forgets, so memory stays bounded.
CACHE_PIECES = 1_000_000

_DOUBLE = re.compile(r"\s\s")
_AFTER_WORD = re.compile(r"(?<=\S)(?=\s)")
_LOADED: dict[tuple[str, bool], "PieceEncoder"] = {}


def encoder(path: str, keeps_space: bool) -> "PieceEncoder":
    """The encoder of a tokenizer file, once per worker process."""
    key = (path, keeps_space)
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(path, keeps_space)
    return _LOADED[key]


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``keeps_space``: white space makes tokens (byte-level vocabularies) or is dropped (word
    vocabularies).
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # every piece it gets is new
        self.keeps_space = keeps_space
        self.known: dict[str, bytes] = {"": b""}

    def pieces(self, text: str) -> list[str]:
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        if "\0" in text or _DOUBLE.search(text):
            return _AFTER_WORD.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def learn(self, unseen: list[str]) -> None:
        """Encode pieces in one library call."""
        for piece, found in zip(unseen, self.tokenizer.encode_batch_fast(unseen, add_special_tokens=False), strict=True):
            self.known[piece] = array("I", found.ids).tobytes()

    def forget(self) -> None:
        """Where memory is full, keep the short pieces, which recur; if these fill it, nothing."""
        self.known = {k: v for k, v in self.known.items() if len(k) < 10}
        if len(self.known) > CACHE_PIECES // 2:
            self.known = {"": b""}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (None: of the empty text) as bytes."""
        if len(self.known) > CACHE_PIECES:
            self.forget()
        cut = [self.pieces(x or "") for x in texts]
        known = self.known
        found = [list(map(known.get, pieces)) for pieces in cut]
        gaps = [(pieces, ids, [k for k, x in enumerate(ids) if x is None]) for pieces, ids in zip(cut, found, strict=True) if None in ids]
        if gaps:
            self.learn(list({pieces[k] for pieces, _, at in gaps for k in at}))
            for pieces, ids, at in gaps:
                for k in at:
                    ids[k] = known[pieces[k]]
        return [b"".join(ids) for ids in found]
