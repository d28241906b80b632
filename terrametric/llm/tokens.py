"""Token ids by a public tokenizer, with the ids of known word pieces remembered.

Both supported kinds of tokenizer split a text into pieces by a pattern and
encode each piece on its own, so the ids of a text are those of its pieces in
order. Pieces repeat much more than texts: remembering their ids saves most of
the merging. Texts with characters outside the Latin blocks take the
tokenizer's own path as a whole, since the pattern's classes are spelled out
for those blocks only.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from itertools import groupby

from .common import resident

#: Pieces remembered at once in a worker, as often again of those before; older ones are made anew.
MAX_PIECES = 250_000
#: Pieces of a long text that are looked up between two checks of how many are remembered.
RUN = 20_000
#: Longer pieces are not remembered.
MAX_PIECE_CHARS = 64

#: Code points the fast path covers: Basic Latin to Latin Extended-B.
_LAST = 0x24F
_ODD = {*range(0x1C, 0x20), 0x85, 0x130}
_FAST = [c for c in range(_LAST + 1) if c not in _ODD and len(chr(c).lower()) == 1 and ord(chr(c).lower()) <= _LAST]

#: The contractions that these tokenizers' patterns name.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _ranges(codes: list[int]) -> str:
    out = []
    for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        out.append(f"\\u{run[0]:04x}" + (f"-\\u{run[-1]:04x}" if len(run) > 1 else ""))
    return "".join(out)


def _patterns(codes: list[int]) -> tuple[re.Pattern, dict[str, re.Pattern]]:
    """For texts of these characters only: what any other character matches, and the pieces by kind of tokenizer."""
    kind = {c: "space" if chr(c).isspace() else unicodedata.category(chr(c))[0] for c in codes}
    letter, number, space = (_ranges([c for c in codes if kind[c] == k]) for k in ("L", "N", "space"))
    other = _ranges([c for c in codes if kind[c] not in ("L", "N", "space")])
    pieces = {
        "byte": f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[{other}]+|[{space}]+(?![^{space}])|[{space}]+",
        "word": f"{CONTRACTIONS}|[{letter}]+|[{number}]|[{other}]+",
    }
    return re.compile(f"[^{_ranges(codes)}]"), {k: re.compile(v) for k, v in pieces.items()}


#: Classes within Latin-1 are matched faster, and most texts need no others.
_BEYOND_1, _SPLIT_1 = _patterns([c for c in _FAST if c <= 0xFF and ord(chr(c).lower()) <= 0xFF])
_BEYOND, _SPLIT = _patterns(_FAST)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class _Newer(dict):
    """Ids of pieces met lately; a missing piece is taken over from the older ones, or made."""

    def __init__(self, make, older: dict[str, bytes]):
        self.make, self.older = make, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= MAX_PIECE_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """kind: "byte" keeps white space and case; "word" lower-cases and drops white space."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.lower = kind == "word"
        self.split_1, self.split = _SPLIT_1[kind].findall, _SPLIT[kind].findall
        self.known = _Newer(self._piece, {})

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _looked_up(self, pieces: list[str]) -> bytes:
        if len(self.known) >= MAX_PIECES:
            self.known = _Newer(self._piece, dict(self.known))
        return b"".join(map(self.known.__getitem__, pieces))

    def _text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _BEYOND_1.search(text):
            split = self.split_1
        elif not _BEYOND.search(text):
            split = self.split
        else:
            return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        pieces = split(text.lower() if self.lower else text)
        if len(pieces) <= RUN:
            return self._looked_up(pieces)
        return b"".join([self._looked_up(pieces[k : k + RUN]) for k in range(0, len(pieces), RUN)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; none for null."""
        return [self._text(t) for t in texts]


def encoder(path: str, kind: str) -> Encoder:
    """One encoder a worker, kept between tasks."""
    return resident(("tokens", path, kind), lambda: Encoder(path, kind))
