"""Token ids of whole texts, encoded once per distinct piece of a worker."""

from __future__ import annotations

import re
import sys
from array import array
from operator import itemgetter

import numpy as np
import tokenizers
from tokenizers import Tokenizer

MEMO = 500_000  # pieces remembered by a worker; then it starts anew
LONGEST = 64  # characters of a piece worth remembering
TOGETHER = 4096  # pieces encoded in one call

# letters, stops and single line breaks: every tokenizer of these families starts a token where one of them ends
_FINE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,]+|\n(?!\n)")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,]+")
_BESIDE = re.compile(r" (?:\s|(?<=\s ))")  # a space beside another blank; a line break inside a piece is left to the tokenizer

# byte-level vocabularies write each byte as a printable character: itself if it is one, else the next free one from 256 on
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to encoding the whole text at once.

    A text is cut at single spaces between two non-blank characters, where no tokenizer of either family lets a token pass:
    ``lead`` says whether the space belongs to the token after it (byte-level) or is dropped (word-end). A text with any
    other blank next to a space is encoded whole. A new piece is cut further into words, stops and line breaks where it has
    nothing else, so that words are shared by the pieces they stand in; these need no normalising or splitting but lower
    case, and go to the tokenizer's model itself. Other new pieces are encoded many at a time, as one text with a separator
    that is always a token of its own; pieces that hold the separator are encoded alone.
    """

    def __init__(self, path: str, lead: bool, most: int = MEMO):
        self.tokenizer, self.lead, self.most, self.memo = Tokenizer.from_file(path), lead, most, {}
        self.model = self.tokenizer.model.tokenize
        self.gap = "\n" if lead else " | "
        (self.gap_id,) = self.tokenizer.encode(self.gap, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str] | None:
        """None if the text has to be encoded whole."""
        if text[0].isspace() or text[-1].isspace() or _BESIDE.search(text):
            return None
        parts = text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]] if self.lead else parts

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, piece: str) -> bytes:
        """Ids of letters or stops, with their leading space if any."""
        mapped = piece if self.lead else piece.lower()
        if self.lead or not mapped.isascii():
            mapped = mapped.encode().decode("latin-1").translate(_BYTES)
        return _packed([t.id for t in self.model(mapped)])

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of ``pieces`` into the memo."""
        mark = self.gap.strip(" ")
        plain = []
        word, simple, memo = self.word, _WORD.fullmatch, self.memo
        for piece in pieces:
            if simple(piece):
                memo[piece] = word(piece)
            elif mark in piece:
                memo[piece] = self.whole(piece)
            else:
                plain.append(piece)
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode(self.gap.join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.gap_id) * 4
            if len(cuts) != len(some) - 1:
                raise ValueError("the separator is not a token of its own")
            data, starts = ids.tobytes(), [0, *(cuts + 4).tolist()]
            self.memo.update(zip(some, [data[a:b] for a, b in zip(starts, [*cuts.tolist(), len(data)])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) if t else [] for t in texts]
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        new = list({p for pieces in cut if pieces for p in pieces if p not in memo})
        parts = [f if len(f) > 1 and len("".join(f)) == len(p) else None for p, f in zip(new, map(_FINE.findall, new))]
        fine = set().union(*[f for f in parts if f]).union([p for p, f in zip(new, parts) if not f]).difference(memo)
        self.learn(list(fine))
        get = memo.__getitem__
        for piece, f in zip(new, parts):
            if f:
                memo[piece] = b"".join(map(get, f))
        out = [self.whole(t) if pieces is None else b"".join(itemgetter(*pieces)(memo)) if len(pieces) > 1 else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut)]
        for piece in new:
            if len(piece) > LONGEST or "\n" in piece:
                del memo[piece]
        return out


def worker_encoder(path: str, lead: bool, most: int = MEMO) -> Encoder:
    """The encoder of this Python process, which serves many tasks: later tasks find the words of earlier ones known."""
    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if (path, lead, most) not in kept:
        kept[path, lead, most] = Encoder(path, lead, most)
    return kept[path, lead, most]
