"""Byte-level BPE ids of whole texts with the ``tokenizers`` library.

A text is cut before each single blank that follows a non-blank character.
The byte-level pattern never matches across such a place (a match that holds a
blank starts with it, and its only context is a look-ahead), so the ids of the
pieces, one after the other, are the ids of the text.  The same holds around a
single line feed between other characters, and before marks that end a word.
Pieces repeat, so their ids are kept in a bounded table; a word of plain Latin
letters goes straight to the BPE model, any other piece through the full encoder.

That holds only for a byte-level BPE without normalizer, prefix blank, dropout
or word affixes, which is checked when the file is loaded; any other tokenizer
encodes whole texts, and so does every text that holds an added token.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

MARKS = ".,;:!?"
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character as byte-level BPE vocabularies spell it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _word(piece: str) -> bool:
    """Letters only, all below U+0250, where every Unicode version agrees on letters."""
    return piece.isalpha() and (piece.isascii() or max(piece) < "\u0250")


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def cuts_at_blanks(settings: dict) -> bool:
    """Whether the ids of pieces cut at single blanks are the ids of the text."""
    before, model = settings["pre_tokenizer"] or {}, settings["model"]
    plain = not (settings["normalizer"] or settings["truncation"] or settings["padding"])
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    affixes = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
    after = settings["post_processor"]
    return bool(plain and level and model.get("type") == "BPE" and not affixes and (after is None or after.get("type") == "ByteLevel"))


class _Pieces(dict):
    """piece -> its ids as little-endian uint32 bytes; grows to ``limit`` entries."""

    def __init__(self, owner: TextEncoder, lead: str, limit: int):
        super().__init__()
        self.owner, self.lead, self.limit = owner, lead, limit

    def __missing__(self, piece: str) -> bytes:
        owner = self.owner
        if _word(piece):
            ids = owner.model_ids(self.lead + piece)
        else:
            word = piece.rstrip(MARKS)
            if word != piece and _word(word):
                ids = self[word] + owner.marks[piece[len(word) :]]
            else:
                line, _, rest = piece.partition("\n")
                if line and rest and not line[-1].isspace() and not rest[0].isspace():
                    return self[line] + owner.newline + owner.first[rest]
                ids = owner.full_ids(self.lead + piece)
        if len(self) < self.limit and len(piece) <= 64:
            self[piece] = ids
        return ids


class _Marks(dict):
    """Run of ``MARKS`` -> its ids."""

    def __init__(self, owner: TextEncoder, limit: int = 10_000):
        super().__init__()
        self.owner, self.limit = owner, limit

    def __missing__(self, run: str) -> bytes:
        ids = self.owner.full_ids(run)
        if len(self) < self.limit and len(run) <= 64:
            self[run] = ids
        return ids


class TextEncoder:
    def __init__(self, path: str, limit: int = 450_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self._tokenizer.to_str())
        self.piecewise = cuts_at_blanks(settings)
        added = [t["content"] for t in settings["added_tokens"]]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._tokenize = self._tokenizer.model.tokenize
        self._spell = byte_alphabet()
        self._blank = self._spell[32]
        self.newline = self.full_ids("\n")
        self.marks = _Marks(self)
        self.first, self._rest = _Pieces(self, "", limit // 4), _Pieces(self, " ", limit)

    def full_ids(self, text: str) -> bytes:
        return _bytes(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def model_ids(self, piece: str) -> bytes:
        """Ids of a word of letters, with a blank before it or none."""
        if piece.isascii():
            spelled = piece.replace(" ", self._blank, 1)
        else:
            spelled = piece.encode().decode("latin-1").translate(self._spell)
        return _bytes([t.id for t in self._tokenize(spelled)])

    def encode(self, text: str | None) -> bytes:
        """All ids of ``text`` as little-endian uint32 bytes; null is empty."""
        if not text:
            return b""
        if not self.piecewise or (self._added and self._added.search(text)):
            return self.full_ids(text)
        pieces = _CUT.split(text) if _RUN.search(text) else text.split(" ")
        head = self.first[pieces[0]] if pieces[0] else b""
        if not pieces[0]:  # the text starts with a blank: what follows is a piece with its blank
            return b"".join(map(self._rest.__getitem__, pieces[1:]))
        return head + b"".join(map(self._rest.__getitem__, pieces[1:]))


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary file."""
    return TextEncoder(path)
