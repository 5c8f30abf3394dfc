"""Token ids of whole texts by a given tokenizer file.

Tokenizers of the kinds used here cut a text between a character and following white space, and between
letters and ASCII marks, before they look at anything else. So the ids of a text are those of its units
in a row. Each worker encodes a distinct unit once and joins stored bytes. Texts with white space on
whose class regular expression engines disagree are encoded whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

END = 2
_W, _L, _P = r" \n\t\r", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_UNIT = rf"[{_L}]+(?=[{_P}{_W}]|\Z)|[{_P}]+(?=[{_W}]|\Z)|[^{_W}]+"
#: A word or marks up to white space, else everything up to white space; with the white space before it,
UNIT = re.compile(rf"[{_W}]*(?:{_UNIT})|[{_W}]+")
#: or without, for tokenizers that drop white space.
BARE_UNIT = re.compile(_UNIT)
WORD = re.compile(rf"[{_L}]+")
UNSURE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Units kept per worker; beyond that the memory is emptied, which changes no result.
REMEMBERED = 600_000
#: Characters of the texts whose new units are encoded in one call.
GROUP = 1 << 19


def byte_letters() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


class Encoder(dict):
    """Maps a unit to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, drops_space: bool):  # those that drop white space ignore case too
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_space = drops_space
        self.unit = BARE_UNIT if drops_space else UNIT

    def plainly(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def learn(self, units: Iterable[str]) -> None:
        missing = {u for u in units if u not in self}
        if len(self) + len(missing) > REMEMBERED:
            self.clear()
            missing = set(units)
        tokenize, rest = self.tokenizer.model.tokenize, []
        for unit in missing:
            # One word needs no normalizer and no cutting: the model's merges alone give its ids.
            word = unit if self.drops_space or unit[0] != " " else unit[1:]
            if WORD.fullmatch(word):
                stored = word.lower() if self.drops_space else unit
                ids = [t.id for t in tokenize(stored.encode().decode("latin-1").translate(BYTE_LETTERS))]
                self[unit] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(unit)
        if rest:
            self.update(zip(rest, self.plainly(rest), strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: empty) without an end id."""
        for group in groups(texts):
            if self.drops_space:
                group = [lowered(t) for t in group]
            cut = [None if UNSURE.search(t) else self.unit.findall(t) for t in group]
            self.learn(list(chain.from_iterable(c for c in cut if c)))
            for text, units in zip(group, cut, strict=True):
                yield self.plainly([text])[0] if units is None else b"".join(map(self.__getitem__, units))


def lowered(text: str) -> str:
    """A Latin-1 text in lower case, so that its words meet; such letters have no case rule of context.

    For tokenizers that ignore case. Other texts stay, as composing and lowering them do not commute.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about ``GROUP`` characters."""
    group, total = [], 0
    for text in texts:
        group.append(text or "")
        total += len(group[-1])
        if total >= GROUP:
            yield group
            group, total = [], 0
    if group:
        yield group


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool = False) -> Encoder:
    """The worker's encoder for a file."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_space)
    return _ENCODERS[key]
