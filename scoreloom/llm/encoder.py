"""Whole texts to token ids with the ``tokenizers`` library, one distinct word at a time.

Neither public vocabulary merges across white space, so the ids of a text are the ids of its
space-delimited units in order.  A unit goes through the library's normaliser, pre-tokeniser and BPE
model once; its ids stay in a bounded table, where the next occurrence finds them.  A text that holds
anything this cutting rule was not made for goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Units as the byte-level pre-tokeniser cuts around ASCII white space.
SPACED_UNIT = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
TAIL = ".,;:!?*$%&#|)\"-"
MAX_UNITS = 600_000
LONG_UNIT = 64


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Units(dict):
    """Ids of units; a missing unit is encoded and, unless it is long or the table is full, kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(unit) <= LONG_UNIT:
            if len(self) >= MAX_UNITS:
                self.clear()
            self[unit] = ids
        return ids


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``keeps_space`` tells whether a leading space belongs to a unit (byte-level vocabularies) or white
    space is dropped (word-end vocabularies).
    """

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self.letters = byte_letters()
        self.model, self.normal, self.pre = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.spaced = _Units(lambda u: self._unit(" " + u))
        self.bare = _Units(self._unit)

    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; none for a null or empty one."""
        if not text:
            return b""
        plain = text.replace("\n", "").replace("\t", "").replace("\r", "")
        if not plain.isprintable() or "<|" in plain:  # odd separators, or the start of a special token
            return self._whole(text)
        bare = self.bare.__getitem__
        if not self.keeps_space:
            return b"".join(map(bare, text.split()))
        if len(plain) + text.count("\n") < len(text) or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n ", " \n", "\n\n")):
            return b"".join(map(bare, SPACED_UNIT.findall(text)))
        spaced, out = self.spaced.__getitem__, []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(bare("\n"))
            first, *rest = line.split(" ")
            out.append(bare(first))
            out.extend(map(spaced, rest))
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        word = unit[1:] if unit[:1] == " " else unit
        if not word.isalpha():
            stem = word.rstrip(TAIL)
            if stem and stem != word and stem.isalpha():  # a run of letters ends where other signs begin
                return (self.spaced if word is not unit else self.bare)[stem] + self.bare[word[len(stem) :]]
            if self.normal:
                unit = self.normal.normalize_str(unit)
            pieces = [p for p, _ in self.pre.pre_tokenize_str(unit)]
        else:
            if self.normal:
                unit = unit.lower() if unit.isascii() else self.normal.normalize_str(unit)
            if not unit.removeprefix(" ").isalpha():  # normalising may take letters apart
                pieces = [p for p, _ in self.pre.pre_tokenize_str(unit)]
            else:
                pieces = [unit.encode().decode("latin-1").translate(self.letters)]
        return array("I", [t.id for p in pieces for t in self.model.tokenize(p)]).tobytes()


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """One encoder per worker process."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, keeps_space)
    return _ENCODERS[key]


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` replaces the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
