"""Ids of whole texts by a word-level public tokenizer, with each distinct word of a worker encoded once.

The tokenizer's splitting pattern never crosses white space and its normaliser works on each character or on combining runs
that white space ends, so the ids of a text are those of its white-space parts, one after the other. Texts with the control
characters that Python takes for white space and the tokenizer does not (U+001C to U+001F) go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Words, and units of words, that a worker remembers; beyond this it starts anew. Words are cheap to make again of their units.
#: Only speed depends on these.
WORDS, UNITS = 600_000, 300_000
_ODD = re.compile("[\x1c-\x1f]")
#: A word of Latin letters, which is one unit of the splitting pattern, and marks that are another.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?&*$%#|]*)")
#: Marks that end a word of Latin letters.
_MARKS = re.compile("(?<=[a-zß-öø-ÿ])([.,;:!?&*$%#|]+)(?=[ \n])")


def parted(text: str) -> list[str]:
    """A text's white-space parts. Where all its characters are of Latin-1, in which every case has one form, it is put in lower case,
    as the tokenizer does, and marks that end a word stand alone, as its splitting pattern has them: so fewer parts differ."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split()
    return _MARKS.sub(r" \1", text.lower()).split()


class WordIds:
    """Packed ids (little-endian unsigned 32-bit) of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn_units(self, units: list[str], into: dict[str, bytes]) -> None:
        """Each unit ends with the only id of it that ends a word; so many are encoded in one call and told apart after it."""
        for i in range(0, len(units), 1000):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units[i : i + 1000])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            packed, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
            into.update((u, packed[a:b]) for u, a, b in zip(units[i : i + 1000], at[:-1], at[1:], strict=True))

    def _learn(self, words: list[str]) -> None:
        units, known = self.units, self.known
        self._learn_units([w for w in words if w.isascii() and w.isalpha()], known)
        plain = [(w, m[1].lower(), m[2]) for w in words if w not in known and (m := _PLAIN.fullmatch(w))]
        self._learn_units(list({u for _, a, b in plain for u in (a, b) if u not in units}), units)
        known.update((w, units[a] + units[b]) for w, a, b in plain)
        odd = [w for w in words if w not in known]
        known.update(zip(odd, self._encode(odd), strict=True))

    def pack(self, texts: list[str]) -> list[bytes]:
        split = [None if _ODD.search(t) else parted(t) for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        if len(self.units) > UNITS:
            self.units = {"": b""}
        known = self.known
        found = [None if words is None else list(map(known.get, words)) for words in split]
        some = [(words, ids, [i for i, x in enumerate(ids) if x is None]) for words, ids in zip(split, found, strict=True) if ids is not None]
        if new := {words[i] for words, _, at in some for i in at}:
            self._learn(list(new))
            for words, ids, at in some:
                for i in at:
                    ids[i] = known[words[i]]
        return [self._encode([t])[0] if ids is None else b"".join(ids) for t, ids in zip(texts, found, strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The worker's tokenizer for the file at path; Spark keeps workers, so it is loaded once in each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return WordIds(path)
