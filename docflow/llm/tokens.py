"""Token ids of whole texts, unit by unit with a cache.

Byte-level BPE never merges across a single space between two other characters:
the splitting pattern starts a new piece there. So a text's ids are the ids of its
units (cut at such spaces, the space leading), and units repeat a lot. A special string
inside a text, such as ``<|endoftext|>``, has no space and so lies within one unit, where the
tokenizer treats it as it does in the whole text. A unit met for the first time is made of
smaller parts, cut where the pattern surely starts a new piece too: between an ASCII letter
and a mark, and around a single line end.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Distinct units a worker remembers; the older half of them is dropped at a time.
CACHE_UNITS = 1_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PARTS = re.compile(r"(?<=[A-Za-z])(?=[.,;:!?])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_LOADED: dict[str, UnitEncoder] = {}


def _key(part: str) -> str:
    """How a part is remembered: without its leading space, else marked by a line end."""
    return part[1:] if part[0] == " " and part[1:2] not in ("", "\n") else "\n" + part


def _part(key: str) -> str:
    return key[1:] if key[0] == "\n" else " " + key


class UnitEncoder:
    """Encodes texts with a tokenizer file; one per worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, keys: list[str]) -> None:
        step = 10_000
        for i in range(0, len(keys), step):
            some = keys[i : i + step]
            encoded = self.tokenizer.encode_batch_fast([_part(k) for k in some], add_special_tokens=False)
            sizes = np.cumsum([0] + [4 * len(e) for e in encoded]).tolist()
            data = np.array([x for e in encoded for x in e.ids], dtype="<u4").tobytes()
            self.known.update((k, data[a:b]) for k, a, b in zip(some, sizes, sizes[1:], strict=False))

    def _learn(self, keys: set[str]) -> None:
        """Ids of units that are not in ``known``."""
        held = {k: self.older[k] for k in keys if k in self.older}
        if len(self.known) + len(keys) > CACHE_UNITS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known.update(held)
        new = [k for k in keys if k not in known]
        mixed = [(k, [_key(p) for p in _PARTS.split(_part(k))]) for k in new if not k.isalpha()]
        wanted = dict.fromkeys(k for k in new if k.isalpha())
        wanted.update(dict.fromkeys(p for _, own in mixed for p in own if p not in known))
        known.update((p, older[p]) for p in wanted if p in older)
        self._encode([p for p in wanted if p not in known])
        known.update((k, b"".join([known[p] for p in own])) for k, own in mixed if len(own) > 1)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        units, sizes = [], []
        for text in texts:
            parts = _CUT.split(text) if text else []
            sizes.append(len(parts))
            if parts:
                parts[0] = _key(parts[0])
                units += parts
        found = list(map(self.known.get, units))
        new = [i for i, data in enumerate(found) if data is None]
        if new:
            self._learn({units[i] for i in new})
            for i in new:
                found[i] = self.known[units[i]]
        out, at = [], 0
        for n in sizes:
            out.append(np.frombuffer(b"".join(found[at : at + n]), dtype="<u4"))
            at += n
        return out


def encoder(path: str) -> UnitEncoder:
    if path not in _LOADED:
        _LOADED[path] = UnitEncoder(path)
    return _LOADED[path]
