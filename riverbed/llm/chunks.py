"""Parts of a text that a byte-level tokenizer encodes independently, and a bounded cache of their encodings."""

from __future__ import annotations

import re
from collections.abc import Callable

_GLUED = re.compile(r" (?=\s|$)")
_CUT = re.compile(r" (?=\S)")


def parts(text: str) -> list[str]:
    """Cuts a text at every space that a non-space follows.

    All parts but the first lack the space they begin with. The split pattern of the tokenizer lets a word take one space before
    it, so no match spans such a place, and parts can be encoded one by one.
    """
    return _CUT.split(text) if _GLUED.search(text) else text.split(" ")


class Cache:
    """Encodings of parts, in two generations of bounded size: the older one goes when the newer one is full."""

    def __init__(self, encode: Callable[[list[str]], list], most: int):
        self.encode, self.most, self.new, self.old = encode, most, {}, {}

    def fill(self, keys: set[str]) -> dict:
        """A dict that holds all keys."""
        if len(self.new) + len(keys) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    missing.append(k)
        if missing:
            new.update(zip(missing, self.encode(missing)))
        return new
