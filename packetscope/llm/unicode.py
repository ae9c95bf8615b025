"""Which characters every library cuts alike."""

from __future__ import annotations

import unicodedata


class Assigned:
    """Tells whether all characters of a text have a category in Python's Unicode table.

    Libraries with newer tables differ only on characters that are not assigned there.
    """

    def __init__(self):
        self.good: set[str] = set(map(chr, range(0x80)))

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return True
        new = set(text) - self.good
        for letter in new:
            if unicodedata.category(letter) == "Cn":
                return False
        self.good |= new
        return True
