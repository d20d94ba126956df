"""Words, and values of words kept for the next document."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import pyarrow as pa

#: A word: anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Kept(dict):
    """``f(word)`` for each word asked for. Keeps at most twice ``most`` values, of words of at most ``longest`` characters.

    When ``most`` are held they become the older half, in place of the one before; what is asked for again comes back.
    """

    def __init__(self, f: Callable, most: int = 500_000, longest: int = 40) -> None:
        self.f, self.most, self.longest, self.older = f, most, longest, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.f(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


#: What this process keeps for later tasks, by name: a call that drops it.
KEEPERS: dict[str, Callable] = {}


class Start:
    """Goes out with a task's code; at its first batch ``once`` drops what tasks of other kinds have kept in this process."""

    def __init__(self) -> None:
        self.began = False

    def once(self) -> None:
        if self.began:
            return
        self.began = True
        for drop in KEEPERS.values():
            drop()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its own counsel
            pass
