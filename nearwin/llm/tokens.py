"""Token ids of whole texts, with the ids of known words kept."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from nearwin.llm.words import KEEPERS, Kept

#: ASCII punctuation that no added token ends with and no contraction starts with.
TAIL = ".,;:!?#$%&*)|"


#: Words that an encoder keeps, twice, at about 200 bytes each. Fewer take less memory and more time.
KEPT = 700_000


@lru_cache(maxsize=1)
def encoder(path: str, most: int = KEPT) -> Encoder:
    """This process's encoder of a vocabulary file, with the words that earlier tasks have met."""
    return Encoder(path, most)


KEEPERS["encoder"] = encoder.cache_clear


class Encoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` of a tokenizer that drops white space.

    Such a tokenizer (checked here: its pre-tokenizer's removed split never takes in white space, and its added tokens
    hold none; letters and other signs always part) gives a text the ids of its white-space-free words, one after the other. So each word is encoded once
    and kept; the memory for kept words is bounded.
    """

    def __init__(self, path: str, most: int = KEPT) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        if any(t.content[-1] in TAIL for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has an added token that ends in one of {TAIL}")
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        joined = self._ids("a b\nab ' s a's 1 2")
        if joined != [i for w in "a b\nab ' s a's 1 2".split() for i in self._ids(w)] or self._ids("ab.") != self._ids("ab") + self._ids("."):
            raise ValueError(f"{path} does not split words as is relied on here")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.kept = Kept(self._bytes, most)

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _bytes(self, word: bytes) -> bytes:
        """Ids of a word not kept so far; from its kept parts where a letter and the punctuation after it must part."""
        text = word.decode(errors="replace")
        core = text.rstrip(TAIL)
        if core and len(core) < len(text) and core[-1].isalpha() and len(core[-1].lower()) == 1:
            tail = len(text) - len(core)
            return self.kept[word[:-tail]] + self.kept[word[-tail:]]
        return array(self.code, self._ids(text)).tobytes()

    def encode(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each UTF-8 text has, ``end_id`` at its end included, and all ids in one array."""
        end = np.array([end_id], self.dtype).tobytes()
        of = self.kept.__getitem__
        runs = [b"".join(map(of, (text or b"").split())) + end for text in texts]
        return np.fromiter(map(len, runs), np.int64, len(runs)) // self.dtype.itemsize, np.frombuffer(b"".join(runs), self.dtype)
