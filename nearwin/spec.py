"""Which columns of a table take part, and the option string that says so."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class FeatureSpec:
    """Attributes by kind, numeric ones first in every distance; the class and the key are no attributes."""

    numeric: tuple[str, ...]
    nominal: tuple[str, ...] = ()
    label: str | None = None
    key: str = "id"
    weight: str | None = None

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.numeric + self.nominal

    @classmethod
    def infer(cls, df: DataFrame, key: str, label: str | None = None) -> FeatureSpec:
        """Numeric columns, then string columns; other types take no part."""
        left = [(c, t) for c, t in df.dtypes if c not in (key, label)]
        return cls(tuple(c for c, t in left if t in NUMERIC or t.startswith("decimal")), tuple(c for c, t in left if t == "string"), label, key)

    def select(self, text: str, invert: bool = False) -> FeatureSpec:
        """Only the attributes at the 1-based places of a list such as ``first-2,4,last``, or all others."""
        names = self.attributes
        kept = {names[i] for i in places(text, len(names))}
        keep = lambda cs: tuple(c for c in cs if (c in kept) != invert)
        return replace(self, numeric=keep(self.numeric), nominal=keep(self.nominal))


def places(text: str, n: int) -> list[int]:
    """0-based places of a comma list of numbers and ranges; ``first`` and ``last`` are numbers too."""
    number = lambda s: {"first": 1, "last": n}.get(s.strip()) or int(s)
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        a, b = number(low), number(high or low)
        if not 1 <= a <= b <= n:
            raise ValueError(f"{part} is not within 1 to {n}")
        out += [i for i in range(a - 1, b) if i not in out]
    return out


@dataclass(frozen=True)
class SearchOptions:
    """Options of a search: attributes (-R), the others (-V), raw distances (-D), skip identical rows (-S)."""

    attributes: str = "first-last"
    invert: bool = False
    raw: bool = False
    skip_identical: bool = False

    @classmethod
    def parse(cls, text: str) -> SearchOptions:
        words, out = shlex.split(text), cls()
        while words:
            word = words.pop(0)
            if word == "-R":
                out = replace(out, attributes=words.pop(0))
            elif word in ("-V", "-D", "-S"):
                out = replace(out, **{{"-V": "invert", "-D": "raw", "-S": "skip_identical"}[word]: True})
            else:
                raise ValueError(f"no such option: {word}")
        return out

    def text(self) -> str:
        return " ".join(["-R", self.attributes, *(flag for flag, on in (("-V", self.invert), ("-D", self.raw), ("-S", self.skip_identical)) if on)])
