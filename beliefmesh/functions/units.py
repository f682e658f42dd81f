"""Units as text: their powers of the seven SI base dimensions, and whether two units measure the same.

A unit is a product of symbols, each with an optional SI prefix and an integer power, such as `km/h`, `kg m^2 s^-2` or
`N·m`; one slash divides by all that follows it. Scales don't count: `Hz` and `kHz` agree.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

# fixed values: powers of (m, kg, s, A, K, mol, cd) of the symbols that take a prefix, then of those that don't
SCALED = {
    "m": (1, 0, 0, 0, 0, 0, 0), "g": (0, 1, 0, 0, 0, 0, 0), "s": (0, 0, 1, 0, 0, 0, 0), "A": (0, 0, 0, 1, 0, 0, 0), "K": (0, 0, 0, 0, 1, 0, 0), "mol": (0, 0, 0, 0, 0, 1, 0), "cd": (0, 0, 0, 0, 0, 0, 1),
    "Hz": (0, 0, -1, 0, 0, 0, 0), "N": (1, 1, -2, 0, 0, 0, 0), "Pa": (-1, 1, -2, 0, 0, 0, 0), "J": (2, 1, -2, 0, 0, 0, 0), "eV": (2, 1, -2, 0, 0, 0, 0), "W": (2, 1, -3, 0, 0, 0, 0), "C": (0, 0, 1, 1, 0, 0, 0),
    "V": (2, 1, -3, -1, 0, 0, 0), "Ω": (2, 1, -3, -2, 0, 0, 0), "ohm": (2, 1, -3, -2, 0, 0, 0), "S": (-2, -1, 3, 2, 0, 0, 0), "F": (-2, -1, 4, 2, 0, 0, 0), "Wb": (2, 1, -2, -1, 0, 0, 0), "T": (0, 1, -2, -1, 0, 0, 0),
    "H": (2, 1, -2, -2, 0, 0, 0), "L": (3, 0, 0, 0, 0, 0, 0), "pc": (1, 0, 0, 0, 0, 0, 0), "yr": (0, 0, 1, 0, 0, 0, 0),
}
UNSCALED = {"1": (0,) * 7, "%": (0,) * 7, "rad": (0,) * 7, "sr": (0,) * 7, "min": (0, 0, 1, 0, 0, 0, 0), "h": (0, 0, 1, 0, 0, 0, 0), "d": (0, 0, 1, 0, 0, 0, 0), "au": (1, 0, 0, 0, 0, 0, 0), "ly": (1, 0, 0, 0, 0, 0, 0)}
# fixed values: the SI prefixes
PREFIXES = ["da", "Q", "R", "Y", "Z", "E", "P", "T", "G", "M", "k", "h", "d", "c", "m", "µ", "μ", "u", "n", "p", "f", "a", "z", "y", "r", "q"]


@functools.cache
def symbols() -> dict[str, tuple[int, ...]]:
    """Every symbol, with each prefix where it takes one. A plain symbol goes before a prefixed one of the same letters, and
    `da` before other prefixes."""
    out = {**SCALED, **UNSCALED}
    for prefix in PREFIXES:
        for name, powers in SCALED.items():
            out.setdefault(prefix + name, powers)
    return out


TERM = re.compile(r"([^\W\d_]+|%|1)(?:\^([+-]?\d+))?")


def dimension_of(unit: str | None) -> list[int] | None:
    if unit is None or unit.count("/") > 1:
        return None
    total = [0] * 7
    for sign, part in zip((1, -1), unit.split("/"), strict=False):
        terms = re.split(r"[*·⋅×\s]+", part.strip())
        for term in terms:
            found = TERM.fullmatch(term)
            powers = symbols().get(found[1]) if found else None
            # an empty term stands at an operator without an operand; strip leaves one only where the part is empty
            if powers is None:
                if term or len(terms) == 1:
                    return None
                continue
            total = [t + sign * int(found[2] or 1) * p for t, p in zip(total, powers, strict=True)]
    return total


def same_kind(one: str | None, other: str | None) -> bool:
    """Equal texts, or units of one dimension. Unreadable units agree with themselves alone."""
    if one == other:
        return True
    found = dimension_of(one)
    return found is not None and found == dimension_of(other)


@F.pandas_udf(ArrayType(IntegerType()))
def unit_dimension(unit: pd.Series) -> pd.Series:
    """Powers of (m, kg, s, A, K, mol, cd); null for a unit that can't be read."""
    known = {u: dimension_of(u) for u in unit.dropna().unique()}
    return unit.map(lambda u: known.get(u), na_action="ignore")


@F.pandas_udf(BooleanType())
def agree(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([a is not None and b is not None and same_kind(a, b) for a, b in zip(one, other, strict=True)])


def dimension_text(powers: Column) -> Column:
    return F.array_join(F.transform(powers, lambda x: x.cast("string")), ",")
