"""Text standardisation as native expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters whose compatibility decomposition has ASCII in it, by what that ASCII is; built from Unicode's own tables.
_FOLDED = {
    chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if ord(x) < 128)
    for c in range(128, 0x110000) if unicodedata.normalize("NFKD", chr(c)) != chr(c)
}
_ONE = {c: x for c, x in _FOLDED.items() if len(x) == 1}
_MANY = {c: x for c, x in _FOLDED.items() if len(x) > 1}


def _ranges(characters: Iterable[str]) -> str:
    """The characters as the inside of a regular expression's class, neighbours as one range."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


_MANY_CLASS = f"[{_ranges(_MANY)}]"
_FROM, _TO = "".join(_ONE), "".join(_ONE.values())
# One literal, which the optimizer turns into a map once per plan.
_MANY_PAIRS = "\x01".join(f"{c}\x02{x}" for c, x in _MANY.items())


def collapse_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def standardize_text(value: Column) -> Column:
    """Lower case, full compatibility folding to ASCII, other characters dropped, single spaces.

    ASCII texts, nearly all, are only lower-cased and spaced.
    """
    folded = F.translate(F.lower(value), _FROM, _TO)
    # Characters that fold to several letters are rare; only texts with one are taken apart.
    table = F.str_to_map(F.lit(_MANY_PAIRS), F.lit("\x01"), F.lit("\x02"))
    letters = F.transform(F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(table[c], c))
    spelled = F.when(folded.rlike(_MANY_CLASS), F.array_join(letters, "")).otherwise(folded)
    ascii_only = F.regexp_replace(spelled, r"[^\x00-\x7F]", "")
    plain = F.when(value.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(F.lower(value))
    return F.trim(F.regexp_replace(plain, r"[\x09-\x0D\x1C-\x20]+", " "))


def lower_trim(value: Column) -> Column:
    return F.lower(F.trim(value))


def upper_trim(value: Column) -> Column:
    return F.upper(F.trim(value))


def zero_pad(value: Column, width: int = 5) -> Column:
    """Left zero padding that never shortens a longer value."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)
