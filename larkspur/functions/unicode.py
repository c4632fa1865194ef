"""Unicode-exact text expressions, evaluated in the JVM.

Java's ``\\s`` is ASCII only, so the whitespace class is written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters of Unicode's White_Space property and U+001C..U+001F, as the inside of a Java or RE2 class.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def split_words(text: Column, separators: str) -> Column:
    """Maximal runs of characters outside the class ``separators``, in order; null for null."""
    return F.filter(F.split(text, f"[{separators}]+"), lambda w: w != "")


def _fold_table() -> dict[str, str]:
    """Characters whose case folding to one character is not what lower-casing gives, as final sigma and the long s."""
    table = {}
    for c in map(chr, range(0x80, 0x2000)):
        folded = c.casefold() if len(c.casefold()) == 1 else c
        if len(folded.lower()) == 1 == len(c.lower()) and folded.lower() != c.lower():
            table[c.lower()] = folded.lower()
    return table


_FOLDED = _fold_table()


def fold(text: Column) -> Column:
    """Text without letter case, by Unicode's simple case folding: one letter to one letter.

    So final sigma equals sigma and the capital sharp s the small one, but ``ß`` is not ``ss``, and the dotless ``ı``
    is not ``i``: these are different letters, not cases of one.
    """
    return F.translate(F.lower(text), "".join(_FOLDED), "".join(_FOLDED.values()))
