"""Index-side text analysis in JVM expressions: folding, tokens, ASCII helpers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one plain letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code) and parts[0].isascii():
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits, in order. Splitting is linear in the text; extracting
    every match would copy the text for each."""
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), SEPARATORS), "")
