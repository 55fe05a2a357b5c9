"""Folding of look-alike characters, as a vectorised function (the JVM has no Unicode normalisation expression)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters without width, colon look-alikes, and letters of other scripts that look Latin.
ZERO_WIDTH = "​‌‍⁠﻿­͏"
COLONS = "∶∷ː꞉։׃․⸮"
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "м": "m",
    "т": "t", "н": "h", "к": "k", "ӏ": "l", "ѵ": "v", "г": "r", "ԝ": "w", "ո": "n", "ս": "u", "ɡ": "g", "ѡ": "w", "ν": "v",
    "ο": "o", "ρ": "p", "α": "a", "ε": "e", "τ": "t", "ι": "i", "κ": "k", "μ": "m", "υ": "u", "օ": "o", "ա": "a", "ё": "e",
    "ѐ": "e",
}


class _Replacements(dict):
    """What each code point turns into, worked out when it is first met: nothing for invisible characters and accents, the
    look-alike's plain letter, else the letters of the compatibility form."""

    def __missing__(self, point: int) -> str:
        bare = [c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c) and c not in ZERO_WIDTH]
        self[point] = "".join(":" if c in COLONS else LOOK_ALIKES.get(c, c) for c in bare)
        return self[point]


_REPLACEMENTS = _Replacements()


def fold_text(text: str | None) -> str | None:
    """Compatibility form without invisible characters and accents, with look-alikes mapped; null stays null."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_REPLACEMENTS))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")
