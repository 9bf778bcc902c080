"""Time words as a floor in Unix seconds, seen from a given moment."""

from __future__ import annotations

import re

DAY = 86400
#: Days back of words that need no midnight. Fixed values.
BACK = {"last week": 7, "last month": 30, "last year": 365}


def since(word: str | None, as_of: float) -> float | None:
    """Seconds; None, no limit, for an unknown word. Days start at midnight UTC."""
    word = (word or "").strip().lower()
    midnight = as_of - as_of % DAY
    if word == "today":
        return midnight
    if word == "yesterday":
        return midnight - DAY
    if word in BACK:
        return as_of - BACK[word] * DAY
    found = re.fullmatch(r"last (\d+) days?", word)
    return as_of - int(found[1]) * DAY if found else None
