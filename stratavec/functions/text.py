"""Words of a text, on either side of Arrow, and the keyword tokeniser of the search index."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of letters or digits; lower-casing comes first.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased words; null has none."""
    return WORD.findall(text.lower()) if text else []


def keyword_terms(text: Column | str) -> Column:
    """Terms of the keyword index: lower case, cut at everything but a-z and 0-9, no empty ones."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
