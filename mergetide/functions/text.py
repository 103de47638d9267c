"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: whatever is neither a letter nor a digit separates words.
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """Lower-case words of the whole text; NULL has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")
