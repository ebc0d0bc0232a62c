"""Words and shingles as the near-duplicate operator takes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs between Unicode white space."""
    return F.array_remove(F.split(F.lower(text), r"(?U)\s+"), "")


def word_shingles(text: Column, n: int = 3) -> Column:
    """Distinct windows of n words joined by U+001F; a shorter text is one window, and an empty one the empty window."""
    # The words are bound once, as the variable of a lambda over a one-element array.
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), "\x1f"))
    return F.array_distinct(F.flatten(F.transform(F.array(words(text)), windows)))


def char_shingles(text: Column, n: int = 3) -> Column:
    """Distinct windows of n code points of the lower-cased text without white space."""
    t = F.regexp_replace(F.lower(text), r"(?U)\s+", "")
    # A look-ahead matches at every place, in one pass over the text.
    windows = lambda t: F.when(F.length(t) >= n, F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).otherwise(F.array(t))
    return F.array_distinct(F.flatten(F.transform(F.array(t), windows)))
