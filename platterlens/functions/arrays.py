"""Arrays of chapters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds: what chapters may differ by, and the longest that a closing sliver is.
TOLERANCE, SLIVER = 100, 2000


def chapters_match(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= TOLERANCE), lambda ok: F.coalesce(ok, F.lit(False)))


def without_sliver(chapters: Column) -> Column:
    """Without a last chapter of two seconds or less, if others remain."""
    n = F.size(chapters)
    return F.when((n > 1) & (F.element_at(chapters, -1) <= SLIVER), F.slice(chapters, F.lit(1), n - 1)).otherwise(chapters)
