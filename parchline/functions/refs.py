"""References between tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_ref(col: Column | str) -> Column:
    """A reference as it compares: blanks trimmed, lower case; null where it refers to nothing."""
    c = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(c != "", c)
