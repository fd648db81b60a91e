"""Small column helpers shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_text(col: str | Column, sep: str = ";") -> Column:
    """An id array as text, ascending, so results hash alike across engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), sep)
