"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` knows blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
