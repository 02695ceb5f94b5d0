"""Calendar one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full weekday names and three-letter month names.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def weekday_flags(ts: Column) -> list[Column]:
    """One boolean per weekday, named after it."""
    return [(F.weekday(ts) == i).alias(name) for i, name in enumerate(WEEKDAYS)]


def month_flags(ts: Column) -> list[Column]:
    """One boolean per month, named by its three letters."""
    return [(F.month(ts) == i + 1).alias(name) for i, name in enumerate(MONTHS)]
