"""What several test modules read results with."""

from datetime import datetime

from panelweave.operators.blocks import with_row_slot


def t(text: str) -> datetime:
    return datetime.fromisoformat(text)


def values(df, pollutant=None, column="value"):
    """Values of one series in time order."""
    rows = df.filter(df.pollutant == pollutant) if pollutant else df
    return [r[column] for r in rows.orderBy("ts").collect()]


def numbered(df):
    return with_row_slot(df)
