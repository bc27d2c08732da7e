"""Order and identity of observations in a price series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SKEY = ["observed_at", "created_at", "snapshot_id"]


def skey() -> Column:
    """The total order of observations, as one value."""
    return F.struct(*SKEY)


def price() -> Column:
    """The price that history looks at: the effective one where it is known."""
    return F.coalesce("effective_paise", "displayed_paise")


def qualifies() -> Column:
    return F.col("confidence").isin("high", "medium")


def along(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*SKEY)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)
