"""Places in a whole order, with the tables between in the shared folder that release() clears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import ordering
from .common import stage


def running(rows: DataFrame, by: list[Column], value: str | None = None) -> DataFrame:
    """functions.ordering.running with the subpackage's own stage tables."""
    return ordering.running(rows, by, value, stage)
