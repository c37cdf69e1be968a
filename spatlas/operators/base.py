"""What every kind of spatial weights offers; a class with these methods can stand in for the two of this package."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class SpatialOperator(Protocol):
    def apply(self, *args, **kwargs) -> DataFrame:
        """Lagged values, one row a value."""

    def row_sums(self) -> DataFrame:
        """One row an observation with ``row_sum``; 0 for islands."""

    def s0(self) -> DataFrame:
        """The sum of all weights."""

    def islands(self) -> DataFrame:
        """Valid observations without neighbours."""
