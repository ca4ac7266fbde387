"""Named queries over the driver tables and the DuckDB statements they are checked against."""

from __future__ import annotations

from headway.plans.oracles import ORACLES
from headway.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
