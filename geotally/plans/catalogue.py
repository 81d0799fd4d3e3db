"""Every query of the library and its SQL."""

from __future__ import annotations

from geotally.plans import contracts, evaluation, learning, preparation, rasters, space, statistics  # noqa: F401
from geotally.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
