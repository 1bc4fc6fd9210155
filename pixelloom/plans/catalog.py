"""All queries of the raster operators and their SQL twins."""

from __future__ import annotations

from pixelloom.plans import documents, finder, geometry, masks, pixels, repairs, resampling, shapes, statistics, tracks, viewer, windows  # noqa: F401
from pixelloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
