"""Grids, point sets and their cell tables."""

from .grids import Axis, Grid, corner_areas, hull_areas, neighbours
from .points import Points

__all__ = ["Axis", "Grid", "Points", "corner_areas", "hull_areas", "neighbours"]
