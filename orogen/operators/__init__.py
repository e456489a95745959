"""Operators on points, lines, rasters and boreholes."""
