"""Relational operators: statistics, grids, graphs, spatial joins, cells and frames."""
