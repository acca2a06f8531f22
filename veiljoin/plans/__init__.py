"""Experiment grids, and the queries with their SQL."""
