"""Streams of observations on grids."""
