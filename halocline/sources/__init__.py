"""Readers and writers: the grid registry, text grids and the columnar grid record."""
