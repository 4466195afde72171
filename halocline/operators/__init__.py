"""Relational operators over grids: points, quality, partitions, local grids, meshes, fields and content hashes."""
