"""Named queries over grids and tables, and the same in DuckDB SQL."""
