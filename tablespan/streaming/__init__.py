"""Filters over streams, an extension: the grid's own operations are all on tables at rest."""
