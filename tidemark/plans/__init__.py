"""Registered queries over the flood-change operators."""

from . import catalog_queries, file_queries, patch_queries, pixel_queries

QUERIES: dict = {**pixel_queries.QUERIES, **patch_queries.QUERIES, **catalog_queries.QUERIES, **file_queries.QUERIES}
ORACLES: dict = {**pixel_queries.ORACLES, **patch_queries.ORACLES, **catalog_queries.ORACLES, **file_queries.ORACLES}
