"""Queries over the driver tables and their SQL."""

from __future__ import annotations

import functools

from .plans import raster_queries, reconcile_queries, rule_queries, spatial_queries, terrain_queries
from .session import scratch

QUERIES: dict = rule_queries.QUERIES | raster_queries.QUERIES | spatial_queries.QUERIES | reconcile_queries.QUERIES | terrain_queries.QUERIES
SQL: dict = rule_queries.SQL | raster_queries.SQL | spatial_queries.SQL | reconcile_queries.SQL | terrain_queries.SQL

#: Queries that write tables on the way; those go once the result is written.
_WRITING = "prominence prominence_filter fill_sinks fill_sinks_slope watershed_labels region_centroids flow_accumulation routing_target knn_name_join knn_match near_calc reciprocal_nearest nearest_preferred partner_lookup neighbor_land border_line pair_components group_ids".split()


def _scoped(name: str, query):
    @functools.wraps(query)
    def run(spark, sf):
        with scratch() as work:
            return work.keep(query(spark, sf), name)

    return run


QUERIES |= {name: _scoped(name, QUERIES[name]) for name in _WRITING}
