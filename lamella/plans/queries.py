"""Registered queries of the volume, surface, depth and measurement operators, with their SQL."""

from lamella.plans import depth_queries, file_queries, measurement_queries, numeric_queries, volume_queries

QUERIES = {**depth_queries.QUERIES, **volume_queries.QUERIES, **measurement_queries.QUERIES, **numeric_queries.QUERIES, **file_queries.QUERIES}
ORACLE_SQL = {**depth_queries.ORACLE_SQL, **volume_queries.ORACLE_SQL, **measurement_queries.ORACLE_SQL, **file_queries.ORACLE_SQL}
