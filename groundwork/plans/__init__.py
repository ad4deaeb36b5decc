"""Registered queries by family."""

from groundwork.plans import atmosphere_queries, binding_queries, kind_queries, ladder_queries, measure_queries, series_queries, span_queries, structure_queries, text_queries

_FAMILIES = (series_queries, text_queries, structure_queries, measure_queries, kind_queries, binding_queries, atmosphere_queries, ladder_queries, span_queries)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
