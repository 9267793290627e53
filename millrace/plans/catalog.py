"""All registered queries and their SQL: name -> f(spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

from . import relational_queries, sketch_queries, source_queries, streaming_queries, text_queries, udf_queries

_MODULES = (text_queries, relational_queries, sketch_queries, streaming_queries, source_queries, udf_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
