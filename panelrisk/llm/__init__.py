"""Training-data operators: filtering, deduplication, packing, sharding, archives, search, tokenisation.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLE`` hold the registered queries and their DuckDB SQL.
"""
