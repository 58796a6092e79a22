"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this package; ``queries.py`` holds its
registered queries and ``oracles.py`` their DuckDB SQL.
"""
