"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame; most have a DuckDB twin."""

from . import attention, facts, landed, runs

QUERIES = {**attention.QUERIES, **facts.QUERIES, **landed.QUERIES, **runs.QUERIES}
SQL = {**attention.SQL, **facts.SQL, **landed.SQL, **runs.SQL}
