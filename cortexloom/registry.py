"""Registered queries and their SQL, by name."""

from cortexloom.plans import brain, sequencing

QUERIES: dict = {}
SQL: dict = {}
for _module in (sequencing, brain):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
