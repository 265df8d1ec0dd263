"""Logical inputs, queries and the SQL that checks each."""

from tessel.plans import graph_queries, link_queries, stat_queries  # noqa: F401  (they add their queries)
from tessel.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401
