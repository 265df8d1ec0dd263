"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.clustering import components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", thinned: bool = False) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component. `thinned`: each task's edges are a forest already."""
    return components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), thinned)
