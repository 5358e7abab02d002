"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.operators.graph import connected_components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Edges with a null end are ignored; loops make their node its own component; an empty table gives an
    empty one.  Nothing is collected but whether edges are left after a round.
    """
    return connected_components(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "a", "b")
