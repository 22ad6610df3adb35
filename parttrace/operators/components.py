"""Connected components of record links, by contraction: no task or driver holds all links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled


def connected(edges: DataFrame) -> DataFrame:
    """Of edges (src, dst): rows (id, component) of every id with an edge; the component is its smallest id.

    Each round points ids to their smallest neighbour, follows the pointers once more and rewrites the links to where
    their ends point; a round settles two tables, its pointers and the links that are left. Rounds' pointers are followed
    one after the other at the end.
    """
    links, rounds = settled(edges.select("src", "dst").where("src != dst").distinct()), []
    while not links.isEmpty():
        ends = links.union(links.select("dst", "src")).toDF("id", "other")
        lower = ends.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("root"))
        # an id that points to itself is a root already; only the others' pointers are looked up
        above = lower.where("id != root").toDF("root", "above")
        rounds.append(settled(lower.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root"))))
        moved = links.join(rounds[-1].toDF("src", "a"), "src").join(rounds[-1].toDF("dst", "b"), "dst")
        links = settled(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).where("src != dst").distinct())
    if not rounds:
        return links.toDF("id", "component")
    labels = rounds[0].toDF("id", "component")
    for later in rounds[1:]:
        labels = labels.join(later.toDF("component", "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return labels
