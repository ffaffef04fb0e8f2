"""Connected components of a link table, as DataFrame joins and aggregations.

Two steps alternate until nothing changes: every node hands its smallest neighbour to its
larger neighbours, then to its smaller ones. Links are never collected, aggregations combine
before they shuffle, and each round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.scale import cut_lineage


def _distinct(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") > F.col("b")).distinct()


def _to_larger(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    met = both.join(least, "a").select(
        F.col("b").alias("x"), F.least("a", "m").alias("m"), F.col("a").alias("own")
    )
    return _distinct(met.where(F.col("x") > F.col("own")).select(F.col("x").alias("a"), F.col("m").alias("b")))


def _to_smaller(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    met = links.join(least, "a").select("a", "b", "m")
    moved = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return _distinct(moved)


def components(links: DataFrame) -> DataFrame:
    """Columns `node` and `component`, the smallest node that links reach.

    `links` has two long columns `a` and `b`, in any order and possibly repeated. Nodes that no
    link names, or that are their component's smallest, have no row. Links to oneself and links
    with a null end are left out; an empty table gives an empty table.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, seen = cut_lineage(ends.distinct()), None
    while True:
        state = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen or not state[0]:
            break
        seen = state
        links = cut_lineage(_to_smaller(_to_larger(links)))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
