"""Connected components of a link table, by label propagation with shortcuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node that has a link.

    Each round gives a node the smallest label among its own, its neighbours' and
    its label's label, until nothing changes. Links and labels stay in Spark;
    each round's labels are written to the shared folder, which cuts the lineage.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    with scratch(links.sparkSession) as keep:
        return _labels(links, keep)


def _labels(links: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = stored(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    last = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        labels = last.select("node", "component")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = (
            labels.join(near, "node")
            .join(own, "component")
            .select("node", F.least("component", "near", "above").alias("component"), (F.least("near", "above") < F.col("component")).alias("moved"))
        )
        new = keep(new)
        drop(last)
        last = new
        if not new.where("moved").limit(1).count():
            return new.select("node", "component")
