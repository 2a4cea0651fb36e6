"""Ancestors, depths and parents in a term graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.session import written

def edges(terms: DataFrame, node: str = "id", parents: str = "parents") -> DataFrame:
    return terms.select(F.col(node).alias("child"), F.explode(parents).alias("parent")).where("child is not null and parent is not null and child <> parent").distinct()


def closure(links: DataFrame, cycles: str = "raise") -> DataFrame:
    """Every ancestor of every node with the least number of hops: node, ancestor, hops.

    Paths double in length each round (those known are joined with themselves), so a graph of any depth takes the logarithm of its
    depth in rounds; each is written to the shared folder, and the last is the one that changes nothing. A cycle raises ValueError, or, if
    ``cycles`` is ``keep``, its nodes are ancestors of each other, but never of themselves.
    """
    step = links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops"))
    found, before = written(step, "closure"), None
    while True:
        state = found.agg(F.count("*").alias("n"), F.sum("hops").alias("hops"), F.max(F.col("node") == F.col("ancestor")).alias("cycle")).first()
        if state["cycle"] and cycles == "raise":
            raise ValueError("the links have a cycle")
        if (state["n"], state["hops"]) == before:
            return found.where("node <> ancestor")
        before = (state["n"], state["hops"])
        upper = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("hops").alias("more"))
        longer = found.join(upper, "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("hops") + F.col("more")).alias("hops"))
        found = written(found.union(longer).groupBy("node", "ancestor").agg(F.min("hops").alias("hops")), "closure")


def root_of(links: DataFrame) -> str | None:
    """The node without parents that the most links end at; of several the least id. One row is collected."""
    tops = links.groupBy(F.col("parent").alias("node")).count().join(links.select(F.col("child").alias("node")), "node", "left_anti")
    row = tops.orderBy(F.desc("count"), "node").first()
    return row["node"] if row else None


def depths(ancestors: DataFrame, root: str) -> DataFrame:
    """Hops from each node to the root; nodes that don't reach it are left out."""
    return ancestors.where(F.col("ancestor") == root).select("node", F.col("hops").alias("depth"))


def descendants(ancestors: DataFrame) -> DataFrame:
    return ancestors.groupBy(F.col("ancestor").alias("node")).agg(F.countDistinct("node").alias("descendants"))


def nearest_parent(ancestors: DataFrame, used: DataFrame, depth: DataFrame, least_depth: int, most_descendants: int) -> DataFrame:
    """The nearest ancestor that occurs in ``used``, deep enough and not too general: node, parent, hops. Ties go to the lesser id."""
    fit = ancestors.join(used.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    fit = fit.join(depth.where(F.col("depth") >= least_depth).select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    few = descendants(ancestors).where(F.col("descendants") < most_descendants).select(F.col("node").alias("ancestor"))
    return fit.join(few, "ancestor", "left_semi").groupBy("node").agg(F.min(F.struct("hops", "ancestor")).alias("best")).select("node", F.col("best.ancestor").alias("parent"), "best.hops")


def lowest_common(ancestors: DataFrame, groups: DataFrame, depth: DataFrame) -> DataFrame:
    """Of each group of nodes (grp, node) the deepest node that is an ancestor of all or one of them: grp, common."""
    self = groups.select("grp", "node", F.col("node").alias("ancestor"))
    up = groups.join(ancestors, "node").select("grp", "node", "ancestor").union(self)
    sizes = groups.groupBy("grp").agg(F.countDistinct("node").alias("n"))
    all_ = up.groupBy("grp", "ancestor").agg(F.countDistinct("node").alias("k")).join(sizes, "grp").where("k = n")
    deep = all_.join(depth.withColumnRenamed("node", "ancestor"), "ancestor", "left")
    return deep.groupBy("grp").agg(F.max(F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "ancestor")).alias("best")).select("grp", F.col("best.ancestor").alias("common"))
