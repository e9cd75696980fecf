"""Groups of records linked by pairwise matches: connected components by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.skew import hot_limit, join_counted
from codeloom.session import Scratch

#: Rewrites of this many rounds settle any graph that fits in memory of a cluster; more mean an error.
MAX_ROUNDS = 100


def _neighbours(edges: DataFrame) -> DataFrame:
    """(node, least, degree) of both ends of all edges (hi, lo): the least neighbour below the node, null if none, and its edges.

    Partial aggregation leaves one row per node and partition before the shuffle, also for nodes with many edges.
    """
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("least")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(None).cast("bigint").alias("least")))
    return ends.groupBy("node").agg(F.min("least").alias("least"), F.count("*").alias("degree"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node above x that is linked to x is linked to x's least neighbour instead."""
    # Minima without a lower neighbour matter only where they are hubs: their rows must not meet in one shuffle partition.
    near = _neighbours(edges).where(F.col("least").isNotNull() | (F.col("degree") > hot_limit(rows))).withColumnRenamed("node", "lo")
    moved = join_counted(edges, near, "lo", "degree", rows, "left")
    return moved.select("hi", F.coalesce("least", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every neighbour below x, and x itself, is linked to x's least neighbour."""
    near = _neighbours(edges).where("least IS NOT NULL").withColumnRenamed("node", "hi")
    heads = near.select("hi", F.col("least").alias("lo"))
    moved = join_counted(edges, near, "hi", "degree", rows).where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return heads.unionByName(moved).distinct()


def _leaves(edges: DataFrame) -> DataFrame:
    """The edges (hi, lo) of nodes that have no other edge and are linked to a lower one: whatever group that is in, they are in it, and not its least."""
    near = edges.select(F.col("hi").alias("node"), "lo").unionByName(edges.select(F.col("lo").alias("node"), F.lit(None).cast("bigint").alias("lo")))
    return near.groupBy("node").agg(F.min("lo").alias("lo"), F.count("*").alias("n")).where("n = 1 AND lo IS NOT NULL").select(F.col("node").alias("hi"), "lo")


def _followed(leaves: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """(node, group_id) of leaves: the group of the node each is linked to, which is that node itself if it has none in ``groups``."""
    named = groups.select(F.col("node").alias("lo"), "group_id")
    if rows <= hot_limit(rows):
        met = leaves.join(named, "lo", "left")
    else:
        met = join_counted(leaves, named.join(leaves.groupBy("lo").agg(F.count("*").alias("n")), "lo"), "lo", "n", rows, "left")
    return met.select(F.col("hi").alias("node"), F.coalesce("group_id", "lo").alias("group_id"))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, group_id): every node of ``edges`` (a, b) with the least node of its component.

    Rows with a null end and loops link nothing and are left out. Large-star and small-star alternate until every node is linked to its component's minimum
    and to nothing else. A node that is already linked to one lower node only needs no more rewriting: it leaves the edges before each round and takes the group of
    that node in the end, so rounds go on with what is still tangled, and end when nothing is. Each step is written to the shared folder, which ends its
    lineage, and what is no longer needed is deleted.
    """
    scratch = Scratch(spark, "components")
    rows = F.count("*").alias("rows")
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = scratch.cut(clean.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    left: list[tuple[DataFrame, int]] = []
    for _ in range(MAX_ROUNDS):
        leaves, found = scratch.cut_counted(_leaves(current), rows)
        left.append((leaves, found["rows"]))
        rest, more = scratch.cut_counted(current.join(leaves.select("hi"), "hi", "left_anti"), rows)
        scratch.drop(current)
        if not more["rows"]:
            break
        large = scratch.cut(_large_star(rest, more["rows"]))
        scratch.drop(rest)
        current = scratch.cut(_small_star(large, more["rows"]))
        scratch.drop(large)
    else:
        raise RuntimeError("the components did not settle")
    groups = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("group_id"))
    for leaves, count in reversed(left):
        if count:
            more = groups.unionByName(scratch.cut(_followed(leaves, groups, count)))
            scratch.drop(leaves)
            groups = more
    return groups.unionByName(groups.select(F.col("group_id").alias("node"), "group_id").distinct())


def match_groups(spark: SparkSession, pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(node_id, group_id): one row for every id that occurs in node_id_a or node_id_b of ``pairs``.

    A row links its two ids if both are present and its similarity is a number of at least ``threshold``, taken at the
    column's own precision; null and NaN link nothing. An id without links has its own id. No rows give no rows; other columns are ignored.
    """
    kind = dict(pairs.dtypes)["similarity"]
    similar = (~F.isnan("similarity")) & (F.col("similarity") >= F.lit(threshold).cast(kind))
    found = components(spark, pairs.where(similar).select(F.col("node_id_a").alias("a"), F.col("node_id_b").alias("b")))
    ids = pairs.select(F.explode(F.array("node_id_a", "node_id_b")).alias("node_id")).where("node_id IS NOT NULL").distinct()
    return ids.join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("group_id", "node_id").alias("group_id"))
