"""Connected components of an edge table, without collecting it.

Large-star and small-star steps in turn: every node hooks its larger neighbours
(and then itself with its smaller ones) to the smallest node it sees, until every edge leads from a node with no other edge to a
root. Minima are combined before each shuffle, so a node with very many
edges costs one partial row per task there, and each round is stored in the
shared folder, so lineage stays short. Minima of up to ``FEW`` edges are broadcast,
so a round of a small graph is one short job; those of more are stored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges whose minima may be broadcast: a few MB.
FEW = 1 << 17


def _met(rows: DataFrame, least: DataFrame, path: str, few: bool) -> DataFrame:
    """``rows`` with the smallest neighbour of their node ``a``. Minima of many edges
    are stored, so both sides come to the join as they are dealt, and adaptive
    execution can split the rows of a node with very many edges."""
    if few:
        return rows.join(F.broadcast(least), "a")
    return rows.join(common.stored(least, path).hint("merge"), "a")


def _large_star(edges: DataFrame, path: str, few: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _met(both.where("b > a"), least, path, few).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, path: str, few: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    hooked = _met(down, down.groupBy("a").agg(F.min("b").alias("m")), path, few)
    other = hooked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return other.union(hooked.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (larger node, smaller node, each once) there are, and whether
    all are stars: no node has two smaller ones, or a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    size, bad = nodes.agg(F.sum("down"), F.max(((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).cast("int"))).first()
    return size or 0, not bad


def components(edges: DataFrame, work: str | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), both long: the root is the
    smallest node of the component. Self edges and repeats are allowed; nodes
    with a self edge alone have no row. The result is read from below ``work``."""
    spark = edges.sparkSession
    work = work or common.shared_dir(spark)
    path = f"{work}/0"
    now = common.stored(_small_star(edges, f"{work}/small0", False), path)
    for turn in count(1):
        size, stars = _state(now)
        if stars:
            break
        few, new_path = size <= FEW, f"{work}/{turn}"
        now = common.stored(_small_star(_large_star(now, f"{work}/large{turn}", few), f"{work}/small{turn}", few), new_path)
        common.discard(spark, path)
        path = new_path
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
