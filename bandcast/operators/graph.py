"""Connected components by alternating large-star and small-star rounds.

Each round rewires the edge list: *large-star* links every neighbour larger
than a node to the smallest node around it, *small-star* links the node and
its smaller neighbours to the smallest of them.  Every component shrinks to
a star centred on its smallest node; the loop ends when a round changes
nothing, so there is no round limit and no early result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandcast.session import cut_lineage

#: Beyond so many edges a round's joins are never broadcast: the planner sizes edges by the (compressed) file they came from.
BROADCAST_EDGES = 1 << 18


def _joined(e: DataFrame, least: DataFrame, on: Column, n: int) -> DataFrame:
    return e.join(least if n <= BROADCAST_EDGES else least.hint("merge"), on)


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _joined(both.filter("b > a"), least, F.col("a") == F.col("u"), n) \
        .select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    # e holds a < b: the smaller neighbours of b are its a's
    least = e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    moved = _joined(e, least, F.col("b") == F.col("u"), n).select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(own).filter("a < b").distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", node: str = "id",
                         label: str = "component") -> DataFrame:
    """(node, label): the smallest node of its component, for every node that has an edge to another.

    Every round is written by a reliable checkpoint, so lineage stays flat
    and a lost executor repeats one round at most; the driver gets one count
    and one checksum per round.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    e = cut_lineage(e)
    mark = _mark(e)
    while mark[0]:
        e = cut_lineage(_small_star(_large_star(e, mark[0]), mark[0]))
        new = _mark(e)
        if new == mark:
            break
        mark = new
    members = e.select(F.col("b").alias(node), F.col("a").alias(label))
    roots = e.select(F.col("a").alias(node), F.col("a").alias(label)).distinct()
    return members.unionByName(roots)
