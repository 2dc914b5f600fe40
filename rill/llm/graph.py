"""Connected components by repeated contraction, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rill.llm.common import dropped, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b: long); root is one node of the component, the same for all.

    Each round every node picks its smallest neighbour (or itself, if smaller), follows two picks, and edges
    are renamed and made distinct; edges within a name disappear. A contracted graph stays connected where the
    former one was, and the picks halve paths at least, so rounds grow with the logarithm of the largest
    component. Picks are minima, which Spark combines before its exchange: a node with very many edges costs
    one task no more than another. Each round is written to the shared folder.

    Null ends and loops are ignored; an empty graph gives no rows.
    """
    left = saved(edges.where("a < b").select("a", "b").union(edges.where("a > b").select("b", "a")).distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        picks = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("pick")))
        second = picks.select(F.col("node").alias("pick"), F.col("pick").alias("root"))
        roots = saved(picks.join(second, "pick").select("node", "root"))
        rounds.append(roots)
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        named = left.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        former, left = left, saved(named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        dropped(former, picks)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds.pop()
    while rounds:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        round_, former = rounds.pop(), out
        out = saved(round_.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
        dropped(former, round_)
    return out
