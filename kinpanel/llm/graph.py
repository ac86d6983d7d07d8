"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.llm.common import stored

_MOST = 60


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node of ``links`` (columns ``a``, ``b``, not null).

    Large and small stars in turn (Kiveris et al., 2014): each round ties nodes to the smallest neighbour they know, until
    nothing changes; the number of rounds grows with the logarithm of the longest path. Every round is a written table.
    """
    ends = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stored(links.filter("a <> b").select(*ends).distinct())
    mark = None
    for _ in range(_MOST):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is the smallest of its neighbours keeps them through the line above; others pass them on.
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stored(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
