"""Connected components of a table of links, with every step a DataFrame job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def components(links: DataFrame, keep) -> DataFrame:
    """(v, c): the smallest vertex reachable from each vertex of the links (a, b).

    Alternating large and small stars (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): each round ties the
    larger neighbours of a vertex, and then the smaller ones, to the smallest of them, until every vertex is tied to the smallest of
    its component; the number of rounds is about the logarithm of the size. Minima are partial aggregates and the
    joins are plain equi-joins, so a vertex with a third of all links is split at run time. ``keep`` writes
    a table and reads it again (``Scratch.keep``).
    """
    edges = keep(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("c")).where("v != c").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("c").alias("v"), F.col("v").alias("c")))
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("c")).alias("m"))
        large = both.join(least, "v").where("c > v").select(F.col("c").alias("v"), F.col("m").alias("c"))
        lower = large.groupBy("v").agg(F.min("c").alias("m"))
        tied = large.join(lower, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("c")), F.struct(F.col("c").alias("v"), F.col("m").alias("c")))).alias("e"))
        tied = tied.select("e.v", "e.c").where("v != c").distinct()
        state = Observation()
        edges = keep(tied.observe(state, F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "c")).alias("x")))
        now = state.get
        if now == before:
            return edges.unionByName(edges.select(F.col("c").alias("v"), "c").distinct())
        before = now
