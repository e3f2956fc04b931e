"""Connected components by alternating star contraction, in joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import kept


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root): for every vertex of links (u, v) the least vertex that it reaches.

    In a large star, each vertex links its larger neighbours to its least one; in a
    small star, itself and its smaller neighbours.  No vertex's neighbours are ever gathered: minima are
    summed up before the shuffle and joined back.
    """
    edges = kept(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), few=True)
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = kept(small.where("u != v").distinct(), few=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("u"), "root").distinct())
