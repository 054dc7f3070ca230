"""Connected components of an edge table, by alternating large-star and small-star steps, and the pairs within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge, ``root`` being the least node it is linked to over any number of edges.

    Each round is two aggregates; a hub's neighbours are never collected. Rounds go on until one
    changes nothing; their number grows with the logarithm of the longest chain.
    Self-links and null ends are ignored; an empty edge table gives no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = materialise(e)
    before = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small)
        # a fingerprint of the edge set tells when a round has changed nothing
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(e.select("v", "v").distinct().join(roots, F.col("v") == F.col("node"), "left_anti").toDF("node", "root"))


def pairs_within(df: DataFrame, keys: list[str], item: str, hot: int) -> DataFrame:
    """(a, b), a < b, of the items of each group. A group of more than ``hot`` falls into shares by hash; each share meets the whole group in a
    place of its own, so that many tasks expand it. ``df`` should be materialised: it is read more than once."""
    size = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("shares")).filter("shares > 1")
    left, right = df.select(*keys, F.col(item).alias("a")), df.select(*keys, F.col(item).alias("b"))
    if not size.isEmpty():
        one = lambda d: d.join(size, keys, "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        left = one(left).withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int")).drop("shares")
        right = one(right).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        keys = [*keys, "share"]
    return left.join(right, keys).filter("a < b").select("a", "b")
