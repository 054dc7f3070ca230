"""One ranking from several differently-scaled scores: reciprocal rank fusion.

Items are ranked separately under every score and ``sum(1 / (k + rank))`` decides, so neither
range nor shape of a score matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60.0
#: Groups with more rows than this are ranked by buckets over many tasks instead of by one window.
HOT_ROWS = 100_000
BUCKETS = 256


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _ranks(df: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    for i, s in enumerate(scores):
        df = df.withColumn(f"_r{i}", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(s).desc_nulls_last())))
    return df


def _spread_ranks(df: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """The same ranks without a task ever holding a group: count the distinct values, cut them into quantile buckets, then
    rank inside (group, bucket) and add the rows of the higher buckets. Equal values are one row by then, however many share it."""
    for i, s in enumerate(scores):
        values = df.groupBy(*keys, F.col(s).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        cuts = values.groupBy(*keys).agg(F.percentile_approx("_v", [b / BUCKETS for b in range(1, BUCKETS)], 1000).alias("_cuts"))
        v = values.alias("v").join(cuts.alias("c"), _same("v", "c", keys)).select("v.*", "c._cuts")
        v = v.withColumn("_b", F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v")))))
        v = v.drop("_cuts")
        per = v.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
        above = per.withColumn("_off", F.coalesce(F.sum("_bn").over(Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = Window.partitionBy(*keys, "_b").orderBy(F.col("_v").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        v = v.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        v = v.alias("v").join(above.alias("a"), _same("v", "a", [*keys, "_b"])).select(*[F.col(f"v.{k}") for k in keys], F.col("v._v"), (F.col("a._off") + F.col("v._in") + 1).cast("int").alias("_rank"))
        on = _same("d", "v", keys) & F.col(f"d.{s}").eqNullSafe(F.col("v._v"))
        df = df.alias("d").join(v.alias("v"), on, "left").select("d.*", F.col("v._rank").alias(f"_r{i}"))
    return df


def fuse(df: DataFrame, keys: list[str], item: str, scores: list[str], k: float = K, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each (keys, item): ``rank_<score>``, ``fused`` and ``rank_sum``.

    Rows repeated for an item count once, with the best value of each score. NaN and null scores rank last (together). A null
    item is no candidate and gives no row; null keys form a group like any other. Other columns are ignored. No rows in, none out.
    Ordinary groups take one shuffle and a window per score; groups of more than ``hot_rows`` rows go another, equally exact way.
    """
    c = [F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)]
    s = [F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")).alias(f"_s{i}") for i, x in enumerate(scores)]
    rows = df.filter(F.col(item).isNotNull()).select(*c, F.col(item).alias("_item"), *s)
    ks, ss = [f"_k{i}" for i in range(len(keys))], [f"_s{i}" for i in range(len(scores))]
    best = lambda x: x.groupBy(*ks, "_item").agg(*[F.max(c).alias(c) for c in ss])
    # one shuffle, by the keys, serves the aggregate, every window and any later aggregate by the same keys
    near = lambda x: _ranks(best(x.repartition(*[F.col(k) for k in ks])), ks, ss)
    hot = df.groupBy(*c).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows).select(*ks)
    if hot.isEmpty():
        ranked = near(rows)
    else:
        small = rows.alias("d").join(hot.alias("h"), _same("d", "h", ks), "left_anti")
        large = rows.alias("d").join(hot.alias("h"), _same("d", "h", ks), "left_semi")
        ranked = near(small).unionByName(_spread_ranks(best(large), ks, ss))
    rs = [F.col(f"_r{i}") for i in range(len(scores))]
    fused = F.round(reduce(lambda a, b: a + b, [1.0 / (F.lit(float(k)) + r) for r in rs]), 12)
    return ranked.select(
        *[F.col(a).alias(b) for a, b in zip(ks, keys)],
        F.col("_item").alias(item),
        *[r.alias(f"rank_{x}") for r, x in zip(rs, scores)],
        fused.alias("fused"),
        reduce(lambda a, b: a + b, rs).alias("rank_sum"),
    )


def first_of(fused: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The item with the largest fused score of each group of two items or more; ties go to the smaller rank sum, then the smaller item."""
    # max over (fused, -rank_sum), then the least item among equals: an aggregate with map-side combine, no sort of a group
    best = F.max(F.struct("fused", (-F.col("rank_sum")).alias("neg"))).alias("_best")
    n = F.count(F.lit(1)).alias("_n")
    lead = F.min_by(item, F.struct((-F.col("fused")).alias("a"), F.col("rank_sum").alias("b"), F.col(item).alias("c"))).alias(item)
    return fused.groupBy(*keys).agg(best, n, lead).filter("_n > 1").select(*keys, item)
