"""Records of several sources to target shares of the tokens: a multivariate-hypergeometric splitting tree over blocks.

The documents of a source stand in a random order; a block is a run of it of fixed size in tokens. How many blocks a source
gives follows from its quota. A binary tree divides the vector of these numbers among the output shards: each node draws its
left half hypergeometrically, so every shard is a uniform draw without replacement. The draws of a node are seeded by the
node, so a task finds its shards' by going down from the root, whatever other tasks do. Shards take disjoint runs of the
permuted blocks and shuffle their documents locally. Orders and sums of a source are made over range partitions; no source,
however large, is in one task, and the driver sees a row for each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BLOCK_TOKENS = 32_768
SHARD_TOKENS = 4_000_000


def quotas(targets: DataFrame, have: DataFrame, total: int | None = None) -> DataFrame:
    """(source, quota_tokens): tokens to take of each source that has a target and documents, from (source, target_share, max_repeats)
    and (source, have_tokens).

    Without ``total``: as many in all as every source can meet its share of, repeated at most as often as allowed; shares of sources
    without documents go to the others in proportion. With ``total``: shares of it, what a source cannot give being spread over the
    others in proportion until none has room.
    """
    live = targets.join(have, "source").filter("target_share > 0 and max_repeats > 0 and have_tokens > 0").withColumn("cap", F.col("have_tokens") * F.col("max_repeats"))
    level = F.col("cap") / F.col("target_share")  # the total per share at which a source is used up
    every = Window.partitionBy(F.lit(0))  # a row for each source with a target
    if total is None:
        return live.select("source", F.least("cap", F.round(F.min(level).over(every) * F.col("target_share")).cast("long")).alias("quota_tokens"))
    # sources by the level at which they are used up: those before it give all they have, the others share what is left
    by = every.orderBy(level, "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    x = live.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("target_share").over(every) - F.coalesce(F.sum("target_share").over(before), F.lit(0.0)))
    x = x.withColumn("reach", (F.lit(float(total)) - F.col("used")) / F.col("open"))  # the level if this source and all after it stay open
    found = F.min(F.when(F.col("reach") <= level, F.struct(level.alias("level"), "source", "reach"))).over(every)["reach"]  # the first
    return x.select("source", F.when(found.isNull(), F.col("cap")).otherwise(F.least("cap", F.round(found * F.col("target_share")).cast("long"))).alias("quota_tokens"))


def _draw(counts: np.ndarray, shards: int, seed: int, node: int) -> np.ndarray:
    """What a node of the tree gives its left child, which has half of its shards."""
    take = int(counts.sum()) * (shards // 2) // shards
    if not take:
        return np.zeros_like(counts)
    return np.random.default_rng([seed, node]).multivariate_hypergeometric(counts, take, method="marginals")


def shards_between(counts: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first block, blocks) for each source of the shards from ``first`` up to ``last``; only these branches are gone down."""

    def down(node: int, lo: int, hi: int, start: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, start, own
            return
        left = _draw(own, hi - lo, seed, node)
        mid = lo + (hi - lo) // 2
        yield from down(2 * node, lo, mid, start, left)
        yield from down(2 * node + 1, mid, hi, start + left, own - left)

    yield from down(1, 0, shards, np.zeros_like(counts), counts)


def _places(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (id, source, tokens) with ``place``: the tokens that stand before it in the random order of its source."""
    d = docs.withColumn("key", F.xxhash64(F.lit(seed), "id", "tokens"))
    order = [F.col("key"), F.col("id"), F.col("tokens")]
    # one materialised range partitioning: its partition numbers are part of the rows
    p = materialise(d.repartitionByRange(F.col("source"), *order).withColumn("_p", F.spark_partition_id()))
    sums = p.groupBy("source", "_p").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = sums.select("source", "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("_p", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = p.withColumn("run", F.coalesce(F.sum("tokens").over(here), F.lit(0)))
    return run.join(base, ["source", "_p"]).withColumn("place", F.col("run") + F.col("base")).drop("_p", "run", "base", "key")


def mix(
    docs: DataFrame, id_: str, source: str, tokens: str, targets: DataFrame, total: int | None = None, seed: int = 29, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS
) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, position, id, source, repeat_no, tokens) and the shares reached (source, have_tokens, target_share, max_repeats,
    quota_tokens, mix_tokens, actual_share, max_used).

    ``targets`` has source, target_share and max_repeats, a row per source (of repeated rows the largest values count). Documents
    of null source or of sources without a target are not drawn, targets without documents are reported with share 0, and both
    appear in the shares. Documents of null or no tokens are not drawn. A source stops at the document that brings it nearest to its
    quota, so it is off by at most half a document. No document is drawn more often than ``max_repeats``. A shard holds at most
    ``shard_tokens`` and a block, unless single documents are longer than a block.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_).alias("id"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens")).filter("source is not null and tokens > 0")
    t = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).filter("source is not null")
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = materialise(d.groupBy("source").agg(F.sum("tokens").alias("have_tokens")))
    want = materialise(quotas(t, have, total).filter("quota_tokens > 0"))
    placed = _places(d.join(want.select("source"), "source", "left_semi"), seed).join(want.join(have, "source"), "source")
    # the order of a source is gone through again for each repeat; a document is taken if the quota reaches its middle
    again = F.explode(F.sequence(F.lit(0), F.ceil(F.col("quota_tokens") / F.col("have_tokens")).cast("int") - 1))
    taken = placed.withColumn("repeat_no", again).withColumn("place", F.col("place") + F.col("repeat_no") * F.col("have_tokens"))
    taken = taken.filter(F.col("place") + F.col("tokens") / 2 <= F.col("quota_tokens"))
    taken = taken.select("id", "source", "repeat_no", "tokens", F.floor(F.col("place") / block_tokens).alias("block"))
    # the root of the tree: blocks of each source, one number for each source that has a target
    rows = want.select("source", F.ceil(F.col("quota_tokens") / block_tokens).alias("n")).orderBy("source").collect()
    names, counts = [r.source for r in rows], np.array([r.n for r in rows], np.int64)
    per_shard = max(1, shard_tokens // block_tokens - 1)  # leaves of the tree differ by a block
    shards = max(1, -(-int(counts.sum()) // per_shard))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in b.column(0).to_pylist():
                s, at, blocks = [], [], []
                for shard, start, own in shards_between(counts, shards, lo, min(lo + 256, shards), seed):
                    for i in np.flatnonzero(own).tolist():
                        n = int(own[i])
                        s += [names[i]] * n
                        blocks += range(int(start[i]), int(start[i]) + n)
                        at += [shard] * n
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(blocks, pa.int64()), pa.array(at, pa.int64())], ["source", "block", "shard"])

    dealt = spark.range(0, shards, 256).mapInArrow(leaves, "source string, block long, shard long")
    out = taken.join(dealt, ["source", "block"]).withColumn("order", F.xxhash64(F.lit(seed + 2), "shard", "repeat_no", "id"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("order", "id", "repeat_no")) - 1  # a shard is of bounded size
    out = materialise(out.select("shard", place.alias("position"), "id", "source", "repeat_no", "tokens"))
    reached = out.groupBy("source").agg(F.sum("tokens").alias("mix_tokens"), (F.max("repeat_no") + 1).alias("max_used"))
    shares = t.join(have, "source", "full").join(want, "source", "left").join(reached, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    every = F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))  # a row for each source
    actual = F.coalesce(F.col("mix_tokens") / every, F.lit(0.0)).alias("actual_share")
    shares = shares.select("source", zero("have_tokens"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", zero("quota_tokens"), zero("mix_tokens"), actual, zero("max_used"))
    return out.withColumnRenamed("id", id_).withColumnRenamed("source", source), shares
