"""Streams of documents and links. The batch operators have no streaming counterpart to match; these are affordances for continuous intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrivals(docs: DataFrame, every: str = "1 day", late: str = "90 days") -> DataFrame:
    """Documents per source and window of ``posted_at``; rows later than ``late`` are dropped by the watermark of a stream, and may be kept
    aside by ``overdue``. Documents come up to 60 days late. For streams and tables alike."""
    d = docs.withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    d = d.withWatermark("posted_at", late) if docs.isStreaming else d
    return d.groupBy(F.window("posted_at", every).alias("w"), "source").agg(F.count(F.lit(1)).alias("documents")).select(F.col("w.start").alias("from"), "source", "documents")


def overdue(docs: DataFrame, late: str = "90 days") -> DataFrame:
    """The side table of ``arrivals``: documents received more than ``late`` after they were posted. In order of receipt, no other
    document can be dropped by its watermark. Keeps no state."""
    return docs.filter(F.col("received_at").cast("timestamp") > F.col("posted_at").cast("timestamp") + F.expr(f"interval {late}"))


def delivered_once(links: DataFrame, late: str = "90 days") -> DataFrame:
    """Links without those delivered again within ``late`` of a delivery that was kept; one that comes later than that is a new one. Links come
    again up to 61 days later. Hand-typed ones have no id and no offset, so the text tells them apart. A stream forgets a link only when
    its watermark has passed, so it may take a delivery for a repeat that a table takes for new, never the other way round."""
    keys = ["doc_id", "start_offset", "id", "text"]
    timed = links.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    if links.isStreaming:
        return timed.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in timed.columns if c not in keys]
    row = F.struct(F.coalesce("loaded_at", F.lit(None).cast("timestamp")).alias("_at"), *rest)
    fresh = lambda acc, x: (F.size(acc) == 0) | (x["_at"] > F.element_at(acc, -1)["_at"] + F.expr(f"interval {late}"))
    kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda acc, x: F.when(fresh(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    per = timed.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_all"))  # the deliveries of one link
    return per.select(*keys, F.explode(kept).alias("_x")).select(*[F.col(c) if c in keys else F.col(f"_x.{c}") for c in timed.columns])


def usable(sentences: DataFrame) -> DataFrame:
    """The sentence filter, which keeps no state and so runs on a stream as it is."""
    from ..operators.ingest import usable_sentences

    return usable_sentences(sentences)
