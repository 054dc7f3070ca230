"""Joins of character spans inside a document, and the sentence a span lies in.

Spans are half-open. The document is the equality key, so the inequalities ride along as conditions of a hash or merge join; spans
are cut into cells of a fixed width first, so that a document with very many spans is spread over many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 512


def _celled(df: DataFrame, end: Column, only_start: bool = False) -> DataFrame:
    first = F.floor(F.col("start") / CELL)
    last = first if only_start else F.floor(F.greatest(F.col("start"), end - 1) / CELL)
    return df.withColumn("cell", F.explode(F.sequence(first, last)))


def within(outer: DataFrame, inner: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pairs whose ``inner`` lies in ``outer``. Both have ``doc``, ``start``, ``end`` and an id column (``outer_id`` / ``inner_id``)."""
    o = _celled(outer.select(doc, "outer_id", "start", "end"), F.col("end")).withColumnsRenamed({"start": "o_start", "end": "o_end"})
    i = _celled(inner.select(doc, "inner_id", "start", "end"), F.col("end"), only_start=True)
    return o.join(i, [doc, "cell"]).filter("start >= o_start and end <= o_end").select(doc, "outer_id", "inner_id")


def overlapping(left: DataFrame, right: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pairs that share a character; each once, in the cell where the later of both starts."""
    a = _celled(left.select(doc, "outer_id", "start", "end"), F.col("end")).withColumnsRenamed({"start": "o_start", "end": "o_end"})
    b = _celled(right.select(doc, "inner_id", "start", "end"), F.col("end"))
    hit = a.join(b, [doc, "cell"]).filter("start < o_end and end > o_start")
    return hit.filter(F.col("cell") == F.floor(F.greatest("start", "o_start") / CELL)).select(doc, "outer_id", "inner_id")


def equal(left: DataFrame, right: DataFrame, doc: str = "doc_id") -> DataFrame:
    return left.select(doc, "outer_id", "start", "end").join(right.select(doc, "inner_id", "start", "end"), [doc, "start", "end"]).select(doc, "outer_id", "inner_id")


def sentence_of(spans: DataFrame, sentences: DataFrame, strict: bool = False, doc: str = "doc_id") -> DataFrame:
    """The first sentence (by ``sent_num``) a span (``inner_id``) lies in, as (doc, inner_id, sent_num). ``strict``: the sentence that
    holds the span's start, but not at its own start."""
    s = _celled(sentences.select(doc, "sent_num", "start", "end"), F.col("end")).withColumnsRenamed({"start": "o_start", "end": "o_end"})
    i = _celled(spans.select(doc, "inner_id", "start", "end"), F.col("end"), only_start=True)
    fits = "start > o_start and start < o_end" if strict else "start >= o_start and end <= o_end"
    return s.join(i, [doc, "cell"]).filter(fits).groupBy(doc, "inner_id").agg(F.min("sent_num").alias("sent_num"))


def context(text: Column, offset: Column) -> Column:
    """Eighty characters around an offset, white space as blanks; a window that would begin before the text begins with it."""
    return F.regexp_replace(F.substring(text, F.greatest(F.lit(0), offset - 40) + 1, F.lit(80)), r"\s", " ")


def greedy(spans: DataFrame, keys: list[str], first: list[str] | None = None) -> DataFrame:
    """The spans left when, in order of ``first`` (columns, none by default) and then of start, each is dropped that overlaps one kept
    before. Adds nothing, drops rows.

    The spans of one group are folded; groups are arguments of one extraction, a handful of spans.
    """
    item = F.struct(*(first or []), "start", "end", "inner_id")

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    per = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("s"))
    kept = F.aggregate("s", F.slice("s", 1, 0), step)
    return per.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.start", "k.end", "k.inner_id")
