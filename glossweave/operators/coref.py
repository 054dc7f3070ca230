"""Expansion through coreference clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LEAST_SCORE, PERSONAL, PRONOUNS
from .evaluate import FULL_KINDS
from ..functions.text import link_entity_type


def is_pronoun(text: Column) -> Column:
    return F.lower(text).isin(PRONOUNS)


def agrees(text: Column, entity_type: Column) -> Column:
    """Personal pronouns attach to people, all others to anything else."""
    return F.lower(text).isin(PERSONAL) == (entity_type == "PERSON")


def cluster_of(mentions: DataFrame) -> DataFrame:
    """(doc_id, start_offset, text, cluster_id): a mention in several clusters belongs to the last."""
    return mentions.groupBy("doc_id", "start_offset", "text").agg(F.max("cluster_id").alias("cluster_id"))


def links_of(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, id, name, entity_type) of the links that start where a mention of a cluster does; the first for each id."""
    l = links.filter("id is not null and start_offset is not null").select("doc_id", "start_offset", "id", "name", link_entity_type(F.col("types")).alias("entity_type"))
    j = mentions.select("doc_id", "cluster_id", "start_offset").distinct().join(l, ["doc_id", "start_offset"])
    return j.groupBy("doc_id", "cluster_id", "id").agg(F.min(F.struct("start_offset", "name", "entity_type")).alias("f")).select("doc_id", "cluster_id", "id", "f.name", "f.entity_type")


def best_of(mentions: DataFrame, best: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, best_mention, kind, entity_type) of the best mentions that start where a mention does; the first for each string."""
    j = mentions.select("doc_id", "cluster_id", "start_offset").distinct().join(best.select("doc_id", "start_offset", "best_mention", "kind", "entity_type", "candidate_count"), ["doc_id", "start_offset"])
    first = j.groupBy("doc_id", "cluster_id", "best_mention").agg(F.min(F.struct("start_offset", "kind", "entity_type", "candidate_count")).alias("f"))
    return first.select("doc_id", "cluster_id", "best_mention", "f.kind", "f.entity_type", "f.candidate_count")


def expand(mentions: DataFrame, links: DataFrame, best: DataFrame) -> DataFrame:
    """New mentions for the pronouns of clusters with exactly one link, else exactly one best mention: (doc_id, start_offset, text, cluster_id,
    kind, best_mention, candidate_count). Mentions need (doc_id, cluster_id, start_offset, text)."""
    one = lambda df: df.groupBy("doc_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*[c for c in df.columns if c not in ("doc_id", "cluster_id")])).alias("f")).filter("n = 1")
    by_link = one(links_of(mentions, links)).select("doc_id", "cluster_id", F.lit("LinkResolved").alias("kind"), F.col("f.name").alias("best_mention"), "f.entity_type", F.lit(1.0).alias("candidate_count"))
    b = one(best_of(mentions, best)).join(by_link.select("doc_id", "cluster_id"), ["doc_id", "cluster_id"], "left_anti")
    # whatever is full by its kind stays full; identities become full mentions of their entity; all others are only coreferent
    kind = F.when(F.col("f.kind").isin(FULL_KINDS), "CorefFull").when(F.col("f.kind") == "Identity", "CorefIdentity").otherwise("Coref")
    by_best = b.select("doc_id", "cluster_id", kind.alias("kind"), "f.best_mention", "f.entity_type", F.when(kind == "CorefIdentity", 1.0).otherwise(F.col("f.candidate_count")).alias("candidate_count"))
    says = by_link.unionByName(by_best)
    pronouns = mentions.select("doc_id", "cluster_id", "start_offset", "text").distinct().filter(is_pronoun(F.col("text")))
    out = pronouns.join(says, ["doc_id", "cluster_id"]).filter(agrees(F.col("text"), F.col("entity_type")))
    return out.select("doc_id", "start_offset", "text", "cluster_id", "kind", "best_mention", "candidate_count")


def link_entities(links: DataFrame) -> DataFrame:
    """(doc_id, text, start_offset, name, entity_type): the entity a link stands for, by what its types speak for."""
    return links.select("doc_id", "text", "start_offset", "name", link_entity_type(F.col("types")).alias("entity_type"))


def best_links(links: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The best candidate of each mention (doc_id, start_offset, text), if its score is ``least`` or more: what a linker answers. Of equal
    scores the smaller id is taken; repeated deliveries count once. Mentions without offset or candidates have none."""
    l = links.filter("id is not null and start_offset is not null and score is not null")
    rest = [c for c in ("name", "doc_sim_score", "candidate_score", "inlinks", "types") if c in links.columns]
    best = F.min(F.struct((-F.col("score")).alias("neg"), "id", *rest)).alias("b")
    one = l.groupBy("doc_id", "start_offset", "text").agg(best)
    return one.select("doc_id", "start_offset", "text", (-F.col("b.neg")).alias("score"), "b.id", *[f"b.{c}" for c in rest]).filter(F.col("score") >= least)


def usable_links(links: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    return links.filter(F.col("score") >= least)


def link_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links of one system that the other lacks, by (doc_id, start_offset, text, id), tagged BASELINE or NEW."""
    keys = ["doc_id", "start_offset", "text", "id"]
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("system", F.lit("BASELINE")).unionByName(b.join(a, keys, "left_anti").withColumn("system", F.lit("NEW")))


def tagged_union(systems: dict[str, DataFrame]) -> DataFrame:
    """The rows of several systems one under another, each with its ``system``."""
    out = None
    for name, df in systems.items():
        t = df.withColumn("system", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def argument_sentences(args: DataFrame, mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, arg_id, sent_num): the sentences of all mentions of the clusters of the mentions inside an argument. ``args`` have
    (doc_id, arg_id, start, end), mentions (doc_id, cluster_id, start_offset, text), sentences (doc_id, sent_num, start, end)."""
    from .spans import sentence_of, within

    m = mentions.withColumn("end", F.col("start_offset") + F.length("text")).withColumn("key", F.concat_ws(":", "start_offset", "text"))
    inside = within(args.withColumnRenamed("arg_id", "outer_id"), m.select("doc_id", F.col("key").alias("inner_id"), F.col("start_offset").alias("start"), "end"))
    owner = cluster_of(mentions).withColumn("inner_id", F.concat_ws(":", "start_offset", "text"))
    clusters = inside.join(owner.select("doc_id", "inner_id", "cluster_id"), ["doc_id", "inner_id"]).select("doc_id", F.col("outer_id").alias("arg_id"), "cluster_id").distinct()
    where = sentence_of(m.select("doc_id", F.col("key").alias("inner_id"), F.col("start_offset").alias("start"), "end").distinct(), sentences)
    of_mention = m.select("doc_id", "cluster_id", F.col("key").alias("inner_id")).distinct().join(where, ["doc_id", "inner_id"])
    return clusters.join(of_mention, ["doc_id", "cluster_id"]).select("doc_id", "arg_id", "sent_num").distinct()
