"""The three systems over one set of tables: links of the arguments as they stand, after the best-mention rules, and after coreference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coref, linking, resolve
from ..operators.spans import greedy, within
from ..session import materialise


@dataclass
class Tables:
    """What the annotators deliver. ``args`` (doc_id, arg_id, text, start_offset and, if tagged, tokens); ``entities``; ``mentions`` (doc_id,
    cluster_id, start_offset, text); ``documents`` (ext_id, text); ``places`` of the gazetteer; ``kb`` (id, name, typ, prior); ``sentences``
    (doc_id, sent_num, start, end, text), for the contexts."""

    args: DataFrame
    entities: DataFrame
    mentions: DataFrame
    documents: DataFrame
    places: DataFrame
    kb: DataFrame
    sentences: DataFrame | None = None


COLUMNS = ["doc_id", "arg_id", "start_offset", "text", "id", "name", "score"]


def _cleaned(t: Tables) -> DataFrame:
    """(doc_id, arg_id, text, start_offset, said, said_offset): arguments with what is left of them without a determiner or preposition at
    either end, if they are tagged. Offsets of links are those of the whole argument."""
    if "tokens" not in t.args.columns:
        return t.args.select("doc_id", "arg_id", "text", "start_offset", F.col("text").alias("said"), F.col("start_offset").alias("said_offset"))
    c = linking.cleaned_arguments(t.args)
    return c.select("doc_id", "arg_id", "text", "start_offset", F.col("clean").alias("said"), F.coalesce("clean_offset", "start_offset").alias("said_offset"))


def contexts(t: Tables) -> DataFrame:
    """The context of each argument: its sentence and those its clusters lead to (none without sentences)."""
    from ..operators.spans import sentence_of

    span = t.args.select("doc_id", F.col("arg_id").alias("inner_id"), F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end"))
    at = sentence_of(span, t.sentences).withColumnRenamed("inner_id", "arg_id")
    a = t.args.select("doc_id", "arg_id", "text", "start_offset").join(at, ["doc_id", "arg_id"], "left")
    return linking.argument_contexts(a, t.mentions, t.sentences)


def _answers(t: Tables, said: DataFrame) -> DataFrame:
    """The links of arguments (doc_id, arg_id, text, start_offset, said) by what is said; columns of ``COLUMNS`` and typ."""
    found = linking.look_up(said.select("doc_id", "arg_id", "start_offset", F.col("said").alias("text")), t.kb)
    return found.drop("text", "start_offset").join(said.select("doc_id", "arg_id", "text", "start_offset"), ["doc_id", "arg_id"])


def baseline(t: Tables) -> DataFrame:
    """Arguments are cleaned and linked as they stand."""
    return _answers(t, _cleaned(t)).select(*COLUMNS)


def _resolved_args(t: Tables, best: DataFrame) -> DataFrame:
    """Cleaned arguments in which each best mention takes the place of its text, in ``said``."""
    args = _cleaned(t)
    spans = args.select("doc_id", F.col("arg_id").alias("outer_id"), F.col("said_offset").alias("start"), (F.col("said_offset") + F.length("said")).alias("end"))
    b = best.filter("best_mention <> text").withColumn("inner_id", F.xxhash64("doc_id", "start_offset", "text", "best_mention"))
    inside = within(spans, b.select("doc_id", "inner_id", F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end")))
    subs = inside.join(b.select("doc_id", "inner_id", F.col("start_offset").alias("s"), F.length("text").alias("n"), "best_mention"), ["doc_id", "inner_id"])
    picked = greedy(subs.select("doc_id", "outer_id", F.col("s").alias("start"), (F.col("s") + F.col("n")).alias("end"), "inner_id"), ["doc_id", "outer_id"])
    named = picked.join(b.select("doc_id", "inner_id", "best_mention"), ["doc_id", "inner_id"]).groupBy("doc_id", F.col("outer_id").alias("arg_id")).agg(F.collect_set(F.struct("start", "end", F.col("best_mention").alias("best"))).alias("subs"))  # of one argument
    a = args.join(named, ["doc_id", "arg_id"], "left")
    local = F.transform("subs", lambda s: F.struct((s["start"] - F.col("said_offset")).alias("start"), (s["end"] - F.col("said_offset")).alias("end"), s["best"].alias("best")))
    return a.withColumn("said", F.when(F.col("subs").isNotNull(), linking.substitute(F.col("said"), local)).otherwise(F.col("said"))).select("doc_id", "arg_id", "text", "start_offset", "said")


def _linked(t: Tables, best: DataFrame) -> DataFrame:
    # the rules are a wide plan and feed three branches: computed once
    return _answers(t, _resolved_args(t, materialise(best))).select(*COLUMNS)


def rules(t: Tables) -> DataFrame:
    """Arguments are linked by their best mentions; clusters are not used."""
    return _linked(t, resolve.resolve(t.entities, t.documents, t.places).select("doc_id", "start_offset", "text", "best_mention"))


def coreference(t: Tables) -> DataFrame:
    """Links first; they join the tagged entities as candidates; best mentions are then carried to the pronouns of their clusters."""
    first = materialise(_answers(t, _cleaned(t)))
    kind = F.when(F.col("typ").isin("CITY", "PROVINCE", "COUNTRY"), "LOCATION").when(F.col("typ").isin("PERSON", "ORGANIZATION"), F.col("typ")).otherwise("OTHER")
    # links are entities too; their numbers come after all of the tagged ones, which so win ties
    known = first.select("doc_id", (F.col("arg_id").cast("long") + (1 << 40)).alias("ent_no"), "text", "start_offset", "name", kind.alias("entity_type"))
    best = materialise(resolve.resolve(t.entities.select("doc_id", F.col("ent_no").cast("long").alias("ent_no"), "text", "start_offset", "name", "entity_type").unionByName(known), t.documents, t.places))
    links = first.select("doc_id", "start_offset", "id", "name", F.array(F.lower(kind)).alias("types"))
    more = coref.expand(t.mentions, links, best.select("doc_id", "start_offset", "best_mention", "kind", "entity_type", "candidate_count"))
    both = best.select("doc_id", "start_offset", "text", "best_mention").unionByName(more.select("doc_id", "start_offset", "text", "best_mention"))
    return _linked(t, both.distinct())


def compare(t: Tables) -> DataFrame:
    """The links of the three systems, one under another."""
    return coref.tagged_union({"BASELINE": baseline(t), "RULES": rules(t), "COREF": coreference(t)})
