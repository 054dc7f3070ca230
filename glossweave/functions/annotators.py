"""Boundary to language models: the tables they must deliver, and deterministic stand-ins for tests and examples.

A tagger, parser, coreference resolver or linker plugs in as a function from a batch of texts to rows; its model is loaded once in a
worker. The stand-ins are rules and make no claim to be like any model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .fixed import PRONOUNS

SCHEMAS = {
    "tokens": "doc_id string, sent_num int, tok_no int, text string, begin int, end int, ner string, pos string, lemma string",
    "parsed": "doc_id string, sent_num int, start_offset int, chunks array<string>, dgraph string",
    "mentions": "doc_id string, cluster_id int, ord int, text string, start_offset int, is_pronoun boolean, is_best boolean",
    "extractions": "doc_id string, sent_num int, ext_no int, arg1 struct<text:string,start_offset:int>, rel struct<text:string,start_offset:int>, arg2 struct<text:string,start_offset:int>, confidence double",
    "tags": "doc_id string, sent_num int, text string, start_offset int, type string",
    "links": "doc_id string, text string, start_offset int, name string, score double, doc_sim_score double, candidate_score double, inlinks double, id string, types array<string>",
}


def annotate(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], table: str) -> tuple[DataFrame, DataFrame]:
    """The rows a model gives for ``df``, in one of the schemas above, and the rejects: (input, error), the input row as JSON.

    ``load`` makes the model, once for each task. Whole batches go to it; only where one fails its rows are tried one by one, and those
    that fail alone are rejects, so one bad text cannot end a run and none vanishes unseen.
    """
    names = [f.split()[0] for f in SCHEMAS[table].split(", ") if ":" not in f.split()[0]]
    fields = df.sparkSession.createDataFrame([], SCHEMAS[table]).columns
    assert set(names) <= set(fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            try:
                yield model(f)
                continue
            except Exception:  # noqa: BLE001 - tried row by row below
                pass
            for at in range(len(f)):
                one = f.iloc[at : at + 1]
                try:
                    yield model(one)
                except Exception as e:  # noqa: BLE001 - fail-soft by contract, told in the rejects
                    yield pd.DataFrame({"_input": [one.iloc[0].to_json(default_handler=str)], "_error": [f"{type(e).__name__}: {e}"]})

    def padded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in run(frames):
            yield f.reindex(columns=[*fields, "_input", "_error"]).astype(object).where(lambda x: x.notna(), None)

    both = materialise(df.mapInPandas(padded, SCHEMAS[table] + ", _input string, _error string"))
    return both.filter("_error is null").drop("_input", "_error"), both.filter("_error is not null").select(F.col("_input").alias("input"), F.col("_error").alias("error"))


def parse_documents(docs: DataFrame, steps: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """All annotators over the same documents: by table, its rows and rejects. A step that fails on a document leaves the others alone."""
    return {table: annotate(docs, load, table) for table, load in steps.items()}


# Closed classes of words for the stand-in tagger.
DETERMINERS = ["the", "a", "an", "this", "that", "these", "those", "some", "any", "each", "every", "no", "both"]
PREPOSITIONS = ["of", "in", "on", "at", "by", "for", "from", "with", "into", "over", "under", "near", "after", "before", "outside", "since", "against", "about", "through"]


def word_tokens(text: Column, offset: Column) -> Column:
    """Blank-separated words of ``text`` as an array of struct (text, start_offset, pos), offsets from ``offset`` on; determiners are DT,
    prepositions IN, 'to' TO, all others NN."""
    parts = F.split(text, " ", -1)
    pos = lambda w: F.when(F.lower(w).isin(DETERMINERS), "DT").when(F.lower(w).isin(PREPOSITIONS), "IN").when(F.lower(w) == "to", "TO").otherwise("NN")
    zero = F.struct(F.array().cast("array<struct<text:string,start_offset:int,pos:string>>").alias("a"), offset.cast("int").alias("at"))
    step = lambda acc, w: F.struct(F.when(w == "", acc["a"]).otherwise(F.concat(acc["a"], F.array(F.struct(w.alias("text"), acc["at"].alias("start_offset"), pos(w).alias("pos"))))).alias("a"), (acc["at"] + F.length(w) + 1).alias("at"))
    return F.aggregate(parts, zero, step)["a"]


def name_clusters(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """The stand-in coreference resolver: (doc_id, cluster_id, start_offset, text). Mentions of one name in a document are a cluster; a pronoun of
    a sentence belongs to the cluster of the entity that begins last before it."""
    e = entities.filter("name is not null and text is not null and start_offset is not null").select("doc_id", "name", "start_offset", "text").distinct()
    m = e.withColumn("cluster_id", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("name")) - 1).cast("int"))
    words = F.filter(word_tokens(F.col("text"), F.col("start_offset")), lambda w: F.lower(w["text"]).isin(PRONOUNS))
    p = sentences.select("doc_id", F.explode(words).alias("w")).select("doc_id", "w.start_offset", "w.text").distinct()
    first = m.groupBy("doc_id", "start_offset").agg(F.min("cluster_id").alias("cluster_id"))
    both = first.select("doc_id", "start_offset", "cluster_id", F.lit(None).cast("string").alias("text"), F.lit(1).alias("k")).union(p.select("doc_id", "start_offset", F.lit(None).cast("int"), "text", F.lit(0)))
    last = F.last("cluster_id", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("start_offset", "k").rowsBetween(Window.unboundedPreceding, -1))
    said = both.withColumn("own", last).filter("k = 0 and own is not null").select("doc_id", F.col("own").alias("cluster_id"), "start_offset", "text")
    return m.select("doc_id", "cluster_id", "start_offset", "text").distinct().unionByName(said)


def lemma(word: Column) -> Column:
    """The stand-in stemmer: lower case, without a plural s."""
    return F.regexp_replace(F.lower(word), r"(?<=[^su])s$", "")


def capitalised_tokens(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Blank-separated tokens of each line. Capitalised words are tagged by their last letter (a vowel ORGANIZATION, n or d LOCATION, all
    others PERSON), other words O. ``begin`` counts from the line's start."""
    lines = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("sent_num", "line"))
    toks = lines.select("doc_id", "sent_num", F.posexplode(F.split("line", " ", -1)).alias("tok_no", "text"))
    before = Window.partitionBy("doc_id", "sent_num").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, -1)
    toks = toks.withColumn("begin", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")).withColumn("end", (F.col("begin") + F.length("text")).cast("int"))
    return toks.withColumn("ner", F.when(~F.col("text").rlike("^[A-Z][a-z]+$"), "O").when(F.col("text").rlike("[aeiou]$"), "ORGANIZATION").when(F.col("text").rlike("[nd]$"), "LOCATION").otherwise("PERSON"))


def extraction_rows(srl: DataFrame) -> DataFrame:
    """N-ary extractions (arg1, rel, arg2s, confidence) as triples, a row for each second argument; those without any give none."""
    rest = [c for c in srl.columns if c != "arg2s"]
    return srl.select(*rest, F.posexplode("arg2s").alias("arg2_no", "arg2"))


def noun_relations(instances: DataFrame) -> DataFrame:
    """Instances of noun relations (arg1, rel, arg2 as arrays of struct text, start_offset) as triples: an argument's text and the offset of its
    first token, and of the relation too."""
    rest = [c for c in instances.columns if c not in ("arg1", "rel", "arg2")]
    return instances.select(*rest, *[part(F.col(c)).alias(c) for c in ("arg1", "rel", "arg2")])


def part(tokens: Column, least: bool = False) -> Column:
    """A part of an extraction from its tokens: the text and the offset of the first token, or with ``least`` the least of all."""
    at = F.array_min(F.transform(tokens, lambda t: t["start_offset"])) if least else F.try_element_at(tokens, F.lit(1))["start_offset"]
    return F.struct(F.array_join(F.transform(tokens, lambda t: t["text"]), " ").alias("text"), at.alias("start_offset"))


def extractions(nouns: DataFrame, verbs: DataFrame) -> DataFrame:
    """Triples of noun relations, then those of n-ary extractions a row for each second argument, numbered in this order (``ext_no``) within
    their sentence. Both have (doc_id, sent_num, no, arg1, rel, arg2 or arg2s, confidence)."""
    both = nouns.select("doc_id", "sent_num", F.lit(0).alias("source"), "no", F.lit(0).alias("arg2_no"), "arg1", "rel", "arg2", "confidence")
    both = both.unionByName(extraction_rows(verbs).select("doc_id", "sent_num", F.lit(1).alias("source"), "no", "arg2_no", "arg1", "rel", "arg2", "confidence"))
    number = F.row_number().over(Window.partitionBy("doc_id", "sent_num").orderBy("source", "no", "arg2_no")) - 1
    return both.select("doc_id", "sent_num", number.alias("ext_no"), "source", "arg1", "rel", "arg2", "confidence")


def chunked(parsed: DataFrame, start: int = 0, length: int | None = None) -> DataFrame:
    """Tokens and chunk tags side by side, of the whole sentence or of ``length`` tokens from ``start`` on; unequal numbers are an error."""
    fits = F.size("tokens") == F.size("chunks")
    pairs = F.arrays_zip("tokens", "chunks")
    some = pairs if start == 0 and length is None else F.slice(pairs, F.lit(start + 1), F.lit(length) if length is not None else F.size(pairs))
    return parsed.withColumn("pairs", F.when(fits, some).otherwise(F.raise_error(F.lit("tokens and chunks differ in number"))))
