"""Best-mention rules: each entity of a document with the fullest form of it that the document holds.

Entities have (doc_id, ent_no, text, start_offset, name, entity_type). Every rule returns (doc_id, ent_no, best_name, best_offset,
candidate_count): the candidate that wins and one over the number of different candidate names. Candidates are found by equality on the
document and a shared word form. Only where a rule asks for a text somewhere inside another (places that hold the text of an
organisation, names of the raw text that hold that of a person) the distinct texts and names of a document meet on the document alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, location_casing, words
from ..session import materialise
from . import gazetteer

COLUMNS = ["doc_id", "ent_no", "best_name", "best_offset", "candidate_count"]


def entities(df: DataFrame) -> DataFrame:
    """Distinct entities with ``target`` (the text with single blanks) and ``name_words``; those without text or name are left out."""
    e = df.select("doc_id", "ent_no", "text", "start_offset", "name", "entity_type").filter("text is not null and name is not null and doc_id is not null").distinct()
    return e.withColumn("target", clean(F.col("text"))).withColumn("name_words", words(F.col("name")))


def _winner(hits: DataFrame, near: bool = True) -> DataFrame:
    """The nearest candidate (or the first in the document), ties by entity number, then name."""
    far = F.abs(F.col("best_offset") - F.col("start_offset")) if near else F.lit(0)
    best = F.min(F.struct(far.alias("d"), "c_no", "best_name", "best_offset"))
    one = hits.groupBy("doc_id", "ent_no").agg(best.alias("b"), F.count_distinct("best_name").alias("k"))
    return one.select("doc_id", "ent_no", "b.best_name", "b.best_offset", (1.0 / F.col("k")).alias("candidate_count"))


def _affixes(e: DataFrame) -> DataFrame:
    """(doc_id, key, c_no, best_name, best_offset, n_words): every shorter word prefix and suffix of a candidate's name."""
    n = F.size("name_words")
    lengths = F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1))
    heads = F.transform(lengths, lambda k: F.array_join(F.slice("name_words", F.lit(1), k), " "))
    tails = F.transform(lengths, lambda k: F.array_join(F.slice("name_words", n - k + 1, k), " "))
    return e.filter(n > 1).select("doc_id", F.explode(F.array_distinct(F.concat(heads, tails))).alias("key"), F.col("ent_no").alias("c_no"), F.col("name").alias("best_name"), F.col("start_offset").alias("best_offset"), n.alias("n_words"))


def _targets(e: DataFrame) -> DataFrame:
    return e.select("doc_id", "ent_no", "start_offset", F.col("target").alias("key"), F.size(words(F.col("target"))).alias("k_words"))


def person_affix(e: DataFrame) -> DataFrame:
    """'Peterson' or 'Scott' to the nearest person of under four words that begins or ends with it."""
    p = e.filter("entity_type = 'PERSON'")
    return _winner(_targets(p).join(_affixes(p).filter("n_words < 4"), ["doc_id", "key"]).filter("n_words > k_words"))


def organisation_affix(e: DataFrame) -> DataFrame:
    """The first organisation of the document that begins or ends with the text; not for texts found inside a name of a place there."""
    o = e.filter("entity_type = 'ORGANIZATION'")
    t = _targets(o)
    # a text inside the name of a place: the pairs meet on the document and are as many as its distinct texts and places
    place = e.filter("entity_type = 'LOCATION'").select("doc_id", "name").distinct()
    taken = t.select("doc_id", "key").distinct().join(place, "doc_id").filter(F.col("name").contains(F.col("key"))).select("doc_id", "key").distinct()
    t = t.join(taken, ["doc_id", "key"], "left_anti")
    return _winner(t.join(_affixes(o), ["doc_id", "key"]).filter("n_words > k_words"), near=False)


def organisation_prefix(e: DataFrame) -> DataFrame:
    """The nearest organisation of one longer word that begins with the text, in any case."""
    o = e.filter("entity_type = 'ORGANIZATION'")
    one = o.filter(F.size("name_words") == 1)
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name") - 1)), lambda k: F.lower(F.substring(F.col("name"), F.lit(1), k)))
    c = one.select("doc_id", F.explode(heads).alias("key"), F.col("ent_no").alias("c_no"), F.col("name").alias("best_name"), F.col("start_offset").alias("best_offset"))
    t = _targets(o).withColumn("k_len", F.length("key")).withColumn("key", F.lower("key"))
    return _winner(t.join(c, ["doc_id", "key"]).filter(F.length("best_name") > F.col("k_len")))


def _initials(o: DataFrame) -> DataFrame:
    """(doc_id, key, c_no, best_offset, best_name): the initials of the last k capitalised words of each name, for every k."""
    capital = F.filter("name_words", lambda w: w.rlike(r"^\p{Lu}"))
    starts = F.transform(capital, lambda w: F.substring(w, 1, 1))
    initials = F.array_join(starts, "")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(capital))), lambda k: F.struct(F.substring(initials, F.size(capital) - k + 1, k).alias("key"), F.element_at(capital, F.when(k <= F.size(capital), -k).otherwise(-1).cast("int")).alias("head")))
    c = o.filter(F.size(capital) > 0).select("doc_id", F.explode(tails).alias("t"), "name_words", F.col("ent_no").alias("c_no"), F.col("start_offset").alias("best_offset"))
    # every place where the first of these words stands begins a name
    at = F.filter(F.sequence(F.lit(1), F.size("name_words")), lambda i: F.element_at("name_words", i) == F.col("t.head"))
    c = c.select("doc_id", F.col("t.key").alias("key"), "c_no", "best_offset", "name_words", F.explode(at).alias("i"))
    c = c.select("doc_id", "key", "c_no", "best_offset", F.array_join(F.slice("name_words", F.col("i"), F.size("name_words")), " ").alias("best_name"))
    return c


def acronym_of(targets: DataFrame, o: DataFrame) -> DataFrame:
    """The nearest organisation that each ``target`` abbreviates."""
    return _winner(_targets(targets).join(_initials(o), ["doc_id", "key"]))


def organisation_acronym(e: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """An acronym (all upper case, or in brackets in the text of ``docs``) to the nearest organisation whose last capitalised words have
    its letters as initials; what stands before those words in the name is cut off."""
    o = e.filter("entity_type = 'ORGANIZATION'")
    c = _initials(o)
    t = _targets(o)
    upper = t.filter(F.col("key").rlike(r"^\p{Lu}+$"))
    if docs is not None:
        rest = t.filter(~F.col("key").rlike(r"^\p{Lu}+$"))
        inside = rest.select("doc_id", "key").distinct().join(c.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi").join(docs.select(F.col("ext_id").alias("doc_id"), F.col("text").alias("body")), "doc_id").filter(F.expr("body rlike concat('\\\\([^)(]{0,15}\\\\Q', key, '\\\\E[^)(]{0,15}\\\\)')"))
        upper = upper.unionByName(rest.join(inside.select("doc_id", "key"), ["doc_id", "key"], "left_semi"))
    return _winner(upper.join(c, ["doc_id", "key"]))


def location_in_name(e: DataFrame, g: DataFrame) -> DataFrame:
    """'Seattle' to 'Seattle, Washington' where a place is named 'Seattle , Washington' or 'Seattle in Washington'."""
    l = e.filter("entity_type = 'LOCATION'")
    n = F.size("name_words")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.struct(i.alias("at"), F.element_at("name_words", (i + 1).cast("int")).alias("sep")))
    c = l.filter(n > 2).select("doc_id", "name_words", F.col("ent_no").alias("c_no"), F.col("start_offset").alias("best_offset"), F.explode(cut).alias("c")).filter("c.sep in (',', 'in')").filter(F.col("c.at") + 1 < F.size("name_words"))
    heads = F.transform(F.sequence(F.lit(1), F.col("c.at")), lambda s: F.array_join(F.slice("name_words", s, F.col("c.at") - s + 1), " "))
    c = c.withColumn("head", F.explode(heads)).withColumn("tail", F.array_join(F.slice("name_words", F.col("c.at") + 2, F.size("name_words")), " "))
    c = c.select("doc_id", F.lower("head").alias("key"), "c_no", "best_offset", F.concat_ws(", ", "head", "tail").alias("best_name")).filter(F.size(words(F.col("best_name"))) < 7)
    parts = F.transform(F.split("best_name", ","), lambda p: F.trim(p))
    c = c.withColumn("p", parts).filter(F.size("p") == 2).withColumn("a", F.element_at("p", 1)).withColumn("b", F.element_at("p", 2)).drop("p")
    c = gazetteer.type_similarity(c, "b", "a", g).withColumn("container", F.lower("b")).withColumn("contained", F.lower("a"))
    c = c.join(gazetteer.containment(g).withColumn("holds", F.lit(True)), ["container", "contained"], "left").filter("holds or type_similarity = 0").drop("a", "b", "container", "contained", "type_similarity", "holds")
    hit = _winner(_targets(l).withColumn("key", F.lower("key")).join(c, ["doc_id", "key"]))
    return gazetteer.expand_locations(hit.withColumn("best_name", location_casing(F.col("best_name"))), "best_name", g).withColumn("best_name", F.col("expanded")).select(*COLUMNS)


def location_container(e: DataFrame, g: DataFrame) -> DataFrame:
    """A place with the nearest other place of the document that contains it, as 'place, container'."""
    l = e.filter("entity_type = 'LOCATION'")
    holds = gazetteer.containment(g)
    t = _targets(l).withColumn("contained", F.lower("key")).join(F.broadcast(holds) if holds.count() < 100_000 else holds, "contained")
    c = l.select("doc_id", F.lower("name").alias("container"), F.col("ent_no").alias("c_no"), F.col("name").alias("best_name"), F.col("start_offset").alias("best_offset"))
    hit = t.join(c, ["doc_id", "container"]).filter("best_name <> key and best_name <> 'United States'")
    return _winner(hit).withColumnRenamed("best_name", "container_name")


def _found(e: DataFrame, docs: DataFrame, scan, schema: str) -> DataFrame:
    bodies = docs.select(F.col("ext_id").alias("doc_id"), F.col("text").alias("body"))
    return bodies.join(e.select("doc_id").distinct(), "doc_id", "left_semi").mapInPandas(scan, schema)


# Fixed value: two capitalised words between lower-case words or dots.
PERSON_NAME = re.compile(r"(?:\.|\s[a-z]+\s)([A-Z]\w+\s[A-Z]\w+)(?:\.|\s[a-z]+\s)", re.ASCII)


def person_in_text(e: DataFrame, docs: DataFrame) -> DataFrame:
    """The nearest 'Capital Capital' of the raw text, between lower-case words or dots, that contains the text of a person."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(d, m.group(1), m.start(1)) for d, t in zip(f.doc_id, f.body) for m in PERSON_NAME.finditer(t or "")], columns=["doc_id", "best_name", "best_offset"])

    p = e.filter("entity_type = 'PERSON'")
    c = _found(p, docs, scan, "doc_id string, best_name string, best_offset int").withColumn("c_no", F.col("best_offset"))
    return _winner(_targets(p).join(c, "doc_id").filter(F.col("best_name").contains(F.col("key"))))


def container_counts(e: DataFrame, g: DataFrame) -> DataFrame:
    """(doc_id, ent_no, container, mentions): for each place the places of its document that contain it, and how often each is mentioned."""
    l = e.filter("entity_type = 'LOCATION'")
    t = _targets(l).withColumn("contained", F.lower("key")).join(gazetteer.containment(g), "contained")
    c = l.select("doc_id", F.lower("name").alias("container"), F.col("name").alias("best_name"))
    hit = t.join(c, ["doc_id", "container"]).filter("best_name <> key and best_name <> 'United States'")
    return hit.groupBy("doc_id", "ent_no", F.col("best_name").alias("container")).agg(F.count(F.lit(1)).alias("mentions"))


def location_in_text(e: DataFrame, docs: DataFrame, g: DataFrame) -> DataFrame:
    """'X, Container' of the raw text, abbreviations expanded, where the gazetteer bears it out; the nearest one, then the first.
    Texts are matched literally, wherever they stand, as they are, in lower or in upper case; hits of one text do not overlap."""
    pattern = re.compile(r"(?=(,\s?([A-Z]\S+)[\s.?!,]))", re.ASCII)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t, texts in zip(f.doc_id, f.body, f.texts):
                plains: dict[str, set[str]] = {}
                for p in texts:
                    for x in (p, p.lower(), p.upper()):
                        plains.setdefault(x, set()).add(p)
                lengths, over = sorted({len(x) for x in plains}, reverse=True), dict.fromkeys(texts, 0)
                for m in pattern.finditer(t or ""):
                    for s in (m.start() - n for n in lengths if n <= m.start()):
                        for p in plains.get(t[s : m.start()], ()):
                            if s >= over[p]:
                                over[p] = m.end(1)
                                rows.append((d, p, t[s : m.start()], s, m.group(2)))
            yield pd.DataFrame(rows, columns=["doc_id", "plain", "seen", "best_offset", "cont"])

    t = _targets(e.filter("entity_type = 'LOCATION'")).withColumn("plain", F.regexp_replace("key", "[()]", ""))
    texts = t.filter("plain <> ''").groupBy("doc_id").agg(F.collect_set("plain").alias("texts"))  # the places of one document
    c = docs.select(F.col("ext_id").alias("doc_id"), F.col("text").alias("body")).join(texts, "doc_id").mapInPandas(scan, "doc_id string, plain string, seen string, best_offset int, cont string")
    hit = t.join(c, ["doc_id", "plain"])
    hit = gazetteer.expand_locations(hit.withColumn("pair", location_casing(F.concat_ws(", ", "seen", "cont"))), "pair", g)
    parts = F.split("expanded", ",")
    hit = hit.withColumn("contained", F.lower(F.trim(F.element_at(parts, 1)))).withColumn("name", F.trim(F.try_element_at(parts, F.lit(2)))).withColumn("container", F.lower("name"))
    hit = hit.join(gazetteer.containment(g), ["container", "contained"]).filter("container <> contained")
    far = F.abs(F.col("best_offset") - F.col("start_offset"))
    one = hit.groupBy("doc_id", "ent_no").agg(F.min(F.struct(far.alias("d"), "best_offset", "seen", "name")).alias("b"), F.count_distinct("name").alias("k"))
    return one.select("doc_id", "ent_no", F.col("b.seen").alias("contained"), F.col("b.name").alias("container_name"), F.col("b.best_offset").alias("best_offset"), (1.0 / F.col("k")).alias("candidate_count"))


def resolve(df: DataFrame, docs: DataFrame, g: DataFrame) -> DataFrame:
    """One resolved mention for each entity: ``kind`` (Full, Container, Containment or Identity), ``best_mention`` and ``candidate_count``.

    Organisations try acronym, affix and prefix, places the form within a name, the container and the raw text, people affix and raw text;
    others try organisations, places and people in turn. What no rule finds stands for itself.
    """
    e, g = materialise(entities(df)), materialise(g)  # read by every rule
    other = e.filter("entity_type = 'OTHER'")
    rank = 0
    found: list[DataFrame] = []

    def add(hits: DataFrame, kind: str, name: Column) -> None:
        nonlocal rank
        rank += 1
        found.append(hits.select("doc_id", "ent_no", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), name.alias("best_mention"), "best_offset", "candidate_count"))

    as_type = lambda t: e.unionByName(other.withColumn("entity_type", F.lit(t)))
    o, l, p = as_type("ORGANIZATION"), as_type("LOCATION"), as_type("PERSON")
    keep = e.select("doc_id", "ent_no", "target", "entity_type")
    add(organisation_acronym(o, docs), "Full", F.col("best_name"))
    add(organisation_affix(o), "Full", F.col("best_name"))
    add(organisation_prefix(o), "Full", F.col("best_name"))
    add(location_in_name(l, g), "Full", F.col("best_name"))
    box = location_container(l, g).join(keep, ["doc_id", "ent_no"])
    add(box, "Container", location_casing(F.concat_ws(", ", "target", "container_name")))
    add(location_in_text(l, docs, g), "Containment", F.concat_ws(", ", "contained", "container_name"))
    add(person_affix(p), "Full", F.col("best_name"))
    add(person_in_text(p.filter("entity_type = 'PERSON'"), docs), "Full", F.col("best_name"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    first = every.groupBy("doc_id", "ent_no").agg(F.min_by(F.struct("kind", "best_mention", "best_offset", "candidate_count"), "rank").alias("w"))
    out = e.join(first, ["doc_id", "ent_no"], "left")
    return out.select(
        "doc_id", "ent_no", "start_offset", "text", "entity_type", F.coalesce("w.kind", F.lit("Identity")).alias("kind"), F.coalesce("w.best_mention", "target").alias("best_mention"),
        F.coalesce("w.best_offset", "start_offset").alias("best_offset"), F.coalesce("w.candidate_count", F.lit(1.0)).alias("candidate_count"),
    )


def non_trivial(resolved: DataFrame) -> DataFrame:
    """Mentions that say more than their own text."""
    return resolved.filter("kind <> 'Identity' and best_mention <> text")


def entity_runs(tokens: DataFrame) -> DataFrame:
    """Runs of adjacent tokens of one tag to entities. Tokens have (doc_id, sent_num, tok_no, text, begin, end, ner); a run never leaves
    its sentence. Gives ``name`` (words joined by blanks), ``start_offset``, ``end`` and ``entity_type``."""
    t = tokens.filter("ner in ('PERSON', 'ORGANIZATION', 'LOCATION')")
    island = F.col("tok_no") - F.row_number().over(Window.partitionBy("doc_id", "sent_num", "ner").orderBy("tok_no"))
    runs = t.withColumn("island", island).groupBy("doc_id", "sent_num", "ner", "island").agg(F.array_sort(F.collect_list(F.struct("tok_no", "text"))).alias("w"), F.min("begin").alias("start_offset"), F.max("end").alias("end"))
    return runs.select("doc_id", "sent_num", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("name"), "start_offset", "end", F.col("ner").alias("entity_type"))
