"""Comparisons and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, link_debug, mention_debug, tsv_clean
from .spans import context, sentence_of


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two runs, joined on ``keys``, whose ``old`` and ``new`` differ; null counts as a value."""
    return old.join(new, keys).filter(~F.col("old").eqNullSafe(F.col("new")))


def feature_table(bem: DataFrame, features: DataFrame, contexts: DataFrame, positions: DataFrame, names: list[str]) -> DataFrame:
    """The features of the best mentions at their position among those of the document, beside label (empty), texts and contexts; one column
    for each field of the feature TSV, numbers with two decimals."""
    keys = ["doc_id", "bem_index"]
    j = positions.join(bem.select(*keys, F.regexp_replace("target.text", r"\s+", " ").alias("target text"), F.col("best_mention").alias("best text")), keys)
    j = j.join(contexts.select(*keys, F.col("target_context").alias("target context"), F.col("best_context").alias("best context")), keys).join(features, keys)
    text = ["target text", "best text", "target context", "best context"]
    return j.select(
        F.lit("").alias("label"), *[tsv_clean(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in text], *[fixed(F.col(f"`{n}`")).alias(n) for n in names],
        F.col("position").cast("string").alias("doc bem index"), F.col("doc_id").alias("doc id"),
    )


def tsv(df: DataFrame, columns: list[str], formats: dict[str, str] | None = None) -> DataFrame:
    """``line``: the columns cleaned of tabs and line breaks and joined by tabs, doubles by a format such as '%.2f'."""
    formats = formats or {}
    cell = lambda c: F.format_string(formats[c], F.col(c).cast("double")) if c in formats else tsv_clean(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df.select(F.concat_ws("\t", *[cell(c) for c in columns]).alias("line"))


def link_with_context(links: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each link with the one argument context of its document, start and text; more or fewer than one is an error."""
    keys = ["doc_id", "start_offset", "text"]
    n = contexts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("context").alias("context"))
    j = links.join(n, keys, "left")
    return j.withColumn("context", F.when(F.col("n") == 1, F.col("context")).otherwise(F.raise_error(F.lit("a link without exactly one context")))).drop("n")


# The columns of the reports.
EVALUATION_COLUMNS = ["Best Arg1", "Rel", "Best Arg2", "Original Arg1", "Original Arg2", "Sentence Text", "Arg1 Best Mentions", "Arg2 Best Mentions", "Arg1 Links", "Arg2 Links", "Original Arg1 Links", "Original Arg2 Links", "Doc ID", "Arg1 Changed?", "Arg2 Changed?"]
LINK_COLUMNS = ["SOURCE", "OFFSET", "ORIGINAL TEXT", "CLEANED TEXT", "WIKI TITLE", "FB ID", "TYPES", "COMBINED SCORE", "DOC SIM SCORE", "INLINKS", "CROSSWIKIS SCORE", "CONTEXT CLUSTER MENTIONS", "CONTEXT SIZE", "CONTEXT", "DOC ID"]


def header(columns: list[str]) -> str:
    return "\t".join(columns)


def _listed(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def shown_parts(parts: DataFrame, links: DataFrame, bem: DataFrame | None = None) -> DataFrame:
    """(doc_id, part_id, shown, links, mentions) of parts (doc_id, part_id, text, start_offset): the text in which links and then best mentions
    (those that say more than their text) take the place of what they stand at, first come first served, and what was found there."""
    from .linking import substitute
    from .spans import greedy, within

    span = lambda df, at, text: (F.col(at).alias("start"), (F.col(at) + F.length(text)).alias("end"))
    p = parts.select("doc_id", F.col("part_id").alias("outer_id"), *span(parts, "start_offset", "text"))
    subs = links.select("doc_id", F.lit(0).alias("source"), "start_offset", "text", F.col("name").alias("best"), link_debug(F.col("name"), F.col("id"), F.col("score")).alias("debug"))
    if bem is not None:
        target = F.regexp_replace("target.text", r"\s+", " ")
        b = bem.filter((F.col("kind") != "Identity") & (F.col("best_mention") != target))
        b = b.select("doc_id", F.lit(1).alias("source"), F.col("target.start_offset").alias("start_offset"), target.alias("text"), F.col("best_mention").alias("best"))
        subs = subs.unionByName(b.withColumn("debug", mention_debug(F.col("start_offset"), F.col("text"), F.col("best"))))
    subs = subs.filter("best is not null").distinct().withColumn("inner_id", F.xxhash64("doc_id", "source", "start_offset", "text", "best", "debug"))
    inside = within(p, subs.select("doc_id", "inner_id", *span(subs, "start_offset", "text")))
    hit = inside.join(subs.withColumnRenamed("text", "old"), ["doc_id", "inner_id"]).withColumn("start", F.col("start_offset")).withColumn("end", F.col("start_offset") + F.length("old")).drop("start_offset")
    hit = hit.withColumn("order", F.struct("source", "start", "end", "best", "debug"))
    kept = greedy(hit, ["doc_id", "outer_id"], ["order"]).select("doc_id", "outer_id", "inner_id", F.lit(True).alias("kept"))
    hit = hit.join(kept, ["doc_id", "outer_id", "inner_id"], "left")
    row = F.struct("source", "start", "end", "best", "debug", F.coalesce("kept", F.lit(False)).alias("kept"))
    per = hit.groupBy("doc_id", F.col("outer_id").alias("part_id")).agg(F.array_sort(F.collect_list(row)).alias("h"))  # of one part
    none = F.array().cast("array<struct<source:int,start:int,end:int,best:string,debug:string,kept:boolean>>")
    j = parts.join(per, ["doc_id", "part_id"], "left").withColumn("h", F.coalesce("h", none))
    local = F.transform(F.filter("h", lambda x: x["kept"]), lambda x: F.struct((x["start"] - F.col("start_offset")).alias("start"), (x["end"] - F.col("start_offset")).alias("end"), x["best"].alias("best")))
    of = lambda k: _listed(F.transform(F.filter("h", lambda x: x["source"] == k), lambda x: x["debug"]))
    return j.select("doc_id", "part_id", substitute(F.col("text"), local).alias("shown"), of(0).alias("links"), of(1).alias("mentions"))


def evaluation(base: DataFrame, comp: DataFrame, base_links: DataFrame, comp_links: DataFrame, comp_bem: DataFrame | None, base_bem: DataFrame | None = None) -> DataFrame:
    """The extractions in which two systems show different arguments, with the fifteen columns of ``EVALUATION_COLUMNS``.

    ``base`` and ``comp`` are the extractions of both, (doc_id, sent_num, ext_no, sentence, arg1, rel, arg2), parts being structs of text and
    start_offset in the document. They are paired by place; sentences of unequal text are an error.
    """
    keys = ["doc_id", "sent_num", "ext_no"]

    def shown(df: DataFrame, links: DataFrame, bem: DataFrame | None, tag: str) -> DataFrame:
        parts = df.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("arg1").alias("p")), F.struct(F.lit(2).alias("n"), F.col("arg2").alias("p")))).alias("x"))
        parts = parts.select("doc_id", F.struct("sent_num", "ext_no", "x.n").alias("part_id"), "x.p.text", "x.p.start_offset")
        s = shown_parts(parts, links, bem).select("doc_id", F.col("part_id.sent_num").alias("sent_num"), F.col("part_id.ext_no").alias("ext_no"), F.col("part_id.n").alias("n"), "shown", "links", "mentions")
        of = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{tag}_{c}{n}")
        return s.groupBy(*keys).agg(*[of(n, c) for n in (1, 2) for c in ("shown", "links", "mentions")])

    x = comp.select(*keys, "sentence", F.col("rel.text").alias("rel")).join(base.select(*keys, F.col("sentence").alias("other")), keys)
    same = F.when(F.col("sentence").eqNullSafe(F.col("other")), F.col("sentence")).otherwise(F.raise_error(F.lit("the sentences of two systems differ")))
    x = x.withColumn("sentence", same).join(shown(base, base_links, base_bem, "b"), keys).join(shown(comp, comp_links, comp_bem, "c"), keys)
    change = lambda n: F.when(F.col(f"c_shown{n}") != F.col(f"b_shown{n}"), "YES").otherwise("NO")
    x = x.filter("c_shown1 <> b_shown1 or c_shown2 <> b_shown2")
    values = ["c_shown1", "rel", "c_shown2", "b_shown1", "b_shown2", "sentence", "c_mentions1", "c_mentions2", "c_links1", "c_links2", "b_links1", "b_links2"]
    columns = [*map(F.col, values), F.trim("doc_id"), change(1), change(2)]
    return x.select(*keys, *[tsv_clean(c).alias(n) for c, n in zip(columns, EVALUATION_COLUMNS)])


def types_shown(types: Column, most: int = 2) -> Column:
    t = F.coalesce(types, F.array().cast("array<string>"))
    return F.concat(F.array_join(F.slice(t, 1, most), ", "), F.when(F.size(t) > most, ", ...").otherwise(""))


def link_report(systems: dict[str, DataFrame], contexts: DataFrame) -> DataFrame:
    """The links of several systems with the fifteen columns of ``LINK_COLUMNS``. ``contexts`` (doc_id, start_offset, text, clean, full_text, size,
    cluster_mentions) holds exactly one for each link, else it is an error."""
    from .coref import tagged_union

    keys = ["doc_id", "start_offset", "text"]
    n = contexts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("clean", "full_text", "size", "cluster_mentions")).alias("c"))
    j = tagged_union(systems).join(n, keys, "left")
    c = F.when(F.col("n") == 1, F.col("c")).otherwise(F.raise_error(F.lit("a link without exactly one context")))
    j = j.withColumn("c", c)
    values = [
        F.col("system"), F.col("start_offset").cast("string"), F.col("text"), F.col("c.clean"), F.col("name"), F.col("id"), types_shown(F.col("types")), fixed(F.col("score")), fixed(F.col("doc_sim_score")), fixed(F.col("inlinks")),
        fixed(F.col("candidate_score")), F.when(F.col("c.cluster_mentions") == "", "[]").otherwise(F.col("c.cluster_mentions")), F.col("c.size").cast("string"), _listed(F.col("c.full_text")), F.col("doc_id"),
    ]
    return j.select(*[tsv_clean(v).alias(x) for v, x in zip(values, LINK_COLUMNS)])


def document_report(docs: DataFrame, sentences: DataFrame, extractions: DataFrame, links: DataFrame, mentions: DataFrame, bem: DataFrame, chars: int = 300) -> DataFrame:
    """(doc_id, report): for each document its id and counts, the head of its text, its sentences with their triples, its links, its clusters,
    the largest first, and the best mentions that say more than their text. Mentions have (doc_id, cluster_id, start_offset, text, is_best)."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def joined(df: DataFrame, order: list[str], row: Column, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, row.alias("row"))))  # of one document
        return df.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["row"]), "\n").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    triple = line("\t(", F.col("arg1.start_offset"), ": ", F.col("arg1.text"), ")\t(", F.col("rel.start_offset"), ": ", F.col("rel.text"), ")\t(", F.col("arg2.start_offset"), ": ", F.col("arg2.text"), ")\tconf:", fixed(F.col("confidence"), 3))
    of_sentence = extractions.groupBy("doc_id", "sent_num").agg(F.array_sort(F.collect_list(F.struct("ext_no", triple.alias("row")))).alias("t"), F.count(F.lit(1)).alias("n"))  # of one sentence
    s = sentences.join(of_sentence, ["doc_id", "sent_num"], "left")
    s = s.withColumn("row", F.concat_ws("\n", line("(", F.col("start_offset"), ") ", F.col("text")), F.array_join(F.transform("t", lambda x: x["row"]), "\n")))
    said = joined(s, ["sent_num"], F.col("row"), "said")
    total = extractions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_triples"))
    link = line("(", F.col("start_offset"), ")\t", F.col("name"), "\t", F.col("id"), "\t", F.array_join(F.slice(F.coalesce("types", F.array().cast("array<string>")), 1, 2), ", "), ", ...\t", fixed(F.col("score")), "=f(", fixed(F.col("doc_sim_score")), ", ", fixed(F.col("inlinks")), ", ", fixed(F.col("candidate_score")), ")")
    linked = joined(links, ["start_offset", "id"], link, "linked")
    m = mentions.withColumn("row", line("(", F.col("start_offset"), ") ", F.col("text")))
    rest = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_best"), F.struct("start_offset", "row")))), lambda x: x["row"])  # of one cluster
    c = m.groupBy("doc_id", "cluster_id").agg(F.min(F.when(F.col("is_best"), F.col("row"))).alias("best"), rest.alias("rest"), F.count(F.lit(1)).alias("size"))
    clusters = joined(c.withColumn("neg", -F.col("size")), ["neg", "cluster_id"], F.concat(F.coalesce("best", F.lit("")), F.lit("\t"), F.array_join("rest", ", ")), "clusters")
    target = F.regexp_replace("target.text", r"\s+", " ")
    b = bem.filter((F.col("kind") != "Identity") & (F.col("best_mention") != target)).withColumn("row", line(F.col("target.start_offset"), "\t", target, "\t", F.col("best_mention")))
    best = joined(b, ["bem_index"], F.col("row"), "best")
    j = docs.select("doc_id", "text")
    for t in (said, total, linked, clusters, best):
        j = j.join(t, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    block = lambda title, c: (F.lit(title), F.coalesce(c, F.lit("")))
    report = F.concat_ws(
        "\n", "doc_id", F.concat(F.lit("Number of sentences: "), n("n_said")), F.concat(F.lit("Number of extractions: "), n("n_triples")), F.concat(F.lit("Number of FreeBase links: "), n("n_linked")), F.lit(""), F.lit("Text sample:"),
        F.concat(F.coalesce(F.substring("text", 1, chars), F.lit("")), F.lit("...")), F.lit(""), *block("Extracted Sentences:", "said"), F.lit(""), *block("Links:", "linked"), F.lit(""), *block("Coref Clusters:", "clusters"), *block("Best Entity Mentions:", "best"),
    )
    return j.select("doc_id", report.alias("report"))


def serialisable(docs: DataFrame, sentences: DataFrame, mentions: DataFrame, links: DataFrame, contexts: DataFrame, bem: DataFrame) -> DataFrame:
    """One nested row for each document: text, sentences, clusters, links, argument contexts and the best mentions that say more than their text."""

    def nested(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))  # of one document

    target = F.regexp_replace("target.text", r"\s+", " ")
    b = bem.filter((F.col("kind") != "Identity") & (F.col("best_mention") != target))
    out = docs.select("doc_id", "text")
    parts = [
        nested(sentences, ["sent_num", "start_offset", "text"], "sentences"), nested(mentions, ["cluster_id", "start_offset", "text"], "mentions"), nested(links, ["start_offset", "text", "id", "name", "score"], "links"),
        nested(contexts, ["start_offset", "text", "arg_id", "full_text", "size"], "contexts"), nested(b, ["bem_index", "kind", "best_mention", "candidate_count"], "best_mentions"),
    ]
    for p in parts:
        out = out.join(p, "doc_id", "left")
    return out


def precision_lines(curve: DataFrame) -> DataFrame:
    """(rank, line): the smoothed precision with three decimals."""
    return curve.select("rank", fixed(F.col("smoothed"), 3).alias("line"))


def display_order(curve: DataFrame, label: str) -> DataFrame:
    """Adds ``place``, from 1: right answers first, in order of rank, then the others in theirs. Counted from the running number of right
    answers, so nothing is sorted again."""
    right = F.round(F.col("precision") * F.col("rank")).cast("long")
    every = curve.agg(F.sum(F.col(label).cast("long"))).first()[0] or 0
    return curve.withColumn("place", F.when(F.col(label) == 1, right).otherwise(F.lit(every) + F.col("rank") - right))


def counters(df: DataFrame, **counts: Column) -> DataFrame:
    """One row: how many rows there are and how many of them fit each condition, in one pass. For progress and errors of a finished step; an
    ``Observation`` on the running one would do the same, but a session that has held one can no longer ship the models of pyspark.ml."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()])


def mention_contexts(bem: DataFrame, sentences: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, bem_index, kind, target_context, best_context): the sentence an offset lies in (not at its very start), else eighty characters
    around it. The best context is that of the best entity, or of the container (containments are containers), else NA."""
    t = bem.select("doc_id", "bem_index", "kind", F.col("target.start_offset").alias("t"), F.when(F.col("kind").isin("Full", "CorefFull", "CorefIdentity", "LinkResolved"), F.col("best.start_offset")).when(F.col("kind").isin("Container", "Containment"), F.col("container.start_offset")).alias("b"))
    at = t.select("doc_id", F.col("t").alias("inner_id")).union(t.select("doc_id", "b")).filter("inner_id is not null").distinct()
    where = sentence_of(at.select("doc_id", "inner_id", F.col("inner_id").alias("start"), F.col("inner_id").alias("end")), sentences.select("doc_id", "sent_num", "start", "end"), strict=True)
    said = at.join(where, ["doc_id", "inner_id"], "left").join(sentences.select("doc_id", "sent_num", F.col("text").alias("sentence")), ["doc_id", "sent_num"], "left").join(docs.select("doc_id", "text"), "doc_id", "left")
    said = said.select("doc_id", F.col("inner_id").alias("o"), F.coalesce("sentence", context(F.col("text"), F.col("inner_id"))).alias("c"))
    x, y = said.toDF("doc_id", "t", "target_context"), said.toDF("doc_id", "b", "bc")
    j = t.join(x, ["doc_id", "t"], "left").join(y, ["doc_id", "b"], "left")
    best = F.coalesce("bc", F.lit("NA"))
    return j.select("doc_id", "bem_index", "kind", "target_context", best.alias("best_context"))
