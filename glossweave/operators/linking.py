"""Arguments of extractions: cleaning, substitution, contexts and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LEAST_SCORE
from .coref import argument_sentences

# Words that an argument does not begin or end with.
EDGE_TAGS = ["DT", "IN", "TO", "PRP$"]


def strip_edges(tokens: Column) -> Column:
    """``tokens`` (array of struct text, start_offset, pos) without one determiner or preposition at each end."""
    loose = lambda t: t["pos"].isin(EDGE_TAGS)
    front = F.when((F.size(tokens) > 0) & loose(F.try_element_at(tokens, F.lit(1))), 1).otherwise(0)
    back = F.when((F.size(tokens) > front) & loose(F.try_element_at(tokens, F.lit(-1))), 1).otherwise(0)
    return F.slice(tokens, front + 1, F.greatest(F.lit(0), F.size(tokens) - front - back))


def clean_argument(tokens: Column) -> Column:
    """Struct of the text of the stripped tokens and the offset of the first of them."""
    kept = strip_edges(tokens)
    return F.struct(F.array_join(F.transform(kept, lambda t: t["text"]), " ").alias("text"), F.try_element_at(kept, F.lit(1))["start_offset"].alias("start_offset"))


def substitute(text: Column, subs: Column) -> Column:
    """``text`` with spans replaced: ``subs`` is an array of struct (start, end, best), positions in the text, not overlapping. A
    possessive keeps its 's: 'his' for 'John Smith' gives 'John Smith's'."""
    last_first = F.reverse(F.array_sort(F.transform(subs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["best"].alias("best")))))

    def put(acc: Column, s: Column) -> Column:
        old = F.lower(F.substring(acc, s["start"] + 1, s["end"] - s["start"]))
        owns = old.isin("his", "her", "its", "their", "my", "your", "our") | old.rlike("['’]s$")
        new = F.when(owns & ~s["best"].rlike("['’]s?$"), F.concat(s["best"], F.lit("'s"))).otherwise(s["best"])
        return F.concat(F.substring(acc, F.lit(1), s["start"]), new, F.substring(acc, s["end"] + 1, F.length(acc)))

    return F.aggregate(last_first, text, put)


def distinct_arguments(extractions: DataFrame) -> DataFrame:
    """(doc_id, sent_num, arg_no, text, start_offset): the first and second arguments of a sentence, each text and place once, in the order
    they come up."""
    two = extractions.select("doc_id", "sent_num", "ext_no", F.posexplode(F.array("arg1", "arg2")).alias("i", "arg")).filter("arg is not null")
    one = two.groupBy("doc_id", "sent_num", F.col("arg.text").alias("text"), F.col("arg.start_offset").alias("start_offset")).agg(F.min(F.struct("ext_no", "i")).alias("o"))
    number = F.row_number().over(Window.partitionBy("doc_id", "sent_num").orderBy("o")) - 1
    return one.select("doc_id", "sent_num", number.alias("arg_no"), "text", "start_offset")


def contexts(args: DataFrame, mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, arg_id, context, size): the sentences that speak of an argument through its clusters, each text once, in order, and their
    number and one. ``args`` have (doc_id, arg_id, start, end), ``sentences`` (doc_id, sent_num, start, end, text). The sentence of the
    argument itself is added by ``argument_contexts``."""
    said = argument_sentences(args, mentions, sentences.select("doc_id", "sent_num", "start", "end")).join(sentences.select("doc_id", "sent_num", "text"), ["doc_id", "sent_num"])
    per = said.groupBy("doc_id", "arg_id").agg(F.array_sort(F.collect_list(F.struct("sent_num", "text"))).alias("s"))  # of one argument
    out = args.select("doc_id", "arg_id").join(per, ["doc_id", "arg_id"], "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<sent_num:int,text:string>>")))
    return out.select("doc_id", "arg_id", F.array_join(F.array_distinct(F.transform("s", lambda x: x["text"])), " ").alias("context"), (F.size("s") + 1).alias("size"))


def argument_contexts(args: DataFrame, mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, arg_id, start_offset, text, sent_num, full_text, size, cluster_mentions) of arguments (doc_id, arg_id, sent_num, start_offset,
    text): the texts of the sentence an argument stands in and of those its clusters lead to, each once, in this order; their number
    before repeats are dropped; and the mentions of these clusters, '(offset) text', by cluster and offset."""
    from .coref import cluster_of
    from .spans import sentence_of, within

    a = args.select("doc_id", "arg_id", "sent_num", "start_offset", "text", F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end"))
    m = mentions.withColumn("end", F.col("start_offset") + F.length("text")).withColumn("key", F.concat_ws(":", "start_offset", "text"))
    inside = within(a.withColumnRenamed("arg_id", "outer_id"), m.select("doc_id", F.col("key").alias("inner_id"), F.col("start_offset").alias("start"), "end"))
    owner = cluster_of(mentions).select("doc_id", F.concat_ws(":", "start_offset", "text").alias("inner_id"), "cluster_id")
    clusters = inside.join(owner, ["doc_id", "inner_id"]).select("doc_id", F.col("outer_id").alias("arg_id"), "cluster_id").distinct()
    where = sentence_of(m.select("doc_id", F.col("key").alias("inner_id"), F.col("start_offset").alias("start"), "end").distinct(), sentences.select("doc_id", "sent_num", "start", "end"))
    member = m.select("doc_id", "cluster_id", "start_offset", "text", F.col("key").alias("inner_id")).distinct().join(where, ["doc_id", "inner_id"], "left")
    member = member.join(sentences.select("doc_id", "sent_num", F.col("text").alias("said")), ["doc_id", "sent_num"], "left")
    row = F.struct("cluster_id", "start_offset", "text", "sent_num", "said")
    per = clusters.join(member, ["doc_id", "cluster_id"]).groupBy("doc_id", "arg_id").agg(F.array_sort(F.collect_list(row)).alias("m"))  # of one argument
    own = sentences.select("doc_id", "sent_num", F.col("text").alias("own"))
    j = a.drop("start", "end").join(per, ["doc_id", "arg_id"], "left").join(own, ["doc_id", "sent_num"], "left")
    none = F.array().cast("array<struct<cluster_id:int,start_offset:int,text:string,sent_num:int,said:string>>")
    j = j.withColumn("m", F.coalesce("m", none)).withColumn("ext", F.filter("m", lambda x: x["said"].isNotNull()))
    said = F.array_distinct(F.concat(F.array_compact(F.array("own")), F.transform("ext", lambda x: x["said"])))
    ids = F.array_distinct(F.transform("m", lambda x: x["cluster_id"]))
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.filter("m", lambda x: x["cluster_id"] == c), lambda x: F.concat(F.lit("("), x["start_offset"].cast("string"), F.lit(") "), x["text"])), ", "), F.lit("]"))
    return j.select("doc_id", "arg_id", "start_offset", "text", "sent_num", said.alias("full_text"), (F.size("ext") + 1).alias("size"), F.array_join(F.transform(ids, shown), " ").alias("cluster_mentions"))


def cleaned_arguments(args: DataFrame) -> DataFrame:
    """``args`` with ``clean`` and ``clean_offset``: without a determiner or preposition at either end, by their ``tokens``; an argument of
    nothing else has an empty text and no offset."""
    return args.withColumn("_c", clean_argument(F.col("tokens"))).withColumn("clean", F.col("_c.text")).withColumn("clean_offset", F.col("_c.start_offset")).drop("_c")


def look_up(args: DataFrame, kb: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, arg_id, start_offset, text, id, name, score): the entry of ``kb`` (id, name, typ, prior) whose name an argument bears, in
    any case; the highest prior wins, then the smaller id, and scores below ``least`` are dropped. A stand-in for a linker."""
    k = kb.filter("name is not null").select("id", "name", "typ", F.col("prior").alias("score"), F.lower(F.trim("name")).alias("key"))
    a = args.select("doc_id", "arg_id", "start_offset", "text", F.lower(F.trim("text")).alias("key"))
    best = a.join(k, "key").groupBy("doc_id", "arg_id", "start_offset", "text").agg(F.min(F.struct((-F.col("score")).alias("neg"), "id", "name", "typ")).alias("b"))
    return best.select("doc_id", "arg_id", "start_offset", "text", "b.id", "b.name", "b.typ", (-F.col("b.neg")).alias("score")).filter(F.col("score") >= least)
