"""Raw marked-up files to documents: lines with terminators, documents, headers, paragraphs, numbered sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import asciify, clean, is_blank, same_length, usable_sentence

CLOSING = r"^\s*(</DOC>|</doc>)\s*$"


def split_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``line_no``, ``line`` with its terminator (\\n, \\r or \\r\\n) and ``start_offset``. ``keep`` must tell the texts apart."""
    parts = F.split(F.col(text), r"(?<=\n)|(?<=\r)(?!\n)", -1)
    rows = df.select(*keep, F.posexplode(parts).alias("line_no", "line")).filter("line <> ''")
    before = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start_offset", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).cast("int"))


def split_documents(lines: DataFrame, path: str) -> DataFrame:
    """Adds ``doc_ord`` and ``doc_offset``: a document goes up to and including a closing line; lines after the last one form one more.
    Lines that repeat a (path, line_no) count once. Other columns are left out."""
    lines = lines.select(F.col(path).alias("path"), "line_no", "line").dropDuplicates(["path", "line_no"])
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("doc_ord", F.coalesce(F.sum(F.col("line").rlike(CLOSING).cast("int")).over(before), F.lit(0)).cast("int"))
    within = Window.partitionBy("path", "doc_ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("doc_offset", F.coalesce(F.sum(F.length("line")).over(within), F.lit(0)).cast("int"))


def document_texts(docs: DataFrame) -> DataFrame:
    """The text of each document, its lines put together again."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # one document
    return docs.groupBy("path", "doc_ord").agg(lines.alias("l")).select("path", "doc_ord", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))


def _doc_id(line: Column) -> Column:
    return F.when(line.startswith("<DOCID>"), F.regexp_extract(F.substring(line, F.lit(9), F.length(line)), "^[^ ]*", 0)).when(
        line.rlike(r"^(?i)<DOC\s+id="), F.regexp_extract(F.substring(line, F.lit(10), F.length(line)), '^[^"]*', 0)
    )


def _fabricated(start: Column, text: Column, prefix: str, line: Column, offset: Column, what: str) -> Column:
    """A sentence around a mention whose offset still points at the mention; null if it would leave the document or the line."""
    at = start - len(prefix) + offset
    fits = (at >= 0) & (start + F.length(text) + 1 <= F.length(line))
    return F.when(fits, F.struct(F.concat(F.lit(prefix), text, F.lit(".")).alias("text"), at.cast("int").alias("start_offset"))).alias(what)


CORPORA = ["web", "news", "forum"]


def headers(docs: DataFrame, corpus: str | None = None) -> DataFrame:
    """One row for each document: ``corpus``, ``doc_id``, ``author`` and ``written`` (structs of text and offset, or null). A document
    without an id line has null ``doc_id`` and is to be rejected. The corpus is told by the id line, unless all are of one ``corpus``;
    an unknown one is an error."""
    if corpus is not None and corpus not in CORPORA:
        raise ValueError(f'unknown corpus "{corpus}"')
    given = corpus
    line, no = F.col("line"), F.col("line_no")
    first = lambda tag: F.min_by(F.when(line.startswith(tag), F.struct("line", "doc_offset")), F.when(line.startswith(tag), no))
    news_id = line.rlike(r"^<DOC\s+id=")
    got = docs.groupBy("path", "doc_ord").agg(
        first("<DOCID>").alias("web"), F.min_by(F.when(news_id, F.struct("line", "doc_offset")), F.when(news_id, no)).alias("news"), first("<doc id").alias("forum"), first("<POSTER>").alias("poster"), first("<DATETIME>").alias("dated")
    )
    corpus = F.when(F.col("web").isNotNull(), "web").when(F.col("news").isNotNull(), "news").when(F.col("forum").isNotNull(), "forum")
    id_line = F.coalesce("web.line", "news.line", "forum.line") if given is None else F.col(f"{given}.line")
    got = got.withColumn("corpus", corpus if given is None else F.lit(given)).withColumn("id_line", id_line).withColumn("doc_id", _doc_id(F.col("id_line")))
    shown = F.regexp_replace(F.regexp_extract(F.substring("poster.line", F.lit(10), F.length("poster.line")), "^[^&<\n]*", 0), r"\s+$", "")
    got = got.withColumn("shown", shown).withColumn("quoted", F.col("shown").rlike('^"[^"]+"$'))
    got = got.withColumn("name", F.when(F.col("quoted"), F.expr("substring(shown, 2, length(shown) - 2)")).otherwise(F.col("shown")))
    author = _fabricated(F.when(F.col("quoted"), 10).otherwise(9), F.col("name"), "This post was written by ", F.col("poster.line"), F.col("poster.doc_offset"), "author")
    date = F.regexp_extract(F.substring("dated.line", F.lit(12), F.length("dated.line")), "^[^<]*", 0)
    written = _fabricated(F.lit(11), date, "This post was written on ", F.col("dated.line"), F.col("dated.doc_offset"), "written")
    web = F.col("corpus") == "web"  # only web documents carry both
    return got.select("path", "doc_ord", "corpus", "doc_id", "id_line", F.when(web, author).alias("author"), F.when(web, written).alias("written"))


def text_lines(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """``docs`` with tag lines blanked, and the date of news documents too: the line after their first dateline."""
    one = Window.partitionBy("path", "doc_ord")
    dateline = F.col("line").startswith("<DATELINE>")
    first = F.min(F.when(dateline, F.col("line_no"))).over(one)
    after = F.lag("line_no").over(one.orderBy("line_no")) == first
    body = docs.withColumn("dated", F.coalesce(after, F.lit(False))).join(heads.select("path", "doc_ord", "corpus"), ["path", "doc_ord"], "left")
    gone = F.col("line").startswith("<") | (F.col("dated") & (F.coalesce("corpus", F.lit("")) == "news"))
    return body.withColumn("line", F.when(gone, "\n").otherwise(F.col("line"))).drop("dated", "corpus")


def rejected(docs: DataFrame, heads: DataFrame, lines: int = 5) -> DataFrame:
    """(path, doc_ord, reason, sample) of documents without an id line, or whose line yields no id; the sample holds their first text lines."""
    bad = heads.filter("doc_id is null").select("path", "doc_ord", F.when(F.col("id_line").isNull(), "no id line").otherwise("no id in its line").alias("reason"))
    number = F.row_number().over(Window.partitionBy("path", "doc_ord").orderBy("line_no"))
    some = text_lines(docs.join(bad.select("path", "doc_ord"), ["path", "doc_ord"], "left_semi"), heads).withColumn("n", number).filter(F.col("n") <= lines)
    text = some.groupBy("path", "doc_ord").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))  # at most ``lines``
    return bad.join(text, ["path", "doc_ord"], "left").select("path", "doc_ord", "reason", F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("")).alias("sample"))


def paragraphs(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Maximal runs of non-blank lines (tag lines count as blank): ``par_no``, ``start_offset`` and ``text``."""
    body = text_lines(docs, heads).withColumn("blank", is_blank(F.col("line")))
    so_far = Window.partitionBy("path", "doc_ord").orderBy("line_no")
    body = body.withColumn("island", F.sum(F.col("blank").cast("int")).over(so_far)).filter(~F.col("blank"))
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # one paragraph
    runs = body.groupBy("path", "doc_ord", "island").agg(F.min("doc_offset").alias("start_offset"), lines.alias("l"))
    number = F.row_number().over(Window.partitionBy("path", "doc_ord").orderBy("start_offset")) - 1
    return runs.select("path", "doc_ord", number.alias("par_no"), "start_offset", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))


def segments(pars: DataFrame) -> DataFrame:
    """The default segmenter: a sentence ends after . ! or ? before white space. Starts are sums of the lengths before, so nothing is lost."""
    parts = F.split("text", r"(?<=[.!?]\s)", -1)
    rows = pars.select("path", "doc_ord", "par_no", F.col("start_offset").alias("par_offset"), F.posexplode(parts).alias("seg_no", "text")).filter("text <> ''")
    before = Window.partitionBy("path", "doc_ord", "par_no").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start_offset", (F.col("par_offset") + F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).cast("int")).drop("par_offset")


def numbered_sentences(segs: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, doc_ord, sent_num, start_offset, text): author first, then date, then the body; line breaks and tabs become blanks.
    Documents without an id are left out."""
    ok = heads.filter("doc_id is not null")
    flat = lambda x: F.translate(x, "\n\t", "  ")
    fab = lambda c, k: ok.filter(F.col(c).isNotNull()).select("path", "doc_ord", F.lit(k).alias("k"), F.col(f"{c}.start_offset").alias("start_offset"), flat(F.col(f"{c}.text")).alias("text"))
    body = segs.join(ok.select("path", "doc_ord"), ["path", "doc_ord"], "left_semi").select("path", "doc_ord", F.lit(2).alias("k"), "start_offset", flat(F.col("text")).alias("text"))
    every = fab("author", 0).unionByName(fab("written", 1)).unionByName(body)
    number = F.row_number().over(Window.partitionBy("path", "doc_ord").orderBy("k", "start_offset")) - 1
    return every.select("path", "doc_ord", number.alias("sent_num"), "start_offset", "text")


def usable_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """Only usable sentences, with ASCII punctuation; offsets hold."""
    kept = df.filter(usable_sentence(F.col(text)))
    return kept.withColumn(text, same_length(F.col(text), asciify(F.col(text))))


def process(lines: DataFrame, path: str, filtered: bool = True, corpus: str | None = None) -> DataFrame:
    """All steps from raw lines to numbered sentences. What ``rejected`` tells is left out."""
    docs = split_documents(lines, path)
    heads = headers(docs, corpus)
    out = numbered_sentences(segments(paragraphs(docs, heads)), heads)
    return usable_sentences(out) if filtered else out


def first_documents(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by path and order; all of them if ``n`` is negative."""
    if n < 0:
        return docs
    ids = docs.select("path", "doc_ord").distinct().orderBy("path", "doc_ord").limit(n)
    return docs.join(ids, ["path", "doc_ord"], "left_semi")


def first_sentences(sentences: DataFrame, n: int) -> DataFrame:
    """The first ``n`` sentences by document and number; all of them if ``n`` is negative."""
    return sentences if n < 0 else sentences.orderBy(*[c for c in ("path", "doc_ord", "doc_id", "sent_num") if c in sentences.columns]).limit(n)


def clean_entity_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, clean(F.col(text)))
