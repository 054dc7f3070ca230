"""Files in and out: raw corpora, TSV forms of sentences and labels, tag files, reports, nested Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_files(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """(path, text) of all files below a folder, whole and with their line ends. A file is one document stream: no document runs into the
    next file. ``glob`` keeps files by name, such as '*sgm'."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", F.decode("content", encoding).alias("text"))


def raw_text(spark: SparkSession, text: str | Iterable[str], path: str) -> DataFrame:
    """(path, text) of what a program has in hand: a whole text, or the lines of standard input or another stream, line ends kept."""
    return spark.createDataFrame([(path, text if isinstance(text, str) else "".join(text))], "path string, text string")


def raw_url(spark: SparkSession, url: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, text) of what a URL delivers, fetched by the driver."""
    from urllib.request import urlopen

    with urlopen(url) as r:
        return raw_text(spark, r.read().decode(encoding), url)


def uneven_files(docs: DataFrame) -> DataFrame:
    """Files that do not hold exactly one document: (path, documents)."""
    return docs.groupBy("path").agg(F.count_distinct("doc_ord").alias("documents")).filter("documents <> 1")


def sentences(lines: DataFrame, line: str = "line") -> DataFrame:
    """(doc_id, sent_num, start_offset, text) of TSV lines; lines of under four fields are left out."""
    p = F.split(F.col(line), "\t", -1)
    return lines.withColumn("p", p).filter(F.size("p") >= 4).select(F.col("p")[0].alias("doc_id"), F.expr("try_cast(p[1] as int)").alias("sent_num"), F.expr("try_cast(p[2] as int)").alias("start_offset"), F.col("p")[3].alias("text"))


def sentence_lines(df: DataFrame) -> DataFrame:
    cols = [F.col(c).cast("string") for c in ("doc_id", "sent_num", "start_offset")]
    return df.select(F.concat_ws("\t", *cols, F.replace("text", F.lit("\t"), F.lit(""))).alias("line"))


def parsed_sentences(lines: DataFrame, line: str = "line") -> DataFrame:
    p = F.split(F.col(line), "\t", -1)
    good = lines.withColumn("p", p).filter(F.size("p") >= 5)
    return good.select(F.col("p")[0].alias("doc_id"), F.expr("try_cast(p[1] as int)").alias("sent_num"), F.expr("try_cast(p[2] as int)").alias("start_offset"), F.split(F.col("p")[3], r"\s+").alias("chunks"), F.col("p")[4].alias("dgraph"))


def parsed_lines(df: DataFrame) -> DataFrame:
    flat = lambda c: F.translate(c, "\t", " ")
    return df.select(F.concat_ws("\t", "doc_id", F.col("sent_num").cast("string"), F.col("start_offset").cast("string"), flat(F.array_join("chunks", " ")), flat(F.col("dgraph"))).alias("line"))


def labelled(lines: DataFrame, line: str = "line") -> DataFrame:
    """(doc_id, bem_index, label) of a labelled TSV: four columns or more, a label of 0 or 1, the last two columns index and document.
    The header has no such label and falls away."""
    p = F.split(F.col(line), "\t", -1)
    good = lines.withColumn("p", p).filter((F.size("p") >= 4) & F.col("p")[0].isin("0", "1"))
    return good.select(F.element_at("p", -1).alias("doc_id"), F.expr("try_cast(element_at(p, -2) as int)").alias("bem_index"), F.col("p")[0].cast("int").alias("label"))


def gazetteer_lines(spark: SparkSession, path: str) -> DataFrame:
    # the text reader knows UTF-8 only; a separator that no line holds makes the CSV reader give whole lines
    return spark.read.csv(path, schema="line string", encoding="ISO-8859-1", sep="\u0001", quote="")


def kb_entities(lines: DataFrame, line: str = "line") -> DataFrame:
    """(id, name, typ) of lines that are an entity tag and nothing else."""
    pattern = r'^<entity wiki_title="([^"]+)" type="([^"]+)" id="([^"]+)" name="([^"]+)">$'
    good = lines.filter(F.col(line).rlike(pattern))
    return good.select(F.regexp_extract(line, pattern, 3).alias("id"), F.regexp_extract(line, pattern, 4).alias("name"), F.regexp_extract(line, pattern, 2).alias("typ"))


def name_to_node(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(name, node) of lines of id, name and type: of a name on several lines the last one counts. Lines of fewer fields are an error."""
    p = lines.select(F.split(F.col(line), "\t", -1).alias("p"), F.col(line).alias("l"), order)
    field = lambda i: F.when(F.size("p") >= 3, F.col("p")[i]).otherwise(F.raise_error(F.concat(F.lit("no entity: "), F.col("l"))))
    return p.groupBy(field(1).alias("name")).agg(F.max_by(field(0), order).alias("node"))


def kb_lines(entities: DataFrame) -> DataFrame:
    """Entities (id, name, typ) as TSV lines."""
    return entities.select(F.concat_ws("\t", "id", "name", "typ").alias("line"))


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(line).write.mode("overwrite").text(path)


def write_split(texts: DataFrame, path: str, most: int = -1) -> None:
    """Every document (path, doc_ord, text) as a text file of its own, in a folder that bears its file and its number there; the first
    ``most`` by file and number, all if it is negative. Files end with a line break, whether the text does or not."""
    from ..operators.ingest import first_documents

    named = first_documents(texts, most).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("doc_ord").alias("doc"), F.regexp_replace("text", r"\n\z", "").alias("text"))
    named.repartition("file", "doc").write.mode("overwrite").partitionBy("file", "doc").text(path)


def write_documents(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Nested rows as Parquet, in place of one binary file for each document."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
