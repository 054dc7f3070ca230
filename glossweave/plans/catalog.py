"""The engine's queries by name, over the tables of a data folder, and the SQL with the same result.

The tables that stand for the inputs: ``doc_lines`` raw lines (each document a file), ``documents`` texts, ``entities`` tagged
mentions, ``links`` linker candidates, ``best_mentions`` resolved mentions with clusters, ``gazetteer`` and ``kb_entities``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.annotators import DETERMINERS, PREPOSITIONS
from ..functions.fixed import ASCII_FROM, ASCII_TO, LINK_TYPES, PERSONAL, PRONOUNS, STATES
from ..functions.text import asciify, link_entity_type, location_casing, tsv_clean, usable_sentence
from ..operators import coref, evaluate, gazetteer, ingest, linking, reports, resolve, spans
from ..session import materialise
from ..sources import files
from ..sources.tables import table
from . import pipelines

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- ingestion ---------------------------------------------------------------------------------------------------------------

@query(r"""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\r\n]*(\r\n|\n|\r)|[^\r\n]+$')) AS line, generate_subscripts(regexp_extract_all(text, '[^\r\n]*(\r\n|\n|\r)|[^\r\n]+$'), 1) - 1 AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(line) AS line_hash, CAST(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_offset FROM l""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return ingest.split_lines(table(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", "line_no", F.md5("line").alias("line_hash"), "start_offset")


_DOCS = r"""
raw AS (SELECT doc_id AS path, line_no, any_value(line) AS line FROM doc_lines GROUP BY ALL),
docs AS (SELECT *, CAST(coalesce(sum(CAST(regexp_full_match(line, '\s*(</DOC>|</doc>)\s*') AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS doc_ord FROM raw),
offs AS (SELECT *, CAST(coalesce(sum(length(line)) OVER (PARTITION BY path, doc_ord ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS doc_offset FROM docs)
"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.split_documents(table(spark, d, "doc_lines"), "doc_id")


@query(f"WITH {_DOCS} SELECT path, line_no, doc_ord, doc_offset FROM offs")
def doc_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("path", "line_no", "doc_ord", "doc_offset")


@query(f"WITH {_DOCS} SELECT path, doc_ord, md5(string_agg(line, '' ORDER BY line_no)) AS text_hash FROM offs GROUP BY ALL")
def doc_text(spark: SparkSession, d: str) -> DataFrame:
    return ingest.document_texts(_docs(spark, d)).select("path", "doc_ord", F.md5("text").alias("text_hash"))


_HEADS = _DOCS + r""",
h AS (SELECT path, doc_ord, min_by(line, line_no) FILTER (starts_with(line, '<DOCID>')) AS web, min_by(line, line_no) FILTER (regexp_matches(line, '^<DOC\s+id=')) AS news, min_by(line, line_no) FILTER (starts_with(line, '<doc id')) AS forum,
    min_by(line, line_no) FILTER (starts_with(line, '<POSTER>')) AS poster, min_by(doc_offset, line_no) FILTER (starts_with(line, '<POSTER>')) AS p_off,
    min_by(line, line_no) FILTER (starts_with(line, '<DATETIME>')) AS dated, min_by(doc_offset, line_no) FILTER (starts_with(line, '<DATETIME>')) AS d_off FROM offs GROUP BY ALL),
h2 AS (SELECT *, CASE WHEN web IS NOT NULL THEN 'web' WHEN news IS NOT NULL THEN 'news' WHEN forum IS NOT NULL THEN 'forum' END AS corpus, coalesce(web, news, forum) AS idl,
    regexp_replace(regexp_extract(substr(poster, 10), '^[^&<\n]*'), '\s+$', '') AS shown, regexp_extract(substr(dated, 12), '^[^<]*') AS dt FROM h),
h3 AS (SELECT *, regexp_matches(shown, '^"[^"]+"$') AS quoted FROM h2),
h4 AS (SELECT *, CASE WHEN quoted THEN substr(shown, 2, length(shown) - 2) ELSE shown END AS nm, CASE WHEN quoted THEN 10 ELSE 9 END AS st FROM h3),
heads AS (SELECT path, doc_ord, corpus, idl AS id_line, CASE WHEN starts_with(idl, '<DOCID>') THEN regexp_extract(substr(idl, 9), '^[^ ]*') WHEN idl IS NOT NULL THEN regexp_extract(substr(idl, 10), '^[^"]*') END AS doc_id,
    CASE WHEN corpus = 'web' AND st - 24 + p_off >= 0 AND st + length(nm) + 1 <= length(poster) THEN 'This post was written by ' || nm || '.' END AS author,
    CASE WHEN corpus = 'web' AND st - 24 - 1 + p_off >= 0 AND st + length(nm) + 1 <= length(poster) THEN CAST(st - 25 + p_off AS INT) END AS author_offset,
    CASE WHEN corpus = 'web' AND 11 - 25 + d_off >= 0 AND 11 + length(dt) + 1 <= length(dated) THEN 'This post was written on ' || dt || '.' END AS written,
    CASE WHEN corpus = 'web' AND 11 - 25 + d_off >= 0 AND 11 + length(dt) + 1 <= length(dated) THEN CAST(11 - 25 + d_off AS INT) END AS written_offset FROM h4)
"""


@query(f"WITH {_HEADS} SELECT * EXCLUDE (id_line) FROM heads")
def header_fields(spark: SparkSession, d: str) -> DataFrame:
    h = ingest.headers(_docs(spark, d))
    return h.select("path", "doc_ord", "corpus", "doc_id", F.col("author.text").alias("author"), F.col("author.start_offset").alias("author_offset"), F.col("written.text").alias("written"), F.col("written.start_offset").alias("written_offset"))


_PARS = r""",
dl AS (SELECT *, min(line_no) FILTER (starts_with(line, '<DATELINE>')) OVER (PARTITION BY path, doc_ord) AS dl_no, lag(line_no) OVER (PARTITION BY path, doc_ord ORDER BY line_no) AS prev_no FROM offs),
body AS (SELECT path, doc_ord, line_no, doc_offset, CASE WHEN starts_with(line, '<') OR (corpus = 'news' AND prev_no IS NOT NULL AND prev_no = dl_no) THEN chr(10) ELSE line END AS line FROM dl LEFT JOIN (SELECT path, doc_ord, corpus FROM heads) USING (path, doc_ord)),
isl AS (SELECT *, regexp_full_match(line, '[\x00-\x20]*') AS blank, sum(CAST(regexp_full_match(line, '[\x00-\x20]*') AS INT)) OVER (PARTITION BY path, doc_ord ORDER BY line_no) AS island FROM body),
runs AS (SELECT path, doc_ord, island, min(doc_offset) AS start_offset, string_agg(line, '' ORDER BY line_no) AS text FROM isl WHERE NOT blank GROUP BY ALL),
pars AS (SELECT path, doc_ord, CAST(row_number() OVER (PARTITION BY path, doc_ord ORDER BY start_offset) - 1 AS INT) AS par_no, start_offset, text FROM runs)
"""


@query(f"WITH {_HEADS} {_PARS} SELECT path, doc_ord, par_no, start_offset, md5(text) AS text_hash FROM pars")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return ingest.paragraphs(docs, ingest.headers(docs)).select("path", "doc_ord", "par_no", "start_offset", F.md5("text").alias("text_hash"))


_SENTS = _PARS + r""",
cut AS (SELECT path, doc_ord, par_no, start_offset AS par_offset, string_split(regexp_replace(text, '([.!?][\t\n\x0b\f\r ])', '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM pars),
seg AS (SELECT path, doc_ord, par_no, par_offset, unnest(parts) AS text, generate_subscripts(parts, 1) AS seg_no FROM cut),
seg2 AS (SELECT *, par_offset + coalesce(sum(length(text)) OVER (PARTITION BY path, doc_ord, par_no ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_offset FROM seg),
every AS (SELECT path, doc_ord, 0 AS k, author_offset AS start_offset, author AS text FROM heads WHERE author IS NOT NULL AND author_offset IS NOT NULL AND doc_id IS NOT NULL
    UNION ALL SELECT path, doc_ord, 1, written_offset, written FROM heads WHERE written IS NOT NULL AND doc_id IS NOT NULL
    UNION ALL SELECT path, doc_ord, 2, start_offset, text FROM seg2 SEMI JOIN (SELECT * FROM heads WHERE doc_id IS NOT NULL) USING (path, doc_ord) WHERE text <> ''),
sents AS (SELECT path, doc_ord, CAST(row_number() OVER (PARTITION BY path, doc_ord ORDER BY k, start_offset) - 1 AS INT) AS sent_num, CAST(start_offset AS INT) AS start_offset, translate(text, chr(10) || chr(9), '  ') AS text FROM every)
"""


@query(f"WITH {_HEADS} {_SENTS} SELECT path, doc_ord, sent_num, start_offset, text FROM sents")
def sentence_numbering(spark: SparkSession, d: str) -> DataFrame:
    return ingest.process(table(spark, d, "doc_lines"), "doc_id", filtered=False)


_TAIL = _HEADS.replace("FROM doc_lines GROUP BY ALL)", "FROM (SELECT doc_id, line_no, line FROM doc_lines UNION ALL SELECT doc_id, max(line_no) + 1, 'left over' || chr(10) FROM doc_lines GROUP BY doc_id) GROUP BY ALL)")


@query(f"""WITH {_TAIL} {_PARS}, bad AS (SELECT path, doc_ord, CASE WHEN id_line IS NULL THEN 'no id line' ELSE 'no id in its line' END AS reason FROM heads WHERE doc_id IS NULL),
n AS (SELECT path, doc_ord, line, row_number() OVER (PARTITION BY path, doc_ord ORDER BY line_no) AS n, line_no FROM body SEMI JOIN bad USING (path, doc_ord))
SELECT path, doc_ord, reason, coalesce((SELECT string_agg(line, '' ORDER BY line_no) FROM n WHERE n.path = bad.path AND n.doc_ord = bad.doc_ord AND n.n <= 5), '') AS sample FROM bad""")
def rejected_documents(spark: SparkSession, d: str) -> DataFrame:
    """What ingestion leaves out, and why: every file is read with a line after its last document."""
    lines = table(spark, d, "doc_lines").select("doc_id", "line_no", "line")
    tail = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("line_no")).withColumn("line", F.lit("left over\n"))
    docs = ingest.split_documents(lines.unionByName(tail), "doc_id")
    return ingest.rejected(docs, ingest.headers(docs))


@query(f"""WITH {_TAIL} SELECT count(*) AS "rows", count(*) FILTER (doc_id IS NULL) AS rejected, count(*) FILTER (doc_id IS NULL AND id_line IS NULL) AS no_id_line, count(author) AS authors, count(written) AS dates FROM heads""")
def ingestion_counters(spark: SparkSession, d: str) -> DataFrame:
    """Documents read, rejected and with an author or a date, over the same lines as ``rejected_documents``."""
    lines = table(spark, d, "doc_lines").select("doc_id", "line_no", "line")
    tail = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("line_no")).withColumn("line", F.lit("left over\n"))
    heads = ingest.headers(ingest.split_documents(lines.unionByName(tail), "doc_id"))
    return reports.counters(heads, rejected=F.col("doc_id").isNull(), no_id_line=F.col("doc_id").isNull() & F.col("id_line").isNull(), authors=F.col("author").isNotNull(), dates=F.col("written").isNotNull())


_ASCII = f"translate(text, {_q(ASCII_FROM)}, {_q(ASCII_TO)})"


@query(f"SELECT doc_id, sent_num, {_ASCII} AS text FROM sentences WHERE length(text) <= 750 AND len(regexp_extract_all(text, '[\\t\\n\\x0b\\f\\r ]+')) >= 3")
def sentence_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.usable_sentences(table(spark, d, "sentences")).select("doc_id", "sent_num", "text")


@query(f"SELECT doc_id, md5({_ASCII}) AS ascii_hash FROM documents")
def asciify_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(asciify(F.col("text"))).alias("ascii_hash"))


@query("SELECT doc_id || chr(9) || CAST(sent_num AS VARCHAR) || chr(9) || CAST(start_offset AS VARCHAR) || chr(9) || replace(text, chr(9), '') AS line FROM sentences WHERE text IS NOT NULL")
def sentence_tsv(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import sentence_lines

    return sentence_lines(table(spark, d, "sentences").filter("text is not null"))


_TSV = "CAST(sent_num AS VARCHAR) || chr(9) || CAST(start_offset AS VARCHAR) || chr(9)"


@query("SELECT doc_id, sent_num, start_offset, replace(text, chr(9), '') AS text FROM sentences WHERE text IS NOT NULL")
def sentence_read(spark: SparkSession, d: str) -> DataFrame:
    """The sentence TSV, read again."""
    return files.sentences(files.sentence_lines(table(spark, d, "sentences").filter("text is not null")))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a chunk tag and a dependency for each word, by rule."""
    words = F.filter(F.split("text", r"[ \t\n]+"), lambda w: w != "")
    s = table(spark, d, "sentences").filter("text is not null").withColumn("w", words)
    tag = F.transform("w", lambda w: F.when(w.rlike("^[A-Z]"), "B-NP").otherwise("O"))
    return s.select("doc_id", "sent_num", "start_offset", tag.alias("chunks"), F.concat(F.lit("det("), F.array_join("w", "\t"), F.lit(")")).alias("dgraph"))


_PARSED = r"""p AS (SELECT doc_id, sent_num, start_offset, list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> '') AS w FROM sentences WHERE text IS NOT NULL),
pl AS (SELECT doc_id, sent_num, start_offset, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[A-Z]') THEN 'B-NP' ELSE 'O' END) AS chunks, 'det(' || coalesce(array_to_string(w, chr(9)), '') || ')' AS dgraph FROM p)"""


@query(f"WITH {_PARSED} SELECT doc_id || chr(9) || {_TSV} || coalesce(array_to_string(chunks, ' '), '') || chr(9) || translate(dgraph, chr(9), ' ') AS line FROM pl")
def parsed_tsv(spark: SparkSession, d: str) -> DataFrame:
    return files.parsed_lines(_parsed(spark, d))


@query(f"WITH {_PARSED} SELECT doc_id, sent_num, start_offset, CASE WHEN len(chunks) = 0 THEN [''] ELSE chunks END AS chunks, translate(dgraph, chr(9), ' ') AS dgraph FROM pl")
def parsed_read(spark: SparkSession, d: str) -> DataFrame:
    return files.parsed_sentences(parsed_tsv(spark, d))


@query("SELECT doc_id, bem_index, CAST(best_mention = target.name AS INT) AS label FROM best_mentions WHERE best_mention = target.name OR best_mention <> target.name")
def labels_read(spark: SparkSession, d: str) -> DataFrame:
    """Labelled TSV lines, read again: whether the best mention is the name itself. Unlabelled lines fall away, as the header does."""
    return files.labelled(_label_lines(spark, d))


def _label_lines(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "best_mentions")
    label = F.coalesce((F.col("best_mention") == F.col("target.name")).cast("int").cast("string"), F.lit(""))
    head = spark.createDataFrame([("label\ttarget text\tdoc bem index\tdoc id",)], "line string")
    return head.union(b.select(F.concat_ws("\t", label, F.regexp_replace("target.text", r"[\t\n]", " "), F.col("bem_index").cast("string"), "doc_id")))


@query("SELECT id || chr(9) || name || chr(9) || typ AS line FROM kb_entities")
def kb_tsv(spark: SparkSession, d: str) -> DataFrame:
    return files.kb_lines(kb_mapping(spark, d))


@query("SELECT typ AS name, max(id) AS node FROM kb_entities GROUP BY typ")
def node_map(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by name, the last line of a name counting; here the type stands for the name, so that names repeat."""
    lines = table(spark, d, "kb_entities").select(F.concat_ws("\t", "id", "typ", F.lit("x")).alias("line"), F.col("id").alias("line_no"))
    return files.name_to_node(lines)


@query(f"WITH {_DOCS} SELECT path, line_no, '(' || lpad(CAST(doc_offset AS VARCHAR), CAST(greatest(4, length(CAST(doc_offset AS VARCHAR))) AS INT), '0') || ') ' || line AS shown FROM offs")
def debug_dump(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import debug_line

    return _docs(spark, d).select("path", "line_no", debug_line(F.col("doc_offset"), F.col("line")).alias("shown"))


@query("SELECT count(DISTINCT doc_id) AS documents, count(*) AS lines, (SELECT count(*) FROM sentences) AS sentences, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM links) AS links FROM doc_lines")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t: table(spark, d, t).agg(F.lit(t).alias("t"), F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "doc_lines").agg(F.lit("documents").alias("t"), F.count_distinct("doc_id").alias("n")).union(n("doc_lines"))
    for t in ("sentences", "entities", "links"):
        rows = rows.union(n(t))
    of = lambda t, name: F.max(F.when(F.col("t") == t, F.col("n"))).alias(name)
    return rows.agg(of("documents", "documents"), of("doc_lines", "lines"), of("sentences", "sentences"), of("entities", "entities"), of("links", "links"))


# ---- spans -------------------------------------------------------------------------------------------------------------------

_SPANS = """
s AS (SELECT DISTINCT doc_id, sent_num, start_offset AS a, start_offset + length(text) AS b FROM sentences WHERE text IS NOT NULL),
e AS (SELECT DISTINCT doc_id, ent_no, start_offset AS a, start_offset + length(text) AS b, text FROM entities WHERE text IS NOT NULL),
l AS (SELECT DISTINCT doc_id, start_offset AS a, start_offset + length(text) AS b FROM links WHERE start_offset IS NOT NULL AND text IS NOT NULL)
"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").filter("text is not null").select("doc_id", "sent_num", F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end")).distinct()


def _entities(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, "entities").filter("text is not null").select("doc_id", F.col("ent_no").alias(name), F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end")).distinct()


def _links(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "links").filter("start_offset is not null and text is not null")
    return l.select("doc_id", F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end")).distinct().withColumn("inner_id", F.col("start"))


@query(f"WITH {_SPANS} SELECT DISTINCT s.doc_id, s.sent_num AS outer_id, e.ent_no AS inner_id FROM s JOIN e ON s.doc_id = e.doc_id AND e.a >= s.a AND e.b <= s.b")
def span_within(spark: SparkSession, d: str) -> DataFrame:
    return spans.within(_sentences(spark, d).withColumnRenamed("sent_num", "outer_id"), _entities(spark, d, "inner_id")).distinct()


@query(f"WITH {_SPANS} SELECT DISTINCT e.doc_id, e.ent_no AS outer_id, l.a AS inner_id FROM e JOIN l ON e.doc_id = l.doc_id AND l.a < e.b AND l.b > e.a")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    return spans.overlapping(_entities(spark, d, "outer_id"), _links(spark, d)).distinct()


@query(f"WITH {_SPANS} SELECT DISTINCT e.doc_id, e.ent_no AS outer_id, l.a AS inner_id FROM e JOIN l ON e.doc_id = l.doc_id AND l.a = e.a AND l.b = e.b")
def span_exact(spark: SparkSession, d: str) -> DataFrame:
    return spans.equal(_entities(spark, d, "outer_id"), _links(spark, d)).distinct()


@query(f"WITH {_SPANS} SELECT e.doc_id, e.ent_no AS inner_id, min(s.sent_num) AS sent_num FROM s JOIN e ON s.doc_id = e.doc_id AND e.a >= s.a AND e.b <= s.b GROUP BY ALL")
def sentence_of_span(spark: SparkSession, d: str) -> DataFrame:
    return spans.sentence_of(_entities(spark, d, "inner_id"), _sentences(spark, d))


@query(f"""WITH {_SPANS}, f AS (SELECT e.doc_id, e.ent_no, min(s.sent_num) AS sent_num FROM s JOIN e ON s.doc_id = e.doc_id AND e.a > s.a AND e.a < s.b GROUP BY ALL),
e1 AS (SELECT DISTINCT doc_id, ent_no, a FROM e)
SELECT e1.doc_id, e1.ent_no AS inner_id, f.sent_num, CASE WHEN f.sent_num IS NULL THEN regexp_replace(substr(d.text, greatest(0, e1.a - 40) + 1, 80), '[\\t\\n\\x0b\\f\\r ]', ' ', 'g') END AS context
FROM e1 JOIN documents d ON d.ext_id = e1.doc_id LEFT JOIN f ON f.doc_id = e1.doc_id AND f.ent_no = e1.ent_no""")
def sentence_context(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d, "inner_id")
    s = spans.sentence_of(e, _sentences(spark, d), strict=True)
    docs = table(spark, d, "documents").select(F.col("ext_id").alias("doc_id"), "text")
    j = e.select("doc_id", "inner_id", "start").distinct().join(s, ["doc_id", "inner_id"], "left").join(docs, "doc_id")
    return j.select("doc_id", "inner_id", "sent_num", F.when(F.col("sent_num").isNull(), spans.context(F.col("text"), F.col("start"))).alias("context"))


@query(f"""WITH RECURSIVE {_SPANS}, w AS (SELECT l.doc_id, l.a, l.b, min(s.sent_num) AS sent_num FROM s JOIN l ON s.doc_id = l.doc_id AND l.a >= s.a AND l.b <= s.b GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_num ORDER BY a, b) AS n FROM w),
r AS (SELECT doc_id, sent_num, n, a, b, true AS kept, b AS reach FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.sent_num, o.n, o.a, o.b, o.a >= r.reach, CASE WHEN o.a >= r.reach THEN o.b ELSE r.reach END FROM r JOIN o ON o.doc_id = r.doc_id AND o.sent_num = r.sent_num AND o.n = r.n + 1)
SELECT doc_id, sent_num, a AS start, b AS "end", a AS inner_id FROM r WHERE kept""")
def greedy_spans(spark: SparkSession, d: str) -> DataFrame:
    """The links of each sentence that are left when overlapping ones are dropped."""
    l = table(spark, d, "links").filter("start_offset is not null and text is not null").select("doc_id", F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end")).distinct().withColumn("inner_id", F.col("start"))
    where = spans.sentence_of(l, _sentences(spark, d))
    return spans.greedy(l.join(where, ["doc_id", "inner_id"]), ["doc_id", "sent_num"])


# ---- gazetteer ---------------------------------------------------------------------------------------------------------------

_GAZ = r"""
gl AS (SELECT list_transform(regexp_extract_all(line, '([^()]+)\((CITY|PROVINCE|COUNTRY)(?:\s\d+)?\)', 1), lambda x: trim(x)) AS n, regexp_extract_all(line, '([^()]+)\((CITY|PROVINCE|COUNTRY)(?:\s\d+)?\)', 2) AS t FROM gazetteer),
gx AS (SELECT n, t, len(n) AS k, unnest(range(1, len(n) + 1)) AS i FROM gl WHERE len(n) > 0),
g AS (SELECT DISTINCT n[i] AS name, t[i] AS typ, n[i + 1] AS cont_name, t[i + 1] AS cont_typ FROM gx WHERE k = 1 OR i < k),
gn AS (SELECT lower(name) AS lname, CAST(max(CAST(typ = 'CITY' AS INT)) AS INT) AS is_city, CAST(max(CAST(typ = 'PROVINCE' AS INT)) AS INT) AS is_province, CAST(max(CAST(typ = 'COUNTRY' AS INT)) AS INT) AS is_country FROM g GROUP BY ALL),
holds AS (SELECT DISTINCT lower(cont_name) AS container, lower(name) AS contained FROM g WHERE typ = 'CITY' AND cont_typ IN ('PROVINCE', 'COUNTRY') AND lower(name) IN (SELECT lname FROM gn WHERE is_city = 1)
    AND lower(cont_name) IN (SELECT lname FROM gn WHERE is_province = 1 OR is_country = 1))
"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer.places(table(spark, d, "gazetteer"))


@query(f"WITH {_GAZ} SELECT * FROM g")
def gazetteer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d)


@query(f"WITH {_GAZ} SELECT * FROM holds")
def containment(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer.containment(_places(spark, d))


@query(f"WITH {_GAZ}, c AS (SELECT lower(name) AS lname, count(*) AS places FROM g GROUP BY ALL) SELECT gn.*, places FROM gn JOIN c USING (lname)")
def location_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    g = _places(spark, d)
    return gazetteer.names(g).join(gazetteer.total_count(g), "lname")


@query(f"""WITH {_GAZ} SELECT g.name, g.cont_name, CAST(coalesce(a.is_city * b.is_city, 0) + coalesce(a.is_province * b.is_province, 0) + coalesce(a.is_country * b.is_country, 0) AS DOUBLE) AS type_similarity
FROM g LEFT JOIN gn a ON a.lname = lower(name) LEFT JOIN gn b ON b.lname = lower(cont_name) WHERE cont_name IS NOT NULL""")
def location_type_similarity(spark: SparkSession, d: str) -> DataFrame:
    g = _places(spark, d)
    return gazetteer.type_similarity(g.filter("cont_name is not null"), "name", "cont_name", g).select("name", "cont_name", "type_similarity")


@query("""SELECT DISTINCT name, array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN contains(w, '.') THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS cased FROM kb_entities""")
def location_cased(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_entities").select("name", location_casing(F.col("name")).alias("cased")).distinct()


_CASED = "array_to_string(list_transform(string_split({0}, ' '), lambda w: CASE WHEN contains(w, '.') THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"
_ABBR = ", ".join(f"('{k}', '{v}')" for k, v in STATES.items())


@query(f"""WITH {_GAZ}, cp AS (SELECT DISTINCT name, cont_name FROM g WHERE typ = 'CITY' AND cont_typ = 'PROVINCE'),
q AS (SELECT name, cont_name, name || ', ' || left(cont_name, 4) || '.' AS short FROM cp UNION ALL SELECT name, cont_name, name || ', WA' FROM cp UNION ALL SELECT name, cont_name, name || ', ' || cont_name FROM cp),
x AS (SELECT *, regexp_matches(short, '(\\w+),\\s([A-Za-z])\\.?([A-Za-z])\\.?$') AS two, regexp_extract(short, '(\\w+),\\s([A-Za-z])\\.?([A-Za-z])\\.?$', 1) AS town,
    upper(regexp_extract(short, '(\\w+),\\s([A-Za-z])\\.?([A-Za-z])\\.?$', 2) || regexp_extract(short, '(\\w+),\\s([A-Za-z])\\.?([A-Za-z])\\.?$', 3)) AS code, trim(string_split(short, ',')[1]) AS city, trim(string_split(short, ',')[2]) AS cont FROM q),
y AS (SELECT x.*, st.state, lower(CASE WHEN regexp_matches(right(cont, 1), '\\p{{L}}') THEN cont ELSE left(cont, length(cont) - 1) END) AS prefix FROM x LEFT JOIN (VALUES {_ABBR}) st(code, state) ON st.code = x.code)
SELECT name, cont_name, short, coalesce(CASE WHEN two THEN (SELECT cp.name || ', ' || cp.cont_name FROM cp WHERE cp.name = town AND cp.cont_name = state)
    WHEN length(prefix) > 2 THEN (SELECT city || ', ' || {_CASED.format("min(h.container)")} FROM holds h JOIN gn ON gn.lname = h.container AND gn.is_province = 1 WHERE h.contained = lower(city) AND starts_with(h.container, prefix) HAVING count(*) > 0) END, short) AS expanded FROM y""")
def abbreviation_expand(spark: SparkSession, d: str) -> DataFrame:
    """Every 'City, Province' of the gazetteer with the province cut to its first four letters, as a state of two letters that does not hold it,
    and in full, expanded again."""
    g = _places(spark, d)
    p = g.filter("typ = 'CITY' and cont_typ = 'PROVINCE'").select("name", "cont_name").distinct()
    forms = F.array(F.concat(F.col("name"), F.lit(", "), F.substring("cont_name", 1, 4), F.lit(".")), F.concat(F.col("name"), F.lit(", WA")), F.concat_ws(", ", "name", "cont_name"))
    return gazetteer.expand_locations(p.withColumn("short", F.explode(forms)), "short", g)


@query("""WITH t AS (SELECT '<entity wiki_title="' || wiki_title || '" type="' || typ || '" id="' || id || '" name="' || name || '">' AS line FROM kb_entities)
SELECT regexp_extract(line, 'id="([^"]*)"', 1) AS id, regexp_extract(line, 'name="([^"]*)"', 1) AS name, regexp_extract(line, ' type="([^"]*)"', 1) AS typ FROM t""")
def kb_mapping(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import kb_entities

    tag = F.concat(F.lit('<entity wiki_title="'), "wiki_title", F.lit('" type="'), "typ", F.lit('" id="'), "id", F.lit('" name="'), "name", F.lit('">'))
    return kb_entities(table(spark, d, "kb_entities").select(tag.alias("line")))


# ---- resolution --------------------------------------------------------------------------------------------------------------

_ENT = r"""
e AS (SELECT DISTINCT doc_id, ent_no, text, start_offset, name, entity_type, regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g') AS target, string_split(regexp_replace(name, ' +$', ''), ' ') AS w FROM entities WHERE text IS NOT NULL AND name IS NOT NULL),
tw AS (SELECT *, len(string_split(regexp_replace(target, ' +$', ''), ' ')) AS k FROM e)
"""
_AFFIX = """len(c.w) > t.k AND (array_to_string(c.w[:t.k], ' ') = t.target OR array_to_string(c.w[len(c.w) - t.k + 1:], ' ') = t.target)"""


def _pick(sql_from: str, near: bool = True) -> str:
    far = "abs(c.start_offset - t.start_offset)" if near else "0"
    return f"""SELECT t.doc_id, t.ent_no, arg_min(c.name, row(({far}), c.ent_no, c.name, c.start_offset)) AS best_name, arg_min(c.start_offset, row(({far}), c.ent_no, c.name, c.start_offset)) AS best_offset,
        1.0::DOUBLE / count(DISTINCT c.name) AS candidate_count {sql_from} GROUP BY t.doc_id, t.ent_no"""


def _ents(spark: SparkSession, d: str) -> DataFrame:
    return resolve.entities(table(spark, d, "entities"))


@query(f"WITH {_ENT} {_pick(f'''FROM tw t JOIN e c ON c.doc_id = t.doc_id AND c.entity_type = 'PERSON' AND len(c.w) < 4 AND {_AFFIX} WHERE t.entity_type = 'PERSON' ''')}")
def person_best(spark: SparkSession, d: str) -> DataFrame:
    return resolve.person_affix(_ents(spark, d))


@query(f"""WITH {_ENT} {_pick(f'''FROM tw t JOIN e c ON c.doc_id = t.doc_id AND c.entity_type = 'ORGANIZATION' AND {_AFFIX} WHERE t.entity_type = 'ORGANIZATION'
AND NOT EXISTS (SELECT 1 FROM e p WHERE p.doc_id = t.doc_id AND p.entity_type = 'LOCATION' AND contains(p.name, t.target))''', near=False)}""")
def org_affix(spark: SparkSession, d: str) -> DataFrame:
    return resolve.organisation_affix(_ents(spark, d))


_FIRST = r"""
raw AS (SELECT DISTINCT doc_id, ent_no, start_offset, regexp_extract(name, '^\S+') AS one FROM entities WHERE text IS NOT NULL AND name IS NOT NULL AND entity_type = 'ORGANIZATION'),
e AS (SELECT doc_id, ent_no, start_offset, one AS name, string_split(one, ' ') AS w, 'ORGANIZATION' AS entity_type FROM raw WHERE one <> '' UNION ALL SELECT doc_id, -1 - ent_no, start_offset + 1, left(one, 5), [left(one, 5)], 'ORGANIZATION' FROM raw WHERE length(one) > 5),
tw AS (SELECT *, name AS target FROM e)
"""


@query(f"""WITH {_FIRST} {_pick('''FROM tw t JOIN e c ON c.doc_id = t.doc_id AND length(c.name) > length(t.target) AND starts_with(lower(c.name), lower(t.target))''')}""")
def org_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Organisations by the first word of their names, and the first five letters of it, which are to be found again."""
    e = _ents(spark, d).filter("entity_type = 'ORGANIZATION'").select("doc_id", "ent_no", "start_offset", F.regexp_extract("name", r"^\S+", 0).alias("one"), "entity_type").filter("one <> ''").distinct()
    short = e.filter("length(one) > 5").select("doc_id", (-1 - F.col("ent_no")).alias("ent_no"), (F.col("start_offset") + 1).alias("start_offset"), F.substring("one", 1, 5).alias("one"), "entity_type")
    both = e.unionByName(short).withColumn("text", F.col("one")).withColumnRenamed("one", "name")
    return resolve.organisation_prefix(resolve.entities(both))


@query(r"""WITH """ + _ENT + r""", made AS (SELECT doc_id, ent_no, start_offset, name, w, array_to_string(list_transform(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}')), lambda x: x[1]), '') AS ini, list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}')) AS caps FROM e WHERE entity_type = 'ORGANIZATION'),
t AS (SELECT DISTINCT doc_id, -1 - ent_no AS ent_no, start_offset + 1 AS start_offset, ini AS target FROM made WHERE length(ini) > 1 UNION SELECT doc_id, ent_no, start_offset, target FROM e WHERE entity_type = 'ORGANIZATION' AND regexp_full_match(target, '\p{Lu}+')),
c AS (SELECT m.doc_id, m.ent_no, m.start_offset, t.ent_no AS for_no, t.start_offset AS t_off, array_to_string(m.w[i:], ' ') AS name FROM t JOIN made m ON m.doc_id = t.doc_id AND len(m.caps) >= length(t.target) AND right(m.ini, length(t.target)) = t.target,
    unnest(range(1, len(m.w) + 1)) AS u(i) WHERE m.w[i] = m.caps[len(m.caps) - length(t.target) + 1])
SELECT doc_id, for_no AS ent_no, arg_min(name, row(abs(start_offset - t_off), ent_no, name, start_offset)) AS best_name, arg_min(start_offset, row(abs(start_offset - t_off), ent_no, name, start_offset)) AS best_offset, 1.0::DOUBLE / count(DISTINCT name) AS candidate_count FROM c GROUP BY doc_id, for_no""")
def org_acronym(spark: SparkSession, d: str) -> DataFrame:
    """The organisations, and for each an acronym of its initials that is stored beside it like any other entity; the rule finds which is one."""
    e = _ents(spark, d).filter("entity_type = 'ORGANIZATION'")
    initials = F.array_join(F.transform(F.filter("name_words", lambda w: w.rlike(r"^\p{Lu}")), lambda w: F.substring(w, 1, 1)), "")
    short = e.select("doc_id", (-1 - F.col("ent_no")).alias("ent_no"), initials.alias("text"), (F.col("start_offset") + 1).alias("start_offset"), initials.alias("name"), "entity_type").filter("length(text) > 1").distinct()
    both = resolve.entities(e.select("doc_id", "ent_no", "text", "start_offset", "name", "entity_type").unionByName(short))
    return resolve.organisation_acronym(both)


@query(f"""WITH {_GAZ}, {_ENT} SELECT t.doc_id, t.ent_no, arg_min(c.name, row(abs(c.start_offset - t.start_offset), c.ent_no, c.name, c.start_offset)) AS container_name,
arg_min(c.start_offset, row(abs(c.start_offset - t.start_offset), c.ent_no, c.name, c.start_offset)) AS best_offset, 1.0::DOUBLE / count(DISTINCT c.name) AS candidate_count
FROM tw t JOIN holds h ON h.contained = lower(t.target) JOIN e c ON c.doc_id = t.doc_id AND c.entity_type = 'LOCATION' AND lower(c.name) = h.container AND c.name <> t.target AND c.name <> 'United States' WHERE t.entity_type = 'LOCATION' GROUP BY ALL""")
def loc_container(spark: SparkSession, d: str) -> DataFrame:
    return resolve.location_container(_ents(spark, d), _places(spark, d))


@query()
def loc_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Places in the raw texts, to each of which the documents' own 'place, container' forms are added."""
    said = table(spark, d, "best_mentions").filter("kind = 'Container'").groupBy("doc_id").agg(F.array_sort(F.collect_set("best_mention")).alias("said"))  # of one document
    docs = table(spark, d, "documents").select("ext_id", "text").join(said, F.col("ext_id") == F.col("doc_id"), "left")
    docs = docs.select("ext_id", F.concat_ws("\n", "text", F.array_join(F.transform("said", lambda x: F.concat(x, F.lit("."))), "\n")).alias("text"))
    return resolve.location_in_text(_ents(spark, d), docs, _places(spark, d))


@query(r"""WITH RECURSIVE """ + _ENT + r""", dx AS (SELECT ext_id AS doc_id, text, regexp_extract_all(text, '(?:\.|\s[a-z]+\s)[A-Z]\w+\s[A-Z]\w+(?:\.|\s[a-z]+\s)') AS hits FROM documents WHERE ext_id IN (SELECT doc_id FROM e)),
f AS (SELECT doc_id, text, hits, 0 AS i, 0 AS place, 0 AS stop FROM dx WHERE len(hits) > 0 UNION ALL SELECT doc_id, text, hits, i + 1, CAST(stop + instr(substr(text, stop + 1), hits[i + 1]) AS INT), CAST(stop + instr(substr(text, stop + 1), hits[i + 1]) - 1 + length(hits[i + 1]) AS INT) FROM f WHERE i < len(hits)),
c AS (SELECT doc_id, regexp_extract(hits[i], '^(?:\.|\s[a-z]+\s)([A-Z]\w+\s[A-Z]\w+)', 1) AS name, CAST(place - 1 + length(regexp_extract(hits[i], '^(?:\.|\s[a-z]+\s)')) AS INT) AS start_offset FROM f WHERE i > 0)
SELECT t.doc_id, t.ent_no, arg_min(c.name, row(abs(c.start_offset - t.start_offset), c.start_offset, c.name)) AS best_name, arg_min(c.start_offset, row(abs(c.start_offset - t.start_offset), c.start_offset, c.name)) AS best_offset,
    1.0::DOUBLE / count(DISTINCT c.name) AS candidate_count FROM tw t JOIN c ON c.doc_id = t.doc_id AND contains(c.name, t.target) WHERE t.entity_type = 'PERSON' GROUP BY t.doc_id, t.ent_no""")
def person_in_text(spark: SparkSession, d: str) -> DataFrame:
    return resolve.person_in_text(_ents(spark, d), table(spark, d, "documents"))


@query(f"""WITH {_GAZ}, {_ENT} SELECT t.doc_id, t.ent_no, c.name AS container, count(*) AS mentions
FROM tw t JOIN holds h ON h.contained = lower(t.target) JOIN e c ON c.doc_id = t.doc_id AND c.entity_type = 'LOCATION' AND lower(c.name) = h.container AND c.name <> t.target AND c.name <> 'United States' WHERE t.entity_type = 'LOCATION' GROUP BY ALL""")
def container_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.container_counts(_ents(spark, d), _places(spark, d))


_INNAME = r"""
b0 AS (SELECT DISTINCT doc_id, bem_index AS ent_no, target.text AS text, target.start_offset AS start_offset, target.name || CASE WHEN bem_index % 2 = 0 THEN ' , ' ELSE ' in ' END || container.name AS name FROM best_mentions WHERE kind = 'Container' AND target.name IS NOT NULL AND container.name IS NOT NULL AND target.text IS NOT NULL),
ln AS (SELECT *, regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g') AS target, string_split(regexp_replace(name, ' +$', ''), ' ') AS w FROM b0),
cuts AS (SELECT *, unnest(range(1, len(w) - 1)) AS cut FROM ln WHERE len(w) > 2),
heads AS (SELECT *, unnest(range(1, cut + 1)) AS s FROM cuts WHERE w[cut + 1] IN (',', 'in')),
c0 AS (SELECT doc_id, ent_no, start_offset, array_to_string(w[s:cut], ' ') AS head, array_to_string(w[cut + 2:], ' ') AS tail FROM heads),
c1 AS (SELECT *, head || ', ' || tail AS best FROM c0 WHERE len(string_split(head || ', ' || tail, ' ')) < 7 AND len(string_split(head || ', ' || tail, ',')) = 2),
c2 AS (SELECT c1.*, coalesce(x.is_city * y.is_city, 0) + coalesce(x.is_province * y.is_province, 0) + coalesce(x.is_country * y.is_country, 0) AS sim FROM c1 LEFT JOIN gn x ON x.lname = lower(trim(tail)) LEFT JOIN gn y ON y.lname = lower(trim(head))),
c3 AS (SELECT * FROM c2 WHERE sim = 0 OR EXISTS (SELECT 1 FROM holds h WHERE h.container = lower(trim(tail)) AND h.contained = lower(trim(head))))
"""


@query(f"""WITH {_GAZ}, {_INNAME}, hit AS (SELECT t.doc_id, t.ent_no, arg_min(c.best, row(abs(c.start_offset - t.start_offset), c.ent_no, c.best, c.start_offset)) AS best, arg_min(c.start_offset, row(abs(c.start_offset - t.start_offset), c.ent_no, c.best, c.start_offset)) AS best_offset,
    1.0::DOUBLE / count(DISTINCT c.best) AS candidate_count FROM ln t JOIN c3 c ON c.doc_id = t.doc_id AND lower(c.head) = lower(t.target) GROUP BY t.doc_id, t.ent_no),
cased AS (SELECT *, {_CASED.format('best')} AS cb FROM hit), pre AS (SELECT *, trim(string_split(cb, ',')[1]) AS city, lower(trim(string_split(cb, ',')[2])) AS prefix FROM cased)
SELECT doc_id, ent_no, coalesce((SELECT city || ', ' || {_CASED.format("min(h.container)")} FROM holds h JOIN gn ON gn.lname = h.container AND gn.is_province = 1 WHERE h.contained = lower(city) AND length(prefix) > 2 AND starts_with(h.container, prefix) HAVING count(*) > 0), cb) AS best_name, best_offset, candidate_count FROM pre""")
def loc_in_name(spark: SparkSession, d: str) -> DataFrame:
    """Places by names that hold their container, 'X , Y' or 'X in Y', made of the containers of the best mentions."""
    b = table(spark, d, "best_mentions").filter("kind = 'Container'")
    sep = F.when(F.col("bem_index") % 2 == 0, " , ").otherwise(" in ")
    made = b.select("doc_id", F.col("bem_index").alias("ent_no"), "target.text", "target.start_offset", F.concat("target.name", sep, "container.name").alias("name"), F.lit("LOCATION").alias("entity_type"))
    return resolve.location_in_name(resolve.entities(made), _places(spark, d))


@query()
def resolved_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with its best mention, by all rules."""
    return resolve.resolve(table(spark, d, "entities"), table(spark, d, "documents"), _places(spark, d))


@query("SELECT doc_id, bem_index, kind, best_mention FROM best_mentions WHERE kind <> 'Identity' AND best_mention <> target.text")
def non_trivial(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "best_mentions").withColumn("text", F.col("target.text"))
    return resolve.non_trivial(b).select("doc_id", "bem_index", "kind", "best_mention")


_RUNS = r"""
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent_num FROM documents),
tk AS (SELECT doc_id, sent_num, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS tok_no FROM ln),
tg AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, sent_num ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM tk),
nr AS (SELECT *, CASE WHEN NOT regexp_full_match(text, '[A-Z][a-z]+') THEN 'O' WHEN regexp_matches(text, '[aeiou]$') THEN 'ORGANIZATION' WHEN regexp_matches(text, '[nd]$') THEN 'LOCATION' ELSE 'PERSON' END AS ner FROM tg),
lg AS (SELECT *, lag(ner) OVER (PARTITION BY doc_id, sent_num ORDER BY tok_no) AS before FROM nr), pn AS (SELECT *, sum(CAST(before IS DISTINCT FROM ner AS INT)) OVER (PARTITION BY doc_id, sent_num ORDER BY tok_no) AS island FROM lg)
SELECT doc_id, CAST(sent_num AS INT) AS sent_num, string_agg(text, ' ' ORDER BY tok_no) AS name, CAST(min(b) AS INT) AS start_offset, CAST(max(b + length(text)) AS INT) AS "end", ner AS entity_type FROM pn WHERE ner <> 'O' GROUP BY doc_id, sent_num, island, ner
"""


@query(f"WITH {_RUNS}")
def entity_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words of one tag, by a rule that stands in for an entity tagger; offsets in the line."""
    from ..functions.annotators import capitalised_tokens

    return resolve.entity_runs(capitalised_tokens(table(spark, d, "documents"), "doc_id", "text"))


# ---- coreference and links ---------------------------------------------------------------------------------------------------

_PRON = ", ".join(_q(p) for p in PRONOUNS)
_PERS = ", ".join(_q(p) for p in PERSONAL)
_S1 = "s1 AS (SELECT doc_id, sent_num, f.a AS a, f.x AS text, f.a + length(f.x) AS b FROM (SELECT doc_id, sent_num, min(struct_pack(a := start_offset, x := text)) AS f FROM sentences WHERE text IS NOT NULL AND start_offset IS NOT NULL GROUP BY ALL))"
_MEN = f"""{_S1}, en0 AS (SELECT DISTINCT doc_id, name, start_offset, text FROM entities WHERE name IS NOT NULL AND text IS NOT NULL AND start_offset IS NOT NULL),
nm AS (SELECT doc_id, start_offset, text, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY name) - 1 AS INT) AS cluster_id FROM en0),
wd AS (SELECT doc_id, unnest(list_transform(string_split(text, ' '), lambda w, i: struct_pack(w := w, o := a + CAST(coalesce(list_sum(list_transform(string_split(text, ' ')[:i - 1], lambda p: length(p) + 1)), 0) AS INT)))) AS t FROM s1),
pr AS (SELECT DISTINCT doc_id, t.o AS start_offset, t.w AS text FROM wd WHERE lower(t.w) IN ({_PRON})),
pw AS (SELECT pr.*, (SELECT arg_max(nm.cluster_id, row(nm.start_offset, -nm.cluster_id)) FROM nm WHERE nm.doc_id = pr.doc_id AND nm.start_offset < pr.start_offset) AS cluster_id FROM pr),
m AS (SELECT DISTINCT doc_id, cluster_id, start_offset, text FROM nm UNION ALL SELECT doc_id, cluster_id, start_offset, text FROM pw WHERE cluster_id IS NOT NULL)"""


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by a rule that stands in for a coreference resolver: mentions of one name, and the pronouns after them."""
    from ..functions.annotators import name_clusters

    return name_clusters(table(spark, d, "entities"), _sents(spark, d))


@query(f"WITH {_MEN} SELECT doc_id, start_offset, text, max(cluster_id) AS cluster_id FROM m GROUP BY ALL")
def mention_cluster(spark: SparkSession, d: str) -> DataFrame:
    return coref.cluster_of(_mentions(spark, d))


_LT = "CASE " + " ".join(f"WHEN len(list_filter(coalesce(types, []), lambda t: regexp_matches(t, '{p}'))) > 0 THEN '{n}'" for n, p in LINK_TYPES.items()) + " ELSE 'OTHER' END"
_BL = """bl AS (SELECT * EXCLUDE (r) FROM (SELECT doc_id, start_offset, text, score, id, name, doc_sim_score, candidate_score, inlinks, types, row_number() OVER (PARTITION BY doc_id, start_offset, text ORDER BY score DESC, id, name NULLS FIRST, doc_sim_score NULLS FIRST, candidate_score NULLS FIRST, inlinks NULLS FIRST) AS r
FROM links WHERE id IS NOT NULL AND start_offset IS NOT NULL AND score IS NOT NULL) WHERE r = 1 AND score >= 5.0)"""
_CL = f"""cl AS (SELECT m.doc_id, m.cluster_id, id, arg_min(name, row(l.start_offset, name, {_LT})) AS name, arg_min({_LT}, row(l.start_offset, name, {_LT})) AS entity_type
FROM (SELECT DISTINCT doc_id, cluster_id, start_offset FROM m) m JOIN bl l ON l.doc_id = m.doc_id AND l.start_offset = m.start_offset GROUP BY ALL)"""


@query(f"WITH {_BL} SELECT doc_id, start_offset, text, id, name, score FROM bl")
def best_links(spark: SparkSession, d: str) -> DataFrame:
    return _best_links(spark, d).select("doc_id", "start_offset", "text", "id", "name", "score")


def _best_links(spark: SparkSession, d: str) -> DataFrame:
    return coref.best_links(table(spark, d, "links"))


@query(f"WITH {_MEN}, {_BL}, {_CL} SELECT * FROM cl")
def cluster_links(spark: SparkSession, d: str) -> DataFrame:
    return coref.links_of(_mentions(spark, d), _best_links(spark, d))


_CB = """b AS (SELECT DISTINCT doc_id, target.start_offset AS start_offset, best_mention, kind, target.entity_type AS entity_type, candidate_count FROM best_mentions WHERE cluster_id IS NULL),
cb AS (SELECT m.doc_id, m.cluster_id, best_mention, arg_min(struct_pack(k := kind, t := b.entity_type, n := candidate_count), row(b.start_offset, kind, b.entity_type, candidate_count)) AS f
FROM (SELECT DISTINCT doc_id, cluster_id, start_offset FROM m) m JOIN b ON b.doc_id = m.doc_id AND b.start_offset = m.start_offset GROUP BY ALL)"""


def _rule_mentions(spark: SparkSession, d: str) -> DataFrame:
    """What the rules found, before coreference."""
    return table(spark, d, "best_mentions").filter("cluster_id is null").select("doc_id", "target.start_offset", "best_mention", "kind", "target.entity_type", "candidate_count").distinct()


@query(f"WITH {_MEN}, {_CB} SELECT doc_id, cluster_id, best_mention, f.k AS kind, f.t AS entity_type, f.n AS candidate_count FROM cb")
def cluster_best(spark: SparkSession, d: str) -> DataFrame:
    return coref.best_of(_mentions(spark, d), _rule_mentions(spark, d))


@query(f"""WITH {_MEN}, {_BL}, {_CL}, {_CB}, one AS (SELECT doc_id, cluster_id, any_value(name) AS best_mention, any_value(entity_type) AS entity_type FROM cl GROUP BY ALL HAVING count(*) = 1),
ob AS (SELECT doc_id, cluster_id, any_value(best_mention) AS best_mention, any_value(f) AS f FROM cb GROUP BY doc_id, cluster_id HAVING count(*) = 1),
says AS (SELECT doc_id, cluster_id, 'LinkResolved' AS kind, best_mention, entity_type, 1.0::DOUBLE AS candidate_count FROM one
    UNION ALL SELECT doc_id, cluster_id, CASE WHEN f.k IN ('Full', 'CorefIdentity', 'CorefFull', 'LinkResolved') THEN 'CorefFull' WHEN f.k = 'Identity' THEN 'CorefIdentity' ELSE 'Coref' END, best_mention, f.t, CASE WHEN f.k = 'Identity' THEN 1.0 ELSE f.n END FROM ob ANTI JOIN one USING (doc_id, cluster_id))
SELECT m.doc_id, m.start_offset, m.text, m.cluster_id, kind, best_mention, candidate_count FROM m JOIN says USING (doc_id, cluster_id)
WHERE lower(m.text) IN ({_PRON}) AND (lower(m.text) IN ({_PERS})) = (entity_type = 'PERSON')""")
def coref_expand(spark: SparkSession, d: str) -> DataFrame:
    """The pronouns of the clusters with what their cluster is known as: its one link, else its one best mention."""
    return coref.expand(_mentions(spark, d), _best_links(spark, d), _rule_mentions(spark, d))


@query(f"WITH {_BL} SELECT DISTINCT doc_id, text, start_offset, name, {_LT} AS entity_type FROM bl")
def link_entities(spark: SparkSession, d: str) -> DataFrame:
    return coref.link_entities(_best_links(spark, d)).distinct()


@query(f"SELECT DISTINCT id, types, {_LT} AS entity_type FROM links WHERE id IS NOT NULL")
def link_type_guess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").filter("id is not null").select("id", "types", link_entity_type(F.col("types")).alias("entity_type")).distinct()


@query("""WITH o AS (SELECT DISTINCT doc_id, start_offset, text, id FROM links WHERE score >= 5.0), n AS (SELECT DISTINCT doc_id, start_offset, text, id FROM links WHERE candidate_score >= -10.0)
SELECT o.*, 'BASELINE' AS system FROM o ANTI JOIN n USING (doc_id, start_offset, text, id) UNION ALL SELECT n.*, 'NEW' FROM n ANTI JOIN o USING (doc_id, start_offset, text, id)""")
def link_diff(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "links")
    return coref.link_diff(coref.usable_links(l), l.filter("candidate_score >= -10.0"))


@query("""SELECT 'BASELINE' AS system, doc_id, start_offset, id, score FROM links WHERE score >= 5.0 UNION ALL SELECT 'RULES', doc_id, start_offset, id, score FROM links WHERE doc_sim_score >= 30 UNION ALL SELECT 'COREF', doc_id, start_offset, id, score FROM links WHERE inlinks >= 10""")
def tagged_links(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "links").select("doc_id", "start_offset", "id", "score", "doc_sim_score", "inlinks")
    parts = {"BASELINE": l.filter("score >= 5.0"), "RULES": l.filter("doc_sim_score >= 30"), "COREF": l.filter("inlinks >= 10")}
    return coref.tagged_union(parts).select("system", "doc_id", "start_offset", "id", "score")


@query("""WITH a AS (SELECT doc_id, bem_index, best_mention AS old FROM best_mentions), b AS (SELECT doc_id, bem_index, target.name AS new FROM best_mentions) SELECT a.doc_id, a.bem_index, old, new FROM a JOIN b USING (doc_id, bem_index) WHERE old IS DISTINCT FROM new""")
def changed_mentions(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reports import changed

    b = table(spark, d, "best_mentions")
    return changed(b.select("doc_id", "bem_index", F.col("best_mention").alias("old")), b.select("doc_id", "bem_index", F.col("target.name").alias("new")), ["doc_id", "bem_index"])


# ---- evaluation --------------------------------------------------------------------------------------------------------------

_LAB = """lab AS (SELECT l.doc_id, l.start_offset, l.id, max(l.score) AS score, CAST(max(CASE WHEN l.name = e.name THEN 1 ELSE 0 END) AS INT) AS label
FROM links l JOIN (SELECT DISTINCT doc_id, start_offset, name FROM entities WHERE name IS NOT NULL) e ON e.doc_id = l.doc_id AND e.start_offset = l.start_offset WHERE l.id IS NOT NULL AND l.score IS NOT NULL GROUP BY ALL)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").filter("name is not null").select("doc_id", "start_offset", F.col("name").alias("true_name")).distinct()
    l = table(spark, d, "links").filter("id is not null and score is not null")
    return l.join(e, ["doc_id", "start_offset"]).groupBy("doc_id", "start_offset", "id").agg(F.max("score").alias("score"), F.max(F.when(F.col("name") == F.col("true_name"), 1).otherwise(0)).alias("label"))


@query(f"WITH {_LAB} SELECT * FROM lab")
def labelled_join(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d)


@query(f"""WITH {_LAB}, r AS (SELECT *, row_number() OVER w AS rank, CAST(sum(label) OVER w AS DOUBLE) / row_number() OVER w AS p FROM lab WINDOW w AS (ORDER BY score DESC, doc_id, start_offset, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, start_offset, id, label, rank, round(p, 9) AS "precision", round(max(p) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS smoothed FROM r""")
def precision_curve(spark: SparkSession, d: str) -> DataFrame:
    c = evaluate.precision_curve(_labelled(spark, d), "label", "score", ["doc_id", "start_offset", "id"])
    return c.select("doc_id", "start_offset", "id", "label", F.col("rank").cast("long"), F.round("precision", 9).alias("precision"), F.round("smoothed", 9).alias("smoothed"))


_CURVE = """r AS (SELECT *, row_number() OVER w AS rank, CAST(sum(label) OVER w AS DOUBLE) / row_number() OVER w AS p FROM lab WINDOW w AS (ORDER BY score DESC, doc_id, start_offset, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT *, max(p) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS smoothed FROM r)"""


def _two(x: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 9)), {digits}) AS VARCHAR)"


@query(f"WITH {_LAB}, {_CURVE} SELECT rank, {_two('smoothed', 3)} AS line FROM curve")
def precision_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the precision file, by rank."""
    c = materialise(evaluate.precision_curve(_labelled(spark, d), "label", "score", ["doc_id", "start_offset", "id"]))
    return reports.precision_lines(c).select(F.col("rank").cast("long").alias("rank"), "line")


@query(f"WITH {_LAB}, {_CURVE} SELECT doc_id, start_offset, id, label, rank, row_number() OVER (ORDER BY label DESC, rank) AS place FROM curve")
def display_order(spark: SparkSession, d: str) -> DataFrame:
    c = materialise(evaluate.precision_curve(_labelled(spark, d), "label", "score", ["doc_id", "start_offset", "id"]))
    return reports.display_order(c, "label").select("doc_id", "start_offset", "id", "label", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


_SQUASHED = "regexp_replace({0}, '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g')"
_NT = f"""bt AS (SELECT *, {_SQUASHED.format('target.text')} AS tt FROM best_mentions),
nt AS (SELECT doc_id, bem_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bem_index) - 1 AS INT) AS position FROM bt WHERE kind <> 'Identity' AND best_mention <> tt)"""


@query(f"WITH {_NT} SELECT * FROM nt")
def bem_positions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.positions(table(spark, d, "best_mentions"))


@query(f"WITH {_NT}, lb AS (SELECT doc_id, bem_index, CAST(best_mention = target.name AS INT) AS label FROM best_mentions WHERE (best_mention = target.name) IS NOT NULL) SELECT lb.doc_id, position, label, best_mention, kind FROM lb JOIN nt ON nt.doc_id = lb.doc_id AND nt.position = lb.bem_index JOIN best_mentions b ON b.doc_id = nt.doc_id AND b.bem_index = nt.bem_index")
def labelled_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The labelled lines with the best mention at the position each names."""
    return evaluate.labelled_mentions(labels_read(spark, d), table(spark, d, "best_mentions")).select("doc_id", "position", "label", "best_mention", "kind")


@query("SELECT doc_id, bem_index, CAST(CASE WHEN kind IN ('Full', 'CorefIdentity', 'CorefFull', 'LinkResolved') AND best IS NOT NULL THEN abs(target.start_offset - best.start_offset) ELSE -1 END AS INT) AS proximity FROM best_mentions")
def char_proximity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.char_proximity(table(spark, d, "best_mentions"))


@query(f"WITH {_BL} SELECT doc_id, start_offset, '(' || name || ',' || id || ',' || CAST(score AS VARCHAR) || ')' AS shown FROM bl UNION ALL SELECT doc_id, target.start_offset, '(' || CAST(target.start_offset AS VARCHAR) || ') ' || target.text || ' -> ' || best_mention FROM best_mentions")
def debug_strings(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import link_debug, mention_debug

    l = _best_links(spark, d).select("doc_id", "start_offset", link_debug(F.col("name"), F.col("id"), F.col("score")).alias("shown"))
    b = table(spark, d, "best_mentions").select("doc_id", "target.start_offset", mention_debug(F.col("target.start_offset"), F.col("target.text"), F.col("best_mention")).alias("shown"))
    return l.unionByName(b)


_FULL = "('Full', 'CorefIdentity', 'CorefFull', 'LinkResolved')"
_AGREE = f"""ow AS (SELECT doc_id, start_offset, text, max(cluster_id) AS c FROM m GROUP BY ALL),
fb AS (SELECT * FROM bt WHERE kind IN {_FULL} AND best IS NOT NULL),
tc AS (SELECT DISTINCT fb.doc_id, bem_index, c FROM fb JOIN ow ON ow.doc_id = fb.doc_id AND ow.start_offset >= fb.target.start_offset AND ow.start_offset + length(ow.text) <= fb.target.start_offset + length(fb.tt)),
bc AS (SELECT DISTINCT fb.doc_id, bem_index, c FROM fb JOIN ow ON ow.doc_id = fb.doc_id AND ow.start_offset >= fb.best.start_offset AND ow.start_offset + length(ow.text) <= fb.best.start_offset + length(fb.best.text)),
ag AS (SELECT bc.doc_id, bc.bem_index, CASE WHEN count(tc.c) > 0 THEN 1.0 ELSE -1.0 END AS agrees FROM bc LEFT JOIN tc ON tc.doc_id = bc.doc_id AND tc.bem_index = bc.bem_index AND tc.c = bc.c GROUP BY ALL)"""
_BOX = "kind IN ('Container', 'Containment')"
_FEATS = f"""fx AS (SELECT b.*, lower(b.tt) AS t, lower({_SQUASHED.format('b.container.text')}) AS k, coalesce(ag.agrees, 0.0) AS agrees FROM bt b LEFT JOIN ag USING (doc_id, bem_index)),
fn AS (SELECT fx.*, x.is_city AS xc, x.is_province AS xp, x.is_country AS xn, y.is_city AS yc, y.is_province AS yp, y.is_country AS yn, pc.places FROM fx LEFT JOIN gn x ON x.lname = t LEFT JOIN gn y ON y.lname = k LEFT JOIN (SELECT lower(name) AS lname, count(*) AS places FROM g GROUP BY ALL) pc ON pc.lname = t),
ft AS (SELECT doc_id, bem_index, CAST(candidate_count AS DOUBLE) AS "Ambiguous Candidate Count", CAST(agrees AS DOUBLE) AS "Coref Cluster Agrees", CAST(coalesce({_BOX} AND xc = 1 AND yn = 1, false) AS DOUBLE) AS "Country Contains City", CAST(CASE WHEN {_BOX} THEN coalesce(places, 0) ELSE 0 END AS DOUBLE) AS "Location Ambiguity Count",
    CAST(coalesce({_BOX} AND xc = 1 AND yp = 1, false) AS DOUBLE) AS "StateOrProvince contains City", CAST(CASE WHEN {_BOX} THEN coalesce(xc * yc, 0) + coalesce(xp * yp, 0) + coalesce(xn * yn, 0) ELSE 0 END AS DOUBLE) AS "Target and Best location type similarity",
    CAST(kind IN ('Coref', 'CorefIdentity', 'CorefFull', 'LinkResolved') AS DOUBLE) AS "is Coref BestMention", CAST(kind = 'CorefIdentity' AS DOUBLE) AS "is Coref+Identity BestMention", CAST(kind = 'LinkResolved' AS DOUBLE) AS "is Linked BestMention",
    CAST(coalesce(target.entity_type = 'LOCATION', false) AS DOUBLE) AS "is a Location rule", CAST(coalesce(target.entity_type = 'ORGANIZATION', false) AS DOUBLE) AS "is a Organization rule", CAST(coalesce(target.entity_type = 'OTHER', false) AS DOUBLE) AS "is a Other rule", CAST(coalesce(target.entity_type = 'PERSON', false) AS DOUBLE) AS "is a Person rule" FROM fn)"""


@query(f"WITH {_GAZ}, {_NT}, {_MEN}, {_AGREE}, {_FEATS} SELECT * FROM ft")
def features(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.features(table(spark, d, "best_mentions"), _places(spark, d), _mentions(spark, d))


@query()
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each half of the documents is scored by what the other half trains; the label is whether the best mention is the name itself.
    Rows whose label is not known are scored but train nothing."""
    b = table(spark, d, "best_mentions").withColumn("label", (F.col("best_mention") == F.col("target.name")).cast("double"))
    x = evaluate.features(b, _places(spark, d), _mentions(spark, d)).join(b.select("doc_id", "bem_index", "label"), ["doc_id", "bem_index"])
    x = materialise(x.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2))))
    parts = [evaluate.classify(x.filter((F.col("half") != h) & F.col("label").isNotNull()), x.filter(F.col("half") == h)) for h in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "bem_index", "label", "confidence")


@query("""SELECT doc_id, target.start_offset AS start_offset, translate(target.text, chr(9) || chr(10), '  ') AS target, translate(best_mention, chr(9) || chr(10), '  ') AS best_mention, kind FROM best_mentions""")
def mention_report(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "best_mentions")
    return b.select("doc_id", "target.start_offset", tsv_clean(F.col("target.text")).alias("target"), tsv_clean(F.col("best_mention")).alias("best_mention"), "kind")


# ---- the three systems -------------------------------------------------------------------------------------------------------

def _sents(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, one for each number; of several the first by place and text."""
    s = table(spark, d, "sentences").filter("text is not null and start_offset is not null").groupBy("doc_id", "sent_num").agg(F.min(F.struct("start_offset", "text")).alias("s"))
    return s.select("doc_id", "sent_num", F.col("s.start_offset").alias("start_offset"), F.col("s.text").alias("text"), F.col("s.start_offset").alias("start"), (F.col("s.start_offset") + F.length("s.text")).alias("end"))


_TRIPLES = f"""{_S1}, en AS (SELECT doc_id, ent_no, min(struct_pack(a := start_offset, x := text)) AS f FROM entities WHERE text IS NOT NULL GROUP BY ALL),
es AS (SELECT en.doc_id, en.ent_no, en.f.a AS a, en.f.x AS x, min(s1.sent_num) AS sent_num FROM en JOIN s1 ON s1.doc_id = en.doc_id AND en.f.a >= s1.a AND en.f.a + length(en.f.x) <= s1.b GROUP BY ALL),
eo AS (SELECT *, row_number() OVER w AS n, lead(a) OVER w AS na, lead(x) OVER w AS nx FROM es WINDOW w AS (PARTITION BY doc_id, sent_num ORDER BY a, ent_no)),
tr AS (SELECT doc_id, sent_num, 0 AS source, n - 1 AS no, 0 AS arg2_no, x AS arg1, a AS arg1_offset, 'of' AS rel, a + length(x) AS rel_offset, nx AS arg2, na AS arg2_offset, 0.5::DOUBLE AS confidence FROM eo WHERE na - (a + length(x)) BETWEEN 0 AND 11
    UNION ALL SELECT f.doc_id, f.sent_num, 1, 0, o.n - 2, f.x, f.a, 'with', f.a + length(f.x), o.x, o.a, 0.9 FROM eo f JOIN eo o ON o.doc_id = f.doc_id AND o.sent_num = f.sent_num AND f.n = 1 AND o.n > 1),
ex AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, sent_num ORDER BY source, no, arg2_no) - 1 AS INT) AS ext_no FROM tr)"""


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    """Triples by rule: tagged entities close to each other as noun relations, the first of a sentence with all others as one n-ary relation."""
    from ..functions.annotators import extractions, noun_relations

    e = table(spark, d, "entities").filter("text is not null").groupBy("doc_id", "ent_no").agg(F.min(F.struct("start_offset", "text")).alias("f")).select("doc_id", F.col("ent_no").alias("inner_id"), F.col("f.start_offset").alias("start"), (F.col("f.start_offset") + F.length("f.text")).alias("end"), F.col("f.text").alias("text"))
    o = e.join(spans.sentence_of(e.select("doc_id", "inner_id", "start", "end"), _sents(spark, d)), ["doc_id", "inner_id"])
    w = Window.partitionBy("doc_id", "sent_num").orderBy("start", "inner_id")
    o = o.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead(F.struct("text", F.col("start").alias("start_offset"))).over(w))
    one = lambda text, at: F.array(F.struct(text.alias("text"), at.cast("int").alias("start_offset")))
    gap = F.col("next.start_offset") - F.col("end")
    nouns = noun_relations(o.filter((gap >= 0) & (gap <= 11)).select("doc_id", "sent_num", (F.col("n") - 1).alias("no"), one(F.col("text"), F.col("start")).alias("arg1"), one(F.lit("of"), F.col("end")).alias("rel"), F.array("next").alias("arg2"), F.lit(0.5).alias("confidence")))
    all_ = F.array_sort(F.collect_list(F.struct("n", "text", F.col("start").alias("start_offset"), "end")))  # the entities of one sentence
    per = o.groupBy("doc_id", "sent_num").agg(all_.alias("a")).filter(F.size("a") > 1)
    first = F.element_at("a", 1)
    rest = F.transform(F.slice("a", F.lit(2), F.size("a") - 1), lambda x: F.struct(x["text"].alias("text"), x["start_offset"].alias("start_offset")))
    verbs = per.select("doc_id", "sent_num", F.lit(0).alias("no"), F.struct(first["text"].alias("text"), first["start_offset"].alias("start_offset")).alias("arg1"), F.struct(F.lit("with").alias("text"), first["end"].alias("start_offset")).alias("rel"), rest.alias("arg2s"), F.lit(0.9).alias("confidence"))
    return extractions(nouns, verbs)


@query(f"WITH {_TRIPLES} SELECT doc_id, sent_num, ext_no, source, arg1, arg1_offset, rel, arg2, arg2_offset, confidence FROM ex")
def extraction_union(spark: SparkSession, d: str) -> DataFrame:
    """Noun relations and n-ary relations as triples, one list for each sentence."""
    return _extractions(spark, d).select("doc_id", "sent_num", "ext_no", "source", F.col("arg1.text").alias("arg1"), F.col("arg1.start_offset").alias("arg1_offset"), F.col("rel.text").alias("rel"), F.col("arg2.text").alias("arg2"), F.col("arg2.start_offset").alias("arg2_offset"), "confidence")


_ARGS = """a0 AS (SELECT doc_id, sent_num, x AS text, o AS start_offset, min(ext_no * 2 + i) AS r FROM (SELECT doc_id, sent_num, ext_no, 0 AS i, arg1 AS x, arg1_offset AS o FROM ex UNION ALL SELECT doc_id, sent_num, ext_no, 1, arg2, arg2_offset FROM ex) GROUP BY doc_id, sent_num, x, o),
ar AS (SELECT doc_id, sent_num, CAST(row_number() OVER (PARTITION BY doc_id, sent_num ORDER BY r) - 1 AS INT) AS arg_no, text, start_offset FROM a0)"""


@query(f"WITH {_TRIPLES}, {_ARGS} SELECT * FROM ar")
def distinct_arguments(spark: SparkSession, d: str) -> DataFrame:
    return linking.distinct_arguments(_extractions(spark, d))


_LOOSE = ", ".join(f"'{w}'" for w in [*DETERMINERS, *PREPOSITIONS, "to"])


@query(f"""WITH {_S1}, t AS (SELECT doc_id, sent_num, a, list_transform(string_split(text, ' '), lambda w, i: struct_pack(w := w, o := a + CAST(coalesce(list_sum(list_transform(string_split(text, ' ')[:i - 1], lambda p: length(p) + 1)), 0) AS INT))) AS l FROM s1),
u AS (SELECT doc_id, sent_num, list_filter(l, lambda x: x.w <> '') AS l FROM t), v AS (SELECT doc_id, sent_num, CASE WHEN len(l) > 0 AND lower(l[1].w) IN ({_LOOSE}) THEN l[2:] ELSE l END AS l FROM u),
x AS (SELECT doc_id, sent_num, CASE WHEN len(l) > 0 AND lower(l[-1].w) IN ({_LOOSE}) THEN l[:len(l) - 1] ELSE l END AS l FROM v)
SELECT doc_id, sent_num, coalesce(array_to_string(list_transform(l, lambda y: y.w), ' '), '') AS clean, l[1].o AS clean_offset FROM x""")
def argument_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence taken for an argument, without a determiner or preposition at either end."""
    from ..functions.annotators import word_tokens

    a = _sents(spark, d).withColumn("tokens", word_tokens(F.col("text"), F.col("start_offset")))
    return linking.cleaned_arguments(a).select("doc_id", "sent_num", "clean", "clean_offset")


def _tables(spark: SparkSession, d: str) -> pipelines.Tables:
    from ..functions.annotators import word_tokens

    e = table(spark, d, "entities").filter("text is not null").distinct()
    # arguments: the tagged entities with the word before them, as an extractor would take an article or a preposition along
    args = e.groupBy("doc_id", F.col("ent_no").alias("arg_id")).agg(F.min(F.struct("start_offset", "text")).alias("f")).select("doc_id", "arg_id", F.col("f.text").alias("text"), F.col("f.start_offset").alias("start_offset"))
    args = args.withColumn("tokens", word_tokens(F.concat(F.lit("the "), "text"), F.col("start_offset") - 4))
    prior = table(spark, d, "links").filter("id is not null").groupBy("id").agg(F.max("score").alias("prior"))
    kb = table(spark, d, "kb_entities").select("id", "name", "typ").join(prior, "id", "left").withColumn("prior", F.coalesce("prior", F.lit(6.0)))
    return pipelines.Tables(args, e, _mentions(spark, d), table(spark, d, "documents"), _places(spark, d), kb, _sents(spark, d))


@query("""WITH p AS (SELECT id, max(score) AS prior FROM links WHERE id IS NOT NULL GROUP BY id), k AS (SELECT k.id, k.name, lower(trim(k.name)) AS key, coalesce(p.prior, 6.0) AS score FROM kb_entities k LEFT JOIN p USING (id)),
a AS (SELECT doc_id, ent_no AS arg_id, min(struct_pack(o := start_offset, x := text)) AS f FROM entities WHERE text IS NOT NULL GROUP BY ALL),
b AS (SELECT a.doc_id, a.arg_id, a.f.o AS start_offset, a.f.x AS text, k.id, k.score, row_number() OVER (PARTITION BY a.doc_id, a.arg_id ORDER BY k.score DESC, k.id) AS r FROM a JOIN k ON k.key = lower(trim(array_to_string(list_filter(string_split(a.f.x, ' '), lambda w: w <> ''), ' '))))
SELECT doc_id, arg_id, start_offset, text, id, score FROM b WHERE r = 1 AND score >= 5.0""")
def baseline_links(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.baseline(_tables(spark, d)).select("doc_id", "arg_id", "start_offset", "text", "id", "score")


@query()
def three_systems(spark: SparkSession, d: str) -> DataFrame:
    """The links of the baseline, the rules and the coreference system."""
    return pipelines.compare(_tables(spark, d))


_CTX = f"""a AS (SELECT DISTINCT doc_id, start_offset, text, CAST(start_offset AS VARCHAR) || ':' || text AS arg_id FROM bl),
aw AS (SELECT a.*, (SELECT min(s1.sent_num) FROM s1 WHERE s1.doc_id = a.doc_id AND a.start_offset >= s1.a AND a.start_offset + length(a.text) <= s1.b) AS sent_num FROM a),
cow AS (SELECT doc_id, start_offset, text, max(cluster_id) AS c FROM m GROUP BY ALL),
ac AS (SELECT DISTINCT a.doc_id, a.arg_id, cow.c AS cluster_id FROM a JOIN cow ON cow.doc_id = a.doc_id AND cow.start_offset >= a.start_offset AND cow.start_offset + length(cow.text) <= a.start_offset + length(a.text)),
mw AS (SELECT m.*, (SELECT min(s1.sent_num) FROM s1 WHERE s1.doc_id = m.doc_id AND m.start_offset >= s1.a AND m.start_offset + length(m.text) <= s1.b) AS sent_num FROM m),
ms AS (SELECT mw.*, s1.text AS said FROM mw LEFT JOIN s1 ON s1.doc_id = mw.doc_id AND s1.sent_num = mw.sent_num),
pm AS (SELECT ac.doc_id, ac.arg_id, ms.cluster_id, '[' || string_agg('(' || CAST(ms.start_offset AS VARCHAR) || ') ' || ms.text, ', ' ORDER BY ms.start_offset, ms.text) || ']' AS shown FROM ac JOIN ms ON ms.doc_id = ac.doc_id AND ms.cluster_id = ac.cluster_id GROUP BY ALL),
pc AS (SELECT doc_id, arg_id, string_agg(shown, ' ' ORDER BY cluster_id) AS cluster_mentions FROM pm GROUP BY ALL),
pe AS (SELECT ac.doc_id, ac.arg_id, list(said ORDER BY ms.cluster_id, ms.start_offset, ms.text) FILTER (said IS NOT NULL) AS ext FROM ac JOIN ms ON ms.doc_id = ac.doc_id AND ms.cluster_id = ac.cluster_id GROUP BY ALL),
cx AS (SELECT aw.doc_id, aw.arg_id, aw.start_offset, aw.text, aw.sent_num, list_concat(CASE WHEN s1.text IS NULL THEN [] ELSE [s1.text] END, coalesce(pe.ext, [])) AS l, len(coalesce(pe.ext, [])) + 1 AS size, coalesce(pc.cluster_mentions, '') AS cluster_mentions
    FROM aw LEFT JOIN s1 ON s1.doc_id = aw.doc_id AND s1.sent_num = aw.sent_num LEFT JOIN pe ON pe.doc_id = aw.doc_id AND pe.arg_id = aw.arg_id LEFT JOIN pc ON pc.doc_id = aw.doc_id AND pc.arg_id = aw.arg_id),
ctx AS (SELECT doc_id, arg_id, start_offset, text, sent_num, list_filter(l, lambda x, i: list_position(l, x) = i) AS full_text, CAST(size AS INT) AS size, cluster_mentions FROM cx)"""


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    a = _best_links(spark, d).select("doc_id", "start_offset", "text").distinct().withColumn("arg_id", F.concat_ws(":", "start_offset", "text"))
    s = _sents(spark, d)
    at = spans.sentence_of(a.select("doc_id", F.col("arg_id").alias("inner_id"), F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end")), s).withColumnRenamed("inner_id", "arg_id")
    return linking.argument_contexts(a.join(at, ["doc_id", "arg_id"], "left"), _mentions(spark, d), s)


@query(f"WITH {_BL}, {_MEN}, {_CTX} SELECT * FROM ctx")
def argument_contexts(spark: SparkSession, d: str) -> DataFrame:
    """For each linked mention its sentence and those its clusters lead to."""
    return _contexts(spark, d)


_LINKROW = f"""SELECT sys AS "SOURCE", CAST(l.start_offset AS VARCHAR) AS "OFFSET", translate(l.text, chr(9) || chr(10), '  ') AS "ORIGINAL TEXT", translate(l.text, chr(9) || chr(10), '  ') AS "CLEANED TEXT", name AS "WIKI TITLE", id AS "FB ID",
    coalesce(array_to_string(types[:2], ', '), '') || CASE WHEN len(coalesce(types, [])) > 2 THEN ', ...' ELSE '' END AS "TYPES", {_two('score')} AS "COMBINED SCORE", {_two('doc_sim_score')} AS "DOC SIM SCORE", {_two('inlinks')} AS "INLINKS", {_two('candidate_score')} AS "CROSSWIKIS SCORE",
    CASE WHEN cluster_mentions = '' THEN '[]' ELSE translate(cluster_mentions, chr(9) || chr(10), '  ') END AS "CONTEXT CLUSTER MENTIONS", CAST(size AS VARCHAR) AS "CONTEXT SIZE", '[' || translate(coalesce(array_to_string(full_text, ', '), ''), chr(9) || chr(10), '  ') || ']' AS "CONTEXT", l.doc_id AS "DOC ID" FROM sy l JOIN ctx ON ctx.doc_id = l.doc_id AND ctx.start_offset = l.start_offset AND ctx.text = l.text"""


@query(f"WITH {_BL}, {_MEN}, {_CTX}, sy AS (SELECT 'BASELINE' AS sys, * FROM bl UNION ALL SELECT 'RULES', * FROM bl WHERE score >= 20.0) {_LINKROW}")
def link_report(spark: SparkSession, d: str) -> DataFrame:
    """The links of two systems with scores and contexts, fifteen columns."""
    l = _best_links(spark, d)
    return reports.link_report({"BASELINE": l, "RULES": l.filter("score >= 20.0")}, _contexts(spark, d).withColumn("clean", F.col("text")))


def _shown(tag: str, subs: str) -> str:
    """The parts of all extractions with what is found in them taking their place: greedy choice in order, then the pieces put together."""
    return f"""{tag}h AS (SELECT p.*, s.source, s.a AS sa, s.b AS sb, s.best, s.debug, row_number() OVER (PARTITION BY p.doc_id, p.sent_num, p.ext_no, p.n ORDER BY s.source, s.a, s.b, s.best, s.debug) AS k FROM parts p JOIN {subs} s ON s.doc_id = p.doc_id AND s.a >= p.a AND s.b <= p.b),
{tag}r AS (SELECT doc_id, sent_num, ext_no, n, k, [struct_pack(a := sa, b := sb, best := best)] AS kept FROM {tag}h WHERE k = 1 UNION ALL SELECT h.doc_id, h.sent_num, h.ext_no, h.n, h.k, CASE WHEN len(list_filter(r.kept, lambda x: x.a < h.sb AND h.sa < x.b)) > 0 THEN r.kept ELSE list_append(r.kept, struct_pack(a := h.sa, b := h.sb, best := h.best)) END
    FROM {tag}r r JOIN {tag}h h ON h.doc_id = r.doc_id AND h.sent_num = r.sent_num AND h.ext_no = r.ext_no AND h.n = r.n AND h.k = r.k + 1),
{tag}u AS (SELECT doc_id, sent_num, ext_no, n, unnest(kept) AS x FROM (SELECT doc_id, sent_num, ext_no, n, arg_max(kept, k) AS kept FROM {tag}r GROUP BY ALL)),
{tag}v AS (SELECT u.*, p.text, p.a, p.b, coalesce(lag(u.x.b) OVER (PARTITION BY u.doc_id, u.sent_num, u.ext_no, u.n ORDER BY u.x.a), p.a) AS before, lower(substr(p.text, u.x.a - p.a + 1, u.x.b - u.x.a)) AS old FROM {tag}u u JOIN parts p USING (doc_id, sent_num, ext_no, n)),
{tag}w AS (SELECT doc_id, sent_num, ext_no, n, string_agg(substr(text, before - a + 1, x.a - before) || x.best || CASE WHEN (old IN ('his', 'her', 'its', 'their', 'my', 'your', 'our') OR regexp_matches(old, '[\\x27’]s$')) AND NOT regexp_matches(x.best, '[\\x27’]s?$') THEN chr(39) || 's' ELSE '' END, '' ORDER BY x.a) || substr(any_value(text), max(x.b) - any_value(a) + 1) AS shown FROM {tag}v GROUP BY ALL),
{tag}d AS (SELECT doc_id, sent_num, ext_no, n, '[' || coalesce(string_agg(debug, ', ' ORDER BY sa, sb, best, debug) FILTER (source = 0), '') || ']' AS links, '[' || coalesce(string_agg(debug, ', ' ORDER BY sa, sb, best, debug) FILTER (source = 1), '') || ']' AS mentions FROM {tag}h GROUP BY ALL),
{tag}s AS (SELECT p.doc_id, p.sent_num, p.ext_no, p.n, coalesce(w.shown, p.text) AS shown, coalesce(d.links, '[]') AS links, coalesce(d.mentions, '[]') AS mentions FROM parts p LEFT JOIN {tag}w w USING (doc_id, sent_num, ext_no, n) LEFT JOIN {tag}d d USING (doc_id, sent_num, ext_no, n))"""


_CLEAN = "translate({0}, chr(9) || chr(10), '  ')".format


@query(f"""WITH RECURSIVE {_BL}, {_NT}, {_TRIPLES}, parts AS (SELECT doc_id, sent_num, ext_no, 1 AS n, arg1 AS text, arg1_offset AS a, arg1_offset + length(arg1) AS b FROM ex UNION ALL SELECT doc_id, sent_num, ext_no, 2, arg2, arg2_offset, arg2_offset + length(arg2) FROM ex),
lsub AS (SELECT DISTINCT doc_id, 0 AS source, start_offset AS a, start_offset + length(text) AS b, name AS best, '(' || name || ',' || id || ',' || CAST(score AS VARCHAR) || ')' AS debug FROM bl WHERE name IS NOT NULL),
both_ AS (SELECT * FROM lsub UNION ALL SELECT DISTINCT doc_id, 1, target.start_offset, target.start_offset + length(tt), best_mention, '(' || CAST(target.start_offset AS VARCHAR) || ') ' || tt || ' -> ' || best_mention FROM bt WHERE kind <> 'Identity' AND best_mention <> tt),
{_shown('x', 'lsub')}, {_shown('y', 'both_')}
SELECT ex.doc_id, ex.sent_num, ex.ext_no, {_CLEAN('c1.shown')} AS "Best Arg1", ex.rel AS "Rel", {_CLEAN('c2.shown')} AS "Best Arg2", {_CLEAN('b1.shown')} AS "Original Arg1", {_CLEAN('b2.shown')} AS "Original Arg2", {_CLEAN('s1.text')} AS "Sentence Text", {_CLEAN('c1.mentions')} AS "Arg1 Best Mentions", {_CLEAN('c2.mentions')} AS "Arg2 Best Mentions",
    {_CLEAN('c1.links')} AS "Arg1 Links", {_CLEAN('c2.links')} AS "Arg2 Links", {_CLEAN('b1.links')} AS "Original Arg1 Links", {_CLEAN('b2.links')} AS "Original Arg2 Links", trim(ex.doc_id) AS "Doc ID", CASE WHEN c1.shown <> b1.shown THEN 'YES' ELSE 'NO' END AS "Arg1 Changed?", CASE WHEN c2.shown <> b2.shown THEN 'YES' ELSE 'NO' END AS "Arg2 Changed?"
FROM ex JOIN s1 ON s1.doc_id = ex.doc_id AND s1.sent_num = ex.sent_num JOIN xs b1 ON b1.doc_id = ex.doc_id AND b1.sent_num = ex.sent_num AND b1.ext_no = ex.ext_no AND b1.n = 1 JOIN xs b2 ON b2.doc_id = ex.doc_id AND b2.sent_num = ex.sent_num AND b2.ext_no = ex.ext_no AND b2.n = 2
    JOIN ys c1 ON c1.doc_id = ex.doc_id AND c1.sent_num = ex.sent_num AND c1.ext_no = ex.ext_no AND c1.n = 1 JOIN ys c2 ON c2.doc_id = ex.doc_id AND c2.sent_num = ex.sent_num AND c2.ext_no = ex.ext_no AND c2.n = 2 WHERE c1.shown <> b1.shown OR c2.shown <> b2.shown""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The extractions whose arguments best mentions change, beside what links alone show, fifteen columns."""
    x = _extractions(spark, d).join(_sents(spark, d).select("doc_id", "sent_num", F.col("text").alias("sentence")), ["doc_id", "sent_num"])
    x = materialise(x)
    l = _best_links(spark, d)
    return reports.evaluation(x, x, l, l, table(spark, d, "best_mentions"))


_V = "CAST({0} AS VARCHAR)".format


@query(f"""WITH {_BL}, {_MEN}, {_NT}, {_TRIPLES.replace(_S1 + ", ", "", 1)},
tx AS (SELECT doc_id, sent_num, string_agg(chr(9) || '(' || {_V('arg1_offset')} || ': ' || arg1 || ')' || chr(9) || '(' || {_V('rel_offset')} || ': ' || rel || ')' || chr(9) || '(' || {_V('arg2_offset')} || ': ' || arg2 || ')' || chr(9) || 'conf:' || {_two('confidence', 3)}, chr(10) ORDER BY ext_no) AS t FROM ex GROUP BY ALL),
sx AS (SELECT s1.doc_id, count(*) AS n, string_agg('(' || {_V('s1.a')} || ') ' || s1.text || CASE WHEN t IS NULL THEN '' ELSE chr(10) || t END, chr(10) ORDER BY s1.sent_num) AS said FROM s1 LEFT JOIN tx ON tx.doc_id = s1.doc_id AND tx.sent_num = s1.sent_num GROUP BY s1.doc_id),
xn AS (SELECT doc_id, count(*) AS n FROM ex GROUP BY doc_id),
lr AS (SELECT doc_id, start_offset, id, '(' || {_V('start_offset')} || ')' || chr(9) || name || chr(9) || id || chr(9) || coalesce(array_to_string(types[:2], ', '), '') || ', ...' || chr(9) || {_two('score')} || '=f(' || {_two('doc_sim_score')} || ', ' || {_two('inlinks')} || ', ' || {_two('candidate_score')} || ')' AS r FROM bl),
lx AS (SELECT doc_id, count(*) AS n, string_agg(r, chr(10) ORDER BY start_offset, id, r) AS linked FROM lr GROUP BY doc_id),
mr AS (SELECT doc_id, cluster_id, start_offset, '(' || {_V('start_offset')} || ') ' || text AS r, lower(text) IN ({_PRON}) AS pron FROM m),
cr AS (SELECT doc_id, cluster_id, count(*) AS size, coalesce(min(r) FILTER (NOT pron), '') || chr(9) || coalesce(string_agg(r, ', ' ORDER BY start_offset, r) FILTER (pron), '') AS r FROM mr GROUP BY ALL),
cx AS (SELECT doc_id, string_agg(r, chr(10) ORDER BY size DESC, cluster_id, r) AS clusters FROM cr GROUP BY doc_id),
bx AS (SELECT nt.doc_id, string_agg({_V('bt.target.start_offset')} || chr(9) || tt || chr(9) || best_mention, chr(10) ORDER BY nt.bem_index) AS best FROM nt JOIN bt ON bt.doc_id = nt.doc_id AND bt.bem_index = nt.bem_index GROUP BY nt.doc_id)
SELECT d.ext_id AS doc_id, d.ext_id || chr(10) || 'Number of sentences: ' || {_V('coalesce(sx.n, 0)')} || chr(10) || 'Number of extractions: ' || {_V('coalesce(xn.n, 0)')} || chr(10) || 'Number of FreeBase links: ' || {_V('coalesce(lx.n, 0)')} || chr(10) || chr(10) || 'Text sample:' || chr(10) || coalesce(substr(d.text, 1, 300), '') || '...' || chr(10) || chr(10)
    || 'Extracted Sentences:' || chr(10) || coalesce(said, '') || chr(10) || chr(10) || 'Links:' || chr(10) || coalesce(linked, '') || chr(10) || chr(10) || 'Coref Clusters:' || chr(10) || coalesce(clusters, '') || chr(10) || 'Best Entity Mentions:' || chr(10) || coalesce(best, '') AS report
FROM documents d LEFT JOIN sx ON sx.doc_id = d.ext_id LEFT JOIN xn ON xn.doc_id = d.ext_id LEFT JOIN lx ON lx.doc_id = d.ext_id LEFT JOIN cx ON cx.doc_id = d.ext_id LEFT JOIN bx ON bx.doc_id = d.ext_id""")
def document_reports(spark: SparkSession, d: str) -> DataFrame:
    """A readable report for each document."""
    docs = table(spark, d, "documents").select(F.col("ext_id").alias("doc_id"), "text")
    m = _mentions(spark, d).withColumn("is_best", ~coref.is_pronoun(F.col("text")))
    return reports.document_report(docs, _sents(spark, d), _extractions(spark, d), _best_links(spark, d), m, table(spark, d, "best_mentions"))


@query(f"""WITH {_BL}, {_MEN}, {_CTX}, {_NT}, n1 AS (SELECT doc_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY sent_num)) AS h FROM s1 GROUP BY doc_id), n2 AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id), n3 AS (SELECT doc_id, count(*) AS n FROM bl GROUP BY doc_id), n4 AS (SELECT doc_id, count(*) AS n FROM ctx GROUP BY doc_id),
n5 AS (SELECT nt.doc_id, count(*) AS n, string_agg(best_mention, chr(10) ORDER BY nt.bem_index) AS b FROM nt JOIN best_mentions b ON b.doc_id = nt.doc_id AND b.bem_index = nt.bem_index GROUP BY nt.doc_id)
SELECT d.ext_id AS doc_id, length(d.text) AS chars, coalesce(n1.n, 0) AS sentences, coalesce(n1.h, md5('')) AS sentence_hash, coalesce(n2.n, 0) AS mentions, coalesce(n3.n, 0) AS links, coalesce(n4.n, 0) AS contexts, coalesce(n5.n, 0) AS best_mentions, coalesce(n5.b, '') AS best_texts
FROM documents d LEFT JOIN n1 ON n1.doc_id = d.ext_id LEFT JOIN n2 ON n2.doc_id = d.ext_id LEFT JOIN n3 ON n3.doc_id = d.ext_id LEFT JOIN n4 ON n4.doc_id = d.ext_id LEFT JOIN n5 ON n5.doc_id = d.ext_id""")
def serialisable_documents(spark: SparkSession, d: str) -> DataFrame:
    """One nested row for each document, summed up."""
    docs = table(spark, d, "documents").select(F.col("ext_id").alias("doc_id"), "text")
    x = reports.serialisable(docs, _sents(spark, d), _mentions(spark, d), _best_links(spark, d), _contexts(spark, d), table(spark, d, "best_mentions"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda y: y[f]), "\n"), F.lit(""))
    return x.select("doc_id", F.length("text").cast("long").alias("chars"), n("sentences"), F.md5(text("sentences", "text")).alias("sentence_hash"), n("mentions"), n("links"), n("contexts"), n("best_mentions"), text("best_mentions", "best_mention").alias("best_texts"))


_MCTX = f"""o AS (SELECT doc_id, bem_index, kind, target.start_offset AS t, CASE WHEN kind IN {_FULL} THEN best.start_offset WHEN {_BOX} THEN container.start_offset END AS b FROM best_mentions),
sc AS (SELECT o.doc_id, o.p, (SELECT min(s1.sent_num) FROM s1 WHERE s1.doc_id = o.doc_id AND o.p > s1.a AND o.p < s1.b) AS sent_num FROM (SELECT doc_id, t AS p FROM o UNION SELECT doc_id, b FROM o WHERE b IS NOT NULL) o),
sd AS (SELECT sc.doc_id, sc.p, coalesce(s1.text, regexp_replace(substr(d.text, greatest(0, sc.p - 40) + 1, 80), '[\\t\\n\\x0b\\f\\r ]', ' ', 'g')) AS c FROM sc LEFT JOIN s1 ON s1.doc_id = sc.doc_id AND s1.sent_num = sc.sent_num LEFT JOIN documents d ON d.ext_id = sc.doc_id),
mc AS (SELECT o.doc_id, o.bem_index, o.kind, x.c AS target_context, coalesce(y.c, 'NA') AS best_context FROM o LEFT JOIN sd x ON x.doc_id = o.doc_id AND x.p = o.t LEFT JOIN sd y ON y.doc_id = o.doc_id AND y.p = o.b)"""


def _mention_contexts(spark: SparkSession, d: str) -> DataFrame:
    return reports.mention_contexts(table(spark, d, "best_mentions"), _sents(spark, d), table(spark, d, "documents").select(F.col("ext_id").alias("doc_id"), "text"))


@query(f"WITH {_S1}, {_MCTX} SELECT * FROM mc")
def mention_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The sentence, or eighty characters, around the target and the best form of each best mention."""
    return _mention_contexts(spark, d)


_FIELDS = " || chr(9) || ".join(_two(f'"{n}"') for n in evaluate.FEATURES)


@query(f"""WITH {_GAZ}, {_NT}, {_MEN}, {_AGREE}, {_FEATS}, {_MCTX}, cl AS (SELECT nt.doc_id, nt.position, translate(tt, chr(9) || chr(10), '  ') AS tt, translate(best_mention, chr(9) || chr(10), '  ') AS bm, translate(coalesce(target_context, ''), chr(9) || chr(10), '  ') AS tx, translate(coalesce(best_context, ''), chr(9) || chr(10), '  ') AS bx, ft.*
    FROM nt JOIN bt ON bt.doc_id = nt.doc_id AND bt.bem_index = nt.bem_index JOIN mc ON mc.doc_id = nt.doc_id AND mc.bem_index = nt.bem_index JOIN ft ON ft.doc_id = nt.doc_id AND ft.bem_index = nt.bem_index)
SELECT '' || chr(9) || tt || chr(9) || bm || chr(9) || tx || chr(9) || bx || chr(9) || {_FIELDS} || chr(9) || CAST(position AS VARCHAR) || chr(9) || doc_id AS line FROM cl
UNION ALL SELECT {_q(chr(9).join(['label', 'target text', 'best text', 'target context', 'best context', *evaluate.FEATURES, 'doc bem index', 'doc id']))}""")
def feature_tsv(spark: SparkSession, d: str) -> DataFrame:
    """The features of each non-trivial best mention as lines of a TSV, with texts, contexts and its position, and the header line."""
    b = table(spark, d, "best_mentions")
    t = reports.feature_table(b, evaluate.features(b, _places(spark, d), _mentions(spark, d)), _mention_contexts(spark, d), evaluate.positions(b), evaluate.FEATURES)
    head = spark.createDataFrame([(reports.header(t.columns),)], "line string")
    return t.select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in t.columns]).alias("line")).union(head)
