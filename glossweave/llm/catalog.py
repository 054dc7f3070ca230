"""The queries of this subpackage, over the whole tables of a data folder, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.tables import table
from . import canonical, charforms, markup, mixing, neardup, packing, pii, rankfusion, tokens, variants
from . import sentences as sent

SCORES = ["score", "doc_sim_score", "candidate_score", "inlinks"]


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every mention with its four ranks and the fused score."""
    return rankfusion.fuse(table(spark, d, "links"), ["doc_id", "start_offset"], "id", SCORES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rankfusion.first_of(p3_fused(spark, d), ["doc_id", "start_offset"], "id")


def _forms(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").select(F.lit("sentences").alias("tbl"), "doc_id", F.col("sent_num").alias("row_no"), "text")
    e = table(spark, d, "entities").select(F.lit("entities").alias("tbl"), "doc_id", F.col("ent_no").alias("row_no"), "text")
    return charforms.one_form(s.unionByName(e), "text", ["tbl", "doc_id", "row_no"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).filter(~F.col("text").eqNullSafe(F.col("normal"))).select("tbl", "doc_id", "row_no").distinct()


def p6_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("tbl", "doc_id", "row_no", "normal")


def _residue(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), F.lit(-1).alias("line_no"), "text")
    b = table(spark, d, "doc_lines").select(F.lit("doc_lines").alias("tbl"), F.col("doc_id").alias("rec_id"), "line_no", F.col("line").alias("text"))
    keep = ["tbl", "rec_id", "line_no"]
    model = markup.fit(docs, "text")
    return markup.residue(a, "text", keep, model).unionByName(markup.residue(b, "text", keep, model, frames=True))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).filter("pieces > 0").select("tbl", "rec_id", "line_no").distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents and lines as clean text."""
    return _residue(spark, d)


def _names(spark: SparkSession, d: str) -> DataFrame:
    """The spellings that are names in full: entities.name and best_mention."""
    e = table(spark, d, "entities").select("name", F.col("entity_type").alias("kind"))
    b = table(spark, d, "best_mentions").select(F.col("best_mention").alias("name"), F.col("target.entity_type").alias("kind"))
    return e.union(b)


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a person or organisation, those of entities.text too, with the entity it stands for. A mention is evidence
    once: its text counts where it has no name."""
    t = table(spark, d, "entities").select(F.col("text").alias("name"), F.col("entity_type").alias("kind"), F.when(F.col("name").isNull(), 1).otherwise(0).alias("w"))
    return variants.resolve(_names(spark, d).withColumn("w", F.lit(1)).union(t), "name", "kind", "w")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings in entities.name and best_mention only, as TESTDATA.md has them."""
    return variants.pairs(materialise(p2_entities(spark, d).join(_names(spark, d).distinct(), ["name", "kind"], "left_semi")))


def p4_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct hand-typed text with the entry meant and its score; null id: none."""
    typed = table(spark, d, "links").filter("id is null").select("text")
    return canonical.map_values(typed, "text", table(spark, d, "kb_entities"), "id", "name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "links").filter("id is null").select("doc_id", "text").distinct()
    ids = p4_mapped(spark, d).select("text", F.coalesce("id", F.lit("NONE")).alias("id")).withColumnRenamed("text", "t")
    return typed.join(ids, typed.text.eqNullSafe(F.col("t"))).select("doc_id", "text", "id")


def _spaced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang is null or lang not in ('zh', 'ja', 'th')")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Three words and 0.5 as TESTDATA.md has them."""
    return neardup.pairs(_spaced(spark, d), "doc_id", "text", 3, 0.5)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Five words and 0.8 over the documents of every language, a row for each; those of under five words by their whole word list.
    A class (equal sets) and a group (chains of similar texts) bear the least doc_id in them."""
    g = materialise(neardup.document_groups(table(spark, d, "documents"), "doc_id", "text"))
    least = lambda c: g.groupBy(c).agg(F.min("doc_id").alias(f"first_of_{c[:-3]}"))
    return g.join(least("class_id"), "class_id").join(least("group_id"), "group_id").select("doc_id", "first_of_class", "first_of_group", "links")


SENTENCE_SOURCES = ["news", "transcript", "bulletin", "archive"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("source").isin(SENTENCE_SOURCES))
    return sent.sentences(docs, "text", ["doc_id"]).select("doc_id", "start_pos", "end_pos").distinct()


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document, with its text."""
    return sent.sentences(table(spark, d, "documents"), "text", ["doc_id"])


def p7_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``sentences`` as single sentences, with offsets in the document."""
    s = sent.sentences(table(spark, d, "sentences"), "text", ["doc_id", "sent_num", "start_offset"])
    return s.select("doc_id", "sent_num", "sent_no", (F.col("start_offset") + F.col("start_pos")).alias("start_offset"), F.col("sentence").alias("text"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return materialise(tokens.sizes(table(spark, d, "documents"), "text", ["doc_id", "source"]))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), "doc_id", "tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_targets"))[1]


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """All spans with the probability the span classifier gives them."""
    return pii.spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "entities"), ["text", "name"], "entity_type")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_spans(spark, d).select("doc_id", "kind", "start_pos", "end_pos").distinct()


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "documents"), "doc_id", "text", p10_spans(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_entities, p3_found, p3_fused, p4_found, p4_mapped, p5_found, p5_groups, p6_found, p6_normalized, p7_found, p7_documents, p7_rows, p8_packed, p8_fill, p9_mix, p9_shares, p10_found, p10_spans, p10_masked)}


_FUSED = """
WITH best AS (SELECT doc_id, start_offset, id, max(score) AS score, max(doc_sim_score) AS doc_sim_score, max(candidate_score) AS candidate_score,
    max(inlinks) AS inlinks FROM links WHERE id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY doc_id, start_offset ORDER BY score DESC NULLS LAST) AS rank_score, rank() OVER (PARTITION BY doc_id, start_offset ORDER BY doc_sim_score DESC NULLS LAST) AS rank_doc_sim_score,
    rank() OVER (PARTITION BY doc_id, start_offset ORDER BY candidate_score DESC NULLS LAST) AS rank_candidate_score, rank() OVER (PARTITION BY doc_id, start_offset ORDER BY inlinks DESC NULLS LAST) AS rank_inlinks
    FROM best),
fused AS (SELECT doc_id, start_offset, id, CAST(rank_score AS INT) AS rank_score, CAST(rank_doc_sim_score AS INT) AS rank_doc_sim_score,
    CAST(rank_candidate_score AS INT) AS rank_candidate_score, CAST(rank_inlinks AS INT) AS rank_inlinks,
    round(1.0::DOUBLE / (60 + rank_score) + 1.0::DOUBLE / (60 + rank_doc_sim_score) + 1.0::DOUBLE / (60 + rank_candidate_score) + 1.0::DOUBLE / (60 + rank_inlinks), 12) AS fused,
    CAST(rank_score + rank_doc_sim_score + rank_candidate_score + rank_inlinks AS INT) AS rank_sum FROM ranked)
"""


_WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WORDS = f"list_filter(string_split_regex(lower(text), '{_WS}'), lambda x: x <> '')"


def _runs(k: int) -> str:
    return "unnest(list_transform(range(1, len(l) - {}), lambda i: {})) AS g".format(k - 2, " || ' ' || ".join(f"l[i + {j}]" for j in range(k)))


_PAIRS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS l FROM documents WHERE lang IS NULL OR lang NOT IN ('zh', 'ja', 'th')),
s AS (SELECT DISTINCT doc_id, {_runs(3)} FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL)
SELECT x AS doc_id_a, y AS doc_id_b FROM c JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 2 * k >= na.n + nb.n - k
"""
_GROUPS = f"""
WITH RECURSIVE w AS (SELECT doc_id, text IS NULL AS no_text, {_WORDS} AS l FROM documents),
s AS (SELECT DISTINCT doc_id, {_runs(5)} FROM w WHERE len(l) >= 5),
k AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS c, count(*) AS n FROM s GROUP BY doc_id UNION ALL SELECT doc_id, CASE WHEN no_text THEN 'null' ELSE 'w ' || array_to_string(l, ' ') END, 0 FROM w WHERE no_text OR len(l) < 5),
cls AS (SELECT c, min(doc_id) AS rep, any_value(n) AS n FROM k GROUP BY c), r AS (SELECT s.* FROM s SEMI JOIN cls ON cls.rep = s.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM r x JOIN r y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN cls na ON na.rep = a JOIN cls nb ON nb.rep = b WHERE 5 * m >= 4 * (na.n + nb.n - m)),
reach(node, root) AS (SELECT rep, rep FROM cls UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT k.doc_id, cls.rep AS first_of_class, roots.root AS first_of_group, coalesce(deg.links, 0) AS links FROM k JOIN cls USING (c) JOIN roots ON roots.node = cls.rep LEFT JOIN deg ON deg.a = cls.rep
"""


_ROWS = "SELECT 'sentences' AS tbl, doc_id, sent_num AS row_no, text AS t FROM sentences UNION ALL SELECT 'entities', doc_id, ent_no, text FROM entities"


def oracle_sql() -> dict[str, str]:
    forms = charforms.statement(_ROWS)
    return {
        "p6_found": f"SELECT DISTINCT tbl, doc_id, row_no FROM ({forms}) WHERE text IS DISTINCT FROM normal",
        "p6_normalized": f"SELECT tbl, doc_id, row_no, normal FROM ({forms})",
        "p5_found": _PAIRS,
        "p5_groups": _GROUPS,
        "p3_fused": _FUSED + "SELECT * FROM fused",
        "p3_found": _FUSED
        + """SELECT doc_id, start_offset, id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, start_offset) AS n, row_number() OVER (PARTITION BY doc_id, start_offset ORDER BY fused DESC, rank_sum, id) AS r
            FROM fused) WHERE n > 1 AND r = 1""",
    }
