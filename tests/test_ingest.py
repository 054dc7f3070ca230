import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossweave.functions.fixed import ASCII_FROM, ASCII_TO
from glossweave.functions.text import asciify, link_entity_type, location_casing, usable_sentence
from glossweave.operators import ingest

WEB = """<DOC>
<DOCID> web-0001 </DOCID>
<DATETIME> 2007-10-22T10:31:03 </DATETIME>
<BODY>
<POSTER> "jane doe" &lt;j@example.com&gt; </POSTER>
<TEXT>
Jane Doe lives in Seattle.
She works for Acme.

Second paragraph — short one.
</TEXT>
</BODY>
</DOC>
"""


def lines(spark, *texts):
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    return ingest.split_lines(df, "text", ["path"])


def test_offsets_of_the_web_fixture(spark):
    got = [r.start_offset for r in lines(spark, WEB).orderBy("line_no").collect()]
    assert got == [0, 6, 32, 75, 82, 134, 141, 168, 188, 189, 219, 227, 235]


def test_header_sentences_and_numbering(spark):
    docs = ingest.split_documents(lines(spark, WEB + WEB + "\n"), "path")
    heads = ingest.headers(docs).orderBy("doc_ord").collect()
    assert [h.doc_id for h in heads] == ["web-0001", "web-0001", None]
    assert (heads[0].author.start_offset, heads[0].author.text) == (67, "This post was written by jane doe.")
    assert (heads[0].written.start_offset, heads[0].written.text) == (18, "This post was written on 2007-10-22T10:31:03 .")
    pars = ingest.paragraphs(docs, ingest.headers(docs)).filter("doc_ord = 0").orderBy("par_no").collect()
    assert [(p.start_offset, p.text) for p in pars] == [(141, "Jane Doe lives in Seattle.\nShe works for Acme.\n"), (189, "Second paragraph — short one.\n")]
    s = ingest.process(lines(spark, WEB), "path", filtered=False).orderBy("sent_num").collect()
    assert [(x.sent_num, x.start_offset) for x in s][:4] == [(0, 67), (1, 18), (2, 141), (3, 168)]


def test_other_headers(spark):
    news = '<DOC id="AFP_ENG_20090531.0001" type="story" >\n<DATELINE>\nParis, May 31\n</DATELINE>\nText here.\n</DOC>\n'
    forum = '<doc id="bolt-eng-DF-183-195681-7948494">\n<post>\nhello\n</post>\n</doc>\n'
    glued = "<DOCID>abc</DOCID>\nx\n</DOC>\n"
    docs = ingest.split_documents(lines(spark, news, forum, glued), "path")
    got = {h.path: (h.corpus, h.doc_id, h.written) for h in ingest.headers(docs).collect()}
    assert got["f0"] == ("news", "AFP_ENG_20090531.0001", None)
    assert got["f1"][:2] == ("forum", "bolt-eng-DF-183-195681-7948494")
    assert got["f2"][1].startswith("bc</DOCID>")
    # the date of news is none of its text; elsewhere, and after another dateline, the line stays
    pars = lambda **k: [p.text for p in ingest.paragraphs(docs, ingest.headers(docs, **k)).filter("path = 'f0'").collect()]
    assert pars() == ["Text here.\n"] and pars(corpus="web") == ["Paris, May 31\n", "Text here.\n"]
    with pytest.raises(ValueError, match="unknown corpus"):
        ingest.headers(docs, "mail")
    assert {h.path for h in ingest.headers(docs, "news").filter("doc_id is not null").collect()} == {"f0"}


def test_rejects(spark):
    docs = ingest.split_documents(lines(spark, WEB + "\n<b>\nleft\nover\n", '<DOC id= >\nText.\n</DOC>\n'), "path")
    got = {(r.path, r.doc_ord): (r.reason, r.sample) for r in ingest.rejected(docs, ingest.headers(docs)).collect()}
    assert got == {("f0", 1): ("no id line", "\n\nleft\nover\n")}
    assert ingest.first_sentences(ingest.process(lines(spark, WEB), "path", filtered=False), 2).count() == 2


def test_types_of_links(spark):
    cases = {"place.hill": "LOCATION", "base.country": "LOCATION", "us.state": "LOCATION", "some.province": "LOCATION", "business.firm": "ORGANIZATION", "corporation": "ORGANIZATION", "insurance.company": "ORGANIZATION", "person": "PERSON", "time.event": "OTHER"}
    df = spark.createDataFrame([([t], t) for t in cases], "types array<string>, t string")
    assert {r.t: r.k for r in df.select("t", link_entity_type(F.col("types")).alias("k")).collect()} == cases


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab\r\n é", max_size=30), min_size=1, max_size=8))
def test_lines_rebuild_the_text(spark, texts):
    got = lines(spark, *texts).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "start_offset"))).alias("l")).collect()
    by = {r.path: r.l for r in got}
    for i, t in enumerate(texts):
        own = by.get(f"f{i}", [])
        assert "".join(x.line for x in own) == t
        assert all(t[x.start_offset :].startswith(x.line) for x in own)


def test_text_functions(spark):
    df = spark.createDataFrame([("a b c",), ("a b c d",), ("“hi” — x y z",), (" ".join(["x" * 7] * 94),), (None,)], "t string")
    got = [tuple(r) for r in df.select(usable_sentence(F.col("t")), asciify(F.col("t"))).collect()]
    assert [g[0] for g in got] == [False, True, True, False, None]
    assert got[2][1] == '"hi" - x y z' and len(ASCII_FROM) == len(ASCII_TO) == 94
    one = spark.range(1).select(location_casing(F.lit("NEW york u.s.")), link_entity_type(F.array(F.lit("people.person"), F.lit("location.city")))).first()
    assert tuple(one) == ("New York u.s.", "LOCATION")


def test_empty_tables(spark):
    docs = ingest.split_documents(lines(spark, "").filter("false"), "path")
    assert ingest.headers(docs).count() == ingest.paragraphs(docs, ingest.headers(docs)).count() == ingest.rejected(docs, ingest.headers(docs)).count() == 0
