import json

import pytest
from pyspark.sql import functions as F

from glossweave.functions.annotators import chunked, extraction_rows, extractions, lemma, name_clusters, noun_relations, parse_documents, part
from glossweave.operators import coref, ingest, reports
from glossweave.sources import files


def lines(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "line string, line_no int")


def test_round_trips(spark, tmp_path):
    s = spark.createDataFrame([("d", 0, 5, "a\tb"), ("d", 1, 9, "c")], "doc_id string, sent_num int, start_offset int, text string")
    files.write_lines(files.sentence_lines(s), str(tmp_path / "s"))
    back = files.sentences(spark.read.text(str(tmp_path / "s")).withColumnRenamed("value", "line"))
    assert {tuple(r) for r in back.collect()} == {("d", 0, 5, "ab"), ("d", 1, 9, "c")}
    assert files.sentences(lines(spark, "a\tb\tc")).count() == 0
    p = files.parsed_sentences(lines(spark, "d\t0\t3\tB-NP  I-NP\tdet(a, b)", "short"))
    assert [tuple(r) for r in p.collect()] == [("d", 0, 3, ["B-NP", "I-NP"], "det(a, b)")]
    assert files.parsed_lines(p).first().line == "d\t0\t3\tB-NP I-NP\tdet(a, b)"
    files.write_documents(s, str(tmp_path / "docs"), "doc_id")
    assert files.read_documents(spark, str(tmp_path / "docs")).count() == 2


def test_other_sources(spark, tmp_path):
    assert [tuple(r) for r in files.labelled(lines(spark, "label\tx\tindex\tdoc", "1\t0.5\t3\td1", "\t0.5\t4\td1", "0\t5\td2")).collect()] == [("d1", 3, 1)]
    assert [tuple(r) for r in files.kb_entities(lines(spark, '<entity wiki_title="A_B" type="PER" id="E1" name="A B">', '<entity id="E2">')).collect()] == [("E1", "A B", "PER")]
    assert {tuple(r) for r in files.name_to_node(lines(spark, "1\ta\tX", "2\ta\tY", "3\tb\tX\tmore")).collect()} == {("a", "2"), ("b", "3")}
    with pytest.raises(Exception, match="no entity"):
        files.name_to_node(lines(spark, "1\ta")).collect()
    assert files.kb_entities(lines(spark, '<entity wiki_title="" type="PER" id="E1" name="A">')).count() == 0
    assert files.kb_lines(spark.createDataFrame([("E1", "A B", "PER")], "id string, name string, typ string")).first().line == "E1\tA B\tPER"
    assert files.raw_text(spark, ["a\n", "b"], "stdin").first().text == "a\nb"
    (tmp_path / "u.txt").write_text("é\n", encoding="UTF-8")
    assert files.raw_url(spark, (tmp_path / "u.txt").as_uri()).first().text == "é\n"
    texts = spark.createDataFrame([("in/f", 0, "one\ntwo"), ("in/f", 1, "three\n"), ("in/g", 0, "four")], "path string, doc_ord int, text string")
    for most, want in ((-1, {"one\ntwo\n", "three\n", "four\n"}), (2, {"one\ntwo\n", "three\n"})):
        files.write_split(texts, str(tmp_path / f"split{most}"), most)
        assert {p.read_text() for p in (tmp_path / f"split{most}").rglob("*.txt")} == want
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "a.sgm").write_bytes("é\r\nb".encode("ISO-8859-1"))
    (tmp_path / "x" / "b.txt").write_text("no")
    assert [r.text for r in files.raw_files(spark, str(tmp_path / "x"), "ISO-8859-1", "*sgm").collect()] == ["é\r\nb"]
    (tmp_path / "g.txt").write_bytes("Málaga (CITY) Spain (COUNTRY)\n".encode("ISO-8859-1"))
    assert files.gazetteer_lines(spark, str(tmp_path / "g.txt")).first().line.startswith("Málaga")


def test_documents_and_reports(spark):
    df = spark.createDataFrame([("f", "a\n</DOC>\nb\n</DOC>\n"), ("g", "c\n</doc>\n")], "path string, text string")
    docs = ingest.split_documents(ingest.split_lines(df, "text", ["path"]), "path")
    assert [tuple(r) for r in files.uneven_files(docs).collect()] == [("f", 2)]
    assert ingest.first_documents(docs, 1).select("path", "doc_ord").distinct().count() == 1 and ingest.first_documents(docs, -1).count() == docs.count()
    t = spark.createDataFrame([("a\tb", 0.126, None)], "x string, y double, z string")
    assert reports.tsv(t, ["x", "y", "z"], {"y": "%.2f"}).first().line == "a b\t0.13\t"
    links = spark.createDataFrame([("d", 1, "x", "X", 5.0, ["p.a", "p.b", "p.c"])], "doc_id string, start_offset int, text string, name string, score double, types array<string>")
    ctx = spark.createDataFrame([("d", 1, "x", "said x")], "doc_id string, start_offset int, text string, context string")
    assert reports.link_with_context(links, ctx).first().context == "said x"
    assert [r.system for r in coref.tagged_union({"A": t, "B": t}).select("system").orderBy("system").collect()] == ["A", "B"]


P = "struct<text:string,start_offset:int>"
X = f"doc_id string, sent_num int, ext_no int, sentence string, arg1 {P}, rel {P}, arg2 {P}, confidence double"
L = "doc_id string, start_offset int, text string, name string, id string, score double, doc_sim_score double, candidate_score double, inlinks double, types array<string>"
B = f"doc_id string, bem_index int, kind string, best_mention string, target {P}"


def test_document_report(spark):
    docs = spark.createDataFrame([("d", "T" * 400), ("e", None)], "doc_id string, text string")
    s = spark.createDataFrame([("d", 0, 0, "Ann met Bob."), ("d", 1, 13, "She left.")], "doc_id string, sent_num int, start_offset int, text string")
    x = spark.createDataFrame([("d", 0, 0, "", ("Ann", 0), ("met", 4), ("Bob", 8), 0.5)], X)
    l = spark.createDataFrame([("d", 0, "Ann", "Ann Lee", "m1", 9.125, 0.5, 0.25, 7.0, ["p.a", "p.b", "p.c"])], L)
    m = spark.createDataFrame([("d", 1, 8, "Bob", True), ("d", 2, 0, "Ann", True), ("d", 2, 13, "She", False)], "doc_id string, cluster_id int, start_offset int, text string, is_best boolean")
    b = spark.createDataFrame([("d", 0, "Full", "Ann Lee", ("Ann", 0)), ("d", 1, "Identity", "Bob", ("Bob", 8))], B)
    rep = {r.doc_id: r.report for r in reports.document_report(docs, s, x, l, m, b).collect()}
    assert rep["d"].split("\n") == [
        "d", "Number of sentences: 2", "Number of extractions: 1", "Number of FreeBase links: 1", "", "Text sample:", "T" * 300 + "...", "", "Extracted Sentences:", "(0) Ann met Bob.", "\t(0: Ann)\t(4: met)\t(8: Bob)\tconf:0.500", "(13) She left.", "",
        "Links:", "(0)\tAnn Lee\tm1\tp.a, p.b, ...\t9.13=f(0.50, 7.00, 0.25)", "", "Coref Clusters:", "(0) Ann\t(13) She", "(8) Bob\t", "Best Entity Mentions:", "0\tAnn\tAnn Lee",
    ]
    assert rep["e"].startswith("e\nNumber of sentences: 0")


def test_evaluation_report(spark):
    x = spark.createDataFrame([("d", 0, 0, "His wife met Smith.", ("His wife", 0), ("met", 9), ("Smith", 13), 0.5), ("d", 0, 1, "His wife met Smith.", ("wife", 4), ("met", 9), ("wife", 4), 0.5)], X)
    l = spark.createDataFrame([("d", 13, "Smith", "John Smith", "m1", 9.0, None, None, None, None)], L)
    b = spark.createDataFrame([("d", 0, "CorefFull", "Al Ray", ("His", 0)), ("d", 1, "Full", "J. Smith", ("Smith", 13)), ("d", 2, "Identity", "x", ("wife", 4))], B)
    got = reports.evaluation(x, x, l, l, b).collect()
    assert len(got) == 1 and got[0].asDict().keys() - {"doc_id", "sent_num", "ext_no"} == set(reports.EVALUATION_COLUMNS)
    r = got[0]
    assert (r["Best Arg1"], r["Rel"], r["Best Arg2"], r["Original Arg1"], r["Original Arg2"]) == ("Al Ray's wife", "met", "John Smith", "His wife", "John Smith")  # the link came first
    assert (r["Arg1 Best Mentions"], r["Arg2 Best Mentions"], r["Arg2 Links"], r["Original Arg1 Links"]) == ("[(0) His -> Al Ray]", "[(13) Smith -> J. Smith]", "[(John Smith,m1,9.0)]", "[]")
    assert (r["Arg1 Changed?"], r["Arg2 Changed?"]) == ("YES", "NO")
    with pytest.raises(Exception, match="sentences of two systems differ"):
        reports.evaluation(x.withColumn("sentence", F.lit("other")), x, l, l, b).collect()


def test_link_report(spark):
    l = spark.createDataFrame([("d", 13, "Smith", "John Smith", "m1", 9.125, 0.005, None, 3.0, ["a", "b", "c"])], L)
    c = spark.createDataFrame([("d", 13, "Smith", "Smith", ["One\ttwo.", "Three."], 3, "[(13) Smith, (20) he]")], "doc_id string, start_offset int, text string, clean string, full_text array<string>, size int, cluster_mentions string")
    r = reports.link_report({"A": l}, c).first()
    assert list(r) == ["A", "13", "Smith", "Smith", "John Smith", "m1", "a, b, ...", "9.13", "0.01", "3.00", None, "[(13) Smith, (20) he]", "3", "[One two., Three.]", "d"]
    with pytest.raises(Exception, match="exactly one context"):
        reports.link_report({"A": l}, c.union(c)).collect()


def test_counters(spark):
    assert tuple(reports.counters(spark.range(10), even=F.col("id") % 2 == 0).first()) == (10, 5)


def test_annotators_reject_rows_not_runs(spark):
    import pandas as pd

    def load():
        def model(f):
            if (f.text == "bad").any():
                raise ValueError("cannot tag")
            return pd.DataFrame({"doc_id": f.doc_id, "sent_num": 0, "text": f.text, "start_offset": 0, "type": "T"})

        return model

    docs = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "fine")], "doc_id string, text string").coalesce(1)
    rows, rejects = parse_documents(docs, {"tags": load})["tags"]
    assert {r.doc_id for r in rows.collect()} == {"a", "c"}
    assert [(json.loads(r.input)["doc_id"], r.error) for r in rejects.collect()] == [("b", "ValueError: cannot tag")]


def test_extraction_lists(spark):
    T = f"array<{P}>"
    nouns = spark.createDataFrame([("d", 0, 0, [("Ann", 0), ("Lee", 4)], [("head", 9)], [("Acme", 17)], 0.5)], f"doc_id string, sent_num int, no int, arg1 {T}, rel {T}, arg2 {T}, confidence double")
    verbs = spark.createDataFrame([("d", 0, 0, ("Ann", 0), ("met", 9), [("Bob", 17), ("Al", 22)], 0.9), ("d", 0, 1, ("x", 1), ("y", 2), [], 0.9)], f"doc_id string, sent_num int, no int, arg1 {P}, rel {P}, arg2s {T}, confidence double")
    got = extractions(noun_relations(nouns), verbs).orderBy("ext_no").collect()
    assert [(r.ext_no, r.source, r.arg1.text, r.arg1.start_offset, r.arg2.text) for r in got] == [(0, 0, "Ann Lee", 0, "Acme"), (1, 1, "Ann", 0, "Bob"), (2, 1, "Ann", 0, "Al")]
    t = spark.createDataFrame([([("b", 9), ("a", 4)],)], f"t {T}").select(part(F.col("t")).alias("head"), part(F.col("t"), least=True).alias("least")).first()
    assert (t.head.start_offset, t.least.start_offset, t.head.text) == (9, 4, "b a")


def test_name_clusters(spark):
    e = spark.createDataFrame([("d", "Ann Lee", 0, "Ann"), ("d", "Ann Lee", 20, "Lee"), ("d", "Bob", 8, "Bob")], "doc_id string, name string, start_offset int, text string")
    s = spark.createDataFrame([("d", 0, 0, "Ann met Bob his way Lee it"), ("d", 1, 40, "he ran")], "doc_id string, sent_num int, start_offset int, text string")
    assert {(r.cluster_id, r.start_offset, r.text) for r in name_clusters(e, s).collect()} == {(0, 0, "Ann"), (0, 20, "Lee"), (1, 8, "Bob"), (1, 12, "his"), (0, 24, "it"), (0, 40, "he")}


def test_annotation_shapes(spark):
    srl = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "arg1 string, arg2s array<string>")
    assert [(r.arg1, r.arg2) for r in extraction_rows(srl).orderBy("arg2").collect()] == [("a", "x"), ("a", "y")]
    ok = spark.createDataFrame([(["a"], ["B"])], "tokens array<string>, chunks array<string>")
    assert chunked(ok).select(F.size("pairs")).first()[0] == 1
    more = spark.createDataFrame([(list("abcd"), list("BCDE"))], "tokens array<string>, chunks array<string>")
    assert [(x.tokens, x.chunks) for x in chunked(more, 1, 2).first().pairs] == [("b", "C"), ("c", "D")]
    assert spark.createDataFrame([("Mills",), ("glass",), ("bus",)], "w string").select(lemma(F.col("w"))).collect() == [("mill",), ("glass",), ("bus",)]


def test_argument_sentences(spark):
    args = spark.createDataFrame([("d", 1, 0, 10)], "doc_id string, arg_id int, start int, end int")
    m = spark.createDataFrame([("d", 7, 2, "Ann"), ("d", 7, 30, "she"), ("d", 8, 50, "Bob")], "doc_id string, cluster_id int, start_offset int, text string")
    s = spark.createDataFrame([("d", 0, 0, 20), ("d", 1, 21, 40), ("d", 2, 41, 60)], "doc_id string, sent_num int, start int, end int")
    assert {r.sent_num for r in coref.argument_sentences(args, m, s).collect()} == {0, 1}
