from pyspark.sql import functions as F

from glossweave.operators import linking
from glossweave.plans import pipelines


def test_argument_cleaning(spark):
    T = "t array<struct<text:string,start_offset:int,pos:string>>"
    df = spark.createDataFrame([([("the", 0, "DT"), ("old", 4, "JJ"), ("mill", 8, "NN"), ("of", 13, "IN")],), ([("the", 3, "DT")],), ([],)], T)
    assert [tuple(r.c) for r in df.select(linking.clean_argument(F.col("t")).alias("c")).collect()] == [("old mill", 4), ("", None), ("", None)]


def test_substitution(spark):
    S = "x string, s array<struct<start:int,end:int,best:string>>"
    df = spark.createDataFrame([("his wife met Smith", [(13, 18, "John Smith"), (0, 3, "Al Ray")]), ("Acme's mill", [(0, 6, "Acme Corp")]), ("plain", [])], S)
    assert [r[0] for r in df.select(linking.substitute(F.col("x"), F.col("s"))).collect()] == ["Al Ray's wife met John Smith", "Acme Corp's mill", "plain"]


def test_arguments_and_contexts(spark):
    X = "doc_id string, sent_num int, ext_no int, arg1 struct<text:string,start_offset:int>, arg2 struct<text:string,start_offset:int>"
    got = linking.distinct_arguments(spark.createDataFrame([("d", 0, 0, ("a", 1), ("b", 2)), ("d", 0, 1, ("a", 1), None)], X)).orderBy("arg_no").collect()
    assert [(r.arg_no, r.text) for r in got] == [(0, "a"), (1, "b")]
    s = spark.createDataFrame([("d", 0, 0, 10, "Ann ran. "), ("d", 1, 10, 20, "She won.")], "doc_id string, sent_num int, start int, end int, text string")
    m = spark.createDataFrame([("d", 1, 0, "Ann"), ("d", 1, 10, "She")], "doc_id string, cluster_id int, start_offset int, text string")
    a = spark.createDataFrame([("d", 5, 0, 3), ("d", 6, 15, 18)], "doc_id string, arg_id int, start int, end int")
    assert {(r.arg_id, r.context, r.size) for r in linking.contexts(a, m, s).collect()} == {(5, "Ann ran.  She won.", 3), (6, "", 1)}


def test_contexts_begin_with_the_own_sentence(spark):
    s = spark.createDataFrame([("d", 0, 0, 10, "Ann ran. "), ("d", 1, 10, 20, "She won."), ("d", 2, 20, 30, "Bob saw.")], "doc_id string, sent_num int, start int, end int, text string")
    m = spark.createDataFrame([("d", 1, 0, "Ann"), ("d", 1, 10, "She"), ("d", 2, 20, "Bob")], "doc_id string, cluster_id int, start_offset int, text string")
    a = spark.createDataFrame([("d", 5, 1, 10, "She"), ("d", 6, 2, 24, "saw")], "doc_id string, arg_id int, sent_num int, start_offset int, text string")
    got = {r.arg_id: (r.full_text, r.size, r.cluster_mentions) for r in linking.argument_contexts(a, m, s).collect()}
    assert got == {5: (["She won.", "Ann ran. "], 3, "[(0) Ann, (10) She]"), 6: (["Bob saw."], 1, "")}


def test_tagged_arguments_are_cleaned(spark):
    from glossweave.functions.annotators import word_tokens

    args = spark.createDataFrame([("d", 0, "the mayor of Acme", 3), ("d", 1, "of", 40), ("d", 2, "Acme at", 50)], "doc_id string, arg_id int, text string, start_offset int").withColumn("tokens", word_tokens(F.col("text"), F.col("start_offset")))
    assert {r.arg_id: (r.clean, r.clean_offset) for r in linking.cleaned_arguments(args).collect()} == {0: ("mayor of Acme", 7), 1: ("", None), 2: ("Acme", 50)}
    kb = spark.createDataFrame([("E1", "Acme", "ORGANIZATION", 9.0), ("E2", "mayor of Acme", "PERSON", 4.9)], "id string, name string, typ string, prior double")
    none = spark.createDataFrame([], "doc_id string, cluster_id int, start_offset int, text string")
    got = pipelines.baseline(pipelines.Tables(args, None, none, None, None, kb)).collect()
    assert [(r.arg_id, r.start_offset, r.text, r.id) for r in got] == [(2, 50, "Acme at", "E1")]  # the other prior is below the least score


def test_three_systems(spark):
    docs = spark.createDataFrame([("d", "Scott Peterson met Peterson. He left.")], "ext_id string, text string")
    e = spark.createDataFrame([("d", 0, "Scott Peterson", 0, "Scott Peterson", "PERSON"), ("d", 1, "Peterson", 19, "Peterson", "PERSON")], "doc_id string, ent_no int, text string, start_offset int, name string, entity_type string")
    args = spark.createDataFrame([("d", 0, "Scott Peterson", 0), ("d", 1, "Peterson", 19), ("d", 2, "He", 29)], "doc_id string, arg_id int, text string, start_offset int")
    m = spark.createDataFrame([("d", 1, 19, "Peterson"), ("d", 1, 29, "He")], "doc_id string, cluster_id int, start_offset int, text string")
    kb = spark.createDataFrame([("E1", "Scott Peterson", "PERSON", 9.0), ("E2", "Peterson", "CITY", 1.0)], "id string, name string, typ string, prior double")
    places = spark.createDataFrame([("X", "CITY", "Y", "PROVINCE")], "name string, typ string, cont_name string, cont_typ string")
    got = pipelines.compare(pipelines.Tables(args, e, m, docs, places, kb)).collect()
    by = {s: sorted((r.arg_id, r.id) for r in got if r.system == s) for s in ("BASELINE", "RULES", "COREF")}
    assert by == {"BASELINE": [(0, "E1")], "RULES": [(0, "E1"), (1, "E1")], "COREF": [(0, "E1"), (1, "E1"), (2, "E1")]}
