from pyspark.sql import functions as F

from glossweave.operators import coref, evaluate, gazetteer, resolve, spans

E = "doc_id string, ent_no int, text string, start_offset int, name string, entity_type string"


def ents(spark, rows):
    return resolve.entities(spark.createDataFrame([("d", i, t, o, n or t, k) for i, (t, o, n, k) in enumerate(rows)], E))


def test_person_affix_takes_the_nearest(spark):
    rows = [("Scott Peterson", 10, None, "PERSON"), ("Laci Peterson", 100, None, "PERSON"), ("Peterson", 120, None, "PERSON"), ("Dr. Scott Lee Peterson", 130, None, "PERSON"), ("Smith", 140, None, "PERSON")]
    got = {r.ent_no: (r.best_name, r.candidate_count) for r in resolve.person_affix(ents(spark, rows)).collect()}
    assert got == {2: ("Laci Peterson", 0.5)}


def test_organisation_rules(spark):
    rows = [("CDC", 50, None, "ORGANIZATION"), ("U.S. Centers for Disease Control", 10, None, "ORGANIZATION"), ("Boeing", 60, None, "ORGANIZATION"), ("Boeing Company", 90, None, "ORGANIZATION"), ("Micro", 95, None, "ORGANIZATION"), ("Microsoft", 99, None, "ORGANIZATION")]
    e = ents(spark, rows)
    assert [(r.ent_no, r.best_name) for r in resolve.organisation_acronym(e).filter("ent_no = 0").collect()] == [(0, "Centers for Disease Control")]
    assert [(r.ent_no, r.best_name) for r in resolve.organisation_affix(e).collect()] == [(2, "Boeing Company")]
    assert [(r.ent_no, r.best_name) for r in resolve.organisation_prefix(e).filter("ent_no = 4").collect()] == [(4, "Microsoft")]
    blocked = ents(spark, [*rows, ("Boeing Field", 5, None, "LOCATION")])
    assert resolve.organisation_affix(blocked).count() == 0


def places(spark):
    return gazetteer.places(spark.createDataFrame([("Seattle (CITY) Washington (PROVINCE) United States (COUNTRY)",), ("Washington (PROVINCE)",), ("none",)], "line string"))


def test_gazetteer(spark):
    g = places(spark)
    assert {tuple(r) for r in g.collect()} == {("Seattle", "CITY", "Washington", "PROVINCE"), ("Washington", "PROVINCE", "United States", "COUNTRY"), ("Washington", "PROVINCE", None, None)}
    assert gazetteer.names(g).filter("is_country = 1").count() == 0
    assert [tuple(r) for r in gazetteer.containment(g).collect()] == [("washington", "seattle")]
    df = spark.createDataFrame([("Seattle, WA",), ("Seattle, Wash.",), ("Seattle",), ("Boston, WA",)], "t string")
    assert {r.t: r.expanded for r in gazetteer.expand_locations(df, "t", g).collect()} == {"Seattle, WA": "Seattle, Washington", "Seattle, Wash.": "Seattle, Washington", "Seattle": "Seattle", "Boston, WA": "Boston, WA"}


def test_location_rules(spark):
    g = places(spark)
    e = ents(spark, [("Seattle", 100, None, "LOCATION"), ("x", 5, "Seattle , Washington", "LOCATION")])
    assert [r.best_name for r in resolve.location_in_name(e, g).filter("ent_no = 0").collect()] == ["Seattle, Washington"]
    e = ents(spark, [("Seattle", 100, None, "LOCATION"), ("Washington", 200, None, "LOCATION")])
    docs = spark.createDataFrame([("d", "The rain in Seattle, Washington was heavy. met Scott Peterson yesterday again")], "ext_id string, text string")
    raw = spark.createDataFrame([("d", 0, "Seattle", 100, "Seattle", "LOCATION"), ("d", 1, "Washington", 200, "Washington", "LOCATION"), ("d", 2, "Nobody", 9, "Nobody", "OTHER")], E)
    got = {r.ent_no: (r.kind, r.best_mention, r.candidate_count) for r in resolve.resolve(raw, docs, g).collect()}
    assert got == {0: ("Container", "Seattle, Washington", 1.0), 1: ("Identity", "Washington", 1.0), 2: ("Identity", "Nobody", 1.0)}
    alone = resolve.location_in_text(e.filter("ent_no = 0"), docs, g).collect()
    assert [(r.contained, r.container_name, r.best_offset) for r in alone] == [("Seattle", "Washington", 12)]
    p = ents(spark, [("Peterson", 60, None, "PERSON")])
    assert [r.best_name for r in resolve.person_in_text(p, docs).collect()] == ["Scott Peterson"]


def test_entity_runs(spark):
    rows = [("d", 0, i, t, 10 * i, 10 * i + len(t), n) for i, (t, n) in enumerate([("Scott", "PERSON"), ("Peterson", "PERSON"), ("met", "O"), ("Acme", "ORGANIZATION"), ("Paris", "LOCATION")])]
    t = spark.createDataFrame(rows, "doc_id string, sent_num int, tok_no int, text string, begin int, end int, ner string")
    assert {(r.name, r.entity_type) for r in resolve.entity_runs(t).collect()} == {("Scott Peterson", "PERSON"), ("Acme", "ORGANIZATION"), ("Paris", "LOCATION")}


def test_coref_expansion(spark):
    m = spark.createDataFrame([("d", 1, 0, "Smith"), ("d", 1, 30, "he"), ("d", 1, 50, "she"), ("d", 2, 80, "Acme"), ("d", 2, 90, "it")], "doc_id string, cluster_id int, start_offset int, text string")
    best = spark.createDataFrame([("d", 0, "John Smith", "Full", "PERSON", 1.0), ("d", 80, "Acme", "Identity", "ORGANIZATION", 1.0)], "doc_id string, start_offset int, best_mention string, kind string, entity_type string, candidate_count double")
    links = lambda ids: spark.createDataFrame([("d", 80, i, f"Acme {i}", ["organization.organization"]) for i in ids] or [], "doc_id string, start_offset int, id string, name string, types array<string>")
    got = {(r.start_offset, r.kind, r.best_mention) for r in coref.expand(m, links(["m1"]), best).collect()}
    assert got == {(30, "CorefFull", "John Smith"), (90, "LinkResolved", "Acme m1")}
    got = {(r.start_offset, r.kind) for r in coref.expand(m, links(["m1", "m2"]), best).collect()}
    assert got == {(30, "CorefFull"), (90, "CorefIdentity")}
    # what is full by its kind stays full, with the count it has
    for kind, want in [("CorefFull", ("CorefFull", 0.5)), ("LinkResolved", ("CorefFull", 0.5)), ("CorefIdentity", ("CorefFull", 0.5)), ("Container", ("Coref", 0.5)), ("Plain", ("Coref", 0.5)), ("Identity", ("CorefIdentity", 1.0))]:
        b = spark.createDataFrame([("d", 0, "John Smith", kind, "PERSON", 0.5)], best.schema)
        assert [(r.kind, r.candidate_count) for r in coref.expand(m, links([]), b).filter("start_offset = 30").collect()] == [want]


def test_cluster_agreement(spark):
    S = "struct<text:string,start_offset:int,name:string,entity_type:string>"
    e = lambda t, o: (t, o, t, "PERSON")
    rows = [("d", 0, "Full", e("old  Smith", 0), e("John Smith", 50)), ("d", 1, "Full", e("Lee", 20), e("John Smith", 50)), ("d", 2, "Full", e("Lee", 20), e("Nobody", 90)), ("d", 3, "Identity", e("Smith", 4), e("John Smith", 50))]
    b = spark.createDataFrame(rows, f"doc_id string, bem_index int, kind string, target {S}, best {S}")
    # mentions lie within the spans, they need not be the spans; one of two clusters belongs to the last
    m = spark.createDataFrame([("d", 1, 4, "Smith"), ("d", 1, 55, "Smith"), ("d", 2, 20, "Lee"), ("d", 0, 20, "Lee")], "doc_id string, cluster_id int, start_offset int, text string")
    assert {r.bem_index: r.agrees for r in evaluate.cluster_agreement(b, m).collect()} == {0: 1.0, 1: -1.0, 2: 0.0}


def test_best_links_and_positions(spark):
    L = "doc_id string, start_offset int, text string, id string, score double, name string, types array<string>"
    l = spark.createDataFrame([("d", 1, "x", "b", 9.0, "B", None), ("d", 1, "x", "a", 9.0, "A", ["us.state"]), ("d", 1, "x", "c", 7.0, "C", None), ("d", 2, "y", "a", 4.9, "A", None), ("d", 3, "z", None, 9.0, "A", None), ("d", 4, "z", "a", None, "A", None)], L)
    assert [(r.start_offset, r.id) for r in coref.best_links(l).collect()] == [(1, "a")]
    assert [tuple(r) for r in coref.link_entities(coref.best_links(l)).collect()] == [("d", "x", 1, "A", "LOCATION")]
    b = spark.createDataFrame([("d", 3, "Full", "A B", ("B", 7)), ("d", 5, "Identity", "C", ("C", 8)), ("d", 9, "Full", "D", ("E", 1))], "doc_id string, bem_index int, kind string, best_mention string, target struct<text:string,start_offset:int>")
    assert {(r.bem_index, r.position) for r in evaluate.positions(b).collect()} == {(3, 0), (9, 1)}
    labels = spark.createDataFrame([("d", 1, 1), ("d", 7, 0), ("x", 0, 1)], "doc_id string, bem_index int, label int")
    assert [(r.of_all, r.label, r.best_mention) for r in evaluate.labelled_mentions(labels, b).collect()] == [(9, 1, "D")]


def test_expansion_of_repeated_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Seattle, WA", "Boston", "Seattle, Wash.", None] * 20)], "i int, t string").repartition(7)
    want = {"Seattle, WA": "Seattle, Washington", "Boston": "Boston", "Seattle, Wash.": "Seattle, Washington", None: None}
    got = gazetteer.expand_locations(df, "t", places(spark)).collect()
    assert len(got) == 80 and all(r.expanded == want[r.t] for r in got)


def test_places_need_their_form(spark):
    g = gazetteer.places(spark.createDataFrame([("A b(CITY)  C (PROVINCE 12) D (COUNTRY of E)",), ("X (CITY x)",)], "line string"))
    assert {tuple(r) for r in g.collect()} == {("A b", "CITY", "C", "PROVINCE")}


def test_spans(spark):
    s = spark.createDataFrame([("d", 1, 0, 5), ("d", 2, 3, 7), ("d", 3, 5, 9), ("d", 4, 500, 1500)], "doc_id string, inner_id int, start int, end int")
    assert [r.inner_id for r in spans.greedy(s, ["doc_id"]).orderBy("inner_id").collect()] == [1, 3, 4]
    o = s.withColumnRenamed("inner_id", "outer_id")
    rows = s.collect()
    over = {(a.inner_id, b.inner_id) for a in rows for b in rows if b.start < a.end and b.end > a.start}
    assert {(r.outer_id, r.inner_id) for r in spans.overlapping(o, s).collect()} == over
    inside = {(a.inner_id, b.inner_id) for a in rows for b in rows if b.start >= a.start and b.end <= a.end}
    assert {(r.outer_id, r.inner_id) for r in spans.within(o, s).collect()} == inside


def test_precision_curve_and_link_diff(spark):
    d = spark.createDataFrame([(1, 0.9, "a"), (0, 0.8, "b"), (1, 0.7, "c"), (1, 0.6, "d"), (None, 0.5, "e")], "y int, c double, k string")
    got = [(round(r.precision, 3), round(r.smoothed, 3)) for r in evaluate.precision_curve(d, "y", "c", ["k"]).orderBy("rank").collect()]
    assert got == [(1.0, 1.0), (0.5, 0.75), (0.667, 0.75), (0.75, 0.75)]
    L = "doc_id string, start_offset int, text string, id string"
    a, b = spark.createDataFrame([("d", 10, "Seattle", "m1"), ("d", 20, "Acme", "m2")], L), spark.createDataFrame([("d", 10, "Seattle", "m1"), ("d", 20, "Acme", "m3")], L)
    assert {(r.id, r.system) for r in coref.link_diff(a, b).collect()} == {("m2", "BASELINE"), ("m3", "NEW")}


def test_empty_inputs(spark):
    e = resolve.entities(spark.createDataFrame([], E))
    assert resolve.person_affix(e).count() == resolve.organisation_affix(e).count() == resolve.organisation_acronym(e).count() == 0
    assert evaluate.precision_curve(spark.createDataFrame([], "y int, c double, k string"), "y", "c", ["k"]).count() == 0
    assert spans.greedy(spark.createDataFrame([], "doc_id string, inner_id int, start int, end int"), ["doc_id"]).select(F.count("*")).first()[0] == 0


def test_locations_stand_anywhere(spark):
    g = places(spark)
    e = ents(spark, [("Seattle", 100, None, "LOCATION"), ("Washington", 100, None, "LOCATION")])
    for text, want in [("Rain (Seattle, Washington) fell", 6), ('"SEATTLE, Washington is', 1), ("To Boston-Seattle, WA now", 10), ("see Nowhere, Seattle, Washington now", 13)]:
        docs = spark.createDataFrame([("d", text)], "ext_id string, text string")
        got = [(r.ent_no, r.container_name, r.best_offset) for r in resolve.location_in_text(e, docs, g).collect()]
        assert got == [(0, "Washington", want)], text
