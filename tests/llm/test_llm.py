"""Each operator against brute force, a round trip or planted cases, and on nulls, empty tables, ties, repeats and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import canonical, catalog, charforms, markup, mixing, neardup, packing, pii, rankfusion, sentences, tokens, variants
from glossweave.llm.components import components


# ---- 1 markup ------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model(sf):
    import duckdb

    texts = [t for (t,) in duckdb.execute(f"select text from '{sf}/documents.parquet' order by doc_id").fetchall()]
    return markup.train([t for t in texts if not markup.SUSPECT.search(t)])


@pytest.mark.parametrize("text, clean", [
    ("<p>One <b>two</b> three.</p>", "One two three."), ("== Head ==\ntext [[Port|harbour]] and [[quay]].", "# Head\ntext harbour and quay."), ("## Title\n- item\n**bold** `x`", "# Title\n- item\nbold x"),
    ("\\section{Top}\n\\begin{itemize}\n\\item One \\textbf{two}.\n\\end{itemize}", "# Top\n\n- One two."), ("```\nif (a < b && c > d) {\n```", "    if (a < b && c > d) {"), ("A &amp; B &lt;i&gt;", "A & B "), ("$$a^2 + b^2$$", "a^2 + b^2"),
])
def test_markup_becomes_text(model, text, clean):
    found = markup._batch([text], model)[0]
    assert any(x[3] >= 0.5 for x in found)
    assert markup.clean(text, found).strip() == clean.strip()


@pytest.mark.parametrize("text", ["If x < 8 and y > 7, it costs $5 to $9.", "They wrote 2^11 - 1 and ~85 of R&D [sic].", "C:\\storm\\new_list held 19 * 5 * 2 #7", "for i in range(7):\n    total += rows[i]['qty']\n}", "- a\n- b\n1. c", "Smith & Sons, snake_case_id >= 3", ""])
def test_plain_use_is_no_markup(model, text):
    found = markup._batch([text], model)[0]
    assert not any(x[3] >= 0.5 for x in found)


def test_marginals_equal_enumeration(model):
    import itertools

    f = markup.Forest()
    f.plant(0, "a **b** {\n<i>x * y\n2 ^ 3</i> z")
    states = [{0: 5, 1: 15, 2: 2}[t] for t in f.typ]
    assert f.typ.count(1) == 3 and max(f.depth) == 4 and len(f.typ) == 9  # the element <i> holds the line after its own
    total, on = 0.0, np.zeros(len(states))
    for xs in itertools.product(*map(range, states)):
        w = model.root[xs[0]]
        for i in range(1, len(states)):
            up = f.parent[i]
            pk = f.kind[up] + 1 if f.typ[up] == 2 else 0
            w += model.line[pk, xs[up], xs[i]] + model.look[xs[i] % 3, f.look[i]] if f.typ[i] == 1 else model.child[pk, xs[up], f.kind[i], xs[i]]
        total += np.exp(w)
        on += np.exp(w) * (np.array(xs) == 1)
    items = np.array(f.typ) == 2
    assert np.allclose((on / total)[items], model.marginals(f)[items])


def test_trees():
    text = "{{box|\n[[a|b]] '''c''' d\n}} \\textbf{x {y} z} <ul>\n<li>e <b>f</li>\n</ul></p>"
    own = markup.pieces(text)
    other = markup.partners(text, own)
    spans = {text[own[i][1] : own[j][2]] for i, j in enumerate(other) if j > i}
    assert {"{{box|\n[[a|b]] '''c''' d\n}}", "[[a|b]]", "'''c'''", "\\textbf{x {y} z}", "{y}", "<ul>\n<li>e <b>f</li>\n</ul>", "<li>e <b>f</li>"} <= spans
    assert other[[text[s:e] for _, s, e in own].index("</p>")] == -1
    long = "<b>" * 30_000 + "</i>" * 30_000  # nothing closes: linear all the same
    assert set(markup.partners(long, markup.pieces(long))) == {-1}


def test_labelled_pages_have_both_outcomes(model):
    rng = np.random.default_rng(5)
    seen, right, n = {}, 0, 0
    for _ in range(600):
        _, text, syntax, roles = markup.labelled_page(rng, ["One line of words to take.", "Another one, with more of them."])
        assert len(roles) == text.count("\n")
        f = markup.Forest()
        f.plant(0, text)
        if f.typ:
            p = model.marginals(f)
            for node, (_, k, s, e, _) in zip(f.node, f.pieces):
                y = any(a < e and s < b for a, b in syntax)
                seen.setdefault(markup.NAMES[k], set()).add(y)
                right, n = right + ((p[node] >= 0.5) == y), n + 1
    assert right / n > 0.97 and sum(len(v) == 2 for v in seen.values()) >= 8


def test_long_lines_are_looked_at_whole():
    long = "some words with a_sign and *another " * 20
    for line, want in [(long + ";", 1), (long + "{ ", 1), (long, 0), ("for " + long.replace("*", "_") + "(", 1), ("}" * 500, 1)]:
        f = markup.Forest()
        f.plant(0, "first\n" + line + "\nlast")
        assert [x for t, x in zip(f.typ, f.look) if t == 1] == [want], line


def test_long_constructs_are_taken_whole(model):
    words = ("many words of a note " * 400).strip()
    for text, clean in [(f"a \\footnote{{{words}}} b", f"a  ({words}) b"), (f"a {{{{note|{words}}}}} b", "a  b"), (f"[https://e.example/ {words}] c", f"{words} c"), (f"<!-- {words} --> d", " d")]:
        assert markup.clean(text, markup._batch([text], model)[0]).strip() == clean.strip(), text[:20]


def test_few_texts_leave_the_tasks(spark):
    df = spark.createDataFrame([(f"clean text number {i}",) for i in range(9000)], "text string").repartition(8)
    assert markup.fit(df, "text").root.shape == (5,)


def test_markup_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "<DOC id=\"x\">\n", 9), (4, "<b>x</b> " * 20000, 9)], "id int, text string, clean2 int")
    got = {r.id: r for r in markup.residue(df, "text", ["id"], frames=True).collect()}
    assert got[1].clean is None and got[2].clean == "" and got[3].pieces == 0 and "<" not in got[4].clean and got[4].pieces == 40000
    assert markup.residue(df.filter("false"), "text", ["id"]).count() == 0


# ---- 2 names ---------------------------------------------------------------------------------------------------------------

def test_name_variants(spark):
    people = ["Leon Fisabasko"] * 9 + ["FISABASKO, Leon", "leon fisabasko", "Leon Fisabsako", "L. Fisabasko", "Fisabasko L", "Tomas Fisabasko", "Tomas Fisabasko", "Charles Buliveno", "Chuck Buliveno", "Lucia Buliveno", "C. Buliveno", "Nicholas \"Nick\" Ra", "Nick Ra", "Solo"]
    orgs = ["Pedepon Glass Corporation", "Pedepon Glass Corp.", "The Pedepon Glass", "Vofidon Foods Brothers Incorporated", "Vofidon Mining Brothers Incorporated", "Institute for Glass Research (Fago)", "Fago Inst. for Glass Research"]
    df = spark.createDataFrame([(n, "PERSON") for n in people] + [(n, "ORGANIZATION") for n in orgs] + [(None, "PERSON"), ("x", None), ("City", "LOCATION"), (" ", "PERSON")], "name string, kind string").withColumn("entity", F.lit(1))
    got = variants.resolve(df, "name", "kind")
    sets = {}
    for r in got.collect():
        sets.setdefault((r.kind, r.entity), set()).add(r.name)
    found = sorted(map(sorted, sets.values()))
    assert sorted(["Leon Fisabasko", "FISABASKO, Leon", "leon fisabasko", "Leon Fisabsako", "L. Fisabasko", "Fisabasko L"]) in found
    assert ["C. Buliveno", "Charles Buliveno", "Chuck Buliveno"] in found and ["Tomas Fisabasko"] in found and ["Solo"] in found
    assert ["Nicholas \"Nick\" Ra", "Nick Ra"] in found
    assert ["Pedepon Glass Corp.", "Pedepon Glass Corporation", "The Pedepon Glass"] in found and ["Vofidon Mining Brothers Incorporated"] in found
    assert ["Fago Inst. for Glass Research", "Institute for Glass Research (Fago)"] in found
    assert variants.pairs(got).filter("name_a >= name_b").count() == 0
    assert variants.resolve(df.filter("false"), "name", "kind").count() == 0


def test_real_surnames_near_each_other(spark):
    """The larger the corpus, the more real surnames lie within an edit or two of a more frequent one; they and their own slips stay theirs."""
    people = ["Rebecca Trevokuner"] * 60 + ["Alexander Trevokuner"] * 60 + ["Walter Trekovuner"] * 12 + ["WALTER TREKOVUNER"] * 2 + ["W. Trekovuner"] * 2 + ["Alexander Trekovuner"] * 10 + ["Trekovuner, Alexander"] * 2
    people += ["Walter Trekvuner"] * 2 + ["Rebecca Trevokunner"] * 2 + ["Rebecca Trevoknuer", "R. Trevoknuer"]
    got = variants.resolve(spark.createDataFrame([(n, "PERSON") for n in people], "name string, kind string"), "name", "kind")
    assert {tuple(r) for r in variants.pairs(got).collect()} == {
        ("W. Trekovuner", "WALTER TREKOVUNER"), ("WALTER TREKOVUNER", "Walter Trekovuner"), ("WALTER TREKOVUNER", "Walter Trekvuner"), ("W. Trekovuner", "Walter Trekovuner"), ("W. Trekovuner", "Walter Trekvuner"),
        ("Walter Trekovuner", "Walter Trekvuner"), ("Alexander Trekovuner", "Trekovuner, Alexander"), ("Rebecca Trevokuner", "Rebecca Trevokunner"), ("Rebecca Trevoknuer", "Rebecca Trevokuner"), ("Rebecca Trevoknuer", "Rebecca Trevokunner"),
        ("R. Trevoknuer", "Rebecca Trevoknuer"), ("R. Trevoknuer", "Rebecca Trevokuner"), ("R. Trevoknuer", "Rebecca Trevokunner"),
    }


def test_spellings_of_texts(spark, tmp_path):
    rows = [("Leon\nFisabasko", "Leon Fisabasko"), ("Fisabasko", "Leon Fisabasko"), ("Fis\u00e1basko", "Leon Fisabasko"), ("Le\u200bon Fisab\u0430sko", "Leon Fisabasko"), ("Leon Fisabsako", "Leon Fisabasko"), ("FISABASKO, Leon", "FISABASKO, Leon"), (None, "L. Fisabasko"), ("Tomas Fisabasko", None)]
    spark.createDataFrame([(t, n, "PERSON") for t, n in rows] + [("Here", "There", "LOCATION")], "text string, name string, entity_type string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([("Leon Fisabasko", ("PERSON",))], "best_mention string, target struct<entity_type string>").write.parquet(f"{tmp_path}/best_mentions.parquet")
    got = {r.name: r.entity for r in catalog.p2_entities(spark, str(tmp_path)).collect()}
    assert set(got) == {x for r in rows for x in r if x}
    leon = {n for n, e in got.items() if e == got["Leon Fisabasko"]}
    assert leon == {"Leon Fisabasko", "Leon\nFisabasko", "Le\u200bon Fisab\u0430sko", "Leon Fisabsako", "FISABASKO, Leon", "L. Fisabasko"}
    assert got["Fisabasko"] == got["Fis\u00e1basko"] == "Fisabasko" and got["Tomas Fisabasko"] == "Tomas Fisabasko"
    assert {tuple(r) for r in catalog.p2_found(spark, str(tmp_path)).collect()} == {("FISABASKO, Leon", "L. Fisabasko"), ("FISABASKO, Leon", "Leon Fisabasko"), ("L. Fisabasko", "Leon Fisabasko")}


# ---- 3 ranks ---------------------------------------------------------------------------------------------------------------

def test_fused_ranks_by_either_way(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), rng.choice([None, float("nan"), *map(float, range(9))]), rng.choice([None, 1.0, 2.0]), "x") for _ in range(600)] + [("a", None, 99.0, 99.0, "x")]
    df = spark.createDataFrame(rows, "k string, item int, s double, t double, fused string")
    slow = {}
    best = {}
    for k, i, s, t, _ in rows:
        if i is not None:
            b = best.setdefault((k, i), [None, None])
            for j, v in enumerate((s, t)):
                if v is not None and v == v and (b[j] is None or v > b[j]):
                    b[j] = v
    for (k, i), b in best.items():
        peers = [v for (kk, _), v in best.items() if kk == k]
        low = lambda v: float("-inf") if v is None else v
        slow[k, i] = tuple(1 + sum(low(p[j]) > low(b[j]) for p in peers) for j in range(2))
    for hot in (100_000, 50):  # one window per group, or spread over buckets
        got = {(r.k, r.item): (r.rank_s, r.rank_t) for r in rankfusion.fuse(df, ["k"], "item", ["s", "t"], hot_rows=hot).collect()}
        assert got == slow
    assert rankfusion.first_of(rankfusion.fuse(df.filter("false"), ["k"], "item", ["s", "t"]), ["k"], "item").count() == 0


# ---- 4 canonical list ------------------------------------------------------------------------------------------------------

def test_values_to_canonical_list(spark):
    kb = spark.createDataFrame([(1, "Astegobridge", "x"), (2, "University of Astegobridge", "x"), (3, "Port Harlow", "x"), (4, "Scott Peterson", "x"), (5, None, "x"), (None, "None", "x"), (6, "Ormuma Province", "x")], "id int, name string, text string")
    cases = {"astegobrigde": 1, "Univ. of Astegobridge": 2, "Astegobridge, University of": 2, "UniversityofAstegobridge": 2, "Astégobridge (Ormuma Province)": 1, "Port Harlw": 3, "Harlow": None, "PETERSON, Scott": 4, "Scott Miller": None, "???": None, "": None, None: None, "Ormuma Prov., x": 6}
    got = {r.text: r.id for r in canonical.map_values(spark.createDataFrame([(c, 1) for c in [*cases, "Port Harlw"]], "text string, id int"), "text", kb, "id", "name").collect()}
    assert got == cases
    assert canonical.map_values(spark.createDataFrame([("a",)], "text string"), "text", kb.filter("false"), "id", "name").first().id is None


def test_repairs_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(120)]

    def osa(a, b):
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    left, right = sorted(set(words[:60])), sorted(set(words[60:]))
    want = {(a, b) for a in left for b in right if a == b or (a not in right and len(a) >= 3 and osa(a, b) <= (2 if len(a) >= 6 else 1) and len(b) >= 3)}
    got = {(r.token, r.word) for r in canonical.repairs(spark.createDataFrame([(w,) for w in left], "token string"), spark.createDataFrame([(w,) for w in right], "word string")).collect()}
    assert got == want


def test_distance_equals_dynamic_programming(spark):
    rng = random.Random(8)

    def osa(a, b):
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    pairs = [("ca", "abc"), ("abcdef", "badcef"), ("", "a"), ("ab", "ba"), ("abcd", "bacd"), ("abcd", "badc"), ("a", "a")]
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            r = rng.random()
            if r < 0.4 and i + 1 < len(b):
                b[i], b[i + 1] = b[i + 1], b[i]
            elif r < 0.6:
                b.insert(i, rng.choice("abc"))
            elif i < len(b):
                b[i : i + 1] = [rng.choice("abc")] if r < 0.8 else []
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", canonical._distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == min(3, osa(r.a, r.b)) for r in got)


def test_short_forms_come_from_the_list(spark):
    kb = spark.createDataFrame([(i, f"{w} Glacier Observatory") for i, w in enumerate(["Alpha", "Beta", "Gamma"])] + [(9, "Scott Peterson")], "id int, name string")
    values = spark.createDataFrame([("Alpha Glac. Obs.",), ("Beta Glacier Observ",), ("Scott Peter",)], "t string")
    assert {r.t: r.id for r in canonical.map_values(values, "t", kb, "id", "name").collect()} == {"Alpha Glac. Obs.": 0, "Beta Glacier Observ": 1, "Scott Peter": None}


# ---- 5 near duplicates -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("k, t", [(3, 0.5), (5, 0.8), (1, 0.6)])
def test_pairs_equal_brute_force(spark, k, t):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(1, 60))]
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [texts[0]] * 5 + ["", " ", "one two"]
    rows = [(i, x, 0) for i, x in enumerate(texts)] + [(10_000, None, 0), (0, texts[0], 0)]
    sets = [{tuple(x.lower().split()[j : j + k]) for j in range(len(x.split()) - k + 1)} for x in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
    df = spark.createDataFrame(rows, "doc_id int, text string, fp int")
    assert {(r.doc_id_a, r.doc_id_b) for r in neardup.pairs(df, "doc_id", "text", k, t).collect()} == want
    assert {(r.doc_id_a, r.doc_id_b) for r in neardup.pairs(df, "doc_id", "text", k, t, part=1500, block=3, hot=2).collect()} == want  # by blocks
    got = neardup.groups(df, "doc_id", "text", k, t).collect()
    group = {r.doc_id: r.group_id for r in got}
    assert all(group[a] == group[b] for a, b in want) and set(group) == {i for i, s in enumerate(sets) if s}


def test_groups_have_every_document(spark, tmp_path):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long), (2, long.upper()), (3, long + " more"), (4, "One  two"), (5, "one\ntwo"), (6, "two one"), (7, ""), (8, " "), (9, None), (10, None), (11, "同じ文。 同じ文。"), (12, "同じ文。 同じ文。"), (13, "one two three four"), (14, "one two three four five")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.p5_groups(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 15))
    by = lambda c: sorted(sorted(r.doc_id for r in got if r[c] == x) for x in {r[c] for r in got})
    assert all(r.first_of_group <= r.first_of_class <= r.doc_id for r in got)
    assert by("first_of_class") == [[1, 2], [3], [4, 5], [6], [7, 8], [9, 10], [11, 12], [13], [14]]
    assert by("first_of_group") == [[1, 2, 3], [4, 5], [6], [7, 8], [9, 10], [11, 12], [13], [14]]
    assert {r.doc_id for r in got if r.links} == {1, 2, 3}


def test_sketch_by_either_way(spark):
    df = spark.createDataFrame([(f"w{i % 7} w{i % 5} w{i % 3} w{i % 11}",) for i in range(400)], "text string")
    assert neardup._sketch(df.coalesce(1), "text", 3) == neardup._sketch(df.repartition(80), "text", 3)  # at once, and in groups first
    assert len(b"".join(neardup._sketch(df, "text", 3))) < 1 << neardup.SKETCH_BITS


def test_cells_cover_every_pair_once():
    fp = np.arange(40, dtype=np.int64) * 7919
    row, cell, side = neardup._cells(np.full(40, 5, np.int64), fp, np.full(40, 6, np.int64))
    seen = {}
    for c in set(cell.tolist()):
        own = [(int(r), int(s)) for r, s in zip(row[cell == c], side[cell == c])]
        for i, (a, s) in enumerate(own):
            for b, t in own[i + 1 :]:
                if (s == t == 0) or s != t:
                    seen[min(a, b), max(a, b)] = seen.get((min(a, b), max(a, b)), 0) + 1
    assert seen == {(a, b): 1 for a in range(40) for b in range(a + 1, 40)}


def test_near_duplicates_of_nothing(spark):
    assert neardup.pairs(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text").count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1)], "a int, b int")
    assert {tuple(r) for r in components(e, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert components(e.filter("false"), "a", "b").count() == 0


# ---- 6 character forms -----------------------------------------------------------------------------------------------------

def test_one_form(spark):
    cases = {"Ｗｉｄｅ １２": "Wide 12", "cafe\u0301": "café", "a\u200bb\u00adc": "abc", "a\u00a0b\u2009c": "a b c", "ﬁne … \u2011": "fine ... -", "Аbоut": "About", "мoст": "мост", "музей с Port": "музей с Port", "！？「あ」 № “q” – é": "！？「あ」 № “q” – é", "क्\u200dष": "क्\u200dष", "": "", None: None, "line\nbreak": "line\nbreak", "\u212aelvin": "Kelvin", "\u210e\u2124 3\uff0e5 \u2024\u2024": "hZ 3.5 ..", "№ ™ x²": "№ ™ x²", "\u2f00": "一", "\u03d1": "θ"}
    df = spark.createDataFrame([(c, 1) for c in cases], "x string, normal int")
    got = {r.text: r.normal for r in charforms.one_form(df, "x", []).collect()}
    assert got == cases
    again = charforms.one_form(charforms.one_form(df, "x", []).select(F.col("normal").alias("x")), "x", []).collect()
    assert all(r.text == r.normal for r in again)
    assert charforms.one_form(df.filter("false"), "x", []).count() == 0


# ---- 7 sentences -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("text, want", [
    ("The orchard, etc. were sold. Dr. Leon J. Smith came at 5 p.m. on Monday. It cost 4.5 crowns.", ["The orchard, etc. were sold.", "Dr. Leon J. Smith came at 5 p.m. on Monday.", "It cost 4.5 crowns."]),
    ('"Stop it!" shouted a voice. "Was it?" asked Ann. eVarro won.', ['"Stop it!" shouted a voice.', '"Was it?" asked Ann.', "eVarro won."]), ("At 5 a.m. Ann left.Bob stayed.", ["At 5 a.m. Ann left.", "Bob stayed."]),
    ("Head line\nFirst one. Second", ["Head line", "First one.", "Second"]), ("法院说“够了。不必。”并离开！他走了。", ["法院说“够了。不必。”并离开！", "他走了。"]), ("Am 3. März z.B. ca. 4 Mio. Kronen. Ende.", ["Am 3. März z.B. ca. 4 Mio. Kronen.", "Ende."]),
    ("उसने कहा। वह गया।", ["उसने कहा।", "वह गया।"]), ("ศาลขายข้าว โทร:01 99 00 ศาลปิด", ["ศาลขายข้าว", "โทร:01 99 00", "ศาลปิด"]), ("متى؟ الآن.", ["متى؟", "الآن."]), ("Write to a.b@c.example. See www.x.example/a?b=1 now.", ["Write to a.b@c.example.", "See www.x.example/a?b=1 now."]),
])
def test_sentences(spark, text, want):
    got = sentences.sentences(spark.createDataFrame([(1, text)], "id int, text string"), "text", ["id"]).orderBy("sent_no").collect()
    assert [r.sentence for r in got] == want
    assert all(text[r.start_pos : r.end_pos] == r.sentence for r in got)


@pytest.mark.parametrize("width", [44, 52, 64, 72, 78])
def test_wrapped_text_of_any_width(spark, width):
    import textwrap

    text = " ".join(f"The {w} harbour of the old town was closed by the council for {n} days after the long storm." for w, n in zip(["small", "southern", "remote", "northern", "crowded"] * 3, range(3, 99, 7)))
    of = lambda t: [re.sub(r"\s+", " ", r.sentence) for r in sentences.sentences(spark.createDataFrame([(1, t)], "id int, text string"), "text", ["id"]).orderBy("sent_no").collect()]
    assert of("Head line\n\n" + textwrap.fill(text, width)) == ["Head line", *of(text)]


def test_long_addresses_and_quotations(spark):
    mail, url = "a." * 90 + "b@" + "c." * 90 + "example", "https://e.example/" + "x.y?z" * 90
    quoted = "“" + "One two. " * 200 + "Three.”"
    text = f"Write to {mail}. See {url} now. He said {quoted}, and left. End."
    got = [r.sentence for r in sentences.sentences(spark.createDataFrame([(1, text)], "id int, text string"), "text", ["id"]).orderBy("sent_no").collect()]
    assert got == [f"Write to {mail}.", f"See {url} now.", f"He said {quoted}, and left.", "End."]


def test_pairs_within_large_groups(spark):
    df = spark.range(60).select((F.col("id") % 7 > 4).cast("int").alias("g"), F.col("id").alias("x"), F.lit(1).alias("a"))
    rows = [(r.g, r.x) for r in df.collect()]
    want = sorted((x, y) for g, x in rows for h, y in rows if g == h and x < y)
    from glossweave.llm.components import pairs_within

    for hot in (4096, 9):
        assert sorted(tuple(r) for r in pairs_within(df, ["g"], "x", hot).collect()) == want


def test_sentences_edges(spark, sf):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One. Two. " * 3000), (5, "\ue000 a\ue00fb")]
    got = sentences.sentences(spark.createDataFrame(rows, "sent_no2 int, text string"), "text", ["sent_no2"]).groupBy("sent_no2").count().collect()
    assert {r.sent_no2: r["count"] for r in got} == {4: 6000, 5: 1}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cover = sentences.sentences(docs, "text", ["doc_id"]).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", r"[\s\u00a0\u2000-\u200a\u202f]", ""))).alias("n"))
    bad = cover.join(docs, "doc_id").filter(F.col("n") != F.length(F.regexp_replace("text", r"[\s\u00a0\u2000-\u200a\u202f]", "")))
    assert bad.count() == 0


# ---- 8 containers, 9 mixing ------------------------------------------------------------------------------------------------

def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 120), "z") for i in range(2000)] + [(7, 50, "z")] * 40 + [(9000, 1050, "z"), (None, 10, "z"), (1, None, "z"), (2, 0, "z"), (3, -4, "z")]
    df = spark.createDataFrame(rows, "id int, size int, bin_no string")
    got = packing.pack(df, "id", "size", capacity=100, group_items=500).collect()
    bins, pieces = {}, {}
    for r in got:
        bins.setdefault((r.group_no, r.bin_no), []).append(r)
        pieces.setdefault((r.id, r.copy_no), []).append(r)
    assert max(sum(r.piece_size for r in b) for b in bins.values()) <= 100
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: (r.bin_offset, r.piece_size)):
            assert r.bin_offset == at
            at += r.piece_size
    assert sum(r.piece_size for r in got) == sum(s for _, s, _ in rows if s and s > 0)
    assert sorted((r.item_start, r.piece_size) for r in got if r.id == 9000) == [(i * 100, 100) for i in range(10)] + [(1000, 50)]
    assert sum(len(p) > 1 for p in pieces.values()) <= 1 + sum(s is not None and s > 100 for _, s, _ in rows) + 40
    assert packing.fill(packing.pack(df, "id", "size", capacity=100, group_items=500), 100).first().fill > 0.97
    assert packing.pack(df.filter("false"), "id", "size").count() == 0


def test_first_fit_equals_plain_scan():
    import numpy as np

    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 400)
    room, want = [], np.empty(400, int)
    for i in np.argsort(-sizes, kind="stable"):
        j = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        if j == len(room):
            room.append(100)
        room[j] -= sizes[i]
        want[i] = j
    assert (packing.first_fit_decreasing(sizes, 100) == want).all()


def test_token_counts(spark):
    t = "Hello world's 12 naïve 漢字 <|endoftext|>\n\n  x"
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    got = tokens.sizes(spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, text string"), "text", ["id"]).collect()
    assert {r.id: r.tokens for r in got} == {1: len(ref.encode(t, add_special_tokens=False).ids), 2: 0, 3: 0}


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaabbc"), rng.randrange(1, 400)) for i in range(6000)] + [(9001, None, 5), (9002, "q", 50), (9003, "a", None)]
    df = spark.createDataFrame(rows, "id int, source string, tokens int").withColumn("shard", F.lit(0))
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 1), ("c", 0.2, 2), ("none", 0.1, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    out, shares = mixing.mix(df, "id", "source", "tokens", targets, shard_tokens=50_000)
    got = {r.source: r for r in shares.collect()}
    total = sum(r.mix_tokens for r in got.values())
    for s, share in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(got[s].mix_tokens - got[s].quota_tokens) <= 200 and abs(got[s].mix_tokens / total - share) < 0.005
        assert got[s].max_used <= {"a": 1, "b": 1, "c": 2}[s]
    assert got["none"].mix_tokens == got["q"].mix_tokens == 0
    rows = out.collect()
    assert len({(r.id, r.repeat_no) for r in rows}) == len(rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.position for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert mixing.mix(df, "id", "source", "tokens", targets.filter("false"))[0].count() == 0
    assert mixing.mix(df.filter("false"), "id", "source", "tokens", targets)[0].count() == 0


def _quotas_by_hand(targets, have, total=None):
    live = {s: (w, r) for s, (w, r) in targets.items() if w and w > 0 and r and r > 0 and have.get(s, 0) > 0}
    cap = {s: have[s] * r for s, (_, r) in live.items()}
    if not live:
        return {}
    weight = sum(w for w, _ in live.values())
    if total is None:
        total = min(cap[s] * weight / w for s, (w, _) in live.items())
        return {s: min(cap[s], round(total * w / weight)) for s, (w, _) in live.items()}
    left, out, open_ = float(total), dict.fromkeys(live, 0.0), set(live)
    while open_ and left > 1e-6:
        weight = sum(live[s][0] for s in open_)
        full = {s for s in open_ if left * live[s][0] / weight >= cap[s] - out[s]}
        for s in full or open_:
            out[s] = cap[s] if s in full else out[s] + left * live[s][0] / weight
        if not full:
            break
        left = total - sum(out.values())
        open_ -= full
    return {s: min(cap[s], round(v)) for s, v in out.items()}


def test_quotas(spark):
    targets = {"a": (0.4, 1), "b": (0.3, 2), "c": (0.2, 3), "d": (0.1, 1), "e": (0.0, 1), "f": (0.5, 0)}
    have = {"a": 1000, "b": 90, "c": 400, "x": 7, "e": 5, "f": 5}
    t = spark.createDataFrame([(s, w, r) for s, (w, r) in targets.items()], "source string, target_share double, max_repeats int")
    h = spark.createDataFrame(list(have.items()), "source string, have_tokens long")
    for total in (None, 10, 500, 900, 1500, 5000):
        got = {r.source: r.quota_tokens for r in mixing.quotas(t, h, total).collect()}
        want = _quotas_by_hand(targets, have, total)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1 for s in want), total


def test_splitting_tree():
    counts = np.array([12_345, 7, 600])
    whole = list(mixing.shards_between(counts, 100, 0, 100, 3))
    assert (sum(own for _, _, own in whole) == counts).all() and {int(own.sum()) for _, _, own in whole} <= {128, 129, 130, 131}
    at = np.zeros(3, int)
    for shard, start, own in whole:  # runs without gaps
        assert (start == at).all()
        at += own
    for lo in (0, 37, 99):  # a task of its own finds the same
        part = list(mixing.shards_between(counts, 100, lo, min(lo + 20, 100), 3))
        assert [x[0] for x in part] == list(range(lo, min(lo + 20, 100))) and all((a[2] == whole[a[0]][2]).all() for a in part)


def test_mixing_a_source_of_many_blocks(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 20 == 0, "small").otherwise("large").alias("source"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 10).cast("int").alias("tokens"))
    targets = spark.createDataFrame([("large", 0.9, 1), ("small", 0.1, 3)], "source string, target_share double, max_repeats int")
    out, shares = mixing.mix(df, "id", "source", "tokens", targets, shard_tokens=20_000, block_tokens=200)
    got = {r.source: r for r in shares.collect()}
    assert got["large"].quota_tokens / 200 > 10_000
    assert all(abs(r.mix_tokens - r.quota_tokens) <= 50 for r in got.values()) and abs(got["small"].actual_share - 0.1) < 0.001 and got["small"].max_used <= 3
    sizes = [r.n for r in out.groupBy("shard").agg(F.sum("tokens").alias("n")).collect()]
    assert max(sizes) <= 20_000 + 200 and len(sizes) > 100 and min(sizes) > 0.9 * max(sizes)
    mixed = out.groupBy("shard").agg(F.sum(F.when(F.col("source") == "small", F.col("tokens"))).alias("s"), F.sum("tokens").alias("n")).select((F.col("s") / F.col("n")).alias("x"))
    low, high = mixed.agg(F.min("x"), F.max("x")).first()
    assert 0.02 < low < 0.1 < high < 0.25  # every shard is a draw of the whole
    assert out.select("id", "repeat_no").distinct().count() == out.count()


# ---- 10 personal information -----------------------------------------------------------------------------------------------

def test_personal_information(spark):
    people = [("PERSON", "Leon Fisabasko"), ("PERSON", "Ursula Difadethin"), ("PERSON", "Tilda Kufovisto")] * 5 + [("ORGANIZATION", "Musazerna and Sons")] * 5 + [(None, "x"), ("PERSON", None)]
    e = spark.createDataFrame(people, "kind string, t string")
    cases = {
        1: ("Dr. Leon Fisabasko lives at 358 Tannery Lane, Port Harlow 92720 and can be reached on 030 23125 172.", {("name", "Leon Fisabasko"), ("address", "358 Tannery Lane, Port Harlow 92720"), ("phone", "030 23125 172")}),
        2: ("Write to U. Difadethin at ursula dot d at mail dot bridge dot invalid or leon [at] x.example.", {("name", "U. Difadethin"), ("email", "ursula dot d at mail dot bridge dot invalid"), ("email", "leon [at] x.example")}),
        3: ("My tax number 75/364/18395 and Order 399-77-582 of Lot 308 330; Fisabasko, Leon's passport no. X77899547.", {("id_number", "75/364/18395"), ("name", "Fisabasko, Leon"), ("id_number", "X77899547")}),
        4: ("Musazerna and Sons sold 98 pages in Millrace Street.", set()), 5: ("Call 1-414-555-0154 ext. 11 for a.b+c@mail.x.example; P.O. Box 145, Bramford.", {("phone", "1-414-555-0154 ext. 11"), ("email", "a.b+c@mail.x.example"), ("address", "P.O. Box 145, Bramford")}),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()] * 30 + [(6, None), (7, "")], "doc_id int, text string")
    found = pii.spans(df, "doc_id", "text", e, ["t"], "kind").select("doc_id", "kind", "start_pos", "end_pos").distinct()
    got = {i: set() for i in cases}
    for r in found.collect():
        got[r.doc_id].add((r.kind, cases[r.doc_id][0][r.start_pos : r.end_pos]))
    assert got == {i: w for i, (_, w) in cases.items()}
    text = {r.doc_id: r.text for r in pii.masked(df.distinct(), "doc_id", "text", found).collect()}
    assert text[1] == "Dr. [NAME] lives at [ADDRESS] and can be reached on [PHONE]." and text[6] is None and text[7] == "" and text[4] == cases[4][0]
    assert pii.spans(df.filter("false"), "doc_id", "text", e.filter("false"), ["t"], "kind").count() == 0


def test_gazetteer_by_either_way(spark, sf):
    docs, e = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/entities.parquet")
    of = lambda most: {tuple(r) for r in pii.candidates(docs, "doc_id", "text", pii.gazetteer(e, ["text", "name"], "entity_type"), most).select("id", F.to_json("starts"), F.to_json("votes"), F.to_json("feats")).collect()}
    broadcast = of(pii.GAZETTEER_ROWS)
    assert broadcast == of(0) and len(broadcast) == docs.count()


def test_the_classifier_rejects_of_every_kind(spark, sf):
    docs, e = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/entities.parquet")
    got = pii.scored(docs, "doc_id", "text", e, ["text", "name"], "entity_type").cache()
    assert {r.kind for r in got.filter("not accepted and probability < 0.5").select("kind").distinct().collect()} == set(pii.KINDS)
    taken = got.filter("accepted")
    clash = taken.alias("x").join(taken.alias("y"), "doc_id").filter("(x.start_pos, x.end_pos) <> (y.start_pos, y.end_pos) and x.start_pos < y.end_pos and y.start_pos < x.end_pos")
    assert clash.count() == 0


# names of the annotated mentions stand at known places: the share of them that is found, and of what is found that is one of them
def test_names_against_annotated_mentions(spark, sf):
    docs, e = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/entities.parquet")
    found = pii.spans(docs, "doc_id", "text", e, ["text", "name"], "entity_type").filter("kind = 'name'").join(docs.select("doc_id", "ext_id"), "doc_id").select("ext_id", "start_pos", "end_pos").distinct()
    # of annotations whose text was changed after they were made the place is not exact
    said = e.filter("entity_type = 'PERSON'").join(docs.select(F.col("ext_id").alias("doc_id"), F.col("text").alias("body")), "doc_id").filter(F.expr("substring(body, start_offset + 1, length(text)) = text"))
    said = said.select(F.col("doc_id").alias("ext_id"), F.col("start_offset").alias("start_pos"), (F.col("start_offset") + F.length("text")).alias("end_pos")).distinct()
    assert found.join(said, ["ext_id", "start_pos", "end_pos"]).count() / said.count() > 0.97


# ---- queries ---------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_run(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    want = {"p1_found": ["tbl", "rec_id", "line_no"], "p2_found": ["name_a", "name_b"], "p3_found": ["doc_id", "start_offset", "id"], "p4_found": ["doc_id", "text", "id"], "p5_found": ["doc_id_a", "doc_id_b"], "p6_found": ["tbl", "doc_id", "row_no"], "p7_found": ["doc_id", "start_pos", "end_pos"], "p10_found": ["doc_id", "kind", "start_pos", "end_pos"]}
    assert df.columns == want.get(name, df.columns)


def test_sql_of_queries(spark, sf):
    import glob
    import os

    import duckdb

    for f in glob.glob(f"{sf}/*.parquet"):
        duckdb.execute(f"create or replace view {os.path.basename(f)[:-8]} as from '{f}'")
    for name, sql in catalog.oracle_sql().items():
        got = sorted(map(repr, catalog.queries()[name](spark, sf).toPandas().sort_index(axis=1).itertuples(index=False, name=None)))
        want = sorted(map(repr, duckdb.execute(sql).fetchdf().sort_index(axis=1).itertuples(index=False, name=None)))
        assert len(got) == len(want) and re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", "".join(want))
