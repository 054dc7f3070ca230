"""Free-entered values to a canonical list: token repair by edit distance, then soft TF-IDF over the repaired tokens.

Each distinct token that the list's vocabulary lacks is joined to it over the strings both yield by deleting up to two
characters, then checked by edit distance (a swap of neighbours counts one). Entries are found by their rarest token,
which any entry that covers a value well enough must share, and ranked by soft TF-IDF over all tokens.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Usual abbreviations in names of places and bodies.
ABBREVIATIONS = {
    "univ": "university", "natl": "national", "nat": "national", "dept": "department", "auth": "authority", "intl": "international", "int": "international",
    "fest": "festival", "prov": "province", "rep": "republic", "hts": "heights", "st": "saint", "fc": "football club", "assn": "association", "assoc": "association", "bros": "brothers",
    "corp": "corporation", "inc": "incorporated", "ltd": "limited", "inst": "institute", "apt": "airport", "arpt": "airport", "pt": "port",
}
# Words that say what kind of place is meant and belong to no name.
DESIGNATIONS = ["city", "town", "village", "the", "a"]
COVER = 0.95
#: A word of at least so many entries may be cut short in a value, to three letters or more and by three or more.
COMMON = 3
_ACCENTED = [(chr(o), unicodedata.normalize("NFKD", chr(o))[0]) for o in range(0xC0, 0x250) if ord(unicodedata.normalize("NFKD", chr(o))[0]) < 128]


def fold(x: Column) -> Column:
    """Lower case without accents, apostrophes and invisible characters; words run together by capitals are parted."""
    x = F.translate(x, "".join(a for a, _ in _ACCENTED) + "’'`­​‌‍⁠﻿", "".join(b for _, b in _ACCENTED))
    x = F.regexp_replace(x, r"[̀-ͯ]", "")
    x = F.regexp_replace(x, r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ")
    return F.lower(F.regexp_replace(x, r"(?<=\b\p{L})\.(?=\p{L}\b)", ""))


def _words(x: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv])
    full = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.try_element_at(table, w), w), " ")))
    return F.array_distinct(F.filter(full, lambda w: ~w.isin(DESIGNATIONS)))


def _deletions(w: Column) -> Column:
    """The string, those with one character left out, and (for longer strings) two."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    ones = one(w)
    twos = F.when(F.length(w) >= 6, F.flatten(F.transform(ones, one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(w), F.when(F.length(w) >= 3, F.concat(ones, twos)).otherwise(F.array().cast("array<string>"))))


def _swapped(x: Column, y: Column) -> Column:
    """Whether one swap of neighbours makes ``x`` into ``y``, which differ and are of one length."""
    apart = F.array_position(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p != q), True).cast("int")
    made = F.concat(F.substring(x, F.lit(1), apart - 1), F.substring(x, apart + 1, F.lit(1)), F.substring(x, apart, F.lit(1)), F.substring(x, apart + 2, F.length(x)))
    return (F.length(x) == F.length(y)) & (made == y)


def _distance(a: Column, b: Column) -> Column:
    """Edit distance in which a swap of neighbours that are not edited otherwise counts one; 3 stands for all beyond 2. All of it are built-in
    expressions: a plain distance up to 2 is right but for a single swap; beyond, there must be a swap with at most one edit on one side of it."""
    lev = F.levenshtein(a, b)
    part = lambda x, y: (x == y) | (F.levenshtein(x, y) <= 1) | _swapped(x, y)

    def swap_at(i: Column, off: int) -> Column:
        j = i + off
        same = (j >= 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, j + 1, F.lit(1))) & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, j, F.lit(1)))
        p, q = F.substring(a, F.lit(1), i - 1), F.substring(b, F.lit(1), j - 1)
        r, s = F.substring(a, i + 2, F.length(a)), F.substring(b, j + 2, F.length(b))
        return same & (((p == q) & part(r, s)) | ((r == s) & part(p, q)))

    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)), lambda i: swap_at(i, -1) | swap_at(i, 0) | swap_at(i, 1))
    return F.when(lev <= 1, lev).when(lev == 2, F.when(_swapped(a, b), 1).otherwise(2)).when((lev <= 4) & swap, 2).otherwise(3)


def _may_be_close(a: Column, b: Column) -> Column:
    """Holds for every pair within two edits: a swap costs a plain edit distance two but leaves the letters as they are."""
    lev = F.levenshtein(a, b)
    letters = F.levenshtein(F.array_join(F.array_sort(F.split(a, "")), ""), F.array_join(F.array_sort(F.split(b, "")), ""))
    return (lev <= 2) | ((lev == 3) & (letters <= 2)) | ((lev == 4) & (letters == 0))


def short_forms(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word, sim) for tokens that are no word but the beginning of one, by three letters or more, that is common in the list: the word of
    ``words`` (word, n) cut short. What 'obs' or 'marath' stand for is so learnt from the list itself."""
    unknown = tokens.select("token").distinct().join(words, F.col("token") == F.col("word"), "left_anti").filter(F.length("token") >= 3)
    heads = words.filter((F.col("n") >= COMMON) & (F.length("word") >= 6)).select("word", F.explode(F.transform(F.sequence(F.lit(3), F.length("word") - 3), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("token"))
    return unknown.join(heads, "token").select("token", "word", F.lit(0.9).alias("sim"))


def repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim) for the distinct ``token`` of one table and the distinct ``word`` of the other: the token itself if it is a
    word, else all words within an edit distance of 2 (of 1 if the token has under 6 characters; none under 3)."""
    tokens, vocabulary = tokens.select("token").distinct(), vocabulary.select("word").distinct()
    same = tokens.join(vocabulary, F.col("token") == F.col("word")).select("token", "word", F.lit(1.0).alias("sim"))
    other = tokens.join(vocabulary, F.col("token") == F.col("word"), "left_anti")
    # deletions and distances cost far more than the bytes of a token tell: spread them whatever adaptive execution would merge
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other = other.repartition(parts, F.xxhash64("token"))  # by the token itself it would be dropped as already there
    left = other.select("token", F.explode(_deletions(F.col("token"))).alias("key"))
    right = vocabulary.select("word", F.explode(_deletions(F.col("word"))).alias("key"))
    d = _distance(F.col("token"), F.col("word"))
    near = left.join(right, "key").filter(F.abs(F.length("token") - F.length("word")) <= 2).select("token", "word").distinct()
    near = materialise(near)  # else the optimiser measures each pair once for every deletion it shares
    near = near.filter(_may_be_close(F.col("token"), F.col("word"))).withColumn("d", d)
    near = near.filter((F.length("token") >= 3) & (F.length("word") >= 3) & (F.col("d") <= 2) & ((F.col("d") <= 1) | (F.length("token") >= 6)))
    return same.union(near.select("token", "word", 1 - F.col("d") / F.greatest(F.length("token"), F.length("word"))))


def map_values(values: DataFrame, text: str, entries: DataFrame, id_: str, name: str, cover: float = COVER) -> DataFrame:
    """(text, id, name, score) of every distinct text: the entry meant, or null id and score 0 if none covers it.

    An entry covers a value if the TF-IDF cosine of both, repaired tokens counting as the words meant, is ``cover`` or more, be it
    of the whole value, of its first part where further parts (after a comma, a slash or in brackets) name what it lies in, or of
    the value written as one word. Of several the best soft TF-IDF score is taken, then the whole value before its part, then the
    smaller id. Null, empty and meaningless texts have no entry; an empty list gives null for all. Entries of one name count as
    several, of null name or id as none. Other columns are ignored.
    """
    distinct = values.select(F.col(text).cast("string").alias("text")).distinct()
    folded = distinct.filter("text is not null").withColumn("f", fold(F.col("text")))
    part = F.regexp_extract("f", r"^\W*([^,/(]*[\p{L}\p{N}]\.?)\s*[,/(]", 1)
    glued = F.regexp_replace("f", r"[^\p{L}\p{N}]+", "")
    forms = F.array(F.struct(F.lit(0).alias("form"), _words(F.col("f")).alias("words")), F.struct(F.lit(1).alias("form"), _words(part).alias("words")), F.struct(F.lit(2).alias("form"), F.array(F.concat(F.lit("="), glued)).alias("words")))
    asked = materialise(folded.select("text", F.explode(forms).alias("v")).select("text", "v.form", "v.words").filter(F.size("words") > 0))

    named = entries.select(F.col(id_).alias("id"), F.col(name).cast("string").alias("name")).filter("id is not null and name is not null").distinct()
    listed = named.withColumn("f", fold(F.col("name"))).withColumn("words", _words(F.col("f")))
    listed = listed.select("id", "name", "words").union(listed.select("id", "name", F.array(F.concat(F.lit("="), F.regexp_replace("f", r"[^\p{L}\p{N}]+", ""))))).filter(F.size("words") > 0)
    n = F.lit(float(named.count() + 1))
    used = materialise(listed.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    idf = used.select("word", F.log(n / F.col("n") + 1).alias("idf"))
    # (id, name, [(word, idf)], norm), found by its heaviest word
    heavy = listed.select("id", "name", F.element_at("words", 1).startswith("=").alias("glued"), F.explode("words").alias("word")).join(idf, "word").groupBy("id", "name", "glued").agg(
        F.collect_list(F.struct("word", "idf")).alias("words")  # the words of one name
    )
    top = F.array_max(F.transform("words", lambda w: F.struct(w["idf"].alias("idf"), w["word"].alias("word"))))
    heavy = heavy.groupBy("id", "name", "words").agg(F.first(top).alias("top")).select("id", "name", F.col("words").alias("entry"), F.col("top.word").alias("word"))

    tokens = asked.select(F.explode("words").alias("token"))
    fixed = materialise(repairs(tokens, idf.select("word")).union(short_forms(tokens, used)).groupBy("token", "word").agg(F.max("sim").alias("sim")))
    unknown = F.log(n + 1)
    fixes = fixed.join(idf, "word").groupBy("token").agg(F.collect_list(F.struct("word", "sim", "idf")).alias("to"))  # bounded: the words within two edits
    spread = asked.select("text", "form", F.posexplode("words").alias("pos", "token")).join(fixes, "token", "left")
    whole = spread.groupBy("text", "form").agg(F.collect_list(F.struct("token", "to")).alias("have"))
    tries = spread.select("text", "form", F.explode("to").alias("t")).select("text", "form", F.col("t.word").alias("word")).distinct()
    pairs = tries.join(heavy, "word").join(whole, ["text", "form"])

    names = F.map_from_arrays(F.transform("entry", lambda w: w["word"]), F.transform("entry", lambda w: w["idf"]))
    pairs = pairs.withColumn("m", names)
    # for each token of the value: its best word within this entry, or what it weighs on its own
    best = lambda h: F.array_max(F.transform(F.filter(F.coalesce(h["to"], F.array().cast("array<struct<word:string,sim:double,idf:double>>")), lambda c: F.map_contains_key(F.col("m"), c["word"])), lambda c: F.struct(c["sim"].alias("sim"), c["idf"].alias("idf"), c["word"].alias("word"))))
    pairs = pairs.withColumn("got", F.transform("have", lambda h: F.struct(best(h).alias("b"), F.coalesce(F.array_max(F.transform(h["to"], lambda c: c["idf"])), unknown).alias("own"))))
    hit = F.filter("got", lambda g: g["b"].isNotNull())
    # a word of the entry that several tokens were repaired to counts once
    words_hit = F.array_distinct(F.transform(hit, lambda g: F.struct(g["b"]["word"].alias("word"), g["b"]["idf"].alias("idf"))))
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    pairs = pairs.withColumn("inner", add(words_hit, lambda w: w["idf"] * w["idf"]))
    pairs = pairs.withColumn("soft", add(hit, lambda g: g["b"]["idf"] * g["b"]["idf"] * g["b"]["sim"]))
    text_norm = F.sqrt(add(F.col("got"), lambda g: F.when(g["b"].isNotNull(), g["b"]["idf"] * g["b"]["idf"]).otherwise(g["own"] * g["own"])))
    entry_norm = F.sqrt(add(F.col("entry"), lambda w: w["idf"] * w["idf"]))
    pairs = pairs.withColumn("norm", text_norm * entry_norm).withColumn("cosine", F.col("inner") / F.col("norm")).withColumn("score", F.least(F.lit(1.0), F.round(F.col("soft") / F.col("norm"), 9)))
    good = pairs.filter(F.col("cosine") >= cover)
    won = good.groupBy("text").agg(F.min_by(F.struct("id", "name", "score"), F.struct((-F.col("score")).alias("s"), "form", "id")).alias("w"))
    out = distinct.join(won, "text", "left")
    return out.select(F.col("text").alias(text), F.col("w.id").alias("id"), F.col("w.name").alias("name"), F.coalesce(F.col("w.score"), F.lit(0.0)).alias("score"))
