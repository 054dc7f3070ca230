"""Places and what contains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import STATES
from ..functions.text import location_casing

# Fixed value: a place, its type and, now and then, a number.
ENTRY = r"([^()]+)\((CITY|PROVINCE|COUNTRY)(?:\s\d+)?\)"
# Fixed value: the last word of a town, a comma, and two letters with or without dots at the end.
STATE_SHORT = r"(\w+),\s([A-Za-z])\.?([A-Za-z])\.?$"


def places(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct (name, typ, cont_name, cont_typ): each place of a line with the next as its container; the place of a line that has
    but one stands alone (null container). The last of several is not a row of its own. Lines without a place give none."""
    got = lines.select(F.regexp_extract_all(F.col(line), F.lit(ENTRY), F.lit(1)).alias("n"), F.regexp_extract_all(F.col(line), F.lit(ENTRY), F.lit(2)).alias("t")).filter(F.size("n") > 0)
    all_ = F.transform("n", lambda n, i: F.struct(F.trim(n).alias("name"), F.element_at("t", i + 1).alias("typ")))
    got = got.select(F.size("n").alias("k"), F.posexplode(all_).alias("i", "p"), all_.alias("all"))
    nxt = F.try_element_at("all", (F.col("i") + 2).cast("int"))
    rows = got.filter((F.col("k") == 1) | (F.col("i") < F.col("k") - 1)).select("p.name", "p.typ", nxt["name"].alias("cont_name"), nxt["typ"].alias("cont_typ"))
    return rows.distinct()


def names(g: DataFrame) -> DataFrame:
    """(lname, is_city, is_province, is_country) of every lower-cased name that is a place in its own right."""
    is_ = lambda t: F.max((F.col("typ") == t).cast("int")).alias(f"is_{t.lower()}")
    return g.groupBy(F.lower("name").alias("lname")).agg(is_("CITY"), is_("PROVINCE"), is_("COUNTRY"))


def total_count(g: DataFrame) -> DataFrame:
    """(lname, places): how many places bear a name."""
    return g.groupBy(F.lower("name").alias("lname")).agg(F.count(F.lit(1)).alias("places"))


def containment(g: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Distinct (container, contained, in lower case) where a province or country holds a city.

    ``strict_reference`` takes any contained place for the city, whatever the types of the pair are, and compares the cased names,
    so that places whose names are not cased word by word never match.
    """
    n = names(g)
    pairs = g.filter("cont_name is not null").select("name", "typ", "cont_name", "cont_typ")
    if strict_reference:
        pairs = pairs.filter((F.col("cont_name") == location_casing(F.lower("cont_name"))) & (F.col("name") == location_casing(F.lower("name"))))
    else:
        pairs = pairs.filter("typ = 'CITY' and cont_typ in ('PROVINCE', 'COUNTRY')")
    p = pairs.select(F.lower("cont_name").alias("container"), F.lower("name").alias("contained")).distinct()
    city = n.filter("is_city = 1").select(F.col("lname").alias("contained"))
    big = n.filter("is_province = 1 or is_country = 1").select(F.col("lname").alias("container"))
    return p.join(city, "contained", "left_semi").join(big, "container", "left_semi")


def type_similarity(pairs: DataFrame, a: str, b: str, g: DataFrame) -> DataFrame:
    """Adds ``type_similarity``: how many of city, province and country both names can be."""
    n = names(g)
    x, y = n.select([F.col(c).alias(f"x_{c}") for c in n.columns]), n.select([F.col(c).alias(f"y_{c}") for c in n.columns])
    j = pairs.join(x, F.lower(F.col(a)) == F.col("x_lname"), "left").join(y, F.lower(F.col(b)) == F.col("y_lname"), "left")
    both = sum((F.coalesce(F.col(f"x_is_{t}") * F.col(f"y_is_{t}"), F.lit(0)) for t in ("city", "province", "country")), F.lit(0))
    return j.withColumn("type_similarity", both.cast("double")).drop(*[f"{p}_{c}" for p in "xy" for c in n.columns])


def _state(short: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in STATES.items() for v in kv]), short)


def expand_locations(df: DataFrame, text: str, g: DataFrame) -> DataFrame:
    """Adds ``expanded``: 'City, WA' and 'City, Wash.' with the name of a state or province that holds the city, else the text itself.

    Of several provinces that begin with the abbreviation the first by name is taken. Texts without a comma stay as they are, null stays
    null. Every distinct text is looked up once.
    """
    d = df.select(F.col(text).alias("_t")).filter(F.instr("_t", ",") > 0).distinct()
    city1, st = F.regexp_extract("_t", STATE_SHORT, 1), F.upper(F.concat(F.regexp_extract("_t", STATE_SHORT, 2), F.regexp_extract("_t", STATE_SHORT, 3)))
    short = F.regexp_extract("_t", STATE_SHORT, 0) != ""
    parts = F.split("_t", ",")
    d = d.withColumn("_short", short).withColumn("_city", F.when(short, city1).otherwise(F.trim(F.element_at(parts, 1)))).withColumn("_cont", F.when(short, _state(st)).otherwise(F.trim(F.try_element_at(parts, F.lit(2)))))
    prefix = F.lower(F.when(F.substring("_cont", -1, 1).rlike(r"\p{L}"), F.col("_cont")).otherwise(F.expr("substring(_cont, 1, length(_cont) - 1)")))
    d = d.withColumn("_prefix", F.when(~F.col("_short") & (F.length(prefix) > 2), prefix))
    holds = containment(g)
    exact = g.filter("typ = 'CITY' and cont_typ = 'PROVINCE'").select(F.col("name").alias("_city"), F.col("cont_name").alias("_cont")).distinct()
    by_state = d.filter("_short and _cont is not null").join(exact, ["_city", "_cont"]).select("_t", F.concat_ws(", ", "_city", "_cont").alias("e"))
    # the province list is short; its prefixes make the lookup an equality
    prov = names(g).filter("is_province = 1").select(F.col("lname").alias("container")).withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("container"))), lambda k: F.substring(F.col("container"), F.lit(1), k))))
    by_prefix = d.filter("_prefix is not null").join(prov, "_prefix").withColumn("contained", F.lower("_city")).join(holds, ["container", "contained"]).groupBy("_t", "_city").agg(F.min("container").alias("c"))
    found = by_state.union(by_prefix.select("_t", F.concat_ws(", ", F.col("_city"), location_casing(F.col("c"))))).groupBy("_t").agg(F.min("e").alias("e"))
    return df.join(found, F.col(text) == F.col("_t"), "left").withColumn("expanded", F.coalesce("e", F.col(text))).drop("_t", "e")
