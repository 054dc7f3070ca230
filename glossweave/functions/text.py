"""Column functions on text. All of them stay inside Spark's own expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ASCII_FROM, ASCII_TO, LEAST_GAPS, LINK_TYPES, MOST_CHARS


def asciify(x: Column) -> Column:
    """ASCII stand-ins for typographic characters, one for one."""
    return F.translate(x, ASCII_FROM, ASCII_TO)


def same_length(before: Column, after: Column) -> Column:
    """``after``, or an error if an edit that must keep offsets has changed the length."""
    return F.when(F.length(before) == F.length(after), after).otherwise(F.raise_error(F.lit("an edit changed the length of a text")))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units, for parity with offsets counted so."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def clean(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", " ")


def words(x: Column) -> Column:
    """Pieces between single blanks, without empty ones at the end."""
    return F.split(F.regexp_replace(x, " +$", ""), " ", -1)


def location_casing(x: Column) -> Column:
    """Every word lower-cased with an upper first letter; words with a dot, like u.s., stay."""
    return F.array_join(F.transform(F.split(x, " ", -1), lambda w: F.when(F.instr(w, ".") > 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")


def is_blank(x: Column) -> Column:
    return x.rlike(r"^[\x00-\x20]*$")


def is_text_line(x: Column) -> Column:
    return ~x.startswith("<")


def usable_sentence(x: Column) -> Column:
    """At most 750 characters and at least three runs of white space."""
    return (F.length(x) <= MOST_CHARS) & (F.regexp_count(x, F.lit(r"\s+")) >= LEAST_GAPS)


def tsv_clean(x: Column) -> Column:
    return F.translate(x, "\t\n", "  ")


def link_entity_type(types: Column) -> Column:
    """The type a link's types speak for: places before organisations before people."""
    has = lambda p: F.exists(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.coalesce(t.rlike(p), F.lit(False)))
    out = F
    for name, pattern in LINK_TYPES.items():
        out = out.when(has(pattern), name)
    return out.otherwise("OTHER")


def link_debug(name: Column, id_: Column, score: Column) -> Column:
    return F.concat(F.lit("("), name, F.lit(","), id_, F.lit(","), score.cast("string"), F.lit(")"))


def mention_debug(offset: Column, text: Column, best: Column) -> Column:
    return F.concat(F.lit("("), offset.cast("string"), F.lit(") "), text, F.lit(" -> "), best)


def fixed(x: Column, digits: int = 2) -> Column:
    """A number with a fixed count of decimals; halves of the decimal number go up, as in the reports."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))


def debug_line(offset: Column, line: Column) -> Column:
    return F.format_string("(%04d) %s", offset, line)
