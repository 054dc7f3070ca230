"""One character form for text that looks alike: embedded SQL over Arrow partitions.

Every Arrow batch of a partition is handed to an in-process DuckDB, which rewrites it with
``translate``, ``regexp_replace`` and ``nfc_normalize``; rows come back as Arrow. Nothing is
shuffled and no Python object is made per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters, the foreign one above the Latin one.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮаеорсухѕіјһԁԛԝүӏ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXYaeopcyxsijhdqwyl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορχιυκ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXavopxiuk"
LATIN = "ABEKMHOPCTYXaeopcyxsij"
LATIN_AS_CYRILLIC = "АВЕКМНОРСТУХаеорсухѕіј"
LATIN_G = "ABEZHIKMNOPTYXvo"
LATIN_AS_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο"
# Characters without a width of their own (soft hyphen, zero-width space and joiners, marks of direction, word joiner, BOM).
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
# Spaces that are neither U+0020 nor a line break, and hyphens that read like the plain one.
SPACES = "\t               　"
HYPHENS = "‐‑﹣－"
# Signs of the Indic scripts after which a joiner has a meaning of its own.
VIRAMAS = "्্੍્୍்్್്්"
#: Rows or bytes that are handed to the embedded database at a time.
ROWS, BYTES = 131_072, 16 << 20
KEPT_ZWJ, KEPT_ZWNJ = "", ""


#: Blocks whose compatibility forms are brought to the plain ones: common ones (wide letters and digits), then the rest.
COMMON = [(0xFF0E, 0xFF0F), (0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)]
RARE = [(0x2024, 0x2025), (0x2100, 0x2150), (0x2160, 0x2180), (0x2F00, 0x2FD6), (0x03D0, 0x03D7), (0x03F0, 0x03F6), (0xFF65, 0xFFA0), (0x1D400, 0x1D800), (0xFB50, 0xFDFC), (0xFE70, 0xFEFD), (0x017F, 0x0180)]
# Signs made of letters that are read as signs and stay.
KEPT = "№℡℻™℠ℹ"
JOINED = [(0x2025, 0x2027), (0xFB00, 0xFB07), (0x0132, 0x0134), (0x01C4, 0x01CD), (0x01F1, 0x01F4)]


def _forms(blocks: list[tuple[int, int]], single: bool) -> list[tuple[str, str]]:
    """The forms of these blocks with their plain text, by rule from the Unicode tables, of one character or of several.
    Superscripts, fractions, ordinals, letter-like signs (number sign, trade mark) and East Asian punctuation are in no block:
    they keep their meaning and stay."""
    pairs = [(chr(o), unicodedata.normalize("NFKC", chr(o))) for block in blocks for o in range(*block) if unicodedata.name(chr(o), "")]
    plain = lambda to: all(unicodedata.category(x)[0] in "LNM" or x in "-." for x in to)
    return [(c, to) for c, to in pairs if to != c and c not in KEPT and plain(to) and (len(to) == 1) == single]


def _ranges(blocks: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b - 1:04X}}}" for a, b in blocks) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in chars) + "]"


def statement(rows: str) -> str:
    """The same as one statement over ``rows``, a query whose text is the column t."""
    return _sql().replace("WITH a AS", f"WITH batch AS ({rows}), a AS", 1)


def _sql() -> str:
    tr = lambda x, a, b: f"translate({x}, {_quoted(a)}, {_quoted(b)})"
    plain = lambda pairs: ("".join(c for c, _ in pairs), "".join(to for _, to in pairs))
    wide_from, wide_to = plain(_forms(COMMON, True))
    wide = tr("t", wide_from + SPACES + HYPHENS, wide_to + " " * len(SPACES) + "-" * len(HYPHENS))
    rare = tr("t1", *plain(_forms(RARE, True)))
    for c, to in _forms(RARE, False):
        rare = f"replace({rare}, {_quoted(c)}, {_quoted(to)})"
    joined = "t2"
    for c, to in _forms(JOINED, False):
        joined = f"replace({joined}, {_quoted(c)}, {_quoted(to)})"
    letters = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}]+"
    pieces = letters + "|" + letters.replace("[", "[^").replace("]+", "]+")
    own_c, own_g = f"[^\\P{{Cyrillic}}{CYRILLIC}]", f"[^\\P{{Greek}}{GREEK}]"
    as_latin = tr("w", CYRILLIC + GREEK, CYRILLIC_AS_LATIN + GREEK_AS_LATIN)
    word = f"""CASE
        WHEN NOT regexp_matches(w, '[\\p{{Greek}}\\p{{Cyrillic}}]') THEN w
        WHEN regexp_matches(w, '\\p{{Latin}}') THEN CASE
            WHEN NOT regexp_matches({as_latin}, '[\\p{{Greek}}\\p{{Cyrillic}}]') THEN {as_latin}
            WHEN NOT regexp_matches({tr('w', LATIN, LATIN_AS_CYRILLIC)}, '[\\p{{Latin}}\\p{{Greek}}]') THEN {tr('w', LATIN, LATIN_AS_CYRILLIC)}
            WHEN NOT regexp_matches({tr('w', LATIN_G, LATIN_AS_GREEK)}, '[\\p{{Latin}}\\p{{Cyrillic}}]') THEN {tr('w', LATIN_G, LATIN_AS_GREEK)}
            ELSE {as_latin} END
        WHEN lone AND NOT regexp_matches({as_latin}, '[\\p{{Greek}}\\p{{Cyrillic}}]') THEN {as_latin}
        ELSE w END"""
    return f"""
    WITH a AS (SELECT *, CASE WHEN regexp_matches(t, {_quoted(_ranges(COMMON)[:-1] + _class(SPACES + HYPHENS)[1:])}) THEN {wide} ELSE t END AS t1 FROM batch),
    b AS (SELECT *, CASE WHEN strlen(t1) > length(t1) AND regexp_matches(t1, {_quoted(_ranges(RARE))}) THEN {rare} ELSE t1 END AS t2 FROM a),
    b2 AS (SELECT *, CASE WHEN strlen(t2) > length(t2) AND regexp_matches(t2, {_quoted(_ranges(JOINED))}) THEN {joined} ELSE t2 END AS t25 FROM b),
    c AS (SELECT *, CASE WHEN regexp_matches(t25, {_quoted(_class(INVISIBLE))}) THEN
            replace(replace(regexp_replace(
                regexp_replace(regexp_replace(t25, {_quoted('(' + _class(VIRAMAS) + r')\x{200D}')}, '\\1{KEPT_ZWJ}', 'g'), {_quoted('(' + _class(VIRAMAS) + r')\x{200C}')}, '\\1{KEPT_ZWNJ}', 'g'),
                {_quoted(_class(INVISIBLE))}, '', 'g'), '{KEPT_ZWJ}', chr(8205)), '{KEPT_ZWNJ}', chr(8204))
            ELSE t25 END AS t3 FROM b2),
    d AS (SELECT *, CASE WHEN strlen(t3) > length(t3) THEN nfc_normalize(t3) ELSE t3 END AS t4 FROM c),
    e AS (SELECT *, strlen(t4) > length(t4) AND regexp_matches(t4, '[\\p{{Greek}}\\p{{Cyrillic}}]') AND regexp_matches(t4, '\\p{{Latin}}') AS mixed,
            NOT regexp_matches(t4, '{own_c}|{own_g}') AS lone FROM d)
    SELECT * EXCLUDE (t, t1, t2, t25, t3, t4, mixed, lone), t AS text,
        CASE WHEN mixed THEN list_aggregate(list_transform(regexp_extract_all(t4, '{pieces}'), lambda w: {word}), 'string_agg', '') ELSE t4 END AS normal
    FROM e"""


def one_form(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``text`` as it was and ``normal``, its consistent form, for every row.

    Wide, joined and presentation forms become plain, odd spaces U+0020, invisible characters vanish (a joiner after an
    Indic virama stays), letter and accent become one character, and a word of mixed scripts is brought to one of them; a
    word wholly of look-alikes is Latin if the rest of the text is. Null stays null and '' stays ''; the form of a form is
    itself. Columns not named in ``keep`` are left out; ``keep`` may hold neither ``text`` nor ``normal``.
    """
    src = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("t"))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in src.schema.fields[:-1]], T.StructField("text", T.StringType()), T.StructField("normal", T.StringType())])
    query = _sql()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})

        def rewritten(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            con.register("batch", pa.Table.from_batches(held))
            out = con.sql(query).to_arrow_table()
            con.unregister("batch")
            names = [*keep, "text", "normal"]
            kinds = [*held[0].schema.types[:-1], pa.string(), pa.string()]
            yield from pa.table({n: out.column(n) for n in names}).cast(pa.schema(list(zip(names, kinds)))).to_batches()

        # planning the statement costs as much as rewriting thousands of rows: batches are put together up to a bound
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS or sum(b.nbytes for b in held) >= BYTES:
                yield from rewritten(held)
                held = []
        if held:
            yield from rewritten(held)

    return src.mapInArrow(run, schema)
