"""Sentence boundaries across languages and scripts, wholly in Spark SQL expressions.

Characters that look like a boundary but are none are masked, one for one, by private-use placeholders; a
placeholder is then put at each boundary, the text is split there, and the sentences are cut from the text as it was.
Every step but that placeholder keeps the length, so positions are those of the text, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOT, ASK, SHOUT, SOFT, CUT = "", "", "", "", ""
MASKS = "".join(map(chr, range(0xE000, 0xE010)))
CHUNK = 512
#: Columns of a page of plain text: the usual bound of hard-wrapped lines.
COLUMNS = 80
THAI = r"[\u0e01-\u0e5b]"

# Abbreviations that never end a sentence before what usually follows them.
TITLES = "Mr|Mrs|Ms|Mx|Dr|Dra|Prof|Gen|Col|Capt|Lt|Sgt|Rev|Hon|Gov|Sen|Rep|St|Sr|Sra|Srta|Mme|Mlle|Messrs|Fr|Hr"
NUMBERED = "No|Nos|Nr|Nro|núm|num|n|ca|c|approx|aprox|env|ref|Ref|Apt|apt|Tel|Tél|Тел|тел|el|él|ел|ext|Ext|Fig|fig|Vol|vol|p|pp|Art|art|Sec|sec|Ch|ch|cf|Abs|Abb|Kap|стр|рис|ул|д|кв|ок|им|Mio|Mrd|Mill"
LATINISMS = "vs|viz|i\\.e|e\\.g|z\\.B|Z\\.B|bzw|d\\.h|u\\.a|o\\.ä|т\\.е|т\\.к|т\\.д|p\\.ex|P\\.O|Assn|Intl|Int'l|Inst|Univ|Dept|Auth|Prov|Hts|Natl|Mt|Ft"
MONTHS = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|janv|févr|avr|juil|sept|oct|nov|déc|ene|abr|ago|dic"
GERMAN_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
FIRM_ENDS = "Corp|Co|Inc|nc|Ltd|Bros|LLC|Cos|GmbH|S\\.A|S\\.L|Jr|Sr"
# Words that begin an English sentence rather than continue a name.
OPENERS = "The|A|An|At|In|On|It|Its|He|She|They|We|You|I|This|That|These|Those|There|Here|What|Why|Who|Whose|Which|How|When|Where|While|Was|Were|Is|Are|Could|Can|Would|Will|Should|Did|Do|Does|Has|Have|Nobody|Neither|Either|Both|Each|Every|Some|Many|Most|Once|After|Before|According|About|Officials|From|For|See|Section|Prices|Rates|Ranked|Lot|Send|Write|Contact|Their|His|Her|Our|My|Your|Witness|Please|Follow|If|As|But|And|Or|So|Then|Not|No|To|By|With|Of"


def _r(x: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(x, pattern, to)


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _soft_breaks(x: Column) -> Column:
    """Line breaks put in by wrapping become SOFT: those after which the next word would not have fitted the width the text was wrapped to."""

    def marked(lines: Column, width: Column) -> Column:
        def end(pair: Column, i: Column) -> Column:
            line, after = pair["l"], pair["f"]
            fits = F.length(line) + 1 + F.length(F.regexp_extract(after, r"^\S*", 0)) <= width - 2
            hard = fits | (F.trim(line) == "") | (F.trim(after) == "") | after.rlike(r"^\p{Lu}{2,15}: ")
            return F.concat(line, F.when(i == F.size(lines) - 1, "").when(hard, "\n").otherwise(SOFT))

        following = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit("")))
        return F.array_join(F.transform(F.arrays_zip(lines.alias("l"), following.alias("f")), end), "")

    def width(lines: Column) -> Column:
        """The width a text was wrapped to, by its own lines: the longest but for the sixth of the long ones that edits may have stretched. A
        text with lines beyond ``COLUMNS`` is not wrapped, unless most of its long lines break off within a sentence."""
        sizes = F.sort_array(F.transform(lines, lambda l: F.length(l)), asc=False)
        long = F.filter(lines, lambda l: F.length(l) >= 50)
        open_ended = F.filter(long, lambda l: ~l.rlike(r"[.!?:…。！？؟।][\"”’»)\]」]*\s*$"))
        own = lambda z: F.element_at(z, F.greatest(F.lit(1), F.ceil(F.size(F.filter(z, lambda n: n * 2 > z[0])) / 6)).cast("int"))
        return _let(sizes, lambda z: F.when((z[0] <= COLUMNS) | ((z[0] <= 1.25 * COLUMNS) & (F.size(open_ended) * 2 > F.size(long))), own(z)).otherwise(1 << 30))

    whole = lambda lines: _let(width(lines), lambda w: marked(lines, w))
    return F.when(F.instr(x, "\n") > 0, _let(F.split(x, "\n", -1), whole)).otherwise(x)


def _inside(p: Column) -> Column:
    """Masks the terminators of a quotation, all but one at its end."""
    most = F.translate(F.substring(p, F.lit(1), F.length(p) - 1), ".!?。！？", DOT + SHOUT + ASK + DOT + SHOUT + ASK)
    return F.when(F.length(p) > 1, F.concat(most, F.right(p, F.lit(1)))).otherwise(p)


def _quotations(x: Column) -> Column:
    def line(l: Column) -> Column:
        odd = lambda parts: F.transform(parts, lambda p, i: F.when(i % 2 == 1, _inside(p)).otherwise(p))
        return _let(F.split(l, '"', -1), lambda parts: F.when(F.size(parts) % 2 == 1, F.array_join(odd(parts), '"')).otherwise(l))

    return F.when(F.instr(x, '"') > 0, F.array_join(F.transform(F.split(x, "\n", -1), line), "\n")).otherwise(x)


def _curly_quotations(x: Column) -> Column:
    opens, closes = "[“「『«]", "[”」』»]"

    def part(p: Column) -> Column:
        quoted = p.rlike(f"^{opens}[^\\n]*{closes}$")
        return F.when(quoted, F.concat(_inside(F.substring(p, F.lit(1), F.length(p) - 1)), F.right(p, F.lit(1)))).otherwise(p)

    curly = F.array_join(F.transform(F.split(x, f"(?={opens})|(?<={closes})", -1), part), "")
    return F.when(x.rlike(opens), curly).otherwise(x)


def _mask(x: Column) -> Column:
    gap = f"[ \\u00a0\\u2000-\\u200a\\u202f{SOFT}]"
    # addresses: each match goes on where the last one ended (\G), so one pass goes along an address of any length
    x = F.when(F.instr(x, "@") > 0, _r(_r(x, r"\.(?=[\w.+-]*+@)", DOT), r"(@|\G(?!\A))([\w+-]*)\.(?=\w)", f"$1$2{DOT}")).otherwise(x)
    x = F.when(x.rlike(r"://|www\."), _r(_r(x, r"(://|www\.|\G(?!\A))([^\s.]*)\.(?=\S)", f"$1$2{DOT}"), r"(://|\G(?!\A))([^\s?]*)\?(?=\S)", f"$1$2{ASK}")).otherwise(x)
    x = _r(x, r"(?<=\d)\.(?=\d)", DOT)  # decimals, sections, numbers
    x = _r(x, rf"\.(?={gap})(?<=(?<![\p{{L}}\p{{M}}])(?:{TITLES}|{NUMBERED}|{LATINISMS})\.)", DOT)
    x = _r(x, rf"\.(?={gap}\d)(?<=(?<![\p{{L}}\p{{M}}])(?:{MONTHS})\.)", DOT)
    x = _r(x, rf"(?<!\d)(\d{{1,2}})\.(?={gap}(?:{GERMAN_MONTHS})(?!\p{{L}}))", f"$1{DOT}")
    x = _r(x, rf"(?<=str)\.(?={gap}\d)", DOT)
    x = _r(x, rf"(?<![\p{{L}}\p{{M}}])({FIRM_ENDS})\.(?={gap}(?:Inc|Ltd|Co|Corp|and|of|&|\p{{Ll}}|\p{{Lo}}|\d{{1,2}} \p{{IsCyrillic}}))", f"$1{DOT}")
    x = _r(x, rf"((?:^|[\n.!?{SOFT} ])At{gap}\d{{1,2}}(?::\d\d)?{gap}[ap]\.m)\.", f"$1{DOT}")  # "At 5 a.m. X did ..."
    last = rf"(?!{gap}+(?:{OPENERS})(?!\p{{L}}))"
    x = _r(x, rf"(?<![\p{{L}}\p{{M}}\p{{N}}'’])(\p{{Lu}})\.(?=\p{{Lu}}\.|-\p{{Lu}})", f"$1{DOT}")  # initials in a row
    x = _r(x, rf"(?<!\p{{L}}[,]{gap})(?<![\p{{L}}\p{{M}}\p{{N}}'’])(\p{{Lu}})\.{last}(?={gap}+\p{{Lu}})", f"$1{DOT}")
    return x


def _cuts(x: Column) -> Column:
    """Puts CUT at each boundary."""
    gap = f"[ \\t\\u00a0\\u2000-\\u200a\\u202f\\u3000{SOFT}]"
    opening = r"[\"“«‘(\[¿¡„「『]*"
    x = F.replace(x, F.lit("\n"), F.lit(f"{CUT}\n"))
    x = _r(x, rf"([.!?…؟।۔]+[\"”’»)\]]*)({gap}+)(?={opening}(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}$@#]|\p{{Ll}}\p{{Lu}}))", f"$1{CUT}$2")
    # a blank that was left out: the end of a word or number runs into a capitalised word
    x = _r(x, r"(?<=[\p{Ll}\p{N})\]]{2}|[ap]\.m|[\p{L}][\"”])([.!?]+[\"”’»)]*)(?=[\"“«]?\p{Lu}[\p{Ll}'’])", f"$1{CUT}")
    x = _r(x, r"([؟।۔])(?=[\p{L}\p{N}])", f"$1{CUT}")
    x = _r(x, r"([。！？｡]+[」』”’）】]*)(?=[^」』”’）】\s\n。！？])", f"$1")
    x = _r(x, "([」』”’）】])", "$1")  # a quotation inside a sentence that goes on
    x = F.translate(x, "", CUT)
    return x


def _thai_cuts(x: Column) -> Column:
    """In Thai a space ends a sentence, unless it follows a label or lies within numbers and contact details."""
    gap = f"[ \\t\\u00a0\\u2000-\\u200a\\u202f\\u3000{SOFT}]"
    return _r(x, rf"(?<![:：])(?<=[\p{{L}}\p{{M}}\p{{N}}.)\"”%?!])({gap}+)(?=[\"“(]?{THAI})|(?<={THAI})({gap}+)(?=\p{{Lu}})", f"{CUT}$1$2")


def _running(a: Column) -> Column:
    return F.aggregate(a, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _starts(lengths: Column) -> Column:
    """The sums of all lengths that go before, made chunk by chunk so that the cost stays linear in long texts."""

    def shifted(chunks: Column, offsets: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda c, i: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda v: v + F.element_at(offsets, (i + 1).cast("int")))))

    def of(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: _running(F.slice(a, (c * CHUNK + 1).cast("int"), F.lit(CHUNK))))
        return _let(chunks, lambda ch: _let(_running(F.transform(ch, lambda c: F.element_at(c, -1))), lambda off: shifted(ch, off)))

    return _let(lengths, of)


def sentences(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row for each sentence: ``keep``, ``sent_no`` (from 0), ``start_pos``, ``end_pos`` (exclusive) and ``sentence``.

    Sentences cover every character of the text that is not white space outside them, in order, and never overlap.
    Null, empty and blank texts give no row. Repeated rows give repeated sentences. Other columns are left out.
    """
    raw = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_t"))
    raw = raw.filter(F.col("_t").isNotNull() & (F.col("_t") != ""))
    steps = [_soft_breaks, _quotations, _curly_quotations, lambda m: _cuts(_mask(m)), lambda m: F.when(m.rlike(THAI), _thai_cuts(m)).otherwise(m)]
    marked = F.translate("_t", MASKS, "�" * len(MASKS))
    for step in steps:
        marked = _let(marked, step)
    ws = rf"[\s  -  　{SOFT}]"

    def trimmed(piece: Column) -> Column:
        s, a = piece["s"], piece["a"]
        lead = F.length(F.regexp_extract(s, f"^{ws}+", 0))
        tail = F.length(F.regexp_extract(s, f"(?<!{ws}){ws}+$", 0))
        return F.struct((a + lead).alias("a"), (a + F.length(s) - tail).alias("b"))

    def placed(pieces: Column) -> Column:
        return F.filter(F.transform(F.arrays_zip(pieces.alias("s"), _starts(F.transform(pieces, lambda s: F.length(s))).alias("a")), trimmed), lambda p: p["a"] < p["b"])

    work = raw.withColumn("_p", _let(F.split(marked, CUT, -1), placed))
    # the outer form: for the inner one Spark adds a filter that computes the whole array again
    out = work.select(*keep, "_t", F.posexplode_outer("_p").alias("sent_no", "_p")).filter(F.col("sent_no").isNotNull())
    return out.select(*keep, "sent_no", F.col("_p.a").alias("start_pos"), F.col("_p.b").alias("end_pos"), F.substring("_t", F.col("_p.a") + 1, F.col("_p.b") - F.col("_p.a")).alias("sentence"))
