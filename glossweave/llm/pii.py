"""Personal information in free text: weak supervision over candidate spans.

Regular expressions, a gazetteer and words of address propose spans, far more than are personal information. Labelers (shapes,
gazetteer entries, words around the span) vote for or against each or abstain. How often every pattern of votes occurs is
counted over all candidates; expectation-maximisation on these counts estimates the reliability of each labeler and a posterior
per pattern. On these posteriors a logistic span classifier is trained, over the votes and over features of the span and its
neighbours; it decides on every span.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Of overlapping spans the kind that comes first here counts.
KINDS = ["email", "address", "id_number", "phone", "name"]
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
LABELERS = 10
#: Entries of the gazetteer at most that are broadcast (16 bytes each); larger ones are joined to the tokens of the texts instead.
GAZETTEER_ROWS = 2_000_000
GIVEN, SURNAME, BODY = 1, 2, 3
#: Spans of a kind at most that the classifier is trained on, drawn by hash from all candidates.
TRAIN_SPANS = 4000
#: Places of the hashed features, and features of a span.
PLACES, FEATURES = 4096, 7

_S = r"[\s­​-‍⁠﻿]"
_A = r"(?:(?![؀-ۿऀ-໿぀-ヿ一-鿿＀-／：-＠])[\w.+\-­​-‍⁠﻿])"
_AT = rf"(?:{_S}?[\[(]{_S}?at{_S}?[\])]{_S}?|@)"
_DOT = rf"(?:{_S}?[\[(]{_S}?dot{_S}?[\])]{_S}?|{_S}dot{_S}|\.)"
LOCAL = re.compile(_A)
AT_SIGN = re.compile(_AT, re.I)
DOMAIN = re.compile(rf"(?:(?![.]){_A})+?(?:{_DOT}[^\W_][\w-]*)+", re.I)
SPELLED_HINT = re.compile(rf"{_S}dot{_S}", re.I)
SPELLED = re.compile(rf"[A-Za-z0-9_+-]+(?:{_S}dot{_S}[A-Za-z0-9_+-]+)*{_S}at{_S}[A-Za-z0-9-]+(?:{_S}dot{_S}[A-Za-z0-9-]+)+(?![\w-])(?!{_S}at{_S}[\w-]+{_S}dot)", re.I)
HANDLE = re.compile(r"@\w[\w-]*(?![\w.-]*\.\w)")
URL = re.compile(r"(?:https?://|www\.)[^\s<>\"\])|]+")
PHONE = re.compile(rf"(?<![\w.,/$€£-])(?:\+\d{{1,3}}[\s.-]?)?(?:\(\d{{1,4}}\)[\s.-]?)?\d{{1,5}}(?:[\s.-]\d{{2,5}}){{1,4}}(?:\s?(?:ext\.?|x|extension)\s?\d{{1,5}})?(?![\w/]|[.,-]\d)")
SEPARATORS = (" ", "\n", "\t", ".", "-", ")", "\u00a0", "\u2009", "\u202f", "\u3000")
PHONE_SHAPE = re.compile(r"\+\d{1,3}[\s.-]\d{1,4}(?:[\s.-]\d{2,5}){1,3}$|\(\d{3}\)[\s.-]?\d{3}[\s.-]\d{4}$|(?:1[\s.-])?\d{3}([\s.-])\d{3}\1\d{4}$|0\d{1,3}(?:\s\d{2,5}){2,4}$")
ID = re.compile(r"(?:\d{3}-\d{2}-\d{4}|\d{2}/\d{3}/\d{5}|\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{1,2}\d{6,9}[A-Z]?|[Ａ-Ｚ]\d{6,9})")
WIDE_ID = re.compile(r"(?<![\w./-])(?=[^\s]*\d{3})[A-ZＡ-Ｚ]{0,3}\d[\d./-]{3,}\d[A-Z]?(?![\w/]|[.,-]\d)")
_NO = r"\d{1,4}[a-zA-Z]?"
_WORD = r"[^\W\d_]+"
_TOWN = rf"(?:(?:Saint|St\.?|Port|Mount|Fort|New|Old|North|South|East|West)\s)?(?-i:[A-ZＡ-ＺÀ-Þ]){_WORD[:-1]}+(?:\s(?:Heights|Hts\.?|Springs|Falls|Beach|City|Hills|Park))?"
_CODE = r"\d{4,6}"
_UNIT = r"(?:,?\s(?:Apt\.?|Apartment|Flat|Unit|Suite|Ste\.?|Room|Floor|No\.?|\#)\s?\w{1,5})"
_WAY = r"(?:Lane|Street|Road|Avenue|Drive|Court|Place|Square|Way|Close|Terrace|Crescent|Boulevard|Ave\.?|St\.?|Rd\.?|Ln\.?|Dr\.?|Blvd\.?|Ct\.?|Pl\.?)"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:{_NO}\s(?:{_WORD}\s){{1,2}}?{_WAY}(?!\w){_UNIT}?(?:,\s{_TOWN}(?:,?\s{_CODE})?)?"
    rf"|{_WORD}(?:str\.|straße|strasse|weg|platz|gasse)\s{_NO}(?:,\s(?:{_CODE}\s)?{_TOWN})?"
    rf"|{_NO},?\s(?:rue|avenue|boulevard|place|chemin|calle|avenida|via|plaza)\s(?:de\s)?{_WORD}(?:,\s(?:{_CODE}\s)?{_TOWN})?"
    rf"|(?:P\.\s?O\.|PO|Post(?:\sOffice)?)\s?Box\s\d{{1,6}}(?:,\s(?:{_CODE}\s)?{_TOWN}(?:,?\s{_CODE})?)?)(?![\w])",
    re.I,
)
# Addresses hold a number: where its house, way or box may stand before it.
NUMBER = re.compile(r"\d+")
WAY_BEFORE = re.compile(rf"{_WORD}(?:str\.|straße|strasse|weg|platz|gasse)\s$", re.I)
BOX_BEFORE = re.compile(r"(?:P\.\s?O\.|PO|Post(?:\sOffice)?)\sBox\s$", re.I)
WAY = re.compile(rf"(?<![\w-])(?:{_NO}\s)?[A-Z]{_WORD}\s(?:Lane|Street|Road|Avenue|Drive|Court|Square|Terrace|Crescent|Boulevard|Ave|Rd|Ln|Blvd)(?!\w)")
# Words around personal information, in the languages of the corpus.
PHONE_BEFORE = re.compile(r"(?:tel|tél|telefon|phone|call|reached on|fax|mobile|contact|or|тел|телефон|電話|电话|هاتف|फ़ोन|फ़ोन|โทร|teléfono|téléphone)[.:：]?\s*$", re.I)
NUMBER_BEFORE = re.compile(r"(?:lot|order|code|ref\.?|section|point|no\.|page|item|invoice|№)\s*$", re.I)
ID_BEFORE = re.compile(r"(?:passport|licen[cs]e|tax|national|security|insurance|identity|identification|\bID\b|SSN|NIN|ausweis|steuer|pasaporte|passeport|паспорт)[\w\s.:*_'\[\](/?=-]{0,60}$", re.I)
ADDRESS_BEFORE = re.compile(r"(?:lives at|goes to|address|adresse|anschrift|dirección|адрес|see|住所|地址|العنوان|पता|ที่อยู่|,)[:：]?\s*$", re.I)
TITLE_BEFORE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Gen|Col|Capt|Rev|Sr|Sra|Dra|M|Mme|Mlle|Herr|Frau|Hr|Fr|Señor|Señora)\.?|г-н|г-жа)\s$")
PERSON_BEFORE = re.compile(r"(?:\b(?:by|to|of|and|for|with|said|told|asked|according to|remove|witness|lists|an|a|lobte|hörte|félicité|écouté|écoute|elogió a|escuchó a|schreiben|write)|[.!?:\"“>*\[]|^)\s*$", re.I)
PERSON_AFTER = re.compile(r"^(?:['’]s|\s(?:said|told|and|called|who|lives|\w+ly\s\w+ed|\w+ed|twice|gave|für|pour|por|im|en)\b|[,.]\s|\s\()")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Gen|Col|Capt|Rev|Mme|Mlle|Herr|Frau|Señora?)\.?\s([A-ZÀ-Þ][^\W\d_]+(?:[ \n][A-ZÀ-Þ][^\W\d_]+)?)")
MONEY_NEAR = re.compile(r"[$€£]\s*$|(?:crowns|euros?|dollars|kg|tonnes|tons|pages|percent|%)\b", re.I)
BODY_AFTER = re.compile(r"^\s?(?:,?\s?(?:and|&)\sSons|\s(?:Brothers|Bros|Institute|Inst|Association|Assn|Company|Co\b|Corp|Limited|Ltd|International|Intl|Int'l|Foods|University|Street|Lane|Road|Ave|Football|Maritime|Observatory|Airport|Province|Heights|Formation|Marathon|Church))", re.I)
TOKEN = re.compile(r"[^\W\d_]+(?:[­​-‍⁠﻿̀-ͯ'’-]+[^\W\d_]+)*")
RUN = re.compile(r"[GSI]*[GS][GSI]*")


def _key(token: str) -> str:
    return re.sub("[­​-‍⁠﻿]", "", token).lower()


def gazetteer(mentions: DataFrame, texts: list[str], kind: str) -> DataFrame:
    """(token, class): every token of the mentions, mostly part of names of people, as a given name or a surname, or of other names.
    Counted over all mentions."""
    spelled = mentions.select(F.col(kind).alias("kind"), F.explode(F.array(*[F.col(t) for t in texts])).alias("t")).filter("t is not null and kind is not null").groupBy("kind", "t").agg(F.count(F.lit(1)).alias("n"))
    plain = F.lower(F.regexp_replace("t", "[­​-‍⁠﻿]", ""))
    comma = F.regexp_replace(F.regexp_replace(plain, r"^([^,]*),(.*)$", "$2 $1"), "['’]s?$", "")
    words = F.filter(F.split(F.when(F.col("kind") == "PERSON", comma).otherwise(plain), r"[^\p{L}\p{M}'’-]+"), lambda w: F.length(w) > 1)
    each = spelled.withColumn("w", words).select("kind", "n", F.posexplode("w").alias("i", "token"), F.size("w").alias("m"))
    person = F.col("kind") == "PERSON"
    last = F.col("i") == F.col("m") - 1
    sums = each.groupBy("token").agg(F.sum("n").alias("all"), F.sum(F.when(person, F.col("n")).otherwise(0)).alias("person"), F.sum(F.when(person & ~last, F.col("n")).otherwise(0)).alias("given"))
    return sums.select("token", F.when(F.col("person") <= 0.6 * F.col("all"), BODY).when(F.col("given") * 2 > F.col("person"), GIVEN).otherwise(SURNAME).alias("class"))


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


def _hashed(entries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([_hash(t) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(1).cast(pa.int8())], ["h", "class"])

    return entries.mapInArrow(run, "h long, class byte")


def _names(text: str, code_of: dict[str, str], blocked: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Spans built from tokens of the gazetteer and what stands beside them, and the form each has: G given name, S surname, I initial,
    O unknown word, a comma where the surname comes first. What is none (lone given names, lower-case words) is proposed too."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    line = "".join([code_of[text[a:b]] for a, b in tokens])
    french = (" le " in text or " la " in text or " avec " in text) and " the " not in text and " el " not in text
    for run in RUN.finditer(line):
        i, stop = run.start(), run.end()
        while i < stop:
            at = tokens[i][0]
            if line[i] == "I" and i + 1 < stop and text[at : at + 3] == "M. " and (line[i + 1] in "G" or french and re.search(r"(?:^|[.!?:>*\n-]\s*)$", text[max(0, at - 3) : at])):
                i += 1  # Monsieur
                continue
            seq = [i]
            j = i + 1
            comma = False
            while j < stop:
                gap = text[tokens[j - 1][1] : tokens[j][0]]
                c, form = line[j], "".join(line[x] for x in seq)
                low = text[tokens[j][0]].islower()
                if gap in (" ", "\n", " ") or (len(gap) == 1 and gap.isspace()) or (gap in (". ", ".\n", ".") and line[j - 1] == "I"):
                    done = re.search(r"^I*G+I*S$|^S[GI]$|^I+S$", form) if not comma else re.search(r"^S(?:G|I+)$", form)
                    if done and not (c == "I" and comma):
                        break
                    if form in ("S",) and c == "S" and not low:
                        break
                elif re.fullmatch(r",\s", gap) and form in ("S",) and c in "GI" and not comma:
                    after = text[tokens[j][1] : tokens[j + 1][0]] if j + 1 < len(tokens) else ""
                    if c in "G" and j + 1 < stop and line[j + 1] in "S" and after.isspace():
                        break
                    if c == "I" and not text[tokens[j][1] : tokens[j][1] + 1] == ".":
                        break
                    comma = True
                elif re.fullmatch(r"\s[\"“]", gap) and c in "G":
                    pass
                elif re.fullmatch(r"[\"”]\s", gap) and c in "S":
                    pass
                else:
                    break
                seq.append(j)
                j += 1
            form = "".join(line[x] for x in seq)
            a, b = tokens[seq[0]][0], tokens[seq[-1]][1]
            if form.strip("I"):
                if form[-1] == "I" and comma and text[b : b + 1] == ".":
                    b += 1
                word = re.sub(r"['’]s?$", "", text[a:b])
                b = a + len(word)
                if not any(a < y and x < b for x, y in blocked):
                    yield a, b, ("," if comma else "") + form
                    if form == "G" and j < len(tokens) and line[j] in "OK" and text[b : tokens[j][0]] == " " and text[tokens[j][0]].isupper() and text[a].isupper():
                        yield a, tokens[j][1], "G" + line[j]
            i = j
    for m in TITLED.finditer(text):
        words = m.group(1).split()
        form = "".join(code_of[w] for w in words)
        if form[0] in "OK" and not any(m.start(1) < y and x < m.end(1) for x, y in blocked):
            yield m.start(1), m.start(1) + len(words[0]) if len(words) > 1 and form[1] in "GS" else m.end(1), form[0] if len(words) > 1 and form[1] in "GS" else form


def _votes(votes: list[int]) -> int:
    """Two bits a labeler: 1 for, 2 against, 0 no opinion."""
    out = 0
    for i, v in enumerate(votes):
        out |= (v & 3) << (2 * i)
    return out


def _shape(word: str) -> str:
    """The word with letters as x, capitals as X and digits as 9, runs shortened."""
    return re.sub(r"(.)\1+", r"\1+", word.translate(_SHAPES)) if word.isascii() else "U" + str(len(word))


_SHAPES = {**{ord(c): "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{ord(c): "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "9" for c in "0123456789"}}


def _features(kind: str, text: str, a: int, b: int, votes: int) -> list[int]:
    """Places of the hashed features: words before and after, shape and length of the span."""
    before, after = text[max(0, a - 24) : a].split()[-2:], text[b : b + 24].split()[:2]
    span = text[a:b]
    one, two = (before[-1] if before else "^"), (after[0] if after else "$")
    return [_place["p" + one], _place["q" + before[0] if len(before) > 1 else "q"], _place["n" + two], _place["m" + after[1] if len(after) > 1 else "m"], _place["s" + _shape(span)], _place[f"l{min(len(span), 40) // 4}"], _place[f"w{span.count(' ')}{text[a - 1 : a]}|{text[b : b + 1]}"]]


class _Places(dict):
    """Feature -> its hashed place."""

    def __missing__(self, name: str) -> int:
        at = zlib.crc32(name.lower().encode("utf-8", "replace")) % PLACES
        if len(self) < 200_000:
            self[name] = at
        return at


_place = _Places()


def _mails(text: str) -> list[tuple[int, int]]:
    """Runs around an at sign with a domain after it, spelled-out addresses, and names after a bare at sign."""
    out: list[tuple[int, int]] = []
    if "@" in text or "(" in text or "[" in text:
        for m in AT_SIGN.finditer(text):
            a, least = m.start(), out[-1][1] if out else 0
            while a > least and LOCAL.match(text, a - 1):
                a -= 1
            if a < m.start() and (d := DOMAIN.match(text, m.end())):
                out.append((a, d.end()))
            elif m.group() == "@" and (d := HANDLE.match(text, m.start())):
                out.append((a, d.end()))
    if SPELLED_HINT.search(text):
        out += [m.span() for m in SPELLED.finditer(text) if not any(m.start() < y and x < m.end() for x, y in out)]
    return out


def _addresses(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    end = 0
    for at, stop in runs:
        if at < end:
            continue
        before = None
        if text[at - 1 : at].isspace() and text[max(0, at - 7) : at - 1].lower().endswith(("str.", "straße", "trasse", "weg", "platz", "gasse", "box")):
            near = text[max(0, at - 40) : at]
            before = WAY_BEFORE.search(near) or BOX_BEFORE.search(near[-16:])
        after = text[stop : stop + 1]
        if before or after.isspace() or after == "," or after.isalpha():
            if m := ADDRESS.match(text, at - len(before.group()) if before else at):
                out.append(m.span())
                end = m.end()
    return out


def _numbers(text: str, runs: list[tuple[int, int]]) -> tuple[list[re.Match], list[re.Match]]:
    """Matches of identity numbers and of phone numbers, none overlapping one of its kind."""
    ids, phones = [], []
    id_end = phone_end = 0
    for at, stop in runs:
        start = at
        while start > at - 3 and start > id_end and (text[start - 1].isupper() and (text[start - 1] < "[" or "Ａ" <= text[start - 1] <= "Ｚ")):
            start -= 1
        if at >= id_end and (m := WIDE_ID.match(text, start)):
            ids.append(m)
            id_end = m.end()
        if at >= phone_end and (text[stop : stop + 1] in SEPARATORS or text[at - 1 : at] in "+("):
            start = at - 1 if text[at - 1 : at] in ("+", "(") else at
            m = PHONE.match(text, start) or (PHONE.match(text, at) if start < at else None)
            if m:
                phones.append(m)
                phone_end = m.end()
    return ids, phones


class _Forms(dict):
    """What the form of a name tells by itself: votes of whole names, lone surnames, lone given names, unknown and known other words."""

    def __missing__(self, form: str) -> tuple[int, int, int, int, int]:
        whole = bool(re.search("[GI].*S|S.*[GI]|GG", form))
        self[form] = (1 if whole else 0, 1 if form == "S" else 0, 2 if form.strip("I") == "G" and not whole else 0, 2 if "O" in form or "K" in form else 0, 2 if "K" in form else 0)
        return self[form]


_forms = _Forms()


def find(text: str, code_of: dict[str, str]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, votes) of the candidates of a text; spans of several kinds may overlap. ``kind`` is a place in ``KINDS``."""
    out: list[tuple[int, int, int, int]] = []
    urls = [m.span() for m in URL.finditer(text)] if "://" in text or "www." in text else []
    inside = lambda a, b: any(x <= a and b <= y for x, y in urls)
    for a, b in _mails(text):
        s = text[a:b]
        a, b = a + len(s) - len(s.lstrip(".-+_")), b - len(s) + len(s.rstrip("_"))
        s = text[a:b]
        if not inside(a, b):
            parts = re.split(rf"{_DOT}", s)
            tld = parts[-1]
            before = text[max(0, a - 24) : a]
            votes = [1 if "@" in s else 0, 1 if re.search(r"[\[(]\s?at|\sat\s", s, re.I) and re.search(r"dot|\.", s, re.I) else 0, 1 if len(parts) > 1 and tld.isalpha() and 2 <= len(tld) <= 12 else 2, 1 if re.search(r"(?:to|contact|mail|e-mail|\(|:|：|or|копи|copy)\s?$", before, re.I) else 0, 2 if len(parts) == 1 else 0, 2 if s.startswith("@") else 0]
            out.append((0, a, b, _votes(votes)))
    runs = [m.span() for m in NUMBER.finditer(text)]
    seen: list[tuple[int, int]] = []
    if runs:
        for a, b in _addresses(text, runs):
            s = text[a:b]
            if not inside(a, b):
                votes = [1 if "," in s else 0, 1 if re.search(r"\d{5}", s) or re.search(r"Box", s, re.I) else 0, 1 if ADDRESS_BEFORE.search(text[max(0, a - 30) : a]) else 0, 1 if re.search(r"[A-Z]", s[:14].replace("P.O", "p.o")) or "rue" in s else 2, 1 if re.match(r"\d|p\.?\s?o|box|post", s, re.I) or re.search(r"\d", s) else 2, 2 if re.search(r"\s(?:rue|avenue|boulevard|place|chemin|calle|avenida|via|plaza)\s(?:de\s)?(?![A-ZÀ-Þ])", s) else 0]
                out.append((1, a, b, _votes(votes)))
                seen.append((a, b))
        for m in WAY.finditer(text):
            a, b = m.span()
            if not inside(a, b) and not any(a < y and x < b for x, y in seen):
                numbered = text[a].isdigit()
                out.append((1, a, b, _votes([0, 0, 1 if ADDRESS_BEFORE.search(text[max(0, a - 30) : a]) else 0, 1, 1 if numbered else 2, 0 if numbered else 2])))
        ids, phones = _numbers(text, runs)
        for m in ids:
            a, b = m.span()
            if not inside(a, b):
                s, before = m.group(), text[max(0, a - 70) : a]
                strict = re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{2}/\d{3}/\d{5}|\d{3}\.\d{3}\.\d{3}-\d{2}|[A-ZＡ-Ｚ]\d{8}|[A-Z]{2}\d{6}[A-Z]", s)
                votes = [1 if strict else 2, 1 if ID_BEFORE.search(before) else 0, 2 if NUMBER_BEFORE.search(before[-14:]) and not re.search(r"passport", before, re.I) else 0, 1 if len(s) >= 8 else 2, 0 if ID.fullmatch(s) else 2, 2 if MONEY_NEAR.search(before[-3:] + " ") or MONEY_NEAR.match(text[b : b + 10].lstrip()) else 0]
                out.append((2, a, b, _votes(votes)))
        for m in phones:
            a, b = m.span()
            s = m.group()
            core = re.split(r"\s?(?:ext|x)", s)[0]
            digits = sum(c.isdigit() for c in core)
            if digits >= 5 and not any(a < y and x < b for x, y in urls):
                before, after = text[max(0, a - 24) : a], text[b : b + 10].lstrip()
                votes = [1 if PHONE_SHAPE.match(core) else 2, 1 if PHONE_BEFORE.search(before) else 0, 2 if NUMBER_BEFORE.search(before) else 0, 1 if 10 <= digits <= 13 else 2, 2 if digits < 7 else 0, 2 if MONEY_NEAR.match(after) or MONEY_NEAR.search(before[-3:]) else 0, 1 if s[0] in "+(" or len(core) < len(s) else 0]
                out.append((3, a, b, _votes(votes)))
    for a, b, form in _names(text, code_of, urls):
        before, after = text[max(0, a - 24) : a], text[b : b + 24]
        small = text[a].islower() and text[b - 1].islower() and len(form) < 2
        whole, alone, given, unknown, known = _forms[form]
        votes = [whole, alone, 1 if TITLE_BEFORE.search(before) else 0, 1 if PERSON_BEFORE.search(before) else 0, 1 if PERSON_AFTER.match(after) else 0, 2 if BODY_AFTER.match(after) else 0, 2 if small else 0, given, unknown, known]
        out.append((4, a, b, _votes(votes)))
    return out


class _Codes(dict):
    """Token -> G given name, S surname, K part of other names, I initial, O unknown; filled as tokens come up, from a sorted table of hashes."""

    def __init__(self, hashes: np.ndarray, classes: np.ndarray) -> None:
        super().__init__()
        self.hashes, self.classes = hashes, classes

    def __missing__(self, token: str) -> str:
        bare = re.sub(r"['’]s?$", "", token)
        if len(bare) == 1:
            c = "I" if bare.isupper() else "O"
        else:
            h = np.uint64(_hash(_key(bare))).astype(np.int64)
            at = int(np.searchsorted(self.hashes, h))
            c = "?GSK"[self.classes[at]] if at < len(self.hashes) and self.hashes[at] == h else "O"
        if len(self) < 500_000:
            self[token] = c
        return c


def _text_tokens(text: str) -> set[int]:
    return {_hash(_key(re.sub(r"['’]s?$", "", m.group()))) for m in TOKEN.finditer(text)}


def candidates(docs: DataFrame, id_: str, text: str, entries: DataFrame, most: int = GAZETTEER_ROWS) -> DataFrame:
    """(id, kinds, starts, ends, votes, feats) of every text: its candidates side by side, ``FEATURES`` places of features each.

    A gazetteer of at most ``most`` entries is broadcast as a sorted table of hashes; a larger one is joined to the tokens of the texts.
    """
    kind = docs.schema[id_].dataType.simpleString()
    src = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    entries = materialise(_hashed(entries))
    table = None
    if entries.count() <= most:
        t = entries.toArrow().combine_chunks()
        order = np.argsort(t.column("h").to_numpy(), kind="stable")
        table = docs.sparkSession.sparkContext.broadcast((t.column("h").to_numpy()[order], t.column("class").to_numpy()[order]))
    else:
        src = src.withColumn("rid", F.xxhash64("id", "text"))

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [_text_tokens(t) if t else () for t in b.column(1).to_pylist()]
                at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                h = np.fromiter((x for own in sets for x in own), np.uint64, len(at)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(h)], ["rid", "h"])

        known = src.select("rid", "text").mapInArrow(tokens, "rid long, h long").distinct().join(entries, "h")
        known = known.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("h", "class"))).alias("known"))  # the known tokens of one text
        src = src.join(known, "rid", "left").select("id", "text", F.col("known.h").alias("h"), F.col("known.class").alias("class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = None if table is None else _Codes(*table.value)
        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            feats: list[int] = []
            offsets = [0]
            own = [None] * b.num_rows if codes is not None else list(zip(b.column(2), b.column(3)))
            for t, mine in zip(b.column(1).to_pylist(), own):
                if t:
                    if codes is None:
                        known = [x.values for x in mine]
                        c = _Codes(*(k.to_numpy() if k is not None else np.empty(0, np.int64) for k in known))
                    else:
                        c = codes
                    found = find(t, c)
                    rows += found
                    for k, x, y, v in found:
                        feats += _features(KINDS[k], t, x, y, v)
                offsets.append(len(rows))
            a = np.array(rows, np.int64).reshape(-1, 4)
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(a[:, i].astype(np.int32))) for i in range(4)]
            wide = pa.ListArray.from_arrays(pa.array(np.array(offsets) * FEATURES, pa.int32()), pa.array(np.array(feats, np.int16)))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, wide], ["id", "kinds", "starts", "ends", "votes", "feats"])

    return src.mapInArrow(run, f"id {kind}, kinds array<int>, starts array<int>, ends array<int>, votes array<int>, feats array<short>")


def _unpack(patterns: np.ndarray) -> np.ndarray:
    return np.stack([(patterns >> (2 * i)) & 3 for i in range(LABELERS)], 1)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern of votes, and P(vote | truth) of each labeler, by expectation-maximisation from the majority vote."""
    v = _unpack(patterns)
    post = np.clip(0.5 + 0.5 * ((v == 1).sum(1) - 1.5 * (v == 2).sum(1)) / np.maximum(1, (v > 0).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((post * counts).sum() / counts.sum(), 0.05, 0.95)
        like = np.zeros((2, LABELERS, 3))
        for truth, p in ((0, 1 - post), (1, post)):
            for vote in range(3):
                like[truth, :, vote] = ((v == vote) * (p * counts)[:, None]).sum(0) + (2.0 if (vote == 1) == bool(truth) and vote else 1.0)
        like /= like.sum(2, keepdims=True)
        # silence says nothing, and no labeler is believed to speak for the opposite of what it says
        ratio = np.log(like[1] / like[0])
        gain = np.where(v == 1, np.maximum(0, ratio[:, 1]), 0) + np.where(v == 2, np.minimum(0, ratio[:, 2]), 0)
        log = (np.log((1 - prior) / prior) - gain.sum(1), 0.0)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, like


def span_classifier(votes: np.ndarray, feats: np.ndarray, post: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic model over votes and features, trained on the posteriors. Places beyond ``PLACES`` are the votes'."""
    x = _places(votes, feats)
    w, g2 = np.zeros(PLACES + 4 * LABELERS + 1), np.full(PLACES + 4 * LABELERS + 1, 1e-8)
    for _ in range(steps):  # gradient steps with a rate of its own for each weight
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        grad = np.bincount(x.ravel(), np.repeat((p - post) / len(post), x.shape[1]), len(w)) + 1e-4 * w
        g2 += grad * grad
        w -= 0.5 * grad / np.sqrt(g2)
    return w


def _places(votes: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """A row for each span: the places of its features, of its votes and of the constant."""
    v = _unpack(votes) + 4 * np.arange(LABELERS)[None, :] + PLACES
    return np.concatenate([feats.astype(np.int64), v, np.full((len(v), 1), PLACES + 4 * LABELERS)], 1)


def _fit(found: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, tuple[int, np.ndarray]]]:
    """For each kind the weights of its classifier, and (candidates, P(vote | truth)). The votes of all candidates are counted; the
    classifier learns from at most about ``TRAIN_SPANS`` of each kind, drawn by hash."""
    each = found.select("id", "feats", F.posexplode(F.arrays_zip("kinds", "votes", "starts")).alias("i", "c"))
    # at most 3 ** LABELERS patterns for each of five kinds, whatever the corpus
    tally = each.groupBy(F.col("c.kinds").alias("kind"), F.col("c.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = {k: sum(r.n for r in tally if r.kind == k) for k in range(len(KINDS))}
    share = F.element_at(F.array(*[F.lit(min(1.0, TRAIN_SPANS / max(1, total[k]))) for k in range(len(KINDS))]), F.col("c.kinds") + 1)
    drawn = each.filter(F.pmod(F.xxhash64("id", "c.starts", "c.kinds"), F.lit(1 << 30)) < share * (1 << 30))
    drawn = drawn.select(F.col("c.kinds").alias("kind"), F.col("c.votes").alias("votes"), F.slice("feats", F.col("i") * FEATURES + 1, F.lit(FEATURES)).alias("feats")).toArrow()
    weights, learnt = {}, {}
    kinds, votes = drawn.column("kind").to_numpy(), drawn.column("votes").to_numpy()
    feats = drawn.column("feats").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    for k in range(len(KINDS)):
        own = [(r.votes, r.n) for r in tally if r.kind == k]
        if own and (kinds == k).any():
            patterns, counts = np.array([x for x, _ in own]), np.array([float(n) for _, n in own])
            post, like = reliabilities(patterns, counts)
            order = np.argsort(patterns)
            mine = kinds == k
            weights[k] = span_classifier(votes[mine], feats[mine], post[order][np.searchsorted(patterns[order], votes[mine])])
            learnt[k] = (int(counts.sum()), like)
    return weights, learnt


def scored(docs: DataFrame, id_: str, text: str, mentions: DataFrame, mention_texts: list[str], mention_kind: str, threshold: float = 0.5, most: int = GAZETTEER_ROWS) -> DataFrame:
    """Every candidate: (id, kind, start_pos, end_pos, probability, accepted). Accepted are those of ``threshold`` or more that no accepted
    span of an earlier kind, or a longer or likelier one of their own kind, overlaps."""
    found = materialise(candidates(docs, id_, text, gazetteer(mentions, mention_texts, mention_kind), most))
    shared = docs.sparkSession.sparkContext.broadcast(_fit(found)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            flat = [b.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(1, 6)]
            kinds, starts, ends, votes = flat[:4]
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            feats = flat[4].reshape(-1, FEATURES)
            p = np.zeros(len(kinds))
            for k, w in weights.items():
                own = kinds == k
                p[own] = 1 / (1 + np.exp(-np.clip(w[_places(votes[own], feats[own])].sum(1), -30, 30)))
            taken = np.zeros(len(kinds), bool)
            order = np.lexsort((-p, starts - ends, kinds, row))
            order = order[p[order] >= threshold]
            held: list[tuple[int, int]] = []
            current = -1
            for i, r, a, e in zip(order.tolist(), row[order].tolist(), starts[order].tolist(), ends[order].tolist()):
                if r != current:
                    current, held = r, []
                if not any(a < y and x < e for x, y in held):
                    held.append((a, e))
                    taken[i] = True
            names = pa.array([KINDS[k] for k in kinds.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names, pa.array(starts), pa.array(ends), pa.array(p), pa.array(taken)], ["id", "kind", "start_pos", "end_pos", "probability", "accepted"])

    kind = docs.schema[id_].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, kind string, start_pos int, end_pos int, probability double, accepted boolean").withColumnRenamed("id", id_)


def spans(docs: DataFrame, id_: str, text: str, mentions: DataFrame, mention_texts: list[str], mention_kind: str, threshold: float = 0.5, most: int = GAZETTEER_ROWS) -> DataFrame:
    """(id, kind, start_pos, end_pos, probability), positions in code points, of all personal information found; spans do not overlap.

    Null and empty texts have none. Texts are read whole. Rows repeated are read each. An empty gazetteer leaves all names unfound but
    those after a title, other kinds as they are. Other columns are ignored.
    """
    return scored(docs, id_, text, mentions, mention_texts, mention_kind, threshold, most).filter("accepted").drop("accepted")


def masked(docs: DataFrame, id_: str, text: str, found: DataFrame) -> DataFrame:
    """(id, text) with a typed placeholder for each span; of overlapping spans the first, then the longer, counts. Ids must tell texts apart;
    a text without spans, null included, stays as it is."""
    order = F.array_sort(F.collect_list(F.struct("start_pos", (-F.col("end_pos")).alias("neg"), "kind")))  # the spans of one text
    per = found.groupBy(F.col(id_).alias("_id")).agg(order.alias("spans"))

    def step(acc, s):
        end = -s["neg"]
        skip = s["start_pos"] < acc["at"]
        piece = F.concat(F.substring(F.col("_t"), acc["at"] + 1, s["start_pos"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(skip, acc).otherwise(F.struct(F.concat(acc["parts"], F.array(piece)).alias("parts"), end.alias("at")))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    joined = docs.select(F.col(id_), F.col(text).cast("string").alias("_t")).join(per, F.col(id_).eqNullSafe(F.col("_id")), "left")
    folded = joined.withColumn("acc", F.aggregate("spans", start, step))
    whole = F.concat(F.array_join("acc.parts", ""), F.substring(F.col("_t"), F.col("acc.at") + 1, F.length("_t")))
    return folded.select(id_, F.when(F.col("spans").isNull(), F.col("_t")).otherwise(whole).alias(text))
