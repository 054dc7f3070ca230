"""Markup residue in text: a tree-structured model tells syntax from content, then texts are rewritten.

A text is parsed into nested nodes as a lenient browser would do it: the document, its lines, the elements that an opening
and a closing piece enclose (tags, links, templates, environments, commands with braces, fences, formulas, emphasis), the
lines within elements of several lines, and the single pieces. The document has a format (plain, HTML, Markdown, wiki, TeX),
a line that and a role (prose, code, markup), an element or piece is syntax or content. Potentials tie each node to its parent
by the kinds and states of both; they are counted on labelled pages, which are rendered in every format from clean lines of
the corpus. Sum-product messages up and down the tree give the marginal of every node.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Clean texts at most that labelled pages are made of.
TRAIN_PAGES = 1500
FORMATS = ["plain", "html", "markdown", "wiki", "tex"]
ROLES = ["prose", "code", "markup"]
# Element names of HTML and of wiki texts.
ELEMENTS = (
    "a abbr article aside b blockquote body br button caption center cite code col dd del div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav nowiki "
    "ol option p pre q ref references s samp script section select small source span strike strong style sub sup syntaxhighlight table tbody td textarea tfoot th thead title tr tt u ul var video wbr gallery includeonly noinclude onlyinclude poem svg path"
).split()
# Tags that frame the documents of the collection and are not of their texts.
FRAME = re.compile(r"^\s*</?(?:DOC|DOCID|DATETIME|POSTER|BODY|TEXT|DATELINE|HEADLINE|DOCTYPE|POSTDATE|post|doc)\b")
_names = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_bare = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_full = {n[:-1] for n in html5 if n.endswith(";")}
# Kinds of pieces, the more specific first; the last ones are mostly plain use of the same characters.
PIECES: list[tuple[str, str]] = [
    ("comment", r"<!--|-->"),
    ("tag", rf"</?(?i:{_names})(?:\s[^<>\n]*)?/?>"),
    ("tag_other", r"</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s<>]+))*\s*/?>"),
    ("tag_broken", rf"</?(?i:{_names})(?:\s+[\w:-]+=[^<>\n]*)?(?=\s|$|<|\.|,)(?!\s*[=<>]?\s*\d)|(?<![\w<])/(?i:{_names})>|</?(?i:{_names})$"),
    ("entity_tag", rf"&lt;/?(?i:{_names})(?:\s[^&\n]*)?/?&gt;"),
    ("entity", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"),
    ("entity_broken", rf"&(?:#\d{{2,5}}|{_bare})(?![A-Za-z0-9=])"),
    ("md_link", r"!?\[[^\]\n]*\]\([^)\n]*\)|\]\((?:https?://|[\w./]+\))|!\[[^\[\]\n]*\]?(?=\(|$)"),
    ("wiki_link", r"\[\[|\]\]"),
    ("ext_link", r"\[(?:https?:)?//[^\s\]]+"),
    ("template", r"\{\{\{?|\}\}\}?(?!\$)"),
    ("wiki_table", r"(?m:^[ \t]*(?:\{\|.*|\|[-}+].*|[|!](?!\|).*?(?:\|\||!!).*)$)"),
    ("md_table", r"(?m:^[ \t]*\|(?:[^|\n]*\|){2,}[ \t]*$|^[ \t]*:?-{3,}:?(?:[ \t]*\|[ \t]*:?-{3,}:?)+[ \t]*$)"),
    ("table_row", r"(?m:^[ \t]*[|!][ \t][^|\n]*$)"),
    ("quotes", r"(?<!')'{2,5}(?!')"),
    ("fence", r"(?m:^[ \t]*(?:```|~~~)[\w+-]*[ \t]*$)|```"),
    ("inline_code", r"(?<!`)`[^`\n]+`(?!`)"),
    ("emphasis", r"\*\*\*?(?=\S)|(?<=\S)\*\*\*?|(?<![\w])__(?=\S)|(?<=\S)__(?!\w)|~~"),
    ("single_emphasis", r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?![\w_])"),
    ("md_heading", r"(?m:^[ \t]{0,3}#{1,6}[ \t]+(?=\S))"),
    ("wiki_heading", r"(?m:^[ \t]*={2,6}[ \t]*[^=\n].*$|[ \t]={2,6}[ \t]*$)"),
    ("path", r"(?<!\w)[A-Za-z]:\\[\w\\.-]+"),
    ("display_math", r"\$\$|\\\[(?!\d)|\\\]|\\\(|\\\)"),
    ("inline_math", r"(?<![\w$\\])\$(?![\s\d][^$\n]*\$?\d)(?=[^$\n]*[\\^_={}+])[^$\n]+\$(?!\d)|(?<![\w$\\])\$[a-zA-Z]\$"),
    ("tex_environment", r"\\(?:begin|end)\s?\{[^}\n]*\}?"),
    ("tex_command", r"\\[a-zA-Z]{2,}\*?|\\[a-zA-Z](?=[{\s])"),
    ("tex_break", r"\\\\(?:\[[\w.]+\])?"),
    ("tex_escape", r"\\[%&$#_{}~^,;!\"'`]"),
    ("tex_script", r"(?<=[\w)}])[_^]\{"),
    ("tex_tie", r"(?<=[A-Za-z.])~(?=[A-Za-z\\\d])"),
    ("money", r"\$\d[\d.,]*"),
    ("note", r"\[[^\[\]\n]*\]"),
    ("compare", r"<=|>=|<>|&&|<(?=[\s\d%=-])|>(?=[\s\d%=-])|->|=>"),
    ("approx", r"~(?=\d)"),
    ("number_sign", r"#(?=[\w])"),
    ("power", r"\^"),
    ("star", r"\*"),
    ("underscore", r"(?<=\w)_(?=\w)"),
    ("ampersand", r"&"),
    ("angle", r"[<>]"),
    ("brace", r"[{}]"),
    ("pipe", r"\|"),
    ("other", r"[`~\\$#=]{1,3}"),
]
# kinds told by more than a pattern: tags and environments that hold what is not prose
KIND = {k: i for i, k in enumerate([*(k for k, _ in PIECES), "tag_code", "tag_math", "tex_verbatim"])}
NAMES = list(KIND)
#: What a piece can begin with; at any other place no pattern is tried.
BEGIN = r"(?=[<>&*_`\[\]{}\\$#=|~^'!/-]|[ \t:][ \t=|!#`~:<{-]|[A-Za-z]:\\)"
SCAN = re.compile(BEGIN + "(?:" + "|".join(f"({p})" for _, p in PIECES) + ")")
SUSPECT = re.compile(r"[<>&*_`\[\]{}\\$#=|~^]|''")
CODE_WORD = re.compile(r"(?:for|if|while|def|return|else|elif|class|import|from|SELECT|INSERT|UPDATE|WHERE|FROM|var|let|const|int|print)\b")
CODE_SIGN = re.compile(r"[(){}:;=*]")
CODE_START = re.compile(r"\w[\w.\[\]'\"]*\s*(?:\+=|-=|=|:=)\s")
CODE_END = re.compile(r"[}{)]+;?")
TEX_ROW = re.compile(r"&[^&\n]*\\\\")
# Elements that hold code, that hold formulas, and that are never closed.
CODE_TAGS, MATH_TAGS = {"pre", "code", "syntaxhighlight", "nowiki", "kbd", "samp"}, {"math", "sup", "sub"}
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
TAG_NAME = re.compile(r"</?([A-Za-z][\w:-]*)")
#: Kinds of pieces that can enclose something, and those of them that end with their line.
LINE_ONLY = {KIND[k] for k in ("wiki_link", "emphasis", "quotes")}
TAGS = {KIND[k] for k in ("tag", "tag_other", "tag_code", "tag_math")}
COMMANDS = {KIND[k] for k in ("tex_command", "tex_script")}


def pieces(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all pieces of a text that could be markup."""
    out = []
    for m in SCAN.finditer(text):
        k = m.lastindex - 1
        if k == KIND["entity"] and m.group()[1] != "#" and m.group()[1:-1] not in _full:
            k = KIND["ampersand"]
        elif k == KIND["tag"]:
            name = TAG_NAME.match(m.group()).group(1).lower()
            k = KIND["tag_code"] if name in CODE_TAGS else KIND["tag_math"] if name in MATH_TAGS else k
        elif k == KIND["tex_environment"] and re.search("verbatim|lstlisting", m.group()):
            k = KIND["tex_verbatim"]
        out.append((k, m.start(), m.end()))
    return out


def _side(k: int, piece: str) -> tuple[str, int] | None:
    """What a piece opens (1), closes (-1) or either (0), by a key that both sides share."""
    if k in TAGS:
        name = TAG_NAME.match(piece)
        name = name.group(1).lower() if name else ""
        return None if name in VOID_TAGS or piece.endswith("/>") else ("<" + name, -1 if piece.startswith("</") else 1)
    if k == KIND["brace"] or k == KIND["tex_script"]:
        return ("{", -1 if piece == "}" else 1)
    if k == KIND["wiki_link"]:
        return ("[[", 1 if piece == "[[" else -1)
    if k == KIND["template"]:
        return ("{" * len(piece), 1 if piece[0] == "{" else -1)
    if k == KIND["tex_environment"] or k == KIND["tex_verbatim"]:
        return ("\\" + piece[piece.find("{") + 1 :].rstrip("}"), 1 if piece.startswith("\\begin") else -1)
    if k == KIND["fence"]:
        return ("fence", 0)
    if k == KIND["emphasis"] or k == KIND["quotes"]:
        return (piece, 0)
    if k == KIND["display_math"]:
        return ("$$", 0) if piece == "$$" else ("\\[" if piece in ("\\[", "\\]") else "\\(", 1 if piece in ("\\[", "\\(") else -1)
    if k == KIND["comment"]:
        return ("<!", 1 if piece == "<!--" else -1)
    if k == KIND["wiki_table"]:
        body = piece.lstrip()
        return ("{|", 1) if body.startswith("{|") else ("{|", -1) if body.startswith("|}") else None
    return None


def partners(text: str, own: list[tuple[int, int, int]]) -> list[int]:
    """For each piece the one that closes or opens its element, -1 for none. Elements nest; what crosses another stays single."""
    out = [-1] * len(own)
    stack: list[tuple[str, int, int]] = []
    live: dict[str, int] = {}
    dead: set[int] = set()
    short: list[tuple[str, int]] = []
    line_end = -1
    for i, (k, s, e) in enumerate(own):
        if s > line_end:
            for key, j in short:  # emphasis and the like end with the line
                if out[j] < 0 and j not in dead:
                    dead.add(j)
                    live[key] -= 1
            short = []
            line_end = text.find("\n", s)
            line_end = len(text) if line_end < 0 else line_end
        side = _side(k, text[s:e])
        if side is None:
            continue
        key, way = side
        if way <= 0 and live.get(key, 0) > 0:
            while True:
                name, j, _ = stack.pop()
                if j in dead:
                    continue
                live[name] -= 1
                dead.add(j)
                if name == key:
                    break
            out[i], out[j] = j, i
        elif way >= 0:
            stack.append((key, i, s))
            live[key] = live.get(key, 0) + 1
            if k in LINE_ONLY:
                short.append((key, i))
    # a command whose argument is in braces encloses it: both braces are the command's
    for i in range(1, len(own)):
        if own[i][0] == KIND["brace"] and out[i] > i and own[i - 1][0] == KIND["tex_command"] and own[i - 1][2] == own[i][1]:
            out[i - 1] = out[i]
    return out


class Forest:
    """The trees of many texts side by side: for each node its type (0 document, 1 line, 2 element or piece), kind, parent, depth and, for
    lines, look; ``node`` tells the node of each piece, ``pieces`` (text, kind, start, end, partner) of each."""

    def __init__(self) -> None:
        self.typ: list[int] = []
        self.kind: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.look: list[int] = []
        self.at: list[tuple[int, int]] = []
        self.node: list[int] = []
        self.pieces: list[tuple[int, int, int, int, int]] = []

    def _add(self, typ: int, kind: int, parent: int, look: int, at: tuple[int, int]) -> int:
        self.typ.append(typ)
        self.kind.append(kind)
        self.parent.append(parent)
        self.depth.append(0 if parent < 0 else self.depth[parent] + 1)
        self.look.append(look)
        self.at.append(at)
        return len(self.typ) - 1

    def plant(self, owner: int, text: str) -> None:
        """Adds the tree of a text; one without pieces has none."""
        own = pieces(text)
        if not own:
            return
        other = partners(text, own)
        root = self._add(0, 0, -1, 0, (owner, 0))
        of = [-1] * len(own)
        boxes: list[tuple[int, int, int]] = []  # node, closing piece, line
        line, line_no, end, row = root, 0, -1, None
        for i, (k, s, e) in enumerate(own):
            while boxes and boxes[-1][1] < i:
                boxes.pop()
            if s > end:
                a = text.rfind("\n", 0, s) + 1
                end = text.find("\n", s)
                end = len(text) if end < 0 else end
                line_no += 1
                line = self._add(1, 0, boxes[-1][0] if boxes else root, int(_code_line(text[a:end])), (owner, a))
                row = TEX_ROW.search(text, a, end)
            if k == KIND["ampersand"] and row:
                k = KIND["tex_break"]
            if 0 <= other[i] < i:
                of[i] = of[other[i]]
            elif i and other[i] > i and own[i - 1][0] == KIND["tex_command"] and other[i - 1] == other[i]:
                of[i] = of[i - 1]  # the opening brace of a command
            else:
                of[i] = self._add(2, 2 * k + (other[i] > i), boxes[-1][0] if boxes and boxes[-1][2] == line_no else line, 0, (owner, s))
                if other[i] > i:
                    boxes.append((of[i], other[i], line_no))
            self.node.append(of[i])
            self.pieces.append((owner, k, s, e, other[i]))


class Model:
    """Log potentials, learnt by counting. ``root`` of a format; ``line`` of a line's format and role given the parent's kind and state;
    ``child`` of an element's kind and state given the parent's; ``look`` of a line given its role. Kind 0 of a parent is the document
    (or, for elements, a line), the others are those of elements."""

    STATES = 15  # format x role of a line; a document uses the first five, an element the first two

    def __init__(self, root: np.ndarray, line: np.ndarray, child: np.ndarray, look: np.ndarray) -> None:
        norm = lambda a, axes: np.log(a / a.sum(axes, keepdims=True))
        self.root = norm(root, -1)
        base = line[1:].sum(0, keepdims=True)
        base = base / base.sum(-1, keepdims=True)
        line = np.concatenate([line[:1], line[1:] + 5 * base])
        self.line = norm(line, -1)
        # a parent of a kind that was rarely seen is taken for one of any kind
        own = child[1:].sum(0, keepdims=True) + 1e-3
        own, of_line = own / own.sum((-1, -2), keepdims=True), child[:1].sum(1, keepdims=True)
        anywhere = of_line.sum((0, 1)) / of_line.sum()
        state = child.sum((2,)) + 1e-3  # parent kind, parent state, state
        by_state = (child.sum((0, 1)) + 0.02) / (child.sum((0, 1)) + 0.02).sum(0, keepdims=True)  # kind given state
        factored = (state / state.sum(-1, keepdims=True))[:, :, None, :] * by_state[None, None]
        rest = np.concatenate([factored[:1], np.broadcast_to(0.5 * own + 0.5 * anywhere[None, None], child[1:].shape)])
        self.child = norm(child + 30 * rest, (-1, -2))
        self.look = norm(look, -1)
        own_share = child.sum((0, 1))
        self.by_kind = own_share[:, 1] > own_share[:, 0]  # what a kind alone would be taken for

    def marginals(self, f: Forest) -> np.ndarray:
        """P(syntax) of each node, exact; all trees at once, depth by depth."""
        typ, kind, parent, depth, look = (np.array(x, np.int64) for x in (f.typ, f.kind, f.parent, f.depth, f.look))
        n, none = len(typ), -1e30
        up = np.full((n, self.STATES), none)
        docs, lines, items = typ == 0, typ == 1, typ == 2
        up[docs, :5] = self.root
        up[lines] = np.tile(self.look.T[look[lines]], 5)  # state = 3 * format + role
        up[items, :2] = 0.0
        pk = np.where(parent < 0, 0, np.where(typ[parent] == 2, kind[parent] + 1, 0))
        sent, down = np.zeros((n, self.STATES)), np.zeros((n, self.STATES))
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]

        def table(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # node, state of the parent, own state
            return (self.line[pk[own]], up[own]) if typ[own[0]] == 1 else (self.child[pk[own], :, kind[own], :], up[own][:, :2])

        for level in reversed(levels[1:]):
            for own in (level[typ[level] == 1], level[typ[level] == 2]):
                if len(own):
                    t, u = table(own)
                    sent[own] = _logsum(t + u[:, None, :], 2)
                    np.add.at(up, parent[own], sent[own])
        for level in levels[1:]:
            for own in (level[typ[level] == 1], level[typ[level] == 2]):
                if len(own):
                    t, _ = table(own)
                    above = up[parent[own]] + down[parent[own]] - sent[own]
                    d = _logsum(t + above[:, :, None], 1)
                    down[own, : d.shape[1]] = d
        both = up[:, :2] + down[:, :2]
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


class _Page:
    """A page being rendered: its text, the spans of it that are syntax and the role of each line."""

    def __init__(self, rng: np.random.Generator, lines: list[str]) -> None:
        self.rng, self.lines, self.text, self.syntax, self.roles, self.role = rng, lines, "", [], [], 0

    def put(self, text: str) -> None:
        self.text += text

    def mark(self, text: str) -> None:
        if text:
            self.syntax.append((len(self.text), len(self.text) + len(text)))
            self.text += text

    def end(self, role: int = 0) -> None:
        self.roles.append(role)
        self.text += "\n"

    def pick(self, some: list):
        return some[self.rng.integers(len(some))]

    def words(self, most: int = 4) -> str:
        w = self.pick(self.lines).split()
        at = int(self.rng.integers(max(1, len(w) - most)))
        return " ".join(w[at : at + 1 + int(self.rng.integers(most))])

    def number(self) -> str:
        return str(int(self.rng.integers(1, 100)))

    def wrap(self, a: str, b: str, inner) -> None:
        """Something between two delimiters; now and then one of them is lost or cut short."""
        r = self.rng.random()
        self.mark("" if r < 0.08 else a[:-1] if r < 0.12 and len(a) > 2 and a[0] == "<" else a)
        inner()
        r = self.rng.random()
        self.mark("" if r < 0.08 else b[:-1] if r < 0.12 and len(b) > 2 and b[0] == "<" else b)


# How each format writes the same things: pairs of delimiters around a phrase, and what stands by itself.
INLINE = {
    1: [("<b>", "</b>"), ("<i>", "</i>"), ("<em class=\"x\">", "</em>"), ("<a href=\"https://e.example/a?id=3\">", "</a>"), ("<span style='color:red'>", "</span>"), ("<FONT SIZE=2>", "</FONT>"), ("<code>", "</code>"), ("<sup>", "</sup>"), ("&lt;i&gt;", "&lt;/i&gt;"), ("<!-- ", " -->"), ("&quot;", "&quot;")],
    2: [("**", "**"), ("__", "__"), ("~~", "~~"), ("`", "`"), ("[", "](https://e.example/b?id=1)"), ("*", "*"), ("_", "_"), ("![", "](pic.png)"), ("***", "***")],
    3: [("[[", "]]"), ("[[Word|", "]]"), ("'''", "'''"), ("''", "''"), ("{{", "}}"), ("{{cite|", "}}"), ("[https://e.example/c ", "]"), ("<ref>", "</ref>"), ("<ref name=\"r1\">", "</ref>"), ("<nowiki>", "</nowiki>"), ("[[Category:", "]]")],
    4: [("\\textbf{", "}"), ("\\emph{", "}"), ("\\footnote{", "}"), ("\\textit{", "}"), ("\\cite{", "}"), ("\\href{https://e.example}{", "}"), ("``", "''")],
}
SINGLE = {1: ["<br/>", "<br>", "&amp;", "&#8217;", "&nbsp;", "&nbsp", "<hr>", "&eacute;", "<img src=\"p.png\">"], 2: ["![pic](pic.png)", "  \\"], 3: ["<ref name=\"r1\"/>", "{{stub}}", "<br />", "&ndash;"], 4: ["\\%", "\\&", "~\\ref{a}", "\\\\[2pt]", "\\ldots ", "\\$"]}
HARMLESS = [
    "If x < {} and y > {}, it is late.", "They wrote 2^{} - 1 and ~{} more.", "It costs ${} to ${} a day.", "Rates ({}* hotels) fell <{}%.", "Ranked #{} of {}.", "The file C:\\new\\list_{} held {} * 3 entries.", "It [sic] was R&D at {} and {}.",
    "Their market_id field is >= {} and <= {}.", "Smith & Sons paid {} & {}.", "See [{}] and {}.", "a = {} or b = {}", "Follow @one_two #tag {} {}", "Set {{a, b}} has {} of {} parts.", "Press A|B or {} | {}.", "It took {} -> {} steps.", "It's the crew's {} 'or so' of {}.", "* {} and {}", "- {} of {}", "{}. First of {}",
]
CODE = [
    "for i in range({}):", "    total += rows[i]['qty']", "if (a < b && c > d) {{", "}}", "SELECT * FROM t WHERE c <> {}", "    return x * y;", "x = [{}]", "while (n <= {}) {{ n++; }}", "y = a ** {} + b[{}];", "vector<int> v({});", "print(f\"{{a}} & {}\")", "def __init__(self):", "m = {{'k': {}}};", "let s = a | b[{}] & ~c;",
    "INSERT INTO t VALUES ({}, 'x_y');", "const z = x => x * {};", "int *p = &q[{}];",
]


def _formula(p: _Page) -> str:
    return p.pick(["a^2 + b^2", "E = k x_{{2}}", "v_8 = d / t", "x_{{{}}} + {}", "\\frac{{a}}{{{}}}", "a < b"]).format(p.number(), p.number())


def _phrase(p: _Page, fmt: int) -> None:
    """One piece of inline markup of a format: something that stands by itself, a formula, or a phrase in one pair of delimiters or two."""
    r = p.rng.random()
    if r < 0.15:
        p.mark(p.pick(SINGLE[fmt]))
    elif r < 0.3:
        formula = _formula(p)
        a, b = {1: ("<i>", "</i>"), 2: ("$", "$"), 3: ("<math>", "</math>"), 4: ("$", "$")}[fmt]
        if a == "$":
            p.mark(f"${formula}$")
        else:
            p.wrap(a, b, lambda: p.put(formula))
    elif r < 0.4:
        (a, b), (c, d) = p.pick(INLINE[fmt]), p.pick(INLINE[fmt])
        p.wrap(a, b, lambda: (p.put(p.words(2) + " "), p.wrap(c, d, lambda: p.put(p.words(2)))))
    else:
        a, b = p.pick(INLINE[fmt])
        p.wrap(a, b, lambda: p.put(p.words(3)))


def _sentence(p: _Page, fmt: int) -> None:
    """A line of prose: plain words, harmless signs and, if the format has any, inline markup, in any order."""
    parts = [lambda: p.put(p.pick(p.lines) if p.rng.random() < 0.3 else p.words(6))]
    if p.rng.random() < 0.35:
        parts += [lambda: p.put(p.pick(HARMLESS).format(p.number(), p.number()))] * (1 + int(p.rng.integers(3)))
    if fmt and p.rng.random() < 0.6:
        parts += [lambda: _phrase(p, fmt)] * (1 + int(p.rng.integers(2)))

    def body() -> None:
        for i, j in enumerate(p.rng.permutation(len(parts)).tolist()):
            p.put(" " if i else "")
            parts[j]()

    if fmt == 1 and p.rng.random() < 0.4:
        p.wrap("<p>", "</p>", body)
    else:
        body()
    p.end()


def _block(p: _Page, fmt: int) -> None:
    """A heading, list, table, block of code or formula as the format writes it."""
    what = p.pick(["heading", "list", "table", "code", "formula", "box"])
    rows = 1 + int(p.rng.integers(3))
    code = lambda: (p.put(p.pick(CODE).format(p.number(), p.number())), p.end(1))
    if what == "heading":
        a, b = {1: ("<h2>", "</h2>"), 2: ("## ", ""), 3: ("== ", " =="), 4: ("\\section{", "}")}[fmt]
        p.wrap(a, b, lambda: p.put(p.words())) if fmt in (1, 4) else (p.mark(a), p.put(p.words()), p.mark(b))
        p.end(2)
    elif what == "list" and fmt in (1, 4):
        a, b = {1: p.pick([("<ul>", "</ul>"), ("<ol>", "</ol>")]), 4: p.pick([("\\begin{itemize}", "\\end{itemize}"), ("\\begin{enumerate}", "\\end{enumerate}")])}[fmt]

        def items() -> None:
            p.end(2)
            for _ in range(rows):
                p.wrap("<li>", "</li>", lambda: p.put(p.words(6))) if fmt == 1 else (p.mark("\\item "), p.put(p.words(6)))
                p.end(0)

        p.wrap(a, b, items)
        p.end(2)
    elif what == "table":
        cell = lambda: p.put(p.words(1) if p.rng.random() < 0.5 else p.number())
        a, b = {1: ("<table>", "</table>"), 2: ("", ""), 3: ("{| class=\"wikitable\"", "|}"), 4: ("\\begin{tabular}{lr}", "\\end{tabular}")}[fmt]
        p.mark(a)
        if a:
            p.end(2)
        for i in range(rows + 1):
            if fmt == 1:
                p.wrap("<tr><td>", "</td></tr>", lambda: (cell(), p.mark("</td><td>"), cell()))
            elif fmt == 2:
                p.mark(f"| {p.words(1)} | {p.number()} |" if i != 1 else "|---|---|")
            elif fmt == 3:
                p.mark(p.pick(["|-", f"| {p.words(1)} || {p.number()}", f"! {p.words(1)} !! {p.words(1)}"]))
            else:
                cell()
                p.mark(" & ")
                cell()
                p.mark(" \\\\")
            p.end(2)
        p.mark(b)
        if b:
            p.end(2)
    elif what == "code":
        a, b = {1: p.pick([("<pre><code>", "</code></pre>"), ("<pre>", "</pre>")]), 2: ("```" + p.pick(["", "python", "sql"]), "```"), 3: ("<syntaxhighlight lang=\"sql\">", "</syntaxhighlight>"), 4: ("\\begin{verbatim}", "\\end{verbatim}")}[fmt]
        p.mark(a)
        p.end(2)
        for _ in range(rows):
            code()
        p.mark(b)
        p.end(2)
    elif what == "formula":
        a, b = {1: ("<i>", "</i>"), 2: ("$$", "$$"), 3: ("<math>", "</math>"), 4: p.pick([("\\[ ", " \\]"), ("$$", "$$"), ("\\begin{equation} ", " \\end{equation}")])}[fmt]
        formula = _formula(p)
        p.wrap(a, b, lambda: p.put(formula))
        p.end(2)
    else:
        a, b = {1: p.pick([("<p>", "</p>"), ("<div class=\"c\">", "</div>"), ("<blockquote>", "</blockquote>"), ("<!--", "-->")]), 2: ("> ", ""), 3: ("{{Infobox", "}}"), 4: ("\\begin{quote}", "\\end{quote}")}[fmt]
        if fmt == 2:
            p.put(p.words(6))
        else:
            p.wrap(a, b, lambda: (p.end(2), _sentence(p, 0)) if p.rng.random() < 0.4 else p.put(p.words(6)))
        p.end(2)


def labelled_page(rng: np.random.Generator, lines: list[str]) -> tuple[int, str, list[tuple[int, int]], list[int]]:
    """(format, text, spans of syntax, role of each line) of a page rendered from clean lines: one line or several."""
    fmt, p = int(rng.integers(5)), _Page(rng, lines)
    for _ in range(1 if rng.random() < 0.5 else 2 + int(rng.integers(8))):
        r = rng.random()
        if fmt and r < 0.35:
            _block(p, fmt)
        elif r < 0.47:
            p.put(p.pick(CODE).format(p.number(), p.number()))
            p.end(1)
        else:
            _sentence(p, fmt)
    return fmt, p.text, p.syntax, p.roles


def train(clean: list[str], seed: int = 11, pages: int = 12_000) -> Model:
    """Potentials counted over ``pages`` labelled pages made of the lines of ``clean`` texts."""
    rng = np.random.default_rng(seed)
    lines = [l for t in clean for l in t.split("\n") if l.strip()] or ["A line of words."]
    k = 2 * len(KIND)
    root, look = np.full(5, 1.0), np.full((3, 2), 1.0)
    line, child = np.full((k + 1, Model.STATES, Model.STATES), 1e-6), np.zeros((k + 1, Model.STATES, k, 2))
    for f in range(5):
        line[0, f, 3 * f : 3 * f + 3] += 0.5
    for _ in range(pages):
        fmt, text, syntax, roles = labelled_page(rng, lines)
        f = Forest()
        f.plant(0, text)
        root[fmt] += 1
        starts = np.array([a for a, _ in syntax] or [-1])
        ends = np.array([b for _, b in syntax] or [-1])
        state = [0] * len(f.typ)
        for node, (_, _, s, e, _) in zip(f.node, f.pieces):
            state[node] |= int(((starts < e) & (ends > s)).any())
        for i, typ in enumerate(f.typ):
            if typ == 0:
                state[i] = fmt
            elif typ == 1:
                role = roles[text.count("\n", 0, f.at[i][1])]
                state[i] = 3 * fmt + role
                look[role, f.look[i]] += 1
        for i, up in enumerate(f.parent):
            if up >= 0:
                pk = f.kind[up] + 1 if f.typ[up] == 2 else 0
                if f.typ[i] == 1:
                    line[pk, state[up], state[i]] += 1
                else:
                    child[pk, state[up], f.kind[i], state[i]] += 1
    return Model(root, line, child, look)


def _code_line(line: str) -> bool:
    """Whether a whole line looks like code by its end or its start; linear in its length."""
    bare = line.strip()
    if not bare or bare[-1] in ";{":
        return bool(bare)
    word = CODE_WORD.match(bare)
    return bool(CODE_END.fullmatch(bare) or CODE_START.match(line.lstrip()) or (word and CODE_SIGN.search(bare, word.end())))


def _batch(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int, float, int]]]:
    """For each text its pieces (kind, start, end, marginal of its node, partner)."""
    f = Forest()
    for i, t in enumerate(texts):
        if t and SUSPECT.search(t):
            f.plant(i, t.replace("\r", " "))
    out: list[list[tuple[int, int, int, float, int]]] = [[] for _ in texts]
    if f.pieces:
        p = model.marginals(f)[np.array(f.node)].tolist()
        for (owner, k, s, e, other), q in zip(f.pieces, p):
            out[owner].append((k, s, e, q, other))
    return out


_DROP = re.compile(r"\\(?:cite|ref|label|usepackage|documentclass)\*?(?:\[[^\]]*\])?\{[^}]*\}")


def clean(text: str, found: list[tuple[int, int, int, float, int]], threshold: float = 0.5) -> str:
    """The text without syntax: headings as '# ' lines, items as '- ', code indented by four blanks, formulas as they are, cells parted by tabs."""
    out: list[str] = []
    at, code = 0, False
    for i, (k, s, e, p, other) in enumerate(found):
        if s < at or p < threshold:
            continue
        chunk, piece, kind = text[at:s], text[s:e], NAMES[k]
        out.append(re.sub(r"\n(?=[^\n])", "\n    ", chunk) if code else chunk)
        at, put = e, ""
        low = piece.lower()
        name = re.match(r"</?([a-z]+\d?)", low)
        tag = name.group(1) if name else ""
        if kind in ("tag", "tag_other", "tag_broken", "tag_code", "tag_math"):
            if tag in ("pre", "syntaxhighlight"):
                code, put = not low.startswith("</"), "\n"
            elif low.startswith("</"):
                put = "\n" if tag in ("p", "div", "li", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6") and text[e : e + 1] != "\n" else ""
            elif re.fullmatch(r"h[1-6]", tag):
                put = "# "
            elif tag == "li":
                put = "- "
            elif tag in ("br", "tr"):
                put = "\n"
            elif tag in ("td", "th"):
                put = "" if out and out[-1].endswith(("\n", "")) and not "".join(out[-2:]).strip() else "\t"
            elif tag in ("sup", "sub"):
                put = "^" if tag == "sup" else "_"
        elif kind in ("entity", "entity_broken"):
            put = html.unescape(piece if piece.endswith(";") else piece + ";")
        elif kind == "md_link":
            m = re.match(r"!?\[([^\]\n]*)\]", piece)
            put = m.group(1) if m and not piece.startswith("!") else ""
        elif kind == "wiki_link":
            if piece == "[[":
                end = text.find("]]", e)
                bar = text.find("|", e, end if end > 0 else e)
                if end > 0 and re.match(r"(?i)(?:category|file|image):", text[e:end]):
                    at = end + 2
                elif bar > 0:
                    at = bar + 1
        elif kind == "ext_link":
            at += 1 if text[at : at + 1] == " " else 0
            stop = text.find("\n", at)
            end = text.find("]", at, len(text) if stop < 0 else stop)
            if end > at:
                put, at = text[at:end], end + 1
        elif kind == "template":
            at = found[other][2] if other > i else at
        elif kind == "comment":
            at = found[other][2] if other > i else at
        elif kind in ("wiki_table", "md_table", "table_row"):
            body = piece.strip()
            rule = re.fullmatch(r"\{\|.*|\|[-}+].*|[-|: ]+", body)
            put = "" if rule else "\t".join(c.strip() for c in re.split(r"\|\|?|!!?", body.strip("|!")))
        elif kind == "fence":
            code = not code
        elif kind == "inline_code":
            put = piece.strip("`")
        elif kind == "single_emphasis":
            put = piece[1:-1]
        elif kind == "md_heading":
            put = "# "
        elif kind == "wiki_heading":
            put = "# " + piece.strip().strip("=").strip() if piece.strip().strip("=") else ""
        elif kind == "inline_math":
            put = piece.strip("$")
        elif kind in ("tex_environment", "tex_verbatim"):
            if kind == "tex_verbatim":
                code = piece.startswith("\\begin")
            m = re.match(r"\{[lcr|]+\}", text[e:])
            at += m.end() if m else 0
        elif kind == "tex_command":
            if m := _DROP.match(text, s):
                at = m.end()
            elif low in ("\\item",):
                put = "-"
            elif re.match(r"\\(?:sub)*section|\\chapter|\\title", low):
                put = "# "
            elif low == "\\footnote" and other > i:
                put = " ("
            elif other < 0 or low in ("\\frac", "\\sqrt"):
                put = piece  # part of a formula
        elif kind == "tex_break":
            put = "\t" if piece == "&" else "\n" if text[e : e + 1] != "\n" else ""
        elif kind == "tex_escape":
            put = piece[1:]
        elif kind == "tex_script":
            put = piece
        elif kind == "tex_tie":
            put = " "
        elif kind == "brace":
            of = found[other] if other >= 0 else None
            before = found[i - 1] if other > i and i else found[other - 1] if 0 < other < i else None  # the command of the braces
            command = before is not None and NAMES[before[0]] == "tex_command" and before[2] == (s if other > i else of[1])
            word = text[before[1] : before[2]].lower() if command else ""
            put = piece if not command or word in ("\\frac", "\\sqrt") else ")" if word == "\\footnote" and other < i else ""
        elif kind in ("pipe", "other", "star", "angle"):
            put = piece
        out.append(put)
    out.append(text[at:])
    done = "".join(out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", done)).strip("\n")


def fit(docs: DataFrame, text: str) -> Model:
    """Fitted on the ``TRAIN_PAGES`` clean texts that come first by their hash (all, if fewer). A share of the texts, such that about
    twice as many are left, is taken before any leaves its task; if too few of them are clean the share is raised."""
    t = docs.select(F.col(text).cast("string").alias("t"))
    h = F.xxhash64("t")
    plain = t.filter(~F.col("t").rlike(SUSPECT.pattern) & (F.length("t") < 20_000))
    share = min(1.0, 3 * TRAIN_PAGES / max(1, docs.count()))
    while True:
        some = plain.filter(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else plain
        got = [r.t for r in some.orderBy(F.pmod(h, F.lit(1 << 40)), "t").limit(TRAIN_PAGES).collect()]
        if len(got) == TRAIN_PAGES or share >= 1:
            return train(got)
        share = min(1.0, 4 * share)


def residue(docs: DataFrame, text: str, keep: list[str], model: Model | None = None, frames: bool = False) -> DataFrame:
    """``keep``, ``pieces`` (how many pieces of syntax the text holds), ``doubt`` (the largest marginal of any) and ``clean``.

    Null stays null with 0 pieces; a text without syntax is its own clean text. With ``frames`` a text that begins with a frame
    tag is taken for a frame line and left as it is. Without a ``model`` one is fitted on the texts themselves. The output has no
    columns but these; ``keep`` may not hold their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text))
    src = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in src.schema.fields[:-1]], T.StructField("pieces", T.IntegerType()), T.StructField("doubt", T.DoubleType()), T.StructField("clean", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            asked = [None if t and frames and FRAME.match(t) else t for t in texts]
            found = _batch(asked, shared.value)
            n = [sum(x[3] >= 0.5 for x in f) for f in found]
            doubt = [max((x[3] for x in f), default=0.0) for f in found]
            done = [clean(t, f) if t and c else t for t, f, c in zip(texts, found, n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32()), pa.array(doubt, pa.float64()), pa.array(done, pa.string())], names=[*keep, "pieces", "doubt", "clean"])

    return src.mapInArrow(run, schema)
