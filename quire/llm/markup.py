"""Markup to clean text: HTML, Markdown, wiki and LaTeX, alone or mixed, with headings, lists, code and formulas kept.

A text is read once for each kind of construct. Code and formulas are set aside first, so that signs in them mean nothing;
then each rule replaces its construct by plain text or by a neutral mark of structure, and notes the kind at that place.
Signs that open no construct stay as they are: ``6 < 64``, ``R&D``, ``5*``, ``#12``, ``$96``, double apostrophes inside an
abbreviation. Constructs with a sign at each end are found by one pass over the signs, so the time is proportional to the
length of a text, whatever is left open in it.

What comes out is cut into blocks, each with the kinds of markup met in it, and two passes of rules sort them. First by
themselves: a block with many links, or a long one without frequent words, is residue; a long one with frequent words is
text; headings, lists, code, formulas and tables are structure. Short or middling ones stay undecided and take the label of
the nearest decided neighbours. Residue is left out of the clean text; a text's kinds are those of its blocks.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalikes import skeleton

KINDS = ("html", "latex", "markdown", "wiki")
#: Thresholds of the block rules: share of characters in links, characters of a short and of a long block, share of frequent words.
LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.4, 40, 140, 0.05, 0.15
MAX_STOP_WORDS = 20_000

# HTML elements that open a block, and the other elements that count as markup.
_BLOCK_TAGS = "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul br".split()
_INLINE_TAGS = "a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em embed font i iframe img input ins kbd label link map mark meta meter noscript object output path q rp rt ruby s samp script small source span strike strong style sub sup svg textarea time tt u var video wbr".split()
_TAGS = set(_BLOCK_TAGS) | set(_INLINE_TAGS)
#: LaTeX commands without an argument that count as markup where they stand alone.
_BARE_COMMANDS = "item par noindent newline newpage maketitle tableofcontents centering hline bigskip medskip smallskip".split()

# Private marks while a text is being read; they are deleted from the input first.
_HELD, _LINK, _UNLINK = "\ue000", "\ue001", "\ue002"
_PRIVATE = re.compile("[\ue000-\ue002]")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
_MARKS = re.compile("[\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7]+")
_SIGNS = re.compile(r"[<&*_~`#>\[{|'=\\$]|^\s*[-+]\s|^\s*\d+\.\s", re.M)

_FENCE = re.compile(r"^(```|~~~)[^\n`]*\n(.*?)(?:^\1[ \t]*$|\Z)", re.M | re.S)
_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")
_DOLLARS = re.compile(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$])([^$\n]*)(?<=\S)\$(?![\w$])")
_IN_MATH = re.compile(r"[\\^_{}=+]")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<!\[CDATA\[|\]\]>", re.S | re.I)
_DROPPED = re.compile(r"<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:(?:\s|&nbsp;|/)[^<>]*)?)(?:>|(?=\Z))")
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")

_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_WIKI_OUT = re.compile(r"\[(https?://[^\s\]]+)(?:\s+([^\]\n]*))?\](?!\()")

_MD_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_MD_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
_MD_LINK = re.compile(r"\[([^\[\]\n]+)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
_MD_EM = re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_MD_QUOTE = re.compile(r"^ {0,3}>[ \t]+(?=\S)", re.M)
_MD_LIST = re.compile(r"^([ \t]*)(?:[-+*]|(\d{1,3})\.)[ \t]+(?=\S)(?!(?:[-*][ \t]+)+[-*][ \t]*$)", re.M)
_MD_TABLE = re.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$\n?", re.M)

_TEX_ENV = re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?")
_TEX_ITEM = re.compile(r"\\item\b(?:\[([^\]\n]*)\])?[ \t]*")
_TEX_BARE = re.compile(r"\\(?:" + "|".join(_BARE_COMMANDS) + r")(?![a-zA-Z])[ \t]*")


@dataclass
class Block:
    """A piece of clean text: what it is, whether it is content, its text, and the kinds of markup that stood in it."""

    kind: str
    label: str
    text: str
    kinds: list[str] = field(default_factory=list)


Edit = tuple[int, int, str]


def delimited(text: str, opener: re.Pattern, closer: Callable[[re.Match], str]) -> Iterator[tuple[re.Match, int, int]]:
    """Constructs from an opener to the first closer behind it: (opener, start of the closer, its end), none inside another.
    A closer (a pattern without regard to case) that isn't found once is not looked for again behind that place."""
    gone, at = {}, 0
    for m in opener.finditer(text):
        if m.start() < at:
            continue
        want = closer(m)
        if want in gone:
            continue
        end = re.compile(want, re.I | re.M).search(text, m.end())
        if end is None:
            gone[want] = True
            continue
        yield m, end.start(), end.end()
        at = end.end()


def paired(text: str, sign: str, sizes: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Stretches of one line between two equal runs of a sign: (start, size of the run, end), the outermost ones. A run opens
    where text follows and no word or sign stands before it, and closes where it is the other way round. A longer run closes
    a shorter one, its other signs belonging to the text."""
    s, found, waiting = re.escape(sign), [], {}
    for m in re.finditer(rf"\n|{s}+", text):
        if m[0] == "\n":
            waiting.clear()
            continue
        a, b = m.span()
        before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
        n = b - a
        if not before.isspace() and not (after.isalnum() or after == "_"):
            size = n if n in waiting else max((k for k in waiting if k < n), default=0) if sign == "'" else 0
            if size and b - size > waiting[size] + size:
                found.append((waiting[size], size, b))
                first = waiting[size]
                waiting = {k: v for k, v in waiting.items() if v < first}
                continue
        if n in sizes and n not in waiting and not after.isspace() and not (before.isalnum() or before == "_"):
            waiting[n] = a
    found.sort()
    out, last = [], -1
    for x in found:
        if x[0] >= last:
            out.append(x)
            last = x[2]
    return out


class _Reader:
    """One text on its way to clean text, with the kinds of markup met so far and where."""

    def __init__(self, text: str):
        self.text, self.notes, self.held = text, [], []

    @property
    def kinds(self) -> set[str]:
        return {k for _, k in self.notes}

    def edit(self, kind: str, edits: Iterable[Edit]) -> None:
        """Replace stretches, given in order and apart from each other, and note the kind where each of them was."""
        out, at, shift, notes, k = [], 0, 0, [], 0
        for a, b, new in edits:
            while k < len(self.notes) and self.notes[k][0] <= a:
                notes.append((self.notes[k][0] + shift, self.notes[k][1]))
                k += 1
            while k < len(self.notes) and self.notes[k][0] < b:
                notes.append((a + shift, self.notes[k][1]))
                k += 1
            # a construct that begins a block belongs to that block, one that ends a block to the one it ends
            notes.append((a + shift + (len(new) if new and not new.endswith("\n") else 0), kind))
            out += [self.text[at:a], new]
            shift += len(new) - (b - a)
            at = b
        if not out:
            return
        notes += [(o + shift, x) for o, x in self.notes[k:]]
        self.text, self.notes = "".join(out) + self.text[at:], sorted(notes)

    def rule(self, kind: str, pattern: re.Pattern, by: Callable[[re.Match], str | None]) -> None:
        """Replace every match; a rule that returns None leaves the match as text."""
        self.edit(kind, ((m.start(), m.end(), new) for m in pattern.finditer(self.text) if (new := by(m)) is not None))

    def hold(self, text: str, block: bool = False) -> str:
        """A place for text that no later rule may touch."""
        self.held.append(text)
        mark = f"{_HELD}{len(self.held) - 1}{_HELD}"
        return f"\n{mark}\n" if block else mark

    def release(self, text: str) -> str:
        while _HELD in text:
            text = re.sub(f"{_HELD}(\\d+){_HELD}", lambda m: self.held[int(m[1])], text)
        return text


def _tags() -> Callable[[re.Match], str | None]:
    """The rule for tags; it counts the entries of numbered lists."""
    lists: list[int | None] = []

    def by(m: re.Match) -> str | None:
        name = m[2].lower()
        if name not in _TAGS or (not m[0].endswith(">") and "=" not in m[3]):
            return None
        if name in ("ol", "ul"):
            if not m[1]:
                lists.append(0 if name == "ol" else None)
            elif lists:
                lists.pop()
            return "\n"
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return "\n\n" if m[1] else "\n\n" + "#" * int(name[1]) + " "
        if name == "li":
            if m[1]:
                return "\n"
            if lists and lists[-1] is not None:
                lists[-1] += 1
                return f"\n{lists[-1]}. "
            return "\n- "
        if name == "a":
            return _UNLINK if m[1] else _LINK
        if name in ("td", "th"):
            return " | "
        if name in ("br", "hr", "tr"):
            return "\n"
        return "\n\n" if name in _BLOCK_TAGS else ""

    return by


def _entity(m: re.Match) -> str | None:
    out = html.unescape(m[0])
    return None if out == m[0] else out


def _wiki_rows(body: str) -> str:
    rows = []
    for line in body.split("\n"):
        line = line.strip()
        if line.startswith(("|", "!")) and not line.startswith(("|-", "|+")):
            rows.append(" | ".join(c.strip() for c in re.split(r"\|\||!!", line[1:])))
    return "\n" + "\n".join(f"| {r} |" for r in rows) + "\n"


def _wiki_link(m: re.Match) -> str:
    """The label of a link; of an embedded file its caption."""
    if re.match(r"\s*(?:file|image|קובץ|תמונה)\s*:", m[1], re.I):
        parts = (m[2] or "").split("|")
        caption = parts[-1].strip()
        return "" if re.fullmatch(r"(?:thumb|frame|frameless|left|right|center|none|border|\d*x?\d+px|ממוזער|)", caption, re.I) else caption
    return _link((m[2] or m[1]).strip())


def _templates(text: str, skipped: frozenset[int] = frozenset()) -> list[Edit]:
    """The outermost templates: without parameters nothing, else the last one, in brackets. Openers without an end are text."""
    out, open_, at = [], [], 0  # of each open template its start and what was written into it
    for m in re.finditer(r"\{\{|\}\}", text):
        if open_:
            open_[-1][1].append(text[at : m.start()])
        at = m.end()
        if m[0] == "{{":
            if m.start() not in skipped:
                open_.append((m.start(), []))
            elif open_:
                open_[-1][1].append(m[0])
        elif open_:
            start, parts = open_.pop()
            inner = "".join(parts)
            new = text[start:at] if not inner.strip() else f" ({inner.rsplit('|', 1)[1].strip()})" if "|" in inner else ""
            if open_:
                open_[-1][1].append(new)
            elif inner.strip():
                out.append((start, at, new))
    return _templates(text, frozenset(a for a, _ in open_)) if open_ and not skipped else out


_TEX = re.compile(r"\\([a-zA-Z]{2,})\*?(?:\[[^\]\n]*\])?\{|\\.|[{}]", re.S)
# LaTeX commands for headings, and those whose argument is not text.
_TEX_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 1}
_TEX_DROPPED = set("cite citep citet ref eqref pageref label bibliography usepackage documentclass input include vspace hspace".split())


def _tex_commands(text: str) -> list[Edit]:
    """Commands with arguments, by one pass over the braces: what stands before an argument and behind it is replaced by
    itself, so nesting costs nothing. Commands whose argument is never closed stay as they are."""
    out: list[Edit] = []
    open_: list[tuple[str, int, int, int]] = []  # command, its start, the start of its argument, edits before it
    follow = ""  # the command that a second argument belongs to
    for m in _TEX.finditer(text):
        c = m[0]
        if c == "{":
            if follow and m.start() == here:
                open_.append((follow + "2", m.start(), m.end(), len(out)))
            else:
                open_.append(("", m.start(), m.end(), len(out)))
            follow = ""
        elif c == "}":
            follow = ""
            if not open_:
                continue
            name, start, arg, before = open_.pop()
            if not name:
                continue
            a, b = m.span()
            second = b < len(text) and text[b] == "{"
            if name in _TEX_DROPPED:
                out[before:] = [(start, b, "")]
                continue
            lead, tail = "", ""
            if name in _TEX_HEADS:
                lead, tail = "\n" + "#" * _TEX_HEADS[name] + " ", "\n"
            elif name == "footnote":
                lead, tail = " (", ")"
            elif name == "url":
                lead, tail = _LINK, _UNLINK
            elif name == "frac" and second:
                lead, tail, follow, here = "(", ")/", name, b
            elif name == "frac2":
                lead, tail = "(", ")"
            elif name == "href" and second:
                out[before:] = [(start, b, "")]
                follow, here = name, b
                continue
            elif name == "href2":
                lead, tail = _LINK, _UNLINK
            out.insert(before, (start, arg, lead))
            out.append((a, b, tail))
        elif m[1]:
            open_.append((m[1], m.start(), m.end(), len(out)))
            follow = ""
    return out


def _numbered(text: str) -> str:
    """Runs of at least two wiki lines ``# entry`` as numbered entries; a single one is a heading."""
    lines, i = text.split("\n"), 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j].startswith("# "):
            j += 1
        if j - i > 1:
            for n in range(i, j):
                lines[n] = f"{n - i + 1}. {lines[n][2:]}"
        i = max(j, i + 1)
    return "\n".join(lines)


def _link(text: str) -> str:
    return f"{_LINK}{text}{_UNLINK}"


def read(raw: str) -> _Reader:
    """All markup of a text replaced, and the kinds it had."""
    r = _Reader(_INVISIBLE.sub("", _PRIVATE.sub("", raw)))
    if not _SIGNS.search(r.text):
        return r
    some = lambda x: x in r.text

    def between(kind: str, opener: str, closer: Callable[[re.Match], str], by: Callable[[re.Match, str], str], least: int = 0) -> None:
        r.edit(kind, ((m.start(), b, by(m, r.text[m.end() : a])) for m, a, b in delimited(r.text, re.compile(opener, re.I | re.M), closer) if a - m.end() >= least))

    if some("`") or some("~~~"):
        r.rule("markdown", _FENCE, lambda m: r.hold("```\n" + m[2].rstrip("\n") + "\n```", True))
        r.rule("markdown", _CODE, lambda m: r.hold(m[2].strip()))
    if some("<"):
        between("wiki", r"<nowiki>", lambda m: r"</nowiki\s*>", lambda m, x: r.hold(x))
        between("wiki", r"<math(?:\s[^<>]*)?>", lambda m: r"</math\s*>", lambda m, x: r.hold(f"${x.strip()}$"))
        r.rule("wiki", _REF_ALONE, lambda m: "")
        between("wiki", r"<ref(?:\s[^<>]*)?>", lambda m: r"</ref\s*>", lambda m, x: f" ({x.strip()})" if x.strip() else "")
    if some("\\"):
        between("latex", r"\\begin\{(equation|align|math|displaymath|eqnarray|gather)(\*?)\}", lambda m: rf"\\end\{{{re.escape(m[1] + m[2])}\}}", lambda m, x: r.hold(f"\\begin{{{m[1]}{m[2]}}}{x}\\end{{{m[1]}{m[2]}}}", True))
        between("latex", r"\\([\[(])", lambda m: r"\\\]" if m[1] == "[" else r"\\\)", lambda m, x: r.hold(m[0] + x + ("\\]" if m[1] == "[" else "\\)")), 1)
    if some("$"):
        r.rule("latex", _DOLLARS, lambda m: r.hold(m[0]) if m[1] is None or _IN_MATH.search(m[1]) else None)
    r.notes += [(m.start(), "markdown") for m in (_MD_HEAD.search(r.text), _MD_LIST.search(r.text)) if m]  # their marks are the neutral ones
    r.notes.sort()
    if some("\n=") or some("\n-"):
        r.rule("markdown", _MD_UNDERLINED, lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip())
    r.rule("markdown", _MD_QUOTE, lambda m: "")
    if some("<"):
        r.rule("html", _COMMENT, lambda m: "")
        r.rule("html", _DROPPED, lambda m: "")
        between("html", r"<(pre|code)\b[^<>]*>", lambda m: rf"</{m[1].lower()}\s*>", lambda m, x: r.hold("```\n" + html.unescape(x).strip("\n") + "\n```", True) if m[1].lower() == "pre" else r.hold(html.unescape(x)))
        between("html", r"<sup\b[^<>]*footnote-marker[^<>]*>", lambda m: r"</sup\s*>", lambda m, x: " ")
        r.rule("html", _TAG, _tags())
    if some("&"):
        r.rule("html", _ENTITY, _entity)
    if some("{|"):
        between("wiki", r"^\{\|[^\n]*\n", lambda m: r"^\|\}", lambda m, x: _wiki_rows(x))
    if some("="):
        r.rule("wiki", _WIKI_HEAD, lambda m: "\n" + "#" * len(m[1]) + " " + m[2] + "\n")
    if some("["):
        r.rule("wiki", _WIKI_LINK, _wiki_link)
        r.rule("wiki", _WIKI_OUT, lambda m: _link((m[2] or "").strip()))
        r.rule("markdown", _MD_IMAGE, lambda m: m[1])
        r.rule("markdown", _MD_LINK, lambda m: _link(m[1]))
    if some("{{"):
        r.edit("wiki", _templates(r.text))
    if some("''"):
        for _ in range(2):  # bold around italics
            r.edit("wiki", _unwrapped(r.text, "'", (2, 3, 4, 5)))
    if some("\\"):
        r.rule("latex", _TEX_ENV, lambda m: "\n")
        r.rule("latex", _TEX_ITEM, lambda m: "\n- " + (f"{m[1]}: " if m[1] else ""))
        r.edit("latex", _tex_commands(r.text))
        r.rule("latex", _TEX_BARE, lambda m: "\n" if m[0].startswith(("\\par", "\\newline", "\\newpage")) else "")
    if some("|") and some("---"):
        r.rule("markdown", _MD_TABLE, lambda m: "")
    if some("*") or some("_"):
        for _ in range(2):
            for sign in "*_":
                r.edit("markdown", _unwrapped(r.text, sign, (2, 3)))
            r.rule("markdown", _MD_EM, lambda m: m[1] or m[2])
    if some("~~"):
        r.edit("markdown", _unwrapped(r.text, "~", (2,)))
    r.rule("", _BULLET, lambda m: m[1] + "- ")
    r.notes = [(o, k) for o, k in r.notes if k]
    if "wiki" in r.kinds and "\n# " in r.text:
        r.text = _numbered(r.text)
    return r


_REF_ALONE = re.compile(r"<ref(?:\s[^<>]*)?/>", re.I)
_MD_UNDERLINED = re.compile(r"^(?=[^\W\d_])([^\n|]{1,200})\n(={3,}|-{3,})[ \t]*$", re.M)
_BULLET = re.compile(r"^([ \t]*)[+*][ \t]+(?=\S)(?!(?:[-*][ \t]+)*[-*][ \t]*$)", re.M)


def _unwrapped(text: str, sign: str, sizes: tuple[int, ...]) -> list[Edit]:
    """Stretches between runs of a sign, as edits that take the runs away."""
    return [e for a, n, b in paired(text, sign, sizes) for e in ((a, a + n, ""), (b - n, b, ""))]


_HEADING, _ITEM = re.compile(r"#{1,6} "), re.compile(r"(?:[-•]|\d{1,3}[.)]) ")


def blocks(raw: str, stop_words: frozenset[str] = frozenset()) -> tuple[list[Block], set[str]]:
    """The blocks of a text in order, labelled ``text``, ``structure`` or ``residue``, and its kinds of markup."""
    r = read(raw)
    out: list[Block] = []
    begin, k, waiting = 0, 0, set()  # kinds noted where no block is go to the next one, at the end to the last
    for part in r.text.split("\n"):
        while k < len(r.notes) and r.notes[k][0] <= begin + len(part):
            waiting.add(r.notes[k][1])
            k += 1
        begin += len(part) + 1
        body = part.strip()
        if not body.replace(_LINK, "").replace(_UNLINK, "").strip():
            continue
        linked = sum(len(x) for x in re.findall(f"{_LINK}([^{_UNLINK}]*){_UNLINK}", body))
        text = re.sub(r"[ \t\u00a0]+", " ", r.release(body.replace(_LINK, "").replace(_UNLINK, ""))).strip() if not body.startswith(_HELD) else r.release(body)
        out.append(Block(*_first_pass(text, linked, stop_words), text, sorted(waiting)))
        waiting = set()
    if waiting:
        if not out:  # nothing but markup
            out.append(Block("empty", "residue", ""))
        out[-1].kinds = sorted({*out[-1].kinds, *waiting})
    # second pass: the nearest decided neighbours; text wins where they disagree or are missing
    before, after = _decided(out), _decided(out[::-1])[::-1]
    for i, b in enumerate(out):
        if b.label in ("short", "near"):
            b.label = "residue" if {before[i], after[i]} - {None} == {"residue"} and b.kind != "item" else "text"
    return out, r.kinds


def _decided(found: list[Block]) -> list[str | None]:
    """For each block the label of the nearest decided one before it."""
    out, last = [], None
    for b in found:
        out.append(last)
        if b.label in ("text", "residue"):
            last = b.label
    return out


def _first_pass(text: str, linked: int, stop_words: frozenset[str]) -> tuple[str, str]:
    """The kind of a block and its label by its own words and links; ``short`` and ``near`` are undecided."""
    if text.startswith("```"):
        kind = "code"
    elif _HEADING.match(text):
        kind = "heading"
    elif _ITEM.match(text):
        kind = "item"
    elif text.startswith("|") and text.endswith("|"):
        kind = "row"
    elif text.startswith(("\\[", "$$", "\\begin{")):
        kind = "formula"
    else:
        kind = "paragraph"
    if kind in ("code", "formula", "heading", "row"):
        return kind, "structure"
    words = [w.strip(".,;:!?()[]\"'") for w in _MARKS.sub("", skeleton(text)).lower().split()]
    stops = sum(1 for w in words if w in stop_words) / max(1, len(words))
    if linked > LINKS * len(text) and len(text) > SHORT:
        return kind, "residue"
    if len(text) < SHORT:
        return kind, "short"
    if stops >= STOP_HIGH or not stop_words:
        return kind, "text"
    return kind, "near" if stops >= STOP_LOW or len(text) < LONG else "residue"


def clean(raw: str, stop_words: frozenset[str] = frozenset()) -> str:
    """The text without markup and without residue, one block a line."""
    found, _ = blocks(raw, stop_words)
    kept = [b for b in found if b.label != "residue"] or found
    return "\n".join(b.text for b in kept)


def _converted(stop_words: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("kind", pa.string()), ("label", pa.string()), ("text", pa.string()), ("kinds", pa.list_(pa.string()))])
        for batch in batches:
            texts, kinds, parts = [], [], []
            for raw in batch.column(1).to_pylist():
                found, _ = blocks(raw, stop_words)
                kept = [b for b in found if b.label != "residue"] or found
                texts.append("\n".join(b.text for b in kept))
                kinds.append(sorted({k for b in found for k in b.kinds}))
                parts.append([b.__dict__ for b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(parts, pa.list_(block))], ["id", "text", "kinds", "blocks"])

    return run


def converted(df: DataFrame, key: str, raw: str, common: DataFrame) -> DataFrame:
    """(id, text, kinds, blocks) of every row with a raw text: its clean text, the kinds of markup it had, its blocks.

    Null keys and texts are left out; an empty text stays empty and has no kind. Rows that repeat a key come out as often
    as they stand there. ``common`` (lang, word) holds the frequent words; the driver reads it after a check of its size.
    Other columns are not looked at. No shuffle is needed.
    """
    words = [w for (w,) in common.select("word").where("word IS NOT NULL").distinct().limit(MAX_STOP_WORDS + 1).collect()]
    if len(words) > MAX_STOP_WORDS:
        raise ValueError(f"more than {MAX_STOP_WORDS} frequent words")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(raw).alias("raw")).where(F.col("id").isNotNull() & F.col("raw").isNotNull())
    schema = "id long, text string, kinds array<string>, blocks array<struct<kind: string, label: string, text: string, kinds: array<string>>>"
    return rows.mapInArrow(_converted(frozenset(_MARKS.sub("", w).lower() for w in words)), schema)
