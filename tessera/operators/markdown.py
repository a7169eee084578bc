"""Markdown to a section tree.

A block parser (headings, fences, tables, lists, quotes, HTML, paragraphs) and an
inline scanner (code, math, links and images with targets in place or defined elsewhere,
emphasis, breaks, entities) for the part of CommonMark that documents use.  Text
keeps what a reader sees: emphasis marks, link targets, definitions and code fences
go; math keeps its delimiters; an image gives its alternative text, or is a figure
where it stands alone.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field


@dataclass
class Node:
    kind: str  # root, heading, paragraph, code_block, math_block, table or figure
    text: str = ""  # a heading's title
    level: int = 0
    src: str | None = None
    caption: str | None = None
    description: str | None = None
    children: list[Node] = field(default_factory=list)


@dataclass
class Inline:
    """What the inline scanner finds in a stretch of text."""

    text: str = ""
    images: list[tuple[str, str, str | None]] = field(default_factory=list)
    displays: int = 0
    prose: bool = False  # visible text besides images, display math and HTML


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*|.*)$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
_QUOTE = re.compile(r" {0,3}> ?(.*)$")
_ROW = re.compile(r" {0,3}\|?(?:[ \t]*:?-+:?[ \t]*\|)*[ \t]*:?-+:?[ \t]*\|?[ \t]*$")
_ATTRIBUTES = re.compile(r"[ \t]*\{[^{}]*\}[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:!--|[?!]|/?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|dt|dd|fieldset|figure|figcaption|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul|pre|textarea)(?:[\s/>]|$))", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|<[?!][^<>]*>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>")
_TARGET = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)""")
_DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|([^\s<]\S*))(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?[ \t]*(?:\n|$)""")
_ESCAPE = re.compile(r"""\\([!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~])""")


def has_prose(text: str) -> bool:
    """Whether there is a visible character outside angle brackets."""
    depth = 0
    for c in text:
        if c == "<":
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif not depth and not c.isspace():
            return True
    return False


def _plain(text: str) -> str:
    return html.unescape(_ESCAPE.sub(r"\1", text))


def _closing(text: str, at: int) -> int:
    """The bracket that closes the one at ``at``, or -1."""
    depth = 0
    while at < len(text):
        if text[at] == "\\":
            at += 1
        elif text[at] == "[":
            depth += 1
        elif text[at] == "]":
            depth -= 1
            if not depth:
                return at
        at += 1
    return -1


#: A link's or an image's target, and its title.
Target = tuple[str, str | None]


def _label(raw: str) -> str:
    """References and definitions fit whatever their case and spaces."""
    return " ".join(raw.split()).casefold()


def _target(text: str, opened: int, close: int, defined: dict[str, Target]) -> tuple[Target, int] | None:
    """Where the brackets from ``opened`` to ``close`` point, in place or by a definition, and where that ends."""
    here = _TARGET.match(text, close + 1)
    if here:
        title = next((_plain(t) for t in here.groups()[2:] if t), None)
        return (_plain(here.group(1) or here.group(2) or ""), title), here.end()
    label, end = text[opened + 1 : close], close + 1
    if text.startswith("[", end):
        last = _closing(text, end)
        if last > 0:
            label, end = text[end + 1 : last] or label, last + 1
    found = defined.get(_label(label))
    return None if found is None else (found, end)


def inline(text: str, figures: bool = True, defined: dict[str, Target] | None = None) -> Inline:
    """Reads inline markup.  Images hold back their text until something follows."""
    defined = defined or {}
    out = Inline()
    parts: list[str] = []
    pending: list[str] = []

    def flush(following: str) -> None:
        if pending:
            caption = pending.pop()
            parts.append(caption)
            if caption and not caption[-1].isspace() and not following[:1].isspace():
                parts.append(" ")

    def add(piece: str, counts: bool = True) -> None:
        if not piece:
            return
        flush(piece)
        parts.append(piece)
        if counts and piece.strip():
            out.prose = True

    i, n = 0, len(text)
    plain: list[str] = []

    def emit_plain() -> None:
        if plain:
            add(_plain("".join(plain)))
            plain.clear()

    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n:
            if text[i + 1] == "\n":
                emit_plain()
                add("\n", False)
                i += 2
                while i < n and text[i] in " \t":
                    i += 1
                continue
            plain.append(text[i : i + 2])
            i += 2
            continue
        if c == "`":
            run = len(text) - len(text[i:].lstrip("`")) - i
            end = next((m.start() for m in re.finditer("`+", text[i + run :]) if len(m.group()) == run), -1)
            if end >= 0:
                emit_plain()
                code = text[i + run : i + run + end].replace("\n", " ")
                if code.strip() and code[0] == code[-1] == " ":
                    code = code[1:-1]
                add(code)
                i += 2 * run + end
                continue
            plain.append(text[i : i + run])
            i += run
            continue
        if c == "$":
            double = text.startswith("$$", i)
            mark = "$$" if double else "$"
            end = text.find(mark, i + len(mark))
            body = text[i + len(mark) : end] if end > 0 else ""
            fits = body and (double or (not body[0].isspace() and not body[-1].isspace() and not text[end + 1 : end + 2].isdigit()))
            if fits:
                emit_plain()
                if double:
                    out.displays += 1
                add(mark + body + mark, not double)
                i = end + len(mark)
                continue
            plain.append(mark)
            i += len(mark)
            continue
        if c == "!" and text.startswith("![", i):
            close = _closing(text, i + 1)
            found = _target(text, i + 1, close, defined) if close > 0 else None
            if found:
                emit_plain()
                flush("image")
                alt = inline(text[i + 2 : close], False, defined).text
                (src, title), end = found
                out.images.append((src, alt, title))
                if has_prose("".join(parts)) or not figures:
                    out.prose = True
                    parts.append(alt)
                else:
                    pending.append(alt)
                i = end
                continue
        if c == "[":
            close = _closing(text, i)
            found = _target(text, i, close, defined) if close > 0 else None
            if found:
                emit_plain()
                inner = inline(text[i + 1 : close], figures, defined)
                out.images += inner.images
                add(inner.text)
                i = found[1]
                continue
        if c == "<":
            link = _AUTOLINK.match(text, i)
            tag = _TAG.match(text, i)
            if link or tag:
                emit_plain()
                add(link.group(1) if link else tag.group())
                i = (link or tag).end()
                continue
        if c in "*_":
            run = len(text) - len(text[i:].lstrip(c)) - i
            before, after = text[i - 1 : i], text[i + run : i + run + 1]
            word = lambda x: bool(x) and (x.isalnum())
            inside = c == "_" and word(before) and word(after)
            lone = (not before or before.isspace()) and (not after or after.isspace())
            if not inside and not lone and _paired(text, i, run):
                i += run
                continue
            plain.append(text[i : i + run])
            i += run
            continue
        if c == "\n":
            hard = plain and "".join(plain).endswith("  ")
            if plain:
                kept = "".join(plain).rstrip(" ")
                plain[:] = [kept]
            emit_plain()
            add("\n" if hard else " ", False)
            i += 1
            while i < n and text[i] in " \t":
                i += 1
            continue
        plain.append(c)
        i += 1
    emit_plain()
    out.text = "".join(parts)
    if pending and (out.displays or len(out.images) != 1 or has_prose(out.text) or not figures):
        out.text += pending[0]
    return out


def _paired(text: str, at: int, run: int) -> bool:
    """Whether an emphasis run has a partner of its kind in the same stretch of text."""
    c = text[at]
    before = text[at - 1 : at]
    if before and not before.isspace() and re.search(rf"(?<![{re.escape(c)}\\]){re.escape(c) * run}(?!{re.escape(c)})\S", text[:at]):
        return True
    after = text[at + run :]
    return bool(after) and not after[0].isspace() and re.search(rf"\S{re.escape(c) * run}(?!{re.escape(c)})|\S{re.escape(c)}+", after) is not None


def _cells(line: str) -> list[str]:
    """A table row's cells; a bar in code or after a backslash is text."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    cells, cell, i, code = [], [], 0, False
    while i < len(line):
        if line[i] == "\\" and line[i + 1 : i + 2] == "|":
            cell.append("|")
            i += 1
        elif line[i] == "|" and not code:
            cells.append("".join(cell))
            cell = []
        else:
            code ^= line[i] == "`"
            cell.append(line[i])
        i += 1
    if "".join(cell).strip() or not line.endswith("|"):
        cells.append("".join(cell))
    return [c.strip() for c in cells]


def render_table(rows: list[list[str]]) -> str:
    """The table as markdown, one space around each cell."""
    if not rows:
        return ""
    wide = len(rows[0])
    even = [(row + [""] * wide)[:wide] for row in rows]
    lines = ["| " + " | ".join(row) + " |" for row in even]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


class _Blocks:
    """Turns lines into nodes below the present heading."""

    def __init__(self, defined: dict[str, Target]) -> None:
        self.root = Node("root")
        self.path = [self.root]
        self.defined = defined
        self.found: dict[str, Target] = {}

    def without_definitions(self, lines: list[str]) -> str:
        """A paragraph's text after the link definitions that it begins with, which are noted (the first of a label counts)."""
        text, at = "\n".join(lines), 0
        while (m := _DEFINITION.match(text, at)) and m.group(1).strip():
            title = next((_plain(t) for t in m.groups()[3:] if t), None)
            self.found.setdefault(_label(m.group(1)), (_plain(m.group(2) or m.group(3) or ""), title))
            at = m.end()
        return text[at:]

    def heading(self, level: int, raw: str) -> None:
        raw = _ATTRIBUTES.sub("", raw) if _ATTRIBUTES.search(raw) else raw
        while len(self.path) > 1 and self.path[-1].level >= level:
            self.path.pop()
        node = Node("heading", inline(raw.strip(), False, self.defined).text, level)
        self.path[-1].children.append(node)
        self.path.append(node)

    def add(self, node: Node) -> None:
        self.path[-1].children.append(node)

    def paragraph(self, lines: list[str], item: bool = False) -> None:
        rest = self.without_definitions(lines)
        if not rest.strip():
            return
        got = inline("\n".join(x.lstrip() for x in rest.split("\n")).rstrip(), defined=self.defined)
        if not item and got.displays == 1 and not got.prose and not got.images:
            self.add(Node("math_block", got.text))
        elif len(got.images) == 1 and not has_prose(got.text):
            src, alt, title = got.images[0]
            self.add(Node("figure", "", src=src, caption=alt, description=title))
        else:
            self.add(Node("paragraph", got.text))

    def read(self, lines: list[str], item: bool = False) -> None:
        i, held = 0, []

        def close() -> None:
            if held:
                self.paragraph(held, item)
                held.clear()

        while i < len(lines):
            line = lines[i]
            fence = _FENCE.match(line)
            if fence and not (fence.group(1)[0] == "`" and "`" in fence.group(2)):
                close()
                indent = len(line) - len(line.lstrip(" "))
                mark, code = fence.group(1), []
                i += 1
                while i < len(lines):
                    end = lines[i].strip()
                    if len(lines[i]) - len(lines[i].lstrip(" ")) < 4 and end and set(end) == {mark[0]} and len(end) >= len(mark):
                        break
                    code.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                    i += 1
                i += 1
                self.add(Node("code_block", "".join(x + "\n" for x in code)))
                continue
            if not line.strip():
                close()
                i += 1
                continue
            if not held and (line.startswith("    ") or line.startswith("\t")):
                code = []
                while i < len(lines) and (not lines[i].strip() or lines[i].startswith(("    ", "\t"))):
                    code.append(lines[i][4:] if lines[i].startswith("    ") else lines[i].lstrip("\t"))
                    i += 1
                while code and not code[-1].strip():
                    code.pop()
                self.add(Node("code_block", "".join(x + "\n" for x in code)))
                continue
            atx = _ATX.match(line)
            if atx:
                close()
                self.heading(len(atx.group(1)), atx.group(2) or "")
                i += 1
                continue
            setext = _SETEXT.match(line)
            if held and setext:
                title = self.without_definitions(held)
                held.clear()
                if not title.strip():  # nothing but definitions: the line underlines nothing
                    held.append(line)
                    i += 1
                    continue
                self.heading(1 if "=" in setext.group(1) else 2, title)
                i += 1
                continue
            if _RULE.match(line):
                close()
                i += 1
                continue
            if "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _ROW.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])) and not held:
                rows = [_cells(line)]
                i += 2
                while i < len(lines) and lines[i].strip() and not _ATX.match(lines[i]) and not _FENCE.match(lines[i]):
                    rows.append(_cells(lines[i]))
                    i += 1
                self.add(Node("table", render_table([[inline(c, False, self.defined).text.strip() for c in row] for row in rows])))
                continue
            quote = _QUOTE.match(line)
            if quote:
                close()
                inner = []
                while i < len(lines) and lines[i].strip():
                    more = _QUOTE.match(lines[i])
                    if not more and (_ATX.match(lines[i]) or _ITEM.match(lines[i]) or _FENCE.match(lines[i])):
                        break
                    inner.append(more.group(1) if more else lines[i])
                    i += 1
                self.read(inner)
                continue
            found = _ITEM.match(line)
            if found and (not held or ((found.group(4) or "").strip() and (not found.group(2)[0].isdigit() or found.group(2)[:-1] == "1"))):
                close()
                wide = len(found.group(1)) + len(found.group(2)) + min(len(found.group(3) or " "), 4)
                inner = [found.group(4) or ""]
                i += 1
                while i < len(lines):
                    if not lines[i].strip():
                        if i + 1 < len(lines) and lines[i + 1].startswith(" " * wide):
                            inner.append("")
                            i += 1
                            continue
                        break
                    if lines[i].startswith(" " * wide):
                        inner.append(lines[i][wide:])
                    elif _ITEM.match(lines[i]) or _ATX.match(lines[i]) or _FENCE.match(lines[i]) or _RULE.match(lines[i]) or _QUOTE.match(lines[i]):
                        break
                    else:
                        inner.append(lines[i].lstrip())
                    i += 1
                self.read(inner, True)
                continue
            if not held and _HTML.match(line):
                # an HTML block stands in no node
                while i < len(lines) and lines[i].strip():
                    i += 1
                continue
            held.append(line)
            i += 1
        close()


def parse(body: str) -> Node:
    """The tree of a document's body."""
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    blocks = _Blocks({})
    blocks.read(lines)
    if blocks.found:  # definitions may stand below what refers to them
        blocks = _Blocks(blocks.found)
        blocks.read(lines)
    return blocks.root


def prune(node: Node, drop) -> list[str]:
    """Removes headings for which ``drop(title)`` holds, with all below; returns their titles."""
    gone, kept = [], []
    for child in node.children:
        if child.kind == "heading" and drop(child.text):
            gone.append(child.text)
        else:
            gone += prune(child, drop)
            kept.append(child)
    node.children = kept
    return gone


def is_reference_title(title: str) -> bool:
    from tessera.functions.text import REFERENCE_TITLES

    return title.strip().lower() in REFERENCE_TITLES


def figure_text(node: Node) -> str:
    return "\n\n".join(x for x in (node.caption, node.description) if x)


def block_text(node: Node) -> str:
    return figure_text(node) if node.kind == "figure" else node.text


def full_text(node: Node) -> str:
    """Titles and texts in order, an empty line between."""
    out: list[str] = []

    def walk(x: Node) -> None:
        for child in x.children:
            text = block_text(child)
            if text:
                out.append(text)
            walk(child)

    walk(node)
    return "\n\n".join(out)


def tree_text(node: Node, longest: int = 60) -> str:
    """A drawing of the tree, with the beginning of each text."""
    lines = ["root"]

    def walk(x: Node, lead: str) -> None:
        for k, child in enumerate(x.children):
            last = k == len(x.children) - 1
            text = block_text(child).replace("\n", " ")
            text = text[:longest] + "…" if len(text) > longest else text
            label = f"h{child.level}" if child.kind == "heading" else child.kind
            lines.append(f"{lead}{'└── ' if last else '├── '}{label}: {text}")
            walk(child, lead + ("    " if last else "│   "))

    walk(node, "")
    return "\n".join(lines)
