"""Word-processor files on the standard library: DOCX read and written, RTF read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd

from quillspark.functions.markup import Page
from quillspark.functions.udf import vectorised

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
DOCX_DDL = "title string, author string, language string, chapters array<struct<title:string,body:string>>, images array<string>"
_FIELDS = ["title", "author", "language", "chapters", "images"]


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _text(paragraph: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(n.text or "" if n.tag == f"{_W}t" else marks.get(n.tag, "") for n in paragraph.iter()).strip()


def read_docx(data: bytes, name: str = "") -> dict | None:
    """Title, author, language, chapters and images of a DOCX; null if the bytes are none.

    Headings, titles and subtitles open chapters, list items get a mark, the
    cells of a table's row stand in one paragraph.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        core, styles, links = (_part(archive, n) for n in ("docProps/core.xml", "word/styles.xml", "word/_rels/document.xml.rels"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
        return None
    if body is None:
        return None
    named = {s.get(f"{_W}styleId"): (s.find(f"{_W}name").get(f"{_W}val") or "").lower() for s in (styles.iter(f"{_W}style") if styles is not None else ()) if s.find(f"{_W}name") is not None}
    target = {r.get("Id"): (r.get("Target") or "").rsplit("/", 1)[-1] for r in (links if links is not None else ()) if (r.get("Type") or "").endswith("/image")}
    about = {n.tag.rsplit("}", 1)[-1]: (n.text or "").strip() for n in (core.iter() if core is not None else ())}
    chapters, images, title, parts = [], [], about.get("title") or name, []
    for block in body:
        if block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = ["\n".join(filter(None, (_text(p) for p in cell.iter(f"{_W}p")))) for cell in row.findall(f"{_W}tc")]
                parts.append(f"<p>{' | '.join(map(escape, cells))}</p>")
        if block.tag != f"{_W}p":
            continue
        mark = block.find(f"{_W}pPr/{_W}pStyle")
        style = mark.get(f"{_W}val") or "" if mark is not None else ""
        style, text = named.get(style, style.lower()), _text(block)
        if text and (style.startswith("heading") or style in ("title", "subtitle")):
            if parts:
                chapters.append({"title": title, "body": "\n".join(parts)})
            title, parts = text, []
            continue
        if text:
            parts.append(f"<p>{'• ' if style.startswith('list') else ''}{escape(text)}</p>")
        for picture in block.iter(f"{_A}blip"):
            if file := target.get(picture.get(f"{_R}embed")):
                images.append(file)
                parts.append(f'<p><img src="images/{escape(file)}" alt=""/></p>')
    if parts:
        chapters.append({"title": title, "body": "\n".join(parts)})
    return {"title": about.get("title") or None, "author": about.get("creator") or None, "language": about.get("language") or None, "chapters": chapters, "images": images}


def _blocks(body: str) -> Iterator[tuple[int, str]]:
    """Heading level (0 for none) and text of each block of markup."""
    page = Page(body)
    block = {"p", "div", "li", "blockquote", "pre", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"}
    level, held = 0, []
    owner = None
    for i in range(1, len(page.tag)):
        if page.tag[i] is not None:
            continue
        at = page.parent[i]
        while at > 0 and page.tag[at] not in block:
            at = page.parent[at]
        if at != owner and held:
            yield level, " ".join("".join(held).split())
            held = []
        owner, tag = at, page.tag[at]
        level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0
        held.append(page.data[i])
    if held:
        yield level, " ".join("".join(held).split())


def write_docx(title: str | None, author: str | None, chapters: list[tuple[str, str]]) -> bytes:
    """A DOCX of chapters of markup: titles as first-level headings, headings and paragraphs as such."""
    def paragraph(text: str, level: int = 0) -> str:
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = []
    for name, markup in chapters:
        if name:
            body.append(paragraph(name, 1))
        body += [paragraph(text, level) for level, text in _blocks(markup or "") if text]
    w = _W[1:-1]
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7))
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="word/document.xml"/><Relationship Id="r2" Type="{package}/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="{package}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title or "")}</dc:title><dc:creator>{escape(author or "")}</dc:creator></cp:coreProperties>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'<w:styles xmlns:w="{w}">{styles}</w:styles>',
        "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, head + text)
    return out.getvalue()


#: Destinations of RTF that hold no text, and control words that stand for a character.
_RTF_SILENT = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote listtable listoverridetable rsidtbl generator themedata datastore xmlnstbl object fldinst".split())
_RTF_MARKS = {"par": "\n", "line": "\n", "row": "\n", "page": "\n", "sect": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": "\xa0", "_": "-"}
_RTF = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)


def rtf_text(data: bytes) -> str | None:
    """Plain text of an RTF file; null if the bytes are none."""
    if not data.lstrip()[:5] == b"{\\rtf":
        return None
    codepage = re.search(rb"\\ansicpg(\d+)", data)
    encoding = f"cp{codepage[1].decode()}" if codepage else "cp1252"
    try:
        b"".decode(encoding)
    except LookupError:
        encoding = "cp1252"
    out, stack, silent, skip, after = [], [], False, 1, 0
    for found in _RTF.finditer(data):
        word, number, code, symbol, brace, plain = found.groups()
        if brace == b"{":
            stack.append((silent, skip))
        elif brace == b"}":
            silent, skip = stack.pop() if stack else (False, 1)
        elif symbol == b"*":
            silent = True
        elif word is not None:
            name = word.decode()
            if name in _RTF_SILENT:
                silent = True
            elif name == "uc":
                skip = int(number or 1)
            elif name == "u" and number is not None:
                after = skip
                if not silent:
                    out.append(chr(int(number) % 65536))
            elif not silent:
                out.append(_RTF_MARKS.get(name, ""))
        elif code is not None or plain is not None or symbol is not None:
            if symbol is not None:
                text = _RTF_MARKS.get(symbol.decode("latin-1"), symbol.decode("latin-1") if symbol in b"\\{}" else "")
            else:
                text = (bytes([int(code, 16)]) if code else plain).decode(encoding, "replace")
            # what follows a \u is its stand-in
            drop = min(after, len(text))
            after -= drop
            if not silent:
                out.append(text[drop:])
    # pairs of surrogates are one character
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


@vectorised(DOCX_DDL)
def docx(content: pd.Series) -> pd.DataFrame:
    """Fields of DOCX files; all null where the bytes are none."""
    return pd.DataFrame([(read_docx(bytes(c)) if c is not None else None) or dict.fromkeys(_FIELDS) for c in content], columns=_FIELDS, dtype=object)


@vectorised("binary")
def docx_file(title: pd.Series, author: pd.Series, chapters: pd.Series) -> pd.Series:
    return pd.Series([write_docx(t, a, [(c["title"], c["body"]) for c in (cs if isinstance(cs, list | np.ndarray) else [])]) for t, a, cs in zip(title, author, chapters, strict=True)], dtype=object)


@vectorised("string")
def rtf(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else rtf_text(bytes(c)) for c in content], dtype=object)
