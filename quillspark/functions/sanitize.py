"""Untrusted book pages made safe for a reader: elements, attributes, addresses and style sheets."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.markup import Page
from quillspark.functions.text import col
from quillspark.functions.udf import vectorised

#: Elements that run, fetch or navigate; attributes that hold an address.
BLOCKED = frozenset("script iframe frame frameset object embed applet form input textarea select option button base meta noscript template portal".split())
ADDRESSES = frozenset("src href poster background data srcset xlink:href".split())
#: Fixed value: the style that every chapter begins with.
BASE_STYLE = "html{-webkit-text-size-adjust:100%;}body{overflow-wrap:break-word;word-wrap:break-word;}img,svg,video{max-width:100%;height:auto;}"
#: What may not stand in a style sheet.
DANGER = r"(?i)(expression\s*\(|javascript\s*:|vbscript\s*:|behaviou?r\s*:|-moz-binding)"
COMMENT, IMPORT = r"(?s)/\*.*?\*/", r"(?i)@import[^;]*;"
_URL = re.compile(r"""url\(\s*(['"]?)(.*?)\1\s*\)""", re.I | re.S)


def resolve(raw: str, base: str, remote: bool = False) -> tuple[str, str]:
    """(keep, remote, internal or block) and the address of a reference in a document of the folder ``base``."""
    value = (raw or "").strip()
    low = value.lower()
    if not value:
        return "block", ""
    if low.startswith(("#", "data:", "about:blank", "mailto:", "tel:")):
        return "keep", value
    if re.match(r"((https?:)?//|[a-z][a-z0-9+.\-]*:)", low):
        return ("remote", value) if remote else ("block", "")
    path, mark, fragment = value.partition("#")
    joined = posixpath.normpath(posixpath.join(base, path.partition("?")[0]))
    outside = joined in ("", ".", "..") or joined.startswith(("../", "/"))
    return ("block", "") if outside else ("internal", joined + mark + fragment)


def safe_css(css: str, base: str, asset: str, remote: bool = False) -> str:
    for pattern in (COMMENT, IMPORT, DANGER):
        css = re.sub(pattern, "", css or "")

    def address(found: re.Match) -> str:
        kind, value = resolve(found[2], base, remote)
        return 'url("data:,")' if kind == "block" else f'url("{asset + quote(value) if kind == "internal" else value}")'

    return _URL.sub(address, css)


def _attribute(tag: str, name: str, value: str, base: str, asset: str, chapter: str | None, remote: bool) -> str | None:
    """The value that stays, or None."""
    if name.startswith("on") or name in ("srcdoc", "formaction"):
        return None
    if name == "style":
        return safe_css(value, base, asset, remote)
    if name not in ADDRESSES:
        return value
    if name == "srcset":
        kept = []
        for candidate in filter(None, (c.split() for c in value.split(","))):
            kind, ref = resolve(candidate[0], base, remote)
            if kind in ("keep", "internal"):
                kept.append(" ".join([asset + quote(ref) if kind == "internal" else candidate[0], *candidate[1:]]))
        return ", ".join(kept) or None
    kind, ref = resolve(value, base, remote)
    if kind == "block":
        return None
    if kind != "internal":
        return value if kind == "keep" else ref
    return chapter + quote(ref.partition("#")[0]) if tag in ("a", "area") and chapter is not None else asset + quote(ref)


def safe_html(raw: str, base: str, asset: str, chapter: str | None = None, remote: bool = False, title: str = "") -> str:
    """A whole document without anything that runs, fetches or leaves the book."""
    page = Page(raw or "<body></body>")
    for i in page.elements():
        if not page.live[i]:
            continue
        tag, attrs = page.tag[i], page.data[i]
        if tag in BLOCKED:
            page.remove(i)
        elif tag == "link":
            kind, value = resolve(attrs.get("href", ""), base, remote)
            if kind == "internal" and "stylesheet" in attrs.get("rel", "").lower():
                page.data[i] = {k: v for k, v in attrs.items() if not k.startswith("on")} | {"href": asset + quote(value)}
            else:
                page.remove(i)
        else:
            kept = {k: _attribute(tag, k, v, base, asset, chapter, remote) for k, v in attrs.items()}
            page.data[i] = {k: v for k, v in kept.items() if v is not None}
    first = lambda tag: next(page.elements({tag}), None)
    html, head, body = first("html"), first("head"), first("body")
    inner = ""
    if head is not None:
        for i in page.inside(head, {"title"} if title else ()):
            page.remove(i)
        for i in page.inside(head, {"style"}):
            if page.data[i].get("id") == "reader-base":
                page.remove(i)
        inner = page.write(head + 1, page.end[head], xml=False)
    content = 0 if html is None else html
    if body is None and head is not None:
        page.remove(head)
    attributes = lambda i: page.write(i, i + 1, xml=False).partition(">")[0] + ">"
    opened = "<html>" if html is None else attributes(html)
    start = "<body>" if body is None else attributes(body)
    rest = page.write(body + 1, page.end[body], xml=False) if body is not None else page.write(content + 1, page.end[content], xml=False)
    return f'{opened}<head><style id="reader-base">{BASE_STYLE}</style>{inner}</head>{start}{rest}</body></html>'


@vectorised("string")
def sanitize(html: pd.Series, base: pd.Series, asset: pd.Series, chapter: pd.Series) -> pd.Series:
    """Safe document of each page; addresses of its book begin with ``asset`` or, for links, ``chapter``."""
    return pd.Series([safe_html(h or "", b or "", a or "", c) for h, b, a, c in zip(html, base, asset, chapter, strict=True)], dtype=object)


@vectorised("string")
def sanitize_css(css: pd.Series, base: pd.Series, asset: pd.Series) -> pd.Series:
    return pd.Series([safe_css(x or "", b or "", a or "") for x, b, a in zip(css, base, asset, strict=True)], dtype=object)


def clean_css(css: Column | str) -> Column:
    """Style sheets without comments, imports and what could run; addresses stay."""
    out = F.coalesce(col(css), F.lit(""))
    for pattern in (COMMENT, IMPORT, DANGER):
        out = F.regexp_replace(out, pattern, "")
    return out
