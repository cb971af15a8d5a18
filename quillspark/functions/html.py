"""Web pages: metadata, main content, cleaning, replacement and chapters, on the standard parser.

One Arrow pass turns html and address into a struct; what plain expressions can
tell (title, language, visible length) has expressions of its own.
"""

from __future__ import annotations

import re
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.chapters import grouped
from quillspark.functions.markup import Page
from quillspark.functions.text import col
from quillspark.functions.udf import vectorised

#: Elements that go with all they hold.
DROPPED = frozenset(
    "map area embed object video audio iframe canvas applet frameset track portal source frame param shadow "
    "button input output textarea select datalist keygen optgroup option "
    "base script meta link style template slot basefont font "
    "menu command nav menuitem "
    "math svg col colgroup dialog".split()
)
#: Attributes that go, beside all that begin with ``data-`` or ``on``.
DROPPED_ATTRIBUTES = frozenset(
    "style class background bgcolor border width heigth "
    "contextmenu draggable tabindex for autocomplete capture contenteditable crossorigin dirname enterkeyhint form "
    "formaction formenctype formmethod formnovalidate formtarget inputmode list maxlength minlength max min novalidate "
    "pattern readonly required spellcheck step usemap autofocus "
    "loading ping slot sizes decoding elementtiming fetchpriority referrerpolicy "
    "accept accept-charset action enctype method srcset attributionsrc".split()
)
#: Elements that go when they are empty.
GO_EMPTY = frozenset(
    "span abbr cite em i b sub sup small strong mark del s code p ol ul li div pre blockquote label aside address "
    "h1 h2 h3 h4 h5 h6 main section header article footer summary details table caption thead tbody tfoot".split()
)
#: Elements that stay as they are; others become div.
KNOWN = frozenset(
    "address article aside footer header h1 h2 h3 h4 h5 h6 hgroup main section blockquote dd div dl dt figcaption figure hr li ol p pre ul "
    "a abbr b bdi bdo br cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr img picture portal "
    "noscript del ins caption table tbody td tfoot th thead tr fieldset form label legend meter progress details summary".split()
)
#: What simpler element stands for another, and styles that stand for an element.
SIMPLER = {
    **dict.fromkeys("article aside details figure fieldset footer form header hgroup main noframes noscript picture search section".split(), "div"),
    "dir": "ul",
    **dict.fromkeys("bdi data label rt ruby time rp wbr".split(), "span"),
    **dict.fromkeys("figcaption summary legend".split(), "p"),
    **dict.fromkeys("s strike".split(), "del"),
}
STYLED = {
    "mark": ("span", "background-color: #ff0;"),
    "u": ("span", "text-decoration-color: red;text-decoration-style: wavy;text-decoration-line: underline;text-decoration: red wavy underline;"),
    "table": ("table", "border-collapse: collapse;"),
    "th": ("th", "border: 1px solid black;"),
    "td": ("td", "border: 1px solid black;"),
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Attributes that hold the address of an image that loads late, and names of metadata in order.
LATE = ["data-src", "data-original", "data-lazy-src", "data-url", "data-image", "data-full-src", "data-hi-res-src"]
DATE_NAMES = ["article:published_time", "article:modified_time", "book:release_date", "og:article:published_time", "og:article:modified_time", "og:book:release_date"]
PUBLISHER_NAMES = ["publisher", "owner", "copyright", "og:site_name"]
DESCRIPTION_NAMES = ["description", "og:description", "subtitle", "abstract"]
TAG_NAMES = ["news_keywords", "keywords"]
#: Characters before the first heading that make a chapter, and the title of a page without one.
LEFTOVER, UNTITLED = 80, "Artigo"

PAGE_DDL = "title string, date string, author string, publisher string, description string, tags array<string>, language string, chapters array<struct<title:string,body:string>>, images array<string>"


def title_of(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def language_of(html: Column | str) -> Column:
    """Two-letter language of the html element, en by default."""
    lang = F.lower(F.regexp_extract(col(html), r"""(?is)<html[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    return F.when(lang == "", "en").otherwise(lang)


def _metadata(page: Page, url: str) -> dict:
    named: dict[tuple[str, str], str] = {}
    props: dict[tuple[str, str], list[int]] = {}
    titles, langs = [], []
    for i in page.elements():
        tag, attrs = page.tag[i], page.data[i]
        if tag == "meta" and attrs.get("content", "").strip():
            for attribute in ("name", "property"):
                if attribute in attrs:
                    named.setdefault((attribute, attrs[attribute]), attrs["content"].strip())
        elif tag == "title":
            titles.append(page.text(i, page.end[i]).strip())
        elif tag == "html":
            langs.append((attrs.get("lang") or attrs.get("xml:lang") or "").strip())
        if attrs.get("itemprop"):
            props.setdefault(attrs["itemprop"], []).append(i)
    meta = lambda names: next((named[a, n] for n in names for a in ("name", "property") if (a, n) in named), "")

    def value(prop: str, tag: str, attribute: str) -> str:
        return next((v for i in props.get(prop, ()) if page.tag[i] == tag and (v := page.data[i].get(attribute, "").strip())), "")

    def name_in(prop: str) -> str:
        return next((v for i in props.get(prop, ()) for k in page.inside(i, {"meta"}) if page.data[k].get("itemprop") == "name" and (v := page.data[k].get("content", "").strip())), "")

    first_author = props.get("author", ())[:1]
    try:
        host = urlparse(url).hostname
    except ValueError:
        host = None
    return {
        "title": next((t for t in titles if t), "") or host or url,
        "date": value("datePublished", "meta", "content") or value("startDate", "time", "datetime") or meta(DATE_NAMES) or None,
        "author": meta(["author"]) or name_in("author") or "".join(page.text(i, page.end[i]).strip() for i in first_author),
        "publisher": name_in("publisher") or meta(PUBLISHER_NAMES) or url,
        "description": meta(DESCRIPTION_NAMES),
        "tags": [t.strip() for t in meta(TAG_NAMES).split(",") if t.strip()],
        "language": next((x for x in langs if x), "en").split("-")[0].lower() or "en",
    }


def _find_late_images(page: Page) -> None:
    for i in page.elements({"img"}):
        attrs = page.data[i]
        if attrs.get("src", "").strip():
            continue
        found = next((v for a in LATE if (v := attrs.get(a, "").strip())), "")
        if not found and page.tag[page.parent[i]] == "picture":
            sets = (page.data[k].get("srcset", "").strip() for k in page.inside(page.parent[i], {"source"}))
            found = next((c for s in sets if (c := s.split(",")[0].strip().split(" ")[0])), "")
        if found:
            attrs["src"] = found


def tidy_space(text: str) -> str:
    """Runs of spaces, and blank lines with the spaces around them, become one."""
    text = re.sub("  +", " ", text.replace("\r", "").replace("\t", " "))
    return re.sub(" +\n", "\n", re.sub(r"\n[\n ]+", "\n", text))


def clean(page: Page) -> None:
    """Take out what is not content: elements, hidden and empty ones, attributes and white space."""
    for i in page.elements():
        if page.live[i] and (page.tag[i] in DROPPED or "hidden" in page.data[i]):
            page.remove(i)
    # from the end, so that an element is seen after all that it holds
    filled = bytearray(len(page.tag))
    for i in range(len(page.tag) - 1, 0, -1):
        if not page.live[i]:
            continue
        if page.tag[i] in GO_EMPTY and not filled[i]:
            page.remove(i)
        elif page.tag[i] is not None or page.data[i].strip():
            filled[page.parent[i]] = 1
    for i in page.elements():
        page.data[i] = {k: v for k, v in page.data[i].items() if k not in DROPPED_ATTRIBUTES and not k.startswith(("data-", "on"))}
        source = page.data[i].get("src", "")
        if page.tag[i] == "img" and source.startswith("data:image/svg+xml"):
            payload = source.partition(",")[2] or source
            if "svg" in payload and "<" not in payload:
                page.remove(i)
    for i in range(len(page.tag)):
        if page.live[i] and page.tag[i] is None and page.tag[page.parent[i]] not in ("pre", "code"):
            page.data[i] = tidy_space(page.data[i])


def main_content(page: Page) -> int:
    """The only article in a main, else the first main, else the first article, else the body."""
    inner = {k for m in page.elements({"main"}) for k in page.inside(m, {"article"})}
    if len(inner) == 1:
        return inner.pop()
    first = lambda found: next(iter(found), None)
    main = first(i for i in page.elements() if page.tag[i] == "main" or page.data[i].get("role") == "main")
    for found in (main, first(page.elements({"article"})), first(page.elements({"body"}))):
        if found is not None:
            return found
    return 0


def replace(page: Page) -> None:
    """Headings one level down if there is one of the first; simpler elements for others."""
    lower = any(True for _ in page.elements({"h1"}))
    for i in page.elements():
        tag, attrs = page.tag[i], page.data[i]
        if lower and tag in HEADINGS:
            level = HEADINGS.index(tag) + 1
            if level < len(HEADINGS):
                tag = HEADINGS[level]
            else:
                tag = "p"
                page.data[i] = attrs = {"role": "heading", "aria-level": "7", **attrs}
        tag = SIMPLER.get(tag, tag)
        if tag not in KNOWN and tag not in ("html", "head", "body", "title", "#root"):
            tag = "div"
        if tag in STYLED:
            tag, style = STYLED[tag]
            page.data[i] = {"style": style, **attrs}
        page.tag[i] = tag


def _place_images(page: Page, content: int, url: str) -> list[str]:
    images: dict[str, None] = {}
    for i in page.inside(content, {"img"}):
        source = page.data[i].get("src", "").strip()
        if source and not source.startswith("data:"):
            absolute = urljoin(url, source)
            images[absolute] = None
            alt = page.data[i].get("alt")
            page.data[i] = {"src": absolute, **({"alt": alt} if alt else {})}
    return list(images)


def split(page: Page, content: int, title: str) -> list[tuple[str, int, int, list[int]]]:
    """(title, first node, end, shells) of each chapter.

    Level-two headings cut; with a single one, level-three headings too.  A
    chapter stands in copies of the elements that hold its heading.  What is
    before the first heading is a chapter if it has enough text.
    """
    first, end = content + 1, page.end[content]
    name = {i: page.text(i, page.end[i]).strip() for i in page.inside(content, {"h2", "h3"})}
    cuts = [i for i, t in name.items() if t and page.tag[i] == "h2"]
    if not cuts:
        return [(title, first, end, [])]
    if len(cuts) == 1:
        cuts = [i for i, t in name.items() if t]
    stops = [*cuts[1:], end]
    chapters = [(name[i], page.end[i], stop, page.ancestors(i, content)) for i, stop in zip(cuts, stops, strict=True)]
    chapters = [c for c in chapters if page.text(c[1], c[2]).strip()]
    if len(page.text(first, cuts[0]).strip()) >= LEFTOVER:
        chapters.insert(0, (title, first, cuts[0], []))
    return chapters


def _chapters(page: Page, content: int, title: str, url: str) -> list[dict]:
    parts = split(page, content, title)
    owners: dict[str, int] = {}
    for k, (_, low, high, shells) in enumerate(parts):
        for i in [*shells, *page.elements(None, low, high)]:
            if page.data[i].get("id"):
                owners.setdefault(page.data[i]["id"], k)
            if page.tag[i] == "a" and page.data[i].get("name"):
                owners.setdefault(page.data[i]["name"], k)
    own = urldefrag(url)[0]
    inner: dict[int, str] = {}

    def linked(i: int) -> tuple[str, dict]:
        """Addresses are absolute, inner ones lead to the chapter that has them, broken ones are no links."""
        tag, attrs = page.tag[i], page.data[i]
        if tag != "a" or "href" not in attrs:
            return tag, attrs
        try:
            absolute = urljoin(url, attrs["href"])
        except ValueError:
            absolute = attrs["href"]
        base, fragment = urldefrag(absolute)
        if base == own and fragment or absolute.startswith("#"):
            if fragment not in owners:
                return "span", {k: v for k, v in attrs.items() if k != "href"}
            inner[i] = fragment
            chapter = into.get(owners[fragment])
            here = chapter is None or chapter == into.get(at)
            return tag, attrs | {"href": f"#{fragment}" if here else f"chapter_{chapter + 1:04d}.xhtml#{fragment}"}
        blank = {"target": "_blank"} if absolute.startswith(("http://", "https://")) else {}
        return tag, attrs | {"href": absolute} | blank

    into: dict[int, int] = {}
    bodies = []
    for at, (_, low, high, shells) in enumerate(parts):  # noqa: B007
        bodies.append(page.write(low, high, shells, change=linked))
    named = [(t or title, b) for (t, *_), b in zip(parts, bodies, strict=True)]
    groups = grouped(named)
    if len(groups) > 1 and inner:
        # links between chapters are known only now
        into = {k: n for n, (_, _, members) in enumerate(groups) for k in members}
        for at, (_, low, high, shells) in enumerate(parts):  # noqa: B007
            bodies[at] = page.write(low, high, shells, change=linked)
        groups = grouped([(t, b) for (t, _), b in zip(named, bodies, strict=True)])
    return [{"title": t, "body": b} for t, b, _ in groups] or [{"title": title, "body": "<p></p>"}]


def read_page(html: str, url: str) -> dict:
    page = Page(html)
    about = _metadata(page, url)
    title = about["title"] or UNTITLED
    _find_late_images(page)
    clean(page)
    content = main_content(page)
    replace(page)
    images = _place_images(page, content, url)
    return about | {"title": title, "chapters": _chapters(page, content, title, url), "images": images}


@vectorised(PAGE_DDL)
def page(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    """Metadata, consolidated chapters and images of each page; null html is an empty page."""
    return pd.DataFrame([read_page(h or "", u or "") for h, u in zip(html, url, strict=True)], columns=["title", "date", "author", "publisher", "description", "tags", "language", "chapters", "images"], dtype=object)


def reference_class(url: Column | str) -> Column:
    """keep, remote, internal or block: what a reader does with an address."""
    u = F.lower(F.trim(F.coalesce(col(url), F.lit(""))))
    return F.when(u == "", "block").when(u.rlike("^(#|data:|about:blank|mailto:|tel:)"), "keep").when(u.rlike("^((https?:)?//|[a-z][a-z0-9+.-]*:)"), "remote").otherwise("internal")
