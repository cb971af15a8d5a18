"""A page as one flat list of nodes in document order; nothing here recurses, however deep the nesting.

Node i has a tag (None for text), its attributes or its text, its parent and the
end of its subtree: the subtree is the range i..end.  Taking an element out
marks its range; its place in the list stays.
"""

from __future__ import annotations

import html as entities
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

#: Elements without content, elements of text only, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot select div section article main body html td th blockquote".split())


class Page(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = ["#root"]
        self.data: list = [{}]
        self.parent, self.end = [-1], [0]
        self._open = [0]
        self.feed(source)
        self.close()
        while self._open:
            self._shut()
        self.live = bytearray(b"\1") * len(self.tag)

    # ------------------------------------------------ building

    def _add(self, tag: str | None, data) -> None:
        self.tag.append(tag)
        self.data.append(data)
        self.parent.append(self._open[-1])
        self.end.append(len(self.tag))

    def _shut(self) -> None:
        self.end[self._open.pop()] = len(self.tag)

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, ())
        if tag in _BLOCKS and self.tag[self._open[-1]] == "p":
            self._shut()
        for at in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[at]]
            if name in closes:
                while len(self._open) > at:
                    self._shut()
                break
            if name in _SCOPES and name not in closes:
                break
        self._add(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag not in VOID:
            self._open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut()

    def handle_endtag(self, tag):
        for at in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[at]] == tag:
                while len(self._open) > at:
                    self._shut()
                return

    def handle_data(self, data):
        self._add(None, data)

    # ------------------------------------------------ looking

    def elements(self, tags=None, low: int = 0, high: int | None = None) -> Iterator[int]:
        """Live elements of some tags in a range, in document order."""
        for i in range(low, len(self.tag) if high is None else high):
            if self.live[i] and self.tag[i] is not None and (tags is None or self.tag[i] in tags):
                yield i

    def inside(self, i: int, tags=None) -> Iterator[int]:
        return self.elements(tags, i + 1, self.end[i])

    def text(self, low: int, high: int) -> str:
        return "".join(self.data[i] for i in range(low, high) if self.live[i] and self.tag[i] is None)

    def ancestors(self, i: int, top: int) -> list[int]:
        """From below ``top`` down to the element's parent."""
        out = []
        while (i := self.parent[i]) != top and i > 0:
            out.append(i)
        return out[::-1]

    # ------------------------------------------------ changing and writing

    def remove(self, i: int) -> None:
        self.live[i : self.end[i]] = bytes(self.end[i] - i)

    def write(self, low: int, high: int, shells: list[int] = (), xml: bool = True, change: Callable[[int], tuple[str, dict]] | None = None) -> str:
        """Markup of a range inside copies of the ``shells``; elements that reach beyond the range end with it."""
        out, ends = [], []
        plain = lambda i: (self.tag[i], self.data[i])

        def begin(i: int, end: int) -> None:
            tag, attrs = (change or plain)(i)
            inner = "".join(f' {k}="{entities.escape(v)}"' for k, v in attrs.items())
            if tag in VOID:
                out.append(f"<{tag}{inner}/>" if xml else f"<{tag}{inner}>")
            else:
                out.append(f"<{tag}{inner}>")
                ends.append((end, tag))

        for i in shells:
            begin(i, self.end[i])
        for i in range(low, high):
            while ends and ends[-1][0] <= i:
                out.append(f"</{ends.pop()[1]}>")
            if not self.live[i]:
                continue
            if self.tag[i] is not None:
                begin(i, self.end[i])
            else:
                raw = not xml and self.tag[self.parent[i]] in RAW
                out.append(self.data[i] if raw else entities.escape(self.data[i], quote=False))
        out += [f"</{tag}>" for _, tag in reversed(ends)]
        return "".join(out)
