"""A small helper that looks up tags in one HTML page.

It runs inside a pandas UDF; Spark splits the pages over tasks. A page is read
in one pass; attributes and character references are decoded only where asked.
"""

import re
from bisect import bisect_right
from html import unescape

# Tags without content, and tags whose content is plain text, per
# the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNREAD = frozenset("script style".split())
_PLAIN = frozenset("title textarea".split())
# Opening one of these ends an open element of the listed kinds.
_BLOCKS = (
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6"
    " header hr main nav ol p pre section table ul"
).split()
_ENDS = {tag: frozenset(["p"]) for tag in _BLOCKS} | {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "option": frozenset(["option"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
# An implied end never reaches past one of these.
_WALLS = frozenset("table ul ol dl select div article section body html".split())
_ENDS = {tag: (ended, _WALLS - ended) for tag, ended in _ENDS.items()}
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _UNREAD | _PLAIN}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Node:
    __slots__ = ("page", "tag", "raw", "start", "end", "texts_from", "texts_to", "_attrs")

    def __init__(self, page, tag, raw, start):
        self.page, self.tag, self.raw, self.start = page, tag, raw, start
        self.end, self.texts_from, self.texts_to, self._attrs = start, len(page.texts), 0, None

    @property
    def attrs(self):
        if self._attrs is None:
            self._attrs = {}
            for name, value in _ATTRIBUTE.findall(self.raw):
                if value[:1] in ("'", '"'):
                    value = value[1:-1]
                self._attrs.setdefault(name.lower(), unescape(value))
        return self._attrs

    def all(self, tag, **wanted):
        """Matching elements below this one, in document order.

        ``cls`` matches one class or the whole class text; another attribute
        matches by value, or by being there at all when the value is True.
        """
        same = self.page.nodes.get(tag, ())
        for i in range(bisect_right(same, self.start, key=lambda n: n.start), len(same)):
            if same[i].start > self.end:
                return
            if same[i].fits(wanted):
                yield same[i]

    def first(self, tag, **wanted):
        return next(self.all(tag, **wanted), None)

    def fits(self, wanted):
        for name, value in wanted.items():
            if name == "cls":
                classes = self.attrs.get("class", "").split()
                if value not in classes and value != " ".join(classes):
                    return False
            elif name not in self.attrs or value not in (True, self.attrs[name]):
                return False
        return True

    def text(self):
        """Each piece of text stripped, joined without a separator."""
        pieces = self.page.texts[self.texts_from : self.texts_to]
        return "".join([unescape(piece).strip() for piece in pieces])


class _Page:
    """Elements by tag and pieces of text, both in document order."""

    def __init__(self, html):
        self.nodes, self.texts = {}, []
        self.open, self.count, self.pending, self.templates = [Node(self, "", "", 0)], 0, "", 0
        root, at = self.open[0], 0
        token = _TOKEN.search(html)
        while token:
            start, stop = token.span()
            if at < start:
                self.pending += html[at:start]
            at = stop
            end, tag, attrs = token.groups()
            if tag is None:
                self._flush()
            elif end:
                self._close((tag.lower(),), ())
            else:
                tag = tag.lower()
                self._open_tag(tag, attrs)
                if tag in _RAW:
                    close = _RAW[tag].search(html, at)
                    stop = close.start() if close else len(html)
                    self.pending = html[at:stop] if tag in _PLAIN else ""
                    at = stop
            token = _TOKEN.search(html, at)
        self.pending += html[at:]
        self._close_down_to(0)
        self.root = root

    def _flush(self):
        if self.pending:
            if not self.templates:
                self.texts.append(self.pending)
            self.pending = ""

    def _open_tag(self, tag, raw):
        if tag in _ENDS:
            self._close(*_ENDS[tag], every=True)
        self._flush()
        self.count += 1
        node = Node(self, tag, raw, self.count)
        self.nodes.setdefault(tag, []).append(node)
        if tag in _VOID or raw.endswith("/"):
            node.texts_to = node.texts_from
        else:
            self.open.append(node)
            self.templates += tag == "template"

    def _close(self, tags, walls, every=False):
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                self._close_down_to(depth)
                if not every:
                    return
            elif tag in walls:
                return

    def _close_down_to(self, depth):
        self._flush()
        for node in self.open[depth:]:
            node.end, node.texts_to = self.count, len(self.texts)
            self.templates -= node.tag == "template"
        del self.open[depth:]


def parse(html: str) -> Node:
    return _Page(html).root
