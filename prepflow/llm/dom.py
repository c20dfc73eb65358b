"""HTML as the trees that ``extraction`` labels: block elements, and the runs of text in them.

Tolerant by construction: unclosed, misnested and unknown tags, stray angle brackets, comments and
raw text are all taken as browsers roughly do, and nothing raises. Reading takes time in proportion
to the page, however odd: what is open is looked up by name, and an end of tag that is missing is missed
once for all tags that lack the same one.
"""

from __future__ import annotations

import html
import re

# How HTML's elements behave.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = set("template object svg canvas audio video select button datalist math".split())
CLOSED_BY = {  # an open element, and the start tags that end it
    "p": set(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt tr td th".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())  # the end tag of one ends any other
SCOPE = set("table td th li ul ol dl article section aside main nav header footer form div html body".split())

CLOSES: dict[str, list[str]] = {}  # the same by start tag: the open elements that it ends
for _open, _tags in CLOSED_BY.items():
    for _tag in _tags:
        CLOSES.setdefault(_tag, []).append(_open)

STARTS = re.compile(r"</?[a-zA-Z]")
NAME_END = re.compile(r"[\s/>]")
QUOTES = re.compile(r"[\"']")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role|itemprop|data-main)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in page order: parent position (-1 for the root), tag ("#" for a run), attribute words, text, link share."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.text, self.linked, self.main = [], [], [], [], [], []
        self._open: list[tuple[str, int, bool]] = []  # tag, node (-1: none), hidden
        self._at: dict[str, list[int]] = {}  # where in it elements of a name are
        self._scopes: list[int] = []  # where those are that limit what a start tag ends
        self._blocks: list[int] = []  # where those with a node are
        self._pieces: list[tuple[str, bool]] = []
        self._links = self._hidden = 0
        self._node("html", [], None)
        self._push("html", 0, False)
        self._read(source)
        self._flush()

    def _node(self, tag: str, names: list[str], main) -> int:
        self.parent.append(self._block())
        self.tag.append(tag)
        self.names.append(names)
        self.text.append("")
        self.linked.append(0.0)
        self.main.append(main)
        return len(self.tag) - 1

    def _block(self) -> int:
        return self._open[self._blocks[-1]][1] if self._blocks else -1

    def _push(self, tag: str, node: int, hidden: bool) -> None:
        at = len(self._open)
        self._open.append((tag, node, hidden))
        self._at.setdefault(tag, []).append(at)
        if tag in SCOPE:
            self._scopes.append(at)
        if node >= 0:
            self._blocks.append(at)

    def _last(self, names) -> int:
        """Where the nearest open element of these names is, but for the root; 0 if there is none."""
        return max((self._at[n][-1] for n in names if self._at.get(n)), default=0)

    def _flush(self) -> None:
        pieces, self._pieces = self._pieces, []
        text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
        if not text:
            return
        total = sum(len(t.strip()) for t, _ in pieces)
        linked = sum(len(t.strip()) for t, in_link in pieces if in_link)
        node = self._node("#", [], None)
        self.text[node], self.linked[node] = text, linked / max(1, total)

    def _pop(self) -> None:
        tag, node, hidden = self._open.pop()
        self._at[tag].pop()
        if tag in SCOPE:
            self._scopes.pop()
        if node >= 0:
            self._blocks.pop()
        self._hidden -= hidden
        if tag == "a":
            self._links -= 1

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        if tag in INLINE:
            if tag == "br":
                self._pieces.append((" ", False))
            if tag in VOID:
                return
            if tag == "a":
                self._links += 1
            self._push(tag, -1, False)
            return
        self._flush()
        at = self._last(CLOSES.get(tag, ()))  # an open element that this tag ends
        if at > 0 and at >= self._scopes[-1]:
            while len(self._open) > at:
                self._pop()
        if tag in VOID:
            return
        found = {k.lower(): v.strip("\"'") for k, v in NAMED.findall(attributes)} if attributes else {}
        main = found.pop("data-main", None)
        names = [w.lower() for v in found.values() for w in WORDS.findall(v)]
        hidden = tag in HIDDEN
        self._hidden += hidden
        self._push(tag, self._node(tag, names, main), hidden)

    def _end(self, tag: str) -> None:
        if tag == "html" or tag == "body":
            return
        at = self._last(HEADINGS if tag in HEADINGS else (tag,))
        if at == 0 or tag in INLINE and at < self._blocks[-1]:
            return  # an inline end tag does not close blocks
        if tag not in INLINE:
            self._flush()
        while len(self._open) > at:
            self._pop()

    def _read(self, source: str) -> None:
        at = 0
        for found in self._tags(source):
            if found.start() > at and not self._hidden:
                self._pieces.append((source[at : found.start()], self._links > 0))
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                self._end(tag)
            elif tag in RAW and not found[3].endswith("/"):
                if tag not in INLINE:
                    self._flush()
                at = self._after_raw(tag, source, at)
                self._next = at
            else:
                self._start(tag, found[3])  # HTML ignores a slash at the end: the element stays open
        if at < len(source) and not self._hidden:
            self._pieces.append((source[at:], self._links > 0))

    def _after_raw(self, tag: str, source: str, at: int) -> int:
        """Where the page goes on behind the end tag of a raw text element."""
        if self._lower is None:
            self._lower = source.lower()
        lower = self._lower if len(self._lower) == len(source) else source
        end = lower.find("</" + tag, at)
        close = source.find(">", end) if end >= 0 else -1
        return close + 1 if close >= 0 else len(source)

    def _tags(self, source: str):
        """Tags, comments and the like, from ``_next`` on.

        From a start without end, the places outside of quotes that its search has passed are kept: a later
        start whose name ends at one of them would search the same way. Two quote signs make at most three such ways.
        """
        self._next, self._lower = 0, None
        missed = None
        last_end, name_end = source.rfind(">"), 0
        while (at := source.find("<", self._next)) >= 0:
            is_tag = STARTS.match(source, at)
            declares = source.startswith(("<!", "<?"), at)
            if is_tag and name_end < is_tag.end():  # else the name ends where that of an earlier start did
                end = NAME_END.search(source, is_tag.end())
                name_end = end.start() if end else len(source)
            if is_tag:
                may_end = not (missed and missed[name_end])
            else:
                may_end = declares and (at < last_end or source.startswith(("<!--", "<![CDATA["), at))
            found = TAG.match(source, at) if may_end else None
            if found is None:
                self._next = at + 1
                if is_tag and may_end:
                    missed = missed or bytearray(len(source) + 1)
                    self._miss(source, name_end, missed)
                continue
            self._next = found.end()
            yield found

    @staticmethod
    def _miss(source: str, at: int, missed: bytearray) -> None:
        while True:
            quote = QUOTES.search(source, at)
            to = quote.start() if quote else len(source)
            missed[at : to + 1] = b"\1" * (to + 1 - at)
            close = source.find(quote[0], quote.end()) if quote else -1
            if close < 0:
                return
            at = close + 1
