"""A tolerant reader of HTML: nodes with their features, without building objects per node."""

from __future__ import annotations

import html
import re
from zlib import crc32

import numpy as np

#: A tag from its name on. Quotes count where a value begins; a tag that isn't closed ends at the next "<". Nothing is tried twice: what is
#: matched is never given back, and an open quote without an end is found out once.
_NAME = re.compile(r"/?[a-zA-Z][^\s/><]*+")
_REST = re.compile(r"""(?:[^"'<>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>]*+)|["'])*+""")
_ATTR = re.compile(r"""([^\s=/"'][^\s=/]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(\S*+)))?+""")
_TELLING = frozenset("class id role style itemprop aria-label".split())
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed".split())
#: No text of these is ever main text.
NEVER = frozenset("script style head title noscript template svg iframe object select option textarea button input label math canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start of these ends an open paragraph.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start of the key ends an open one of these, up to the limits.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_LIMITS = frozenset("ul ol dl table body html article section main div aside nav header footer form td th".split())

# Words in class, id and role attributes by what they tell.
LEXICON = (
    "article content post entry main body story text prose page",
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner doubleclick",
    "nav navigation navbar menu breadcrumb breadcrumbs toolbar tabs pagination pager toc",
    "footer foot copyright legal bottom colophon contentinfo",
    "sidebar side aside widget related recommended rail complementary more popular trending",
    "comment comments reply replies disqus respond discussion feedback reader",
    "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login gdpr form search dialog warning",
    "share social follow tools meta byline author tags print rating header masthead top logo banner",
)
_KIND = {w: k for k, words in reversed(list(enumerate(LEXICON))) for w in words.split()}
_TAGS = {t: k for k, tags in enumerate(("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "a", "div section center", "article main", "nav menu", "header", "footer", "aside", "form fieldset", "table tr td th tbody thead", "b i em strong span u small font", "pre blockquote figure figcaption code", "ul ol dl")) for t in tags.split()}
N_TAGS, N_WORDS = 15, len(LEXICON)
#: Kinds of tags that matter when an ancestor has them: article, nav, header, footer, aside, form.
_ABOVE = (5, 6, 7, 8, 9, 10)
#: Bits for the words of attributes that no list has, by hash: trees learn from pages what they tell.
HASHED = 16
N_FEATURES = N_TAGS + 2 * (N_WORDS + 1 + HASHED) + len(_ABOVE) + 18
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


class Page:
    """Nodes in page order: parent, tag and the like, as lists; pieces of text by node. Reading takes time in proportion to the
    source, whatever it holds: nothing is searched for again, and ends of elements are found by name."""

    __slots__ = ("tags", "parent", "depth", "words", "hidden", "pieces", "mark", "_stack", "_open_at", "_blocks", "_limits")

    def __init__(self, source: str) -> None:
        self.tags, self.parent, self.depth, self.words, self.hidden = ["#root"], [-1], [0], [0], [False]
        #: (node, text), or (node, None) for a break between blocks, in page order.
        self.pieces: list[tuple[int, str | None]] = []
        self.mark: list[bool] = [False]
        #: Open nodes; of each tag, of the tags that are no inline ones and of those in _LIMITS: their places in the stack.
        self._stack: list[int] = [0]
        self._open_at: dict[str, list[int]] = {}
        self._blocks: list[int] = [0]
        self._limits: list[int] = [0]
        self._read(source)

    def _add(self, tag: str, attrs: str) -> int:
        node = len(self.tags)
        self.tags.append(tag)
        self.parent.append(self._stack[-1])
        self.depth.append(len(self._stack))
        kinds, hidden = 0, False
        if "=" in attrs:
            for m in _ATTR.finditer(attrs):
                if m.lastindex > 1 and m[1].lower() in _TELLING:
                    for token in _TOKEN.findall(m[m.lastindex]):
                        token = token.lower()
                        k = _KIND.get(token)
                        kinds |= 1 << (N_WORDS + crc32(token.encode()) % HASHED if k is None else k)
        if attrs:
            hidden = bool(_HIDDEN.search(attrs))
        self.words.append(kinds)
        self.hidden.append(hidden)
        self.mark.append("data-main" in attrs)
        return node

    def _push(self, node: int, tag: str) -> None:
        at = len(self._stack)
        self._stack.append(node)
        self._open_at.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self._blocks.append(at)
        if tag in _LIMITS:
            self._limits.append(at)

    def _close(self, at: int) -> None:
        """Closes the open nodes from a place of the stack on."""
        if self._blocks[-1] >= at:
            self.pieces.append((self._stack[at], None))
        while len(self._stack) > at:
            self._open_at[self.tags[self._stack.pop()]].pop()
        for places in (self._blocks, self._limits):
            while places[-1] >= at:
                places.pop()

    def _last(self, tag: str) -> int:
        """The place of the last open node of a tag, 0 if there is none."""
        places = self._open_at.get(tag)
        return places[-1] if places else 0

    def _end(self, tag: str) -> None:
        at = self._last(tag)
        if at and (tag not in INLINE or at > self._blocks[-1]):  # an inline end doesn't close blocks
            self._close(at)
        elif not at and tag in _BLOCKS:
            self.pieces.append((self._stack[-1], None))

    def _implied_ends(self, tag: str) -> None:
        """What a start of the tag ends."""
        ends = _ENDS.get(tag, ())
        while True:
            at = max((self._last(t) for t in ends), default=0)
            if tag in _BLOCKS:
                at = max(at, self._last("p"))
            if not at or at < self._limits[-1]:
                break
            self._close(at)
            if tag not in ("tr", "tbody", "tfoot", "thead"):
                break
        if tag == "body" and (head := self._last("head")):
            self._close(head)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                lt = size
            if lt > at:
                self.pieces.append((self._stack[-1], source[at:lt]))
            if lt == size:
                break
            follows = source[lt + 1 : lt + 2]
            if follows in ("!", "?") or (follows == "/" and not source[lt + 2 : lt + 3].isalpha()):
                close, n = ("-->", 3) if source.startswith("!--", lt + 1) else (">", 1)
                end = source.find(close, lt + 2)
                at = size if end < 0 else end + n
                continue
            m = _NAME.match(source, lt + 1)
            if not m:
                self.pieces.append((self._stack[-1], "<"))
                at = lt + 1
                continue
            rest = _REST.match(source, m.end())
            at = rest.end()
            if source.startswith(">", at):
                at += 1
            elif at >= size:
                break  # the page ends within a tag
            tag, attrs = m[0].lower(), rest[0]
            if tag[0] == "/":
                self._end(tag[1:])
                continue
            if tag in _BLOCKS or tag in _ENDS or tag == "body":
                self._implied_ends(tag)
            if tag not in INLINE:
                self.pieces.append((self._stack[-1], None))
            node = self._add(tag, attrs)
            if tag in RAW:
                end = _CLOSE[tag].search(source, at)
                self.pieces.append((node, source[at : end.start() if end else size]))
                at = source.find(">", end.end()) + 1 if end else size
                if not at:
                    break
            elif tag not in VOID and not attrs.endswith("/"):
                self._push(node, tag)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, characters of own text, whether the node is under a tag without main text) by node."""
        n = len(self.tags)
        parent, depth = np.array(self.parent), np.array(self.depth)
        own, marks, words = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text in self.pieces:
            if text:
                own[node] += len(text.strip())
                marks[node] += text.count(".") + text.count(",")
                words[node] += text.count(" ")
        kind = np.array([_TAGS.get(t, -1) for t in self.tags])
        # what a node has itself and what its ancestors have, as bits: words and hashes, hidden, kinds of tags above, no text, in a link
        hide, first = N_WORDS + HASHED, N_WORDS + HASHED + 1
        above = {_ABOVE[i]: 1 << (first + i) for i in range(len(_ABOVE))}
        no_text, link_bit = 1 << (first + len(_ABOVE)), 1 << (first + len(_ABOVE) + 1)
        bits = []
        for tag, k, w, hid in zip(self.tags, kind.tolist(), self.words, self.hidden, strict=True):
            bits.append(w | hid << hide | above.get(k, 0) | (no_text if tag in NEVER else 0) | (link_bit if k == 3 else 0))
        mine = np.array(bits)
        end, up = list(range(1, n + 1)), self.parent
        for i in range(1, n):
            bits[i] |= bits[up[i]]
        for i in range(n - 1, 0, -1):  # a subtree's nodes follow its root
            if end[i] > end[up[i]]:
                end[up[i]] = end[i]
        every = np.array(bits)
        has = lambda x, b: (x & b) != 0
        columns = lambda x, low, many: (x[:, None] >> np.arange(low, low + many)) & 1
        lex, seen, over = columns(mine, 0, first), columns(every, 0, first), columns(every, first, len(_ABOVE))
        never, in_link = has(every, no_text), has(every, link_bit)
        own[never] = 0
        sums = np.zeros((6, n + 1))
        np.cumsum(np.stack([own, np.where(in_link, own, 0), np.ones(n), marks * ~never, (kind == 0).astype(float), words * ~never]), axis=1, out=sums[:, 1:])
        total = sums[:, np.array(end)] - sums[:, :n]
        chars, links, tags, points, paras, spaces = total
        kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n, int)
        rank = np.zeros(n)
        seen_kids: dict[int, int] = {}
        for i in range(1, n):
            rank[i] = seen_kids.get(self.parent[i], 0)
            seen_kids[self.parent[i]] = int(rank[i]) + 1
        up = np.maximum(parent, 0)
        around = (chars[up] - chars) / np.maximum(1, kids[up] - 1)
        f = np.zeros((n, N_FEATURES), np.float32)
        at = np.flatnonzero(kind >= 0)
        f[at, kind[at]] = 1
        c = N_TAGS
        for block in (lex, seen, over):
            f[:, c : c + block.shape[1]] = block
            c += block.shape[1]
        one = np.maximum(chars, 1)
        rest = (
            np.log1p(chars), links / one, np.log1p(tags), np.log1p(chars / tags), points / one * 100, np.log1p(paras), spaces / one * 10, np.log1p(own), np.minimum(depth, 30),
            rank / np.maximum(1, kids[up]), np.log1p(kids[up]), np.log1p(around), chars / max(1.0, chars[0]), np.log1p(chars[up]), links[up] / np.maximum(1, chars[up]), np.log1p(kids), np.log1p(own / np.maximum(1, tags)), np.log1p(paras[up]),
        )
        for x in rest:
            f[:, c] = x
            c += 1
        return f, own, never

    def text(self, kept: np.ndarray) -> str:
        """The text of the kept nodes: a space between blocks, white space inside a block as one space."""
        out: list[str] = []
        for node, text in self.pieces:
            if text is None:
                out.append(" ")
            elif kept[node]:
                out.append(html.unescape(text))
        return " ".join("".join(out).split())
