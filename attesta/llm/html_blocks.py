"""Leaf blocks of a web page, with the path of tags that leads to each."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Elements that end a block of text.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
select summary table tbody td textarea tfoot th thead tr ul""".split())
#: Elements whose text is never shown.
HIDDEN_TAGS = frozenset("script style noscript template head title iframe object svg math canvas audio video".split())
#: Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head; anything else ends one whose end tag was left out.
HEAD_TAGS = frozenset("base basefont bgsound command link meta noframes noscript script style template title head html".split())
#: An opening tag of the first kind ends an open one of the second.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "option": {"option"}}
#: Block elements that end an open paragraph.
ENDS_PARAGRAPH = BLOCK_TAGS - {"button", "option", "optgroup", "select", "textarea", "legend", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
TOKEN = re.compile(r"[a-z]+|[0-9]+")


class Blocks(HTMLParser):
    """Collects (path, text, characters inside links); a path is a tuple of tokens, the outermost first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.hidden = 0
        self.links = 0
        self.found: list[tuple[tuple[str, ...], str, int]] = []
        self.where: tuple[str, ...] = ()

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append((self.where, text, self.linked))
            self.parts, self.linked = [], 0

    def pop(self, n: int):
        for tag, _ in self.stack[n:]:
            self.hidden -= tag in HIDDEN_TAGS
            self.links -= tag == "a"
        del self.stack[n:]

    def end_head(self, tag: str | None = None):
        """Close an open head before a tag or text that can't stand in it; ``body`` also closes what is open inside, but no template."""
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD_TAGS:
            self.pop(len(self.stack) - 1)
        elif tag == "body":
            names = [t for t, _ in self.stack]
            if "head" in names and "template" not in names:
                self.pop(names.index("head"))

    def handle_starttag(self, tag, attrs):
        self.end_head(tag)
        if tag == "br":
            if self.parts and not self.hidden:
                self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
            closes = CLOSES.get(tag) or ({"p"} if tag in ENDS_PARAGRAPH else ())
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in closes:
                    self.pop(i)
                    break
                if self.stack[i][0] in BLOCK_TAGS and self.stack[i][0] not in ("p",):
                    break
        if tag in VOID_TAGS:
            return
        words = [tag]
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                words += ["." + w for w in TOKEN.findall(value.lower())[:8]]
        self.stack.append((tag, tuple(words)))
        self.hidden += tag in HIDDEN_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if self.hidden:
            return
        if not self.parts:
            if not data.strip():
                return
            self.where = tuple(w for _, words in self.stack for w in words)
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path tokens, text, linked characters) of every leaf block, in page order; hidden text is left out.

    White space inside a block is one space; a block without text is none.
    Line breaks do not end a block.  Broken markup is read as browsers do:
    an end tag without a start is passed over, an open element ends with the page,
    a head without an end tag at the first thing that can't stand in it.
    """
    if not html:
        return []
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found
