"""HTML pages to title, main text and addresses, with the standard library's parser.

The regular expressions run in Python; a page is parsed once for all three results. Addresses in texts begin with a letter, digit or _ before which none stands, and end with a letter behind which none
stands, of any script: the fixed patterns' own word boundaries also let .b@c.io begin within éa.b@c.io.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql.functions import udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .emails import AT_WORD, DOT_WORD, SPACED, STANDARD

#: Elements that are dropped; what may hold the main text, the first kind that a page has wins; elements without content.
DROPPED = ["script", "style", "nav", "header", "footer", "aside"]
MAIN = ["main", "article", ".content", "#content", ".main-content", ".post-content", ".entry-content", ".page-content"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
_STANDARD = re.compile(STANDARD)


def _whole(pattern: str) -> re.Pattern:
    """A fixed pattern, \\b...\\b, between whole words only."""
    flags, _, rest = pattern.partition(r"\b")
    return re.compile(flags + r"(?<!\w)(?=[A-Za-z0-9_])" + rest.removesuffix(r"\b") + r"(?<=[A-Za-z])(?!\w)")


_PLAIN = _whole(STANDARD)
#: (pattern, what is replaced in a match, by what, what a text must hold for a match)
_DISGUISED = [(_whole(AT_WORD), re.compile(r"\s*(?:at|AT)\s*"), "@", "."), (_whole(DOT_WORD), re.compile(r"(?i)\[dot\]|\(dot\)"), ".", "@"), (_whole(SPACED), re.compile(r"\s+"), "", "@")]


class _Page(HTMLParser):
    """Collects the title's, the body's and all main elements' text nodes, and coded addresses, outside of dropped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[list[str]]]] = []  # tag and the texts that its nodes go to
        self.dropped = 0
        self.node: list[str] = []
        self.titles: list[list[str]] = []
        self.bodies: list[list[str]] = []
        self.main: dict[str, list[list[str]]] = {m: [] for m in MAIN}
        self.codes: list[str] = []

    def flush(self):
        """The end of a text node."""
        text = "".join(self.node).strip()
        self.node.clear()
        if text and not self.dropped:
            for _, texts in self.open:
                for t in texts:
                    t.append(text)

    def handle_data(self, data):
        self.node.append(data)

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in DROPPED:
            self.dropped += 1
        texts: list[list[str]] = []
        if not self.dropped:
            a = dict(reversed(attrs))  # the first of equal attributes
            found = [tag, *("." + c for c in (a.get("class") or "").split()), "#" + (a.get("id") or "")]
            for where in [self.main[f] for f in dict.fromkeys(found) if f in self.main] + [x for n, x in (("title", self.titles), ("body", self.bodies)) if n == tag]:
                texts.append([])
                where.append(texts[-1])
            if a.get("data-cfemail"):
                self.codes.append(a["data-cfemail"])
        if tag in VOID:
            self.dropped -= tag in DROPPED
        else:
            self.open.append((tag, texts))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if any(t == tag for t, _ in self.open):
            while True:
                closed, _ = self.open.pop()
                self.dropped -= closed in DROPPED
                if closed == tag:
                    return

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def decoded(code: str) -> str | None:
    """The address behind a data-cfemail value, as emails.decode_cloudflare has it."""
    if not re.fullmatch("(?:[0-9a-fA-F]{2}){2,}", code):
        return None
    raw = bytes.fromhex(code)
    text = "".join(chr(b ^ raw[0]) for b in raw[1:])
    return text if _STANDARD.search(text) else None


def addresses(text: str, codes: list[str]) -> list[str]:
    """Sorted distinct addresses: plain, coded and disguised ones."""
    found = set(_PLAIN.findall(text)) if "@" in text else set()
    found.update(e for c in codes if (e := decoded(c)))
    for pattern, fix, by, needs in _DISGUISED:
        if needs in text:
            found.update(e for m in pattern.finditer(text) if _STANDARD.match(e := fix.sub(by, m[0])))
    return sorted(found)


def parse(html: str | None) -> tuple[str, str, list[str]]:
    """(title, text, addresses) of a page; null counts as an empty page.

    The text is that of the first kind of main element that the page has, all elements of that kind joined by spaces, nested ones again; without such text the body's. Text nodes are stripped
    and joined without a separator, white space collapses.
    """
    p = _Page()
    p.feed(html or "")
    p.close()
    p.flush()
    main = next((m for m in p.main.values() if m), [])
    text = " ".join("".join(x) for x in main) or "".join(p.bodies[0] if p.bodies else [])
    text = re.sub(r"\s+", " ", text)
    return re.sub(r"\s+", " ", "".join(p.titles[0] if p.titles else [])), text, addresses(text, p.codes)


_PARTS = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("emails", ArrayType(StringType()))])


@udf(_PARTS, useArrow=False)
def page_parts(html: str | None) -> tuple[str, str, list[str]]:
    """parse() of a page. Rows come to Python by the hundred, so that its memory does not grow with what Arrow's batches of 10,000 pages hold."""
    return parse(html)
