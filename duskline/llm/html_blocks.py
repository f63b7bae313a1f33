"""Flat text blocks of a raw HTML page, with the measures that a block classifier looks at.

Tags of inline elements do not end a block; every other tag does, `br` included. Text in `script`,
`style`, `template`, `noscript`, `title`, `textarea`, `select`, `button` and other elements that no
reader sees as text is no block. Missing end tags are tolerated: a block knows the elements that
are open around it, and an end tag closes everything opened since its start tag.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby"
    " s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = RAW | frozenset("template select option button svg math object canvas audio video head".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# An open element of these ends where the next of its kind or its container begins.
_IMPLIED = {
    "p": frozenset(
        "p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6"
        " blockquote pre hr figure fieldset address details menu".split()
    ),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body", "article", "main", "div", "p", "nav", "section", "header"}),
}

# Names of containers (elements, classes, ids, roles) that tell what a block is for.
BOILERPLATE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner topbar footer"
    " foot bottom copyright aside sidebar side widget complementary ad ads advert adverts advertisement"
    " advertising sponsor sponsored promo promotion notice notices cookie cookies consent gdpr alert"
    " modal popup overlay form login search subscribe newsletter signup comment comments"
    " disqus reply replies discussion share sharing social related recommended recommendations"
    " pagination pager toolbar contentinfo legal disclaimer skip tags".split()
)
CONTENT = frozenset(
    "article main content post entry story articlebody entrycontent postcontent maincontent text"
    " body-text articletext".split()
)


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    boilerplate: int
    content: int
    heading: bool
    item: bool
    label: bool | None = None
    around: list[float] = field(default_factory=list)

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def _names(tag: str, attributes: str) -> tuple[int, int, bool, bool | None]:
    """Whether an element is a container of boilerplate, of content, hidden, and its `data-keep`."""
    parts, hidden, keep = {tag}, False, None
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c)
            if name in ("class", "id", "role"):
                for word in value.lower().split():
                    parts.add(word.replace("-", "").replace("_", ""))
                    parts.update(re.split(r"[-_]+", word))
            elif name == "hidden" or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)
            ):
                hidden = True
            elif name == "data-keep":
                keep = value == "1"
    boilerplate = not parts.isdisjoint(BOILERPLATE)
    return int(boilerplate), int(not parts.isdisjoint(CONTENT)), hidden or tag in HIDDEN, keep


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in page order, without their measures of neighbours."""
    page = page or ""
    out: list[Block] = []
    # (tag, boilerplate, content, hidden, keep) of the elements that are open.
    open_: list[tuple] = []
    pieces: list[str] = []
    link_words, anchors = 0, 0
    state = (0, 0, False, None, False, False)

    def close() -> None:
        nonlocal link_words
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                words = max(len(_WORD.findall(text)), 1)
                out.append(
                    Block(text, words, min(link_words, words), state[0], state[1], state[4], state[5], state[3])
                )
        link_words = 0

    def standing() -> tuple:
        # An article inside a sidebar is boilerplate, a nav inside an article as well, but a
        # header inside an article may hold its headline: the innermost container decides.
        boilerplate = content = 0
        keep = None
        for depth, element in enumerate(open_, 1):
            if element[2] and not element[1]:
                content = depth
            if element[1]:
                boilerplate = depth
            if element[4] is not None:
                keep = element[4]
        tags = {e[0] for e in open_}
        return (
            int(boilerplate > content) * 2 + int(0 < boilerplate < content),
            int(content > 0),
            any(e[3] for e in open_),
            keep,
            not tags.isdisjoint({"h1", "h2", "h3", "h4", "h5", "h6"}),
            "li" in tags,
        )

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        found = _TOKEN.match(page, tag) if tag >= 0 else None
        end = tag if found else (n if tag < 0 else tag + 1)
        if end > at and not state[2]:
            piece = page[at:end]
            pieces.append(piece)
            if anchors:
                link_words += len(_WORD.findall(html.unescape(piece)))
        if not found:
            at = end
            continue
        at = found.end()
        start, stop = found.group(2), found.group(1)
        if start:
            name = start.lower()
            if name not in INLINE:
                close()
                while open_ and name in _IMPLIED.get(open_[-1][0], ()):
                    open_.pop()
            elif name == "a":
                anchors += 1
            if name in VOID or found.group(3).endswith("/"):
                if name == "a":
                    anchors -= 1
                if name not in INLINE:
                    state = standing()
                continue
            open_.append((name, *_names(name, found.group(3))))
            state = standing()
            if name in RAW:
                # The content of these ends at their end tag alone.
                close_at = re.compile(rf"</{re.escape(name)}\s*[>/]", re.I).search(page, at)
                at = close_at.start() if close_at else n
        elif stop:
            name = stop.lower()
            if name not in INLINE:
                close()
            place = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if place is not None:
                dropped = open_[place:]
                anchors = max(0, anchors - sum(e[0] == "a" for e in dropped))
                # Inline elements that a block's end leaves open do not go on.
                del open_[place:]
                state = standing()
    close()
    return out


# The columns of the labelled table, in the order of the tree's features.
FEATURES = (
    "words",
    "link_density",
    "previous_words",
    "previous_link_density",
    "next_words",
    "next_link_density",
    "boilerplate",
    "content",
    "heading",
    "item",
    "page_has_content",
    "symbols",
)
# Bars, dots and arrows stand in tables and lists of articles as well.
_ODD = re.compile(r"©|\(c\) ?\d{4}", re.I)


def features_of(blocks: list[Block]) -> list[list[float]]:
    """One row of FEATURES per block; a missing neighbour counts as empty."""
    main = float(any(b.content and not b.boilerplate for b in blocks))
    rows = []
    for k, b in enumerate(blocks):
        before = blocks[k - 1] if k else None
        after = blocks[k + 1] if k + 1 < len(blocks) else None
        rows.append(
            [
                float(b.words),
                b.link_density,
                float(before.words) if before else 0.0,
                before.link_density if before else 0.0,
                float(after.words) if after else 0.0,
                after.link_density if after else 0.0,
                float(b.boilerplate),
                float(b.content),
                float(b.heading),
                float(b.item),
                main,
                float(len(_ODD.findall(b.text))),
            ]
        )
    return rows
