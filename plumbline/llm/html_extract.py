"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

A page becomes its leaf text blocks in page order. A block's features are its own
tag, the tags and class or id words of its ancestors, and its text (length, links,
punctuation). The field labels blocks as main text or not; Viterbi decoding gives
the best labelling of the page. It is trained on labelled pages, which are built
here from many layouts (``labelled_pages``); other labelled pages can be given.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .session import ready

#: A tag; a quote counts only after an equals sign, and only where it is closed.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_OPENING = re.compile("<(?:[!?]|/?[a-zA-Z])")
_NAME = re.compile("<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_TAG_EVENT = re.compile(r"""=\s*+(["'])|>""")
#: Elements whose text is never page text; it ends at the closing tag only.
_RAW = frozenset("script style template iframe textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head body article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend figure figcaption blockquote pre address details summary hr dialog menu center button label option select ins noscript".split()
)
#: A start tag closes the nearest open element of its group, unless one of the second set stands between.
_GROUPS = (({"p"}, {"table", "td", "th", "button"}), ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"}))
_GROUP_OF = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Words of class, id and role that tell what an element is for (fixed values).
CUES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip",
    "head": "header masthead banner topbar logo branding toolbar",
    "foot": "footer copyright colophon legal contentinfo imprint",
    "side": "sidebar aside widget rail complementary",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner",
    "comment": "comment comments reply replies respond discussion disqus reader feedback",
    "notice": "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe alert dialog paywall",
    "related": "related recommended share social sharing follow tags more trending popular",
    "form": "form search login signup contact",
    "main": "article content post entry story main body text articlebody prose page",
}
_CUE_OF: dict[str, list[str]] = {}
for _kind, _words in CUES.items():
    for _word in _words.split():
        _CUE_OF.setdefault(_word, []).append(_kind)
#: Words of a block's own text that tell what it is for (fixed values).
SAYS = {
    "rights": "copyright rights reserved ©",
    "comments": "comments comment reply replies responses",
    "notice": "cookie cookies consent subscribe newsletter",
    "links": "home about contact privacy terms sitemap login search menu imprint",
    "related": "related share tags popular recommended",
    "advert": "advertisement sponsored promoted",
}
_SAID = {word: kind for kind, words in SAYS.items() for word in words.split()}
_STRUCTURE = frozenset("nav header footer aside article main section form ul ol table figure button label details blockquote pre dialog menu address select".split())


def _cues(attributes: str) -> list[str]:
    found = []
    for match in _ATTRIBUTE.finditer(attributes):
        value = match[1] or match[2] or match[3] or ""
        for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            found += _CUE_OF.get(word, [])
    return found


class Node:
    """An open element. It knows its parent only, what its block ancestors are for, and which open element a start tag would close."""

    __slots__ = ("tag", "parent", "place", "block", "tags", "kinds", "own", "closable", "inside")

    def __init__(self, tag: str, attributes: str, parent: Node | None, place: int) -> None:
        self.tag, self.parent, self.place = tag, parent, place
        up = parent.block if parent else None
        if tag in _BLOCK:
            self.block, own = self, frozenset(_cues(attributes)) if attributes else frozenset()
            tags, kinds = (up.tags, up.kinds) if up else (frozenset(), frozenset())
            # few different sets: shared along the tree, whatever its depth
            self.tags = tags if tag in tags or tag not in _STRUCTURE else tags | {tag}
            self.kinds = kinds if own <= kinds else kinds | own
            self.own = (tag, own)
            self.inside: dict[str, int] = {}  # open inline elements whose nearest block this is
        else:
            self.block = up
        last = parent.closable if parent else (None,) * len(_GROUPS)
        if any(tag in shut or tag in until for shut, until in _GROUPS):
            last = tuple(self if tag in shut else None if tag in until else x for (shut, until), x in zip(_GROUPS, last, strict=True))
        self.closable = last


@dataclass
class Block:
    text: str
    node: Node | None
    links: int


def decoded(text: str) -> str:
    """Character references as characters, one space for white space; a reference beyond all code points is U+FFFD."""
    if "&" in text:
        text = html.unescape(_LONG_REFERENCE.sub("\ufffd", text))
    return " ".join(text.split())


class _TagEnds:
    """Where tags end, for pages on which a quote is never closed: one walk backwards over the marks that matter.

    From a mark outside quotes the tag goes on to its ``>``, or over a quoted value to the next mark; a quote that is never
    closed does not count. Every mark's end is known once, so all tags of a page take time that grows with the page.
    """

    def __init__(self, page: str) -> None:
        self.at: list[int] = []
        quote: list[str] = []
        for m in _TAG_EVENT.finditer(page):
            self.at.append(m.end() - 1)
            quote.append(m[1] or "")
        self.end = [-1] * (len(self.at) + 1)
        for i in range(len(self.at) - 1, -1, -1):
            if not quote[i]:
                self.end[i] = self.at[i]
            else:
                shut = page.find(quote[i], self.at[i] + 1)
                self.end[i] = self.end[i + 1 if shut < 0 else bisect_right(self.at, shut)]

    def after(self, place: int) -> int:
        """The ``>`` that ends a tag whose name ends at ``place``; -1 where none does."""
        return self.end[bisect_left(self.at, place)]


def leaf_blocks(page: str) -> list[Block]:
    """The page's text blocks in page order: character references decoded, white space made one space, none empty.

    Time and memory grow with the page's length only, whatever its markup is.
    """
    blocks: list[Block] = []
    root = Node("", "", None, 0)
    root.block, root.tags, root.kinds, root.own, root.inside = root, frozenset(), frozenset(), ("", frozenset()), {}
    stack = [root]
    open_blocks: dict[str, int] = {}
    parts: list[str] = []
    links, in_link = 0, 0
    ends: _TagEnds | None = None
    endless: set[str] = set()  # raw elements without an end tag from here on

    def flush() -> None:
        nonlocal links
        if parts:
            if text := decoded("".join(parts)):
                blocks.append(Block(text, stack[-1].block, links))
            parts.clear()
        links = 0

    def close(upto: int) -> None:
        nonlocal in_link
        for node in stack[upto:]:
            in_link -= node.tag == "a"
            counts = open_blocks if node.block is node else node.block.inside
            counts[node.tag] -= 1
        del stack[upto:]

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            parts.append(piece)
            if in_link:
                links += len(piece)

    at, last, last_cdata = 0, page.rfind(">"), page.rfind("]]>")
    while True:
        found = _OPENING.search(page, at)
        if not found or found.start() > last:
            add(page[at:])
            break
        start = found.start()
        if page[start + 1] in "!?":
            add(page[at:start])
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 2)
                at = stop + 3 if stop >= 0 else len(page)
            elif page.startswith("<![CDATA[", start) and start < last_cdata:
                at = page.find("]]>", start) + 3
            else:
                at = page.find(">", start) + 1
            continue
        add(page[at:start])
        match = _TAG.match(page, start) if ends is None else None
        if match is None:
            ends = ends or _TagEnds(page)
            name = _NAME.match(page, start)
            stop = ends.after(name.end())
            stop = page.find(">", start) if stop < 0 else stop
            at, closing, tag, attributes = stop + 1, name[1], name[2].lower(), page[name.end() : stop]
        else:
            at, closing, tag, attributes = match.end(), match[1], match[2].lower(), match[3]
        if not closing and tag in _RAW:
            # without an end, or ended at once, it holds nothing
            if not attributes.endswith("/") and tag not in endless:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                else:
                    endless.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            if tag in _BLOCK:
                if open_blocks.get(tag):
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    close(k)
            elif stack[-1].block.inside.get(tag):  # an inline end tag never closes a block
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in _BLOCK and (shut := stack[-1].closable[_GROUP_OF.get(tag, 0)]) is not None:
            close(shut.place)
        if tag not in _VOID and not attributes.endswith("/"):
            node = Node(tag, attributes, stack[-1], len(stack))
            stack.append(node)
            counts = open_blocks if node.block is node else node.block.inside
            counts[tag] = counts.get(tag, 0) + 1
            in_link += tag == "a"
    flush()
    return blocks


_paths: dict[tuple, list[str]] = {}


def _path_features(node: Node) -> list[str]:
    tags, kinds, own = node.tags, node.kinds, node.own
    known = _paths.get((tags, kinds, own))
    if known is None:
        if len(_paths) > 20_000:
            _paths.clear()
        known = [f"in:{t}" for t in sorted(tags)] + [f"cue:{c}" for c in sorted(kinds)] + [f"own:{own[0]}", *(f"owncue:{c}" for c in sorted(own[1]))]
        main = bool(tags & {"article", "main"}) or "main" in kinds
        bad = (tags & {"nav", "footer", "aside", "form", "button", "label", "dialog", "menu", "select"}) | (kinds - {"main", "head"})
        top = "header" in tags or "head" in kinds
        known += [f"main:{main}", f"bad:{bool(bad)}", f"top:{top}&main:{main}"]
        _paths[(tags, kinds, own)] = known
    return known


_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


def features(blocks: list[Block]) -> list[list[str]]:
    """Features of a page's blocks: path, text, and place before or after the title and a heading that announces comments."""
    titles = [i for i, b in enumerate(blocks) if b.node.own[0] == "h1"]
    first, out, announced = (titles[0] if titles else -1), [], False
    for i, block in enumerate(blocks):
        text = block.text
        words = text.count(" ") + 1
        share = block.links / max(1, len(text))
        stops = text.count(".") + text.count(",") + text.count("!") + text.count("?")
        size = "1" if words < 2 else "2" if words < 5 else "3" if words < 12 else "4" if words < 30 else "5"
        said = {_SAID[w] for w in _LETTERS.findall(text.lower()) if w in _SAID} if words < 30 else set()
        heading = block.node.own[0] in _HEADINGS
        if heading:
            announced = "comments" in said and words < 6 and i > first
        place = "none" if first < 0 else "before" if i < first else "at" if i == first else "after"
        end = len(blocks) - 1 - i
        row = [*_path_features(block.node), "bias", f"words:{size}", f"links:{'all' if share > 0.8 else 'some' if share > 0.2 else 'few'}", f"stops:{min(3, stops)}", f"ends:{text[-1] in '.!?:'}", f"mark:{text[0] in '©' or '©' in text}", f"mail:{'@' in text}"]
        row += [f"title:{place}", f"end:{min(end, 2)}", *(f"says:{w}" for w in sorted(said)), *(f"says:{w}&short" for w in sorted(said) if words < 6)]
        if announced:
            row.append("announced")
        out.append(row)
    return out


_LETTERS = re.compile(r"[^\W\d_]+|©")


def labelled_pages(n: int = 600, seed: int = 5) -> list[tuple[str, dict[str, int]]]:
    """Pages in many layouts, each with the label (1: main text) of every block's text.

    Content stands in a landmark, in an element with a telling class, in one with a meaningless class, in a table cell, or
    in no element of its own beside menus, headers and footers that are themselves marked or not.
    """
    rng = random.Random(seed)
    syllables = "ta re mi lo su ka ne vo di pa che un er or is ent ion al ba fe".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    run = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 4, b: int = 16) -> str:
        return run(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    pages = []
    for _ in range(n):
        labels: dict[str, int] = {}

        def mark(text: str, y: int, labels: dict[str, int] = labels) -> str:
            labels[" ".join(text.split())] = y
            return text

        def prose(y: int, a: int, b: int) -> str:
            return " ".join(sentence() for _ in range(rng.randint(a, b)))

        def link_list() -> str:
            inner = "".join(f'<li><a href="/{word()}">{mark(run(1, 3), 0)}</a></li>' for _ in range(rng.randint(2, 7)))
            return f"<ul>{inner}</ul>"

        def wrap(names: list[tuple[str, str]], inner: str) -> str:
            tag, attribute = rng.choice(names)
            return f"<{tag}{attribute}>{inner}</{tag}>"

        bare = rng.random() < 0.3  # chrome without landmarks or telling names
        hashed = lambda: f' class="{rng.choice(["css-", "x", "sc-", "_", ""])}{rng.randrange(16**6):x}{rng.choice(["", " b" + str(rng.randint(1, 99))])}"'

        def plain(inner: str) -> str:
            return wrap([("div", ""), ("div", hashed()), ("div", hashed()), ("p", "")] if not inner.startswith("<") else [("div", ""), ("div", hashed()), ("center", "")], inner)

        def rights() -> str:
            return rng.choice([f"Copyright {rng.randint(1999, 2030)} {run(1, 3)}", f"{run(1, 3)}. All rights reserved.", f"{rng.randint(1999, 2030)} {run(1, 2)} | Privacy | Terms"])

        def nav() -> str:
            if bare:
                return rng.choice([link_list(), plain(link_list()), plain(" | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(4)))])
            return wrap([("nav", ""), ("nav", ' class="navbar"'), ("div", ' class="menu"'), ("div", ' id="navigation"'), ("ul", ' class="breadcrumbs"'), ("div", ' role="navigation"')], link_list())

        def header() -> str:
            if bare:
                return plain(rng.choice([f'<a href="/">{mark(run(1, 3), 0)}</a>', mark(run(1, 4), 0)]))
            return wrap([("header", ""), ("div", ' class="masthead"'), ("div", ' id="header"'), ("header", ' class="site-header"'), ("div", ' class="topbar"'), ("div", ' class="branding"')], rng.choice(["<p>{}</p>", "{}"]).format(mark(run(1, 6), 0)) + (nav() if rng.random() < 0.5 else ""))

        def footer() -> str:
            if rng.random() < 0.15:
                return wrap([("address", ""), ("div", ' class="footer"'), ("footer", "")], rng.choice(["<address>{}</address>", "{}"]).format(mark(f"{run(1, 4)} {word()}@{word()}.org", 0)))
            if bare:
                return rng.choice(["<hr>", ""]) + plain(rng.choice(["&copy; ", ""]) + mark(rights(), 0))
            if rng.random() < 0.4:
                return wrap([("footer", ""), ("div", ' id="footer"'), ("footer", hashed())], rng.choice(["<p>{}</p>", "{}"]).format(mark(rights(), 0)))
            return wrap([("footer", ""), ("div", ' class="footer"'), ("div", ' id="site-footer"'), ("footer", ' class="colophon"')], rng.choice(["&copy; ", ""]) + mark(prose(0, 1, 2), 0) + (link_list() if rng.random() < 0.3 else ""))

        def side() -> str:
            return wrap([("aside", ""), ("div", ' class="sidebar"'), ("div", ' id="right-rail"'), ("aside", ' class="widget"')], f"<h3>{mark(run(1, 3), 0)}</h3>" + rng.choice([link_list, lambda: f"<p>{mark(prose(0, 1, 3), 0)}</p>"])())

        def advert() -> str:
            return wrap([("div", ' class="ad"'), ("div", ' class="ads banner"'), ("ins", ' class="adsbygoogle"'), ("div", ' id="advert-1"'), ("section", ' class="sponsored"'), ("aside", ' class="promo"')], mark(prose(0, 1, 3), 0))

        def notice() -> str:
            return wrap([("div", ' class="cookie-notice"'), ("div", ' id="gdpr-consent"'), ("div", ' class="newsletter popup"'), ("div", ' role="alert"'), ("dialog", "")], f"<p>{mark(rng.choice(['We use cookies. ', '']) + prose(0, 1, 2), 0)}</p><button>{mark(run(1, 2), 0)}</button>")

        def form() -> str:
            return f'<form action="/x"><label>{mark(run(1, 3), 0)}</label><input name="q"><button>{mark(run(1, 1), 0)}</button></form>'

        def comments() -> str:
            one = lambda: wrap([("div", ' class="comment"'), ("li", ' class="comment"'), ("article", ' class="comment"')], f"<p>{mark(prose(0, 1, 4), 0)}</p>")
            title = rng.choice([run(1, 3), "Comments", f"{rng.randint(2, 30)} comments", "Leave a reply", "Reader comments"])
            if bare:
                inner = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<p" + hashed() + ">{}</p>"]).format(mark(prose(0, 1, 4), 0)) for _ in range(rng.randint(1, 4)))
                return f"<h3>{mark(rng.choice(['Comments', 'Reader comments', f'{rng.randint(2, 30)} comments', 'Replies']), 0)}</h3>{inner}"
            return wrap([("section", ' id="comments"'), ("div", ' class="comments"'), ("div", ' class="reader-comments"'), ("ol", ' class="comment-list"')], f"<h2>{mark(title, 0)}</h2>" + "".join(one() for _ in range(rng.randint(1, 4))))

        def share() -> str:
            return wrap([("div", ' class="share"'), ("div", ' class="related-posts"'), ("ul", ' class="tags"'), ("section", ' class="recommended"')], link_list())

        def content() -> str:
            out = [f"<h1>{mark(run(1, 9), 1)}</h1>"] if rng.random() < 0.9 else []
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                if kind < 0.72:
                    text = mark(prose(1, 1, 5), 1)
                    out.append(rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>"]))
                elif kind < 0.8:
                    out.append(f"<h2>{mark(run(1, 6), 1)}</h2>")
                elif kind < 0.86:
                    out.append("<ul>" + "".join(f"<li>{mark(run(2, 9), 1)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
                elif kind < 0.9:
                    out.append(f"<blockquote>{mark(prose(1, 1, 2), 1)}</blockquote>")
                elif kind < 0.93:
                    out.append(f"<table><tr><td>{mark(run(1, 3), 1)}</td><td>{mark(run(1, 3), 1)}</td></tr></table>")
                else:
                    out.append(rng.choice([advert, share, side, notice])())
            inner = "".join(out)
            if rng.random() < 0.2:
                inner += rng.choice([comments, share, form])()
            where = rng.random()
            if where < 0.3:
                return inner  # in no element of its own
            if where < 0.5:
                return wrap([("div", hashed()), ("section", hashed()), ("div", ""), ("center", ""), ("td", "")], inner)
            return wrap([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post-body entry"'), ("section", ' class="story"')], inner)

        top = [f() for f in ((header, nav) if bare else (header, nav, notice, advert, form)) if rng.random() < 0.5]
        low = [f() for f in ((comments,) if bare else (comments, share, side, advert, form)) if rng.random() < 0.35]
        rng.shuffle(top)
        middle = content() + "".join(low)
        if rng.random() < 0.08:  # a page laid out by a table
            middle = f"<table{rng.choice(['', ' width=100%'])}><tr><td{rng.choice(['', hashed()])}>{nav()}</td><td>{middle}</td></tr></table>"
        elif middle.startswith("<td"):
            middle = f"<table><tr>{middle}</tr></table>"
        body = "".join(top) + middle + (footer() if rng.random() < 0.85 else "")
        if rng.random() < 0.3:  # a wrapper of the whole page says nothing
            body = wrap([("div", ' id="page"'), ("div", ' class="main-wrapper"'), ("div", ' id="main"'), ("div", ' class="page-body"')], body)
        labels = {html.unescape("© " + k) if f"&copy; {k}" in body else k: y for k, y in labels.items()}
        pages.append((f"<!DOCTYPE html><html><head><title>{run(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>", labels))
    return pages


@dataclass
class Extractor:
    chain: crf.Chain
    names: dict[str, int]

    def scores(self, blocks: list[Block]) -> np.ndarray:
        """Scores of one page's blocks."""
        out = np.zeros((len(blocks), 2))
        for i, row in enumerate(features(blocks)):
            known = [k for f in row if (k := self.names.get(f)) is not None]
            out[i] = self.chain.weights[known].sum(0)
        return out

    def main_text(self, pages: list[str | None]) -> list[list[str]]:
        """The main text blocks of every page."""
        cut = [leaf_blocks(p) if p else [] for p in pages]
        flat = [b for blocks in cut for b in blocks]
        lengths = np.array([len(b) for b in cut], dtype=np.int64)
        states = self.chain.viterbi(np.concatenate([self.scores(blocks) for blocks in cut]), lengths) if flat else np.zeros(0, int)
        at = np.concatenate(([0], np.cumsum(lengths)))
        return [[b.text for b, y in zip(blocks, states[at[i] : at[i + 1]], strict=True) if y] for i, blocks in enumerate(cut)]


def fit_extractor(pages: list[tuple[str, dict[str, int]]] | None = None) -> Extractor:
    """Train on (html, label of each block's text); on the built-in labelled pages by default."""
    names: dict[str, int] = {}
    rows, states, lengths = [], [], []
    for page, labels in pages if pages is not None else labelled_pages():
        every = leaf_blocks(page)
        blocks = [(b, row) for b, row in zip(every, features(every), strict=True) if b.text in labels]
        lengths.append(len(blocks))
        for b, row in blocks:
            rows.append([names.setdefault(f, len(names)) for f in row])
            states.append(labels[b.text])
    x = np.zeros((len(rows), len(names)))
    for i, known in enumerate(rows):
        x[i, known] = 1
    return Extractor(crf.fit(x, np.array(lengths), np.array(states), 2, penalty=0.5), names)


def _extracted(batches: Iterator[pa.RecordBatch], model: Extractor) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks: list[list[str]] = []
        for i in range(0, batch.num_rows, 64):
            blocks += model.main_text(batch.column(batch.num_columns - 1)[i : i + 64].to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(["\n".join(b) for b in blocks], pa.string()), pa.array([len(b) for b in blocks], pa.int32())], [*batch.schema.names[:-1], "text", "n_blocks"])


def extract_main_text(pages: DataFrame, model: Extractor, keep: list[str], source: str = "html") -> DataFrame:
    """The columns ``keep`` of ``pages`` with text (main text blocks joined by a line feed) and n_blocks.

    A null or empty page, and one without main text, gives an empty text; a page of broken markup gives what text it
    has, in time that grows with its length. Repeated rows are pages of their own. Other columns are ignored.
    """
    ready(pages.sparkSession)
    rows = pages.select(*keep, F.col(source).cast("string").alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _extracted(it, model), f"{fields}, text string, n_blocks int")
