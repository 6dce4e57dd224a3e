"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read once, in time linear in its length, by a tolerant scanner: quotes and elements may stay
open. Every stretch of text between block-level tags is a leaf block with its open ancestors (tag, class,
id, role). By rule, not by the field, the text of form controls, of scripts and the like, and of elements that are
hidden takes no part. Features of a block come from its ancestors, its own tag, its text and links, and
its place; a two-label chain (0 boilerplate, 1 main text) with label transitions decides over the
whole page by Viterbi. The weights are learned by the gradient of the conditional log-likelihood on labelled
pages: ``labelled_pages`` makes them from page templates that state each block's label. They lie in
``html_field.json`` beside this file; ``python -m lodex.llm.html`` learns and writes them anew.

Defined results: null html counts as empty; a page without main text gives an empty string; text
in unclosed elements belongs to the innermost open one, a new paragraph closes an open one; an attribute
value whose quote is never closed, or closed in the middle of later markup, ends at the tag's end; repeated
rows come out as often as they come in; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import os
import re
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

# Tag names of the HTML standard by their role in reading a page.
SKIPPED = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title", "textarea", "audio", "video", "noframes", "noembed")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "input")
CONTROLS = ("button", "select", "option", "optgroup", "datalist", "label", "legend", "output", "meter", "progress")
CLOSES_P = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
P_SCOPE = ("table", "td", "th", "caption", "object")
#: Elements that a new one of their kind closes, by the elements that may stand between.
ITEMS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}
# Words of short headings and lines that say what part of a page follows, by part.
CUES = {
    "comments": ("comment", "comments", "kommentar", "kommentare", "commentaire", "commentaires", "comentario", "comentarios", "reply", "replies", "antworten", "responses", "discussion"),
    "legal": ("impressum", "datenschutz", "privacy", "imprint", "terms", "copyright", "agb", "contact", "kontakt", "mentions", "légales", "aviso", "privacidad", "confidentialité"),
    "related": ("related", "recommended", "trending", "popular", "more", "mehr", "verwandte", "articles", "relacionados", "similaires", "latest", "newest"),
    "share": ("share", "teilen", "partager", "compartir", "tweet", "print", "facebook", "twitter", "tags"),
    "notice": ("cookie", "cookies", "consent", "accept", "akzeptieren", "accepter", "aceptar"),
    "ad": ("advertisement", "anzeige", "werbung", "publicité", "publicidad", "sponsored", "gesponsert"),
    "form": ("subscribe", "newsletter", "login", "register", "search", "suche", "abonnieren", "buscar"),
    "menu": ("home", "menu", "startseite", "accueil", "inicio", "sitemap", "about"),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}

NAMED = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=]++)(?:\s*+=\s*+)?")
BARE = re.compile(r"[^\s>]*+")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TELLING = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
SKIP_SET, VOID_SET, INLINE_SET, CLOSES_P_SET, CONTROL_SET = frozenset(SKIPPED), frozenset(VOID), frozenset(INLINE + CONTROLS), frozenset(CLOSES_P), frozenset(CONTROLS)


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    path: frozenset[str]  # features of all ancestors
    linked: int  # characters inside links


def open_tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The telling attributes of a tag whose name ends at ``at``, whether it closes itself, and where
    it ends."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return found, end > 0 and page[end - 1] == "/", n if end < 0 else end + 1
        at, value = m.end(), ""
        if page[at - 1 : at] == "=" or page[m.end(1) : at].strip() == "=":
            quote = page[at : at + 1]
            close = page.find(quote, at + 1) if quote in ('"', "'") and quote else -1
            if close >= 0 and (close + 1 == n or page[close + 1] in " \t\n\r\f/>"):
                value, at = page[at + 1 : close], close + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0].strip("\"'"), bare.end()
        name = m[1].lower()
        if name in TELLING:
            found.setdefault(name, value)


@lru_cache(maxsize=4096)
def features_of(tag: str, names: str) -> tuple[str, ...]:
    """An element's features: its tag and the words of its class, id and role."""
    return tuple(dict.fromkeys([f"t:{tag}", *(f"n:{w}" for w in NAME.findall(names.lower()))]))


def unseen(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or UNSEEN.search(attributes.get("style", "")) is not None


class Tree:
    """The open elements. All steps but closing take constant time, and an element closes once."""

    def __init__(self, known):
        self.known = known
        self.tags: list[str] = []
        self.paths: list[frozenset[str]] = [frozenset()]
        self.owners: list[str] = [""]  # the innermost element that isn't inline
        self.dropped: list[bool] = [False]
        self.links: list[int] = [0]
        self.blocks: list[int] = [-1]  # place of the innermost element that isn't inline
        self.where: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        inline = tag in INLINE_SET
        path = self.paths[-1]
        names = " ".join(attributes[k] for k in ("class", "id", "role") if k in attributes)
        if not inline or names:
            own = features_of(tag, names) if len(names) < 200 else features_of.__wrapped__(tag, names)
            new = [w for w in own if w not in path and (self.known is None or w in self.known)]
            path = path.union(new) if new else path
        self.where.setdefault(tag, []).append(len(self.tags))
        self.blocks.append(self.blocks[-1] if inline else len(self.tags))
        self.tags.append(tag)
        self.paths.append(path)
        self.owners.append(self.owners[-1] if inline else tag)
        self.dropped.append(self.dropped[-1] or tag in CONTROL_SET or tag not in ("html", "body") and unseen(attributes))
        self.links.append(self.links[-1] + (tag == "a"))

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.tags) > place:
            self.where[self.tags.pop()].pop()
            for column in (self.paths, self.owners, self.dropped, self.links, self.blocks):
                column.pop()


@cache
def end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def blocks(page: str | None, known=None) -> list[Block]:
    """Leaf blocks in page order. ``known``: the ancestors' features that matter, all if None."""
    page = page or ""
    out: list[Block] = []
    tree = Tree(known)
    parts: list[str] = []
    linked, at, n = 0, 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw).strip()
            if text:
                out.append(Block(text, tree.owners[-1], tree.paths[-1], linked))
            parts, linked = [], 0

    def say(text):
        nonlocal linked
        if not tree.dropped[-1]:
            parts.append(text)
            if tree.links[-1]:
                linked += len(text)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        follows = page[start + 1 : start + 2]
        closing = follows == "/"
        m = NAMED.match(page, start + 1 + closing)
        if not m:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                at = n if end < 0 else end + 3
            elif follows in ("!", "?", "/") and follows:
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at = start + 1
            continue
        tag, at = m[0].lower(), m.end()
        inline = tag in INLINE_SET
        if closing:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            place = tree.last(tag)
            if inline:
                if place > tree.blocks[-1]:
                    tree.cut(place)
            else:
                flush()
                if place >= 0:
                    tree.cut(place)
                elif tag == "br":
                    say(" ")
            continue
        attributes, closed, at = ({}, False, at + 1) if page[at : at + 1] == ">" else open_tag(page, at)
        if tag in SKIP_SET:
            if not closed:
                end = end_of(tag).search(page, at)
                at = end.end() if end else n
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag in VOID_SET:
            if inline:
                say(" ")
            else:
                flush()
            continue
        if not inline:
            flush()
            if tag in CLOSES_P_SET:
                for inner in (("p",), CONTROLS):
                    place = tree.last(*inner)
                    if place > tree.last(*P_SCOPE):
                        tree.cut(place)
            elif tag in ITEMS:
                own, scope = ITEMS[tag]
                first = min((tree.where[t][-1] for t in own if tree.where.get(t) and tree.where[t][-1] > tree.last(*scope, "div", "section", "article", "body")), default=-1)
                if tag == "tr":
                    first = tree.last("tr") if tree.last("tr") > tree.last("table", "body") else first
                if first >= 0:
                    tree.cut(first)
        if not closed or tag in CONTROL_SET or not inline:
            tree.push(tag, attributes)
    flush()
    return out


MARKS = (".", "!", "?", ":", "…", '"', "”", "»")


def block_features(page: list[Block]) -> list[list[str]]:
    """Feature words of each block but for those of its ancestors."""
    out, n, after_h1, since = [], len(page), False, set()
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        f = {"bias", f"own:{b.tag}"}
        share = b.linked / max(1, len(b.text))
        f.add("link:all" if share > 0.8 else "link:some" if share > 0.3 else "link:none")
        f.add("len:1" if words < 3 else "len:2" if words < 8 else "len:3" if words < 25 else "len:4")
        f.add("end:mark" if b.text[-1] in MARKS else "end:none")
        if "©" in b.text or "copyright" in b.text.lower():
            f.add("copyright")
        if words < 8:
            for w in LETTERS.findall(b.text.lower()):
                if w in CUE_OF:
                    f.add(f"cue:{CUE_OF[w]}")
                    if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                        f.add(f"head:{CUE_OF[w]}")
                        since.add(f"since:{CUE_OF[w]}")
        f |= since & {"since:comments", "since:related"}
        after_h1 = after_h1 or b.tag == "h1"
        f.add("after:h1" if after_h1 else "before:h1")
        if k == 0:
            f.add("first")
        if k == n - 1:
            f.add("last")
        out.append(sorted(f))
    return out


@dataclass
class Field:
    """weights: feature -> (score of label 0, score of label 1); moves[a][b]: from label a to b."""

    weights: dict[str, tuple[float, float]]
    moves: list[list[float]]

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        get, none, of_path = self.weights.get, (0.0, 0.0), {}
        out = []
        for b, f in zip(page, block_features(page)):
            if b.path not in of_path:
                own = [get(w, none) for w in b.path]
                of_path[b.path] = (sum(x for x, _ in own), sum(y for _, y in own))
            x, y = of_path[b.path]
            for w in f:
                p, q = get(w, none)
                x += p
                y += q
            out.append((x, y))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi labels."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves
        scored = self.scores(page)
        a, b = scored[0]
        back = []
        for s0, s1 in scored[1:]:
            from0, from1 = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + m00 if from0 else b + m10) + s0, (a + m01 if from1 else b + m11) + s1
        label = [1 if b > a else 0]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, field.weights)
    return "\n".join(b.text for b, y in zip(found, field.decode(found)) if y)


def labelled_pages(n: int = 600, seed: int = 11) -> list[list[tuple[Block, int]]]:
    """Training pages from templates; the marks M and B in the text give each block's label."""
    rng = np.random.default_rng(seed)
    syllables = ["ta", "ren", "mo", "lis", "ka", "dor", "ve", "shu", "pin", "gra", "el", "oth", "an", "er"]
    # Names that page authors give to parts of a page.
    side = {
        "nav": ["nav", "navbar", "menu", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc", "skip-link"],
        "header": ["header", "site-header", "masthead", "banner", "topbar", "branding"],
        "footer": ["footer", "site-footer", "bottom", "legal", "copyright", "colophon"],
        "aside": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "rail", "more-stories"],
        "notice": ["cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "paywall", "subscribe-box"],
        "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "banner-ad", "ad-slot"],
        "form": ["newsletter", "signup", "search", "search-form", "login", "subscribe", "contact-form"],
        "comments": ["comments", "comment", "comment-list", "comment-body", "disqus", "responses", "replies", "discussion", "reader-comments"],
        "share": ["share", "social", "social-links", "share-buttons", "tags", "meta", "byline", "author-box"],
    }
    mains = ["content", "main", "main-content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "body-text", "text", "page-content"]
    tags = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "ad": ["div", "aside", "section", "ins"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}

    def word():
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    def phrase(label, low, high):
        return label + " " + " ".join(word() for _ in range(rng.integers(low, high)))

    def sentence(label):
        if rng.random() < 0.06:
            return phrase(label, 1, 4) + "."
        return ". ".join(phrase(label if i == 0 else "", 4, 20).strip().capitalize() if i else phrase(label, 4, 20) for i in range(rng.integers(1, 5))) + rng.choice([".", ".", ".", "", "!"])

    def para(label):
        style = rng.random()
        body = sentence(label)
        if style < 0.08:
            return f"<p><b>{body}<br>"
        if style < 0.2:
            return f"<p>{body}"
        if style < 0.3:
            return f"<p>{body} <a href='/x'>{word()}</a> {word()}.</p>"
        if style < 0.36:
            return f"<blockquote><p>{body}</p></blockquote>"
        return f"<p>{body}</p>"

    def listing(label, link):
        items = "".join(f"<li>{'<a href=/q>' if link else ''}{phrase(label, 1, 4 if link else 12)}{'</a>' if link else ''}</li>" for _ in range(rng.integers(2, 8)))
        return f"<ul>{items}</ul>"

    def table(label):
        return "<table>" + "".join("<tr>" + "".join(f"<td>{phrase(label, 1, 4)}</td>" for _ in range(2)) + "</tr>" for _ in range(rng.integers(1, 4))) + "</table>"

    def part(kind):
        tag = rng.choice(tags[kind])
        named = rng.random() < (0.35 if tag == kind or tag in ("nav", "header", "footer", "aside", "form") else 0.85)
        attr = f' {rng.choice(["class", "class", "id"])}="{rng.choice(side[kind])}"' if named else ""
        inner = ""
        if not named and tag in ("div", "section", "ul", "ol", "ins"):  # nothing but the text tells what it is
            cue = lambda k: f"B {rng.choice(CUES[k]).capitalize()}"
            line = f"<h3>{cue('comments')}</h3>" + "".join(f"<div><p>{sentence('B')}</p></div>" for _ in range(rng.integers(1, 4))) if kind == "comments" else f"<h3>{cue('related')} {word()}</h3>{listing('B', True)}" if kind == "aside" else f"{cue('ad')}" if kind == "ad" else f"<p>{cue('notice')} {word()}</p>" if kind == "notice" else f"<p>{cue('form')} {word()}</p>" if kind == "form" else listing("B", True)
            line = f"<p>{cue('legal')} {rng.choice(CUES['legal'])}</p>" if kind == "footer" and rng.random() < 0.6 else line
            return f"<{tag}>{f'<li>{line}</li>' if tag in ('ul', 'ol') else line}</{tag}>"
        if rng.random() < 0.3:  # any content: what holds it must be telling enough
            inner = rng.choice(["phrase", "sentence", "para", "list", "links"])
            inner = {"phrase": lambda: phrase("B", 1, 6), "sentence": lambda: sentence("B"), "para": lambda: para("B"), "list": lambda: listing("B", False), "links": lambda: listing("B", True)}[inner]()
            inner = inner[4:-5] if tag in ("ul", "ol") and inner.startswith("<ul>") else f"<li>{inner}</li>" if tag in ("ul", "ol") else inner
        elif kind in ("nav", "share") or kind in ("aside", "footer") and rng.random() < 0.5:
            inner = listing("B", True)
            inner = inner[4:-5] if tag in ("ul", "ol") else inner
            if kind == "aside" and rng.random() < 0.6:
                inner = f"<h3>{phrase('B', 1, 3)}</h3>" + inner
        elif kind == "form":
            inner = f"<label>{phrase('B', 1, 3)}</label><input><button>{phrase('B', 1, 2)}</button>" + (f"<p>{sentence('B')}</p>" if rng.random() < 0.6 else "")
        elif kind == "comments":
            inner = f"<h3>{phrase('B', 1, 3)}</h3>" + "".join(f"<{'li' if tag == 'ol' else 'div'} class=comment><p>{sentence('B')}</p></{'li' if tag == 'ol' else 'div'}>" for _ in range(rng.integers(1, 5)))
        elif kind == "header":
            inner = (f"<h1>{phrase('B', 1, 3)}</h1>" if rng.random() < 0.35 else f"<div class=logo><a href=/>{phrase('B', 1, 3)}</a></div>") + (f"<p>{phrase('B', 2, 7)}</p>" if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = f"<p>{phrase('B', 1, 3)} &copy; {sentence('')}</p>" if rng.random() < 0.5 else f"{phrase('B', 1, 3)} &copy; &middot; {sentence('')}"
        else:
            inner = f"{sentence('B')}" if rng.random() < 0.5 else "".join(para("B") for _ in range(rng.integers(1, 4)))
            if rng.random() < 0.3:
                inner = f"<h4>{phrase('B', 1, 4)}</h4>" + inner
        return f"<{tag}{attr}>{inner}</{tag}>"

    def article():
        tag = rng.choice(["article", "article", "main", "div", "section", "none"])
        attr = "" if tag in ("article", "main") and rng.random() < 0.6 else f' {rng.choice(["class", "id"])}="{rng.choice(mains)}"'
        body = f"<h1>{phrase('M', 2, 9)}</h1>" if rng.random() < 0.7 else ""
        body = f"<header>{body}</header>" if body and tag != "none" and rng.random() < 0.12 else body
        for _ in range(rng.integers(1, 9)):
            r = rng.random()
            body += para("M") if r < 0.66 else f"<h2>{phrase('M', 1, 6)}</h2>{para('M')}" if r < 0.76 else listing("M", False) if r < 0.82 else table("M") if r < 0.85 else f"<pre>{phrase('M', 2, 9)}</pre>" if r < 0.87 else part(rng.choice(["ad", "aside", "share", "form", "notice"]))
        if tag == "none":
            return body
        inside = f"<{tag}{attr}>{body}</{tag}>"
        return f"<main>{inside}</main>" if tag == "article" and rng.random() < 0.3 else inside

    pages = []
    for _ in range(n):
        often = rng.choice([0.0, 0.3, 0.6])
        before = [part(k) for k in ("notice", "header", "nav", "nav", "ad", "form", "aside") if rng.random() < often]
        after = [part(k) for k in ("share", "aside", "form", "ad", "notice", "comments", "aside", "footer") if rng.random() < often]
        page = "<html><head><title>x</title></head><body>" + "".join(before) + article() + "".join(after) + ("</body></html>" if rng.random() < 0.9 else "")
        found = []
        for b in blocks(page):
            label = 0 if b.text.startswith("B") else 1
            b.text = b.text[2:] or b.text
            found.append((b, label))
        pages.append(found)
    return pages


def fit(pages: list[list[tuple[Block, int]]], epochs: int = 20, rate: float = 0.3, l2: float = 2e-3) -> Field:
    """Conditional maximum likelihood: forward-backward for expectations, AdaGrad by page."""
    data = [([sorted({*f, *b.path}) for f, (b, _) in zip(block_features([b for b, _ in p]), p)], np.array([y for _, y in p])) for p in pages if p]
    names = sorted({w for f, _ in data for x in f for w in x})
    number = {w: i for i, w in enumerate(names)}
    rows = [([np.array([number[w] for w in x]) for x in f], y) for f, y in data]
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gm = np.full(w.shape, 1e-6), np.full(moves.shape, 1e-6)
    for _ in range(epochs):
        for f, y in rows:
            s = np.array([w[x].sum(axis=0) for x in f])
            n = len(s)
            fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0]
            for i in range(1, n):
                fwd[i] = s[i] + np.logaddexp(fwd[i - 1][0] + moves[0], fwd[i - 1][1] + moves[1])
            for i in range(n - 2, -1, -1):
                x = moves + s[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(x[:, 0], x[:, 1])
            z = np.logaddexp(*fwd[-1])
            p = np.exp(fwd + bwd - z)
            p[np.arange(n), y] -= 1
            dm = np.zeros((2, 2))
            if n > 1:
                dm = np.exp(fwd[:-1, :, None] + moves + (s + bwd)[1:, None, :] - z).sum(axis=0)
                np.add.at(dm, (y[:-1], y[1:]), -1)
            flat = np.concatenate(f)
            used, back = np.unique(flat, return_inverse=True)
            dw = np.zeros((len(used), 2))
            np.add.at(dw, back, np.repeat(p, [len(x) for x in f], axis=0))
            dw += l2 * w[used]
            gw[used] += dw**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            gm += dm**2
            moves -= rate * dm / np.sqrt(gm)
    return Field({k: (float(a), float(b)) for k, (a, b) in zip(names, w)}, moves.tolist())


WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_field.json")


@cache
def default_field() -> Field:
    with open(WEIGHTS, encoding="utf-8") as f:
        kept = json.load(f)
    return Field({k: tuple(w) for k, w in kept["weights"].items()}, kept["moves"])


def write_default_field(path: str = WEIGHTS) -> None:
    field = fit(labelled_pages())
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"weights": {k: [round(x, 6) for x in w] for k, w in field.weights.items()}, "moves": [[round(x, 6) for x in row] for row in field.moves]}, f, ensure_ascii=False, indent=0)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    known = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches):
        for batch in pieces_of(batches):
            texts = [main_text(h, known.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    write_default_field()
