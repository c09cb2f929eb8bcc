"""Main-text extraction with a linear-chain conditional random field over a page's leaf blocks.

A page is read into leaf blocks, the runs of text between tags that begin or end a block. A block's features are its own and its
ancestors' tags, the words of their class, id and role attributes, and simple measures of its text. A two-state chain (main, other)
scores them; Viterbi decoding picks the main blocks. The field is trained by gradient descent on its log-likelihood over labelled pages,
which a generator below writes: pages of many layouts with text of random syllables, in which each block's label is known. Training data are thus of a fixed
size, and nothing is learnt from the pages that are extracted.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IN_TAG = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>")
_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile(r"[\"'>]")
_RAW = re.compile(r"(script|style|textarea|title)(?=[\s/>])", re.IGNORECASE)
_HIDDEN = re.compile(r"(svg|template|noscript)(?=[\s/>])", re.IGNORECASE)
_HIDDEN_END = re.compile(r"</(svg|template|noscript)\s*>", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "textarea", "title")}
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of these ends when another of its group begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SECTIONS = frozenset("article main nav aside footer header form section".split())
PARAGRAPH_INSIDE = frozenset("button td th li dd dt caption".split())


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]
    linked: int  # characters inside links


class Markup:
    """Finds a page's markup from left to right in linear time, however broken it is.

    A tag ends at the first > outside quotes. Once a tag has been found without such an end, the places of quotes, > and white space are noted, and so are the
    quotes from which no end was reached: no stretch is searched again from every tag in it.
    """

    def __init__(self, html: str) -> None:
        self.html, self.last = html, html.rfind(">")
        self.final = {c: html.rfind(c) for c in "\"'"}
        self.special: list[int] | None = None
        self.stops: list[int] = []
        self.dead: set[int] = set()

    def _note(self) -> None:
        self.special = [m.start() for m in _SPECIAL.finditer(self.html)]
        self.stops = [m.start() for m in _NAME_END.finditer(self.html)]

    def tag_end(self, at: int) -> int:
        """The place after the > that ends a tag of which at is inside and outside quotes; -1 if there is none."""
        if self.special is None:
            if m := _IN_TAG.match(self.html, at):
                return m.end()
            self._note()
        path, k = [], bisect_left(self.special, at)
        while k < len(self.special) and (c := self.special[k]) not in self.dead:
            if self.html[c] == ">":
                return c + 1
            path.append(c)
            if c >= self.final[self.html[c]]:
                break
            k = bisect_left(self.special, self.html.find(self.html[c], c + 1) + 1)
        self.dead.update(path)
        return -1

    def name_end(self, at: int) -> int:
        if self.special is None:
            m = _NAME_END.search(self.html, at)
            return m.start() if m else len(self.html)
        k = bisect_left(self.stops, at)
        return self.stops[k] if k < len(self.stops) else len(self.html)

    def skipped(self, at: int) -> int:
        """Where a comment or an element of raw text that begins at the < at ends, the page's end if it is not closed; -1 if there is none here."""
        html = self.html
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            return len(html) if end < 0 else end + 3
        if at < self.last and (m := _RAW.match(html, at + 1)):
            end = _RAW_END[m[1].lower()].search(html, html.find(">", at) + 1)
            return end.end() if end else len(html)
        return -1

    def hidden(self, at: int) -> int:
        """The end of the svg, template or noscript tag that begins at the < at; -1 if there is none here."""
        if at > self.last or not (m := _HIDDEN.match(self.html, at + 1)):
            return -1
        end = self.tag_end(m.end())
        return end if end >= 0 else self.html.find(">", at) + 1

    def tag(self, at: int) -> tuple[int, int, int] | None:
        """Of the tag whose name begins at at: where its name, its inside and the tag end."""
        end = self.name_end(at)
        if (whole := self.tag_end(end)) >= 0:
            return end, whole - 1, whole
        if self.special is not None:  # a name that has swallowed the begin of a quoted value
            k = bisect_left(self.special, at)
            if k < len(self.special) and self.special[k] < end and (whole := self.tag_end(self.special[k])) >= 0:
                return self.special[k], whole - 1, whole
        return None

    def hidden_ends(self) -> dict[int, int]:
        """Where the svg, template and noscript elements that are closed begin and end. A self-closed or unclosed tag holds nothing."""
        ends: dict[int, int] = {}
        open_at: dict[str, list[int]] = {"svg": [], "template": [], "noscript": []}
        at = self.html.find("<")
        while 0 <= at:
            if (end := self.skipped(at)) >= 0:
                pass
            elif (end := self.hidden(at)) >= 0:
                if not self.html.endswith("/>", at, end):
                    open_at[_HIDDEN.match(self.html, at + 1)[1].lower()].append(at)
            elif m := _HIDDEN_END.match(self.html, at):
                end = m.end()
                if open_at[m[1].lower()]:
                    ends[open_at[m[1].lower()].pop()] = end
            else:
                end = at + 1
            at = self.html.find("<", end)
        return ends


def leaf_blocks(html: str | None) -> list[Block]:
    """The non-empty leaf blocks in page order. Malformed markup is read as far as it goes; nothing is cut."""
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    in_link, linked, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, tuple(x[1] for x in stack), linked))
            texts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        texts.append(text)
        if in_link:
            linked += len(text.strip())

    ends: dict[int, int] | None = None
    page, here = Markup(html), html.find("<")
    while 0 <= here:
        closing, name, inside, end = False, None, (0, 0), page.skipped(here)
        if end < 0 and here > page.last:  # no tag can end any more
            here = html.find("<!--", here + 1)
            continue
        if end < 0 and (end := page.hidden(here)) >= 0:
            ends = page.hidden_ends() if ends is None else ends
            end = ends.get(here, end)
        elif end < 0:
            closing = html.startswith("/", here + 1)
            first = here + 1 + closing
            if html.startswith(("!", "?"), here + 1):
                end = html.find(">", here) + 1
            elif html[first : first + 1].isascii() and html[first : first + 1].isalpha() and (found := page.tag(first)):
                name, inside, end = html[first : found[0]], found[:2], found[2]
            else:
                here = html.find("<", here + 1)
                continue
        if here > at:
            add(html[at:here])
        at, here = end, html.find("<", end)
        if name is None:
            continue
        tag = name.lower()
        if closing:
            if tag == "a":
                in_link = 0
            elif tag in BLOCK_TAGS:
                end_block()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
        elif tag == "a":
            in_link = 1
        elif tag == "br":
            texts.append(" ")
        elif tag in BLOCK_TAGS:
            end_block()
            in_link = 0
            _imply_ends(stack, tag)
            more = html[inside[0] : inside[1]]
            if tag not in VOID_TAGS and not more.endswith("/"):
                words = WORD.findall(" ".join(a or b or c for a, b, c in ATTRIBUTE.findall(more)).lower()) if "=" in more else ()
                stack.append((tag, (tag, *words)))
    if at < len(html):
        add(html[at:])
    end_block()
    return out


def _imply_ends(stack: list[tuple[str, tuple[str, ...]]], tag: str) -> None:
    closes = CLOSES.get(tag, ())
    for i in range(len(stack) - 1, -1, -1):
        open_tag = stack[i][0]
        if open_tag == "p" or open_tag in closes:
            del stack[i:]
            if open_tag == "p" and tag != "p" and closes:
                _imply_ends(stack, tag)
            return
        if open_tag not in PARAGRAPH_INSIDE or not closes:
            return


# Words of class and id attributes that pages commonly use, by what they hold.
_MAIN = ["content", "main", "post", "entry", "article body", "post content", "entry content", "story", "text", "page content", "main content", "body"]
_BOILERPLATE = {
    "nav": ["nav", "navigation", "menu", "main menu", "navbar", "breadcrumb", "breadcrumbs", "topbar", "pagination", "pager", "toc"],
    "header": ["header", "site header", "masthead", "branding", "page header", "logo", "top"],
    "footer": ["footer", "site footer", "copyright", "bottom", "colophon", "legal"],
    "aside": ["sidebar", "side", "aside", "widget", "related", "related posts", "recommended", "popular", "tags", "social", "share", "author bio", "trending", "more"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo", "promotion", "adbox", "commercial"],
    "notice": ["notice", "cookie", "cookies", "consent", "gdpr", "alert", "banner notice", "popup", "modal", "overlay", "paywall", "warning", "disclaimer", "message"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact"],
    "comments": ["comments", "comment", "comment list", "reader comments", "discussion", "replies", "reply", "responses", "disqus", "respond"],
}
_COMMON = {"list", "site", "page", "top", "bottom", "main", "author", "posts", "reader", "more", "message", "bio", "side"}
#: Words that tell by themselves what an element holds.
CLUTTER = {w: kind for kind, names in _BOILERPLATE.items() for name in names for w in name.split()}
CLUTTER = {w: kind for w, kind in CLUTTER.items() if w not in _COMMON and w not in " ".join(_MAIN).split()}


# ------------------------------------------------------------------------------------------------------ features
@lru_cache(maxsize=50_000)
def _path_features(path: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    found = {f"in:{p[0]}" for p in path} | {f"word:{w}" for p in path for w in p[1:]}
    kinds = {CLUTTER[w] for p in path for w in p[1:] if w in CLUTTER}
    found |= {f"kind:{k}" for k in kinds} | ({"clutter"} if kinds else set())
    if path:
        section = next((p[0] for p in reversed(path) if p[0] in SECTIONS), "none")
        found |= {f"section:{section}", f"own:{path[-1][0]}"} | {f"own-word:{w}" for w in path[-1][1:]}
    return tuple(sorted(found))


@lru_cache(maxsize=4096)
def _measure(length: int, share: int, stop: bool) -> tuple[str, ...]:
    size = 0 if length < 12 else 1 if length < 30 else 2 if length < 80 else 3 if length < 200 else 4
    return (f"size:{size}", f"links:{share}", f"stop:{stop}", f"size-stop:{size}{stop}")


def features(block: Block) -> tuple[tuple[str, ...], ...]:
    text = block.text
    share = min(3, 3 * block.linked // max(len(text), 1))
    edge = ("bias", "copyright") if "©" in text else ("bias",)
    return _path_features(block.path), _measure(min(len(text), 200), share, text[-1] in ".!?…:;\"”»"), edge


@dataclass
class Field:
    """weights: score of main above other by feature; move[i][j]: of state j after i."""

    weights: dict[str, float]
    move: list[list[float]]

    def __post_init__(self) -> None:
        self._sums: dict[tuple[str, ...], float] = {}

    def _sum(self, group: tuple[str, ...]) -> float:
        if group not in self._sums:
            if len(self._sums) > 100_000:
                self._sums.clear()
            self._sums[group] = sum(self.weights.get(f, 0.0) for f in group)
        return self._sums[group]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels, by Viterbi."""
        n = len(blocks)
        if not n:
            return []
        (m00, m01), (m10, m11) = self.move
        other = main = 0.0
        back = []
        for i, block in enumerate(blocks):
            s = sum(map(self._sum, features(block)))
            if i:
                a = (other + m00, 0) if other + m00 >= main + m10 else (main + m10, 1)
                b = (main + m11, 1) if main + m11 >= other + m01 else (other + m01, 0)
                back.append((a[1], b[1]))
                other, main = a[0], b[0] + s
            else:
                main = s
        state = int(main > other)
        labels = [state]
        for step in reversed(back):
            state = step[state]
            labels.append(state)
        return [bool(x) for x in reversed(labels)]

    def extract(self, html: str | None) -> list[str]:
        blocks = leaf_blocks(html)
        return [b.text for b, main in zip(blocks, self.decode(blocks), strict=True) if main]


# ------------------------------------------------------------------------------------------------------ training
def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 160, rate: float = 0.4, ridge: float = 2e-4) -> Field:
    """Maximises the penalised log-likelihood; forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    rows = [[[index.setdefault(f, len(index)) for g in features(b) for f in g] for b in bs] for bs, _ in pages]
    n, steps = len(pages), max(len(r) for r in rows)
    y, mask = np.zeros((n, steps), int), np.zeros((n, steps), bool)
    for p, (row, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        y[p, : len(row)], mask[p, : len(row)] = labels, True
    flat = [found for row in rows for found in row]
    x = np.zeros((len(flat), len(index)), np.float32)  # the blocks of all pages, in the order of mask
    for i, found in enumerate(flat):
        x[i, found] = 1
    w, move = np.zeros(len(index)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    both = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    for k in range(1, rounds + 1):
        unary = np.zeros((n, steps, 2))
        unary[mask, 1] = x @ w.astype(np.float32)
        ahead, behind = np.zeros_like(unary), np.zeros_like(unary)
        ahead[:, 0] = unary[:, 0]
        for t in range(1, steps):
            new = lse(ahead[:, t - 1, :, None] + move, 1) + unary[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = lse(move + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], new, behind[:, t + 1])
        z = lse(ahead[:, -1], 1)
        p = np.exp(ahead + behind - z[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + move + (unary[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None])
        g = (y - p[:, :, 1])[mask].astype(np.float32) @ x / n - ridge * w
        gm = (seen - (pair * both[:, :, None, None]).sum(axis=(0, 1))) / n - 0.05 * move
        for v, grad, m, q in ((w, g, state[0], state[1]), (move, gm, state[2], state[3])):
            m += 0.1 * (grad - m)
            q += 0.01 * (grad * grad - q)
            v += rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(q / (1 - 0.99**k)) + 1e-8)
    return Field({f: float(w[i]) for f, i in index.items()}, move.tolist())


_SYLLABLES = "ba de ki lo mu na per ri so tan ve wo xi yo zu chan gre ple sti tro".split()

def labelled_pages(count: int = 700, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Generated pages of many layouts as (blocks, labels)."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    chance = lambda p: rng.random() < p
    # main text carries this mark, which labels its block and is then taken out
    mark = ""

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(low, high))))

    def sentence(low: int = 4, high: int = 40) -> str:
        return words(low, high).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def name(words_of: list[str]) -> str:
        value = pick(words_of).replace(" ", pick(["-", "_", " "]))
        return f' {pick(["class", "class", "id"])}="{value}{pick(["", "", "-1", " wide", " x"])}"'

    def links(tag: str) -> str:
        items = "".join(f'<li><a href="/{words(1, 2)}">{words(1, 4)}</a>{pick(["", "</li>"])}' for _ in range(int(rng.integers(2, 8))))
        return f"<{tag}>{items}</{tag}>" if chance(0.7) else " ".join(f'<a href="#">{words(1, 3)}</a>' for _ in range(int(rng.integers(1, 5))))

    def boilerplate(kind: str) -> str:
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "div", "section", "p", "aside"])
        tag = pick(tag)
        plain = tag in ("nav", "header", "footer", "aside", "form") and chance(0.6)
        attr = "" if plain else name(_BOILERPLATE[kind])
        paragraphs = "".join(f"<p>{sentence()}</p>" for _ in range(int(rng.integers(1, 4))))
        if kind == "nav":
            inner = links(pick(["ul", "ol"]))
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name=q>{pick(['', f'<p>{sentence()}</p>'])}<select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 3)}</button>"
            tag, attr = ("form", attr) if chance(0.7) else (tag, attr)
        elif kind == "comments":
            each = pick(["div", "li", "article", "p"])
            inner = f"<h3>{words(1, 4)}</h3>" * chance(0.5) + "".join(f'<{each}{pick(["", name(_BOILERPLATE["comments"])])}>{pick([sentence(), f"<p>{sentence()}</p><p>{sentence()}</p>"])}</{each}>' for _ in range(int(rng.integers(1, 6))))
        elif kind == "footer":
            inner = pick([f"&copy; {words(1, 3)} &middot; {sentence()}", paragraphs, links("ul"), f"<p>&copy; {words(2, 6)}</p>"])
        elif kind == "header":
            inner = pick([f"<h1>{words(1, 4)}</h1><p>{sentence(2, 8)}</p>", f'<a href="/">{words(1, 3)}</a>', f"<div>{words(1, 4)}</div>" + links("ul"), sentence(3, 12)])
        else:
            inner = pick([sentence(), paragraphs, f"<h3>{words(1, 3)}</h3>{paragraphs}", f"<h4>{words(1, 3)}</h4>" + links("ul")])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def article() -> str:
        out = [f"<h1>{mark}{words(2, 10)}</h1>"] if chance(0.85) else []
        for _ in range(int(rng.integers(1, 9))):
            body = mark + (words(1, 5) + pick(["", ".", "***", " |"]) if chance(0.3) else sentence(3, 90))
            out.append(pick([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br><p>{mark}{sentence()}", f"<p>{body} <a href='#'>{words(1, 4)}</a> {words(1, 9)}.</p>", f"<h2>{mark}{words(1, 7)}</h2>", f"<ul><li>{mark}{words(1, 20)}</li><li>{mark}{sentence()}</li></ul>", f"<ol><li>{mark}{sentence()}<li>{mark}{words(2, 9)}</ol>", f"<blockquote>{pick([f'<p>{body}</p>', body])}</blockquote>", f"<table><tr><th>{mark}{words(1, 3)}<td>{mark}{words(1, 9)}</table>", f"<pre>{body}</pre>", f"<div>{body}</div>", f"<figure><img src=x><figcaption>{body}</figcaption></figure>"]))
            if chance(0.35):
                out.append(boilerplate(pick(["ad", "aside", "notice", "form", "nav"])))
        if chance(0.15):
            out.append(boilerplate("comments"))
        return "".join(out)

    pages = []
    for _ in range(count):
        kinds = lambda names, p: [boilerplate(k) for k in names if chance(p)]
        before = kinds(["notice", "header", "nav", "nav", "ad", "form", "aside"], 0.45)
        after = kinds(["comments", "aside", "ad", "nav", "form", "notice"], 0.4) + kinds(["footer"], 0.85)
        order = rng.permutation(len(before))
        shape = pick(["article", "article", "article", "main", "named", "named", "main-article", "div-article", "div-article", "plain", "plain"])
        body = article()
        if shape == "article":
            body = f"<article{pick(['', name(_MAIN)])}>{body}</article>"
        elif shape == "main":
            body = f"<main{pick(['', name(_MAIN)])}>{body}{''.join(kinds(['comments', 'aside'], 0.2))}</main>"
        elif shape == "named":
            body = f"<{(t := pick(['div', 'section']))}{name(_MAIN)}>{body}</{t}>"
        elif shape == "main-article":
            body = f"<main>{''.join(kinds(['nav', 'ad'], 0.2))}<article>{body}</article>{''.join(kinds(['comments', 'aside'], 0.3))}</main>"
        elif shape == "div-article":
            body = f"<div{name(['container', 'wrapper', 'page', 'layout', 'row'])}><article>{body}</article>{''.join(kinds(['aside', 'comments'], 0.4))}</div>"
        blocks = leaf_blocks(f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before[i] for i in order)}{body}{''.join(after)}{pick(['</body></html>', ''])}")
        labels = [int(mark in b.text) for b in blocks]
        pages.append(([Block(t, b.path, b.linked) for b in blocks if (t := b.text.replace(mark, "").strip())], [x for x, b in zip(labels, blocks, strict=True) if b.text.replace(mark, "").strip()]))
    return pages


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract_pages(pages: DataFrame, field: Field | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main blocks in page order joined by line feeds, and the code points of that.

    Character references are decoded and white space inside a block is one space. Null and empty pages and pages without a main
    block have an empty text. Pages are read one by one: repeated rows and null ids stay, an empty table gives an empty result.
    """
    field = field or default_field()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(field.extract(x.as_py())) for x in batch.column(2)]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")
