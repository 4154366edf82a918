"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, each with the path of
open tags (with their class, id and role words). Tag paths and words are hashed to vectors; a
bidirectional LSTM in numpy reads the whole sequence and labels every block as article or not, with the
context of the whole document on both sides.

The network is trained on pages that this module writes itself from a seed: articles between menus,
headers, sidebars, notices, adverts, forms, footers and comments, in many markups. It is trained once,
on the driver, with fixed bounds, and its weights are broadcast; pages are labelled map-side.

Null, empty and blank pages have an empty text. Broken and cut-off markup is read as far as it goes: an
open comment, script or tag runs to the end; a head without an end tag ends where something stands that can't
be in a head. Long pages are read in chunks of `CHUNK` blocks, from the front and from the back, and each chunk
goes on with the state in which the last one ended, so that every label has the whole page as its context and
memory stays bounded. Repeated rows are read alike; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import batches

#: Elements that end a block, elements whose content is no text, and elements without an end tag.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
SILENT = frozenset("head iframe noscript object script style svg template title".split())
RAW = frozenset("iframe noscript script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an open one of the same kind ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS_P = BLOCK_TAGS - {"br", "button", "html", "body", "option", "optgroup", "select", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "textarea", "summary"}
#: Elements that can stand in a head; any other ends a head that is still open.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SCOPE = frozenset("article aside blockquote body div footer form header main nav ol section table td th ul".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']\S*))", re.I)
_SPACE = re.compile(r"\s+")
_CUT = re.compile(r"[^a-z0-9]+")


class _Open:
    """The open elements of a page, with the vector of the path that they make: tags and marked attributes, each distinct word once.

    An element that adds no word has its parent's vector, so that paths of any depth take little room. Where each
    name is open, and the nearest element that bounds implied ends, is kept, so that a tag costs no walk.
    """

    def __init__(self):
        self.names: list[str] = []
        self.words: list[tuple[str, ...]] = []
        self.vectors = [np.zeros(TAGS, np.float32)]
        self.scope: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.count: dict[str, int] = {}
        self.silent = 0

    def last(self, name: str) -> int:
        places = self.at.get(name)
        return places[-1] if places else -1

    def push(self, name: str, words: tuple[str, ...]) -> None:
        new = [w for w in dict.fromkeys(words) if not self.count.get(w)]
        vector = self.vectors[-1]
        if new:
            vector = vector.copy()
            for w in new:
                for slot, share in _slots(w):
                    vector[slot] += share
        for w in words:
            self.count[w] = self.count.get(w, 0) + 1
        k = len(self.names)
        self.scope.append(k if name in SCOPE else self.scope[-1] if k else -1)
        self.names.append(name)
        self.words.append(words)
        self.vectors.append(vector)
        self.at.setdefault(name, []).append(k)
        self.silent += name in SILENT

    def pop(self, k: int) -> None:
        """Ends element k and all that are open in it."""
        while len(self.names) > k:
            name = self.names.pop()
            self.at[name].pop()
            for w in self.words.pop():
                self.count[w] -= 1
            self.vectors.pop()
            self.scope.pop()
            self.silent -= name in SILENT

    def implied_ends(self, name: str) -> None:
        """Ends what an element of this name ends before it begins."""
        if name not in IN_HEAD and name != "head" and (head := self.last("head")) >= 0:
            self.pop(head)
        if name in BLOCK_TAGS and (svg := self.last("svg")) > self.last("foreignobject"):
            self.pop(svg)
        ended = max((self.last(c) for c in CLOSES.get(name, ())), default=-1)
        if name in ENDS_P:
            ended = max(ended, self.last("p"))
        if ended >= 0 and ended >= self.scope[-1]:
            self.pop(ended)


def leaf_blocks(page: str | None) -> list[tuple[str, np.ndarray]]:
    """(text, vector of the path) of each block with text, in page order."""
    out: list[tuple[str, np.ndarray]] = []
    stack = _Open()
    parts: list[str] = []

    def flush():
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append((text, stack.vectors[-1]))

    def text_to(end: int):
        if end > at:
            if stack.silent and stack.names[-1] == "head" and not page[at:end].isspace():
                stack.pop(len(stack.names) - 1)  # text can't stand in a head
            if not stack.silent:
                parts.append(html.unescape(page[at:end]))

    page = page or ""
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        text_to(m.start())
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCK_TAGS:
            flush()
        if m[1]:
            if (k := stack.last(name)) >= 0:
                stack.pop(k)
            continue
        stack.implied_ends(name)
        if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
            continue
        words = [name]
        for a in _ATTR.finditer(m[3]):
            words += [f"{a[1].lower()}:{w}" for w in _CUT.split((a[2] or a[3] or a[4] or "").lower()) if w]
        stack.push(name, tuple(words))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if name == "textarea" and not stack.silent:
                parts.append(html.unescape(page[at : end.start() if end else len(page)]))
            at = end.start() if end else len(page)
    text_to(len(page))
    flush()
    return out


WIDTH, HIDDEN, CHUNK = 280, 12, 512
SALTS = ("", "~", "^")
TAGS, WORDS = 256, 16


@lru_cache(200_000)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = 2166136261
    for c in word.encode("utf-8", "surrogatepass"):
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    h ^= h >> 15
    return h % size, 1.0 if h >> 31 else -1.0


@lru_cache(50_000)
def _slots(name: str) -> list[tuple[int, float]]:
    """Three slots of a name and its share in each: of three a strange name has at most one or two in common with a known one."""
    return [(slot, sign * len(SALTS) ** -0.5) for slot, sign in (_slot(salt + name, TAGS) for salt in SALTS)]


def block_vectors(blocks: list[tuple[str, np.ndarray]], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """A row for each block from lo to hi: the tag path, all words hashed, and sizes."""
    hi = len(blocks) if hi is None else hi
    out = np.zeros((hi - lo, WIDTH), np.float32)
    for k in range(lo, hi):
        text, path = blocks[k]
        row = out[k - lo]
        row[:TAGS] = path
        words = dict.fromkeys(text.lower().split(" "))
        for w in words:
            at, sign = _slot(w, WORDS)
            row[TAGS + at] += sign
        row[TAGS : TAGS + WORDS] *= 0.1 / np.sqrt(len(words))  # paths lead; words only tell small fixed blocks apart
        n = len(text)
        row[TAGS + WORDS :] = (min(np.log1p(n) / 5, 1.5), (text[-1] in ".!?…") * 0.3, min(len(words), 16) / 16, (k == 0) * 1.0, (k == len(blocks) - 1) * 1.0, k / len(blocks), (text[0] in "©»") * 1.0, 1.0)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
    """Outputs (time, page, HIDDEN) for inputs (time, page, WIDTH). state: where to begin, replaced by where it ends."""
    steps, pages, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    out = np.empty((steps, pages, HIDDEN), np.float32)
    xw = x @ w[:WIDTH] + w[-1]
    for t in range(steps):
        g = xw[t] + h @ w[WIDTH:-1]
        i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN] + (1.0 if k == 1 else 0.0)) for k in range(3))
        u = np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, u, tc))
        h = o * tc
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


def _lstm_back(x: np.ndarray, w: np.ndarray, keep: list, grad: np.ndarray) -> np.ndarray:
    dw = np.zeros_like(w)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, u, tc = keep[t]
        d = grad[t] + dh
        dc = dc + d * o * (1 - tc * tc)
        dg = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - u * u)), axis=1)
        dw[:WIDTH] += x[t].T @ dg
        dw[WIDTH:-1] += h.T @ dg
        dw[-1] += dg.sum(axis=0)
        dh, dc = dg @ w[WIDTH:-1].T, dc * f
    return dw


def _stack(rows: list[np.ndarray]):
    """Pages of about one length as (time, page, WIDTH), the same back to front from each page's end, and the mask."""
    steps = max(map(len, rows))
    x, r = np.zeros((steps, len(rows), WIDTH), np.float32), np.zeros((steps, len(rows), WIDTH), np.float32)
    mask = np.zeros((steps, len(rows)), bool)
    for k, v in enumerate(rows):
        x[: len(v), k], r[: len(v), k], mask[: len(v), k] = v, v[::-1], True
    return x, r, mask


def _turn(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each page's steps back to front, from its own end."""
    size = mask.sum(axis=0)
    at = size[None, :] - 1 - np.arange(len(a))[:, None]
    return np.where(mask[..., None], a[np.clip(at, 0, None), np.arange(a.shape[1])[None, :]], 0)


def score(rows: list[np.ndarray], model) -> list[np.ndarray]:
    """A margin for each block of each page; above 0: article."""
    fw, bw, v = model
    x, r, mask = _stack(rows)
    both = np.concatenate((_lstm(x, fw), _turn(_lstm(r, bw), mask), x), axis=2)
    out = both @ v[:-1] + v[-1]
    return [out[: len(p), k] for k, p in enumerate(rows)]


def score_long(blocks: list, model) -> np.ndarray:
    """The margins of one page of any length, in chunks: each goes on where the last one ended, in both directions."""
    fw, bw, v = model
    n = len(blocks)
    starts = range(0, n, CHUNK)
    hidden = np.empty((n, 2 * HIDDEN), np.float32)
    out = np.empty(n, np.float32)
    state: list = []
    for lo in reversed(starts):
        hi = min(n, lo + CHUNK)
        hidden[lo:hi, HIDDEN:] = _lstm(block_vectors(blocks, lo, hi)[::-1, None], bw, state=state)[::-1, 0]
    state = []
    for lo in starts:
        hi = min(n, lo + CHUNK)
        x = block_vectors(blocks, lo, hi)
        hidden[lo:hi, :HIDDEN] = _lstm(x[:, None], fw, state=state)[:, 0]
        out[lo:hi] = np.concatenate((hidden[lo:hi], x), axis=1) @ v[:-1] + v[-1]
    return out


def label(pages: list[list], model) -> list[np.ndarray]:
    """Which blocks of each page are article. Pages of up to CHUNK blocks go together, longer ones each in chunks."""
    out = [np.zeros(len(b), bool) for b in pages]
    short = sorted((k for k, b in enumerate(pages) if 0 < len(b) <= CHUNK), key=lambda k: len(pages[k]))
    for at in range(0, len(short), 64):
        part = short[at : at + 64]
        for k, s in zip(part, score([block_vectors(pages[k]) for k in part], model)):
            out[k] = s > 0
    for k, b in enumerate(pages):
        if len(b) > CHUNK:
            out[k] = score_long(b, model) > 0
    return out


class _Writer:
    """Pages with known labels: which blocks are article is told by marks that the writer puts into them."""

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        letters = list("aeiounrstlmdhcgpbéöñаеонιατ")
        self.vocab = ["".join(self.rng.choice(letters, self.rng.integers(2, 9))) for _ in range(3000)]

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, lo: int, hi: int) -> str:
        w = [self.vocab[k] for k in self.rng.integers(0, len(self.vocab), self.rng.integers(lo, hi + 1))]
        style = self.rng.random()
        if style < 0.06:
            w = [x.upper() + "!!" for x in w]
        elif style < 0.12:
            w = [x + self.pick("***", "###", "%%%", "&amp;&amp;", " |") for x in w]
        elif self.maybe(0.7):
            w[0] = w[0].capitalize()
            w[-1] += self.pick(".", ".", ".", "?", "!", "")
        return " ".join(w)

    def sentence(self) -> str:
        return " ".join(self.words(4, 18) for _ in range(self.rng.integers(1, 6)))

    def name(self, *options) -> str:
        """A class, id or role attribute, with company."""
        n = self.pick(*options)
        if self.maybe(0.25):
            n += self.pick("-1", "-box", "_wrap", " clearfix", "-main-x", " block")
        return f' {self.pick("class", "class", "class", "id")}="{n}"'

    def inline(self, text: str) -> str:
        if self.maybe(0.35):
            w = text.split(" ")
            k = self.rng.integers(len(w))
            w[k] = self.pick("<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span>{}</span>", "<code>{}</code>").format(w[k])
            text = " ".join(w)
        return text

    def article(self) -> str:
        m = self.MARK
        body = []
        for _ in range(int(self.rng.choice([1, 1, 2, 3, 5, 8, 12]))):
            r = self.rng.random()
            text = m + self.inline(self.pick(self.sentence, self.sentence, self.sentence, lambda: self.words(1, 6), lambda: self.pick("x", "1", "-", "ok"))())
            if r < 0.7:
                body.append(self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"{text}<br>"))
            elif r < 0.78:
                body.append(f"<h2>{m}{self.words(2, 7)}</h2>")
            elif r < 0.86:
                body.append("<ul>" + "".join(f"<li>{m}{self.words(1, 12)}</li>" for _ in range(self.rng.integers(1, 5))) + "</ul>")
            elif r < 0.9:
                body.append(f"<blockquote>{text}</blockquote>")
            elif r < 0.93:
                body.append(f"<figure><img src=x><figcaption>{m}{self.words(3, 10)}</figcaption></figure>")
            elif r < 0.96:
                body.append("<table><tr>" + "".join(f"<td>{m}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                body.append(f"<pre>{text}</pre>")
            if self.maybe(0.1):
                body.append(self.pick(self.advert, self.share, self.notice, self.form, self.comments)())
        title = self.pick(f"<h1>{m}{self.words(2, 10)}</h1>", f"<h1>{m}{self.words(1, 10)}</h1>", f"<header><h1>{m}{self.words(2, 10)}</h1></header>", f"<h2>{m}{self.words(2, 8)}</h2>", "")
        inner = title + "".join(body)
        if self.maybe(0.1):
            inner += self.comments()
        kind = self.rng.random()
        if kind < 0.28:
            return f"<article{self.name('post', 'article', 'entry') if self.maybe(0.3) else ''}>{inner}</article>"
        if kind < 0.36:
            return f"<main>{self.pick(inner, f'<article>{inner}</article>')}</main>"
        if kind < 0.54:
            return f"<div{self.name('content', 'article', 'post', 'entry-content', 'story', 'article-body', 'main-content', 'post-content', 'text', 'body-copy')}>{inner}</div>"
        if kind < 0.58:
            return f"<div role='main'>{inner}</div>"
        if kind < 0.92:
            return self.plain(inner)
        return inner  # straight in the body

    def coined(self) -> str:
        """A name that says nothing."""
        return "".join(self.rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), self.rng.integers(1, 8)))

    def plain(self, inner: str) -> str:
        """A container that doesn't tell what it holds: the blocks around it, and the text, have to."""
        for _ in range(int(self.rng.choice([1, 1, 1, 2, 3, 5]))):
            called = self.pick("", "", self.name("row", "col", "inner", "wrap", "grid", "module", "left", "center", "column", "area", "zone", "layout", "top-story", "side-story", "review"), self.name(self.coined(), f"{self.coined()} {self.coined()}"))
            tag = self.pick("div", "div", "section", "section", "section", "td", "center", "span", f"x-{self.coined()}")
            inner = f"<table><tr><td{called}>{inner}</td></tr></table>" if tag == "td" else f"<{tag}{called}>{inner}</{tag}>"
        return inner

    def links(self, n: int) -> str:
        item = self.pick("<li><a href='/a'>{}</a></li>", "<a href='/a'>{}</a>", "<li>{}</li>", "<div><a href='/a'>{}</a></div>")
        return "".join(item.format(self.words(1, 3)) for _ in range(n))

    def menu(self) -> str:
        inner = self.links(self.rng.integers(2, 8))
        return self.pick(f"<nav><ul>{inner}</ul></nav>", f"<nav>{inner}</nav>", f"<div{self.name('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'topnav', 'menu-main')}><ul>{inner}</ul></div>", f"<ul{self.name('menu', 'nav', 'pagination')}>{inner}</ul>", f"<div role='navigation'>{inner}</div>")

    def head(self) -> str:
        inner = self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<a href='/'>{self.words(1, 3)}</a>") + self.pick("", f"<p>{self.words(3, 12)}</p>", self.menu())
        return self.pick(f"<header>{inner}</header>", f"<div{self.name('header', 'masthead', 'site-header', 'top', 'banner')}>{inner}</div>", f"<div role='banner'>{inner}</div>")

    def foot(self) -> str:
        inner = self.pick(f"&copy; {self.words(1, 4)} &middot; {self.sentence()}", f"<p>&copy; {self.words(2, 8)}</p>", f"<p>{self.sentence()}</p>", self.menu() + f"<p>{self.words(2, 9)}</p>", self.sentence())
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{self.name('footer', 'site-footer', 'copyright', 'bottom')}>{inner}</div>", f"<div role='contentinfo'>{inner}</div>")

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.pick(f"<ul>{self.links(self.rng.integers(2, 6))}</ul>", f"<p>{self.sentence()}</p>", f"<div>{self.sentence()}</div>")
        return self.pick(f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", f"<div{self.name('sidebar', 'widget', 'related', 'side', 'rail', 'recommended', 'aside')}>{inner}</div>", f"<div role='complementary'>{inner}</div>")

    def notice(self) -> str:
        inner = self.pick(self.sentence(), f"<p>{self.sentence()}</p>", f"<p>{self.words(4, 15)}</p><button>{self.words(1, 2)}</button>")
        return f"<{(t := self.pick('div', 'section', 'div'))}{self.pick(self.name('notice', 'cookie', 'cookie-banner', 'alert', 'consent', 'popup', 'modal', 'newsletter', 'warning', 'gdpr', 'message', 'announcement', 'subscribe'), ' role=alert', ' role=dialog')}>{inner}</{t}>"

    def advert(self) -> str:
        inner = self.pick(self.sentence(), f"<p>{self.sentence()}</p>", f"<a href='/buy'>{self.words(2, 9)}</a>")
        return f"<{(t := self.pick('div', 'div', 'section', 'aside', 'ins'))}{self.name('ad', 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'promotion', 'sponsor', 'adsense', 'ad-slot')}>{inner}</{t}>"

    def share(self) -> str:
        return f"<div{self.name('share', 'social', 'tags', 'meta', 'byline-links')}>{self.links(3)}</div>"

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=q>" + self.pick("", f"<select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select>", f"<textarea>{self.words(1, 5) if self.maybe(0.5) else ''}</textarea>") + f"<button>{self.words(1, 2)}</button>"
        return self.pick(f"<form>{inner}</form>", f"<form>{inner}<p>{self.sentence()}</p></form>", f"<form{self.name('search', 'login', 'signup', 'contact')}>{inner}</form>")

    def comments(self) -> str:
        one = self.pick("<li class='comment'><p>{}</p></li>", "<div class='comment'><b>{}</b></div>", "<article class='comment'><p>{}</p></article>", "<p>{}</p>", "<div class='reply'>{}</div>")
        inner = self.pick("", f"<h3>{self.words(1, 4)}</h3>") + "".join(one.format(self.sentence()) for _ in range(self.rng.integers(1, 6)))
        return self.pick(f"<section{self.name('comments', 'comment-list', 'responses', 'discussion')}>{inner}</section>", f"<div{self.name('comments', 'comments-area', 'reader-comments', 'respond', 'discussion')}>{inner}</div>", f"<ol{self.name('commentlist', 'comments')}>{inner}</ol>")

    def page(self) -> str:
        before = [f() for f, p in ((self.head, 0.5), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.2), (self.side, 0.2)) if self.maybe(p)]
        after = [f() for f, p in ((self.share, 0.2), (self.advert, 0.3), (self.comments, 0.4), (self.form, 0.25), (self.side, 0.4), (self.notice, 0.2), (self.foot, 0.85)) if self.maybe(p)]
        if self.maybe(0.05):  # nothing but the article
            before, after = [], []
        if self.maybe(0.3):
            self.rng.shuffle(before)
        inner = "".join(before) + self.article() + "".join(after)
        if self.maybe(0.2):
            inner = f"<div{self.name('page', 'wrapper', 'container', 'site')}>{inner}</div>"
        page = f"<!DOCTYPE html><html lang='en'><head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style></head><body>{inner}</body></html>"
        return page[: self.rng.integers(len(page) // 2, len(page))] if self.maybe(0.03) else page

    def hidden(self, page: str) -> str:
        """The page; at times the article's element is a plain one, so that context and text have to carry the labels."""
        return re.sub(r"<(/?)(article|main)\b", r"<\1div", page) if self.maybe(0.2) else page

    def sample(self):
        """Blocks without marks, and labels."""
        found = leaf_blocks(self.hidden(self.page()))
        mark = self.MARK
        return [(t.replace(mark, "") or "-", p) for t, p in found], np.array([mark in t for t, _ in found], bool)


def train(pages: int = 2000, rounds: int = 8, seed: int = 11, rate: float = 0.01):
    """Weights (forward, backward, output) after Adam steps on `pages` written pages."""
    writer, rng = _Writer(seed), np.random.default_rng(seed)
    samples = [(block_vectors(b), y) for b, y in (writer.sample() for _ in range(pages)) if len(b)]
    shape = (WIDTH + HIDDEN + 1, 4 * HIDDEN)
    model = [(rng.standard_normal(shape) * 0.1).astype(np.float32), (rng.standard_normal(shape) * 0.1).astype(np.float32), np.zeros(2 * HIDDEN + WIDTH + 1, np.float32)]
    model[2][: 2 * HIDDEN] = rng.standard_normal(2 * HIDDEN) * 0.1
    first, second = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model]
    step = 0
    samples.sort(key=lambda s: len(s[0]))
    groups = [samples[k : k + 24] for k in range(0, len(samples), 24)]
    for turn in range(rounds):
        for g in rng.permutation(len(groups)):
            rows, labels = [v for v, _ in groups[g]], [y for _, y in groups[g]]
            x, r, mask = _stack(rows)
            kept_f, kept_b = [], []
            hf, hb = _lstm(x, model[0], kept_f), _lstm(r, model[1], kept_b)
            both = np.concatenate((hf, _turn(hb, mask), x), axis=2)
            z = both @ model[2][:-1] + model[2][-1]
            y = np.zeros(mask.shape, np.float32)
            for k, v in enumerate(labels):
                y[: len(v), k] = v
            d = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / mask.sum()
            dv = np.append(np.tensordot(d, both, axes=((0, 1), (0, 1))), d.sum()).astype(np.float32)
            dv[2 * HIDDEN : -1] += 1e-5 * model[2][2 * HIDDEN : -1]
            dh = d[..., None] * model[2][None, None, :-1]
            grads = [_lstm_back(x, model[0], kept_f, dh[..., :HIDDEN]), _lstm_back(r, model[1], kept_b, _turn(dh[..., HIDDEN : 2 * HIDDEN], mask)), dv]
            step += 1
            slower = rate * (1 - turn / rounds) + 1e-4
            for k, grad in enumerate(grads):
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                model[k] -= (slower * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tuple(model)


_MODEL: list = []


def model():
    """The trained network, once a driver process."""
    if not _MODEL:
        _MODEL.append(train())
    return _MODEL[0]


def main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col, the text of their article blocks, one on a line (such a column of pages is replaced)."""
    held = pages.sparkSession.sparkContext.broadcast(model())
    others = [c for c in pages.columns if c != out_col]
    at = pages.columns.index(html_col)
    keep = [pages.columns.index(c) for c in others]

    def run(rows):
        for batch in rows:
            for lo, hi in batches(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                blocks = [leaf_blocks(h) for h in part.column(at).to_pylist()]
                texts = ["\n".join(t for (t, _), kept in zip(b, y) if kept) for b, y in zip(blocks, label(blocks, held.value))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string())], names=[*others, out_col])

    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in others), T.StructField(out_col, T.StringType())]))
