"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks of text with the paths of tags that lead to them. A bidirectional LSTM in numpy reads,
for every block in page order, a hashed vector of its path, a hashed vector of its words and a few measures, and labels
each block as main text or not with the whole page as context. It is trained here, by back-propagation through time,
on generated pages whose blocks' labels are known.
"""

from __future__ import annotations

import functools
import html as entities
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, utf8_parts, word_hashes

#: Elements inside a block, elements whose text is never shown, elements without an end.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
HIDDEN = frozenset("script style noscript template iframe object svg math title head canvas audio video textarea".split())
#: Hidden elements whose content is markup: where the end tag is missing, the page goes on after the start tag.
MARKUP = frozenset("noscript template object svg math canvas audio video".split())
#: What may stand in a head; any other start tag or text ends it, as </head> may be omitted.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div main aside nav header footer form select".split())

PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN_SIZE = 64, 24, 8, 16
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
#: What an element adds to the path vector of what stands in it, against its own.
FADE = np.float32(0.85)
#: Generated pages, updates and pages of an update in training.
PAGES, UPDATES, BATCH = 500, 360, 32
SEED = 11

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"[0-9]")
_ENDED = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE) for t in HIDDEN if t != "head"}


def _tag_end(text: str, at: int) -> int:
    """Where a tag that begins before `at` ends: the first > outside quotes, or outright if a quote is never closed."""
    first = text.find(">", at)
    if first < 0:
        return len(text)
    marks = text[at:first]
    if "'" not in marks and marks.count('"') % 2 == 0:
        return first
    end = first
    while True:
        q = min((p for p in (text.find('"', at, end), text.find("'", at, end)) if p >= 0), default=-1)
        if q < 0:
            return end
        close = text.find(text[q], q + 1)
        if close < 0:
            return first
        at = close + 1
        if at > end:
            end = text.find(">", at)
            if end < 0:
                return first


@dataclass(slots=True)
class Block:
    """A leaf's text, the hashed vector of the tags that lead to it, how many they are and how many of its characters are in links."""

    path: np.ndarray
    depth: int
    text: str
    linked: int


_NO_PATH = np.zeros(PATH_SIZE, np.float32)


class _Open:
    """The open elements, outermost first. Each has the path vector of itself and what it stands in, so that a deep page costs no more a block than a flat one."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[np.ndarray] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str, marks: tuple[str, ...]) -> None:
        self.tags.append(tag)
        self.paths.append(element_vector((tag, *marks)) + FADE * (self.paths[-1] if self.paths else _NO_PATH))
        self.count[tag] = self.count.get(tag, 0) + 1

    def cut(self, at: int) -> None:
        for tag in self.tags[at:]:
            self.count[tag] -= 1
        del self.tags[at:], self.paths[at:]

    def has(self, tag: str) -> bool:
        return self.count.get(tag, 0) > 0

    def end(self, tag: str) -> None:
        """Close the innermost such element; phrases and paragraphs are not closed from within a part of the page below them."""
        stops = tag in INLINE or tag == "p"
        if self.has(tag):
            for i in range(len(self.tags) - 1, -1, -1):
                if self.tags[i] == tag:
                    return self.cut(i)
                if stops and self.tags[i] in SCOPE:
                    return None
        return None

    def give_way(self, tag: str) -> None:
        """Close what a start tag ends: an open paragraph, or an item of its kind."""
        ended = ENDS.get(tag, ())
        if self.has("p") or any(self.has(t) for t in ended):
            for i in range(len(self.tags) - 1, -1, -1):
                if self.tags[i] == "p" or self.tags[i] in ended:
                    return self.cut(i)
                if self.tags[i] in SCOPE:
                    return None
        return None


def blocks_of(page: str | None) -> list[Block]:
    """The blocks with text of a page, in its order.

    White space is one space and trimmed, character references are decoded. Elements that never show text are skipped.
    A head ends where something stands that can't be in it; a hidden element of markup without an end hides nothing.
    """
    text = page or ""
    tree = _Open()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    path, depth, titled = _NO_PATH, 0, False
    endless: set[str] = set()
    at = 0

    def close_block():
        nonlocal parts, linked
        if parts:
            body = "".join(parts)
            if "&" in body:
                body = entities.unescape(body)
            body = " ".join(body.split())
            if body and not titled:
                out.append(Block(path, depth, body, min(linked, len(body))))
            parts, linked = [], 0

    def close_head():
        if tree.has("head"):
            close_block()
            tree.cut(tree.tags.index("head"))

    def add(piece: str):
        nonlocal linked, path, depth, titled
        if piece:
            if tree.tags and tree.tags[-1] == "head" and piece.strip(" \t\n\r\f"):
                close_head()
            if not parts or (not depth and tree.tags):
                path, depth, titled = (tree.paths[-1] if tree.paths else _NO_PATH), len(tree.tags), tree.has("head")
            parts.append(piece)
            if tree.has("a") and "a" in tree.tags[-3:]:
                linked += len(piece)

    while True:
        m = _OPEN.search(text, at)
        if not m:
            add(text[at:])
            break
        if m.start() > at:
            add(text[at : m.start()])
        if m[1]:
            end = text.find("-->", m.end())
            at = len(text) if end < 0 else end + 3
            continue
        end = _tag_end(text, m.end())
        at = min(end + 1, len(text))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in ("body", "html", "br"):
                close_head()
            if tag not in INLINE:
                close_block()
            tree.end(tag)
            continue
        if tag not in IN_HEAD:
            close_head()
        elif tag == "head" and any(t != "html" for t in tree.tags[:2]):
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            close_block()
            tree.give_way(tag)
        if tag in _ENDED and not text.endswith("/", 0, end):
            close = None if tag in endless else _ENDED[tag].search(text, at)
            if close:
                at = _tag_end(text, close.end()) + 1
            elif tag in MARKUP:
                endless.add(tag)
            else:
                at = len(text)
            continue
        if tag in VOID or text.endswith("/", 0, end):
            continue
        marks = text[m.end() : end]
        names = [w for a in _ATTRIBUTE.finditer(marks) for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())] if "=" in marks else []
        tree.push(tag, tuple(names[:8]))
    close_block()
    return out


def _stable(word: str) -> int:
    h = np.frombuffer(word.encode().ljust(16, b"\0")[:16], np.uint64)
    return int(mix64(mix64(h[:1]) + h[1:])[0])


@functools.lru_cache(maxsize=65536)
def element_vector(names: tuple[str, ...]) -> np.ndarray:
    """Signed hashes of an element's tag and of the names in its class, id and role."""
    v = np.zeros(PATH_SIZE, np.float32)
    for name in [names[0], *("." + x for x in names[1:])]:
        h = _stable(name)
        v[h % PATH_SIZE] += 1 if h >> 40 & 1 else -1
    return v


def page_inputs(pages: list[list[Block]]) -> np.ndarray:
    """The labeller's input of all blocks of all pages, in order."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return x
    x[:, :PATH_SIZE] = [b.path for b in flat]
    offsets, body = utf8_parts(pa.array([b.text for b in flat], pa.string()))
    hashes, counts = word_hashes(offsets, body)
    spot = (hashes % np.uint64(WORD_SIZE)).astype(np.int64)
    sign = np.where((hashes >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    owner = np.repeat(np.arange(len(flat)), counts)
    words = np.bincount(owner * WORD_SIZE + spot, sign, len(flat) * WORD_SIZE).reshape(len(flat), WORD_SIZE)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = words / np.maximum(np.sqrt((words**2).sum(1)), 1)[:, None]
    size = np.array([len(b.text) for b in flat], np.float32)
    m = x[:, PATH_SIZE + WORD_SIZE :]
    m[:, 0] = np.log1p(size) / 6
    m[:, 1] = np.log1p(counts) / 5
    m[:, 2] = np.array([b.linked for b in flat]) / np.maximum(size, 1)
    m[:, 3] = [b.text[-1] in ".!?…:;" for b in flat]
    lengths = np.array([len(p) for p in pages])
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    m[:, 4] = (np.arange(len(flat)) - begin) / np.repeat(np.maximum(lengths, 1), lengths)
    m[:, 5] = np.minimum([b.depth for b in flat], 64) / 10
    m[:, 6] = np.log1p(np.repeat(lengths, lengths)) / 6
    m[:, 7] = [_DIGIT.search(b.text, 0, 40) is not None for b in flat]
    return x


@dataclass
class Labeller:
    """Weights by direction: wx (input, 4 h), wh (h, 4 h), b (4 h); out (2 h), bias. Gates: input, forget, output, candidate."""

    weights: dict[str, np.ndarray]

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each block of pages that follow one another in x, the probability that it is main text."""
        out = np.zeros(len(x), np.float32)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        first = 0
        while first < len(order):
            last = first + 1
            while last < len(order) and (last - first + 1) * lengths[order[last]] <= 1 << 14:
                last += 1
            group = order[first:last]
            index = _index(starts[group], lengths[group])
            mask = index >= 0
            z, _ = _forward(self.weights, x[np.maximum(index, 0)], mask)
            out[index[mask]] = 1 / (1 + np.exp(-z[mask]))
            first = last
        return out


def _index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(pages, longest) places of blocks, -1 after a page's end."""
    t = np.arange(lengths.max())
    return np.where(t < lengths[:, None], starts[:, None] + t, -1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict, x: np.ndarray, mask: np.ndarray):
    """Logits (pages, steps), and what the backward pass needs."""
    n, steps, _ = x.shape
    saved = {}
    hidden = []
    for d in ("f", "b"):
        gates = x @ w["wx" + d] + w["b" + d]
        h = c = np.zeros((n, HIDDEN_SIZE), np.float32)
        out = np.zeros((n, steps, HIDDEN_SIZE), np.float32)
        trail = [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates[:, t] + h @ w["wh" + d]
            s = _sigmoid(g[:, : 3 * HIDDEN_SIZE])
            i, f, o = s[:, :HIDDEN_SIZE], s[:, HIDDEN_SIZE : 2 * HIDDEN_SIZE], s[:, 2 * HIDDEN_SIZE :]
            u = np.tanh(g[:, 3 * HIDDEN_SIZE :])
            on = mask[:, t, None]
            new = f * c + i * u
            tc = np.tanh(new)
            trail[t] = (h, c, i, f, o, u, tc)
            h, c = np.where(on, o * tc, h), np.where(on, new, c)
            out[:, t] = h
        hidden.append(out)
        saved[d] = trail
    both = np.concatenate(hidden, 2)
    return both @ w["out"] + w["bias"], (both, saved)


def _backward(w: dict, x: np.ndarray, mask: np.ndarray, dz: np.ndarray, state) -> dict:
    both, saved = state
    n, steps, _ = x.shape
    grad = {"out": np.einsum("nt,nth->h", dz, both), "bias": dz.sum()}
    for k, d in enumerate(("f", "b")):
        dout = dz[:, :, None] * w["out"][k * HIDDEN_SIZE : (k + 1) * HIDDEN_SIZE]
        dgates = np.zeros((n, steps, 4 * HIDDEN_SIZE), np.float32)
        grad["wh" + d] = np.zeros_like(w["wh" + d])
        dh = dc = np.zeros((n, HIDDEN_SIZE), np.float32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h0, c0, i, f, o, u, tc = saved[d][t]
            on = mask[:, t, None]
            dh = dh + dout[:, t]
            dcell = dc + dh * o * (1 - tc * tc)
            dg = np.concatenate([dcell * u * i * (1 - i), dcell * c0 * f * (1 - f), dh * tc * o * (1 - o), dcell * i * (1 - u * u)], 1) * on
            dgates[:, t] = dg
            grad["wh" + d] += h0.T @ dg
            dh = np.where(on, dg @ w["wh" + d].T, dh)
            dc = np.where(on, dcell * f, dc)
        grad["wx" + d] = np.einsum("nti,ntg->ig", x, dgates)
        grad["b" + d] = dgates.sum((0, 1))
    return grad


def train(pages: list[list], labels: list[np.ndarray], updates: int = UPDATES, seed: int = SEED) -> Labeller:
    """Fit to pages of blocks and their labels with Adam and binary cross-entropy."""
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    for d in ("f", "b"):
        w["wx" + d] = rng.normal(0, 0.15, (INPUT, 4 * HIDDEN_SIZE)).astype(np.float32)
        w["wh" + d] = rng.normal(0, 0.15, (HIDDEN_SIZE, 4 * HIDDEN_SIZE)).astype(np.float32)
        w["b" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN_SIZE)
    w["out"], w["bias"] = rng.normal(0, 0.3, 2 * HIDDEN_SIZE).astype(np.float32), np.float32(0)
    x, lengths = page_inputs(pages), np.array([len(p) for p in pages])
    starts, y = np.cumsum(lengths) - lengths, np.concatenate(labels).astype(np.float32)
    m, v = {k: 0.0 for k in w}, {k: 0.0 for k in w}
    by_length = np.argsort(lengths, kind="stable")
    for step in range(1, updates + 1):
        # pages of like length share a batch
        a = int(rng.integers(0, max(1, len(pages) - BATCH + 1)))
        group = by_length[a : a + BATCH]
        index = _index(starts[group], lengths[group])
        mask = index >= 0
        part = x[np.maximum(index, 0)]
        z, state = _forward(w, part, mask)
        dz = np.where(mask, _sigmoid(z) - y[np.maximum(index, 0)], 0).astype(np.float32) / mask.sum()
        for k, g in _backward(w, part, mask, dz, state).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.995 * v[k] + 0.005 * g * g
            rate = 0.02 * min(1.0, 2 * (1 - step / (updates + 1)))
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return Labeller(w)


#: Names that sites give to the parts of a page. The generator draws from them.
NAMES = {
    "main": "content post entry story text body article page main question topic detail document lead".split(),
    "menu": "nav menu navbar topnav breadcrumb breadcrumbs navigation links toolbar tabs pagination pager".split(),
    "side": "sidebar side related widget widgets recommended popular tags trending archive aside".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo adsense teaser".split(),
    "notice": "cookie cookies consent notice alert popup modal gdpr newsletter subscribe overlay".split(),
    "comments": "comments comment replies responses discussion disqus commentlist reviews thread".split(),
    "share": "share social sharing follow buttons tools".split(),
    "foot": "footer foot copyright legal bottom colophon".split(),
    "head": "header masthead top logo branding site".split(),
}
#: Roles that some sites give to them.
ROLES = {"main": "main", "menu": "navigation", "side": "complementary", "foot": "contentinfo", "head": "banner", "notice": "dialog"}
MARK = "\x01"


class _Writer:
    """Makes up a page's parts from random numbers. Invented words, so that only structure and measures can be learnt."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.sounds = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 4))) for _ in range(40)]
        self.signs = rng.random() < 0.2
        #: A site leaves out end tags of paragraphs and items, or doesn't name its parts, throughout.
        self.open_ends = rng.random() < 0.15
        self.unnamed = rng.random() < 0.15
        #: Tag soup: phrases whose end tags are missing.
        self.soup = rng.random() < 0.2

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def some(self, p: float, make) -> str:
        return make() if self.chance(p) else ""

    def one(self, options):
        return options[self.rng.integers(0, len(options))]

    def many(self, least: int, most: int):
        return range(int(self.rng.integers(least, most + 1)))

    def word(self) -> str:
        w = "".join(self.sounds[i] for i in self.rng.integers(0, len(self.sounds), self.rng.integers(1, 4)))
        if self.signs and self.chance(0.3):
            return w + self.one(["&amp;", "&#39;s", "*", " &ndash;", "!", "&nbsp;", " 12", "%", "#"])
        return w

    def words(self, least: int, most: int, stop: bool = True) -> str:
        line = [self.word() for _ in self.many(least, most)]
        ends = self.one([".", ".", ".", "!", "?", ":", ""]) if stop else ""
        return " ".join(line).capitalize() + ends

    def phrase(self, least: int, most: int) -> str:
        """Words with markup among them."""
        line = self.words(least, most)
        if self.soup and self.chance(0.25):
            return f"<{self.one(['b', 'i', 'strong', 'em', 'font', 'span', 'u', 'small'])}>{line}" + self.some(0.4, lambda: "<br>")
        r = self.rng.random()
        if r < 0.12:
            return f"{line} <{(t := self.one(['b', 'em', 'strong', 'i', 'span', 'code', 'u']))}>{self.words(1, 4, False)}</{t}> {self.words(1, 20)}"
        if r < 0.24:
            return f'{line} <a href="/x">{self.words(1, 4, False)}</a> {self.words(1, 30)}'
        if r < 0.3:
            return f"{line}<br>{self.words(3, 30)}"
        if r < 0.34:
            return f"{line}<br><br>{self.words(3, 30)}"
        return line

    def end(self, tag: str) -> str:
        return "" if self.open_ends and tag in ("p", "li", "td", "tr", "dd", "dt", "th") else f"</{tag}>"

    def box(self, kind: str, inner: str, tags: tuple = ("div", "section", "div")) -> str:
        tag = self.one(tags)
        if self.unnamed and kind == "main":
            return f"<{tag}>{inner}</{tag}>"
        name = self.one(NAMES[kind]) + self.one(["", "", "-box", "-area", "_1", " clearfix", "-wrapper inner"])
        marks = [f'{self.one(["class", "id"])}="{name}"']
        if kind in ROLES and self.chance(0.15):
            marks.append(f'role="{ROLES[kind]}"')
        return f"<{tag}>{inner}</{tag}>" if tag not in ("div", "section", "ul", "ol", "td") and self.chance(0.5) else f"<{tag} {' '.join(marks)}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3, False)}</a>' for i in range(n)]
        return self.one(["<ul>" + "".join(f"<li>{x}{self.end('li')}" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "<p>" + " &raquo; ".join(items) + "</p>"])

    def paragraph(self) -> str:
        m, kind = MARK, self.rng.random()
        if kind < 0.5:
            return f"<p>{m}{self.phrase(1, 90)}" + self.some(0.7, lambda: self.end("p")) if self.soup else f"<p>{m}{self.phrase(1, 90)}{self.end('p')}"
        if kind < 0.58:
            h = int(self.rng.integers(2, 5))
            return f"<h{h}>{m}{self.words(1, 8, False)}</h{h}>"
        if kind < 0.66:
            tag = self.one(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{m}{self.phrase(2, 20)}{self.end('li')}" for _ in self.many(2, 6)) + f"</{tag}>"
        if kind < 0.7:
            return f"<blockquote><p>{m}{self.words(4, 50)}</p></blockquote>" if self.chance(0.6) else f"<blockquote>{m}{self.words(4, 50)}</blockquote>"
        if kind < 0.78:
            columns = int(self.rng.integers(2, 5))
            row = lambda tag: "<tr>" + "".join(f"<{tag}>{m}{self.words(1, 4, False)}{self.end(tag)}" for _ in range(columns)) + self.end("tr")
            head = self.one([row("th"), "<thead>" + row("th") + "</thead>", ""])
            side = lambda: f"<tr><th>{m}{self.words(1, 3, False)}</th><td>{m}{self.words(1, 8, False)}</td></tr>"
            rows = "".join(row("td") for _ in self.many(1, 5)) if self.chance(0.7) else "".join(side() for _ in self.many(2, 6))
            return f"<table>{self.some(0.3, lambda: f'<caption>{m}{self.words(2, 8)}</caption>')}{head}{rows}</table>"
        if kind < 0.82:
            return "<dl>" + "".join(f"<dt>{m}{self.words(1, 4, False)}{self.end('dt')}<dd>{m}{self.phrase(3, 30)}{self.end('dd')}" for _ in self.many(2, 5)) + "</dl>"
        if kind < 0.86:
            return f'<figure><img src="/i.png" alt="x"><figcaption>{m}{self.words(2, 20)}</figcaption></figure>'
        if kind < 0.9:
            return f"<pre>{m}{self.words(2, 40)}</pre>" if self.chance(0.5) else f"<pre><code>{m}{self.words(2, 40)}</code></pre>"
        if kind < 0.96:
            return f"<div>{m}{self.phrase(5, 70)}</div>"
        return f"{m}{self.phrase(8, 70)}<br><br>"

    def remark(self) -> str:
        """A reader's comment."""
        by = self.some(0.7, lambda: self.one(["<span>{}</span>", "<cite>{}</cite>", "<h4>{}</h4>", '<div class="author">{}</div>', "<b>{}</b>"]).format(self.words(1, 2, False)))
        body = self.one(["<p>{}</p>", "<div>{}</div>", "{}"]).format(self.phrase(2, 40))
        return by + body + self.some(0.3, lambda: f'<a href="#">{self.words(1, 1, False)}</a>')

    def comments(self) -> str:
        tag, item = self.one([("ol", "li"), ("ul", "li"), ("div", "div"), ("section", "article"), ("div", "div")])
        listed = "".join(f'<{item}{self.one(["", chr(32) + "class=comment", chr(32) + "class=reply"])}>{self.remark()}</{item}>' for _ in self.many(1, 7))
        form = self.some(0.3, lambda: f"<form><label>{self.words(1, 3, False)}</label><textarea></textarea><button>{self.words(1, 2, False)}</button></form>")
        return self.box("comments", f"<h3>{self.words(1, 3, False)}</h3><{tag}>{listed}</{tag}>{form}")

    def between(self) -> str:
        return self.some(0.06, lambda: self.box("ad", self.words(1, 20), ("div", "aside"))) + self.some(0.04, lambda: "<script>var a = '<p>';</script>")

    def story(self) -> str:
        title = self.some(0.85, lambda: f"<h1>{MARK}{self.words(1, 14, False)}</h1>")
        if self.chance(0.15):
            title = f"<header>{title}</header>"
        body = "".join(self.paragraph() + self.between() for _ in range(int(self.rng.integers(1, 14) ** 1.3)))
        if self.chance(0.2):
            body = self.box("main", body)
        if self.chance(0.15):
            body = "".join(f"<section><h2>{MARK}{self.words(1, 6, False)}</h2>{self.paragraph()}{self.paragraph()}</section>" for _ in self.many(1, 4)) + body
        return title + body + self.some(0.15, lambda: self.box("share", self.links(3)))

    def page(self) -> str:
        frame = self.rng.random()
        story = self.story()
        if frame < 0.45:
            article = f"<article>{story}</article>"
        elif frame < 0.6:
            article = f"<main>{story}</main>"
        else:
            article = self.box("main", story, ("div", "section", "div"))
        if self.chance(0.15):
            article = f"<main>{article}</main>"
        if self.chance(0.1) and article.endswith("</article>"):
            article = article[: -len("</article>")] + self.comments() + "</article>"
        before = [
            self.some(0.4, lambda: self.box("head", self.words(1, 6, False) + self.some(0.5, lambda: self.links(4)), ("header", "div"))),
            self.some(0.75, lambda: self.box("menu", self.links(int(self.rng.integers(2, 10))), ("nav", "div", "nav"))),
            self.some(0.3, lambda: self.box("notice", f"<p>{self.words(3, 25)}</p>" + self.some(0.5, lambda: f"<button>{self.words(1, 2, False)}</button>"))),
            self.some(0.6, lambda: self.box("ad", self.some(0.5, lambda: "<p>") + self.words(2, 25), ("div", "aside", "div"))),
            self.some(0.2, lambda: f"<form><label>{self.words(1, 3, False)}</label><input name=q><button>{self.words(1, 2, False)}</button></form>"),
        ]
        if self.chance(0.3):
            before = [before[i] for i in self.rng.permutation(len(before))]
        side = lambda: self.box("side", f"<h4>{self.words(1, 3, False)}</h4>" + (self.links(5) if self.chance(0.6) else f"<p>{self.words(3, 40)}</p>"), ("aside", "div"))
        after = [self.some(0.35, self.comments), self.some(0.35, side), self.some(0.15, lambda: self.box("ad", self.words(2, 25), ("div", "aside"))), self.some(0.85, lambda: self.box("foot", "&copy; " + self.words(1, 12) + self.some(0.4, lambda: self.links(3)), ("footer", "div", "footer")))]
        if self.chance(0.1):
            # a page laid out by a table
            middle = f"<table><tr><td>{self.links(6)}</td><td>{article}</td>{self.some(0.5, lambda: f'<td>{side()}</td>')}</tr></table>"
        else:
            middle = self.some(0.15, side) + article
        if self.chance(0.3):
            middle = f'<div class="{self.one(["container", "wrapper", "row", "layout", "x1"])}"><div>{middle}</div></div>'
        body = f"{''.join(before)}<!-- x -->{middle}{''.join(after)}"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8, False)}</title></head><body>{body}" + self.some(0.9, lambda: "</body></html>")


def generated_page(rng: np.random.Generator) -> str:
    """A random page; its main text is marked by the control character \\x01 at the start of each block."""
    return _Writer(rng).page()


@functools.lru_cache(maxsize=1)
def default_labeller() -> Labeller:
    """Trained on generated pages; the same on every call."""
    rng = np.random.default_rng(SEED)
    pages, labels = [], []
    for _ in range(PAGES):
        blocks = blocks_of(generated_page(rng))
        if blocks:
            labels.append(np.array(["\x01" in b.text for b in blocks]))
            pages.append([replace(b, text=b.text.replace("\x01", "") or ".") for b in blocks])
    return train(pages, labels)


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of each page: its blocks of main text joined by empty lines."""
    blocks = [blocks_of(p) for p in pages]
    lengths = np.array([len(b) for b in blocks], np.int64)
    keep = labeller.probabilities(page_inputs(blocks), lengths) >= 0.5 if lengths.sum() else np.zeros(0, bool)
    ends = np.cumsum(lengths)
    return ["\n\n".join(x.text for x, k in zip(b, keep[e - n : e], strict=True) if k) for b, e, n in zip(blocks, ends, lengths, strict=True)]


def extract_text(pages: DataFrame, labeller: Labeller | None = None, html: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points): the main text of the whole html.

    Null and empty pages, and pages without a block of main text, have empty text. Blocks are never cut or limited.
    Input columns of the same names are replaced, other extra columns stay; repeated rows each get their result; an
    empty table stays empty. Pages are independent: nothing is shuffled.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(labeller or default_labeller())

    @F.arrow_udf("string")
    def text_of(values: pa.Array) -> pa.Array:
        out: list[str] = []
        group: list[str | None] = []
        size = 0
        for value in values:
            group.append(value.as_py())
            size += len(group[-1] or "")
            if size > 1 << 20:
                out += main_texts(group, shared.value)
                group, size = [], 0
        return pa.array(out + main_texts(group, shared.value) if group else out, pa.string())

    names = ["text", "n_chars"]
    own = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    found = pages.select(*own, text_of(html).alias("text"))
    return found.select(*own, "text", F.length("text").cast("long").alias("n_chars"))


def op1(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("html")
