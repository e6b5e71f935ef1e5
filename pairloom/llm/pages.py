"""HTML extraction (operator 2): a recurrent labeller of blocks.

A page becomes its sequence of blocks: runs of text between block-level tags, each with the path of tags, classes and
ids above it. A bidirectional LSTM reads the whole sequence, each block as an embedding of its hashed path, the mean
embedding of its hashed words and a few measures, and labels every block as article or not in the light of all others.

The network is trained here, on pages that a generator lays out from invented words: articles amid menus, headers,
footers, sidebars, notices, adverts, forms and comments, with the tags, classes and mistakes that such pages have.
Nothing about the tables it is applied to enters the training.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, map_texts

# blocks

_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is not text of the page. Of one that is never closed only the tag goes, but scripts and styles go on to the end.
RAW = frozenset("script style template noframes iframe object svg math canvas audio video title".split())
ENDLESS = frozenset("script style".split())
#: What stands in a head; anything else ends one that was left open.
HEAD = frozenset("head title meta link script style base noscript template".split())
#: Innermost elements that a path holds at most.
DEEPEST = 32
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, if it is open in the same container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in BLOCK - {"p", "li", "dt", "dd", "tr", "td", "th", "option"}}
BARRIER = frozenset("table ul ol dl div section article aside nav header footer main form body html td th blockquote select".split())


class Block:
    """A run of text: its path (tags with their names, outermost first), text and how many characters stand in links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class _Scanner:
    """The ends of tags of a page. Every search that finds nothing is made once, so a page is read in linear time."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name or attributes go on at `at`, -1 if there is none.

        A quoted value may hold >. A quote that opens no value, or is never closed, is a character like any other.
        """
        if at > self.last:
            return -1
        k = at
        while self.quotes:
            m = _EDGE.search(self.page, k)
            if not m:
                # all that follows is quoted; from here on quotes are taken for characters
                self.quotes = False
                break
            k = m.end()
            if m[0] == ">":
                return k - 1
            if k <= self.last_quote[m[0]] and self.page[max(at, k - 64) : k - 1].rstrip().endswith("="):
                k = self.page.find(m[0], k) + 1
        return self.page.find(">", at)

    def close(self, name: str, at: int) -> int:
        """Where the page goes on after the closing tag of an element without text, -1 if there is no such tag."""
        if name in self.unclosed:
            return -1
        m = _CLOSE[name].search(self.page, at, self.last + 1)
        if not m:
            self.unclosed.add(name)
            return -1
        return m.end()


_EDGE = re.compile(r"[>\"']")
_OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
#: References to numbers so long that they are no character.
_LONG = re.compile(r"&#(?:(\d{8,})|[xX]([0-9a-fA-F]{7,}));?")


def _short(m: re.Match) -> str:
    digits = (m[1] or m[2]).lstrip("0")
    return "\ufffd" if len(digits) > 7 else f"&#{'x' if m[2] else ''}{digits or '0'};"


def decoded(text: str) -> str:
    """The text with its character references decoded."""
    if "&" not in text:
        return text
    return html.unescape(_LONG.sub(_short, text))


class _Stack:
    """The open elements, outermost first, with the places of each name, of those that bound a closing, and of blocks."""

    def __init__(self):
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.blocks: list[tuple[str, tuple[str, ...]]] = []

    def push(self, name: str, names: tuple[str, ...]) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        if name in BARRIER:
            self.barriers.append(len(self.open))
        self.open.append((name, names))
        if name in BLOCK:
            self.blocks.append(self.open[-1])

    def cut(self, to: int) -> None:
        """Close all elements from place `to` on."""
        while len(self.open) > to:
            name, _ = self.open.pop()
            self.at[name].pop()
            if name in BARRIER:
                self.barriers.pop()
            if name in BLOCK:
                self.blocks.pop()

    def last(self, name: str) -> int:
        """The place of the innermost open element of this name, -1 if there is none."""
        at = self.at.get(name)
        return at[-1] if at else -1

    def path(self) -> tuple:
        return tuple(self.blocks[-DEEPEST:])


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; white space inside a block is one space, character references are decoded.

    Scripts, styles, comments, titles and the head are no blocks. Tags may be left open, closed twice or cut off: a
    head ends at the first thing that can't stand in one, and a < that begins no tag is text. The time is linear in
    the length of the page.
    """
    out: list[Block] = []
    stack, scan = _Stack(), _Scanner(page)
    parts: list[str] = []
    linked = 0
    path: tuple | None = None

    def end() -> None:
        nonlocal parts, linked, path
        if parts:
            text = " ".join(decoded("".join(parts)).split())
            if text:
                out.append(Block(path or (), text, min(linked, len(text))))
            parts, linked, path = [], 0, None

    def put(raw: str) -> None:
        nonlocal linked, path
        if path is None and raw.strip():
            if stack.last("head") >= 0:
                stack.cut(stack.last("head"))
            path = stack.path()
        parts.append(raw)
        if stack.at.get("a"):
            linked += len(raw)

    at, n = 0, len(page)
    while at < n:
        if page[at] != "<":
            to = page.find("<", at)
            to = n if to < 0 else to
            put(page[at:to])
            at = to
            continue
        if page.startswith("<!--", at):
            to = page.find("-->", at + 2)
            at = n if to < 0 else to + 3
            continue
        m = _OPEN.match(page, at + 1)
        if not m:
            to = page.find(">", at) if page[at + 1 : at + 2] in ("!", "?") and at < scan.last else -1
            if to < 0:
                put("<")
            at = at + 1 if to < 0 else to + 1
            continue
        to = scan.end(m.end())
        if to < 0:
            put("<")
            at += 1
            continue
        name, rest, at = m[2].lower(), page[m.end() : to], to + 1
        if m[1]:
            if name in BLOCK:
                end()
            if stack.last(name) >= 0:
                stack.cut(stack.last(name))
            elif name == "br":
                parts.append(" ")
            continue
        head = stack.last("head")
        if head >= 0 and name not in HEAD:
            end()
            stack.cut(head)
        if name in RAW:
            if name in BLOCK:
                end()
            if not rest.endswith("/"):
                to = scan.close(name, at)
                at = to if to >= 0 else n if name in ENDLESS else at
            continue
        if name in BLOCK:
            end()
            k = max((stack.last(t) for t in CLOSES.get(name, ())), default=-1)
            if k >= 0 and (not stack.barriers or k >= stack.barriers[-1]):
                stack.cut(k)
            if name == "body":
                stack.cut(1 if stack.open and stack.open[0][0] == "html" else 0)
        elif name == "br":
            parts.append(" ")
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        names = tuple(w.lower() for a in _ATTRIBUTE.finditer(rest) for w in _NAME.findall(a[2] or a[3] or a[4] or "")) if rest else ()
        stack.push(name, names)
    end()
    return out


# features

PATHS, WORDS = 1 << 11, 1 << 11
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 16, 8, 9, 24


@lru_cache(maxsize=1 << 16)
def _path_bucket(x: str) -> int:
    return xxhash.xxh64_intdigest(x, 1) % PATHS


class _Buckets(dict):
    """The hashed bucket of each word, kept for words that come again."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        b = self[word] = xxhash.xxh64_intdigest(word, 2) % WORDS
        return b


_word_buckets = _Buckets()


@lru_cache(maxsize=1 << 14)
def path_features(path: tuple) -> tuple[int, ...]:
    """Hashed features of a path: its tags, its names, and the innermost tags by place."""
    out = {f"t:{t}" for t, _ in path} | {f"n:{w}" for _, names in path for w in names}
    out |= {f"{i}:{t}" for i, (t, _) in enumerate(reversed(path[-3:]))} | {f"l:{w}" for _, names in path[-1:] for w in names}
    return tuple(sorted({_path_bucket(x) for x in out}))


def measures(b: Block, place: float) -> list[float]:
    t = b.text
    n = len(t)
    return [
        np.log1p(n) / 8,
        np.log1p(t.count(" ")) / 6,
        b.linked / n,
        float(t[-1] in ".!?\"')"),
        sum(map(t.count, ",;:.")) * 8 / n,
        sum(map(t.count, "|·»›©>")) * 8 / n,
        float("©" in t),
        place,
        1.0,
    ]


class Batch:
    """The features of the blocks of some pages, flat, with the number of blocks of each page."""

    def __init__(self, pages: list[list[Block]]):
        self.sizes = np.array([len(p) for p in pages], np.int64)
        flat = [b for p in pages for b in p]
        paths = [path_features(b.path) for b in flat]
        get = _word_buckets.__getitem__
        words = [list(map(get, b.text.lower().split())) for b in flat]
        self.paths, self.path_at = _ragged(paths)
        self.words, self.word_at = _ragged(words)
        self.measures = np.array([measures(b, i / len(p)) for p in pages for i, b in enumerate(p)], np.float32).reshape(-1, MEASURES)


def _ragged(lists) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for xs in lists for x in xs), np.int64, int(n.sum())), np.concatenate([[0], np.cumsum(n)])


def _sums(table: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the rows of `table` at each ragged row of indices."""
    out = np.zeros((len(at) - 1, table.shape[1]), table.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(table[index], at[full])
    return out


# network


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = PATH_DIM + WORD_DIM + MEASURES
    w = {"path": rng.normal(0, 0.2, (PATHS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORDS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN + size), "bias": np.zeros(1)}
    for d in ("f", "b"):
        w["x" + d] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN))
        w["h" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, wx, wh, c0, keep: bool):
    """(states, what the backward pass needs) over x of (time, batch, size); a masked step leaves the state as it is."""
    steps, batch, _ = x.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    c = np.zeros_like(h)
    pre = x @ wx + c0
    out, tape = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ wh
        s = _sig(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        c = np.where(m, c2, c)
        h = np.where(m, o * tc, h)
        out[t] = h
    return out, tape


def _lstm_back(dout: np.ndarray, x: np.ndarray, tape: list, wx, wh):
    """Gradients of _lstm: (dx, dwx, dwh, dc0)."""
    steps, batch, _ = x.shape
    dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    dz = np.zeros((steps, batch, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + dout[t]
        dhm = np.where(m, dh, 0)
        dct = np.where(m, dc, 0) + dhm * o * (1 - tc * tc)
        z = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
        dz[t] = z
        dwh += h.T @ z
        dh = np.where(m, 0, dh) + z @ wh.T
        dc = np.where(m, 0, dc) + dct * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def _inputs(w: dict, b: Batch) -> np.ndarray:
    words = _sums(w["word"], b.words, b.word_at) / np.maximum(np.diff(b.word_at), 1)[:, None]
    return np.concatenate([_sums(w["path"], b.paths, b.path_at), words, b.measures], 1).astype(np.float32)


def _padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, batch, size) with its mask, and the place of each flat row in it."""
    steps = int(sizes.max(initial=0))
    at = np.concatenate([[0], np.cumsum(sizes)])
    page = np.repeat(np.arange(len(sizes)), sizes)
    place = (np.arange(len(x)) - at[page]) * len(sizes) + page
    out = np.zeros((steps * len(sizes), x.shape[1]), np.float32)
    out[place] = x
    mask = np.zeros(steps * len(sizes), bool)
    mask[place] = True
    return out.reshape(steps, len(sizes), -1), mask.reshape(steps, len(sizes)), place


def _forward(w: dict, b: Batch, keep: bool = False):
    flat = _inputs(w, b)
    x, mask, place = _padded(flat, b.sizes)
    forward, tf = _lstm(x, mask, w["xf"], w["hf"], w["cf"], keep)
    back, tb = _lstm(x[::-1], mask[::-1], w["xb"], w["hb"], w["cb"], keep)
    states = np.concatenate([forward, back[::-1]], 2).reshape(-1, 2 * HIDDEN)[place]
    logit = np.concatenate([states, flat], 1) @ w["out"] + w["bias"][0]
    return logit, (flat, x, place, tf, tb, states)


def _gradients(w: dict, b: Batch, y: np.ndarray) -> tuple[float, dict]:
    logit, (flat, x, place, tf, tb, states) = _forward(w, b, keep=True)
    p = _sig(logit)
    loss = float(-np.mean(np.where(y, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    d = ((p - y) / len(b.sizes)).astype(np.float32)
    g = {"out": np.concatenate([states, flat], 1).T @ d, "bias": np.array([d.sum()], np.float32)}
    dall = d[:, None] * w["out"][None, :]
    dstate = np.zeros((x.shape[0] * x.shape[1], 2 * HIDDEN), np.float32)
    dstate[place] = dall[:, : 2 * HIDDEN]
    dstate = dstate.reshape(x.shape[0], x.shape[1], -1)
    dxf, g["xf"], g["hf"], g["cf"] = _lstm_back(dstate[:, :, :HIDDEN], x, tf, w["xf"], w["hf"])
    dxb, g["xb"], g["hb"], g["cb"] = _lstm_back(dstate[::-1, :, HIDDEN:], x[::-1], tb, w["xb"], w["hb"])
    dflat = dall[:, 2 * HIDDEN :] + (dxf + dxb[::-1]).reshape(-1, x.shape[2])[place]
    g["path"], g["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
    n = np.diff(b.path_at)
    np.add.at(g["path"], b.paths, np.repeat(dflat[:, :PATH_DIM], n, axis=0))
    n = np.diff(b.word_at)
    np.add.at(g["word"], b.words, np.repeat(dflat[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(n, 1)[:, None], n, axis=0))
    return loss, g


# training pages


class Layouts:
    """Pages of invented words with the label of every block."""

    def __init__(self, seed: int):
        r = self.r = random.Random(seed)
        letters = ["bcdfghklmnprstvwz", "aeiouäéóîñ"]
        self.syllables = ["".join(r.choice(letters[i % 2]) for i in range(r.randint(2, 3))) for _ in range(120)]

    def low(self) -> str:
        """An invented word; there are so many that none is learnt by heart."""
        r = self.r
        return "".join(r.choice(self.syllables) for _ in range(r.choice([1, 1, 2, 2, 3])))

    def text(self, lo: int, hi: int) -> str:
        """Sentences of lo to hi words in all, perhaps with inline tags and character references."""
        r = self.r
        w = [self.low() for _ in range(r.randint(lo, hi))]
        if r.random() < 0.12:
            # odd prose is prose all the same
            w = r.choice([
                lambda: [x for x in w[: r.randint(1, 9)] for _ in range(r.randint(2, 30))],
                lambda: [x.upper() + "!!" for x in w],
                lambda: [x for y in w for x in (y, "|")],
                lambda: [x + r.choice(["###", "%%%", "***", "$$$", "&&&"]) for x in w],
                lambda: [x if r.random() < 0.5 else str(r.randint(0, 99999)) for x in w],
            ])()
        for i in range(len(w)):
            if i == 0 or w[i - 1].endswith("."):
                w[i] = w[i].capitalize()
            if r.random() < 0.1:
                w[i] += r.choice([".", ",", ".", "!", "?"])
        if r.random() < 0.7:
            w[-1] += "."
        if r.random() < 0.1:
            i = r.randrange(len(w))
            w[i] = r.choice(["<b>{}</b>", "<i>{}</i>", "<a href='/x'>{}</a>", "<em>{}</em>", "&amp; {}", "&quot;{}&quot;"]).format(w[i])
        return " ".join(w)

    def word(self) -> str:
        return self.low().capitalize()

    def links(self, n: int) -> str:
        r = self.r
        item = r.choice(["<li><a href='/{0}'>{0}</a></li>", "<a href='/{0}'>{0}</a> | ", "<li><a href='/{0}'>{0}</a>", "<div><a href='/{0}'>{0}</a></div>"])
        body = "".join(item.format(" ".join(self.word() for _ in range(r.choice([1, 1, 1, 2, 4])))) for _ in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def named(self, tags: str, names: str, plain: float = 0.15) -> tuple[str, str]:
        """An opening and a closing tag, mostly with a class or id that tells."""
        r = self.r
        t = r.choice(tags.split())
        if r.random() < plain and t != "div":
            return f"<{t}>", f"</{t}>"
        n = r.choice(names.split())
        n = r.choice([n, f"{n}-{self.word().lower()}", f"{self.word().lower()}-{n}", n.capitalize()])
        return f"<{t} {r.choice(['class', 'class', 'id'])}=\"{n}\">", f"</{t}>"

    def junk(self, kind: str) -> str:
        """A region outside the article."""
        r = self.r
        short = lambda: self.text(2, 25)
        if kind == "menu":
            a, b = self.named("nav div ul nav", "nav menu navigation navbar topnav breadcrumb breadcrumbs")
            return a + self.links(r.randint(2, 12)) + b
        if kind == "header":
            a, b = self.named("header div header", "header masthead banner topbar site-header logo")
            return a + r.choice([f"<h1>{self.word()}</h1>", f"<a href='/'>{self.word()}</a>", f"<div>{self.word()} {self.word()}</div>", f"<p>{short()}</p>"]) + r.choice(["", f"<p>{short()}</p>", self.junk("menu")]) + b
        if kind == "footer":
            a, b = self.named("footer div footer", "footer copyright legal site-footer colophon bottom")
            return a + r.choice([f"&copy; {self.word().lower()}.example &middot; {short()}", f"<p>&copy; 2024 {self.word()}</p>", f"<p>{short()}</p><p>{short()}</p>", self.links(r.randint(2, 6)), f"<small>{short()}</small>"]) + b
        if kind == "sidebar":
            a, b = self.named("aside div section", "sidebar widget related recommended popular trending side more-stories rail", 0.3)
            return a + "".join(r.choice([f"<h3>{self.word()}</h3>", self.links(r.randint(2, 6)), f"<p>{short()}</p>", f"<div>{short()}</div>"]) for _ in range(r.randint(1, 4))) + b
        if kind == "notice":
            a, b = self.named("div section p div", "cookie cookies consent notice gdpr banner alert popup modal overlay newsletter paywall privacy", 0)
            words = r.choice(["We use cookies to improve your visit. ", "This site uses cookies. ", "Wir verwenden Cookies. ", "Nous utilisons des cookies. ", "Usamos cookies. ", "Please subscribe. ", "", "", ""])
            return a + words + short() + r.choice(["", "<button>OK</button>", "<a href='#'>" + self.word() + "</a>"]) + b
        if kind == "advert":
            a, b = self.named("div aside div section ins", "ad ads advert advertisement sponsor sponsored promo banner adsbox partner", 0)
            return a + r.choice([short(), f"<p>{short()}</p>", f"<a href='/x'>{short()}</a>", f"{r.choice(['Advertisement', 'Sponsored', 'Anzeige', ''])} {short()}", f"<p>{short()}</p><p>{self.text(10, 60)}</p>"]) + b
        if kind == "form":
            a, b = self.named("form form form div", "search form subscribe login signup contact newsletter", 0.5)
            return a + "".join(r.choice([f"<label>{self.word()}</label><input name='x'>", f"<button>{self.word()}</button>", f"<p>{short()}</p>", f"<select><option>{self.word()}</option><option>{self.word()}</option></select>", f"<textarea>{short()}</textarea>", f"<legend>{self.word()}</legend>"]) for _ in range(r.randint(1, 4))) + b
        if kind == "share":
            a, b = self.named("div ul div", "share social tags byline meta toolbar pagination author-box", 0)
            return a + r.choice([self.links(r.randint(1, 5)), self.word(), f"<span>{self.word()}</span> <span>{self.word()}</span>"]) + b
        a, b = self.named("section div ol ul div", "comments comment-list discussion responses replies disqus comment reader-comments", 0)
        tag = "li" if a[1:3] in ("ol", "ul") else r.choice(["div", "article", "div"])
        one = lambda: f"<{tag} class=\"comment\">" + r.choice([f"<b>{self.word()}</b>", f"<span class='author'>{self.word()}</span>", f"<h4>{self.word()}</h4>", ""]) + f"<p>{self.text(3, 60)}</p></{tag}>"
        return a + r.choice(["", "<h3>Comments</h3>", f"<h3>{self.word()}</h3>", "<h2>3 Comments</h2>"]) + "".join(one() for _ in range(r.randint(1, 5))) + b

    def article(self) -> str:
        """The article; its blocks begin with a mark, which page() takes out."""
        r = self.r
        mark = "\x01"
        a, b = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), self.named("div section article", "content article post entry story main-content body text page-content", 0.2), ("<main><article>", "</article></main>"), ("<div id='content'><div class='post'>", "</div></div>"), ("<article itemprop='articleBody'>", "</article>")])
        out = [a]
        if r.random() < 0.85:
            h = f"<{(h := r.choice(['h1', 'h1', 'h1', 'h2']))}>{mark}{self.text(2, 14)}</{h}>"
            out.append(r.choice([h, h, h, f"<header>{h}</header>"]))
        if r.random() < 0.15:
            out.append(self.junk("share"))
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.62:
                out.append(f"<p>{mark}{self.text(1, r.choice([120, 120, 120, 120, 40, 40, 6, 2, 1]))}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif x < 0.72:
                out.append(f"<p><b>{mark}{self.text(5, 60)}<br>")
            elif x < 0.78:
                out.append(f"<{(h := r.choice(['h2', 'h3']))}>{mark}{self.text(1, 9)}</{h}>")
            elif x < 0.83:
                out.append("<ul>" + "".join(f"<li>{mark}{self.text(1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.86:
                out.append(f"<blockquote>{r.choice(['', '<p>'])}{mark}{self.text(4, 40)}</blockquote>")
            elif x < 0.89:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark}{self.text(1, 4)}</td>" for _ in range(r.randint(1, 3))) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.91:
                out.append(f"<pre>{mark}{self.text(3, 30)}</pre>")
            elif x < 0.93:
                out.append(f"<div>{mark}{self.text(5, 60)}</div>")
            else:
                out.append(self.junk(r.choice(["advert", "share", "form", "sidebar", "notice", "advert"])))
        if r.random() < 0.1:
            out.append(self.junk(r.choice(["comments", "share", "form"])))
        return "".join(out) + b

    def page(self) -> tuple[list[Block], np.ndarray]:
        r = self.r
        around = lambda kinds, p: "".join(self.junk(k) for k in kinds if r.random() < p)
        before = ["header", "menu", "notice", "advert", "sidebar", "form"]
        after = ["comments", "sidebar", "advert", "form", "notice", "menu", "footer"]
        if r.random() < 0.4:
            r.shuffle(before)
        if r.random() < 0.3:
            r.shuffle(after)
        body = around(before, 0.5) + self.article() + around(after[:-1], 0.3) + (self.junk(after[-1]) if r.random() < 0.75 else "")
        if r.random() < 0.2:
            body = f"<div class='{r.choice(['wrapper', 'container', 'page', 'layout'])}'>{body}</div>"
        found = blocks(f"<html><head><title>{self.word()}</title></head><body>{body}</body></html>")
        y = np.array([b.text.startswith("\x01") for b in found])
        for b in found:
            b.text = b.text.replace("\x01", "") or "."
        return found, y


@lru_cache(maxsize=2)
def trained(seed: int = 11, pages: int = 2400, epochs: int = 4, size: int = 32) -> dict[str, np.ndarray]:
    """The weights after training on generated pages, the same for the same arguments."""
    layouts, rng = Layouts(seed), np.random.default_rng(seed)
    data = [layouts.page() for _ in range(pages)]
    w = new_weights(rng)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    # pages of like length together, so that little is padded
    order = sorted(range(pages), key=lambda i: len(data[i][0]))
    batches = [(Batch([data[i][0] for i in part]), np.concatenate([data[i][1] for i in part])) for part in (order[k : k + size] for k in range(0, pages, size))]
    step, total = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)).tolist():
            step += 1
            _, g = _gradients(w, *batches[k])
            rate = 0.01 * (1 - 0.9 * step / total)
            for n in w:
                d = np.clip(g[n], -1, 1)
                m[n] = 0.9 * m[n] + 0.1 * d
                v[n] = 0.99 * v[n] + 0.01 * d * d
                w[n] = w[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-6)
    return {k: x.astype(np.float32) for k, x in w.items()}


# operator

#: Blocks, padding included, that the network takes at a time.
STEP_BLOCKS = 1 << 15


def label(w: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of each block of each page to belong to the article."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= STEP_BLOCKS and hi - lo < 256:
            hi += 1
        part = order[lo:hi]
        b = Batch([pages[i] for i in part])
        p = _sig(_forward(w, b)[0])
        for i, x in zip(part, np.split(p, np.cumsum(b.sizes)[:-1]), strict=True):
            out[i] = x
        lo = hi
    return out


def main_text(w: dict, pages: list[str]) -> list[str]:
    """The texts of the article's blocks of each page, joined by line breaks."""
    split = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, x in zip(bs, p, strict=True) if x >= 0.5) for bs, p in zip(split, label(w, split), strict=True)]


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from the whole html. No shuffle; one row per input row.

    A null or empty html, and a page without article, have an empty text; an empty table gives no rows. Null ids and
    urls and repeated rows are kept as they are; other columns, one named text among them, are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or trained())

    def work(batch, texts):
        out = main_text(shared.value, [t.decode("utf-8", "replace") for t in texts])
        return {"page_id": column(batch, "page_id"), "url": column(batch, "url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())}

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_texts(pages, ["page_id", "url", F.col("html").alias("html")], f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint", work, text="html")
