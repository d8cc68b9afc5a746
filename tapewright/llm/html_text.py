"""HTML main text by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags,
each with the innermost open element above it; elements know their parents, so
that a page nested n deep takes n links and not n paths. Every block is a vector of
the hashed elements of its whole path (tag, class, id and role words), all its
hashed words and a few statistics. A bidirectional LSTM in numpy reads the whole
sequence of a page, however long, so that each block is classified by what
stands before and after it.

Training needs no given labels: on a bounded sample of pages (FIT_PAGES, by a
hash of the id; of a page of over FIT_BLOCKS blocks a stretch of so many, whose
place the id's hash picks) blocks get the label that their ancestors say: inside
an article or main element, and in no menu, header, footer, aside, form, advert,
notice or comment list; a header inside an article holds its title and belongs
to it. Pages without such an element are not learned from. A page is shown as it
is, with those names hidden, so that the model also learns from words, lengths
and order, and renamed: with other names of the same kinds (MAIN, MAIN_WORDS,
OTHER, OTHER_WORDS), further wrappers, captions, shortened blocks, and a stretch
of the article turned into reader comments. If no page can be learned from, every block without
an ancestor of the other kind counts as main.

Pages are read in one forward scan, in time linear in their length whatever is
unclosed in them. Script, style, template and other elements that hold no prose are
left out while reading, as are comments (`<!-->` and `<!--->` are empty ones) and the
lists of form controls, which end where anything else begins; a self-closed svg is
empty, and an element whose name only begins like one of these is read like any
other, as are object and noscript. A tag that never ends is text. Character references
are decoded in each text by itself, also those without a semicolon as HTML defines
them. A page without main text, without text or null gives the empty string. An
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample
from .shingles import word_hashes

FIT_PAGES = 250
FIT_BLOCKS = 200
BATCH_BLOCKS = 20_000  # blocks turned into vectors together
RENAMED = 12  # renamed copies of a training page
PATH_DIM, WORD_DIM, STATS_DIM, HIDDEN = 224, 24, 8, 16
DIM = PATH_DIM + WORD_DIM + STATS_DIM

#: Elements without prose, skipped with all they hold. An unclosed one of the first kind takes the rest of the page, as in browsers; of the second it is read.
_TEXT_ONLY = frozenset("script style textarea title iframe".split())
_MARKUP_ONLY = frozenset("svg template".split())
#: Controls of forms that hold a list and not prose; what else begins inside one closes it.
_LIST_BOXES = frozenset("select option optgroup".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_TAG_END = re.compile(r"""[>]|=\s*(["'])""")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _TEXT_ONLY | _MARKUP_ONLY}
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What opening one of these closes if it is the innermost open block.
CLOSES = {"li": {"li", "p"}, "p": {"p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
BLOCK_ENDS_P = frozenset("div article section ul ol table form h1 h2 h3 h4 h5 h6 header footer nav aside main blockquote pre figure dl hr".split())
MAIN = frozenset("article main".split())
OTHER = frozenset("nav header footer aside form button menu dialog".split())
MAIN_WORDS = frozenset("article main content post entry story body".split())
OTHER_WORDS = frozenset(
    "nav navigation navbar menu header footer sidebar aside ad ads advert advertisement promo sponsor sponsored banner notice cookie consent "
    "comment comments reply replies breadcrumb breadcrumbs form login signup subscribe newsletter popup modal".split()
)


class Page:
    """The leaf blocks of one page: texts, link characters and elements, which are linked to their parents."""

    def __init__(self):
        self.texts: list[str] = []
        self.links: list[int] = []  # characters inside links, by block
        self.at: list[int] = []  # innermost element, by block
        self.names: list[str] = [""]  # by element: tag and its class, id and role words; 0 is the page itself
        self.parent: list[int] = [-1]

    def path(self, block: int) -> list[str]:
        """The elements above a block, outermost first."""
        out, e = [], self.at[block]
        while e > 0:
            out.append(self.names[e])
            e = self.parent[e]
        return out[::-1]

    def labels(self) -> list[int | None]:
        """By block: 1 in main content, 0 in what surrounds it, None if no ancestor says so."""
        said: list[int | None] = [None]
        for e in range(1, len(self.names)):
            said.append(_said(self.names[e], said[self.parent[e]]))
        return [said[e] for e in self.at]


def _said(element: str, above: int | None) -> int | None:
    """What an element says of the blocks in it, given what its parent says."""
    tag, *words = element.split(" ")
    if above == 0:
        return 0
    main = tag in MAIN or not MAIN_WORDS.isdisjoint(words)
    if tag == "header" or ("header" in words and OTHER_WORDS.isdisjoint(set(words) - {"header"})):
        return 1 if above == 1 or (main and tag != "header") else 0
    if tag in OTHER or not OTHER_WORDS.isdisjoint(words):
        return 0
    return 1 if above == 1 or tag in MAIN or (tag in ("div", "section") and main) else None


class Reader:
    """One forward scan over a page. What is known to be absent from some place on is not looked for again, so time is linear in any page."""

    def __init__(self, page: str):
        self.page = page
        self.absent: set[str] = set()  # what no longer follows
        self.quoted = True  # whether quotes may hide a `>`

    def find(self, what: str, at: int) -> int:
        """Where `what` next stands, or -1."""
        found = -1 if what in self.absent else self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag, or -1. A `>` inside a quoted value ends none, unless no other follows."""
        if self.find(">", at) < 0:
            return -1
        place = at
        while self.quoted:
            m = _TAG_END.search(self.page, place)
            if m is None:
                self.quoted = False
            elif m[1] is None:
                return m.start()
            else:
                close = self.find(m[1], m.end())
                place = m.end() if close < 0 else close + 1
        return self.find(">", at)

    def skipped(self, name: str, at: int) -> int:
        """The place behind the end tag of an element without prose, or -1 if it is unclosed."""
        key = f"</{name}"
        m = None if key in self.absent else _CLOSERS[name].search(self.page, at)
        if m is None:
            self.absent.add(key)
            return -1
        end = self.find(">", m.end())
        return len(self.page) if end < 0 else end + 1

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """("text", characters, ""), ("open", tag, attributes) and ("close", tag, "") in the order of the page."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            start = self.find("<", at)
            if start != at:
                yield "text", page[at : start if start >= 0 else n], ""
            if start < 0:
                return
            at, mark = start + 1, page[start + 1 : start + 2]
            if page.startswith("!--", at):
                if page.startswith(">", start + 4) or page.startswith("->", start + 4):
                    at = page.index(">", start + 4) + 1
                    continue
                ends = [(e, k) for k in ("-->", "--!>") if (e := self.find(k, start + 4)) >= 0]
                at = min(e + len(k) for e, k in ends) if ends else n
                continue
            m = _NAME.match(page, start)
            if m is None:
                end = self.find(">", at) if mark in ("!", "?") else -1
                if end < 0:
                    yield "text", "<", ""
                else:
                    at = end + 1
                continue
            end = self.tag_end(m.end())
            if end < 0:
                yield "text", "<", ""
                continue
            at, tag, attributes = end + 1, m[2].lower(), page[m.end() : end]
            if m[1]:
                yield "close", tag, ""
            elif tag not in _CLOSERS:
                yield "open", tag, attributes
            elif not (tag == "svg" and attributes.endswith("/")):
                behind = self.skipped(tag, at)
                if behind >= 0:
                    at = behind
                elif tag in _TEXT_ONLY:
                    at = n
                else:
                    yield "open", tag, attributes


def blocks(page: str | None) -> Page:
    """Read a page."""
    out = Page()
    stack: list[int] = [0]  # open elements
    opened: Counter[str] = Counter()  # how many of a tag are open
    tags: list[str] = [""]
    parts: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush():
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.texts.append(text)
                out.links.append(links)
                out.at.append(at)
        parts, links = [], 0

    def close():
        opened[tags.pop()] -= 1
        stack.pop()

    for kind, tag, attributes in Reader(page or "").tokens():
        if kind == "text":
            if tags[-1] in _LIST_BOXES:
                continue
            if not parts:
                at = stack[-1]
            parts.append(html.unescape(tag))
            if in_link:
                links += len(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if kind == "close":
            if tag in INLINE:
                in_link -= tag == "a" and in_link > 0
                continue
            flush()
            if opened[tag] > 0:
                while tags[-1] != tag:
                    close()
                close()
            in_link = 0
            continue
        while tags[-1] in _LIST_BOXES and (tag not in _LIST_BOXES or tag == "select"):
            close()
        if tag in INLINE:
            in_link += tag == "a"
            continue
        flush()
        if tag in VOID or attributes.endswith("/"):
            continue
        closed = CLOSES.get(tag, {"p"} if tag in BLOCK_ENDS_P else ())
        while tags[-1] in closed:
            close()
        words = [w for a in ATTRIBUTE.finditer(attributes) for w in WORDS.findall((a[1] or a[2] or a[3] or "").lower())] if attributes else []
        out.names.append(" ".join([tag, *words]))
        out.parent.append(stack[-1])
        stack.append(len(out.names) - 1)
        tags.append(tag)
        opened[tag] += 1
    flush()
    return out


def renamed(page: Page, labels: list[int], rng: np.random.Generator) -> tuple[Page, list[int]]:
    """The page with other names of the same kinds, and what pages elsewhere have: wrappers, captions, comments."""
    out = Page()
    labels, shortened = list(labels), rng.random(len(labels)) < 0.15
    out.texts = [" ".join(t.split(" ")[: int(rng.integers(1, 6))]) if s else t for t, s in zip(page.texts, shortened)]
    out.links = [min(v, len(t)) for v, t in zip(page.links, out.texts)]
    mains, others = sorted(MAIN_WORDS), sorted(OTHER_WORDS)
    as_main = ["article", "main", *(f"{t} {a}" for t in ("div", "section") for a in mains)]
    as_other = [f"{t} {a}" for t in ("div", "section", "ul", "p") for a in others]
    said: list[int | None] = [None]
    moved = [0]  # new element of each old one
    for e in range(1, len(page.names)):
        above, name = page.parent[e], page.names[e]
        said.append(_said(name, said[above]))
        if said[e] != said[above]:
            name = str(rng.choice(as_main if said[e] == 1 else sorted(OTHER) if rng.random() < 0.4 else as_other))
        top = moved[above]
        for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.1 else 0):
            out.names.append(str(rng.choice(["div", "div", "section", "div row", "div wrap"])))
            out.parent.append(top)
            top = len(out.names) - 1
        out.names.append(name)
        out.parent.append(top)
        inner = len(out.names) - 1
        for _ in range(int(rng.integers(1, 40)) if said[e] != said[above] and rng.random() < 0.3 else 0):
            out.names.append("div")
            out.parent.append(inner)
            inner = len(out.names) - 1
        moved.append(inner)
    out.at = [moved[e] for e in page.at]
    inside = [i for i, v in enumerate(labels) if v == 1]

    def under(block: int, name: str) -> None:
        out.names.append(name)
        out.parent.append(out.at[block])
        out.at[block] = len(out.names) - 1

    for i in inside:
        if rng.random() < 0.08:
            under(i, str(rng.choice(["figcaption", "figure", "header", "blockquote", "table", "div related", "div text"])))
    for i in inside:  # adverts and notices between the paragraphs
        if rng.random() < 0.04:
            under(i, str(rng.choice([*sorted(OTHER - {"header"}), *(f"{t} {a}" for t in ("div", "p") for a in others if a != "header")])))
            labels[i] = 0
    if len(inside) > 4 and rng.random() < 0.5:
        start = int(rng.integers(len(inside) // 2, len(inside)))
        for i in inside[start:]:
            under(i, str(rng.choice(["aside", "form", "div comment", "div comments", "div reply", "div replies", "section comments"])))
            labels[i] = 0
    return out, labels


def _hash(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h ^ h >> 15


_elements: dict[tuple[str, bool], np.ndarray] = {}


def _element(name: str, hide: bool) -> np.ndarray:
    """The hashed tag and words of one element."""
    if (name, hide) not in _elements:
        if len(_elements) > 100_000:
            _elements.clear()
        row = np.zeros(PATH_DIM, np.float32)
        for j, word in enumerate(name.split(" ")):
            if hide and (j or word in MAIN or word in OTHER):
                word = "div"
            h = _hash(("." if j else "<") + word)
            row[(h >> 1) % PATH_DIM] += 1.0 if h & 1 else -1.0
        _elements[name, hide] = row
    return _elements[name, hide]


def vectors(page: Page, hide: bool = False) -> np.ndarray:
    """One row per block. `hide` leaves out the names that say what a block is."""
    n = len(page.texts)
    x = np.zeros((n, DIM), np.float32)
    if not n:
        return x
    sums, depth = np.zeros((len(page.names), PATH_DIM), np.float32), np.zeros(len(page.names))
    for e in range(1, len(page.names)):
        above = page.parent[e]
        sums[e], depth[e] = sums[above] + _element(page.names[e], hide), depth[above] + 1
    at = np.array(page.at)
    x[:, :PATH_DIM] = sums[at] / (1 + np.abs(sums[at]) / 4)  # what is nested very deep fades in the count of its like only
    words, first = word_hashes(page.texts)
    counts = np.diff(first)
    of = np.repeat(np.arange(n), counts)
    slots = np.zeros((n, WORD_DIM), np.float32)
    np.add.at(slots, (of, (words >> np.uint64(1)) % np.uint64(WORD_DIM)), np.where(words & np.uint64(1), 1.0, -1.0))
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = slots / (2 + np.sqrt(counts))[:, None]
    place, size = np.arange(n), np.array([len(t) for t in page.texts])
    marks = np.array([t.count(". ") + t.count(", ") + t.count("; ") + (t[-1] in ".,;") for t in page.texts])
    x[:, PATH_DIM + WORD_DIM :] = np.stack(
        [np.log1p(counts) / 4, np.minimum(np.array(page.links) / size, 1), [t[-1] in ".!?:\"”" for t in page.texts], ["©" in t for t in page.texts],
         marks / np.maximum(counts, 1), place / n, (n - 1 - place) / n, np.log1p(depth[at]) / 2], axis=1,
    )
    return x


class BiLSTM:
    """One bidirectional LSTM layer and a logistic output per step."""

    def __init__(self, dim: int = DIM, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.learned = False
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p["w" + side] = rng.standard_normal((dim + hidden, 4 * hidden)).astype(np.float32) / np.sqrt(dim + hidden)
            self.p["b" + side] = np.zeros(4 * hidden, np.float32)
            self.p["b" + side][hidden : 2 * hidden] = 1.0  # forget gate
        self.p["wo"] = rng.standard_normal((2 * hidden + dim, 1)).astype(np.float32) * 0.1
        self.p["bo"] = np.zeros(1, np.float32)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: (steps, pages, dim), time-ordered for this direction."""
        w, b, n = self.p["w" + side], self.p["b" + side], self.h
        h, c = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
        drive = x @ w[: x.shape[2]] + b
        out, memory = np.zeros((len(x), x.shape[1], n), np.float32), []
        for t in range(len(x)):
            a = drive[t] + h @ w[x.shape[2] :]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * n], -30, 30)))
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(a[:, 3 * n :])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                memory.append((h, c, i, f, o, g, tc))
            h, c = h2, c2
            out[t] = h
        return out, memory

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forth, mf = self._run("f", x, mask, keep)
        back, mb = self._run("b", x[::-1], mask[::-1], keep)
        joined = np.concatenate([forth, back[::-1], x], axis=2)
        p = 1 / (1 + np.exp(-np.clip(joined @ self.p["wo"] + self.p["bo"], -30, 30)))[..., 0]
        return p, joined, mf, mb

    def _back(self, side: str, x: np.ndarray, mask: np.ndarray, d_out: np.ndarray, memory, grads) -> None:
        w, n, dim = self.p["w" + side], self.h, x.shape[2]
        gw, gb = np.zeros_like(w), np.zeros_like(self.p["b" + side])
        dh, dc = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
        for t in reversed(range(len(x))):
            h, c, i, f, o, g, tc = memory[t]
            m = mask[t][:, None]
            dh = dh + d_out[t]
            live, stay = np.where(m, dh, 0), np.where(m, 0, dh)
            dct = np.where(m, dc + live * o * (1 - tc * tc), 0)
            da = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            gw[:dim] += x[t].T @ da
            gw[dim:] += h.T @ da
            gb += da.sum(0)
            dh = stay + da @ w[dim:].T
            dc = np.where(m, dct * f, dc)
        grads["w" + side], grads["b" + side] = gw, gb

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 9) -> None:
        """pages: (vectors, labels of 0, 1 or -1 for unknown); Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, self.learned = 0, bool(pages)
        for _ in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][0]) + rng.random() * 4)
            groups = [order[k : k + batch] for k in range(0, len(order), batch)]
            for g in rng.permutation(len(groups)):
                x, mask, y = padded([pages[i] for i in groups[g]])
                p, joined, mf, mb = self.forward(x, mask, keep=True)
                known = mask & (y >= 0)
                d = (np.where(known, p - y, 0) / max(known.sum(), 1)).astype(np.float32)[..., None]
                grads = {"wo": np.einsum("tpk,tpo->ko", joined, d), "bo": d.sum((0, 1))}
                d_in = d @ self.p["wo"].T
                self._back("f", x, mask, d_in[..., : self.h], mf, grads)
                self._back("b", x[::-1], mask[::-1], d_in[::-1, :, self.h : 2 * self.h], mb, grads)
                step += 1
                for k, v in grads.items():
                    v = np.clip(v, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray], most: int = 60_000) -> list[np.ndarray]:
        """Probabilities per page; pages of like length run together, at most `most` padded blocks."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order, k = sorted(range(len(pages)), key=lambda i: -len(pages[i])), 0
        while k < len(order):
            longest = max(len(pages[order[k]]), 1)
            group = order[k : k + max(1, most // longest)]
            k += len(group)
            x, mask, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in group])
            p = self.forward(x, mask)[0]
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max([1, *(len(x) for x, _ in pages)])
    x, mask, y = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages)), bool), -np.ones((steps, len(pages)), np.float32)
    for j, (v, labels) in enumerate(pages):
        x[: len(v), j], mask[: len(v), j], y[: len(v), j] = v, True, labels
    return x, mask, y


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows per page: plain, with names hidden, and renamed; vectors as bytes and labels."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for page_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = blocks(text)
            said = page.labels()
            if 1 not in said:
                continue
            labels = [v or 0 for v in said]
            rng = np.random.default_rng(_hash(str(page_id)))
            start = int(rng.integers(0, max(len(labels) - FIT_BLOCKS, 0) + 1))
            shown = [(page, labels, False), (page, labels, True), *((*renamed(page, labels, rng), False) for _ in range(RENAMED))]
            for kind, (p, y, hide) in enumerate(shown):
                rows = slice(start, start + FIT_BLOCKS)
                for c, v in zip(out, (page_id, kind, vectors(p, hide)[rows].astype(np.float16).tobytes(), y[rows])):
                    c.append(v)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["id", "kind", "x", "y"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = FIT_PAGES) -> BiLSTM:
    """Train on a bounded sample of pages."""
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).where("html IS NOT NULL")
    found = bounded_sample(own, "id", rows).mapInArrow(_training_rows, "id long, kind int, x binary, y array<int>").toPandas()
    found = found.sort_values(["id", "kind"], kind="stable")
    model = BiLSTM()
    model.train([(np.frombuffer(x, np.float16).reshape(-1, DIM).astype(np.float32), np.asarray(y, np.float32)) for x, y in zip(found["x"], found["y"])])
    return model


def by_blocks(pages: Iterable[Page], most: int = BATCH_BLOCKS) -> Iterator[list[Page]]:
    """Pages in lists of at most `most` blocks and as many pages, or of one page."""
    held: list[Page] = []
    size = 0
    for page in pages:
        n = len(page.texts) + 1
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(page)
        size += n
    if held:
        yield held


def main_text(pages: DataFrame, model: BiLSTM, id_col: str = "page_id", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """(id, url, text, n_chars, n_blocks, n_main): the main text of every page."""
    weights, learned = model.p, model.learned

    @F.pandas_udf("text string, n_chars long, n_blocks long, n_main long")
    def extract(texts: pd.Series) -> pd.DataFrame:
        labeller = BiLSTM()
        labeller.p = weights
        rows = []
        for found in by_blocks(map(blocks, texts)):
            if learned:
                scores = labeller.label([vectors(b) for b in found])
            else:
                scores = [[float(v != 0) for v in b.labels()] for b in found]
            for page, p in zip(found, scores):
                kept = [t for t, v in zip(page.texts, p) if v >= threshold]
                text = "\n".join(kept)
                rows.append((text, len(text), len(page.texts), len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_chars", "n_blocks", "n_main"])

    return pages.select(id_col, "url", extract(F.col(html_col)).alias("_m")).select(id_col, "url", "_m.*")
