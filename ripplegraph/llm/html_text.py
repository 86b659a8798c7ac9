"""Main text of web pages by a recurrent block labeller.

A page's leaf blocks, in order, are vectors of hashed tag paths (with classes and ids) and hashed words; a bidirectional
LSTM in numpy reads the whole sequence and labels every block, so that a block is judged in the context of its page.
Blocks labelled as content are joined by one line feed.

The labeller is trained here, on the driver, on at most TRAIN_PAGES pages (those of the smallest hashes) and COPIES copies of
them with boilerplate of many kinds put in; training labels come from the semantic elements (article and main against
navigation, header, footer, aside, forms, adverts, notices, comments). Some copies keep the labels and lose the elements that told them:
their articles stand in plain divisions or table cells, as older sites have them. In the copies, blocks of the articles also stand as items of
lists, table cells, quotes, captions, headers of the article and paragraphs that are one link.

Cases: null and empty html, and pages without content, give the empty string; scripts, styles, comments and markup never count as text;
unclosed tags, comments and quotes end with the page; rows that repeat are treated alike; whole pages are read, however long and however
deep (time and memory grow with the page's length); an empty table gives an empty one; extra columns are not read."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, TRAIN_BYTES, COPIES = 150, 1 << 16, 5
PATH_SIZE, WORD_SIZE, HIDDEN = 128, 16, 16
WORDS = 40
SIZE = PATH_SIZE + WORD_SIZE + 4
EPOCHS, RATE, SEED = 30, 0.02, 7
#: Pages, and steps of padded sequences, that are labelled together.
PAGES_AT_ONCE, STEPS_AT_ONCE = 128, 1 << 14

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msub msup msubsup msqrt mroot mover munder semantics".split())
_RAW = frozenset("script style template iframe".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: An element that ends an open one of the same list.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: For training labels.
_CONTENT = frozenset(("article", "main"))
_NOISE = frozenset("nav header footer aside form button select dialog head menu ad ads advert advertisement banner sponsored promo sidebar comment comments reply replies disqus discussion respond notice cookie consent newsletter subscribe share social related breadcrumb breadcrumbs pagination widget popup modal navigation contentinfo complementary".split())


class Element:
    """An open element: its name, its own words (of class, id and role), what is around it, whether it is in a link; `sum`, the vector of its whole path, is made once."""

    __slots__ = ("name", "up", "linked", "own", "sum")

    def __init__(self, name: str, extra: tuple[str, ...], up: Element | None) -> None:
        self.name, self.up = name, up
        self.linked = name == "a" or (up is not None and up.linked)
        self.own = () if name in _INLINE else (name, *extra)
        self.sum: np.ndarray | None = None

    def path(self) -> tuple[str, ...]:
        """The words of all elements around, the outermost first."""
        chain, e = [], self
        while e is not None:
            chain.append(e.own)
            e = e.up
        return tuple(t for own in reversed(chain) for t in own)

    def vector(self) -> np.ndarray:
        """The hashed words of the whole path: those of the elements around are added up once."""
        chain, e = [], self
        while e is not None and e.sum is None:
            chain.append(e)
            e = e.up
        total = np.zeros(PATH_SIZE, dtype=np.float32) if e is None else e.sum
        for e in reversed(chain):
            if e.own:
                total = total + path_vector(e.own)
            e.sum = total
        return total


def path_vector(words: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_SIZE, dtype=np.float32)
    for t in words:
        h = zlib.crc32(t.encode())
        out[h % PATH_SIZE] += 1 if h & 0x10000 else -1
    return out


class Block(NamedTuple):
    """A block's innermost element, its text and the share of it in links; words: a path in place of the element's, for training."""

    element: Element
    text: str
    links: float
    words: tuple[str, ...] | None = None

    @property
    def path(self) -> tuple[str, ...]:
        return self.element.path() if self.words is None else self.words


_ROOT = Element("b", (), None)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. The cost of a tag does not depend on how deep it stands: an end tag of which no element is open is passed over."""
    out: list[Block] = []
    stack: list[Element] = [_ROOT]
    is_open: Counter[str] = Counter()
    text: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        plain = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if plain:
            out.append(Block(stack[-1], plain, min(1.0, linked / max(1, len(plain)))))
        text.clear()
        linked = 0

    def close(names: tuple[str, ...], until: frozenset[str] = frozenset()) -> None:
        if not any(is_open[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                is_open.subtract(e.name for e in stack[i:])
                del stack[i:]
                return
            if stack[i].name in until:
                return

    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        text.append(piece)
        if piece and stack[-1].linked:
            linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            flush()
        else:
            text.append(" " if name == "br" else "")
        if m[1] or m[4]:
            close((name,))
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _ENDS_P:
            close(("p",), frozenset(("article", "td", "div", "section", "button")))
        if name in _CLOSES and name != "p":
            close(_CLOSES[name], frozenset(("ul", "ol", "table", "dl", "select")))
        if name not in _VOID and not (m[3] or m[6] or "").endswith("/"):
            extra = tuple(t for x in _NAMES.findall(m[3] or m[6] or "") for t in _PARTS.findall("".join(x).lower()))
            stack.append(Element(name, extra, stack[-1]))
            is_open[name] += 1
    flush()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), SIZE), dtype=np.float32)
    for i, b in enumerate(page):
        x[i, :PATH_SIZE] = b.element.vector() if b.words is None else path_vector(b.words)
        words = b.text.lower().split(" ")
        # From WORDS words on, divided by the root of their number: sums of long blocks spread no wider.
        unit = 0.2 / max(1.0, (len(words) / WORDS) ** 0.5)
        for w in words:
            h = zlib.crc32(w.encode())
            x[i, PATH_SIZE + h % WORD_SIZE] += unit if h & 0x10000 else -unit
        n = len(b.text)
        x[i, -4:] = b.links, np.log1p(n) / 8, sum(b.text.count(c) for c in ".,;!?") / (1 + n / 20), i / len(page)
    return np.clip(x, -2, 2)


def weak_label(path: tuple[str, ...]) -> float:
    """Content and no noise around; the header of an article is its own."""
    at = next((i for i, t in enumerate(path) if t in _CONTENT), None)
    return float(at is not None and not _NOISE & ({*path[:at], *path[at:]} - ({"header"} if "header" not in path[:at] else set())))


class Labeller:
    """A bidirectional LSTM with one logistic output for each step."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w["x" + d] = (r.standard_normal((SIZE, 4 * HIDDEN)) / np.sqrt(SIZE)).astype(np.float32)
            self.w["h" + d] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.w["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.w["o"] = (r.standard_normal(2 * HIDDEN + SIZE) / 8).astype(np.float32)
        self.w["ob"] = np.zeros(1, dtype=np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction; x: steps, pages, features. Padding leaves a state as it is."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, entry = np.zeros((steps, n, HIDDEN), np.float32), x @ self.w["x" + d] + self.w["c" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = entry[t] + h @ self.w["h" + d]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            tanh = np.tanh(new_c)
            new_h = np.where(m, o * tanh, h)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            h, c = new_h, new_c
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask), self._run("b", x, mask), x], axis=2)
        return both @ self.w["o"] + self.w["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        hs = {d: self._run(d, x, mask, kept[d]) for d in "fb"}
        both = np.concatenate([hs["f"], hs["b"], x], axis=2)
        error = (1 / (1 + np.exp(-(both @ self.w["o"] + self.w["ob"]))) - y) * mask / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"], g["ob"] = np.tensordot(error, both, axes=([0, 1], [0, 1])), np.array([error.sum()], dtype=np.float32)
        for n, d in enumerate("fb"):
            up = error[:, :, None] * self.w["o"][n * HIDDEN : (n + 1) * HIDDEN]
            dh, dc = np.zeros_like(kept[d][0][1]), np.zeros_like(kept[d][0][1])
            for t, h, c, i, f, o, gate, tanh, m in reversed(kept[d]):
                dh = dh + up[t]
                live, dc_in = np.where(m, dh, 0), dc + np.where(m, dh * o * (1 - tanh**2), 0)
                dz = np.where(m, np.concatenate([dc_in * gate * i * (1 - i), dc_in * c * f * (1 - f), live * tanh * o * (1 - o), dc_in * i * (1 - gate**2)], axis=1), 0)
                g["x" + d] += x[t].T @ dz
                g["h" + d] += h.T @ dz
                g["c" + d] += dz.sum(axis=0)
                dh = np.where(m, dz @ self.w["h" + d].T, dh)
                dc = np.where(m, dc_in * f, dc)
        return g

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE) -> Labeller:
        """Adam on batches of pages of a like length."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        batches = [packed([pages[i] for i in order[k : k + 32]]) + (padded([labels[i] for i in order[k : k + 32]]),) for k in range(0, len(order), 32)]
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        r, step = np.random.default_rng(SEED), 0
        for epoch in range(epochs):
            for k in r.permutation(len(batches)):
                g, step = self.gradients(*batches[k]), step + 1
                now = rate * (1 - epoch / epochs) + 1e-4
                for name, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * v
                    second[name] = 0.99 * second[name] + 0.01 * v * v
                    self.w[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def padded(labels: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((max(map(len, labels)), len(labels)), dtype=np.float32)
    for i, y in enumerate(labels):
        out[: len(y), i] = y
    return out


def packed(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), SIZE), dtype=np.float32), np.zeros((steps, len(pages)), dtype=bool)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, True
    return x, mask


#: What stands for the article's element in a copy: by its name, by a class, or by nothing but the layout.
_ARTICLES = (("article",), ("main",), ("div", "content"), ("div", "post"), ("section", "entry"), ("div",), ("table", "tr", "td"), ("table", "tbody", "tr", "td"))


#: How blocks of an article may stand in it, besides paragraphs.
_FORMS = (("ul", "li"), ("ul", "li"), ("ol", "li"), ("table", "tr", "td"), ("table", "tbody", "tr", "th"), ("blockquote", "p"), ("dl", "dd"), ("figure", "figcaption"), ("header", "h1"), ("header", "p"), ("section", "h2"), ("h3",), ("pre",), ("div", "p"), ("ul", "li", "p"), ("p",))


def _formed(path: tuple[str, ...], b: Block, form: tuple[str, ...], r: np.random.Generator) -> Block:
    """The block as another form of an article's block has it: short, as items and cells are, or all of it one link."""
    text = " ".join(b.text.split(" ")[: int(r.integers(1, 9))]) if r.random() < 0.6 else b.text
    return Block(_ROOT, text, float(r.random() < 0.2), (*path[:-1], *form))


def _put_in(page: list[tuple[Block, float]], r: np.random.Generator, phrases: list[str]) -> list[tuple[Block, float]]:
    """A copy of the page's blocks and labels with boilerplate of several kinds around and between them, and paths as other sites have them."""
    noise = sorted(_NOISE - {"head"})
    around = ("body", "div", "section", "ul", "li", "p", "span")
    renamed = _ARTICLES[int(r.integers(2))] if r.random() < 0.4 else _ARTICLES[int(r.integers(len(_ARTICLES)))]
    # Containers on the way to the content: their own words say nothing.
    outer = tuple(str(x) for x in r.choice(["div", "section", "wrapper", "page", "content", "container", "post", "entry", "body"], int(r.integers(0, 4))))
    out = [(b._replace(words=(*b.path[:2], *outer, *(x for t in b.path[2:] for x in (renamed if t in _CONTENT else (t,))))), yes) for b, yes in page]
    for _ in range(int(r.integers(1, 5))):
        form, at = _FORMS[int(r.integers(len(_FORMS)))], int(r.integers(len(out)))
        # Without an article around it a header is the page's.
        form = ("p",) if form[0] == "header" and not _CONTENT & set(renamed) else form
        for i in range(at, min(len(out), at + int(r.integers(1, 6)))):
            if out[i][1]:
                out[i] = (_formed(out[i][0].path, out[i][0], form, r), 1.0)
    for _ in range(int(r.integers(1, 6))):
        kind = noise[int(r.integers(len(noise)))]
        inside = r.random() < 0.4 and kind != "header"
        path = ("html", "body", *(renamed if inside else ()), str(r.choice(around)), kind, *(str(x) for x in r.choice(around, int(r.integers(0, 3)))))
        at = int(r.integers(len(out) + 1))
        for _ in range(int(r.integers(1, 5))):
            out.insert(at, (Block(_ROOT, phrases[int(r.integers(len(phrases)))], float(r.random() < 0.5), path), 0.0))
    return out


def fit(pages: DataFrame) -> Labeller:
    """Trained on a bounded sample: at most TRAIN_PAGES pages of up to TRAIN_BYTES each."""
    whole = 1 << 40
    # Hashes under a bound that leaves about twice as many pages: the sort has few rows to send.
    few = F.pmod(F.xxhash64("url", "html"), F.lit(whole)) < max(1, min(whole, 2 * TRAIN_PAGES * whole // max(1, pages.count())))
    rows = pages.filter(F.length("html").between(1, TRAIN_BYTES) & few).select("html").orderBy(F.xxhash64("url", "html"), "html").limit(TRAIN_PAGES).collect()
    seen = [[(b, weak_label(b.path)) for b in page] for page in (blocks(r["html"]) for r in rows) if page]
    if not any(yes for page in seen for _, yes in page):
        seen.append([(Block(_ROOT, text, links, path), weak_label(path)) for path, text, links in ((("html", "body", "nav"), "home", 1.0), (("html", "body", "article", "p"), "A sentence of some length, as articles have them.", 0.0), (("html", "body", "footer"), "imprint", 0.5))])
    r = np.random.default_rng(SEED)
    phrases = [b.text for page in seen for b, _ in page]
    # Of few pages there are more copies, so that the net takes as many steps.
    copies = max(COPIES, -(-TRAIN_PAGES * (COPIES + 1) // len(seen)) - 1)
    seen = [*seen, *(_put_in(page, r, phrases) for page in seen for _ in range(copies))]
    return Labeller().train([vectors([b for b, _ in page]) for page in seen], [np.array([yes for _, yes in page], dtype=np.float32) for page in seen])


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is content. Pages of a like length are run together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order, k = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i])), 0
    while k < len(order):
        j = k + 1
        while j < len(order) and (j - k + 1) * len(pages[order[j]]) <= STEPS_AT_ONCE:
            j += 1
        got = model.logits(*packed([vectors(pages[i]) for i in order[k:j]])) > 0
        for n, i in enumerate(order[k:j]):
            out[i] = got[: len(pages[i]), n]
        k = j
    return out


def main_text(pages: DataFrame, model: Labeller | None = None, key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars of every page."""
    spec = pages.sparkSession.sparkContext.broadcast((model or fit(pages)).w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.w = spec.value
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(i, PAGES_AT_ONCE)
                seen = [blocks(x.as_py() or "") for x in part.column(2)]
                texts = ["\n".join(x.text for x, yes in zip(b, keep, strict=True) if yes) for b, keep in zip(seen, label(net, seen), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, "url", "text", "n_chars"])

    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, url string, text string, n_chars bigint")
