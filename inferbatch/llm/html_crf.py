"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks, runs of text inside one block element. Scripts, styles,
templates, form data, titles and comments never become blocks. A head holds nothing else: whatever other
text or element follows its start belongs to the body, as in the HTML rules. Formulas, drawings and
fallback texts are text like any other, judged by the model. Each block has features of
its ancestors (tags, words of class, id and role) and of its text (length, links, punctuation, place in
the page), and the field has a weight per feature and label and one per pair of neighbouring labels. It
is trained by gradient ascent on labelled pages and decoded by Viterbi.

Labelled pages are composed at training time: paragraphs, titles and link texts of at most
`most_pages` real pages (those with the smallest hash of their id), at most `texts_per_page` of each, spread over
the page, and `words_per_text` words of a text, all documented bounds, are laid out in
seeded random page layouts, where the composer knows which blocks it put into the article. Extraction
reads every whole page, in time that grows with its length only, however deep its elements lie.

Defined results: a null or empty page, or one without main text, gives an empty text and 0 characters;
broken or cut markup is read as far as it goes; repeated rows give equal texts; an empty table gives an
empty result; without any page to learn from, stock phrases fill the layouts; only the named columns
are read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PAGES = 300
TEXTS_PER_PAGE = 12
WORDS_PER_TEXT = 80
LAYOUTS = 900
SEED = 7
STEPS = 200
RATE = 0.08
RIDGE = 0.2
WINDOW = 48

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template select datalist".split())
XML = frozenset(("svg", "math"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img picture source br input output meter progress "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# A start tag ends an open element of the second set, unless one of the third lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENDS = (".", "!", "?", "…", ":", ";", '"', "”")


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int
    label: int | None


def _names(attributes: str, labelled: bool) -> tuple[tuple[str, ...], int | None]:
    found, label = [], None
    for key, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if key.lower() == "data-y":
            label = int(value) if labelled else None
        else:
            found += [f"c:{p.lower()}" for p in NAME_PARTS.findall(value)]
    return tuple(found), label


class _Open:
    """The open elements, with what every block asks of them kept up to date as they come and go.

    No question walks through the stack, so a page costs time in proportion to its length however deep it is.
    """

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...], str, int | None]] = []
        self.places: dict[str, list[int]] = {}
        self.path: Counter[str] = Counter()
        self.xml = 0

    def push(self, tag: str, names: tuple[str, ...], label: int | None) -> None:
        own, above = (self.stack[-1][2], self.stack[-1][3]) if self.stack else ("body", None)
        path = tuple(n for n in (f"t:{tag}", *names) if self.known is None or n in self.known)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, path, own if tag in INLINE else tag, above if label is None else label))
        self.path.update(path)
        self.xml += tag in XML

    def pop(self) -> None:
        tag, path, _, _ = self.stack.pop()
        self.places[tag].pop()
        for name in path:
            self.path[name] -= 1
            if not self.path[name]:
                del self.path[name]
        self.xml -= tag in XML

    def last(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open element of these tags, -1 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def leave(self, names: Iterable[str], fences: Iterable[str]) -> None:
        """Close up to the innermost of `names`, unless one of `fences` lies within it."""
        at = self.last(names)
        if at > self.last(fences):
            while len(self.stack) > at:
                self.pop()

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def features(self) -> tuple[tuple[str, ...], int | None]:
        """Path features and label of a block that stands here."""
        own, label = self.stack[-1][2:] if self.stack else ("body", None)
        return (f"o:{own}", *sorted(self.path)), label


def blocks(html: str | None, labelled: bool = False, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page, in page order. Only composed pages are `labelled`, by data-y.

    `known` limits the features of the path to those that matter to a model.
    """
    html = html or ""
    nest = _Open(known)
    out: list[Block] = []
    parts: list[str] = []
    links = [0]

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            path, label = nest.features()
            out.append(Block(text, path, links[0], label))
        links[0] = 0

    at = 0
    while at < len(html):
        m = MARKUP.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            parts.append(text)
            if nest.has("a"):
                links[0] += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        if closing:
            nest.leave((tag,), ())
            continue
        if tag in ("br", "img", "input", "mtd"):
            parts.append(" ")
        empty = attributes.endswith("/") and (tag in RAW or tag in XML or nest.xml)
        if tag in VOID or tag == "head" or empty:
            continue
        if tag == "xmp":
            # Shown as it is written, markup included.
            end = re.compile(r"</xmp\b[^>]*(?:>|\Z)", re.I).search(html, at)
            nest.push(tag, *_names(attributes, labelled))
            parts.append(escape(html[at : end.start() if end else len(html)]))
            flush()
            nest.pop()
            at = end.end() if end else len(html)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in CLOSES_P:
            nest.leave(("p",), ("td", "th", "button", "table"))
        if tag in IMPLIED:
            nest.leave(*IMPLIED[tag])
        nest.push(tag, *_names(attributes, labelled))
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    rows = []
    for k, b in enumerate(page):
        words = b.text.split()
        share = b.link_chars / max(1, len(b.text))
        rows.append(
            [
                *b.path,
                f"words:{min(6, int(np.log2(len(words) + 1)))}",
                f"links:{0 if share < 0.1 else 1 if share < 0.6 else 2}",
                f"end:{b.text.endswith(ENDS)}",
                f"commas:{min(3, b.text.count(','))}",
                f"sign:{any(c in b.text for c in '©®|»')}",
                f"place:{0 if k == 0 else 2 if k == len(page) - 1 else 1}",
                "one",
            ]
        )
    return rows


@dataclass(frozen=True)
class Model:
    weights: dict[str, tuple[float, float]]
    moves: np.ndarray
    first: np.ndarray

    def emissions(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for k, names in enumerate(features(page)):
            for name in names:
                w = self.weights.get(name)
                if w:
                    out[k, 0] += w[0]
                    out[k, 1] += w[1]
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the most likely sequence of labels."""
        if not page:
            return []
        e = self.emissions(page).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = e[0][0] + float(self.first[0]), e[0][1] + float(self.first[1])
        back = []
        for e0, e1 in e[1:]:
            back.append((s1 + m10 > s0 + m00, s1 + m11 > s0 + m01))
            s0, s1 = max(s0 + m00, s1 + m10) + e0, max(s0 + m01, s1 + m11) + e1
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def main_text(self, html: str | None) -> str:
        page = blocks(html, known=self.weights)
        return " ".join(b.text for b, y in zip(page, self.decode(page)) if y)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages: list[tuple[list[list[str]], list[int]]]) -> Model:
    """Train on sequences of feature names with their labels."""
    names = sorted({name for rows, _ in pages for row in rows for name in row})
    at = {name: k for k, name in enumerate(names)}
    length = max(len(y) for _, y in pages)
    n = len(pages)
    mask, gold = np.zeros((n, length), bool), np.zeros((n, length), np.int64)
    cell, col = [], []
    for i, (rows, y) in enumerate(pages):
        mask[i, : len(y)], gold[i, : len(y)] = True, y
        for k, row in enumerate(rows):
            cell += [i * length + k] * len(row)
            col += [at[name] for name in row]
    cell, col = np.array(cell), np.array(col)
    total = mask.sum()
    pairs = mask[:, 1:]
    gold_moves = np.zeros((2, 2))
    np.add.at(gold_moves, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    onehot = np.eye(2)[gold] * mask[..., None]
    theta = np.zeros(2 * len(names) + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, moves, first = theta[: 2 * len(names)].reshape(2, -1), theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.stack([np.bincount(cell, w[y][col], n * length).reshape(n, length) for y in (0, 1)], -1)
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = e[:, 0] + first
        for k in range(1, length):
            step_in = _logsum(forward[:, k - 1, :, None] + moves, 1) + e[:, k]
            forward[:, k] = np.where(mask[:, k, None], step_in, forward[:, k - 1])
        for k in range(length - 2, -1, -1):
            step_out = _logsum(moves + (e[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(mask[:, k + 1, None], step_out, 0)
        z = _logsum(forward[:, -1], 1)
        p = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        joint = forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        joint = np.exp(np.minimum(joint, 0)) * pairs[..., None, None]
        miss = onehot - p
        flat = miss.reshape(-1, 2)
        grad_w = np.stack([np.bincount(col, flat[cell, y], len(names)) for y in (0, 1)])
        grad = np.concatenate(
            [grad_w.ravel(), (gold_moves - joint.sum((0, 1))).ravel(), miss[:, 0].sum(0)]
        ) - RIDGE * theta
        grad /= total
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        theta = theta + RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    w = theta[: 2 * len(names)].reshape(2, -1)
    weights = {name: (float(w[0, k]), float(w[1, k])) for name, k in at.items()}
    return Model(weights, theta[-6:-2].reshape(2, 2), theta[-2:])


# Usual names of page parts, one group per kind of part.
BOXES = {
    "ad": "ad ads advert advertisement banner sponsored promo adsbox promotion",
    "notice": "cookie cookie-notice notice alert gdpr consent popup modal newsletter subscribe message",
    "side": "sidebar side widget related recommended trending popular more-stories",
    "share": "share social toolbar breadcrumb breadcrumbs pagination tags meta byline",
    "comments": "comments comment comment-list replies discussion disqus reader-comments",
    "menu": "menu navbar nav navigation main-menu topbar skip",
    "head": "header site-header masthead page-header logo",
    "foot": "footer site-footer page-footer copyright legal bottom",
}
CONTENT = "content post entry article article-body post-content entry-content main-content story text body-text"
STOCK = (
    "The first paragraph tells what happened, and where it did.",
    "A second one follows with more detail, names and a number or two.",
    "In the end somebody explains what it means for the others.",
)


class Composer:
    """Seeded random page layouts, filled with given texts, whose blocks carry their label."""

    def __init__(self, texts: list[str], seed: int = SEED):
        self.rng = random.Random(seed)
        self.long = [t for t in texts if len(t.split()) > 8] or list(STOCK)
        self.short = [" ".join(t.split()[: 1 + k % 5]) for k, t in enumerate(texts) if t.split()] or ["Home", "More"]

    def pick(self, names: str) -> str:
        return self.rng.choice(names.split())

    def sentence(self) -> str:
        text = self.rng.choice(self.long)
        words = text.split()
        if self.rng.random() < 0.4:
            words = words[: self.rng.randint(1, max(1, min(12, len(words))))]
        return escape(" ".join(words), quote=False)

    def word(self) -> str:
        return escape(self.rng.choice(self.short), quote=False)

    def link_list(self) -> str:
        items = [f'<a href="#">{self.word()}</a>' for _ in range(self.rng.randint(1, 7))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items)

    def prose(self, most: int) -> str:
        rng, out = self.rng, []
        for _ in range(rng.randint(1, most)):
            kind = rng.random()
            text = self.sentence()
            if kind < 0.62:
                out.append(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br><p>{self.sentence()}</p>", f"<p>{text} <a href='#'>{self.word()}</a> {self.sentence()}</p>"]))
            elif kind < 0.72:
                out.append(f"<h{rng.randint(2, 4)}>{self.word()}</h2>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.9:
                out.append(f"<pre>{text}</pre>")
            elif kind < 0.94:
                out.append(f"<table><tr><th>{self.word()}</th><td>{self.word()}</td></tr></table>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{text}</figcaption></figure>")
            else:
                out.append(f"<div>{text}</div>")
        return "".join(out)

    def box(self, kind: str | None = None) -> str:
        """A part of the page that is not its main text."""
        rng = self.rng
        kind = kind or rng.choice([*BOXES, "form"])
        if kind == "form":
            inner = f"<label>{self.word()}</label><input><button>{self.word()}</button><p>{self.sentence()}</p>"
            return f'<form data-y="0">{inner}</form>'
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside"}.get(kind, "div")
        if rng.random() < 0.2:
            tag = rng.choice(["div", "section"])
            named = 1.0
        else:
            named = 0.5 if tag != "div" else 1.0
        name = f' {rng.choice(["class", "class", "id"])}="{self.pick(BOXES[kind])}"' if rng.random() < named else ""
        if kind in ("menu", "share"):
            inner = self.link_list()
        elif kind == "head":
            inner = rng.choice([f"<h1>{self.word()}</h1>", f"<a href='/'>{self.word()}</a><p>{self.sentence()}</p>"]) + (self.link_list() if rng.random() < 0.5 else "")
        elif kind == "foot":
            inner = rng.choice([f"&copy; {self.word()} &middot; {self.sentence()}", f"<p>{self.sentence()}</p>{self.link_list()}", self.sentence()])
        elif kind == "comments":
            inner = f"<h3>{self.word()}</h3>" + "".join(
                f'<{rng.choice(["div", "li", "article"])} class="{rng.choice(["comment", "reply", "comment-body"])}"><b>{self.word()}</b><p>{self.sentence()}</p></div>'
                for _ in range(rng.randint(1, 4))
            )
        else:
            inner = rng.choice([self.sentence(), f"<p>{self.sentence()}</p>", f"<h3>{self.word()}</h3>{self.link_list()}", f"<p>{self.sentence()}</p><button>{self.word()}</button>"])
        return f'<{tag}{name} data-y="0">{inner}</{tag}>'

    def page(self) -> str:
        rng = self.rng
        top = "".join(self.box(k) for k in ("head", "menu", "notice", "ad", "share") if rng.random() < 0.55)
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        name = f' class="{self.pick(CONTENT)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
        title = f"<h1>{self.word() if rng.random() < 0.5 else self.sentence()}</h1>"
        if rng.random() < 0.2:
            title = f"<header>{title}</header>" if rng.random() < 0.5 else title
        body = [title if rng.random() < 0.85 else ""]
        for _ in range(rng.randint(1, 4)):
            body.append(self.prose(6))
            while rng.random() < 0.45:
                body.append(self.box(rng.choice(["ad", "notice", "side", "side", "share", "form", "comments", "menu"])))
                body.append(self.prose(3))
        main = f'<{tag}{name} data-y="1">{"".join(body)}</{tag}>'
        if rng.random() < 0.3:
            wrap = rng.choice(["main", "div", "div class='container'", "div id='page'", "div class='wrapper'"])
            main = f"<{wrap}>{main}</{wrap.split()[0]}>"
        end = "".join(self.box(k) for k in ("side", "comments", "form", "ad", "foot") if rng.random() < 0.5)
        return f'<html><head><title>{self.word()}</title></head><body data-y="0">{top}{main}{end}</body></html>'


def labelled_pages(texts: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of composed pages, cut into windows of bounded length."""
    composer, out = Composer(texts, seed), []
    for _ in range(layouts):
        page = blocks(composer.page(), labelled=True)
        rows, y = features(page), [b.label or 0 for b in page]
        out += [(rows[k : k + WINDOW], y[k : k + WINDOW]) for k in range(0, len(y), WINDOW)]
    return out


def train(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most_pages: int = MOST_PAGES,
    texts_per_page: int = TEXTS_PER_PAGE, words_per_text: int = WORDS_PER_TEXT,
) -> Model:
    """Fit on pages composed from the texts of a bounded sample."""
    picked = pages.filter(F.col(html_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), id_col)
    picked = picked.orderBy("h", id_col).limit(most_pages).select(F.col(id_col).alias("__id")).distinct()
    rows = pages.select(id_col, html_col).join(F.broadcast(picked), pages[id_col].eqNullSafe(F.col("__id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[b.text for b in blocks(h.as_py(), known=())] for h in batch.column(1)]
            few = [t[:: max(1, len(t) // texts_per_page)][:texts_per_page] for t in texts]
            cut = [[" ".join(x.split(maxsplit=words_per_text)[:words_per_text]) for x in t] for t in few]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], names=["id", "texts"])

    kind = pages.schema[id_col].dataType.simpleString()
    found = rows.select(id_col, html_col).mapInArrow(run, f"id {kind}, texts array<string>")
    found = found.orderBy("id", "texts").limit(most_pages).collect()
    return fit(labelled_pages([t for r in found for t in r["texts"]]))


def extracted(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url and the main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([model.main_text(h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
