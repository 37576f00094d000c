"""Main text of HTML pages by a linear-chain conditional random field.

A page is a chain of leaf blocks, each main text or not.  A block's features are
the tags around it, the words of the classes and ids around it, and its text's
length, links and punctuation; neighbours are tied by a weight for each pair of
labels, one set for neighbours with the same parent and one for others.  The
weights are fitted to the likelihood of labelled pages (forward-backward, AdaGrad),
and pages are decoded by Viterbi.

No labels come with the pages, so the labelled pages are written by a generator:
articles in the usual containers with menus, headers, footers, sidebars, notices,
adverts, forms and comments around and inside them, with and without telling
class names, well-formed or not.  Others can be given.

Cases: null, empty and text-free pages have an empty text.  Cut-off pages are read
as far as they go.  Repeated rows get equal results, and null ids are carried.
Long pages are read whole, and empty tables give empty results.  Columns other than
id, address and html aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.arrow import chunks, column, map_arrow
from tidewater.llm.html_blocks import Block, blocks

TRAINING_PAGES = 1_000
_EPOCHS, _RATE, _PENALTY = 10, 0.25, 1e-5


def block_features(page: Sequence[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    for k, b in enumerate(page):
        n = len(b.text)
        words = b.text.count(" ") + 1
        share = b.link_chars / n
        own = ["bias", f"leaf={b.tags[-1] if b.tags else ''}", f"words={min(9, int(math.log2(words)))}"]
        own += [f"tag={t}" for t in set(b.tags)]
        own += [f"name={w}" for w in b.words]
        own += [f"near={w}" for w in b.near]
        own.append("links=" + ("none" if share == 0 else "few" if share < 0.4 else "many" if share < 0.9 else "all"))
        if b.text[-1] in ".!?…\"”":
            own.append("ends")
        if "," in b.text:
            own.append("comma")
        if b.text[0] in "©®" or "©" in b.text:
            own.append("mark")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            own.append("bar")
        if k == 0:
            own.append("first")
        if k == len(page) - 1:
            own.append("last")
        if k and page[k - 1].parent == b.parent:
            own.append(f"beside={page[k - 1].tags[-1] if page[k - 1].tags else ''}")
        out.append(own)
    return out


@dataclass
class Field:
    """Weights: of features for the label "main" against "other", and of label pairs (same parent or not)."""

    weights: dict[str, float]
    pairs: np.ndarray  # [same parent][label before][label]

    def margins(self, page: Sequence[Block]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in own) for own in block_features(page)]

    def decode(self, page: Sequence[Block]) -> list[bool]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        pairs = self.pairs.tolist()
        margins = self.margins(page)
        off, on, back = 0.0, margins[0], []
        for k in range(1, len(page)):
            t = pairs[page[k].parent == page[k - 1].parent]
            from_off = off + t[0][0] >= on + t[1][0], off + t[0][1] >= on + t[1][1]
            off, on = max(off + t[0][0], on + t[1][0]), max(off + t[0][1], on + t[1][1]) + margins[k]
            back.append(from_off)
        label, out = on > off, []
        for from_off in (*reversed(back), None):
            out.append(label)
            if from_off is not None:
                label = not from_off[label]
        return out[::-1]


def marginals(margins: Sequence[float], same: Sequence[int], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of "main" for each block, and of each pair of labels for each two neighbours (forward-backward).

    ``same[k]`` tells whether a block has the parent of the one before.  Chances are scaled at each block.
    """
    step = np.exp(pairs).tolist()
    own = [(math.exp(-max(m, 0.0)), math.exp(min(m, 0.0))) for m in margins]
    off, on = own[0]
    ahead = [(off / (off + on), on / (off + on))]
    for k in range(1, len(own)):
        (a, b), (c, d) = step[same[k]]
        x, y = ahead[-1]
        off, on = (x * a + y * c) * own[k][0], (x * b + y * d) * own[k][1]
        ahead.append((off / (off + on), on / (off + on)))
    behind = [(1.0, 1.0)]
    for k in range(len(own) - 1, 0, -1):
        (a, b), (c, d) = step[same[k]]
        x, y = own[k][0] * behind[-1][0], own[k][1] * behind[-1][1]
        off, on = a * x + b * y, c * x + d * y
        behind.append((off / (off + on), on / (off + on)))
    first, then = np.array(ahead), np.array(behind[::-1])
    alone = first * then
    both = first[:-1, :, None] * np.exp(pairs)[np.asarray(same[1:], int)] * (np.array(own) * then)[1:, None, :]
    return alone[:, 1] / alone.sum(axis=1), both / both.sum(axis=(1, 2), keepdims=True)


def _same(page: Sequence[Block]) -> list[int]:
    return [0, *(int(b.parent == a.parent) for a, b in zip(page, page[1:]))]


def gradient(page: Sequence[Block], labels: Sequence[bool], field: Field) -> tuple[dict[str, float], np.ndarray]:
    """Of the labels' log-likelihood, by the weights and by the label pairs."""
    features, same = block_features(page), _same(page)
    chance, both = marginals(field.margins(page), same, field.pairs)
    weights: dict[str, float] = {}
    for own, y, p in zip(features, labels, chance.tolist()):
        for f in own:
            weights[f] = weights.get(f, 0.0) + y - p
    return weights, _pair_gradient(np.array(labels, int), same, both)


def _pair_gradient(labels: np.ndarray, same: Sequence[int], both: np.ndarray) -> np.ndarray:
    out, kind = np.zeros((2, 2, 2)), np.asarray(same[1:], int)
    np.add.at(out, kind, -both)
    np.add.at(out, (kind, labels[:-1], labels[1:]), 1.0)
    return out


def fit(pages: Sequence[tuple[Sequence[Block], Sequence[bool]]], seed: int = 3) -> Field:
    """Maximum likelihood with a small penalty."""
    index: dict[str, int] = {}
    data = []
    for page, labels in pages:
        rows = [[index.setdefault(f, len(index)) for f in own] for own in block_features(page)]
        if rows:
            flat = np.array([f for r in rows for f in r])
            place = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            data.append((flat, place, _same(page), np.array(labels, int)))
    w, pairs = np.zeros(len(index)), np.zeros((2, 2, 2))
    seen_w, seen_p = np.full(len(index), 1e-3), np.full((2, 2, 2), 1e-3)
    rng = random.Random(seed)
    for _ in range(_EPOCHS):
        rng.shuffle(data)
        for flat, place, same, labels in data:
            chance, both = marginals(np.bincount(place, w[flat], len(labels)).tolist(), same, pairs)
            grad_w = np.bincount(flat, (labels - chance)[place], len(w)) - _PENALTY * w
            grad_p = _pair_gradient(labels, same, both)
            seen_w += grad_w**2
            seen_p += grad_p**2
            w += _RATE * grad_w / np.sqrt(seen_w)
            pairs += _RATE * grad_p / np.sqrt(seen_p)
    return Field({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-3}, pairs)


# The generator of labelled pages.

#: Class and id names for each part of a page.
_NAMES = {
    "main": ["content", "main content", "article body", "post", "entry content", "story body", "page content", "post text", "blog post"],
    "nav": ["nav", "menu", "navbar", "main menu", "navigation", "breadcrumb", "breadcrumbs", "top menu", "tabs", "pagination", "pager"],
    "header": ["header", "site header", "masthead", "top bar", "branding", "logo", "hero banner"],
    "footer": ["footer", "site footer", "bottom", "foot", "copyright", "legal", "colophon"],
    "side": ["sidebar", "side", "widget", "rail", "aside", "related", "related posts", "recommended", "popular", "tags", "trending", "archive"],
    "notice": ["notice", "cookie notice", "cookie banner", "alert", "consent", "gdpr", "message", "warning", "announcement", "paywall", "disclaimer"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner ad", "adsbox"],
    "comment": ["comments", "comment", "comment list", "replies", "discussion", "responses", "comment body", "reader comments", "disqus"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact form", "search box"],
    "share": ["share", "social", "share buttons", "social links", "meta", "byline"],
}


#: Syllables of the generator's words.
_SYLLABLES = [a + b for a in "bcdfghlmnprstvwéüñ" for b in "aeiouèöí"]

#: Kinds of pages: what the article is in - its own element, one that a name may tell, or nothing but the page.
KINDS = ("article", "article", "article", "named", "named", "bare")


class _Writer:
    def __init__(self, seed: int, kind: str | None = None):
        self.r = random.Random(seed)
        self.main: set[str] = set()
        self.kind = kind or self.r.choice(KINDS)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=int(4 * self.r.random()) + 1))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.words(1, 22).capitalize()
            if self.r.random() < 0.5:
                s = s.replace(" ", ", ", 1)
            out.append(s + self.r.choice("....!?"))
        return " ".join(out)

    def named(self, kind: str, tags: str) -> tuple[str, str]:
        """Opening and closing tag of a part, mostly with a telling name."""
        tag = self.r.choice(tags.split())
        if tag not in ("div", "section", "ul", "td", "span") and self.r.random() < 0.5 or self.r.random() < 0.06:
            return f"<{tag}>", f"</{tag}>"
        name = self.r.choice(_NAMES[kind])
        if self.r.random() < 0.5:
            name = name.replace(" ", self.r.choice("-_"))
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">', f"</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        form = self.r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " · "]).join(items) if form < 0.85 else "".join(f"<p>{x}</p>" for x in items)

    def keep(self, text: str) -> str:
        self.main.add(" ".join(text.replace("<br>", " ").replace("&copy;", "©").split()))
        return text

    def noise(self, kind: str) -> str:
        r = self.r
        text = lambda: r.choice([self.prose(r.randint(1, 4)), self.words(2, 12), f"<p>{self.prose(r.randint(1, 3))}</p>"])
        if kind == "nav":
            a, b = self.named("nav", "nav div ul" if r.random() < 0.7 else "nav")
            return a + self.links(2, 8) + b
        if kind == "header":
            a, b = self.named("header", "header div")
            return a + r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 4)}</div>", f'<a href="/">{self.words(1, 2)}</a>']) + r.choice(["", self.links(2, 5), f"<p>{self.words(3, 8)}</p>"]) + b
        if kind == "footer":
            a, b = self.named("footer", "footer div footer")
            return a + r.choice([f"&copy; {self.word()}.example &middot; {self.prose(1)}", f"<p>&copy; 20{r.randint(10, 26)} {self.words(1, 3)}. {self.prose(1)}</p>", self.links(2, 6), f"<p>{self.prose(2)}</p>" + self.links(1, 3)]) + b
        if kind == "side":
            a, b = self.named("side", "aside div section")
            return a + r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 3)}</h2>"]) + r.choice([self.links(2, 7), text(), "".join(f"<p>{self.prose(1)}</p>" for _ in range(r.randint(1, 3)))]) + b
        if kind == "notice":
            a, b = self.named("notice", "div div section")
            return a + text() + r.choice(["", "<button>OK</button>", f'<a href="#">{self.words(1, 2)}</a>']) + b
        if kind == "ad":
            a, b = self.named("ad", "div div aside section")
            return a + r.choice([text(), f"{self.prose(r.randint(1, 3))}\n{self.prose(1)}", f'<a href="http://x.example">{self.prose(1)}</a>']) + b
        if kind == "comment":
            a, b = self.named("comment", "section div ol div")
            out = a + r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{r.randint(2, 90)} {self.word()}</h2>"])
            for _ in range(r.randint(1, 5)):
                c, d = self.named("comment", "div li article div")
                out += c + r.choice(["", f"<b>{self.word()}</b>", f"<span>{self.words(1, 2)}</span><br>"]) + f"<p>{self.prose(r.randint(1, 4))}</p>" * (r.random() < 0.9) + d
            return out + b
        if kind == "form":
            a, b = self.named("form", "form form div")
            return a + f"<label>{self.words(1, 4)}</label><input type=text><button>{self.words(1, 2)}</button>" + r.choice(["", f"<p>{self.prose(1)}</p>"]) + b
        a, b = self.named("share", "div ul span")
        return a + self.links(2, 4) + b

    def body(self) -> str:
        r = self.r
        a, b = "", ""
        if self.kind == "article":
            a, b = r.choice([("<article>", "</article>")] * 6 + [("<main>", "</main>")] * 2)
        elif self.kind == "named":
            a, b = self.named("main", r.choice(["div section article td main", "div"]))
        if self.kind != "bare" and r.random() < 0.25:
            c, d = self.named("main", "div article section")
            a, b = a + c, d + b
        if r.random() < 0.3:
            a = r.choice(['<div id="page">', '<div class="wrapper">', '<div class="container">', "<div>"]) + a
            b += "</div>"
        title = self.words(1, 12)
        head = f"<h1>{self.keep(title)}</h1>" if r.random() < (0.8 if a else 0.6) else ""
        if head and a and r.random() < 0.2:  # an article's own header
            head = f"<header>{head}" + (f"<p>{self.keep(self.prose(1))}</p>" if r.random() < 0.6 else "") + "</header>"
        out = a + head
        unclosed, para = r.random() < 0.2, r.choice(["p"] * 9 + ["div"])
        if a and r.random() < 0.05:  # text straight in the container
            return out + self.keep("<br><br>".join(self.prose(3) for _ in range(r.randint(1, 4)))) + b
        for k in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            x = r.random()
            if x < 0.76 or k == 0 and x < 0.84:
                inner = self.prose(r.choice([1, 1, 2, 3, 5, 8]))
                if r.random() < 0.12:  # tables as text, lists of names, lines without an end
                    inner = r.choice([" | ", " · ", " &copy; ", " "]).join(self.words(1, 40).split())
                inner = self.keep(inner)
                if r.random() < 0.3:
                    first, _, rest = inner.partition(" ")
                    inner = r.choice([f"<b>{first}</b> {rest}", f'<a href="/{self.word()}">{first}</a> {rest}', f"<b>{inner}<br>", f"<i>{first}</i> {rest}"])
                out += f"<{para}>{inner}" + ("" if unclosed and para == "p" else f"</{para}>")
            elif x < 0.83:
                tag = r.choice(["h2", "h3"])
                out += f"<{tag}>{self.keep(self.words(1, 7))}</{tag}>"
            elif x < 0.88:
                tag = r.choice(["ul", "ol"])
                out += f"<{tag}>" + "".join(f"<li>{self.keep(self.prose(1))}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>"
            elif x < 0.9 and a:  # sources and the like
                out += "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.keep(self.words(2, 6))}</a></li>' for _ in range(r.randint(2, 4))) + "</ul>"
            elif x < 0.915 or k == 0:
                out += f"<blockquote>{self.keep(self.prose(2))}</blockquote>"
            else:
                out += self.noise(r.choice(["ad", "ad", "side", "share", "form", "notice"]))
        if r.random() < 0.15:
            out += self.noise(r.choice(["comment", "share", "side"]))
        return out + b

    def page(self) -> str:
        r = self.r
        out = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>"
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("form", 0.2), ("ad", 0.5), ("side", 0.15)) if r.random() < p]
        if r.random() < 0.4:
            r.shuffle(before)
        after = [k for k, p in (("share", 0.15), ("comment", 0.4), ("side", 0.4), ("ad", 0.3), ("form", 0.2), ("nav", 0.1), ("footer", 0.85), ("notice", 0.1)) if r.random() < p]
        if r.random() < 0.15:  # nothing but the article
            before, after = [], []
        out += "".join(map(self.noise, before)) + self.body() + "".join(map(self.noise, after))
        return out + ("</body></html>" if r.random() < 0.9 else "")


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 0, kind: str | None = None) -> list[tuple[list[Block], list[bool]]]:
    """Generated pages, of one kind or of all, as blocks with their labels."""
    out = []
    for k in range(n):
        writer = _Writer(seed * 1_000_003 + k, kind)
        page = blocks(writer.page())
        out.append((page, [b.text in writer.main for b in page]))
    return out


@functools.lru_cache(maxsize=4)
def trained(n: int = TRAINING_PAGES) -> Field:
    """The field fitted on ``n`` generated pages; the same in every process."""
    return fit(labelled_pages(n))


def extract(pages: DataFrame, field: Field | None = None, html: str = "html", keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keys, text, n_chars``: the main text of each page.  Needs no exchange."""
    model = field or trained()
    slim = pages.select(*keys, F.col(html).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__html"):
            texts = []
            for page in column(batch, "__html").to_pylist():
                found = blocks(page)
                texts.append(" ".join(b.text for b, main in zip(found, model.decode(found)) if main))
            columns = [column(batch, k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keys, "text", "n_chars"]
            )

    return map_arrow(slim, run, f"{schema}, text string, n_chars long")
