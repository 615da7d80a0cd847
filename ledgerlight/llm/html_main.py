"""Main text of web pages by a bidirectional LSTM over their blocks.

A page falls into leaf blocks, the text between block-level tags, each with the path of tags it stands in. A block's
vector hashes the names, classes and ids of its path and its words, with a few figures (length, share of links, place).
A bidirectional LSTM in numpy reads a page's vectors in order, so that a label depends on the whole page, and tells
article blocks from menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Scripts, styles,
comments and titles never become blocks. The model is trained here on pages made by a seeded generator that knows
each block's kind; it has never seen the pages it is used on.

Null or empty html gives the empty text. Character references are decoded, white space inside a block becomes one
space, blocks of the article are joined by two line ends in page order. Rows that repeat are pages of their own. Long
pages are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH, WORDS, FIGURES = 512, 64, 8
HIDDEN = 24
BATCH = 128  # pages labelled together

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<textarea\b[^>]*>.*?</textarea\s*>|<select\b[^>]*>.*?</select\s*>|<button\b[^>]*>.*?</button\s*>|<(?:svg|math|iframe)\b[^>]*/>|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|title|iframe|math)\b[^>]*>.*?</\2\s*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)/?>|<[!?][^>]*>|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")

# fixed values: elements of HTML by kind
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Block:
    __slots__ = ("links", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, links: int):
        self.path, self.text, self.links = path, text, links


@lru_cache(maxsize=1 << 14)
def _marks(name: str, attributes: str) -> tuple[str, ...]:
    parts = [p.lower() for m in _NAMES.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "")]
    return (f"<{name}", *parts)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            out.append(Block(tuple(x for name, marks in open_ if name not in INLINE for x in marks), text, linked))
        pieces.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            pieces.append(piece)
            if anchors:
                linked += len(piece)

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            if m[1] or m[2]:
                flush()
            continue
        if m[3]:
            places = [i for i, (n, _) in enumerate(open_) if n == name]
            if name not in INLINE:
                flush()
            if places:
                anchors -= sum(n == "a" for n, _ in open_[places[-1] :])
                del open_[places[-1] :]
            continue
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            elif name not in VOID and not m[0].endswith("/>"):
                open_.append((name, ()))
                anchors += name == "a"
            continue
        flush()
        shut = "p" if name in CLOSES_P else name if name in ("li", "td", "th", "tr", "dt", "dd", "option") else ""
        if shut:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == shut:
                    anchors -= sum(n == "a" for n, _ in open_[i:])
                    del open_[i:]
                    break
                if open_[i][0] in ("ul", "ol", "table", "div", "section", "article", "td"):
                    break
        if name not in VOID:
            open_.append((name, _marks(name, m[5] or "")))
    add(page[at:])
    flush()
    return out


# ---- vectors ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Names in the path; the last element's once more by itself."""
    v = np.zeros(PATH)
    for x in set(path):
        v[_slot(x, PATH)] = 1.0
    last = max((i for i, x in enumerate(path) if x[0] == "<"), default=0)
    for x in path[last:]:
        v[_slot("last" + x, PATH)] = 1.0
    return v


def _own_vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), WORDS + FIGURES))
    for i, b in enumerate(page):
        words = _WORD.findall(b.text.lower())
        for w in words:
            out[i, _slot(w, WORDS)] += 1.0
        out[i, :WORDS] = np.sqrt(out[i, :WORDS] / max(1, len(words)))
        n, size = len(words), len(b.text)
        out[i, WORDS:] = (
            min(1.0, np.log1p(n) / 6), float(n < 4), float(n > 25), min(1.0, b.links / size), sum(c in ".,;:!?" for c in b.text) / size * 5,
            i / len(page), float(b.text[-1] in ".!?…:\"”"), float(i == 0),
        )
    return out


# ---- the recurrent labeller -------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Weights: for each direction input (PATH + WORDS + FIGURES, 4 HIDDEN), recurrent and bias; then the output."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        n = PATH + WORDS + FIGURES
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.15, (n, 4 * HIDDEN))
            self.w[f"h{d}"] = rng.normal(0, 0.8 / HIDDEN**0.5, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w["o"] = rng.normal(0, 0.3, 2 * HIDDEN)
        self.w["p"] = np.zeros(1)
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def _run(self, a: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """a: time x pages x gates, what the input adds; hidden states by time, and what the way back needs."""
        steps, pages, _ = a.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        hs, tape = np.zeros((steps, pages, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = a[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            th = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, u, th))
            h, c = m * (o * th) + (1 - m) * h, m * new + (1 - m) * c
            hs[t] = h
        return hs, tape

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probability of each block to be the article's."""
        w = np.hstack([self.w["xf"], self.w["xb"]])
        bias = np.concatenate([self.w["cf"], self.w["cb"]])
        sizes = [len(p) for p in pages]
        steps = max(sizes, default=0)
        a = np.zeros((steps, len(pages), 8 * HIDDEN))
        mask = np.zeros((steps, len(pages)))
        for j, page in enumerate(pages):
            if not page:
                continue
            if len(self.paths) > 1 << 15:
                self.paths.clear()
            for b in page:
                if b.path not in self.paths:
                    self.paths[b.path] = _path_vector(b.path) @ w[:PATH] + bias
            a[: len(page), j] = np.array([self.paths[b.path] for b in page]) + _own_vectors(page) @ w[PATH:]
            mask[: len(page), j] = 1
        hf, _ = self._run(a[:, :, : 4 * HIDDEN], mask, "f", False)
        hb, _ = self._run(a[:, :, 4 * HIDDEN :], mask, "b", False)
        p = _sigmoid(np.concatenate([hf, hb], 2) @ self.w["o"] + self.w["p"])
        return [p[:n, j] for j, n in enumerate(sizes)]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients over padded pages (time first)."""
        runs = {d: self._run(x @ self.w[f"x{d}"] + self.w[f"c{d}"], mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        p = _sigmoid(both @ self.w["o"] + self.w["p"])
        n = mask.sum()
        cost = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        dz = mask * (p - y) / n
        g = {"o": np.einsum("tp,tph->h", dz, both), "p": np.array([dz.sum()])}
        for k, d in enumerate("fb"):
            dh_out = dz[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            da = np.zeros((*mask.shape, 4 * HIDDEN))
            dh, dc = np.zeros(dh_out.shape[1:]), np.zeros(dh_out.shape[1:])
            gh = np.zeros_like(self.w[f"h{d}"])
            for t, h, c, i, f, o, u, th in reversed(runs[d][1]):
                m = mask[t][:, None]
                dh = dh + dh_out[t]
                dn = m * dh
                dcell = m * dc + dn * o * (1 - th**2)
                gates = np.hstack([dcell * u * i * (1 - i), dcell * c * f * (1 - f), dn * th * o * (1 - o), dcell * i * (1 - u**2)])
                da[t] = gates
                gh += h.T @ gates
                dh, dc = gates @ self.w[f"h{d}"].T + (1 - m) * dh, dcell * f + (1 - m) * dc
            g[f"h{d}"], g[f"c{d}"] = gh, da.sum((0, 1))
            g[f"x{d}"] = x.reshape(-1, x.shape[2]).T @ da.reshape(-1, 4 * HIDDEN)
        return cost, g


# ---- training pages ---------------------------------------------------------------------------------------------

# fixed values: names that web pages give to parts that are not their article, and to those that are
ASIDE_NAMES = {
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs tabs toolbar toc",
    "header": "header masthead topbar logo branding banner hero-links site-header",
    "footer": "footer copyright legal colophon site-footer bottom",
    "sidebar": "sidebar aside related widget popular trending recommended more-stories tags archive",
    "notice": "cookie consent gdpr notice alert popup modal overlay newsletter subscribe privacy",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad teaser",
    "form": "form search login signup contact comment-form subscribe-form",
    "comments": "comments comment replies reply discussion disqus reader-comments responses",
    "social": "share social follow sharing buttons byline-links pagination pager",
}
MAIN_NAMES = "article post content entry main story body text post-body entry-content article-body main-content page"


def _prose(r: random.Random, n: int, speech: list[str]) -> str:
    words = [r.choice(speech) for _ in range(n)]
    out = []
    for k, w in enumerate(words):
        out.append((w.capitalize() if not k or out[-1][-1] in ".!?" else w) + (r.choice([".", ".", ",", "?", "!"]) if r.random() < 0.14 else ""))
    return " ".join(out).rstrip(",.?!") + "." * (n > 5)


SHAPES = ("named", "named", "named", "named", "unknown", "unknown", "unclosed", "bare", "one", "plain")


def made_page(r: random.Random, shape: str | None = None) -> tuple[str, list[tuple[str, bool]]]:
    """A page and its blocks' texts in order, each with whether the article holds it. Every text is one of its page.

    Shapes: names that say what a part is; names that nobody knows; closing tags left out; paragraphs without a container,
    with or without other parts; an article of one block; text alone.
    """
    shape = shape or r.choice(SHAPES)
    letters = r.choice(["etaoinshrdlu", "eaisnrtulodc", "enisratdhulcgü", "eaosrnidlctuñ"])
    speech = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(60)]
    truth: list[tuple[str, bool]] = []

    def text(n: int, own: bool, end: str = "") -> str:
        t = f"{_prose(r, n, speech)} {''.join(r.choice(letters) for _ in range(5))}{len(truth)}{end}"
        truth.append((t, own))
        return entities.escape(t)

    def named(kind: str, tags: tuple[str, ...]) -> tuple[str, str]:
        tag = r.choice(tags)
        if shape == "unknown":
            tag = "div" if kind == "main" or r.random() < 0.5 else tag
            return f'<{tag} class="{"".join(r.choice(letters) for _ in range(6))}">', f"</{tag}>"
        name = r.choice((ASIDE_NAMES[kind] if kind in ASIDE_NAMES else MAIN_NAMES).split())
        if tag in ("nav", "header", "footer", "aside", "form", "article", "main") and r.random() < 0.6:
            return f"<{tag}>", f"</{tag}>"
        return f'<{tag} {r.choice(["class", "id", "class"])}="{r.choice(["", "", "site-", "page-", "c-", "block "])}{name}">', f"</{tag}>"

    def wrap(kind: str, tags: tuple[str, ...], inner) -> str:
        a, b = named(kind, tags)
        return a + inner() + b

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{text(r.randint(1, 3), False)}</a></li>' for _ in range(n)) + "</ul>"

    def part(kind: str) -> str:
        if kind == "menu":
            return wrap(kind, ("nav", "nav", "div", "ul", "div"), lambda: links(r.randint(2, 9)))
        if kind == "header":
            return wrap(kind, ("header", "header", "div"), lambda: f"<{r.choice(['div', 'p', 'h1', 'h2'])}>{text(r.randint(1, 5), False)}</div>" + (links(3) if r.random() < 0.4 else ""))
        if kind == "footer":
            return wrap(kind, ("footer", "footer", "div"), lambda: f"&copy; {text(r.randint(2, 25), False)}" if r.random() < 0.6 else f"<p>{text(r.randint(2, 25), False)}</p>" + links(3))
        if kind == "form":
            return wrap(kind, ("form", "form", "div"), lambda: f"<label>{text(2, False)}</label><input><div>{text(1, False)}</div>")
        if kind == "comments":
            return wrap(kind, ("div", "section", "ol"), lambda: "".join(f"<{t}>{text(r.randint(2, 60), False)}</{t}>" for t in r.choices(["div", "p", "li"], k=r.randint(1, 6))))
        if kind == "social":
            return wrap(kind, ("div", "ul"), lambda: links(r.randint(2, 4)))
        if kind == "sidebar":
            return wrap(kind, ("aside", "aside", "div", "section"), lambda: f"<h3>{text(2, False)}</h3>" + (links(3) if r.random() < 0.6 else f"<p>{text(r.randint(3, 30), False)}</p>"))
        return wrap(kind, ("div", "div", "section", "p", "aside"), lambda: text(r.randint(3, 30), False) if r.random() < 0.6 else f"<p>{text(r.randint(3, 30), False)}</p>")

    def own(k: int) -> str:
        x = r.random()
        if x < 0.72:
            a, b = (f"<b>", "<br>") if r.random() < 0.15 else ("<p>", "</p>") if r.random() < 0.9 else ("<p>", "")
            return f"{'<p>' if a == '<b>' else ''}{a}{text(r.choice([2, 5, 12, 25, 50, 90]), True)}{b}"
        if x < 0.8:
            return f"<h{r.randint(2, 4)}>{text(r.randint(1, 6), True)}</h2>".replace("</h2>", "</h2>")
        if x < 0.87:
            return "<ul>" + "".join(f"<li>{text(r.randint(2, 18), True)}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if x < 0.92:
            return f"<blockquote>{text(r.randint(5, 30), True)}</blockquote>"
        if x < 0.95:
            return f"<pre>{text(r.randint(3, 15), True)}</pre>"
        return "<table><tr>" + "".join(f"<td>{text(r.randint(1, 4), True)}</td>" for _ in range(3)) + "</tr></table>"

    if shape == "plain":
        return text(r.choice([3, 8, 20, 60, 200]), True), truth
    if shape in ("bare", "one"):
        around = r.random() < 0.5
        page = [part("header")] * (r.random() < 0.3) + [part("menu")] if around else []
        a, b = ("", "") if shape == "bare" else named("main", ("article", "main", "div"))
        page.append(a)
        if shape == "bare":
            page += [f"<h1>{text(r.randint(1, 8), True)}</h1>"] * (r.random() < 0.4)
            page += [f"<p>{text(r.choice([4, 12, 30, 80]), True)}" + r.choice(["</p>", "</p>", ""]) for _ in range(r.choice([1, 1, 2, 4, 8]))]
        else:
            page.append(r.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<p>{}", "<p>{}</p><script>bad"]).format(text(r.choice([2, 6, 20, 60]), True)))
        page.append(b)
        page += [part("footer")] * (around and r.random() < 0.7)
        return (r.choice(["", "<html><body>", "<!DOCTYPE html><html><head><title>x</title><body>", "<body>"]) + "".join(page)), truth
    out = ["<html><head><title>x</title></head><body>"]
    for kind in ("header", "menu", "notice", "social", "advert"):
        if r.random() < 0.45:
            out.append(part(kind))
    if r.random() < 0.2:
        out.append(part("sidebar"))
    a, b = named("main", ("article", "article", "main", "div", "section")) if r.random() < 0.93 else ("<div>", "</div>")
    out.append(a)
    if r.random() < 0.8:
        out.append(f"<h1>{text(r.randint(1, 10), True)}</h1>")
    for k in range(r.choice([1, 2, 3, 5, 8, 14])):
        out.append(own(k))
        if r.random() < 0.05:
            out.append(part(r.choice(["advert", "social", "sidebar", "form", "notice"])))
    if r.random() < 0.1:
        out.append(part("comments"))
    out.append(b)
    for kind in ("social", "comments", "sidebar", "advert", "form", "notice", "menu", "footer", "footer"):
        if r.random() < 0.35:
            out.append(part(kind))
    page = "".join(out) + "</body></html>"
    if shape == "unclosed":
        page = re.sub("</(?:p|li|td|tr|body|html)>", lambda m: m[0] if r.random() < 0.4 else "", page)
    return page, truth


@lru_cache(maxsize=2)
def trained(pages: int = 1800, epochs: int = 8, seed: int = 5) -> Labeller:
    r = random.Random(seed)
    made = []
    for _ in range(pages):
        page, truth = made_page(r)
        kind = dict(truth)
        found = blocks(page)
        y = np.array([float(kind.get(b.text.removeprefix("© "), False)) for b in found])
        x = np.hstack([np.array([_path_vector(b.path) for b in found]), _own_vectors(found)])
        made.append((x, y))
    made.sort(key=lambda m: len(m[1]))
    model = Labeller(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    groups = [made[i : i + 24] for i in range(0, pages, 24)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            group = groups[g]
            steps = max(len(y) for _, y in group)
            x, y, mask = np.zeros((steps, len(group), group[0][0].shape[1])), np.zeros((steps, len(group))), np.zeros((steps, len(group)))
            for j, (a, b) in enumerate(group):
                x[: len(b), j], y[: len(b), j], mask[: len(b), j] = a, b, 1
            # names unknown to the model must not sway it: some are hidden while it learns
            x[:, :, :PATH] *= rng.random(x[:, :, :PATH].shape) > 0.05
            _, grads = model.gradients(x, mask, y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            step += 1
            rate = 0.01 * (0.5 ** (epoch / 2.5))
            for k, v in grads.items():
                v = v / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def main_text(model: Labeller, pages: list[str | None]) -> list[str]:
    """Each page's main text; pages of like length are labelled together."""
    found = [blocks(p) for p in pages]
    order = sorted(range(len(found)), key=lambda i: len(found[i]))
    out = [""] * len(found)
    at = 0
    while at < len(order):
        end = at + BATCH
        while end > at + 1 and len(found[order[min(end, len(order)) - 1]]) * (end - at) > 1 << 15:
            end = at + (end - at) // 2
        part = order[at:end]
        at = end
        for i, p in zip(part, model.label([found[i] for i in part]), strict=True):
            out[i] = "\n\n".join(b.text for b, x in zip(found[i], p, strict=True) if x >= 0.5)
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    weights = trained().w
    sent = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in weights.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller(0)
        model.w = {k: v.astype(float) for k, v in sent.value.items()}
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                text = main_text(model, part["html"].tolist())
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select("page_id", "url", F.col(html_col).alias("html"))
    return rows.mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
