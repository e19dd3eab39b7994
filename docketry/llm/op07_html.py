"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page's text is cut into leaf blocks where block elements begin or end. Every block has features
of its ancestors (tags, words of class, id and role) and of its text. The field has two labels,
main and other; it is trained here by maximum likelihood on pages that a generator lays out and
labels (seeded, bounded by TRAIN_PAGES), and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Generated pages that the field is trained on, steps of training, and the weight of the squared penalty.
TRAIN_PAGES, STEPS, PENALTY = 500, 160, 0.02

# A tag ends at its >, at the next < outside of quotes or at the page's end, and nothing is given back, so any page is read once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?|<[!?][^<>]*+>?", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "xmp", "noembed", "noframes")}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_BREAK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button caption legend label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BREAK - frozenset("button label option optgroup select html body head td th tr tbody thead tfoot caption legend".split())
_SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Words of class, id and role, by what they tell.
_HINTS = {
    "ad": "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner adbox adslot dfp",
    "comment": "comment comments commentlist disqus reply replies respond discussion feedback",
    "side": "sidebar side aside widget related recommended recommendations popular trending more rail secondary complementary tags tagcloud",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall toast dialog alertdialog banner-notice",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar top logo brand",
    "share": "share sharing social follow buttons toolbar tools",
    "main": "content article post entry story main body text articlebody maincontent page-content",
}
_HINT = {w: k for k, words in _HINTS.items() for w in words.split()}
_TAGS = "nav header footer aside article main section form li ul ol table td p h1 h2 h3 blockquote pre figure figcaption button select label a dl dialog details".split()
_NAMES = ["bias", *(f"in:{t}" for t in _TAGS), *(f"hint:{h}" for h in _HINTS), *(f"own:{t}" for t in _TAGS), "head-in-article",
          *(f"words:{k}" for k in range(7)), *(f"links:{k}" for k in range(4)), "stops", "ends", "copyright", "commas", "digits", "first", "last"]
FEATURE = {n: k for k, n in enumerate(_NAMES)}


_BIT = {t: 1 << k for k, t in enumerate([*sorted(_BREAK), *_HINTS])}


class _Open:
    """The open block elements of a page: where each kind is open, which kinds and hints are open at all."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset]] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.many: dict[str, int] = defaultdict(int)
        self.mask = 0

    def push(self, tag: str, hints: frozenset) -> None:
        self.where[tag].append(len(self.stack))
        self.stack.append((tag, hints))
        for x in (tag, *hints):
            self.many[x] += 1
            self.mask |= _BIT[x]

    def cut(self, k: int) -> None:
        """Close the element at k and what is open inside."""
        while len(self.stack) > k:
            tag, hints = self.stack.pop()
            self.where[tag].pop()
            for x in (tag, *hints):
                self.many[x] -= 1
                if not self.many[x]:
                    self.mask &= ~_BIT[x]

    def last(self, *tags: str) -> int:
        """Where the innermost open element of these kinds is, -1 if none is open."""
        return max(self.where[t][-1] if self.where[t] else -1 for t in tags)

    def key(self) -> tuple[int, str, bool]:
        """What the features of a block in here depend on: kinds and hints that are open, the innermost element, a header in the article."""
        heads = self.where["header"]
        inside = bool(heads) and any(self.where[t] and self.where[t][0] < heads[0] for t in ("article", "main"))
        return self.mask, self.stack[-1][0] if self.stack else "", inside


def _ancestor_features(key: tuple[int, str, bool]) -> tuple[int, ...]:
    mask, own, inside = key
    out = [FEATURE["bias"], *(FEATURE[f"in:{t}"] for t in _BREAK if mask & _BIT[t] and f"in:{t}" in FEATURE), *(FEATURE[f"hint:{h}"] for h in _HINTS if mask & _BIT[h])]
    if f"own:{own}" in FEATURE:
        out.append(FEATURE[f"own:{own}"])
    if inside:
        out.append(FEATURE["head-in-article"])
    return tuple(sorted(out))


def blocks(page: str) -> list[tuple[str, tuple[int, ...]]]:
    """(text, features) of the leaf blocks of a page in order; blocks without text are left out."""
    out: list[tuple[str, tuple[int, ...], float]] = []
    open_ = _Open()
    parts: list[str] = []
    # link: how many blocks were open where a link began, -1 outside of links
    state = {"links": 0, "key": None, "link": -1}
    cache: dict[tuple, tuple] = {}
    empty = frozenset()

    def flush() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                key = state["key"]
                if key not in cache:
                    cache[key] = _ancestor_features(key)
                out.append((text, cache[key], min(1.0, state["links"] / len(text))))
            parts.clear()
        state["links"], state["key"] = 0, None

    def add(text: str) -> None:
        if not text:
            return
        parts.append(text)
        if not text.isspace():
            if state["key"] is None:
                state["key"] = open_.key()
            if state["link"] >= 0:
                state["links"] += len(text.strip())

    def cut(k: int) -> None:
        if k >= 0:
            open_.cut(k)
            if state["link"] > k:
                state["link"] = -1

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BREAK:
                flush()
                cut(open_.last(tag))
            elif tag == "a":
                state["link"] = -1
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in _BREAK:
            flush()
            if tag in _CLOSES_P:
                cut(open_.last("p"))
            if tag in _SAME:
                same = open_.last("td", "th", "dd", "dt") if tag in ("td", "th", "dd", "dt") else open_.last(tag)
                if same > open_.last(*_SAME[tag]):
                    cut(same)
        elif tag == "br":
            parts.append(" ")
        if tag == "a":
            state["link"] = len(open_.stack)
        if tag not in _BREAK or tag in _VOID:
            continue
        hints = empty
        if "=" in m[3]:
            words = [w for a in _NAMED.findall(m[3]) for w in re.split(r"[\s_-]+", (a[0] or a[1] or a[2]).lower())]
            hints = frozenset(_HINT[w] for w in words if w in _HINT)
        open_.push(tag, hints)
    flush()
    total = len(out)
    return [(t, f + _text_features(t, links, k, total)) for k, (t, f, links) in enumerate(out)]


def _text_features(text: str, links: float, k: int, total: int) -> tuple[int, ...]:
    words = text.count(" ") + 1
    out = [FEATURE[f"words:{min(6, words.bit_length() - 1)}"], FEATURE[f"links:{min(3, int(links * 3.99))}"]]
    if text.count(". ") + text.count("! ") + text.count("? "):
        out.append(FEATURE["stops"])
    if text[-1] in ".!?:;…\"'”»。":
        out.append(FEATURE["ends"])
    if "©" in text or "(c)" in text.lower()[:40]:
        out.append(FEATURE["copyright"])
    if text.count(",") >= 2:
        out.append(FEATURE["commas"])
    if sum(map(str.isdigit, text[:200])) * 4 > min(200, len(text)):
        out.append(FEATURE["digits"])
    if k == 0:
        out.append(FEATURE["first"])
    if k == total - 1:
        out.append(FEATURE["last"])
    return tuple(out)


# ---- labelled pages ----


def labelled_page(r: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks, laid out at random."""
    vocabulary = ["".join(r.choice(["an", "er", "ti", "on", "sh", "el", "mo", "ka", "ri", "u", "de", "ß", "é", "ño"]) for _ in range(r.randint(1, 4))) for _ in range(150)]
    n = iter(range(10**6))

    def words(lo: int, hi: int) -> str:
        out = [r.choice(vocabulary) for _ in range(r.randint(lo, hi))]
        return " ".join([f"{out[0].capitalize()}{next(n)}", *out[1:]])

    def prose(lo: int = 1, hi: int = 9) -> str:
        return " ".join(words(2, 18) + r.choice([".", ".", ".", "!", "?"]) for _ in range(r.randint(lo, hi)))

    main: list[str] = []

    def keep(text: str) -> str:
        main.append(text)
        return text

    def el(tag: str, inner: str, names: list[str] | None = None) -> str:
        name = ""
        if names and r.random() < 0.85:
            name = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(k: int, item: str = "li") -> str:
        return "".join(el(item, f'<a href="/{w}">{w}</a>') for w in (words(1, 3) for _ in range(k)))

    def menu() -> str:
        inner = el("ul", links(r.randint(2, 8)))
        return r.choice([el("nav", inner, ["", "menu", "navbar"]), el("div", inner, ["menu", "nav", "navigation", "breadcrumbs"]), el("nav", links(r.randint(2, 5), "span"))])

    def advert() -> str:
        return r.choice([el("div", prose(1, 3), ["ad", "ads", "advert", "sponsored", "ad-banner", "promo"]), el("div", el("p", prose(1, 2)), ["ad", "advertisement"]), el("aside", prose(1, 2), ["ad", "sponsor"])])

    def side() -> str:
        inner = el("h3", words(1, 4)) + r.choice([el("ul", links(r.randint(2, 6))), el("p", prose(1, 3))])
        return r.choice([el("aside", inner, ["sidebar", "", "related"]), el("div", inner, ["sidebar", "widget", "related", "recommended"])])

    def notice() -> str:
        inner = el("p", prose(1, 2)) + r.choice(["", el("button", words(1, 2))])
        return r.choice([el("div", inner, ["cookie-notice", "consent", "notice", "alert"]), el("dialog", inner), el("section", inner, ["cookie", "gdpr notice", "popup"])])

    def form() -> str:
        return el("form", el("label", words(1, 4)) + '<input type="text">' + r.choice(["", el("p", prose(1, 1))]) + el("button", words(1, 2)), ["", "search", "newsletter"])

    def comments() -> str:
        one = lambda: el(r.choice(["div", "li", "article", "p"]), el("b", words(1, 2)) + " " + r.choice([prose(1, 4), el("p", prose(1, 4))]), ["comment", "", "reply"])
        inner = el(r.choice(["h2", "h3"]), words(1, 3)) + "".join(one() for _ in range(r.randint(1, 6)))
        return r.choice([el("section", inner, ["comments", "comments", "disqus"]), el("div", inner, ["comments", "discussion", "comment-list"])]).replace("<section>", '<section id="comments">').replace("<div>", '<div class="comments">', 1)

    def share() -> str:
        return el("div", links(r.randint(2, 4), "span"), ["share", "social", "toolbar"])

    def body() -> str:
        out = []
        title = el("h1", keep(words(2, 12)))
        out.append(el("header", title) if r.random() < 0.25 else title)
        if r.random() < 0.5:
            lead = prose(1, 3)
            out.append(f"<p><b>{keep(lead)}<br>" if r.random() < 0.5 else el("p", keep(lead)))
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.62:
                out.append(el("p", keep(prose())) if r.random() < 0.8 else f"<p>{keep(prose())}")
            elif x < 0.69:
                out.append(el(r.choice(["h2", "h3"]), keep(words(1, 8))))
            elif x < 0.76:
                out.append(el(r.choice(["ul", "ol"]), "".join(el("li", keep(r.choice([prose(1, 2), words(2, 9)]))) for _ in range(r.randint(1, 5)))))
            elif x < 0.80:
                out.append(el("blockquote", el("p", keep(prose(1, 3)))))
            elif x < 0.83:
                out.append(el("pre", keep(words(3, 30))))
            elif x < 0.86:
                out.append(el("figure", el("figcaption", keep(prose(1, 1)))))
            elif x < 0.89:
                out.append(el("table", "".join(el("tr", "".join(el("td", keep(words(1, 4))) for _ in range(3))) for _ in range(2))))
            elif x < 0.93:
                out.append(f'<p>{keep(words(1, 3) + ".")}</p>')
            else:
                out.append(r.choice([advert, side, share, form, notice])())
        return "".join(out)

    text = r.choice([lambda x: el("article", x, ["", "post", "entry"]), lambda x: f"<article>{x}</article>", lambda x: f"<article>{x}</article>", lambda x: el("main", el("article", x)), lambda x: el("main", x), lambda x: f'<div class="{r.choice(["content", "article-body", "post", "entry-content", "story"])}">{x}</div>', lambda x: f'<section class="{r.choice(["article", "main-content"])}">{x}</section>'])(body())
    top = [f() for f, p in ((notice, 0.25), (lambda: el("header", el("p", words(1, 5)) + r.choice(["", menu()]), ["", "masthead"]), 0.5), (menu, 0.75), (advert, 0.5), (form, 0.2), (side, 0.2)) if r.random() < p]
    r.shuffle(top)
    end = [f() for f, p in ((share, 0.25), (comments, 0.4), (side, 0.35), (advert, 0.3), (form, 0.2), (menu, 0.2), (notice, 0.15)) if r.random() < p]
    r.shuffle(end)
    foot = r.choice([el("footer", r.choice(["&copy; " + words(1, 5), words(2, 8) + ".", "&copy; 2024 " + prose(1, 2), el("p", prose(1, 2))]), ["", "site-footer"]), el("div", "&copy; " + words(2, 8), ["footer", "copyright"]), "", el("footer", "&copy; " + prose(1, 2))])
    if r.random() < 0.5:
        text = el("div", text, ["container", "wrap", "page", "layout"])
    page = "".join(top) + text + "".join(end) + foot
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{page}</body></html>", main


# ---- the field ----


class Field:
    """Weights: emission of `main` over `other` for each feature, a first label's and a transition's score."""

    def __init__(self, emit: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.emit, self.start, self.move = emit, start, move

    def decode(self, features: list[tuple[int, ...]]) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        emit, ((oo, om), (mo, mm)) = self.emit.tolist(), self.move.tolist()
        o, m = self.start.tolist()
        back = []
        for k, f in enumerate(features):
            score = 0.0
            for x in f:
                score += emit[x]
            if k:
                from_o, from_m = (o + oo >= m + mo), (o + om >= m + mm)
                back.append((from_o, from_m))
                o, m = (o + oo if from_o else m + mo), (o + om if from_m else m + mm)
            m += score
        label, out = m > o, []
        for from_o, from_m in reversed(back):
            out.append(label)
            label = not (from_m if label else from_o)
        return ([label, *reversed(out)] if features else [])


def train(pages: int = TRAIN_PAGES, steps: int = STEPS, seed: int = 7) -> Field:
    """Maximum likelihood with a squared penalty on generated pages: Adam on gradients from forward and backward sums."""
    r, x, y, start = random.Random(seed), [], [], []
    for _ in range(pages):
        page, main = labelled_page(r)
        main = {" ".join(html.unescape(t).split()) for t in main}
        own = blocks(page)
        start.append(len(x))
        x += [f for _, f in own]
        y += [t in main for t, _ in own]
    length = np.diff([*start, len(x)])
    many, longest, n = len(start), int(length.max()), len(FEATURE)
    dense = np.zeros((len(x), n))
    for k, f in enumerate(x):
        dense[k, list(f)] = 1
    slot = np.concatenate([np.arange(c) for c in length])
    page_of = np.repeat(np.arange(many), length)
    mask = np.zeros((many, longest), bool)
    mask[page_of, slot] = True
    gold = np.zeros((many, longest), int)
    gold[page_of, slot] = np.array(y, int)
    w = np.zeros(n + 2 + 4)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    both = mask[:, 1:]
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    seen_emit = dense[np.array(y)].sum(0)
    seen_start = np.bincount(gold[:, 0], minlength=2)
    for step in range(1, steps + 1):
        emit, begin, move = w[:n], w[n : n + 2], w[n + 2 :].reshape(2, 2)
        score = np.zeros((many, longest, 2))
        score[page_of, slot, 1] = dense @ emit
        fwd, bwd = np.zeros((many, longest, 2)), np.zeros((many, longest, 2))
        fwd[:, 0] = begin + score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]) + score[:, t]
            fwd[:, t] = np.where(mask[:, t, None], new, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = bwd[:, t + 1] + score[:, t + 1]
            new = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            bwd[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - z[:, None, None])
        pair = fwd[:, :-1, :, None] + move + (score + bwd)[:, 1:, None, :] - z[:, None, None, None]
        grad = np.concatenate([
            (p[page_of, slot, 1] @ dense) - seen_emit, p[:, 0].sum(0) - seen_start,
            (np.exp(pair[both]).sum(0) - seen_move).ravel(),
        ]) / many + PENALTY * w / 10
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w -= 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Field(w[:n], w[n : n + 2], w[n + 2 :].reshape(2, 2))


def extract(page: str, field: Field) -> str:
    own = blocks(page)
    return "\n".join(t for (t, _), main in zip(own, field.decode([f for _, f in own]), strict=True) if main)


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [extract(p or "", shared.value) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    Null html counts as empty and gives empty text. Character references are decoded, white space
    in a block is one space, blocks are joined by a newline in page order. <br> counts as white
    space. Pages of any length, nesting and malformation are read whole, in time in proportion:
    unclosed comments and scripts run to the page's end, other unclosed tags to the next tag.
    Repeated rows and rows without an id are treated alike; an empty table gives an empty result.
    Other columns of pages are not read.
    """
    common.bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or train())
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(_extracted(shared), "page_id long, url string, text string, n_chars long")
