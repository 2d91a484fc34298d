"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, with the tags,
classes and ids of their ancestors. Each block has sparse features of its ancestors and its text;
the field scores labels (main text or not) for a block and for neighbours, and Viterbi decoding
picks the page's best sequence. The field is trained with forward-backward gradients on labelled
pages. Labelled pages come from `labelled_pages`: layouts with known main blocks, generated from
a seed, so that training needs no table and has a fixed size.

Defined results: null or empty html gives an empty text; comments, scripts, styles and the
document head hold no blocks; a head whose end tag is left out ends, as in HTML, at the first tag
or text that may not stand in one; an unclosed tag ends with its parent, however deep it lies; text cut off inside a tag ends
before it; a tag whose quotes are not closed ends at its first '>'; repeated rows and ids keep a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from awardlens.llm.text import tidy

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)|[!?][^>]*(?:>|\Z))", re.S)
_MARK = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")
RAW = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select"))
#: What may stand in a head: elements whose text is skipped, and void ones. Of end tags, these end a head.
HEAD_RAW = frozenset(("title", "script", "style", "noscript", "noframes", "template"))
HEAD_VOID = frozenset(("base", "basefont", "bgsound", "link", "meta"))
HEAD_ENDS = frozenset(("head", "body", "html", "br"))
VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"button", "label"}
#: Words in classes, ids and roles that tell what a part of a page is for.
HINTS = {
    "boilerplate": "ad ads advert advertisement banner promo sponsor sponsored sponsors affiliate".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip".split(),
    "edge": "header footer masthead topbar bottom copyright legal colophon branding logo".split(),
    "side": "sidebar aside widget related recommended popular trending more also rail teaser".split(),
    "notice": "cookie cookies consent notice alert popup modal gdpr toast warning overlay dialog".split(),
    "talk": "comment comments reply replies respond discussion disqus reviews".split(),
    "social": "share sharing social follow newsletter subscribe signup login search tags meta byline author".split(),
    "main": "article content post entry body main story text page prose blog".split(),
}
#: Longer attributes are not kept in the cache of hints.
KEPT = 10_000
_HINT = {w: k for k, ws in HINTS.items() for w in ws}


@dataclass
class Block:
    """A leaf block: its text, its ancestors' tags and hints, and how much of it lies in links."""

    text: str
    tags: frozenset[str]
    hints: frozenset[str]
    tag: str
    linked: int


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> frozenset[str]:
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for word in _WORD.findall((m[1] or m[2] or m[3] or "").lower()):
            if word in _HINT:
                found.add(_HINT[word])
    return frozenset(found)


class _Open:
    """The open elements, with the places of each tag and counts of hints, so that no lookup walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.hints: Counter = Counter()
        self.blocks: list[int] = []

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name, -1 for none."""
        return self.places[name][-1] if name in self.places else -1

    def push(self, name: str, hints: frozenset[str]) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.hints.update(hints)
        self.stack.append((name, hints))

    def cut(self, k: int) -> None:
        """End the elements from place k on."""
        while len(self.stack) > k:
            name, hints = self.stack.pop()
            places = self.places[name]
            places.pop()
            if not places:
                del self.places[name]
            for h in hints:
                self.hints[h] -= 1
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def close(self, name: str, barrier: frozenset[str]) -> None:
        """End an open element that the next tag implies is over."""
        k = self.last(name)
        if k >= 0 and k > max(map(self.last, barrier)):
            self.cut(k)


def _after(page: str, name: str, at: int) -> int:
    """Where the text of a skipped element ends."""
    closing = re.compile(rf"</{name}\b", re.I).search(page, at)
    end = page.find(">", closing.end()) if closing else -1
    return end + 1 if end >= 0 else len(page)


def _tag_end(page: str, at: int, doomed: set[int]) -> tuple[int, int]:
    """Where the attributes from `at` end, and where the page goes on after them.

    A '>' inside quotes does not end a tag. Where a quote is left open, the tag ends at its first '>'.
    `doomed` keeps the places outside quotes from which that was found, so that no stretch of a page is
    read again for each tag before it.
    """
    seen, x = [], at
    while x not in doomed:
        seen.append(x)
        mark = _MARK.search(page, x)
        if not mark:
            return len(page), len(page)
        if mark[0] == ">":
            return mark.start(), mark.end()
        close = page.find(mark[0], mark.end())
        if close < 0:
            break
        x = close + 1
    doomed.update(seen)
    end = page.find(">", at)
    return (end, end + 1) if end >= 0 else (len(page), len(page))


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks of text in order; character references decoded, white space folded."""
    blocks: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    linked = 0
    in_head = False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            own = open_.stack[open_.blocks[-1]][0] if open_.blocks else ""
            blocks.append(Block(text, frozenset(t for t in _TAGS if t in open_.places), frozenset(h for h, n in open_.hints.items() if n), own, linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if "a" in open_.places:
                linked += len(text)

    at, end = 0, len(page)
    doomed: set[int] = set()
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:].split("<", 1)[0] if re.match(r"[^<]*<[a-zA-Z/!]", page[at:]) else page[at:])
            break
        raw = page[at : m.start()]
        add(raw)
        at = m.end()
        if in_head and raw.strip():
            in_head = False
        name = (m[2] or "").lower()
        if not name:
            continue
        stop, at = _tag_end(page, at, doomed)
        attributes = page[m.end() : stop]
        if in_head:
            if m[1]:
                in_head = name not in HEAD_ENDS
                if in_head or name == "head":
                    continue
            elif name in HEAD_RAW:
                at = _after(page, name, at)
                continue
            elif name in HEAD_VOID or name == "head":
                continue
            else:
                in_head = False
        if m[1]:
            k = open_.last(name)
            if name in BLOCK or (k >= 0 and open_.blocks and open_.blocks[-1] >= k):
                flush()
            if k >= 0:
                open_.cut(k)
            continue
        if name == "head":
            in_head = True
            parts.append(" ")
            continue
        if name in RAW:
            if name != "svg" or not attributes.endswith("/") or _UNQUOTED.search(attributes):
                at = _after(page, name, at)
            if name not in {"svg", "canvas"}:
                parts.append(" ")
            continue
        if name in VOID or attributes.endswith("/"):
            if name in {"br", "hr", "img", "input"}:
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                open_.close("p", frozenset(("table", "button")))
            if name == "li":
                open_.close("li", frozenset(("ul", "ol", "menu")))
            elif name in {"td", "th"}:
                open_.close("td", frozenset(("table", "tr")))
                open_.close("th", frozenset(("table", "tr")))
            elif name == "tr":
                open_.close("tr", frozenset(("table",)))
            elif name in {"dt", "dd"}:
                open_.close("dt", frozenset(("dl",)))
                open_.close("dd", frozenset(("dl",)))
        open_.push(name, (_hints if len(attributes) < KEPT else _hints.__wrapped__)(attributes) if attributes else frozenset())
    flush()
    return blocks


_TAGS = "nav header footer aside form article main section ul ol li table td blockquote pre figure figcaption p div h1 h2 h3 h4 h5 h6 a button label dialog details".split()
_NAMES = (
    ["bias", *(f"in:{t}" for t in _TAGS), *(f"own:{t}" for t in _TAGS), *(f"hint:{h}" for h in HINTS)]
    + [f"size:{k}" for k in range(8)]
    + [f"links:{k}" for k in range(4)]
    + ["stop", "comma", "copyright", "pipe", "article&bad", "first", "last", "bad", "form-like"]
)
_INDEX = {n: i for i, n in enumerate(_NAMES)}
_BAD_TAGS = frozenset(("nav", "footer", "aside", "form", "dialog", "button", "label"))
_BAD_HINTS = frozenset(HINTS) - {"main"}


def features(blocks: list[Block]) -> list[list[int]]:
    """Numbers of each block's active features."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        f = [0]
        f += [_INDEX[f"in:{t}"] for t in b.tags if f"in:{t}" in _INDEX]
        if f"own:{b.tag}" in _INDEX:
            f.append(_INDEX[f"own:{b.tag}"])
        f += [_INDEX[f"hint:{h}"] for h in b.hints]
        f.append(_INDEX[f"size:{min(7, n.bit_length() - 1)}"])
        f.append(_INDEX[f"links:{min(3, 4 * b.linked // (n + 1))}"])
        bad = bool(b.tags & _BAD_TAGS or b.hints & _BAD_HINTS)
        for name, on in (
            ("stop", b.text[-1] in ".!?…"),
            ("comma", "," in b.text),
            ("copyright", "©" in b.text),
            ("pipe", "|" in b.text or "»" in b.text),
            ("bad", bad),
            ("article&bad", bad and ("article" in b.tags or "main" in b.tags)),
            ("form-like", "form" in b.tags),
            ("first", i == 0),
            ("last", i == len(blocks) - 1),
        ):
            if on:
                f.append(_INDEX[name])
        out.append(f)
    return out


@dataclass
class Field:
    """Weights: emission (features, 2), transition (2, 2), start (2)."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(0) for f in feats])

    def decode(self, feats: list[list[int]]) -> list[int]:
        """Viterbi: the best label sequence."""
        if not feats:
            return []
        s = self.scores(feats).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + s[0][0], self.start[1] + s[0][1]
        back = []
        for x, y in s[1:]:
            to0, to1 = int(b + m10 > a + m00), int(b + m11 > a + m01)
            a, b = (b + m10 if to0 else a + m00) + x, (b + m11 if to1 else a + m01) + y
            back.append((to0, to1))
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _gradient(field: Field, feats: list[list[int]], labels: list[int], grads: Field) -> None:
    """Adds the log-likelihood's gradient for one page by forward-backward."""
    s = field.scores(feats)
    n = len(s)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[0] = field.start + s[0]
    for i in range(1, n):
        alpha[i] = s[i] + np.logaddexp(alpha[i - 1, 0] + field.move[0], alpha[i - 1, 1] + field.move[1])
    for i in range(n - 2, -1, -1):
        v = s[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(field.move[:, 0] + v[0], field.move[:, 1] + v[1])
    z = np.logaddexp(*alpha[-1])
    p = np.exp(alpha + beta - z)
    for i, f in enumerate(feats):
        d = -p[i]
        d[labels[i]] += 1
        grads.emit[f] += d
    grads.start -= p[0]
    grads.start[labels[0]] += 1
    for i in range(1, n):
        q = np.exp(alpha[i - 1][:, None] + field.move + (s[i] + beta[i])[None] - z)
        grads.move -= q
        grads.move[labels[i - 1], labels[i]] += 1


def train(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 12, rate: float = 0.15, decay: float = 2e-3, seed: int = 3) -> Field:
    """A field fitted to labelled block sequences by Adagrad."""
    size = len(_NAMES)
    field = Field(np.zeros((size, 2)), np.zeros((2, 2)), np.zeros(2))
    total = Field(np.full((size, 2), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6))
    r = random.Random(seed)
    order = [i for i, p in enumerate(pages) if p[0]]
    for _ in range(epochs):
        r.shuffle(order)
        for at in range(0, len(order), 8):
            g = Field(np.zeros((size, 2)), np.zeros((2, 2)), np.zeros(2))
            for i in order[at : at + 8]:
                _gradient(field, *pages[i], g)
            for k in ("emit", "move", "start"):
                w, x, t = getattr(field, k), getattr(g, k), getattr(total, k)
                x -= decay * w
                t += x * x
                w += rate * x / np.sqrt(t)
    return field


_VOCABULARY = """the a of and to in is was for on with as by at from this that it are be have had not but which were one all their when more
 will would there she he they we you been its who has about after city water school work house year people government report market
 river mountain garden letter music history science winter summer morning evening family children teacher doctor market price money
 der die das und ist nicht ein eine mit auf für von werden über nach Stadt Straße Jahr Menschen Wasser Arbeit Schule
 el la los las que en un una por con para como más pero sus también año años ciudad agua trabajo niños mañana
 le les des est une dans pour qui sur avec pas plus où été ville eau travail enfants année être""".split()


def labelled_pages(n: int = 360, seed: int = 17) -> list[tuple[str, list[tuple[str, int]]]]:
    """Generated pages with the label of every block's text: 1 for the article's own blocks."""
    r = random.Random(seed)

    def word() -> str:
        return r.choice(_VOCABULARY)

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence() -> str:
        style = r.random()
        text = words(3, 18)
        if style < 0.05:
            return text.upper() + "!"
        if style < 0.12:
            return f"\u201c{text.capitalize()},\u201d said {word().capitalize()} {word().capitalize()}."
        if style < 0.2:
            return f"{text.capitalize()} {r.randint(2, 2030)}, {words(1, 6)} ({r.randint(1, 99)} %)."
        if style < 0.26:
            return f"{text.capitalize()}: {words(2, 5)}; {words(2, 5)} \u2014 {words(1, 4)}"
        return text.capitalize() + r.choice((".", ".", ".", "?", ",", ""))

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 9, 14))))

    pages = []
    for k in range(n):
        truth: list[tuple[str, int]] = []
        serial = [0]

        def text(body: str, label: int, truth=truth, serial=serial, k=k) -> str:
            serial[0] += 1
            whole = f"{body} x{k}n{serial[0]}"
            truth.append((" ".join(whole.split()), label))
            return entities.escape(whole, quote=False)

        def link(label: int) -> str:
            return f'<a href="/{word()}">{text(words(1, 3), label)}</a>'

        def menu() -> str:
            items = "".join(f"<li>{link(0)}</li>" for _ in range(r.randint(2, 7)))
            return r.choice(('<nav><ul>{}</ul></nav>', '<div class="menu"><ul>{}</ul></div>', '<ul id="main-nav">{}</ul>', '<header><nav><ul>{}</ul></nav></header>')).format(items)

        def box(kind: str) -> str:
            body = text(r.choice((words(1, 4), sentence(), paragraph())), 0)
            shapes = {
                "ad": ('<div class="ad">{}</div>', '<aside class="promo">{}</aside>', '<div class="sponsored-box"><p>{}</p></div>', '<div id="ad-top">{}</div>'),
                "notice": ('<div class="cookie-notice"><p>{}</p></div>', '<div role="dialog" class="consent">{}</div>', '<div class="alert">{}</div>'),
                "header": ('<header><p>{}</p></header>', '<div class="masthead">{}</div>', '<div id="header"><h2>{}</h2></div>'),
                "side": ('<aside>{}</aside>', '<div class="sidebar"><p>{}</p></div>', '<div class="related"><h3>{}</h3></div>', '<aside><h3>{}</h3></aside>'),
                "form": ('<form><label>{}</label><input type="text"></form>', '<form action="/s"><p>{}</p><button>OK</button></form>', '<div class="newsletter"><p>{}</p></div>'),
                "foot": ('<footer>&copy; {}</footer>', '<footer><p>{}</p></footer>', '<div class="footer">&copy; {}</div>', '<div id="footer"><p>{}</p></div>'),
                "talk": ('<div class="comments"><p>{}</p></div>', '<section id="comments"><div class="comment">{}</div></section>', '<ol class="comment-list"><li>{}</li></ol>'),
                "share": ('<div class="share">{}</div>', '<p class="byline">{}</p>', '<ul class="social"><li>{}</li></ul>'),
            }
            shape = r.choice(shapes[kind])
            if shape.startswith("<footer>&copy;") or "footer\">&copy;" in shape:
                truth[-1] = ("© " + truth[-1][0], 0)
            if "<button>OK" in shape:
                truth.append(("OK", 0))
            return shape.format(body)

        def article() -> str:
            out = [r.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", "<h1><b>{}</b></h1>")).format(text(words(2, 12), 1))] if r.random() < 0.85 else []
            for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
                style = r.random()
                if style < 0.62:
                    out.append(f"<p>{text(paragraph(), 1)}</p>")
                elif style < 0.7:
                    out.append(f"<p>{text(sentence(), 1)}")
                elif style < 0.76:
                    out.append(f"<h3>{text(words(1, 6), 1)}</h3>")
                elif style < 0.84:
                    out.append("<ul>" + "".join(f"<li>{text(sentence(), 1)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
                elif style < 0.88:
                    out.append(f"<blockquote>{text(sentence(), 1)}</blockquote>")
                elif style < 0.92:
                    out.append("<table>" + "".join(f"<tr><td>{text(words(1, 3), 1)}</td><td>{text(words(1, 3), 1)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
                elif style < 0.95:
                    out.append(f"<div>{text(paragraph(), 1)}</div>")
                else:
                    out.append(box(r.choice(("ad", "side", "share", "form", "notice"))))
            return "".join(out)

        shell = r.choice(("<article>{}</article>",) * 4 + ("<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div class="post-body">{}</div>', '<div id="main"><div class="entry">{}</div></div>', "<section>{}</section>", "<div>{}</div>"))
        before = [menu() if r.random() < 0.9 else "", *(box(x) for x in ("header", "ad", "notice", "side") if r.random() < 0.35)]
        r.shuffle(before)
        head = "".join(before)
        body = shell.format(article())
        after = [box(x) for x in ("ad", "side", "talk", "talk", "form", "share", "notice") if r.random() < 0.3]
        r.shuffle(after)
        tail = "".join(after) + (box("foot") if r.random() < 0.9 else "") + (menu() if r.random() < 0.15 else "")
        pages.append((f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{head}{body}{tail}</body></html>", truth))
    return pages


def sequences(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of labelled pages; blocks of unknown text count as not main."""
    out = []
    for page, truth in pages:
        blocks, known = leaf_blocks(page), dict(truth)
        out.append((features(blocks), [known.get(b.text, 0) for b in blocks]))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the default labelled pages."""
    return train(sequences(labelled_pages()))


def main_text(page: str | None, field: Field) -> str:
    """Texts of the blocks labelled as main, joined by a space."""
    blocks = leaf_blocks(page or "")
    return " ".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """`page_id, url, text, n_chars` for every row."""
    model = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), schema)
