"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into blocks: runs of text between block-level tags, each with its chain of open elements.  Features are the chain's tags and the words of
its classes, ids and roles, and what the text looks like (length, end, share of links).  The chain's labels, main text or not, are decoded by
Viterbi; weights come from the likelihood of labelled pages (html_pages.py, a bounded number), by gradient steps with forward-backward sums.

Extraction is one map over the scan.  Defined results: a null, empty or text-free page gives the empty text and 0; broken markup is read as far as it goes
(an unclosed comment, raw element or tag takes the rest); what scripts, styles, titles, templates, frames and text areas hold is no text; repeated rows alike; a null url stays null; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, tidy
from .html_pages import MARK, labelled_pages

PAGES, EPOCHS = 1200, 6
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
NAME_PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: Read to their end tags as they stand: none of it is text of the page.
RAW = frozenset("script style noscript template textarea title iframe".split())
#: Formulas are part of the sentence around them.
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction menclose semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
#: Blocks that may stand within a paragraph and close none.
WITHIN = frozenset("svg object canvas select datalist optgroup option".split())
#: Any other opening block closes an open one of these.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Of these, an opening one closes the one before it in the same list or table.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist"), "optgroup": ("select",)}


class Block:
    __slots__ = ("chain", "text", "linked")

    def __init__(self, chain: tuple, text: str, linked: int):
        self.chain, self.text, self.linked = chain, text, linked


def element(name: str, attrs: str) -> tuple:
    """An element of a chain: its tag and the words of its names."""
    words: list[str] = []
    if attrs and not attrs.isspace():
        for key, value in ATTR.findall(attrs):
            key = key.lower()
            if key == "hidden" or key == "style" and "none" in value:
                words.append("hidden")
            elif key != "style":
                words += NAME_PART.findall(value.lower())
    return (name, *sorted(set(words)))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    chain: list[tuple] = []
    parts: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)
    made: dict[tuple[str, str], tuple] = {}

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(tuple(chain), text, linked))
            parts, linked = [], 0

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if name in INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
            elif name == "br":
                parts.append(" ")
            continue
        close()
        if m[1]:
            for i in range(len(chain) - 1, -1, -1):
                if chain[i][0] == name:
                    del chain[i:]
                    break
            in_link = 0
            continue
        if name in RAW and not (m[3].rstrip().endswith("/") and any(e[0] == "svg" for e in chain)):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if chain and chain[-1][0] in LEAVES and name not in WITHIN:
            chain.pop()
        if name in SIBLINGS:
            for i in range(len(chain) - 1, -1, -1):
                if chain[i][0] == name:
                    del chain[i:]
                    break
                if chain[i][0] in SIBLINGS[name]:
                    break
        if name not in VOID and not m[3].rstrip().endswith("/"):
            key = (name, m[3])
            if key not in made:
                made[key] = element(name, m[3])
            chain.append(made[key])
    close()
    return out


def chain_features(chain: tuple) -> tuple[str, ...]:
    seen = {f"in:{e[0]}" for e in chain} | {f"name:{w}" for e in chain for w in e[1:]}
    if chain:
        seen.add(f"parent:{chain[-1][0]}")
    return tuple(sorted(seen))


def text_features(b: Block, first: bool) -> tuple[str, ...]:
    text = b.text
    size = len(text)
    found = ["bias", f"size:{min(6, int(math.log2(size + 1)) // 1)}" if size < 64 else "size:long", f"links:{min(3, 4 * b.linked // max(size, 1))}", "stop" if text[-1] in ".!?:;" else "open"]
    if text[0] in "©" or "copyright" in text[:40].lower():
        found.append("copy")
    if first:
        found.append("first")
    return tuple(found)


class Model:
    """Weights of features for main text, and of the four steps from label to label."""

    def __init__(self, weights: dict[str, float], step: list[list[float]]):
        self.weights, self.step = weights, step
        self.memo: dict[tuple, float] = {}

    def emission(self, b: Block, first: bool) -> float:
        own = self.memo.get(b.chain)
        if own is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            own = self.memo[b.chain] = sum(self.weights.get(f, 0.0) for f in chain_features(b.chain))
        return own + sum(self.weights.get(f, 0.0) for f in text_features(b, first))

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        s, back = self.step, []
        v0, v1 = 0.0, self.emission(page[0], True)
        for b in page[1:]:
            e = self.emission(b, False)
            a0, a1, b0, b1 = v0 + s[0][0], v1 + s[1][0], v0 + s[0][1], v1 + s[1][1]
            back.append((int(a1 > a0), int(b1 > b0)))
            v0, v1 = max(a0, a1), max(b0, b1) + e
        label = int(v1 > v0)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def marginals(e: list[float], s: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Probabilities of main text at each block and expected counts of the steps, by forward-backward."""
    n = len(e)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    f = [(0.0, e[0])]
    for i in range(1, n):
        a, b = f[-1]
        f.append((add(a + s[0][0], b + s[1][0]), add(a + s[0][1], b + s[1][1]) + e[i]))
    g = [(0.0, 0.0)] * n
    for i in range(n - 2, -1, -1):
        a, b = g[i + 1][0], g[i + 1][1] + e[i + 1]
        g[i] = (add(s[0][0] + a, s[0][1] + b), add(s[1][0] + a, s[1][1] + b))
    z = add(*f[-1])
    counts = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(n - 1):
        for x in (0, 1):
            for y in (0, 1):
                counts[x][y] += math.exp(f[i][x] + s[x][y] + (e[i + 1] if y else 0.0) + g[i + 1][y] - z)
    return [math.exp(f[i][1] + g[i][1] - z) for i in range(n)], counts


def fit(pages: list[str], epochs: int = EPOCHS) -> Model:
    """Adaptive gradient steps on the likelihood of pages whose main blocks start with MARK."""
    data = []
    for page in pages:
        found = blocks(page)
        y = [int(b.text.startswith(MARK)) for b in found]
        for b in found:
            b.text = b.text.lstrip(MARK) or "."
        if found:
            data.append(([(*chain_features(b.chain), *text_features(b, i == 0)) for i, b in enumerate(found)], y))
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    s, s_seen = [[0.5, 0.0], [0.0, 0.5]], [[1.0, 1.0], [1.0, 1.0]]
    for _ in range(epochs):
        for x, y in data:
            p, counts = marginals([sum(w.get(f, 0.0) for f in row) for row in x], s)
            grad: dict[str, float] = {}
            for row, label, q in zip(x, y, p):
                if abs(label - q) > 1e-3:
                    for f in row:
                        grad[f] = grad.get(f, 0.0) + label - q
            for f, g in grad.items():
                g -= 1e-3 * w.get(f, 0.0)
                seen[f] = seen.get(f, 1e-2) + g * g
                w[f] = w.get(f, 0.0) + 0.3 * g / math.sqrt(seen[f])
            for a, b in zip(y, y[1:]):
                counts[a][b] -= 1
            for a in (0, 1):
                for b in (0, 1):
                    s_seen[a][b] += counts[a][b] ** 2
                    s[a][b] -= 0.1 * counts[a][b] / math.sqrt(s_seen[a][b])
    return Model(w, s)


@functools.cache
def trained(pages: int = PAGES) -> Model:
    return fit(labelled_pages(pages))


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, y in zip(found, model.decode(found)) if y)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars)"""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(p, model) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
