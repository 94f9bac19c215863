"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, with their
tag path.  Scripts, styles, comments and other silent elements are skipped, character references
are decoded, white space becomes one space.  Each block is a vector: hashed tokens of its tag path
(tag names, classes, ids, roles), hashed words, and a few shape numbers.  A bidirectional LSTM in
numpy reads the whole sequence in both directions and a logistic output labels every block, so
the label uses context from the whole page; the blocks labelled content are joined by a blank line.

Training needs no hand labels: a bounded sample of pages (``SAMPLE_PAGES`` of at most ``SAMPLE_CHARS`` characters, the rows
of least ``xxhash64`` of url and html) is labelled by the names of their tags, and each is also re-dressed: its
content moves under other content containers, and menus, asides, notices, forms, adverts and reader
comments under many names, or names that mean nothing, are put around and into it.  The network is small (a few thousand
weights), trained on the driver within seconds and broadcast.  Every page is then extracted whole.

Defined cases: null or empty html gives empty text; a page without blocks too; unclosed, misnested
and unknown tags are accepted; a page of any length is read whole (its blocks are run through the
network in one sequence).  With no page to learn from, the re-dressed built-in page alone trains
the model.  Repeated pages give repeated results; extra columns pass through; clashing ones are replaced.
"""

from __future__ import annotations

import html as _html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm.shared import without

SAMPLE_PAGES, SAMPLE_CHARS, VARIANTS, HIDDEN, EPOCHS, SEED = 160, 200_000, 4, 24, 24, 7
_PATH_DIM, _WORD_DIM, _SHAPE_DIM = 128, 32, 8
DIM = _PATH_DIM + _WORD_DIM + _SHAPE_DIM

# Element names of HTML.
_SILENT = ("script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "canvas", "audio", "video", "title")
#: These run to the end of the page if they are left open; other open silent tags are skipped alone.
_RAW = ("script", "style", "textarea")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names of containers used to re-dress training pages.
_CONTENT = ['article', 'main', 'div class="content"', 'div id="content"', 'div class="post-body"', 'section class="entry-content"', 'div class="article-body"', 'div id="main-text"', 'div class="story"', 'main role="main"', 'article class="post"', 'div itemprop="articleBody"', 'section class="text"']
_FURNITURE = ['nav', 'header', 'footer', 'aside', 'form', 'div class="menu"', 'ul class="nav"', 'div class="navbar"', 'div class="breadcrumb"', 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"',
              'div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="banner"', 'div class="sponsored"', 'div class="promo"', 'div class="cookie-notice"', 'div class="cookie"', 'div class="notice"',
              'div class="alert"', 'div class="consent"', 'div class="popup"', 'div class="newsletter"', 'div class="subscribe"', 'div class="comments"', 'section id="comments"', 'div class="comment"', 'ol class="comment-list"', 'section class="comments"', 'div id="disqus_thread"',
              'div class="related"', 'div class="share"', 'div class="social"', 'div class="footer"', 'div id="footer"', 'div class="header"', 'div id="header"', 'div class="masthead"', 'div class="copyright"', 'div class="login"', 'form class="search"', 'div class="pagination"',
              'div class="tags"', 'div role="navigation"', 'div role="banner"', 'div role="contentinfo"', 'aside class="sidebar"', 'div class="reader-comments"', 'div class="replies"', 'dialog', 'menu',
              'div class="user-comments"', 'section class="responses"', 'div id="feedback"', 'div class="cookie-consent"', 'div class="privacy-overlay"', 'div class="modal"', 'div class="toolbar"', 'div class="topbar"', 'div class="rail"',
              'ul class="links"', 'div class="recommended"', 'div class="more-stories"', 'div class="signup"', 'div class="legal"', 'div class="sitemap"', 'section class="thread"', 'div class="bottom-bar"', 'div class="partner"', 'div class="tracker"']

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SILENT}
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z0-9]+")


def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def path_tokens(tag: str, attributes: str) -> tuple:
    """Tag name, and the parts of its class, id, role and itemprop."""
    out = [tag]
    if attributes:
        for m in _ATTR.finditer(attributes):
            out += _NAME.findall((m[2] or m[3] or m[4] or "").lower())
    return tuple(out)


def leaf_blocks(page: str | None) -> list:
    """``(path, text, linked characters)`` of every leaf block, in page order."""
    blocks: list = []
    if not page:
        return blocks
    stack: list = []
    links, pieces, linked, at = 0, [], 0, 0
    left_open: set = set()  # silent tags that no end tag follows any more

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                blocks.append((tuple(x for _, toks in stack for x in toks), text, linked))
            pieces.clear()
        linked = 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at:m.start()]
            pieces.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _CLOSE and not m[1]:
            if not m[3].endswith("/"):
                close = None if tag in left_open else _CLOSE[tag].search(page, at)
                if close:
                    at = close.end()
                else:
                    left_open.add(tag)
                    at = len(page) if tag in _RAW else at
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        links = 0
        if tag == "head":
            continue  # what it may hold is silent by itself, and its end tag is optional
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()  # an open paragraph or item ends where the next begins
            stack.append((tag, path_tokens(tag, m[3])))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return blocks


def block_vectors(blocks: list) -> np.ndarray:
    """One row per block: hashed path, hashed words, shape."""
    out = np.zeros((len(blocks), DIM), np.float32)
    paths: dict = {}
    for i, (path, text, linked) in enumerate(blocks):
        got = paths.get(path)
        if got is None:
            got = np.zeros(_PATH_DIM, np.float32)
            for depth, token in enumerate(reversed(path)):
                got[_slot(token, _PATH_DIM)] += 1.0 if depth < 6 else 0.5
            paths[path] = got = np.minimum(got, 2)
        out[i, :_PATH_DIM] = got
        words = text.lower().split(" ")
        slots = [_slot(w.strip(".,;:!?()"), _WORD_DIM) for w in words]
        out[i, _PATH_DIM:_PATH_DIM + _WORD_DIM] = np.bincount(slots, minlength=_WORD_DIM) / len(words) ** 0.5
        n = len(text)
        out[i, -_SHAPE_DIM:] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1.0, linked / n), text[-1] in ".!?", text[0].isupper(),
                                "©" in text, i / len(blocks), len(path) / 8)
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output, in numpy."""

    def __init__(self, weights: dict):
        self.w = weights

    @staticmethod
    def fresh(seed: int = SEED) -> "Labeller":
        rng = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w["x" + side] = rng.normal(0, 0.15, (DIM, 4 * HIDDEN)).astype(np.float32)
            w["h" + side] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w["b" + side] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        w["o"] = rng.normal(0, 0.15, (2 * HIDDEN, 1)).astype(np.float32)
        w["c"] = np.zeros(1, np.float32)
        return Labeller(w)

    def _run(self, x, mask, side, trace=None):
        n, steps, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        pre = x @ self.w["x" + side] + self.w["b" + side]
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w["h" + side]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN:(k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            h2 = o * th
            if trace is not None:
                trace.append((t, i, f, o, g, c, th, h, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[:, t] = h
        return out

    def forward(self, x, mask):
        return 1 / (1 + np.exp(-np.clip(np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2) @ self.w["o"] + self.w["c"], -30, 30)))[:, :, 0]

    def gradients(self, x, mask, y):
        traces: dict = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, s, traces[s]) for s in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + self.w["c"], -30, 30)))
        d = (p[:, :, 0] - y) * mask / mask.sum()
        g = {"o": np.einsum("nth,nt->h", both, d)[:, None], "c": np.array([d.sum()], np.float32)}
        back = d[:, :, None] * self.w["o"][:, 0]
        for k, side in enumerate("fb"):
            own = back[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            gx, gh, gb = (np.zeros_like(self.w[n + side]) for n in "xhb")
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, gg, c0, th, h0, m in reversed(traces[side]):
                total = dh + own[:, t]
                on = np.where(m, total, 0)
                dct = np.where(m, dc, 0) + on * o * (1 - th * th)
                dz = np.concatenate([dct * gg * i * (1 - i), dct * c0 * f * (1 - f), on * th * o * (1 - o), dct * i * (1 - gg * gg)], axis=1)
                gx += x[:, t].T @ dz
                gh += h0.T @ dz
                gb += dz.sum(axis=0)
                dh = np.where(m, dz @ self.w["h" + side].T, total)
                dc = np.where(m, dct * f, dc)
            g["x" + side], g["h" + side], g["b" + side] = gx, gh, gb
        return g

    def labels(self, sequences: list) -> list:
        """Content or not for every block; pages of like length share a batch."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1  # padded to the longest: at most 4,096 steps, or one page
            while hi < len(order) and (hi - lo + 1) * max(1, len(sequences[order[hi]])) <= 4096:
                hi += 1
            part = [i for i in order[lo:hi] if len(sequences[i])]
            if part:
                x, mask = _padded([sequences[i] for i in part])
                p = self.forward(x, mask)
                for k, i in enumerate(part):
                    out[i] = p[k, :len(sequences[i])] >= 0.5
            lo = hi
        return out


def _padded(rows: list):
    steps = max(len(r) for r in rows)
    x = np.zeros((len(rows), steps, rows[0].shape[1]), np.float32)
    mask = np.zeros((len(rows), steps), bool)
    for k, r in enumerate(rows):
        x[k, :len(r)], mask[k, :len(r)] = r, True
    return x, mask


def train(pages: list, seed: int = SEED) -> Labeller:
    """Fit on ``(blocks, labels)`` pages by Adam."""
    model = Labeller.fresh(seed)
    rng = np.random.default_rng(seed)
    data = [(block_vectors(b), np.array(y, np.float32)) for b, y in pages if b]
    data.sort(key=lambda d: len(d[0]))
    batches, lo = [], 0
    while lo < len(data):
        hi = lo + 1  # at most 32 pages, padded to at most 16,384 steps, or one page
        while hi < len(data) and hi - lo < 32 and (hi - lo + 1) * len(data[hi][0]) <= 16384:
            hi += 1
        x, mask = _padded([d[0] for d in data[lo:hi]])
        y = np.zeros(mask.shape, np.float32)
        for k, d in enumerate(data[lo:hi]):
            y[k, :len(d[1])] = d[1]
        batches.append((x, mask, y))
        lo = hi
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            step += 1
            g = model.gradients(*batches[b])
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v / max(1.0, size)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                rate = 0.02 if epoch < EPOCHS * 2 // 3 else 0.006
                model.w[k] = (model.w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


_CONTENT_TOKENS = frozenset({"article", "main"})
_FURNITURE_TOKENS = frozenset("nav header footer aside form ad ads advert advertisement menu sidebar notice cookie comments comment related banner".split())


def named_label(path: tuple) -> int | None:
    """What the tag names say: content, furniture, or nothing (None)."""
    if any(t in _FURNITURE_TOKENS for t in path):
        return 0
    return 1 if any(t in _CONTENT_TOKENS for t in path) else None


def redress(blocks: list, rng, furniture_specs: list | None = None, content_specs: list | None = None) -> tuple[list, list]:
    """The same page in other clothes: content under another container, furniture of many names
    before, after and amid it, some of it in whole sentences of the page's own kind.  In two pages of five
    the classes and ids say nothing (made-up names), and one in eight is laid out as a table."""
    specs, contents = furniture_specs or _FURNITURE, content_specs or _CONTENT
    silent, table = rng.random() < 0.4 and not furniture_specs, rng.random() < 0.12
    body = [b for b in blocks if named_label(b[0]) == 1]
    rest = [b for b in blocks if named_label(b[0]) == 0]
    if not body:
        return [], []

    def dressed(spec, inner):
        tag, _, attributes = spec.partition(" ")
        names = path_tokens(tag, attributes)
        if silent and len(names) > 1:  # the tag stays, each name becomes one that means nothing
            names = (tag, *(f"n{_slot(spec + n, 997)}" for n in names[1:]))
        cell = ("table", "tr", "td") if table and tag in ("div", "section", "ul") else ()
        return ("html", "body", *(("div",) if rng.random() < 0.4 else ()), *cell, *names, *inner)

    def furniture(whole=0.25):
        spec = specs[rng.integers(5 if specs is _FURNITURE and rng.random() < 0.3 else len(specs))]  # the five that are tags
        own = []
        for _ in range(int(rng.integers(1, 5))):
            # nothing but its words, links and place tells furniture without a name
            plain = (silent or table) and " " in spec
            source = rest if rest and rng.random() < (0.9 if plain else 0.4) else body
            words = source[rng.integers(len(source))][1].split(" ")
            lo = int(rng.integers(len(words)))
            if plain or rng.random() >= whole:  # else a whole block, as a reader may write
                words = words[lo:lo + int(rng.choice([2, 4] if plain and source is body else [2, 4, 12, 40]))]
            text = " ".join(words)
            inner = (("ul", "li"), ("p",), (), ("div",), ("div", "p"), ("h3",), ("h1",), ("h2",), ("h4",), ("label",))[rng.integers(10)]
            own.append(((dressed(spec, inner), text, len(text) if rng.random() < 0.3 else 0), 0))
        return own

    spec = contents[rng.integers(len(contents))]
    main = []
    for path, text, linked in body:
        tail = path[-1] if path and path[-1] not in _CONTENT_TOKENS else "p"
        if tail == "p" and rng.random() < 0.2:
            tail = ("li", "blockquote", "h2", "td", "pre", "h3", "figcaption", "dd")[rng.integers(8)]
        inner = {"li": ("ul", "li"), "td": ("table", "tr", "td"), "blockquote": ("blockquote", "p"), "figcaption": ("figure", "figcaption"), "dd": ("dl", "dd")}.get(tail, (tail,))
        main.append(((dressed(spec, inner), text, linked), 1))
    out = [x for _ in range(int(rng.integers(0, 4))) for x in furniture()]
    for block in main:
        out.append(block)
        if rng.random() < 0.03:
            out += [((dressed(spec, x[0][0][2:]), x[0][1], x[0][2]), 0) for x in furniture()]
    if rng.random() < 0.6:  # comments and notices at the end of the content's own container
        out += [((dressed(spec, x[0][0][2:]), x[0][1], x[0][2]), 0) for _ in range(int(rng.integers(1, 3))) for x in furniture(0.7)]
    out += [x for _ in range(int(rng.integers(0, 4))) for x in furniture()]
    return [b for b, _ in out], [y for _, y in out]


#: Fixed page that is always trained on, so that an empty table has a model too.
_BUILT_IN = ("<html><body><nav><ul><li><a>Home</a></li><li><a>About</a></li></ul></nav><article><h1>A title</h1><p>One sentence of the text.</p>"
             "<p>Another sentence, which is longer than the first one was.</p></article><footer>&copy; 2020</footer></body></html>")


def learn(pages: DataFrame, html_col: str = "html", order_col: str = "url", sample_pages: int = SAMPLE_PAGES,
          sample_chars: int = SAMPLE_CHARS) -> Labeller:
    """Train on a bounded sample of pages (parameters: their number, and the length of pages that are learned
    from) and their re-dressed forms.  The least hashes are found first, then only their pages are fetched."""
    hashed = (pages.select(F.col(html_col).alias("_h"), F.xxhash64(order_col, html_col).alias("_o"))
              .where(F.length("_h").between(1, sample_chars)))
    least = [r[0] for r in hashed.select("_o").distinct().orderBy("_o").limit(sample_pages).collect()]
    found = hashed.where(F.col("_o").isin(least)).groupBy("_o").agg(F.min("_h").alias("_h")).collect() if least else []
    sample = [(r["_h"],) for r in sorted(found, key=lambda r: r["_o"])]
    rng = np.random.default_rng(SEED)
    data = []
    for page in [_BUILT_IN, *[r[0] for r in sample]]:
        blocks = leaf_blocks(page)
        labels = [named_label(b[0]) for b in blocks]
        known = [(b, y) for b, y in zip(blocks, labels, strict=True) if y is not None]
        data.append(([b for b, _ in known], [y for _, y in known]))
        data += [redress(blocks, rng) for _ in range(VARIANTS)]
    return train(data)


def extract_texts(model: Labeller, pages: list) -> list:
    blocks = [leaf_blocks(p) for p in pages]
    marks = model.labels([block_vectors(b) for b in blocks])
    return ["\n\n".join(x[1] for x, y in zip(b, m, strict=True) if y) if m is not None else "" for b, m in zip(blocks, marks, strict=True)]


def extract(pages: DataFrame, html_col: str = "html", order_col: str = "url", model: Labeller | None = None,
            keep: list | None = None, out: str = "text") -> DataFrame:
    """``keep`` columns of every page (all by default) and its main text as ``out``."""
    base = without(pages, *([out] if out != html_col else []))
    keep = base.columns if keep is None else keep
    model = learn(pages, html_col, order_col) if model is None else model
    shipped = pages.sparkSession.sparkContext.broadcast(model.w)

    def run(batches):
        labeller = Labeller(shipped.value)
        for batch in batches:
            html = batch.column(len(keep))
            texts: list = []
            for lo in range(0, batch.num_rows, 256):
                texts += extract_texts(labeller, html.slice(lo, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, out])

    fields = [base.schema[c] for c in keep]
    return base.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))
