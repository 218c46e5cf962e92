"""Main-text extraction by a recurrent block labeller.

A page is read as its sequence of leaf blocks: runs of text between block-level tags, each with the path of open tags
above it. A block's vector is its hashed tag path, its hashed words and a few figures (length, share of link text,
punctuation, place on the page). A bidirectional LSTM in NumPy reads the whole sequence and labels every block as main text
or not in the light of all the others. The page's text is the main blocks, in order, one a line.

Training: weak labels from pages that mark their main part up (``article`` or ``main``), at most ``TRAIN_PAGES`` different rows, those of
smallest md5 of the id. The marks themselves are left out of the tag path, so the model has to do without them.
With no marked page there is no model and every block counts as main text.

Scale: one scan, no shuffle; the reader goes through a page once, by index, in time linear in it whatever is left open; the weights (some 30,000 floats) are broadcast. Pages are scored in groups of like length, at most
``STEPS`` block steps at a time or one page.

Defined edge cases: a null page has null text and no blocks, an empty one empty text, an empty table no rows; stray tags, comments,
scripts and styles are tolerated; quotes count only after ``=``, and one that is never closed is an ordinary character; a head ends at its end tag, the first tag that cannot stand in one, or text outside its title;
what an unclosed script, style, comment or tag swallows is what a browser's would (an unclosed template or noscript nothing);
entities are decoded; long pages are read whole (tag paths keep their ``DEPTH`` innermost tags, and a mark); a block of score exactly 0.5 is not main; repeated rows are labelled alike;
null ids are kept, but not trained on; only the two columns named are read, extra columns of any name are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES, EPOCHS, HIDDEN, STEPS, DEPTH = 200, 8, 24, 40_000, 32
_TAGS, _WORDS, _FIGURES = 32, 64, 6
WIDTH = _TAGS + _WORDS + _FIGURES

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_ATTRIBUTE = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_RAW = {t: re.compile(rf"</{t}(?![a-zA-Z0-9])", re.I) for t in ("script", "style", "template", "noscript")}
_TITLE = re.compile(r"(</title\s*>)|<body\b|</head\b", re.I)
_HEAD = frozenset("html head title base basefont bgsound link meta".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data em font i kbd label mark q s samp small span strong sub sup time u var tt ins del img wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_MARKS = ("article", "main")
_SPLIT = re.compile(r"\w+")


def tokens(page: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, lower-case tag name, start, stop) of what a page is made of; kind: text, open, close or skip."""
    pos, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    nowhere: set[str] = set()  # raw tags without an end from here on
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            yield "text", "", pos, at
            pos = at
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            yield "skip", "", at, pos
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            pos = n if end < 0 else end + 1
            yield "skip", "", at, pos
        elif m := _TAG.match(page, at):
            pos = m.end()
            while a := _ATTRIBUTE.search(page, pos):
                pos = a.end()
                if a[0] == ">":
                    break
                pos = _VALUE.match(page, pos).end()
                quote = page[pos : pos + 1]
                if quote and quote in "\"'" and last[quote] > pos:
                    pos = page.find(quote, pos + 1) + 1
                else:
                    pos = _UNQUOTED.match(page, pos).end()
            else:
                pos = n
            tag = m[2].lower()
            if tag in _RAW and not m[1]:
                end = None if tag in nowhere else _RAW[tag].search(page, pos)
                if end:
                    close = page.find(">", end.end())
                    pos = n if close < 0 else close + 1
                elif tag in ("script", "style"):
                    pos = n
                else:
                    nowhere.add(tag)
                yield "skip", "", at, pos
            elif tag in _RAW:
                yield "skip", "", at, pos
            else:
                yield "close" if m[1] else "open", tag, at, pos
        else:
            pos = at + 1
            yield "text", "", at, pos


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of open block tags, text, characters of it inside links) of each leaf block.

    The path has the innermost DEPTH tags, and a mark of the main part first if one is open farther out.
    """
    out, path, parts, link, links = [], [], [], 0, 0
    opened: dict[str, int] = {}
    head, open_title, titled = False, False, 0  # in a head, in a title without end, end of the last title
    ahead: tuple[int, int] = (-1, 0)  # start and, if it is one, end of the next title's end: searched once

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            own = tuple(path[-DEPTH:])
            mark = next((t for t in _MARKS if opened.get(t)), None)
            out.append(((mark, *own) if mark and not any(t in _MARKS for t in own) else own, text, min(links, len(text))))
        parts.clear()
        links = 0

    def leave() -> str:
        tag = path.pop()
        opened[tag] -= 1
        return tag

    for kind, tag, start, stop in tokens(page):
        if start < titled:
            continue
        if kind == "text" and head and not page[start:stop].isspace():
            if open_title:
                continue
            head = False
        if kind == "text":
            parts.append(page[start:stop])
            links += stop - start if link else 0
            continue
        if kind == "skip":
            parts.append(" ")
            continue
        if tag == "head":
            head, open_title = kind == "open", False
            parts.append(" ")
            continue
        if head and (tag in _HEAD if kind == "open" else tag not in ("body", "html", "br")):
            if tag == "title" and kind == "open" and not open_title:
                if ahead[0] < stop:
                    m = _TITLE.search(page, stop)
                    ahead = (m.start(), m.end() if m[1] else 0) if m else (len(page), 0)
                titled, open_title = ahead[1], not ahead[1]
            continue
        head = False
        if tag in _INLINE:
            if tag == "a":
                link = int(kind == "open")
            continue
        flush()
        if kind == "close":
            if opened.get(tag):
                while leave() != tag:
                    pass
        elif tag not in _VOID:
            while path and path[-1] in _CLOSES.get(tag, ()):
                leave()
            path.append(tag)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


class Vectors:
    """Blocks to vectors; slots of words are remembered, up to a bound."""

    def __init__(self, memo: int = 300_000):
        self.slots: dict[str, int] = {}
        self.memo = memo
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            v = np.zeros(_TAGS, dtype=np.float32)
            kept = [t for t in path if t not in _MARKS]
            for depth, t in enumerate(reversed(kept)):
                v[_slot(t, _TAGS)] += 0.6**depth
            self.paths[path] = v
        return self.paths[path]

    def page(self, found: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
        n = len(found)
        x = np.zeros((n, WIDTH), dtype=np.float32)
        if not n:
            return x
        if len(self.slots) > self.memo:
            self.slots.clear()
        slots, at, count = [], [], np.zeros(n)
        for i, (path, text, links) in enumerate(found):
            x[i, :_TAGS] = self._path(path)
            words = _SPLIT.findall(text.lower())
            for w in words:
                s = self.slots.get(w)
                if s is None:
                    s = self.slots[w] = _slot(w, _WORDS)
                slots.append(s)
            at.append(len(words))
            count[i] = len(words)
            x[i, -_FIGURES + 1] = links / len(text)
            x[i, -_FIGURES + 2] = min(1.0, 20 * sum(map(text.count, ".,;!?")) / len(text))
        hist = np.bincount(np.repeat(np.arange(n), at) * _WORDS + np.array(slots, dtype=np.int64), minlength=n * _WORDS).reshape(n, _WORDS)
        x[:, _TAGS : _TAGS + _WORDS] = hist / np.sqrt(np.maximum(1, count))[:, None]
        x[:, -_FIGURES] = np.log1p(count) / 4
        x[:, -3] = np.arange(n) / n
        x[:, -2] = 1 / n
        x[:, -1] = 1
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors with a logistic output."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * h)).astype(np.float32)
            self.w["h" + d] = rng.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32)
            self.w["c" + d] = np.zeros(4 * h, dtype=np.float32)
            self.w["c" + d][h : 2 * h] = 1  # remember at first
        self.w["o"] = rng.normal(0, (2 * h) ** -0.5, 2 * h).astype(np.float32)
        self.w["q"] = np.zeros(1, dtype=np.float32)

    def _direction(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, batch, _ = x.shape
        h, z_in = self.h, x.reshape(-1, WIDTH) @ self.w["x" + d] + self.w["c" + d]
        z_in = z_in.reshape(steps, batch, 4 * h)
        out, hid, cell, tape = np.zeros((steps, batch, h), dtype=np.float32), np.zeros((batch, h), dtype=np.float32), np.zeros((batch, h), dtype=np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + hid @ self.w["h" + d]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            on = live[t][:, None]
            new = np.where(on, f * cell + i * g, cell)
            tan = np.tanh(new)
            nxt = np.where(on, o * tan, hid)
            if keep:
                tape.append((t, hid, cell, i, f, o, g, tan, on))
            hid, cell = nxt, new
            out[t] = nxt
        return out, tape

    def scores(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """[steps, batch] probabilities for padded [steps, batch, WIDTH] vectors."""
        both = np.concatenate([self._direction(x, live, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["q"])

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, runs = self.h, {d: self._direction(x, live, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        err = (_sigmoid(both @ self.w["o"] + self.w["q"]) - y) * live / max(1, live.sum())
        grad = {"o": np.einsum("tb,tbh->h", err, both), "q": err.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            d_out = err[:, :, None] * self.w["o"][k * h : (k + 1) * h]
            d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            d_z = np.zeros((*x.shape[:2], 4 * h), dtype=np.float32)
            g_h = np.zeros_like(self.w["h" + d])
            for t, hid, cell, i, f, o, g, tan, on in reversed(runs[d][1]):
                d_h = d_h + d_out[t]
                up = np.where(on, d_h, 0)
                d_new = np.where(on, d_c + up * o * (1 - tan**2), 0)
                z = np.concatenate([d_new * g * i * (1 - i), d_new * cell * f * (1 - f), up * tan * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
                d_z[t] = z
                g_h += hid.T @ z
                d_h = np.where(on, z @ self.w["h" + d].T, d_h)
                d_c = np.where(on, d_new * f, d_c)
            flat = d_z.reshape(-1, 4 * h)
            grad |= {"x" + d: x.reshape(-1, WIDTH).T @ flat, "h" + d: g_h, "c" + d: flat.sum(axis=0)}
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, live = np.zeros((steps, len(pages), WIDTH), dtype=np.float32), np.zeros((steps, len(pages)), dtype=bool)
    for j, p in enumerate(pages):
        x[: len(p), j], live[: len(p), j] = p, True
    return x, live


def like_length(sizes: list[int], steps: int = STEPS) -> Iterator[list[int]]:
    """Groups of pages of similar length whose padded size stays within ``steps`` (one page at least)."""
    group: list[int] = []
    for i in sorted((i for i, n in enumerate(sizes) if n), key=lambda i: -sizes[i]):
        if group and sizes[group[0]] * (len(group) + 1) > steps:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def fit(pages: list[str], epochs: int = EPOCHS, seed: int = 11) -> Labeller | None:
    """A labeller from pages that mark their main part up; None if there are none."""
    vectors, xs, ys = Vectors(), [], []
    for page in pages:
        found = blocks(page)
        y = np.array([any(t in _MARKS for t in path) for path, _, _ in found], dtype=np.float32)
        if len(y) and y.any():
            xs.append(vectors.page(found))
            ys.append(y)
    if not xs:
        return None
    model, rng = Labeller(), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in model.w.items()}
    square = {k: np.zeros_like(v) for k, v in model.w.items()}
    batches, step = list(like_length([len(x) for x in xs], 600)), 0
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            x, live = padded([xs[i] for i in batches[b]])
            y = np.zeros(live.shape, dtype=np.float32)
            for j, i in enumerate(batches[b]):
                y[: len(ys[i]), j] = ys[i]
            step += 1
            for k, g in model.gradients(x, live, y).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                model.w[k] = (model.w[k] - 0.02 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def label_pages(pages: list[str | None], model: Labeller | None, vectors: Vectors) -> list[tuple[list[str], list[bool]]]:
    """Texts and labels of the blocks of each page."""
    found = [blocks(p) if p else [] for p in pages]
    labels = [[True] * len(f) for f in found]
    for group in like_length([len(f) for f in found]) if model else ():
        x, live = padded([vectors.page(found[i]) for i in group])
        yes = model.scores(x, live) > 0.5
        for j, i in enumerate(group):
            labels[i] = yes[: len(found[i]), j].tolist()
    return [([t for _, t, _ in f], y) for f, y in zip(found, labels, strict=True)]


def training_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = TRAIN_PAGES) -> list[str]:
    """At most ``limit`` different labelled rows, however often an id or a row repeats."""
    rows = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("page")).where(F.col("i").isNotNull() & F.lower("page").rlike("<(article|main)[ >]"))
    keyed = rows.withColumns({"h": F.md5(F.col("i").cast("string")), "x": F.md5("page")})
    chosen = [(r["i"], r["x"]) for r in keyed.groupBy("h", "i", "x").count().orderBy("h", "i", "x").limit(limit).collect()]  # the bound on labelled rows
    if not chosen:
        return []
    wanted = keyed.where(F.col("i").isin([i for i, _ in chosen]) & F.col("x").isin([x for _, x in chosen])).dropDuplicates(["i", "x"])
    by_key = {(r["i"], r["x"]): r["page"] for r in wanted.orderBy("h", "i", "x").limit(limit).collect()}
    return [by_key[k] for k in sorted(chosen) if k in by_key]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n_blocks, n_main, text) of every page."""
    model = pages.sparkSession.sparkContext.broadcast(fit(training_pages(pages, id_col, html_col)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for b in it:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = part.column(1).to_pylist()
                found = label_pages(rows, model.value, vectors)
                text = [None if p is None else "\n".join(t for t, y in zip(*f, strict=True) if y) for p, f in zip(rows, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(f[0]) for f in found], type=pa.int32()), pa.array([sum(f[1]) for f in found], type=pa.int32()), pa.array(text, type=pa.string())],
                    names=["page_id", "n_blocks", "n_main", "text"],
                )

    source = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, f"page_id {dict(pages.dtypes)[id_col]}, n_blocks int, n_main int, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
