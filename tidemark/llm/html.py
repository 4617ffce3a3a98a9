"""Main text of web pages: leaf blocks labelled by a bidirectional LSTM, written in numpy.

A page is cut into leaf blocks: the text between two block-level tags, with its path of open tags
and their classes. Scripts, styles, comments and the like are never text. Each block enters the
network as the mean of its hashed path elements, the mean of its hashed words, and a few numbers;
the two directions read all blocks of the page, so that each is judged with the whole page in view.

Training takes PAGES pages of smallest hash of their id. Their blocks are marked by what the markup
says (containers of articles, and of menus, notices and so on), and each page is varied with other
containers and foreign blocks, so that the network meets more layouts than the table has. Training is
seeded. Pages of more than TRAIN_BLOCKS blocks are not used for it; labelling has no such limit.

If no sampled page has a marked container, there is nothing to learn from, and all blocks that the markup does not mark as
something else are kept. Null and empty pages, and pages without main text, have an empty text. Text in elements such as buttons,
options, templates and objects is not the page's; one that is not closed ends at the next block or with its parent. White space within a block
becomes one space. A page that breaks off is read to its end. Repeated rows give repeated results;
further columns are ignored.
"""

import html as entities
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import BYTE_CODES, prefix_sums, read, slices, stretch_hashes, word_bounds
from tidemark.llm.toxicity import Adam

# Parameters of the method.
PAGES, TRAIN_BLOCKS, EPOCHS, BATCH, RATE = 300, 200, 6, 16, 0.01
PATH_ROWS, WORD_ROWS, PATH_DIM, WORD_DIM, HIDDEN = 1024, 2048, 16, 8, 12
NUMBERS = 4
DIM = PATH_DIM + WORD_DIM + NUMBERS

# Kinds of elements in HTML, and the container names that mark training blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup and ends at their end tag, or at the end of the page as in a browser.
RAW = frozenset("script style textarea iframe title xmp noembed noframes".split())
# Elements whose text is not the page's. Those of FLAT cannot hold blocks: if one is not closed, a block ends it.
UNSEEN = frozenset("noscript template object svg select optgroup option datalist button".split())
FLAT = frozenset("svg select optgroup option datalist button".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var".split()
)
GOOD = ("article", "main", "content", "post", "entry", "story", "body-text", "article-body")
BAD = (
    "nav", "header", "footer", "aside", "form", "menu", "ad", "ads", "advert", "sidebar", "comments", "comment", "cookie",
    "notice", "banner", "popup", "share", "related", "promo", "breadcrumb", "newsletter", "dialog", "login", "sponsor",
)
_TAGS = frozenset(("article", "main", "nav", "header", "footer", "aside", "form", "menu", "dialog"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_NAMED = re.compile(r"(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    # Name, what the path says of it, and whether its end tag is known to come.
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append(Block(path, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal path, linked
        if text and not any(t in UNSEEN for t, _, _ in stack):
            if not parts or not any(p.strip() for p in parts):
                path = tuple(e for _, own, _ in stack for e in own)
            parts.append(text)
            if any(t == "a" for t, _, _ in stack):
                linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        closing = bool(m[1])
        if name in RAW and not closing:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = close.start() if close else end
            continue
        if name in RAW:
            continue
        if name in VOID:
            if name in ("br", "wbr"):
                add(" " if name == "br" else "")
            elif name == "hr":
                flush()
            continue
        if name in BLOCK_TAGS and not closing:
            for i, (t, _, closed) in enumerate(stack):
                if t in FLAT and not closed:
                    del stack[i:]
                    break
        if name not in INLINE:
            flush()
        if m[3].endswith("/") and any(t == "svg" for t in (name, *(s[0] for s in stack))):
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "table", "div", "article", "section", "main"):
                    break
        own = [name]
        for a in _NAMED.finditer(m[3]):
            own += [f".{w.lower()}" for w in re.split(r"[\s_-]+", a[1] or a[2] or a[3] or "") if w]
        stack.append((name, tuple(own), name in FLAT and _is_closed(page, name, at)))
    flush()
    return out


def _is_closed(page: str, name: str, at: int) -> bool:
    """Whether an element that begins before `at` has an end tag before the next one of its name begins."""
    found = re.compile(f"<(/?){name}(?=[\\s/>]|\\Z)", re.I).search(page, at)
    return found is not None and bool(found[1])


def mark(path: tuple[str, ...]) -> int | None:
    """What the markup says of a block: 1 main text, 0 not, None nothing."""
    names = {e if e in _TAGS else e[1:] if e[0] == "." else "" for e in path}
    if names & set(BAD):
        return 0
    return 1 if names & set(GOOD) else None


_ROW: dict[str, int] = {}


def _row(element: str) -> int:
    if len(_ROW) > 100_000:
        _ROW.clear()
    if element not in _ROW:
        _ROW[element] = zlib.crc32(element.encode()) % PATH_ROWS
    return _ROW[element]


class Pages:
    """The blocks of some pages as arrays: path rows, word rows, numbers, and each page's first block."""

    def __init__(self, pages: list[list[Block]]):
        every = [b for p in pages for b in p]
        self.first = np.cumsum([0] + [len(p) for p in pages])
        paths = [[_row(e) for e in b.path if e not in ("html", "body")] or [0] for b in every]
        self.path_at = np.cumsum([0] + [len(p) for p in paths])
        self.path_rows = np.array([r for p in paths for r in p], np.int64)
        texts = [b.text.lower().encode("utf-8", "replace") for b in every]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0] + [len(t) for t in texts])
        starts, ends, self.word_at = word_bounds(data, offsets)
        self.word_rows = (stretch_hashes(prefix_sums(BYTE_CODES[data]), starts, ends) % np.uint64(WORD_ROWS)).astype(np.int64)
        size = np.array([len(b.text) for b in every], np.float32)
        place = np.arange(len(every)) - np.repeat(self.first[:-1], np.diff(self.first))
        self.numbers = np.stack(
            [
                np.log1p(size) / 5, np.array([b.linked for b in every], np.float32) / np.maximum(size, 1),
                (place == 0).astype(np.float32), np.array([b.text[-1] in ".!?" for b in every], np.float32),
            ],
            axis=1,
        ).astype(np.float32).reshape(-1, NUMBERS)


def _means(table: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of the table's rows for each stretch at[i]:at[i + 1]; zeros for an empty one."""
    counts = np.diff(at)
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(table[rows], at[full], axis=0) / counts[full, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Labeller:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.knows = True

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h = HIDDEN
        self.p = {
            "path": normal(PATH_ROWS, PATH_DIM, scale=0.3), "word": normal(WORD_ROWS, WORD_DIM, scale=0.1),
            "in": normal(DIM, 8 * h, scale=0.3), "bias": np.zeros(8 * h, np.float32),
            "rec0": normal(h, 4 * h, scale=0.3), "rec1": normal(h, 4 * h, scale=0.3),
            "out": normal(2 * h + DIM, scale=0.3), "shift": np.zeros(1, np.float32),
        }
        self.p["bias"][h : 2 * h] = self.p["bias"][5 * h : 6 * h] = 1.0  # the forget gates start open

    def inputs(self, pages: Pages) -> np.ndarray:
        return np.concatenate(
            [
                _means(self.p["path"], pages.path_rows, pages.path_at),
                _means(self.p["word"], pages.word_rows, pages.word_at), pages.numbers,
            ],
            axis=1,
        )

    def forward(self, x: np.ndarray, first: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """A logit for each block; the pages advance together."""
        p, h = self.p, HIDDEN
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], first[:-1][order]
        gates = x @ p["in"] + p["bias"]
        states = np.zeros((len(x), 2 * h), np.float32)
        steps = int(sizes[0]) if len(sizes) else 0
        counts = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)]  # pages longer than t
        for d in (0, 1):
            now, cell = np.zeros((len(sizes), h), np.float32), np.zeros((len(sizes), h), np.float32)
            for t in range(steps):
                n = counts[t]
                at = starts[:n] + (t if d == 0 else sizes[:n] - 1 - t)
                g = gates[at, 4 * h * d : 4 * h * (d + 1)] + now[:n] @ p[f"rec{d}"]
                ifo, c = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
                i, f, o = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h :]
                before, old = now[:n].copy(), cell[:n].copy()
                cell[:n] = f * old + i * c
                top = np.tanh(cell[:n])
                now[:n] = o * top
                states[at, h * d : h * (d + 1)] = now[:n]
                if trace is not None:
                    trace[d, t] = (n, at, before, old, i, f, o, c, top)
        if trace is not None:
            trace["states"], trace["steps"], trace["pages"] = states, steps, len(sizes)
        return np.concatenate([states, x], axis=1) @ p["out"] + p["shift"][0]

    def gradients(self, pages: Pages, target: np.ndarray, known: np.ndarray) -> dict:
        p, h, trace = self.p, HIDDEN, {}
        x = self.inputs(pages)
        logits = self.forward(x, pages.first, trace)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        top = ((_sigmoid(logits) - target) * known / max(1, known.sum())).astype(np.float32)
        both = np.concatenate([trace["states"], x], axis=1)
        g["out"], g["shift"][0] = top @ both, top.sum()
        d_both = top[:, None] * p["out"]
        d_gates = np.zeros((len(x), 8 * h), np.float32)
        for d in (0, 1):
            carry = np.zeros((trace["pages"], h), np.float32)
            cell = np.zeros((trace["pages"], h), np.float32)
            for t in range(trace["steps"] - 1, -1, -1):
                n, at, before, old, i, f, o, c, up = trace[d, t]
                dh = d_both[at, h * d : h * (d + 1)] + carry[:n]
                dc = dh * o * (1 - up * up) + cell[:n]
                d_g = np.concatenate(
                    [dc * c * i * (1 - i), dc * old * f * (1 - f), dh * up * o * (1 - o), dc * i * (1 - c * c)], axis=1
                )
                g[f"rec{d}"] += before.T @ d_g
                carry[:n], cell[:n] = d_g @ p[f"rec{d}"].T, dc * f
                d_gates[at, 4 * h * d : 4 * h * (d + 1)] = d_g
        g["in"], g["bias"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_x = d_gates @ p["in"].T + d_both[:, 2 * h :]
        for name, rows, at, part in (
            ("path", pages.path_rows, pages.path_at, d_x[:, :PATH_DIM]),
            ("word", pages.word_rows, pages.word_at, d_x[:, PATH_DIM : PATH_DIM + WORD_DIM]),
        ):
            counts = np.diff(at)
            np.add.at(g[name], rows, np.repeat(part / np.maximum(counts, 1)[:, None], counts, axis=0))
        return g


def _container(rng: np.random.Generator, name: str) -> tuple[str, ...]:
    if name in _TAGS and rng.random() < 0.7:
        return (name,)
    return (str(rng.choice(["div", "section", "ul", "p"])), f".{name}")


def varied(page: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int | None]]:
    """The page with another main container and with blocks in containers of other kinds."""
    marks = [mark(b.path) for b in page]
    if rng.random() < 0.5:
        new = _container(rng, str(rng.choice(GOOD)))
        page = [
            b._replace(path=tuple(x for e in b.path for x in (new if e == "article" else (e,)))) if m == 1 else b
            for b, m in zip(page, marks)
        ]
    page, marks = list(page), list(marks)
    for _ in range(int(rng.integers(0, 5))):
        like = page[int(rng.integers(len(page)))]
        at = int(rng.integers(0, len(page) + 1))
        around = _container(rng, str(rng.choice(GOOD))) if rng.random() < 0.4 else ()
        inner = (str(rng.choice(["p", "li", "span", "div", "h2"])),)
        path = ("html", "body", *around, *_container(rng, str(rng.choice(BAD))), *inner)
        run = int(rng.integers(1, 4))
        page[at:at] = [Block(path, like.text, like.linked)] * run
        marks[at:at] = [0] * run
    return page, marks


def train(pages: list[str]) -> Labeller:
    rng, net = np.random.default_rng(9), Labeller()
    read_pages = [b for b in map(blocks, pages) if 0 < len(b) <= TRAIN_BLOCKS]
    read_pages = [b for b in read_pages if any(mark(x.path) == 1 for x in b)]
    net.knows = bool(read_pages)
    adam = Adam(net.p, RATE)
    for _ in range(EPOCHS):
        order = rng.permutation(len(read_pages))
        for a in range(0, len(order), BATCH):
            some, marks = zip(*(varied(read_pages[i], rng) for i in order[a : a + BATCH]))
            flat = [m for row in marks for m in row]
            known = np.array([m is not None for m in flat], np.float32)
            target = np.array([m or 0 for m in flat], np.float32)
            adam.step(net.p, net.gradients(Pages(list(some)), target, known))
    return net


def main_text(net: Labeller, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    arrays = Pages(found)
    keep = (net.forward(net.inputs(arrays), arrays.first) >= 0).tolist() if arrays.first[-1] else []
    if not net.knows:
        keep = [mark(b.path) != 0 for page in found for b in page]
    return [
        "\n\n".join(b.text for b, k in zip(page, keep[a:e]) if k)
        for page, a, e in zip(found, arrays.first[:-1].tolist(), arrays.first[1:].tolist())
    ]


def fit(pages: DataFrame) -> Labeller:
    """A labeller from a bounded sample of pages."""
    own = pages.select("page_id", "html").filter("page_id IS NOT NULL AND length(html) BETWEEN 1 AND 60000")
    # Ids first, so that no task sends PAGES whole pages; PAGES ids at most are broadcast.
    ids = own.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(PAGES)
    rows = own.join(F.broadcast(ids), "page_id").dropDuplicates(["page_id"]).collect()
    return train([r["html"] for r in sorted(rows, key=lambda r: r["page_id"])])


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(net or fit(pages))  # a fixed number of weights
    frame = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    kinds = dict(frame.dtypes)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for at, end, _, _ in slices(batch.column("html"), 4 << 20):
                texts = main_text(shared.value, batch.column("html").slice(at, end - at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id").slice(at, end - at), batch.column("url").slice(at, end - at),
                        pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return frame.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark, folder: str) -> DataFrame:
    return extract(read(spark, folder, "pages"))
