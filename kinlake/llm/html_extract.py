"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its text blocks (what stands between block-level tags).
Each block is described by its tag path, with class and id words, hashed to one
vector; its words, hashed to another; and a few numbers.  A bidirectional LSTM in
numpy reads the whole sequence and labels every block with the context of the whole
page.  Blocks labelled as article are joined in page order.

The labeller is trained here on generated pages of many layouts (:func:`training_page`),
with a fixed seed, in a few seconds of one task; its weights are broadcast (under 1 MB
whatever the input).  A long page is read in windows that carry the states on, so memory
is that of its blocks.

Edge cases: null, empty and textless html give an empty text; broken markup is read as
far as it goes (an unclosed tag ends at the end of the page); white space inside a
block, no-break space included, becomes one space; equal rows get equal results; null
ids are rows like others; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.session import small_batches, table, trimmed

PATH_DIM, WORD_DIM, NUMBERS = 96, 32, 6
INPUT = PATH_DIM + WORD_DIM + NUMBERS
HIDDEN = 24
SEED = 11
TRAIN_PAGES, EPOCHS, BATCH = 2400, 10, 32
PAGES_AT_ONCE = 64
CELLS = 8192
HTML_BYTES = 4 << 20
WORD_CACHE = 300_000

# Elements that end a block, elements whose content is no text, elements without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style template noscript textarea iframe svg math object canvas audio video title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What an opening tag closes without saying so.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PARENTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']*(?:"[^"]*"|'[^']*'))*[^>"']*|[^>]*)(?:>|\Z)|[^<]+|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Path:
    """A tag path with its class and id words: one step below another path, so a deep page holds each step once."""

    __slots__ = ("up", "names", "length", "counts")

    def __init__(self, up: "Path | None", names: tuple[str, ...]) -> None:
        self.up, self.names, self.length = up, names, len(names) + (up.length if up else 0)
        self.counts: np.ndarray | None = None

    def last(self, n: int) -> list[str]:
        """The innermost ``n`` names."""
        out, step = [], self
        while step is not None and len(out) < n:
            out = [*step.names[-(n - len(out)) :], *out] if step.names else out
            step = step.up
        return out

    def hashed(self) -> np.ndarray:
        """How many names fall into each of the vector's places, from the outermost step on."""
        steps: list[Path] = []
        step: Path | None = self
        while step is not None and step.counts is None:
            steps.append(step)
            step = step.up
        counts = step.counts if step is not None else np.zeros(PATH_DIM, dtype=np.float32)
        for step in reversed(steps):
            counts = counts.copy()
            for name in step.names:
                counts[_place(name)] += 1.0
            step.counts = counts
        return counts


_ROOT = Path(None, ())


@lru_cache(maxsize=100_000)
def _place(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_DIM


Block = tuple[Path, str, float]


def blocks_of(page: str) -> list[Block]:
    """``(path, text, share of characters inside links)`` of each non-empty block."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()  # how often each tag is on the stack
    text: list[str] = []
    linked, link_depth = 0, 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            out.append((stack[-1][1] if stack else _ROOT, joined, min(1.0, linked / len(joined))))
        text.clear()
        linked = 0

    def drop(k: int) -> None:
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def up_to(names: set[str], stop: set[str]) -> None:
        if not any(opened[name] for name in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                drop(k)
                return
            if stack[k][0] in stop:
                return

    while at < end:
        found = _TOKEN.match(page, at)
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3)
        if tag is None:
            piece = found.group()
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                linked += len(piece) * (link_depth > 0)
            continue
        tag = tag.lower()
        if tag in RAW_TAGS and not closing:
            close()
            if not attributes.endswith("/"):
                done = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = done.end() if done else end
            continue
        if tag == "a":
            link_depth = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        close()
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                drop(k)
            continue
        if stack and stack[-1][0] == "p":
            drop(len(stack) - 1)  # a block inside a paragraph ends it
        if tag in CLOSES:
            up_to(CLOSES[tag], _PARENTS[tag])
        if tag in VOID_TAGS:
            continue
        names = [w for groups in _NAMES.findall(attributes) for w in _SPLIT.split("".join(groups).lower()) if w] if attributes else []
        stack.append((tag, Path(stack[-1][1] if stack else _ROOT, (f"<{tag}", *names))))
        opened[tag] += 1
    close()
    return out


def _path_vector(path: Path) -> np.ndarray:
    out = path.hashed().copy()
    for name in path.last(2):  # the innermost names once more, apart
        out[_place("^" + name)] += 0.5
    return np.tanh(out)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[word] = zlib.crc32(word.lower().encode()) % WORD_DIM
        return got


def features(blocks: list[Block], words: _Words, first: int = 0, total: int | None = None) -> np.ndarray:
    """Vectors of blocks; of a page's part when it starts at block ``first`` of ``total``."""
    out = np.zeros((len(blocks), INPUT), dtype=np.float32)
    total = len(blocks) if total is None else total
    for k, (path, text, links) in enumerate(blocks):
        row, parts = out[k], text.split(" ")
        row[:PATH_DIM] = _path_vector(path)
        counts = np.bincount([words[w] for w in parts], minlength=WORD_DIM)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = counts / (1.0 + np.sqrt((counts * counts).sum()))
        row[PATH_DIM + WORD_DIM :] = (np.log1p(len(parts)) / 5, links, (text.count(".") + text.count(",")) / len(parts), text[-1] in ".!?:\"'", (first + k) / total, np.log1p(path.length) / 3)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, w: dict[str, np.ndarray], side: str, keep: bool = False, state: tuple[np.ndarray, np.ndarray] | None = None):
    """States ``(T, B, H)`` of one direction over ``(T, B, INPUT)``; with ``keep`` what training needs, too.

    With ``state``, the hidden and cell states to go on from, the states to go on from afterwards are returned, too.
    """
    t, b, _ = x.shape
    gates_in = (x.reshape(t * b, -1) @ w["x" + side] + w["b" + side]).reshape(t, b, -1)
    h, c = state or (np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32))
    out, kept = np.empty((t, b, HIDDEN), np.float32), []
    for k in range(t):
        z = gates_in[k] + h @ w["h" + side]
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((i, f, o, g, before, tc, h))
        h = o * tc
        out[k] = h
    if state:
        return out, (h, c)
    return (out, kept) if keep else out


def _backward(grad: np.ndarray, x: np.ndarray, kept: list, w: dict[str, np.ndarray], side: str) -> dict[str, np.ndarray]:
    t, b, _ = x.shape
    dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    dz_all, dwh = np.empty((t, b, 4 * HIDDEN), np.float32), np.zeros_like(w["h" + side])
    for k in range(t - 1, -1, -1):
        i, f, o, g, before, tc, h = kept[k]
        dh = dh + grad[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[k] = dz
        dwh += h.T @ dz
        dh, dc = dz @ w["h" + side].T, dc * f
    flat = dz_all.reshape(t * b, -1)
    return {"x" + side: x.reshape(t * b, -1).T @ flat, "h" + side: dwh, "b" + side: flat.sum(0)}


def _batch(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded ``(T, B, INPUT)``, the same with each sequence turned round, and for each place its turned place."""
    t, b = max(map(len, sequences)), len(sequences)
    x, turned = np.zeros((t, b, INPUT), np.float32), np.zeros((t, b, INPUT), np.float32)
    place = np.tile(np.arange(t)[:, None], (1, b))
    for k, s in enumerate(sequences):
        x[: len(s), k], turned[: len(s), k] = s, s[::-1]
        place[: len(s), k] = np.arange(len(s))[::-1]
    return x, turned, place


def _scores(pages: list[list[Block]], w: dict[str, np.ndarray], words: _Words) -> list[np.ndarray]:
    """The score of each block of some pages, of like numbers of blocks.

    Both directions go through the pages in windows of about ``CELLS`` blocks over all
    pages and carry their states on, so what is held beside the blocks is one window and a
    number per block, however long a page is.
    """
    lengths = [len(p) for p in pages]
    t, b = max(lengths), len(pages)
    step = max(1, CELLS // b)
    out = [np.zeros(n, np.float32) for n in lengths]
    whole = [features(p, words) for p in pages] if t <= step else None  # one window: both directions read the same vectors
    for side, part in (("f", w["out"][:HIDDEN, 0]), ("r", w["out"][HIDDEN:, 0])):
        state = (np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32))
        for lo in range(0, t, step):
            x = np.zeros((min(step, t - lo), b, INPUT), np.float32)
            for k, (page, n) in enumerate(zip(pages, lengths, strict=True)):
                first, end = (lo, min(n, lo + step)) if side == "f" else (max(0, n - lo - step), n - lo)
                if first < end:
                    got = whole[k] if whole else features(page[first:end], words, first, n)
                    x[: end - first, k] = got if side == "f" else got[::-1]
            states, state = _forward(x, w, side, state=state)
            z = states @ part
            for k, n in enumerate(lengths):
                first, end = (lo, min(n, lo + step)) if side == "f" else (max(0, n - lo - step), n - lo)
                if first < end:
                    out[k][first:end] += z[: end - first, k] if side == "f" else z[: end - first, k][::-1]
    return [z + w["bias"][0] for z in out]


# Names of class and id attributes by role, for generated pages.
_ROLES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav sitemap tabs links",
    "header": "header masthead banner topbar branding logo siteheader",
    "footer": "footer bottom copyright colophon legal sitefooter imprint",
    "aside": "sidebar aside related widget rail popular trending recommended tags secondary",
    "notice": "notice cookie consent gdpr alert popup modal newsletter subscribe paywall disclaimer banner",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsense",
    "form": "form search login signup contact comment newsletter field",
    "comments": "comment comments reply replies discussion respond disqus thread feedback reader",
    "share": "share social sharing follow toolbar buttons meta",
}
_MAIN = "content main article post entry story body text page maincontent postcontent entrycontent articlebody".split()
_SAID = {
    "nav": "home about contact news products services blog menu next previous sitemap",
    "header": "welcome search logo subscribe login menu",
    "footer": "copyright rights reserved privacy terms imprint contact powered",
    "aside": "related popular recent posts tags categories more read also",
    "notice": "we use cookies accept consent subscribe newsletter privacy policy agree",
    "ad": "advertisement sponsored buy now offer sale free discount shop",
    "form": "name email password search submit send login message",
    "comments": "reply said comment posted wrote likes ago report user",
    "share": "share tweet like follow print email",
}


def training_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A generated page, and for each of its blocks whether it is article."""
    syllables = ["".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouäéó") for _ in range(1)) + rng.choice(["", "n", "r", "s", "st", "nd"]) for _ in range(60)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    parts: list[str] = []
    labels: list[bool] = []

    def prose(n: int, role: str | None = None) -> str:
        said = _SAID.get(role or "", "").split()
        tokens = [rng.choice(said) if said and rng.random() < 0.4 else word() for _ in range(max(1, n))]
        text = " ".join(tokens).capitalize()
        return text + rng.choice([".", ".", ".", "", "!"]) if role else re.sub(r"(\w+ \w+ \w+ \w+ \w+) ", r"\1, ", text, count=rng.randint(0, 3)) + "."

    def emit(tag: str, text: str, article: bool, link: float = 0.0, attributes: str = "") -> None:
        if rng.random() < link:
            text = f'<a href="/{word()}">{text}</a>'
        elif rng.random() < 0.1:
            text = f"<{(i := rng.choice(['b', 'em', 'span']))}>{text}" + ("" if rng.random() < 0.3 else f"</{i}>")
        parts.append(f"<{tag}{attributes}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>"))
        labels.append(article)

    def named(role: str) -> str:
        names = rng.sample(_ROLES[role].split(), k=rng.randint(1, 2))
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice([" ", "-"]).join(names)}"'

    def boilerplate(role: str) -> None:
        own = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "aside": ["aside"], "form": ["form"]}.get(role, [])
        tag = rng.choice(own * 2 + ["div", "section"] if role != "form" else ["form"])
        parts.append(f"<{tag}{named(role) if tag in ('div', 'section') or rng.random() < 0.5 else ''}>")
        long_one = role in ("comments", "ad", "notice", "aside", "footer") and rng.random() < 0.6
        if rng.random() < 0.35:  # text without a block of its own
            parts.append(prose(rng.randint(6, 60) if long_one else rng.randint(2, 14), role if rng.random() < 0.5 else None))
            labels.append(False)
        elif role in ("nav", "aside", "share", "footer") and rng.random() < 0.7:
            parts.append("<ul>")
            for _ in range(rng.randint(1, 8)):
                emit("li", prose(rng.randint(1, 3), role if rng.random() < 0.5 else None).rstrip("."), False, 0.85)
            parts.append("</ul>")
        elif role == "form":
            for _ in range(rng.randint(1, 4)):
                emit(rng.choice(["label", "p", "button", "div"]), prose(rng.randint(1, 4), role), False)
        else:
            for _ in range(rng.randint(1, 6 if role == "comments" else 2)):
                text = prose(rng.randint(6, 60) if long_one else rng.randint(2, 12), role if rng.random() < 0.5 else None)
                emit(rng.choice(["p", "div", "p", "h3", "li"] if role == "comments" else ["p", "div", "h4"]), text, False, 0.1)
        parts.append(f"</{tag}>")

    before = [r for r in ("header", "nav", "notice", "ad", "form", "share", "aside") if rng.random() < 0.45]
    rng.shuffle(before)
    after = [r for r in ("comments", "aside", "share", "ad", "form", "notice", "nav") if rng.random() < 0.35] + (["footer"] if rng.random() < 0.8 else [])
    for role in before:
        boilerplate(role)
    wraps = []
    for _ in range(rng.randint(0, 2)):
        t = rng.choice(["div", "section", "main"])
        parts.append(f"<{t}>" if rng.random() < 0.4 else f'<{t} {rng.choice(["class", "id"])}="{rng.choice(_MAIN)}">')
        wraps.append(t)
    tag = rng.choice(["article", "article", "article", "div", "main", "section"])
    parts.append(f"<{tag}>" if tag in ("article", "main") and rng.random() < 0.7 else f'<{tag} {rng.choice(["class", "id"])}="{"-".join(rng.sample(_MAIN, rng.randint(1, 2)))}">')
    wraps.append(tag)
    if rng.random() < 0.9:
        emit("h1", prose(rng.randint(1, 14)).rstrip("."), True)
    for _ in range(rng.choice([1, 2, rng.randint(1, 30)])):
        kind = rng.random()
        n = rng.choice([1, 2, rng.randint(1, 12), rng.randint(10, 90), rng.randint(10, 140)])
        if kind < 0.78:
            emit("p", prose(n), True, 0.03)
        elif kind < 0.86:
            emit(rng.choice(["h2", "h3"]), prose(rng.randint(1, 8)).rstrip("."), True)
        elif kind < 0.92:
            parts.append("<ul>")
            for _ in range(rng.randint(1, 5)):
                emit("li", prose(rng.randint(1, 20)), True, 0.05)
            parts.append("</ul>")
        elif kind < 0.96:
            emit(rng.choice(["blockquote", "pre", "figcaption", "td"]), prose(rng.randint(3, 30)), True)
        else:
            boilerplate(rng.choice(["ad", "share", "aside", "notice"]))
    if rng.random() < 0.2:
        boilerplate("comments")
    parts += [f"</{t}>" for t in reversed(wraps)]
    for role in after:
        boilerplate(role)
    return "<html><body>" + "".join(parts) + "</body></html>", labels


@lru_cache(maxsize=1)
def trained(seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights after ``EPOCHS`` over ``TRAIN_PAGES`` generated pages (Adam on the cross entropy)."""
    rng, dice = random.Random(seed), np.random.default_rng(seed)
    data, words = [], _Words()
    while len(data) < TRAIN_PAGES:
        page, labels = training_page(rng)
        blocks = blocks_of(page)
        if len(blocks) == len(labels) and blocks:
            data.append((features(blocks, words), np.array(labels, np.float32)))
    w = {"out": dice.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
    for side in "fr":
        w |= {"x" + side: dice.normal(0, 0.12, (INPUT, 4 * HIDDEN)), "h" + side: dice.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), "b" + side: np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    data.sort(key=lambda d: len(d[1]))
    starts = list(range(0, len(data), BATCH))
    for epoch in range(EPOCHS):
        rng.shuffle(starts)
        for lo in starts:
            part = data[lo : lo + BATCH]
            x, turned, place = _batch([s for s, _ in part])
            y, mask = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
            for k, (_, labels) in enumerate(part):
                y[: len(labels), k], mask[: len(labels), k] = labels, 1
            f, kept_f = _forward(x, w, "f", keep=True)
            r, kept_r = _forward(turned, w, "r", keep=True)
            both = np.concatenate([f, np.take_along_axis(r, place[:, :, None], 0)], 2)
            dz = ((_sigmoid(both @ w["out"] + w["bias"])[:, :, 0] - y) * mask / mask.sum())[:, :, None]
            grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "bias": dz.sum((0, 1))}
            d = dz @ w["out"].T
            grads |= _backward(d[:, :, :HIDDEN], x, kept_f, w, "f")
            grads |= _backward(np.take_along_axis(d[:, :, HIDDEN:], place[:, :, None], 0), turned, kept_r, w, "r")
            step += 1
            rate = 0.012 * (0.5 if epoch >= EPOCHS - 3 else 1.0)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


_weights: dict[int, dict[str, np.ndarray]] = {}


def trained_on_an_executor(spark: SparkSession, seed: int = SEED) -> dict[str, np.ndarray]:
    """:func:`trained` in one task, where numpy keeps to one thread; kept by the driver for later calls."""
    if seed not in _weights:

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                pass
            w = trained(seed)
            yield pa.RecordBatch.from_pylist([{"name": k, "shape": list(v.shape), "raw": v.tobytes()} for k, v in w.items()])

        rows = spark.range(1, numPartitions=1).mapInArrow(train, "name string, shape array<long>, raw binary").collect()
        _weights[seed] = {r["name"]: np.frombuffer(r["raw"], np.float32).reshape(r["shape"]) for r in rows}
    return _weights[seed]


def extract(pages: list[str | None], weights: dict[str, np.ndarray], words: _Words) -> list[str]:
    """The article text of each page."""
    blocks = [blocks_of(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if blocks[k]), key=lambda k: len(blocks[k]))
    at = 0
    while at < len(order):  # pages of like lengths together: padded to twice the shortest at most
        part = [k for k in order[at : at + PAGES_AT_ONCE] if len(blocks[k]) <= max(32, 2 * len(blocks[order[at]]))]
        at += len(part)
        for k, z in zip(part, _scores([blocks[k] for k in part], weights, words), strict=True):
            out[k] = "\n".join(text for (_, text, _), score in zip(blocks[k], z.tolist(), strict=True) if score > 0)
    return out


def page_groups(column: pa.Array, most: int = HTML_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``4 * PAGES_AT_ONCE`` pages with about ``most`` bytes of html, or one page."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float))
    lo, held = 0, 0.0
    for k, size in enumerate(sizes):
        if k > lo and (held + size > most or k - lo >= 4 * PAGES_AT_ONCE):
            yield lo, k
            lo, held = k, 0.0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html)``."""
    small_batches(pages.sparkSession)
    weights = pages.sparkSession.sparkContext.broadcast(trained_on_an_executor(pages.sparkSession))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for lo, hi in page_groups(batch.column("html")):
                part = batch.slice(lo, hi - lo)
                texts = extract(part.column("html").to_pylist(), weights.value, words)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(trimmed(read), "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page."""
    return extract_text(table(spark, sf_dir, "pages"))
