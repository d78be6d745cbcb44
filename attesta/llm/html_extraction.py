"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block is a vector: hashed tokens of
its tag path, hashed words of its text, and its length and link share.  A
bidirectional LSTM in numpy reads the whole sequence, so every block is
classified with all the others in view.  It is trained here, on pages made by
``practice_pages``: layouts with and without semantic tags, whose blocks are
known to be article or not.  The given pages carry no labels and are not used.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import blocks
from .words import small_batches

PATH, WORDS = 384, 64
WIDTH = PATH + WORDS + 4


@lru_cache(maxsize=100_000)
def path_slots(path: tuple[str, ...]) -> tuple[int, ...]:
    tokens = set(path) | {">" + "/".join(t for t in path if t[0] != ".")[-40:], "leaf " + next((t for t in reversed(path) if t[0] != "."), "")}
    return tuple(sorted({zlib.crc32(t.encode()) % PATH for t in tokens}))


@lru_cache(maxsize=50_000)
def word_slot(word: str) -> int:
    return PATH + zlib.crc32(word.encode()) % WORDS


def vectors(page: list[tuple]) -> np.ndarray:
    """(blocks, WIDTH) input of the network."""
    out = np.zeros((len(page), WIDTH), np.float32)
    for i, (path, text, linked) in enumerate(page):
        out[i, list(path_slots(path))] = 1
        words = text.lower().split()
        for w in words:
            out[i, word_slot(w)] += 1 / len(words)
        n = len(text)
        out[i, -4:] = (min(np.log1p(n) / 6, 1.5), linked / n, text[-1] in ".!?:;\"”»…", i / len(page))
    return out


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class BlockLabeller:
    """Bidirectional LSTM with a linear reading of both states and of the input."""

    def __init__(self, hidden: int = 16, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "lr":
            self.p["x" + d] = rng.normal(0, 0.1, (WIDTH, 4 * hidden)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1  # remember at first
            self.p["b" + d] = bias
        self.p["out"] = rng.normal(0, 0.2, (2 * hidden, 1)).astype(np.float32)
        self.p["skip"] = np.zeros((WIDTH, 1), np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def walk(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, B, hidden) of one direction."""
        T, B, _ = x.shape
        H = self.hidden
        given = x @ self.p["x" + d] + self.p["b" + d]
        h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        out = np.zeros((T, B, H), np.float32)
        for t in range(T) if d == "l" else range(T - 1, -1, -1):
            z = given[t] + h @ self.p["h" + d]
            gates = sigmoid(z[:, :3 * H])
            g = np.tanh(z[:, 3 * H:])
            i, f, o = gates[:, :H], gates[:, H:2 * H], gates[:, 2 * H:]
            m = mask[t][:, None]
            c_new = f * c + i * g
            th = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self.walk(d, x, mask, None if keep is None else keep.setdefault(d, [])) for d in "lr"], axis=2)
        if keep is not None:
            keep["both"] = both
        return (both @ self.p["out"] + x @ self.p["skip"])[:, :, 0] + self.p["c"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the blocks and its gradient, back through time."""
        keep: dict = {}
        z = self.logits(x, mask, keep)
        n = mask.sum()
        loss = float((mask * (np.logaddexp(0, z) - y * z)).sum() / n)
        dz = (mask * (sigmoid(z) - y) / n)[:, :, None].astype(np.float32)
        H = self.hidden
        grad = {"out": np.tensordot(keep["both"], dz, ([0, 1], [0, 1])), "skip": np.tensordot(x, dz, ([0, 1], [0, 1])), "c": dz.sum((0, 1))}
        d_states = dz @ self.p["out"].T
        for d, part in (("l", slice(0, H)), ("r", slice(H, None))):
            given = np.zeros((*x.shape[:2], 4 * H), np.float32)
            dh, dc = np.zeros((x.shape[1], H), np.float32), np.zeros((x.shape[1], H), np.float32)
            grad["h" + d] = np.zeros_like(self.p["h" + d])
            for t, h, c, i, f, o, g, th, m in reversed(keep[d]):
                dh = dh + d_states[t][:, part]
                dm = m * dh
                dct = m * dc + dm * o * (1 - th * th)
                step = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dm * th * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                given[t] = step
                grad["h" + d] += h.T @ step
                dh = step @ self.p["h" + d].T + (1 - m) * dh
                dc = dct * f + (1 - m) * dc
            grad["x" + d] = np.tensordot(x, given, ([0, 1], [0, 1]))
            grad["b" + d] = given.sum((0, 1))
        return loss, grad

    def label(self, pages: list[np.ndarray], most_cells: int = 20_000) -> list[np.ndarray]:
        """Whether each block of each page is article text; pages of like length share a batch."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            size = max(1, most_cells // len(pages[order[0]]))
            batch = order[:size]
            while len(batch) > 1 and len(pages[batch[-1]]) * len(batch) > most_cells:
                batch.pop()
            order = order[len(batch):]
            x, mask = padded([pages[i] for i in batch])
            z = self.logits(x, mask)
            for j, i in enumerate(batch):
                out[i] = z[:len(pages[i]), j] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    T = max(len(p) for p in pages)
    x, mask = np.zeros((T, len(pages), WIDTH), np.float32), np.zeros((T, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, 1
    return x, mask


#: Names that page authors give to parts which are not the article, and to the article.
SIDE_NAMES = """header nav menu navbar navigation breadcrumb topbar masthead site-header banner logo ad ads advert advertisement sponsor promo
sidebar side widget related recommended share social newsletter subscribe cookie cookie-notice consent notice alert popup modal
login search pagination tags footer site-footer copyright legal comments comment reply disqus feedback""".split()
MAIN_NAMES = "content main-content article article-body post post-content entry entry-content story story-body text body-text page".split()
WRAP_NAMES = "wrapper container page site row layout inner outer".split()
SIDE_WORDS = """home about contact login register search menu privacy terms cookies accept subscribe share tweet advertisement sponsored
copyright reply comment comments follow newsletter next previous more sign up""".split()


def practice_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and, per leaf block, whether it belongs to the article.

    Words are made up, so only some side words carry meaning.  Half of the
    layouts use semantic tags, the others names on plain elements.
    """
    syllables = [rng.choice("bcdfghlmnprstvz") + rng.choice("aeiouéäñ") for _ in range(30)]

    def word():
        if rng.random() < 0.03:
            return str(rng.randint(0, 5000))
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def prose(low, high):
        out = []
        for _ in range(rng.randint(low, high)):
            out.append(" ".join(word() for _ in range(rng.randint(1, 14))).capitalize() + rng.choice([".", ".", ".", "!", "?"]))
        return " ".join(out)

    def few():
        return " ".join(rng.choice(SIDE_WORDS) if rng.random() < 0.4 else word() for _ in range(rng.randint(1, 5)))

    labels: list[bool] = []
    semantic = rng.random() < 0.6

    def leaf(tag, text, main, attrs=""):
        labels.append(main)
        return f"<{tag}{attrs}>{text}</{tag}>" if rng.random() < 0.85 or tag not in ("p", "li") else f"<{tag}{attrs}>{text}"

    def name(names, tag):
        kind = rng.choice(["class", "class", "id"])
        extra = f" {word()}" if rng.random() < 0.4 else ""
        return f'<{tag} {kind}="{rng.choice(names)}{extra}">'

    def links(n):
        items = [leaf("li", f'<a href="/{word()}">{few()}</a>', False) for _ in range(n)]
        return "<ul>" + "".join(items) + "</ul>"

    def side(kind=None):
        kind = kind or rng.choice(["links", "text", "form", "comments", "mixed", "title"])
        if kind == "links":
            return links(rng.randint(2, 8))
        if kind == "text":
            return leaf("p", prose(1, 3), False) if rng.random() < 0.5 else (labels.append(False) or prose(1, 2))
        if kind == "form":
            return "<form>" + leaf("label", few(), False).replace("label", "div") + '<input type="text">' + leaf("button", few(), False) + "</form>"
        if kind == "title":
            return leaf(rng.choice(["h1", "h1", "h2", "div"]), few(), False) + (links(rng.randint(1, 5)) if rng.random() < 0.5 else "")
        if kind == "comments":
            return "".join(leaf(rng.choice(["p", "div", "li"]), prose(1, 3), False) for _ in range(rng.randint(1, 5)))
        return leaf(rng.choice(["h3", "h4", "div"]), few(), False) + links(rng.randint(1, 4))

    def side_part(*tags):
        if semantic and rng.random() < 0.7:
            tag = rng.choice(tags)
            return f"<{tag}>{side()}</{tag}>"
        return name(SIDE_NAMES, "div") + side() + "</div>"

    def body():
        out = []
        if rng.random() < 0.85:
            title = leaf("h1", " ".join(word() for _ in range(rng.randint(1, 9))), True)
            out.append(f"<header>{title}</header>" if semantic and rng.random() < 0.15 else title)
        even = rng.random() < 0.1  # long pages of plain paragraphs
        for _ in range(rng.randint(60, 200) if rng.random() < 0.05 else rng.randint(1, 12)):
            r = rng.random() * (0.6 if even else 1)
            if r < 0.62:
                out.append(leaf("p", prose(1, 6), True))
            elif r < 0.70:
                labels.append(True)
                out.append(f"<p><b>{prose(1, 1)}<br>")
            elif r < 0.76:
                out.append(leaf(rng.choice(["h2", "h3"]), " ".join(word() for _ in range(rng.randint(1, 6))), True))
            elif r < 0.82:
                out.append("<ul>" + "".join(leaf("li", prose(1, 2), True) for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.86:
                out.append("<blockquote>" + leaf("p", prose(1, 2), True) + "</blockquote>")
            elif r < 0.89:
                out.append("<table><tr>" + "".join(leaf("td", word(), True) for _ in range(rng.randint(1, 4))) + "</tr></table>")
            elif r < 0.90:
                out.append(f"<figure><img src=x>{leaf('figcaption', prose(1, 1), True)}</figure>")
            elif r < 0.91:
                out.append(leaf("p", f'{prose(1, 1)} <a href="/{word()}">{word()}</a> {prose(1, 1)}', True))
            else:
                inner = side(rng.choice(["text", "text", "links", "form", "comments"]))
                out.append(inner if inner.startswith("<form") and rng.random() < 0.6 else
                           f"<aside>{inner}</aside>" if rng.random() < 0.25 else name(SIDE_NAMES, "div") + inner + "</div>")
        return "".join(out)

    out = ["<!DOCTYPE html><html><head><title>", word(), "</title><style>p{}</style></head><body>"]
    wrapped = rng.random() < 0.25
    out.append(name(WRAP_NAMES, "div") if wrapped else "")
    for _ in range(rng.randint(0, 3)):
        out.append(side_part("nav", "header", "nav"))
    if semantic:
        tag = rng.choice(["article", "article", "main", "main"])
        inner = body()
        tail = side_part("aside", "footer") if rng.random() < 0.2 else ""
        wrap = f"<{tag}>{inner}{tail}</{tag}>"
        out.append(f"<main>{wrap}</main>" if tag == "article" and rng.random() < 0.3 else wrap)
    elif rng.random() < 0.2:
        out.append(body())
    else:
        out.append(name(MAIN_NAMES, "div") + body() + "</div>")
    for _ in range(rng.randint(0, 3)):
        out.append(side_part("footer", "aside", "footer"))
    out.append("</div>" if wrapped else "")
    if rng.random() < 0.85:
        out.append("</body></html>")
    return "".join(out), labels


def practice_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = random.Random(seed)
    made = []
    while len(made) < n:
        html, labels = practice_page(rng)
        page = blocks(html)
        if len(page) == len(labels) and page:
            made.append((vectors(page), np.array(labels)))
    return made


@lru_cache(maxsize=2)
def train(pages: int = 1200, passes: int = 10, seed: int = 5) -> BlockLabeller:
    """Fit a labeller on ``pages`` practice pages with Adam; some seconds of numpy on the driver, the same for any input."""
    data = practice_pages(pages, seed)
    model = BlockLabeller()
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    rng = np.random.default_rng(seed)
    t = 0
    for turn in range(passes):
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + 4 * rng.random())
        batches = [order[i:i + 32] for i in range(0, len(order), 32)]
        for b in rng.permutation(len(batches)):
            x, mask = padded([data[i][0] for i in batches[b]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[b]):
                y[:len(data[i][1]), j] = data[i][1]
            _, grad = model.gradient(x, mask, y)
            t += 1
            rate = 0.01 * (1 - turn / (passes + 1))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """Article text of each page: its blocks in page order, one line each."""
    parsed = [blocks(h) for h in pages]
    marks = model.label([vectors(p) for p in parsed])
    return ["\n".join(text for (_, text, _), m in zip(page, mark) if m) for page, mark in zip(parsed, marks)]


def extract(pages: DataFrame, model: BlockLabeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per row of ``pages``.

    Character references are decoded, white space inside a block is one space,
    blocks are joined by one line feed; nothing is cut.  NULL or empty html
    gives an empty text; repeated rows and NULL ids are rows like others; other
    columns aren't read.
    """
    model = model or train()

    def run(batches):
        for batch in small_batches(batches, "_html"):
            texts = main_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("_html")).mapInArrow(
        run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
