"""HTML main-text extraction by a recurrent block labeller.

A page is read into its leaf blocks in document order.  Each block is a vector of its hashed
tag path (tags with the words of class, id and role), its hashed words and a few shapes; a
bidirectional LSTM in numpy reads the sequence and labels every block main text or not with
the whole page as context.  Inference is numpy alone; the weights are a small file made by
``python -m lamina.llm.html_training`` from generated pages of many layouts.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PATH_BUCKETS, WORD_BUCKETS, SHAPES = 512, 512, 10
WEIGHTS = Path(__file__).with_name("html_weights.npz")
BATCH_BLOCKS = 4000

# Elements of HTML by their role in the layout of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template head iframe title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
INLINE |= MATH
# Elements whose text counts as that of the element around them; the labeller sees their names only.
TRANSPARENT = MATH | {"object", "canvas", "svg", "noscript"}
FORM = frozenset("form button select option textarea input fieldset".split())
# Start tags that end an open paragraph, and what else an element of their kind ends.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article div section".split())

# A quote opens a value only after =; one that is never closed is a character like others.  Nothing is read twice:
# the groups are possessive, and a tag that does not match runs to the end of the page.
_OPEN = re.compile(r"<([a-zA-Z][^\s/>]*+)((?>[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>", re.S)
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>", re.I) for t in (*HIDDEN, "textarea")}
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+", re.S)
_NAMED = re.compile(r"class|id|role", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    labels: tuple[str, ...]  # tags of the open elements and the words of their names, each once
    inner: tuple[str, ...]  # the tags of at most three elements around it, no inline ones, from the innermost
    linked: float  # share of characters inside links


class Buckets(dict):
    """The bucket of each word, remembered for 200,000 words at most."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.n
        return found


_path_bucket, _word_bucket = Buckets(PATH_BUCKETS), Buckets(WORD_BUCKETS)


def _labels(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    if _NAMED.search(attributes):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            kind = name.lower()
            if kind in ("class", "id", "role"):
                found += [f".role-{x.lower()}" if kind == "role" else f".{x.lower()}" for x in _PART.findall(a or b or c)]
    return tuple(found)


class _Reader:
    """The open elements of a page and the text of the block at hand.

    Counts of open tags and labels are kept, so a block costs as much as it has distinct
    labels, however deep the page.
    """

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: dict[str, int] = {}  # tag: how many are open
        self.labels: dict[str, int] = {}
        self.around: list[str] = []  # tags of the open elements that count as places
        self.start()

    def start(self) -> None:
        self.parts: list[str] = []
        self.linked = self.total = 0
        self.place: tuple[tuple[str, ...], tuple[str, ...]] | None = None

    def flush(self) -> None:
        text = _SPACES.sub(" ", "".join(self.parts)).strip()
        if text:
            self.out.append(Block(text, *self.place, self.linked / max(self.total, 1)))
        self.start()

    def add(self, raw: str) -> None:
        if not raw:
            return
        text = _html.unescape(raw) if "&" in raw else raw
        n = len(text.strip())
        if n and self.place is None:
            self.place = tuple(self.labels), tuple(self.around[:-4:-1])
        self.total += n
        if self.open.get("a"):
            self.linked += n
        self.parts.append(text)

    def push(self, tag: str, attributes: str) -> None:
        labels = _labels(tag, attributes)[tag in TRANSPARENT :]
        self.stack.append((tag, labels))
        self.open[tag] = self.open.get(tag, 0) + 1
        for x in labels:
            self.labels[x] = self.labels.get(x, 0) + 1
        if tag not in INLINE and tag not in TRANSPARENT:
            self.around.append(tag)

    def pop(self) -> None:
        tag, labels = self.stack.pop()
        for counts, names in ((self.open, (tag,)), (self.labels, labels)):
            for x in names:
                counts[x] -= 1
                if not counts[x]:
                    del counts[x]
        if tag not in INLINE and tag not in TRANSPARENT:
            self.around.pop()

    def close(self, tag: str) -> None:
        """End the innermost open ``tag`` and all inside it; an inline one only if no block is open inside it."""
        if not self.open.get(tag):
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return
            at -= 1
        if any(t not in INLINE for t, _ in self.stack[at:]):
            self.flush()
        while len(self.stack) > at:
            self.pop()

    def begin(self, tag: str, attributes: str) -> None:
        if tag in ("br", "wbr"):
            self.parts.append(" " if tag == "br" else "")
            return
        if tag in ENDS_P and self.open.get("p"):
            self.close("p")
        same = ENDS_SAME.get(tag, ())
        if any(self.open.get(x) for x in same):
            for t, _ in reversed(self.stack):
                if t in same:
                    self.close(t)
                    break
                if t in SCOPES:
                    break
        if tag not in INLINE:
            self.flush()
        if tag not in VOID and not attributes.endswith("/"):
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag == "p" and not self.open.get("p"):
            self.flush()
        else:
            self.close(tag)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks with text, in page order; scripts, styles and the head have none.

    Unclosed elements end where HTML ends them: a new paragraph or item ends the open one,
    an end tag ends all that is open inside its element, inline ones included.  A tag or
    comment that the end of the page cuts off gives no text.  Time follows the length.
    """
    reader, at = _Reader(), 0
    endless: set[str] = set()  # hidden elements without an end in what is left of the page
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            reader.add(page[at:])
            break
        reader.add(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after == "!":
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            at = len(page) if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
        elif after == "?" or after == "/" and not page[lt + 2 : lt + 3].isascii() or after == "/" and not page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
        elif after == "/":
            m = _CLOSE.match(page, lt)
            if m is None:
                break
            at = m.end()
            reader.end(m[1].lower())
        elif after.isascii() and after.isalpha():
            m = _OPEN.match(page, lt)
            if m is None:
                break
            at, tag = m.end(), m[1].lower()
            if tag == "head":
                continue
            if tag in HIDDEN or tag == "textarea":
                # without an end, only scripts, styles and text areas take the rest of the page
                takes_rest = tag in ("script", "style", "textarea")
                end = _RAW_END[tag].search(page, at) if tag not in endless and (takes_rest or not m[2].endswith("/")) else None
                if end is None and not m[2].endswith("/"):
                    endless.add(tag)
                at = end.end() if end else len(page) if takes_rest else at
                continue
            reader.begin(tag, m[2])
        else:
            reader.add("<")
            at = lt + 1
    reader.flush()
    return reader.out


def features(blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Tag-path buckets, word buckets and shapes of a page's blocks."""
    paths = [[*(_path_bucket[x] for x in b.labels), *(_path_bucket[f"{d}:{x}"] for d, x in enumerate(b.inner))] for b in blocks]
    words = [[_word_bucket[w] for w in _WORD.findall(b.text.lower())] for b in blocks]
    shapes = np.zeros((len(blocks), SHAPES), np.float32)
    for i, b in enumerate(blocks):
        n, tokens = len(b.text), b.text.count(" ") + 1
        leaf = b.inner[0] if b.inner else ""
        shapes[i] = (
            np.log1p(n) / 8, np.log1p(tokens) / 6, b.linked, sum(b.text.count(c) for c in ".!?;:,") / (tokens + 1), b.text[-1] in ".!?:\"'", leaf == "p",
            leaf[:1] == "h" and leaf[1:].isdigit(), leaf in ("li", "dd", "dt", "td"), i / max(len(blocks) - 1, 1), any(x in FORM for x in b.labels),
        )
    return paths, words, shapes


def _means(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    n = np.array([len(x) for x in lists])
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if n.sum() else np.zeros(0, np.int64)
    total = np.zeros((len(lists), table.shape[1]), np.float32)
    np.add.at(total, np.repeat(np.arange(len(lists)), n), table[flat])
    return total / np.maximum(n, 1)[:, None]


def inputs(weights: dict[str, np.ndarray], paths, words, shapes) -> np.ndarray:
    return np.concatenate([_means(weights["path"], paths), _means(weights["word"], words), shapes], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (pages, blocks, size) of one direction; a masked step keeps the state."""
    size = u.shape[0]
    h = np.zeros((x.shape[0], size), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((*x.shape[:2], size), np.float32)
    pre = x @ w + b
    for t in range(x.shape[1]):
        z = pre[:, t] + h @ u
        i, f, o, g = sigmoid(z[:, :size]), sigmoid(z[:, size : 2 * size]), sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
        m = mask[:, t, None]
        c_new = f * c + i * g
        s = np.tanh(c_new)
        if trace is not None:
            trace.append((h, c, i, f, o, g, s))
        c = m * c_new + (1 - m) * c
        h = m * (o * s) + (1 - m) * h
        out[:, t] = h
    return out


@lru_cache(maxsize=2)
def load_weights(path: str = str(WEIGHTS)) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def score_pages(pages: list[list[Block]], weights: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The probability of main text for every block of every page; pages of like length go together."""
    scores: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        longest, stop = 0, at
        while stop < len(order) and max(longest, len(pages[order[stop]])) * (stop - at + 1) <= max(BATCH_BLOCKS, len(pages[order[at]])):
            longest = max(longest, len(pages[order[stop]]))
            stop += 1
        chosen = order[at:stop]
        at = stop
        parts = [features(pages[i]) for i in chosen]
        x = np.zeros((len(chosen), longest, weights["wf"].shape[0]), np.float32)
        mask = np.zeros((len(chosen), longest), np.float32)
        for j, part in enumerate(parts):
            x[j, : len(part[0])] = inputs(weights, *part)
            mask[j, : len(part[0])] = 1
        y = predict(x, mask, weights)
        for j, i in enumerate(chosen):
            scores[i] = y[j, : len(pages[i])]
    return scores


def predict(x: np.ndarray, mask: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    forward = lstm(x, mask, weights["wf"], weights["uf"], weights["bf"])
    backward = lstm(x[:, ::-1], mask[:, ::-1], weights["wb"], weights["ub"], weights["bb"])[:, ::-1]
    return sigmoid(np.concatenate([forward, backward, x], axis=2) @ weights["out"] + weights["bias"])[..., 0]


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the html by default), text and n_chars for every row.

    Null and empty pages give an empty text; malformed markup is read as HTML reads it; very
    long pages and blocks are read whole, in time that follows their length; repeated rows are
    read each; no row is compared with others, so there are no ties; an empty table gives no
    rows; columns text and n_chars of ``pages`` are replaced, no other name clashes.
    """
    small_batches(pages.sparkSession)
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html, "text", "n_chars")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)

    def run(batches):
        weights = load_weights()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                read = [blocks_of(t or "") for t in part.column(len(keep)).to_pylist()]
                texts = ["\n\n".join(x.text for x, s in zip(found, score, strict=True) if s >= 0.5) for found, score in zip(read, score_pages(read, weights), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html)).mapInArrow(run, f"{schema}, text string, n_chars long" if schema else "text string, n_chars long")


def op10_lstm_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
