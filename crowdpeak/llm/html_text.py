"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks (runs of text between block-level tags). Features of a block are its ancestors' tags,
class, id and role words, and what its text looks like. The chain is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.llm.text import slices

DIMS = 1 << 14
#: Bound on the pages whose texts fill the labelled pages (in the mean; chosen by a hash), and labelled pages made.
SAMPLE, LABELLED, EPOCHS, RATE = 400, 1000, 8, 0.1

# Elements of HTML by how they are read.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
         "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td",
         "tfoot", "th", "thead", "tr", "ul"}
#: An opening tag ends open elements of these names, up to the nearest one of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|([^<]+)|(<)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[^a-zA-Z]+")


def _dim(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % DIMS


class Node:
    """An open element: its features with those of all its ancestors."""

    __slots__ = ("tag", "parent", "feats", "score")

    def __init__(self, tag: str, parent: Node | None, feats: tuple[int, ...], score):
        self.tag, self.parent, self.feats = tag, parent, feats
        self.score = score


def element_features(tag: str, attributes: str) -> tuple[int, ...]:
    """Dimensions of one element: its tag, and the words of its class, id, role and style."""
    names = [f"<{tag}"]
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("hidden", "aria-hidden"):
                names.append("@hidden" if value.strip("\"'").lower() != "false" else "@shown")
            elif key == "style":
                names.append("@hidden" if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else "@style")
            else:
                words = [w.lower().rstrip("s") or "s" for w in HUMP.split(value.strip("\"'")) if w]
                names += [f"@{w}" for w in words] + [f"@{w[:4]}*" for w in words if len(w) > 4]
    return tuple(dict.fromkeys(_dim(n) for n in names))


def text_features(text: str, linked: int, tag: str, index: int) -> list[int]:
    n, words = len(text), text.count(" ") + 1
    share = linked / max(1, n)
    return [_dim(x) for x in (
        f"len{min(12, int(math.log2(n + 1)))}", f"words{min(8, int(math.log2(words)))}", f"links{int(share * 3.999)}",
        "stop" if text[-1] in ".!?:;\"'»”…" else "nostop", f"in<{tag}", f"marks{min(4, sum(text.count(c) for c in '.,;'))}",
        "copyright" if "©" in text or "(c)" in text.lower() else "plain", "first" if index == 0 else "later")] + (
        [_dim(f"word:{w}") for w in re.findall(r"[a-z]{4,}", text.lower())[:8]] if n < 60 else [])


def blocks(page: str, weights: np.ndarray | None = None, memo: dict | None = None) -> list[tuple[str, tuple | None, float]]:
    """[(text, features, score)]: the leaf blocks of a page. With weights, scores are filled and features are not."""
    memo = {} if memo is None else memo
    root = node = Node("", None, (), 0.0)
    out, parts, linked, links = [], [], 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                own = text_features(text, linked, node.tag, len(out))
                if weights is None:
                    out.append((text, node.feats + tuple(own), 0.0))
                else:
                    out.append((text, None, node.score + float(weights[own].sum())))
            linked = 0

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.match(page, at)
        at = found.end()
        slash, tag, attributes, text, stray = found.groups()
        if text is not None or stray is not None:
            parts.append(text or stray)
            if links:
                linked += len(text or stray)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if not slash and tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(page, at)
            at = stop.end()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
        if tag == "a":
            links = 0 if slash else 1
        if slash:
            scan = node
            while scan is not root and scan.tag != tag:
                scan = scan.parent
            if scan is not root:
                if tag not in BLOCK:  # inline tags never end a block
                    if scan is node:
                        node = scan.parent
                else:
                    node = scan.parent
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            ended, within = ENDS.get(tag, ({"p"}, set()))
            scan, to = node, None
            while scan is not root and scan.tag not in within:
                if scan.tag in ended or scan.tag == "p":
                    to = scan.parent
                elif scan.tag in BLOCK and tag not in ENDS:
                    break
                scan = scan.parent
            node = to or node
        key = (tag, attributes)
        own = memo.get(key)
        if own is None:
            if len(memo) > 20_000:
                memo.clear()
            feats = element_features(tag, attributes)
            own = memo[key] = (feats, float(weights[list(feats)].sum()) if weights is not None else 0.0)
        if tag in BLOCK:
            node = Node(tag, node, node.feats + own[0] if weights is None else (), node.score + own[1])
        if attributes.endswith("/") and tag not in BLOCK:
            continue
    close()
    return out


class Chain:
    """Two labels (0 leave out, 1 keep): emission weights of label 1, transitions and starts."""

    def __init__(self):
        self.weights, self.moves, self.starts = np.zeros(DIMS), np.zeros((2, 2)), np.zeros(2)

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the likeliest labels of a chain of emission scores (label 1 against label 0)."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = float(self.starts[0]), float(self.starts[1])
        back = []
        for i, s in enumerate(scores):
            if i:
                back.append((0 if a + m00 >= b + m10 else 1, 0 if a + m01 > b + m11 else 1))
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
            b += s
        if not scores:
            return []
        out = [1 if b > a else 0]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def fit(self, pages: list[tuple[list[tuple[int, ...]], list[int]]], epochs: int = EPOCHS, seed: int = 8) -> Chain:
        """Adagrad on the conditional log-likelihood; marginals by the forward and backward passes."""
        rng = random.Random(seed)
        squares, move_squares, start_squares = np.full(DIMS, 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3)
        for _ in range(epochs):
            rng.shuffle(pages)
            for feats, gold in pages:
                n = len(feats)
                if not n:
                    continue
                e = np.zeros((n, 2))
                e[:, 1] = [self.weights[list(f)].sum() for f in feats]
                f, b = np.empty((n, 2)), np.zeros((n, 2))
                f[0] = self.starts + e[0]
                for i in range(1, n):
                    x = f[i - 1][:, None] + self.moves
                    top = x.max(axis=0)
                    f[i] = top + np.log(np.exp(x - top).sum(axis=0)) + e[i]
                for i in range(n - 2, -1, -1):
                    x = self.moves + (e[i + 1] + b[i + 1])[None, :]
                    top = x.max(axis=1)
                    b[i] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
                whole = f[-1].max() + np.log(np.exp(f[-1] - f[-1].max()).sum())
                p = np.exp(f + b - whole)
                rate = RATE
                grad: dict[int, float] = {}
                for i in range(n):
                    d = gold[i] - p[i, 1]
                    for k in feats[i]:
                        grad[k] = grad.get(k, 0.0) + d
                ks, ds = np.fromiter(grad, dtype=np.int64), np.fromiter(grad.values(), dtype=float)
                ds = ds - 1e-3 * self.weights[ks]
                squares[ks] += ds * ds
                self.weights[ks] += rate * ds / np.sqrt(squares[ks])
                d_moves = np.zeros((2, 2))
                for i in range(1, n):
                    d_moves[gold[i - 1], gold[i]] += 1
                    d_moves -= np.exp(f[i - 1][:, None] + self.moves + (e[i] + b[i])[None, :] - whole)
                move_squares += d_moves**2
                self.moves += rate * d_moves / np.sqrt(move_squares)
                d_starts = np.eye(2)[gold[0]] - p[0]
                start_squares += d_starts**2
                self.starts += rate * d_starts / np.sqrt(start_squares)
        return self


# Names that page authors give to the parts of a page, for the labelled pages.
KEEP_SHELLS = ["<article>", "<main>", '<main role="main"><article>', '<div class="content">', '<div id="main-content">', '<div class="post-body">',
               '<div class="entry-content">', '<section class="story">', '<div class="article-text"><div class="inner">', '<article class="post">',
               '<div id="wrapper"><article id="article-body">', '<td class="text">', '<div role="main">', "<section>", '<div class="page">']
DROP_SHELLS = ["<nav>", '<div class="ad">', '<div class="ads banner">', '<div class="advert sponsored">', "<aside>", '<aside class="sidebar">', '<div id="sidebar">',
               "<header>", '<header class="site-header">', '<div id="header" class="masthead">', "<footer>", '<div class="footer">', '<div id="cookie-notice">', '<div class="cookie-banner consent">',
               '<div class="notice alert">', '<div class="popup modal">', "<form>", '<form class="newsletter subscribe">', '<div class="search-form"><form>',
               '<section class="comments">', '<div id="comments"><div class="comment">', '<ol class="comment-list">', '<section id="reader-comments">', '<div class="user-comments replies">',
               '<div class="related">', '<div class="share social">', '<div class="menu">', '<ul class="nav">', '<div class="breadcrumb">', '<div role="navigation">',
               '<div role="complementary">', '<div role="banner">', '<div role="contentinfo">', '<div class="promo recommended">', '<div class="widget">', '<div style="display:none">', "<div hidden>",
               '<div class="disclaimer legal">', '<div class="author-bio">', '<div class="tags">', '<div class="pagination">', '<div class="login signup">', "<dialog>", '<div class="privacy gdpr">', '<div class="toolbar">']


def labelled_pages(texts: list[str], short: list[str], count: int = LABELLED, seed: int = 8) -> list[tuple[str, list[tuple[str, int]]]]:
    """[(html, [(text, label)])]: pages laid out in many ways around given texts, whose labels are known by construction."""
    rng, made = random.Random(seed), []
    esc = lambda t: html.escape(t, quote=False)
    long = [t for t in texts if t] or ["text of a page, with a full stop."]
    short = [t for t in short if t] or ["Home", "About"]

    def phrase() -> str:
        words = rng.choice(long + short).split() or ["text"]
        a = rng.randrange(len(words))
        return " ".join(words[a : a + rng.randint(1, 7)])

    def closed(shell: str, sure: bool = False) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", shell))) if sure or rng.random() < 0.85 else ""

    def dropped(sure: bool = False) -> tuple[str, list[tuple[str, int]]]:
        shell = rng.choice(DROP_SHELLS)
        marks, gold = [shell], []
        kind = rng.random()
        if "form" in shell or kind < 0.12:
            for _ in range(rng.randint(1, 3)):
                t = phrase()
                marks.append(rng.choice(["<p><label>{}</label></p>", "<button>{}</button>", "<p>{}</p>", "<div>{}</div>"]).format(esc(t)))
                gold.append((t, 0))
        elif kind < 0.45:
            items = [phrase() for _ in range(rng.randint(2, 7))]
            marks.append("<ul>" + "".join(f'<li><a href="/x">{esc(t)}</a></li>' for t in items) + "</ul>")
            gold += [(t, 0) for t in items]
        else:
            for _ in range(rng.randint(1, 3)):
                t = rng.choice(long) if rng.random() < 0.5 else phrase()
                marks.append(rng.choice(["<p>{}</p>", "<div>{}</div>", "{}<hr>", "<span>{}</span><hr>", "<h3>{}</h3>"]).format(esc(t)))
                gold.append((t, 0))
        return "".join(marks) + closed(shell, sure), gold

    for _ in range(count):
        shell = rng.choice(KEEP_SHELLS)
        marks, gold = ["<!DOCTYPE html><html><head><title>t</title></head><body>"], []
        if rng.random() < 0.3:
            marks.append(rng.choice(["<div>", '<div class="container">', '<div id="page" class="wrap">']))
        for _ in range(rng.randint(0, 4)):
            m, g = dropped(sure=True)
            marks.append(m)
            gold += g
        marks.append(shell)
        if rng.random() < 0.7:
            t = phrase()
            marks.append(rng.choice(["<h1>{}</h1>", "<h1><b>{}</b></h1>", "<h2>{}</h2>", '<h1 class="title">{}</h1>']).format(esc(t)))
            gold.append((t, 1))
        for _ in range(rng.randint(1, 9)):
            t = rng.choice(long) if rng.random() < 0.75 else phrase()
            marks.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<h2>{}</h2>",
                                     "<p><i>{}</i></p>", '<p><a href="/y">{}</a></p>', "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"]).format(esc(t)))
            gold.append((t, 1))
            if rng.random() < 0.08:
                t = phrase()
                marks.append(rng.choice(['<div class="ad">{}</div>', "<aside>{}</aside>", '<div class="share">{}</div>', '<div class="advert">{}</div>']).format(esc(t)))
                gold.append((t, 0))
        marks.append(closed(shell))
        for _ in range(rng.randint(0, 4)):
            m, g = dropped()
            marks.append(m)
            gold += g
        t = "© " + phrase()
        marks.append(f"<footer>{esc(t)}</footer></body></html>")
        gold.append((t, 0))
        made.append(("".join(marks), gold))
    return made


def train(pages: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain, fitted to LABELLED pages laid out around the texts of about `sample` pages of the table."""
    share = min(1.0, sample / max(1, pages.count()))
    some = pages.where("html is not null").where(F.pmod(F.xxhash64(F.lit("pages"), "page_id", "url"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    texts = [t for (page,) in some.select("html").orderBy("html").collect() for t, _, _ in blocks(page)]
    long = sorted({t[:600] for t in texts if len(t) >= 60})
    made = labelled_pages(long, sorted({t for t in texts if len(t) < 60}))
    rows = []
    for page, gold in made:
        found = blocks(page)
        if [t for t, _, _ in found] == [" ".join(t.split()) for t, _ in gold]:
            rows.append(([f for _, f, _ in found], [y for _, y in gold]))
    return Chain().fit(rows)


def main_text(page: str | None, chain: Chain, memo: dict) -> str:
    """Kept blocks in page order, one to a line."""
    found = blocks(page or "", chain.weights, memo)
    keep = chain.decode([s for _, _, s in found])
    return "\n".join(t for (t, _, _), k in zip(found, keep) if k)


def extract(pages: DataFrame, chain: Chain, column: str = "html") -> DataFrame:
    """`pages` with `text`, the main text of the whole page. Null and empty pages, and pages without kept blocks, give ''.

    Broken markup is read as it comes: open elements end with their parents, stray marks are text."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)  # of fixed size, whatever the input
    base = pages.drop("text")
    schema = pages.drop("text").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part in slices(batch, column):
                texts = [main_text(p, shared.value, memo) for p in part.column(part.schema.get_field_index(column)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])

    return base.mapInArrow(run, schema)
