"""Main text of web pages: a linear-chain CRF over the leaf blocks of the document tree.

A page is cut into leaf blocks, runs of text under one chain of block elements.
Each block has features of its ancestors' tags, classes and ids, of its text
and links, and of its neighbours. The CRF, trained on a small table of labelled
pages, marks the blocks of the main text; Viterbi decodes a batch of pages.

Of the markup only scripts, styles and comments have their content dropped by
rule; all else is for the model to keep or leave.

Defined results: null html is the empty page and has empty text; markup that is
not closed ends with its parent; a tag, script, style or comment without an end
takes the rest of the page; a quote that nothing closes is none; whole pages
are read, in time that grows with their length; repeated rows give repeated
results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes
from .crf import Crf, train, viterbi

LABELS = ["O", "B-text", "I-text"]
# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head body div section article main nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog option select title label button".split())
#: What an opening tag ends, if open: its like, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose content is no markup: dropped, or text up to their end.
DROPPED, PLAIN = ("script", "style"), ("title", "textarea")
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in (*DROPPED, *PLAIN)}
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class _Page:
    """Tags and texts of a page in one pass: every search goes on from where the last one ended."""

    def __init__(self, page: str):
        self.page = page
        self.absent: set[str] = set()  # what the rest of the page does not hold

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.absent.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Where the ``>`` of a tag stands, -1 if nowhere; a quoted value, which follows a ``=``, may hold one."""
        page, first = self.page, at
        if self.find(">", at) < 0:
            return -1
        while m := _STOP.search(page, at):
            k = at = m.start()
            if page[k] == ">":
                return k
            at += 1
            while k > first and page[k - 1].isspace():
                k -= 1
            if k > first and page[k - 1] == "=":
                close = self.find(m[0], at)
                if close < 0:  # a quote that nothing closes is none
                    return self.find(">", at)
                at = close + 1
        return -1

    def pieces(self):
        """(tag, attributes, text): an opening tag, an end tag as "/tag", or a text with tag None."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = self.find("<", at)
            if lt < 0:
                yield None, "", page[at:]
                return
            if lt > at:
                yield None, "", page[at:lt]
            m = _TAG.match(page, lt)
            if not m:
                mark = page[lt + 1 : lt + 2]
                if mark not in ("!", "?", "/"):
                    yield None, "", "<"
                    at = lt + 1
                    continue
                comment = page.startswith("<!--", lt)
                close = self.find("-->", lt + 2) if comment else self.find(">", lt)
                if close < 0:
                    return
                at = close + (3 if comment else 1)
                continue
            end = self.tag_end(m.end())
            if end < 0:  # the page breaks off within a tag
                return
            at, tag = end + 1, m[1].lower()
            if page[lt + 1] == "/":
                yield "/" + tag, "", ""
                continue
            yield tag, page[m.end() : end], ""
            if tag in _END_OF:
                close = _END_OF[tag].search(page, at)
                upto = close.start() if close else n
                if tag in PLAIN:
                    yield None, "", page[at:upto]
                at = upto


@dataclass(frozen=True)
class Element:
    """An open element with what its blocks need to know of all around it; what an element adds nothing to is shared."""

    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    outer: tuple[str, ...]  # the two nearest block elements


@dataclass
class Block:
    within: Element
    text: str
    linked: int = 0


ROOT = Element("", frozenset(), frozenset(), ())


def blocks(page: str, known: dict[str, int] | None = None) -> list[Block]:
    """Leaf blocks in page order, white space made one, references decoded.

    Time and memory grow with the page's length, however deep it is: where the
    open elements stand is kept by name, and ``known`` limits the tags and class
    names that are gathered to those that a model has features of.
    """
    stack: list[Element] = []
    where: defaultdict[str, list[int]] = defaultdict(list)  # places of each open tag
    open_blocks: list[int] = []
    found: list[Block] = []
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                found.append(Block(stack[-1] if stack else ROOT, text, linked))
        parts, linked = [], 0

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            where[tag].pop()
            if tag in BLOCK:
                open_blocks.pop()

    def top(tags) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=-1)

    for tag, attributes, text in _Page(page).pieces():
        if tag is None:
            parts.append(html.unescape(text) if "&" in text else text)
            if where["a"]:
                linked += len(text)
        elif tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCK:
                close()
            # an inline end does not reach beyond its block
            if where[tag] and (tag in BLOCK or not open_blocks or where[tag][-1] > open_blocks[-1]):
                cut(where[tag][-1])
        elif tag in VOID:
            if tag == "hr":
                close()
            elif tag != "wbr":
                parts.append(" ")
        else:
            if tag in DROPPED:
                parts.append(" ")
            if tag in BLOCK:
                close()
                if where["p"]:  # a paragraph holds no block
                    cut(where["p"][0])
                like, limit = ENDS.get(tag, ((), ()))
                above = top(limit)
                ended = [places[i] for t in like if (i := bisect_right(places := where[t], above)) < len(places)]
                if ended:
                    cut(min(ended))
            if attributes.rstrip().endswith("/") and tag not in _END_OF:
                continue
            up = stack[-1] if stack else ROOT
            names = {w for x in _NAMED.findall(attributes) for w in _WORD.findall("".join(x[1:]).lower())} if attributes else set()
            names = {w for w in names - up.names if known is None or f"c={w}" in known}
            new = tag not in up.tags and (known is None or f"t={tag}" in known)
            where[tag].append(len(stack))
            if tag in BLOCK:
                open_blocks.append(len(stack))
            stack.append(Element(tag, up.tags | {tag} if new else up.tags, up.names | names if names else up.names, (*up.outer[-1:], tag) if tag in BLOCK else up.outer))
    close()
    return found


_SECTIONS = frozenset("article main nav header footer aside form".split())


def features(bs: list[Block]) -> list[list[str]]:
    own = []
    for b in bs:
        n, words = len(b.text), b.text.count(" ") + 1
        stops = sum(b.text.count(c) for c in ".!?;,")
        link = b.linked / max(1, n)
        within = b.within
        f = [f"t={t}" for t in within.tags] + [f"c={x}" for x in within.names] + [f"leaf={within.outer[-1] if within.outer else ''}", f"up={'>'.join(within.outer)}"]
        f += [f"w={min(words.bit_length(), 7)}", f"link={int(link * 4)}", f"stops={min(stops, 4)}"]
        f += ["sign" for _ in [0] if b.text[0] in "©&|»›"] + (["bare"] if not within.tags & _SECTIONS else [])
        own.append(f)
    edge = lambda f: [x for x in f if x[:2] in ("le", "w=", "li")]
    return [f + [f"p{x}" for x in (edge(own[i - 1]) if i else ["start"])] + [f"n{x}" for x in (edge(own[i + 1]) if i + 1 < len(own) else ["end"])] for i, f in enumerate(own)]


def _sample_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of one of several make-ups and its main-text blocks."""
    parts = ["an", "ver", "tion", "el", "qu", "ment", "sch", "or", "is", "ado", "ber", "the", "ing", "lé", "ü", "os"]
    words = lambda a, b: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ".", ","]) for _ in range(r.randint(a, b)))
    links = lambda n: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n))
    boil = {
        "nav": lambda: f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>", "menu": lambda: f'<div class="menu"><ul>{links(r.randint(2, 7))}</ul></div>', "navdiv": lambda: f'<div id="navigation">{"".join(f"<a href=x>{words(1, 2)}</a> " for _ in range(5))}</div>',
        "ad": lambda: f'<div class="{r.choice(["ad", "ads", "advert", "banner", "promo", "sponsored"])}">{words(2, 30)}</div>', "cookie": lambda: f'<div class="{r.choice(["cookie", "notice", "cookie-notice", "consent", "popup"])}"><p>{words(4, 30)}</p><button>{words(1, 2)}</button></div>',
        "header": lambda: f"<header><p>{words(2, 12)}</p></header>", "aside": lambda: f"<aside><h3>{words(1, 3)}</h3><p>{words(4, 40)}</p></aside>", "sidebar": lambda: f'<div class="{r.choice(["sidebar", "related", "widget", "share"])}"><h3>{words(1, 3)}</h3><p>{words(4, 40)}</p><ul>{links(3)}</ul></div>',
        "form": lambda: f"<form><label>{words(1, 4)}</label><input name=q><p>{words(3, 15)}</p><button>{words(1, 2)}</button></form>", "footer": lambda: f"<footer>&copy; {words(2, 20)}</footer>", "footdiv": lambda: f'<div class="footer"><p>{words(2, 25)}</p></div>',
        "comments": lambda: f'<{(t := r.choice(["div", "section"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment", "replies", "discussion"])}">' + "".join(f'<div class="comment"><p>{words(3, 50)}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>",
    }
    main: list[str] = []

    def text(a: int, b: int) -> str:
        main.append(words(a, b))
        return main[-1]

    def body() -> str:
        out = f"<h1>{text(1, 14)}</h1>" if r.random() < 0.85 else ""
        for _ in range(r.randint(1, 8)):
            kind = r.random()
            out += f"<h2>{text(1, 8)}</h2>" if kind < 0.1 else f"<ul><li>{text(3, 20)}</li><li>{text(2, 12)}</li></ul>" if kind < 0.15 else f"<blockquote>{text(5, 40)}</blockquote>" if kind < 0.2 else f"<p><b>{text(1, 60)}<br>" if kind < 0.35 else f"<p>{text(1, 5)}</p>" if kind < 0.5 else f"<table><tr><td>{text(1, 8)}</td><td>{text(1, 8)}</td></tr></table>" if kind < 0.53 else f"<p>{text(5, 140)}</p>"
            if r.random() < 0.06:
                out += boil[r.choice(["ad", "aside", "form", "sidebar"])]()
        return out

    shell = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="article">{}</div>', '<div class="post-body">{}</div>', '<main><div class="story">{}</div></main>'])
    before = "".join(boil[r.choice(["nav", "menu", "navdiv", "ad", "cookie", "header", "form", "aside"])]() for _ in range(r.randint(1, 4)))
    after = "".join(boil[r.choice(["footer", "footdiv", "comments", "sidebar", "ad", "aside", "footer", "form", "cookie"])]() for _ in range(r.randint(1, 4)))
    return f"<html><head><title>{words(2, 12)}</title><style>p{{margin:0}}</style></head><body>{before}<!-- x -->{shell.format(body())}{after}" + r.choice(["</body></html>", ""]), main


def labelled_pages(spark: SparkSession, rows: int = 260, seed: int = 5) -> DataFrame:
    """A small table of pages with their main-text blocks."""
    r = random.Random(seed)
    return spark.createDataFrame(pd.DataFrame([_sample_page(r) for _ in range(rows)], columns=["html", "main"]), "html string, main array<string>")


def block_labels(bs: list[Block], main: list[str]) -> list[str]:
    """Labels of blocks, given the main text's blocks in page order."""
    tags, at = [], 0
    for b in bs:
        # the title repeats no block of the body
        hit = at < len(main) and "title" not in b.within.tags and b.text == _SPACE.sub(" ", main[at]).strip()
        tags.append(("I-text" if tags and tags[-1] != "O" else "B-text") if hit else "O")
        at += hit
    return tags


def train_extractor(table: DataFrame, max_rows: int = 1000) -> Crf:
    """Fit on at most ``max_rows`` labelled pages, the smallest by html."""
    rows = [(r.html, list(r.main)) for r in table.where("html is not null and main is not null").orderBy("html").limit(max_rows).collect()]
    data = [(features(bs), block_labels(bs, main)) for bs, main in ((blocks(h), m) for h, m in rows)]
    return train(data, LABELS, steps=100, forbidden=(("O", "I-text"),))


def main_texts(model: Crf, pages: list[str | None]) -> list[str]:
    """Main text of each page, its blocks parted by one line feed."""
    cut = [blocks(p or "", model.index) for p in pages]
    emissions = [model.rows(f) for bs in cut for f in features(bs)]
    if not emissions:
        return [""] * len(pages)
    tags = viterbi(np.array(emissions, np.float32), np.array([len(bs) for bs in cut]), model.moves, model.start)
    out, at = [], 0
    for bs in cut:
        out.append("\n".join(b.text for b, t in zip(bs, tags[at : at + len(bs)]) if t))
        at += len(bs)
    return out


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): main text of every whole page; trained on ``labelled_pages`` if no model is given."""
    sent = pages.sparkSession.sparkContext.broadcast(model or train_extractor(labelled_pages(pages.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, 500):
                texts = main_texts(sent.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{url_col}`").cast("string").alias(url_col), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
