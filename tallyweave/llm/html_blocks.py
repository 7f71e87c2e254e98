"""Main text of web pages from flat text blocks.

A page is read once into blocks of text; each has its word count and link density, those of its
neighbours, and what encloses it. A decision tree, trained on a small labelled table of pages that is
built by rule below, tells main text from the rest.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|(?P<text>[^<]+|<)""",
    re.S,
)
#: Elements whose content is not text of the page. Those drawn in a line leave no space behind.
RAW = frozenset("script style noscript template svg textarea select iframe object math canvas button".split())
INLINE_RAW = frozenset(("svg", "math", "button"))
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that stay open until closed; others can't enclose blocks reliably.
ENCLOSING = frozenset("article aside details dialog div dl figure footer form head header li main menu nav ol section table td ul".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog head".split())
#: Names of things beside the article, as a whole class or id; a name of the article's own beside it outweighs them.
HINT = re.compile(
    r"^(?:(?:google|top|side|footer|banner)?[-_]?ads?(?:[-_](?:box|slot|banner|unit|wrapper|container|\d+))?|advert(?:s|isement|ising|orial)?|sponsor(?:s|ed)?(?:[-_]\w+)?|promos?(?:tion)?(?:[-_](?:box|banner))?|banner"
    r"|(?:main|site|top|sub|page)?[-_]?nav(?:bar|igation)?(?:[-_](?:links|menu|bar|top|main))?|(?:main|side|top)?[-_]?menu(?:[-_](?:items?|bar|main))?|breadcrumbs?|(?:left|right)?[-_]?side[-_]?bar(?:[-_](?:left|right|box))?"
    r"|(?:site|page)?[-_]?(?:footer|header|masthead)(?:[-_](?:links|nav|text|inner))?|topbar|toolbar|(?:cookie|consent|gdpr)s?(?:[-_](?:notice|banner|bar|popup|message))?|notices?|alerts?(?:[-_](?:box|bar|info|warning))?"
    r"|newsletter(?:[-_]\w+)?|subscri(?:be|ption)(?:[-_]\w+)?|sign[-_]?up|log[-_]?in|shar(?:e|ing)(?:[-_](?:links|buttons|bar|tools))?|social(?:[-_](?:links|media|share|icons))?|related(?:[-_](?:posts|articles|links|stories|news|content))?"
    r"|recommend(?:ed|ations)(?:[-_]\w+)?|(?:user|reader)?[-_]?comments?(?:[-_](?:list|section|area|body|text|form|thread|content|\d+))?|disqus(?:[-_]\w+)?|repl(?:y|ies)|discussion|respond|widgets?(?:[-_]\w+)?|modal(?:[-_]\w+)?|pop[-_]?up|paginat(?:ion|or)|copyright|disclaimer|search(?:[-_](?:box|form|bar))?)$"
)
OWN = re.compile(r"^(?:article|post|entry|story|content|main|body|text)(?:[-_](?:text|body|content|main|article|inner))*$")
ATTR = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")
LOWER = {c: c + 32 for c in range(65, 91)}
_AFTER_NAME = frozenset(" \t\n\r\f/>") | {""}

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_main", "in_boiler", "hinted", "heading", "list_item", "page_has_main")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    boiler: bool
    hinted: bool
    heading: bool
    item: bool


def _hinted(attrs: str) -> bool:
    names = [name for match in ATTR.finditer(attrs) for name in (match[1] or match[2] or match[3] or "").lower().split()]
    return any(map(HINT.match, names)) and not any(map(OWN.match, names))


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Broken mark-up never raises.

    Scripts, styles and the like have no text; one without an end tag, or closed in itself, hides nothing that follows.
    Hidden elements and page heads hide theirs.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, main, boiler, hinted: with what encloses it
    parts: list[tuple[str, bool]] = []
    anchor = 0
    heading = False
    lowered = ""
    endless: set[str] = set()

    def flush() -> None:
        if not parts:
            return
        text = SPACE.sub(" ", entities.unescape("".join(p for p, _ in parts))).strip()
        if text:
            total = text.count(" ") + 1
            linked = sum(len(SPACE.sub(" ", entities.unescape(p)).split()) for p, inside in parts if inside)
            tag, main, boiler, hinted = stack[-1] if stack else ("", False, False, False)
            out.append(Block(text, total, min(linked, total), main, boiler, hinted, heading, tag == "li"))
        parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        if m is None:  # a tag that never ends, as text
            parts.append((page[at], anchor > 0))
            at += 1
            continue
        at = m.end()
        text = m["text"]
        if text is not None:
            parts.append((text, anchor > 0))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"] or m["close2"])
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/") and tag not in endless:
                lowered = lowered or page.translate(LOWER)
                end = lowered.find(f"</{tag}", at)
                while end >= 0 and lowered[end + 2 + len(tag) : end + 3 + len(tag)] not in _AFTER_NAME:
                    end = lowered.find(f"</{tag}", end + 1)
                if end < 0:
                    endless.add(tag)
                else:
                    stop = page.find(">", end)
                    at = n if stop < 0 else stop + 1
            if tag not in INLINE_RAW:
                parts.append((" ", anchor > 0))
        elif tag == "a":
            anchor = max(0, anchor - 1) if closing else 1
        elif tag == "br":
            parts.append((" ", anchor > 0))
        elif tag in BLOCK:
            flush()
            anchor = 0
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = not closing
            elif tag == "p":
                heading = False
            if tag in ENCLOSING:
                if closing:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                else:
                    if tag == "li" and stack and stack[-1][0] == "li":
                        stack.pop()
                    _, main, boiler, hinted = stack[-1] if stack else ("", False, False, False)
                    own = tag in ("article", "main")
                    named = _hinted(attrs)
                    bad = tag in BOILER_TAGS or (tag == "header" and not main) or bool(HIDDEN.search(attrs)) or (tag == "article" and main and named)
                    stack.append((tag, main or own, boiler or bad, hinted or (named and not own)))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([b.words for b in found], float)
    density = np.array([b.linked / b.words for b in found], float)
    pad = lambda x: (np.r_[0.0, x[:-1]], np.r_[x[1:], 0.0]) if n else (x, x)
    (wb, wa), (db, da) = pad(words), pad(density)
    main = np.array([b.main for b in found], float)
    return np.stack([words, density, wb, db, wa, da, main, np.array([b.boiler for b in found], float), np.array([b.hinted for b in found], float), np.array([b.heading for b in found], float), np.array([b.item for b in found], float), np.full(n, float(main.any()))], axis=1) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Tree:
    """feature[i] < 0: a leaf of value[i]; else rows with x[feature] <= cut go to left[i], others to right[i]."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[bool]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
                continue
            low = x[rows, self.feature[node]] <= self.cut[node]
            todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Tree:
    """A decision tree by Gini impurity. Ties go to the earlier feature and the smaller cut."""
    tree = Tree([], [], [], [], [])

    def gini(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        share = k / np.maximum(n, 1)
        return n * 2 * share * (1 - share)

    def node(rows: np.ndarray, level: int) -> int:
        here = len(tree.feature)
        for column, value in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, bool(y[rows].mean() >= 0.5) if len(rows) else False)):
            column.append(value)
        if level == depth or len(rows) < 2 * least or y[rows].all() or not y[rows].any():
            return here
        best = (gini(np.array([y[rows].sum()]), np.array([len(rows)]))[0] - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, up = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            score = gini(up[:-1], n) + gini(up[-1] - up[:-1], len(order) - n)
            score[(v[1:] == v[:-1]) | (n < least) | (len(order) - n < least)] = np.inf
            k = int(np.argmin(score)) if len(score) else 0
            if len(score) and score[k] < best[0]:
                best = (score[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return here
        low = x[rows, best[1]] <= best[2]
        tree.feature[here], tree.cut[here] = best[1], best[2]
        tree.left[here] = node(rows[low], level + 1)
        tree.right[here] = node(rows[~low], level + 1)
        return here

    node(np.arange(len(y)), 0)
    return tree


def labelled_pages(number: int = 600, seed: int = 5) -> list[tuple[str, set[str]]]:
    """The small training table: pages by rule, each with the texts of its main blocks.

    An article has headings, paragraphs of 1 to 120 words, lists, and at times entries that are all link. Half of the pages
    mark it by an element; in half, what is beside it has telling elements or class names, else densities alone tell. Menus, lists of links, adverts,
    notices, sidebars, comments and footers stand right before and after it in varying order.
    """
    rng = random.Random(seed)
    pages = []
    for k in range(number):
        count = 0

        def say(low: int, high: int, page: int = k) -> str:
            nonlocal count
            count += 1
            return f"p{page}b{count} " + " ".join(f"w{rng.randrange(97)}" for _ in range(rng.randint(low, high) - 1)) if high > 1 else f"p{page}b{count}"

        marked, named = k % 2 == 0, k // 2 % 2 == 0
        main: list[str] = []

        def own(text: str, main: list[str] = main) -> str:
            main.append(" ".join(text.split()))
            return text

        link = lambda text: f'<a href="/x">{text}</a>'
        links = lambda low, high: "<ul>" + "".join(f"<li>{link(say(1, 4))}</li>" for _ in range(rng.randint(low, high))) + "</ul>"
        inner = [f"<h1>{own(say(3, 12))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(2, 7)):
            # Without marks, short paragraphs stand between long ones.
            words = rng.choice([(1, 7), (8, 20), (20, 60), (40, 120)])
            if not marked and words == (1, 7):
                inner.append(f"<p>{own(say(25, 60))}</p>")
            inner.append(f"<p>{own(say(*words))}</p>")
            if rng.random() < 0.2:
                inner.append(f"<h2>{own(say(1, 6))}</h2><p>{own(say(20, 70))}</p>")
            if rng.random() < 0.2:
                inner.append("<ul>" + "".join(f"<li>{own(say(4, 25))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            if marked and rng.random() < 0.25:
                text = own(say(2, 9))
                inner.append(f"<ul><li>{link(text)}</li></ul>")
        if not marked:
            inner.append(f"<p>{own(say(25, 80))}</p>")
        if named and rng.random() < 0.4:
            inner.insert(rng.randrange(len(inner)), f'<div class="ad">{say(3, 30)}</div>')
        if named and rng.random() < 0.3:
            inner.insert(rng.randrange(len(inner)), f"<aside><p>{say(5, 60)}</p></aside>")
        body = "".join(inner)
        body = rng.choice([f"<article>{body}</article>", f"<main>{body}</main>", f'<main><article class="post">{body}</article></main>']) if marked else f"<div>{body}</div>"
        beside = {
            "menu": f"<nav>{links(3, 8)}</nav>" if named else f"<div>{links(4, 8)}</div>",
            "advert": f'<div class="ad">{say(3, 40)}</div>' if named else f"<div>{link(say(3, 12))}</div>",
            "notice": f'<div class="cookie-notice"><p>{say(10, 45)} {link(say(1, 2))}</p></div>' if named else f"<p>{link(say(4, 10))}</p>",
            "side": f"<aside><h3>{say(1, 4)}</h3><p>{say(8, 70)}</p>{links(2, 5)}</aside>" if named else f"<div>{links(3, 6)}</div>",
            "comments": f'<section id="comments"><p>{say(5, 60)}</p><p>{say(2, 30)}</p></section>' if named else "",
            "footer": f"<footer>{say(3, 25)}</footer>" if named else f"<div>{links(2, 5)}<p>{say(2, 6)}</p></div>",
        }
        if marked and not named:  # an element around the article is mark enough: anything may stand beside it
            beside |= {"advert": f"<div>{say(3, 60)}</div>", "notice": f"<p>{say(5, 40)}</p>", "comments": f"<div><p>{say(4, 50)}</p><p>{say(10, 70)}</p></div>"}
        before = ["menu", *rng.sample(["advert", "notice", "side"], rng.randint(0, 3))] if rng.random() < 0.7 else []
        others = [x for x in ("advert", "side", "comments") if x not in before]
        after = rng.sample(others, rng.randint(0, len(others))) + ["footer"] if rng.random() < 0.7 else []
        if not before and not after:  # nothing but the article, which may be one short paragraph
            body = body if rng.random() < 0.5 else "<p>" + say(1, 6) + "</p>"
            main[:] = main if body[:3] != "<p>" else [body[3:-4].strip()]
        pages.append(("<html><head><title>t</title></head><body>" + "".join(beside[x] for x in before) + body + "".join(beside[x] for x in after) + "</body></html>", set(main)))
    return pages


def train(pages: list[tuple[str, set[str]]] | None = None) -> Tree:
    """The tree for labelled pages. Deterministic."""
    x, y = [], []
    for page, main in labelled_pages() if pages is None else pages:
        found = blocks(page)
        x.append(features(found))
        y += [b.text in main for b in found]
    return grow(np.concatenate(x), np.array(y))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    keep = tree.predict(features(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _kernel(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), tree) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every page: the main blocks in page order, joined by line feeds.

    Character references are decoded, white space inside a block is one space. Null and empty pages, and pages
    without main text, give an empty text. Repeated rows are extracted each. One pass, no shuffle.
    """
    prepare(pages.sparkSession)
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html")).mapInArrow(_kernel(tree or train()), schema)
