"""Main text of web pages: a linear-chain CRF over the leaf blocks of a page.

A page is cut into leaf blocks, the texts between the borders of block elements. Each block has features of its ancestors
(tags, words of class, id and role) and of its text (length, share of links, marks); the field labels the sequence of
blocks as main text or not, and Viterbi finds the best labels of whole batches of pages.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.crf import LinearChainCrf
from panelkit.llm.text import per_batch

# HTML element names by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style iframe noembed noframes xmp".split())
#: Elements that are left out with all inside. A drawing ends at a tag that can't be in one, but not inside its parts for HTML.
HIDDEN_TAGS = frozenset(["svg", "template"])
DRAWING_PARTS = frozenset(["foreignobject", "desc", "title"])
ENDS_DRAWING = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: An open element of the first kind is closed by any of the second.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]),
}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """Text of a leaf block, the elements around it (outermost first; name words after the tag), and its linked characters."""

    __slots__ = ("around", "linked", "text")

    def __init__(self, text: str, around: list[tuple[str, tuple[str, ...]]], linked: int):
        self.text, self.around, self.linked = text, around, linked


def _name_words(attributes: str) -> tuple[str, ...]:
    found = []
    for groups in _NAMES.findall(attributes):
        found += _WORD.findall(_CAMEL.sub(" ", "".join(groups)).lower())
    return tuple(found)


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order: references decoded, white space runs made one space, ends trimmed.

    Scripts, styles and frames are left out up to their end tag, or to the end of the page if there is none, as browsers do.
    Drawings (svg) are left out up to the end that matches, or up to the next tag that can't be in one; a self-closed one
    holds nothing. Texts of formulas (math) and what an object offers instead of itself are text. A tag without its ">"
    goes on to the next ">" or the end of the page.
    """

    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    hidden: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, list(open_), linked))
        parts.clear()
        linked = 0

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        piece = page[at : token.start() if token else len(page)]
        if piece and not hidden:
            parts.append(piece)
            if links:
                linked += len(piece)
        if token is None:
            break
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        if hidden:
            if hidden[-1] == "svg" and not closing and tag in ENDS_DRAWING:
                hidden.clear()
            elif closing and tag in hidden:
                while hidden.pop() != tag:
                    pass
                continue
            else:
                inside = HIDDEN_TAGS | DRAWING_PARTS if "svg" in hidden else HIDDEN_TAGS
                if not closing and tag in inside and not (attributes.endswith("/") and (tag == "svg" or hidden[-1] == "svg")):
                    hidden.append(tag)
                if closing or tag not in RAW_TAGS:
                    continue
        elif tag in HIDDEN_TAGS and not closing:
            if tag != "svg" or not attributes.endswith("/"):
                hidden.append(tag)
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS:
                flush()
                if any(name == tag for name, _ in open_):
                    while open_.pop()[0] != tag:
                        pass
                    links = 0
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag == "xmp" and not hidden:
                parts.append(html.escape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK_TAGS:
            flush()
            while open_ and tag in CLOSED_BY.get(open_[-1][0], ()):
                open_.pop()
            if tag not in VOID_TAGS:
                open_.append((tag, _name_words(attributes)))
        elif tag == "a":
            links += 1
    flush()
    return out


# Words that sites use in class and id names, by the part of the page they mark.
SITE_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "menu-main", "site-nav"),
    "header": ("header", "site-header", "masthead", "page-header", "topbar", "branding", "logo"),
    "footer": ("footer", "site-footer", "page-footer", "copyright", "bottom", "colophon"),
    "sidebar": ("sidebar", "side", "aside", "widget", "widget-area", "related", "related-posts", "trending", "popular", "recommended"),
    "notice": ("notice", "cookie", "cookie-notice", "cookie-banner", "consent", "banner", "alert", "popup", "modal", "gdpr", "message"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adbox", "sponsor"),
    "form": ("form", "search-form", "newsletter", "subscribe", "signup", "login", "search"),
    "comments": ("comments", "comment", "comment-list", "commentlist", "discussion", "replies", "responses", "disqus"),
    "share": ("share", "social", "share-buttons", "social-links", "tags", "meta", "byline", "pagination", "pager"),
    "article": ("article", "content", "post", "post-content", "entry", "entry-content", "article-body", "story", "main", "main-content", "text", "body-text"),
}

_PART_OF_TAG = {"nav": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "article": "article", "main": "article"}
#: Telling words of the names; "main", "post", "body" and the like tell of an article only where nothing else does.
_PART_OF_NAME = {word: part for part, all_names in reversed(SITE_NAMES.items()) for name in all_names for word in name.split("-") if len(word) > 1 and word not in ("site", "page", "box", "area", "buttons", "links", "list", "slot", "top")}


_NOTED = re.compile("©|\\bcookies?\\b|\\bcomments?\\b|\\brepl(?:y|ies)\\b|\\bsubscribe\\b|\\bsign up\\b|\\bnewsletter\\b|\\brelated\\b|\\bshare\\b|\\bprivacy\\b|\\badvertisement\\b|\\bsponsored\\b|\\ball rights reserved\\b|\\bread more\\b", re.I)


def _step(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def _part(around: list[tuple[str, tuple[str, ...]]]) -> tuple[str, set[str]]:
    """The part of the page that the innermost telling element marks (its names before its tag), and all other parts around."""

    now, seen = "none", set()
    for tag, names in around:
        found = next((k for k in (_PART_OF_NAME.get(w) for w in names) if k), None) or _PART_OF_TAG.get(tag)
        if found:
            now = found
            seen.add(found)
    return now, seen - {"article"}


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for block in page:
        tags = [t for t, _ in block.around]
        own = tags[-1] if tags else ""
        text = block.text
        words = text.count(" ") + 1
        found = [f"own:{own}", f"words:{_step(words, (2, 4, 8, 15, 30, 60))}", f"links:{_step(block.linked / len(text), (0.01, 0.3, 0.7))}"]
        found += [f"in:{t}" for t in dict.fromkeys(tags)]
        found += [f"name:{w}" for w in dict.fromkeys(w for _, names in block.around for w in names)]
        part, others = _part(block.around)
        found += [f"part:{part}", f"part:{part}:{own}", f"part:{part}:{words >= 8}", f"clear:{part == 'article' and not others}"]
        found += [f"under:{other}" for other in others]
        inner = next((t for t in reversed(tags) if t not in ("p", "li", "ul", "ol", "td", "tr", "table", "tbody", "blockquote", "pre", "div") and t[:1] != "h"), "")
        found += [f"inner:{inner}", f"sentence:{text[-1] in '.!?…。'}", f"long:{inner}:{words >= 8}", f"marks:{_step(sum(text.count(c) for c in ',;:') / words, (0.01, 0.1))}"]
        found += [f"says:{w.lower()}" for w in dict.fromkeys(_NOTED.findall(text))]
        out.append(found)
    return out


def main_text(page: list[Block], labels) -> str:
    return "\n".join(b.text for b, keep in zip(page, labels, strict=True) if keep)


def labels_of(page: list[Block], main: str) -> list[int]:
    """1 for the blocks whose texts are, in order, lines of the page's main text."""

    lines, at, out = main.split("\n"), 0, []
    for block in page:
        hit = at < len(lines) and block.text == lines[at]
        at += hit
        out.append(int(hit))
    return out


def fit(labelled: list[tuple[str, str]], **options) -> LinearChainCrf:
    """Train on (html, main text) pairs."""

    pages = [blocks(page or "") for page, _ in labelled]
    return LinearChainCrf.fit([features(p) for p in pages], [labels_of(p, main or "") for p, (_, main) in zip(pages, labelled, strict=True)], 2, **({"penalty": 3e-4, "rounds": 250} | options))


def fit_table(labelled: DataFrame, max_rows: int = 2000, **options) -> LinearChainCrf:
    """Train on a table of (html, main) columns; at most max_rows pages, chosen by a hash."""

    rows = labelled.select(F.col("html").cast("string").alias("html"), F.col("main").cast("string").alias("main")).where("html is not null")
    return fit([(r["html"], r["main"]) for r in rows.orderBy(F.xxhash64("html"), "html").limit(max_rows).collect()], **options)


def extract(pages: DataFrame, model: LinearChainCrf) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_blocks.

    Null and empty pages, and pages without main text, give an empty text. Markup may be broken or end early; text outside
    of any element is a block. Whole pages are read, whatever their length. Repeated rows give repeated results, an empty
    table none. Columns other than page_id, url and html aren't read.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [blocks(page or "") for page in batch.column(2).to_pylist()]
        labels = model.decode([features(page) for page in found])
        texts = [main_text(page, label) for page, label in zip(found, labels, strict=True)]
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(page) for page in found]}

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return per_batch(narrow, make, "page_id long, url string, text string, n_chars long, n_blocks long")


# --- a small labelled table -------------------------------------------------------------------------------------------

def sample_pages(n: int = 450, seed: int = 17) -> list[tuple[str, str]]:
    """A labelled table: n (html, main text) pairs of pages laid out in many ways, with invented words."""

    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v z".split() for b in "a e i o u an er ion".split()]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(low, high + 1)))

    def sentence(low: int = 4, high: int = 18) -> str:
        mark = rng.choice([".", ".", ".", "!", "?", "", ",", " ***", " | |", "%%%", "###"])
        return words(low, high).capitalize() + mark

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.randrange(1, 8)))

    def named(kind: str) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(SITE_NAMES[kind])}{rng.choice(["", "", " wide", " box-2"])}"'

    def wrap(kind: str, inner: str, tags: tuple[str, ...]) -> str:
        tag = rng.choice(tags)
        plain = tag not in ("div", "section", "ul", "ol", "p", "span") and rng.random() < 0.6
        return f"<{tag}{'' if plain else named(kind)}>{inner}</{tag}>"

    def links(low: int = 2, high: int = 7) -> str:
        rows = [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(rng.randrange(low, high))]
        return rng.choice([f"<ul>{''.join(f'<li>{r}</li>' for r in rows)}</ul>", " ".join(rows), "".join(f"<p>{r}</p>" for r in rows)])

    def texts(low: int = 1, high: int = 3) -> str:
        return rng.choice([prose(), sentence(2, 9), "".join(f"<p>{prose()}</p>" for _ in range(rng.randrange(low, high + 1)))])

    def comment() -> str:
        return "".join(f"<{t}{named('comments')}><b>{words(1, 2)}</b> {rng.choice(['', '<p>'])}{prose()}</{t}>" for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randrange(1, 5)))

    def part(kind: str) -> str:
        if kind == "menu":
            return wrap(kind, links(), ("nav", "nav", "div", "ul"))
        if kind == "header":
            return wrap(kind, rng.choice(["", f"<h1>{words(1, 5)}</h1>", f"<p>{sentence(2, 6)}</p>"]) + rng.choice(["", links()]) + words(1, 4), ("header", "header", "div"))
        if kind == "footer":
            return wrap(kind, f"{rng.choice(['&copy;', '©', 'Copyright', ''])} {words(1, 3)} &middot; {texts()}" + rng.choice(["", links()]), ("footer", "footer", "div"))
        if kind == "sidebar":
            return wrap(kind, rng.choice(["", f"<h3>{rng.choice(['Related', 'Read more', words(1, 3)])}</h3>"]) + rng.choice([links(), texts()]), ("aside", "aside", "div", "section"))
        if kind == "notice":
            return wrap(kind, rng.choice(["We use cookies. ", "", "Privacy: "]) + texts() + rng.choice(["", "<button>OK</button>"]), ("div", "div", "section", "p"))
        if kind == "advert":
            return wrap(kind, rng.choice(["", "Advertisement ", "Sponsored: "]) + texts(), ("div", "div", "section", "aside", "p"))
        if kind == "form":
            return wrap(kind, rng.choice(["Subscribe ", "Sign up ", "", ""]) + rng.choice([f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>", f"<p>{sentence(2, 12)}</p><textarea>{words(1, 4)}</textarea><select><option>{words(1, 2)}<option>{words(1, 2)}</select>"]), ("form",))
        if kind == "comments":
            return wrap(kind, rng.choice(["", f"<h2>{rng.choice(['Comments', '3 replies', words(1, 2)])}</h2>"]) + comment(), ("section", "div", "ol", "ul"))
        return wrap("share", rng.choice([links(), words(1, 5), "Share " + links()]), ("div", "p", "ul", "section"))

    def body() -> list[tuple[str, str | None]]:
        """(markup, text if it is main text) of an article's parts."""
        out: list[tuple[str, str | None]] = []
        for _ in range(rng.choice([0, 1, 1])):
            title = sentence(2, 9)
            out.append((f"<h1>{title}</h1>", title))
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13])):
            text = prose() if rng.random() < 0.75 else sentence(1, 6)
            kind = rng.random()
            if kind < 0.6:
                out.append((rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p class=lead>{}</p>", "<p>{}<br/></p>"]).format(text), text))
            elif kind < 0.7:
                out.append((rng.choice(["<h2>{}</h2>", "<h3>{}</h3>"]).format(text), text))
            elif kind < 0.8:
                rows = [sentence(1, 14) for _ in range(rng.randrange(1, 4))]
                out += [("<ul>", None), *((f"<li>{r}</li>", r) for r in rows), ("</ul>", None)]
            elif kind < 0.86:
                out.append((f"<blockquote>{text}</blockquote>", text))
            elif kind < 0.9:
                cells = [words(1, 3) for _ in range(4)]
                out += [("<table>", None), *((f"<tr><td>{c}", c) for c in cells), ("</table>", None)]
            elif kind < 0.94:
                link = words(1, 3)
                out.append((f'<p>{text} <a href="x">{link}</a> <em>{link}</em></p>', f"{text} {link} {link}"))
            elif kind < 0.97:
                out.append((f"<div>{text}</div>", text))
            else:
                out.append((part(rng.choice(("advert", "form", "share", "notice", "sidebar"))), None))
        return out

    pages = []
    for _ in range(n):
        parts: list[tuple[str, str | None]] = [(f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>", None)]
        above = [k for k in ("header", "menu", "notice", "advert", "form", "sidebar", "share") if rng.random() < 0.45]
        below = [k for k in ("comments", "sidebar", "advert", "share", "form", "notice", "menu") if rng.random() < 0.35]
        rng.shuffle(above)
        rng.shuffle(below)
        parts += [(part(k), None) for k in above]
        layout = rng.random()
        if layout < 0.08:
            parts += body()
        elif layout < 0.97:
            tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
            outer = rng.choice(["", "", "main", "div"])
            name = named("article") if tag in ("div", "section") or rng.random() < 0.3 else ""
            parts.append((f"<{outer}>" if outer else "", None))
            parts.append((f"<{tag}{name}>", None))
            parts += body()
            if rng.random() < 0.15:
                parts.append((part("comments"), None))
            parts.append((f"</{tag}>" + (f"</{outer}>" if outer else ""), None))
        parts += [(part(k), None) for k in below]
        parts.append(((part("footer") if rng.random() < 0.85 else "") + rng.choice(["</body></html>", ""]), None))
        source = "".join(html_part + rng.choice(["", "", "\n", "<!-- x -->"]) for html_part, _ in parts)
        pages.append((source, "\n".join(" ".join(t.split()) for _, t in parts if t)))
    return pages


@lru_cache(maxsize=1)
def default_model() -> LinearChainCrf:
    """The field trained on sample_pages()."""

    return fit(sample_pages())
