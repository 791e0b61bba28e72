"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of events: words and tags. Each has a score learned from labelled pages as a log-odds
of main text against the rest: a word's from the names, classes, ids and roles of the elements around it,
a tag's (never above zero) from its name. One linear scan (keep the running sum, restart where it is not
positive) finds the contiguous region with the largest sum; words of that region whose own score is negative
(an advert or reader comments inside an article) are left out. Blocks of what remains are the text.

Class and id of html, body, an outermost article or main, and of wrappers that hold most words together with a heading
of the article are the layout's and are not asked (`no-sidebar`, `has-comments`); nor is an article's section id
that may be its subject (`discussion`). Formulas (math) and what object holds are read as text.

The labelled pages are composed here from templates in which every part is marked; `fit_weights` takes any
other labelled pages instead.

Cases: null, empty or tag-only html gives ''. Cut-off pages and unclosed elements are read to their end.
Character references are decoded (also without ';', as browsers do). White space inside a block becomes one
space; blocks are joined by one newline; nothing is capped. Time grows with the page, not with its depth. Ties of the largest sum: the first region.
Repeated rows and extra columns: each row on its own; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common

# HTML's void elements, elements with raw text, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg select annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements whose class and id speak of the page's layout; and what an id inside an article may name as its subject.
HOLDERS = frozenset("html body article main".split())
SUBJECTS = frozenset("alert consent discussion feedback follow form header legal menu notice popular register search sharing tags trending".split())
#: What is left out inside an article parts it little, so that its end is not lost behind an advert.
WITHIN, HOLDS = -0.1, 2.0
_EVENT = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
_NAME = re.compile(r"[a-z]+")


def features(tag: str, attributes: str, named: bool = True, inside: bool = False) -> tuple[str, ...]:
    """What an element says of itself: its name, and if it is to be named so the words of its class, id and role.

    Inside an article the id of a section or heading is the target of links: words that may be its subject say nothing.
    """
    found = [f"<{tag}>"]
    if attributes:
        for kind, value in _ATTRIBUTE.findall(attributes) if named else ():
            anchor = inside and kind.lower() == "id" and tag in ("section", "h1", "h2", "h3", "h4", "h5", "h6", "p", "dt", "li")
            found += [f".{w}" for w in _NAME.findall(value.lower()) if not (anchor and w in SUBJECTS)]
        if _HIDDEN.search(attributes):
            found.append(".hidden")
    return tuple(found)


@dataclass
class Opened:
    """An element of a page: its features, the words that stand in it directly, the element around it, and for a heading or
    an article its features with all names."""

    own: tuple[str, ...]
    words: int
    around: int
    held: tuple[str, ...] | None


def events(page: str, opened: list[Opened] | None = None, free: frozenset[int] = frozenset(), known: Container[str] | None = None):
    """('text', text, context) / ('tag', name, (is_block, context)); context is the tuple of features of all open elements,
    of those that are known, so that its length does not grow with the depth.

    opened takes the elements; those whose numbers are in free are not judged by class and id.
    """
    stack: list[tuple[str, tuple[str, ...], int]] = []
    number = -1
    context: tuple[str, ...] = ()
    at, n = 0, len(page)
    while at < n:
        m = _EVENT.match(page, at)
        if m is None:  # a '<' that begins no tag, or a quote that never closes
            end = page.find("<", at + 1)
            end = n if end < 0 else end
            yield "text", page[at:end], context
            at = end
            continue
        at = m.end()
        closing, tag, attributes, text = m.groups()
        if text is not None:
            if opened is not None and stack:
                opened[stack[-1][2]].words += len(text.split())
            yield "text", text, context
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            yield "tag", tag, (not tag.startswith("annotation"), context)
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    context = stack[-1][1] if stack else ()
                    break
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in BLOCK:  # a block ends an open paragraph; items end their kind
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "td", "tr", "dd", "dt", "option"):
                        del stack[k:]
                        context = stack[-1][1] if stack else ()
                        break
                    if stack[k][0] in BLOCK:
                        break
            number += 1
            inside = "<article>" in context or "<main>" in context
            own = features(tag, attributes, number not in free and not (tag in HOLDERS and not inside), inside)
            if opened is not None:
                opened.append(Opened(own, 0, stack[-1][2] if stack else -1, features(tag, attributes) if tag in ("h1", "main", "article") else None))
            if tag == "header" and inside:
                own = ("<header> within", *own[1:])
            more = tuple(f for f in own if f not in context and (known is None or f in known or f in ("<article>", "<main>")))
            context = (*context, *more) if more else context
            stack.append((tag, context, number))
        yield "tag", tag, (tag in BLOCK, context)


class Weights:
    """Scores of features (summed over a word's surroundings) and of tags."""

    def __init__(self, words: dict[str, float], tags: dict[str, float], base: float, tag_default: float):
        self.words, self.tags, self.base, self.tag_default = words, tags, base, tag_default
        self.kept: dict[tuple[str, ...], float] = {}

    def of_words(self, context: tuple[str, ...]) -> float:
        got = self.kept.get(context)
        if got is None:
            if len(self.kept) > 50_000:
                self.kept.clear()
            each = [self.words.get(f, 0.0) for f in context]
            # What speaks for main text counts once at most: bold text in an advert is still an advert.
            got = self.kept[context] = max(-8.0, min(1.0, self.base + min(1.0, sum(x for x in each if x > 0)) + sum(x for x in each if x < 0)))
        return got

    def within(self, context: tuple[str, ...]) -> bool:
        """Whether an element around speaks strongly for main text."""
        return any(self.words.get(f, 0.0) >= HOLDS for f in context if f[:1] == "." or f in ("<article>", "<main>"))

    def of_tag(self, tag: str) -> float:
        return self.tags.get(tag, self.tag_default)


#: Separates main text from the rest in labelled pages.
MARK = "\x01"


def fit_weights(labelled: list[str], smooth: float = 0.5) -> Weights:
    """From pages whose main text stands between pairs of MARK (inside text)."""
    inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
    n_in = n_out = 0
    for page in labelled:
        main, pending = False, []
        for kind, value, context in events(page):
            if kind == "tag":
                pending.append(value)
                continue
            for piece in re.split(f"({MARK})", value):
                if piece == MARK:
                    main = not main
                    continue
                n = len(piece.split())
                if not n:
                    continue
                (tags_in if main else tags_out).update(pending)
                pending = []
                if main:
                    n_in += n
                    inside.update(dict.fromkeys(context, n))
                else:
                    n_out += n
                    outside.update(dict.fromkeys(context, n))
    odds = lambda a, b: math.log((a + smooth) / (n_in + 1)) - math.log((b + smooth) / (n_out + 1))
    words = {f: odds(inside[f], outside[f]) for f in {*inside, *outside}}
    words = {f: w for f, w in words.items() if abs(w) > 0.25}
    all_in, all_out = sum(tags_in.values()) + 1, sum(tags_out.values()) + 1
    tags = {t: min(-0.05, math.log((tags_in[t] + smooth) / all_in) - math.log((tags_out[t] + smooth) / all_out)) for t in {*tags_in, *tags_out}}
    return Weights(words, {t: max(-3.0, w) for t, w in tags.items()}, 0.5, -0.3)


def labelled_pages() -> list[str]:
    """Pages composed from marked parts: each kind of part in the elements and classes that commonly hold it."""
    say = lambda n, k: " ".join(f"w{(i * 7 + k) % 97}" for i in range(n))
    main = lambda n, k: f"{MARK}{say(n, k)}{MARK}"
    # Names by which pages commonly mark what is not the article.
    names = (
        "nav menu navbar navigation breadcrumb breadcrumbs header masthead topbar banner footer copyright sidebar aside rail widget related recommended trending popular "
        "ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login "
        "register search share sharing social follow comment comments reply replies respond discussion disqus feedback form toolbar pagination pager tags skip hidden legal disclaimer paywall"
    ).split()
    rest = [f"<{t}>{say(9, k)}</{t}>" for k, t in enumerate(("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "label"))]
    rest += [f"<nav><ul>{''.join(f'<li><a href=x>{say(1, i)}</a></li>' for i in range(8))}</ul></nav>", f"<ul><li><a href=x>{say(2, 3)}</a></li><li><a href=x>{say(2, 5)}</a></li></ul>"]
    rest += [f'<{t} class="{n}"><p>{say(12, k)}</p></{t}>' for k, n in enumerate(names) for t in ("div", "section" if k % 6 == 0 else "div")]
    rest += [f'<div id="{n}">{say(12, k)}</div>' for k, n in enumerate(names)]
    pages = []
    for k in range(len(rest)):
        around = [rest[(k * 5 + j * 11) % len(rest)] for j in range(8)]
        body = (f"<header><h1>{main(8, k)}</h1></header>" if k % 4 == 0 else f"<h1>{main(8, k)}</h1>") + f"<p>{main(40, k)}</p><h2>{main(4, k)}</h2><p><b>{main(9, k)}</b><br>{main(30, k)}<p>{main(25, k)} <a href=x>{main(2, k)}</a> <i>{main(4, k)}</i></p>"
        body += (f"<ul><li>{main(8, k)}</li><li>{main(8, k)}</li></ul>", f"<blockquote>{main(20, k)}</blockquote>", f"<table><tr><td>{main(4, k)}</td></tr></table>", f"<pre>{main(9, k)}</pre>", f"<section><h3>{main(3, k)}</h3><div>{main(20, k)}</div></section>")[k % 5]
        holder = ("article", "main", 'div class="content"', 'div class="post entry"', 'div id="article" class="story body"')[k % 5]
        inner = around[6] if k % 3 == 0 else ""
        pages.append(f"<html><head><title>{say(5, k)}</title><script>{say(3, k)}</script></head><body>{''.join(around[:4])}<{holder}>{body}{inner}<p>{main(30, k)}</p></{holder.split()[0]}>{''.join(around[4:6])}</body></html>")
    return pages


_FITTED: list[Weights] = []


def default_weights() -> Weights:
    if not _FITTED:
        _FITTED.append(fit_weights(labelled_pages()))
    return _FITTED[0]


def wrappers(page: str, weights: Weights) -> frozenset[int]:
    """Numbers of the elements that hold most of the page's words and the article's heading or element: their names are the layout's."""
    opened: list[Opened] = []
    total = sum(len(value.split()) for kind, value, _ in events(page, opened, known=weights.words) if kind == "text")
    against = lambda own: any(f[0] == "." and weights.words.get(f, 0.0) < 0 for f in own)
    words, good = [o.words for o in opened], [False] * len(opened)
    for k in range(len(opened) - 1, -1, -1):  # an element comes after the one around it
        up = opened[k].around
        if up >= 0:
            words[up] += words[k]
            good[up] |= good[k] or opened[k].held is not None and not against(opened[k].held)
    return frozenset(k for k, o in enumerate(opened) if 2 * words[k] > total and good[k] and ".hidden" not in o.own and against(o.own))


def extract(page: str, weights: Weights | None = None) -> str:
    """The main text of one page."""
    weights = weights or default_weights()
    best = running = 0.0
    first = begin = end = -1
    kept: list[tuple[str, float] | None] = []  # text with its words' score; None: a block begins or ends
    for kind, value, extra in events(page, free=wrappers(page, weights), known=weights.words):
        if kind == "tag":
            running += max(weights.of_tag(value), WITHIN) if weights.within(extra[1]) else weights.of_tag(value)
            if extra[0]:
                kept.append(None)
        else:
            n = len(value.split())
            score = weights.of_words(extra)
            kept.append((value, score))
            if not n:
                continue
            if score > 0 and running <= 0:
                running, first = 0.0, len(kept) - 1
            running += n * (max(score, WITHIN) if score < 0 and weights.within(extra) else score)
            if running > best:
                best, begin, end = running, first, len(kept)
        if running < 0:
            running = 0.0
    blocks, block = [], []
    for item in [*kept[begin:end], None] if end > 0 else []:
        if item is None:
            if block and (text := " ".join(entities.unescape("".join(block)).split())):
                blocks.append(text)
            block = []
        elif item[1] > 0:
            block.append(item[0])
    return "\n".join(blocks)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page; a narrow pass."""

    def run(batch: pa.RecordBatch):
        for part in common.rows_of(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([extract(h) for h in common.texts(part, "html")], pa.string())], ["page_id", "url", "text"])

    return common.map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: page_id, url, text, n_chars."""
    return main_texts(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
