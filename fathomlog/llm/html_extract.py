"""Main text of HTML pages as the maximum-scoring contiguous region of tokens.

A page is a sequence of tags and words. Words score positive, less so in links, and
tags negative, by weights fitted on labelled pages (``html_pages``): a tag's weight is
the log-odds of being inside the main text rather than around it, so paragraphs cost
next to nothing and leaving an article or a table cell costs much. One linear scan finds
the region with the largest sum.

Within the region, too, there is what is no part of an article. Menus, headers, footers, forms
and the like are told by their elements' names and roles. Elements told by class and id only
(adverts, notices, reader comments) are scored: each word of theirs weighs its log-odds, learned
from labelled elements, of being no part in such a place, an article being around it or not,
with running text or without; an element goes if the mean is against it. Headings, and what
holds most of the page, always stay. What goes scores nothing for the region.

Blocks are what block-level tags separate; white space in a block, line breaks included,
becomes one space.

Defined results: a null page is empty (empty text, length 0); a page without words gives
the empty text; unclosed elements and stray tags are allowed; repeated rows are extracted
each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomlog.llm.common import released, slices
from fathomlog.llm.html_pages import NO_PART, PART, labelled_pages

# HTML's element kinds.
RAW = "script|style|textarea|title"  # nothing else runs to the end of the page where its end tag is missing
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html head li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no part of an article, by name, by ARIA role, and by words of class and id.
SKIPPED = frozenset("nav aside footer form menu dialog button search fieldset option svg template".split())
#: Skipped, too, but never within each other: one that another follows before an end tag is empty.
EMBEDDED = frozenset("noscript iframe xmp select canvas audio video".split())
#: Elements that end where one of these begins.
IMPLIED = {"li": "li", "td": "td th tr", "th": "td th tr", "tr": "tr", "dd": "dd dt", "dt": "dd dt", "option": "option", "p": " ".join(BLOCKS)}
IMPLIED = {k: frozenset(v.split()) for k, v in IMPLIED.items()}
LISTS = ("ul", "ol", "dl", "menu", "table")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What holds more of the page's text than this isn't left out for words of its class and id.
MOST, MOST_COMMENTS = 0.5, 0.9
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a row, none of a link, that are running text.
RUNNING = 8
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


#: Words that say what an element goes with, not what it is.
BESIDE = re.compile(r"(?:^|(?<=[\s_-]))(?:(?:has|with|no|without)[_-]+[\w-]+|(?:post|entry|article|story|content)[_-]+header)(?=$|[\s_])", re.I)
_COMMENT = frozenset("comment comments commentlist respond replies disqus discussion".split())


@lru_cache(1)
def marks() -> dict[tuple[bool, bool, str], float]:
    """Log-odds of words of classes and ids against an element, by (article around it, running text in it)."""
    out = {}
    for place in NO_PART:
        against, speaks = NO_PART[place].split(), PART[place].split()
        for word in {*against, *speaks}:
            out[(*place, word)] = math.log((against.count(word) + 0.5) / (speaks.count(word) + 0.5))
    return out


def _against(value: str, in_article: bool, running: bool) -> tuple[float, bool]:
    """(mean weight of a class or id against its element, whether it tells of comments); unknown words speak for running text."""
    words = [w for w in re.split(r"[\s_-]+", BESIDE.sub("", value).lower()) if w]
    known = [marks().get((in_article, running, w)) for w in words]
    if all(w is None for w in known):
        return -1.0, False
    return sum((-0.5 if running else 0.0) if w is None else w for w in known) / len(words), any(w in _COMMENT for w in words)


def _skips(name: str, rest: str, in_article: bool, held: Callable[[], tuple[float, int]] = lambda: (0.0, 0)) -> str:
    """Why an element is left out: "" if it isn't. held: the share of the page's text and the words of running text that it holds."""
    if name in SKIPPED or name in EMBEDDED or (name == "header" and not in_article):
        return name
    if rest and name not in ("html", "body", "main"):
        for key, value in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                if name in HEADINGS or (name == "header" and in_article):
                    continue
                share, running = held()
                score, comments = _against(value, in_article, running >= RUNNING)
                if score >= 0 and share <= (MOST_COMMENTS if comments else MOST):
                    return "comments" if comments else "marked"
            elif key == "role" and value.lower() in ROLES:
                return "marked"
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return "marked"
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "marked"
    return ""


def _held(page: str) -> dict[int, tuple[float, int]]:
    """By the place of its tag, what an element with an end tag, or one that ends with an ancestor, holds: its share of the page's text, and words of running text."""
    words = running = links = 0
    opened, stacks = [], Counter()
    out = {}
    for m in _TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            n = len((m["text"] or "").split())
            words += n
            running += n if n >= RUNNING and not links else 0
            continue
        name = name.lower()
        if name == "a":
            links = 0 if m["close"] else 1
        if not m["close"]:
            if name not in VOID and not m["rest"].endswith("/"):
                opened.append((name, m.start(), words, running))
                stacks[name] += 1
        elif stacks[name]:
            while opened:
                one, at, before, ran = opened.pop()
                stacks[one] -= 1
                out[at] = (words - before, running - ran) if one == name else (0, 0)
                if one == name:
                    break
    return {at: (n / max(1, words), ran) for at, (n, ran) in out.items()}


def tokens(page: str, whole: bool = True) -> Iterator[tuple[str, str, bool]]:
    """(tag, text, link) of what may be article: a tag name (closing ones with /, those within an article with @) or a stretch of text.

    whole: whether ``page`` is all of a page, so that shares of its text mean something.
    """
    skipping, depth, why = "", 0, ""
    links = 0
    article = 0
    opened, inside = Counter(), Counter()  # elements open around what is skipped, and within it
    shares: dict[int, tuple[float, int]] | None = None
    tags: dict[str, list[tuple[int, bool]]] = {}

    def closed(name: str, after: int) -> bool:
        """Whether the next tag of the name is an end tag."""
        if name not in tags:
            tags[name] = [(t.start(), t[0][1] == "/") for t in re.finditer(rf"</?{name}\b", page, re.I)][::-1]
        while tags[name] and tags[name][-1][0] < after:
            tags[name].pop()
        return bool(tags[name]) and tags[name][-1][1]

    for m in _TOKEN.finditer(page):
        name, text = m["name"], m["text"]
        if name is None:
            if text is not None and not skipping:
                yield "", text, links > 0
            continue
        name = name.lower()
        closing = bool(m["close"])
        empty = not closing and (name in VOID or (name in ("svg", "math", "iframe") and m["rest"].endswith("/")))

        def share(at: int = m.start()) -> tuple[float, int]:
            nonlocal shares
            if not whole:
                return 0.0, 0
            if shares is None:
                shares = _held(page)
            return shares.get(at, (0.0, 0))

        if skipping:
            # An element left open ends where the article begins, where its end is implied, or with an element around it.
            opens = not closing and name in ("article", "main") and why != "comments" and not _skips(name, m["rest"], False)
            implied = not closing and name in IMPLIED.get(skipping, ()) and not any(inside[x] for x in LISTS)
            around = closing and name != skipping and name in BLOCKS and name not in IMPLIED and not inside[name] and opened[name] > 0
            if name == skipping and not empty and not implied:
                depth += -1 if closing else 1
            elif name != skipping and not empty:
                inside[name] = max(0, inside[name] + (-1 if closing else 1))
            if depth == 0 or opens or implied or around or (name in ("body", "html") and closing):
                skipping = ""
                if not (opens or implied or around):
                    yield ("/" if closing else "") + name + ("@" if article else ""), "", False
                    continue
            else:
                continue
        if name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
        elif name == "a":
            links = 0 if closing else 1
        if not closing and not empty and (name not in EMBEDDED or closed(name, m.end())) and (why := _skips(name, m["rest"], article > 0, share)):
            skipping, depth = name, 1
            inside.clear()
        elif not empty:
            opened[name] = max(0, opened[name] + (-1 if closing else 1))
        # Tags within an article are weighed apart: there they rarely lead out of it.
        inner = "@" if article and name not in ("article", "main") else ""
        yield ("/" if closing else "") + name + inner, "", False


@lru_cache(1)
def weights() -> dict[str, float]:
    """Weights of tags, and of "word" and "link word", from the labelled pages."""
    inside, outside = Counter(), Counter()
    for before, main, after in labelled_pages():
        for part, counts in ((before, outside), (main, inside), (after, outside)):
            for tag, text, link in tokens(part, whole=False):
                counts[tag or ("link word" if link else "word")] += len(text.split()) if text else 1
    out = {}
    for name in inside | outside:
        odds = math.log((inside[name] + 0.5) / (outside[name] + 0.5))
        out[name] = max(0.1, min(1.0, odds)) if name.endswith("word") else min(-0.05, max(-6.0, odds))
    out["link word"] = min(out["link word"], 0.3)
    out["other"], out["other@"] = -0.5, -0.05
    return out


def main_text(page: str) -> str:
    """The blocks of the best region, one to a line."""
    score_of = weights()
    word, link_word, other = score_of["word"], score_of["link word"], score_of["other"]
    blocks: list[list[str]] = [[]]
    spans: list[tuple[int, int]] = []  # per block with text: its first and last token
    total = best = 0.0
    start = best_from = 0
    best_to = -1
    for i, (tag, text, link) in enumerate(tokens(page)):
        if tag:
            total += score_of.get(tag, score_of["other@"] if tag.endswith("@") else other)
            tag = tag.rstrip("@")
            if tag.lstrip("/") in BLOCKS:
                if blocks[-1]:
                    blocks.append([])
            elif tag == "br" and blocks[-1]:
                blocks[-1].append(" ")
        else:
            text = html.unescape(text)
            if not text.strip():
                if blocks[-1]:
                    blocks[-1].append(" ")
                continue
            if not blocks[-1]:
                spans.append((i, i))
            blocks[-1].append(text)
            spans[-1] = (spans[-1][0], i)
            total += len(text.split()) * (link_word if link else word)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, start, i
    kept = (b for b, (first, last) in zip((b for b in blocks if b), spans, strict=True) if last >= best_from and first <= best_to)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in kept) if x)


def extract(df: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*keep, text, n_chars) per page."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts = [main_text(x) if x else "" for x in batch.column(html_col).to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return df.select(*(F.col(c) for c in keep), F.col(html_col).cast("string").alias(html_col)).mapInArrow(released(run), f"{kinds}, text string, n_chars long")
