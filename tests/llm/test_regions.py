"""Extraction: the region against a brute-force search, and what classes and ids may take out."""

import html
import random

import pytest

from fathomlog.llm import html_extract

WORDS = "plain words of an article that goes on for some time"
MORE = "further words of the same article that must not be lost"


def brute_force(page):
    """Words of the interval of tokens with the largest sum, tried one by one, the first and shortest of equals."""
    weight = html_extract.weights()
    scores, words = [], []
    for tag, text, link in html_extract.tokens(page):
        if tag:
            scores.append(weight.get(tag, weight["other@"] if tag.endswith("@") else weight["other"]))
            words.append([])
        else:
            words.append(html.unescape(text).split())
            scores.append(len(words[-1]) * weight["link word" if link else "word"])
    best, chosen = 0.0, []
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, chosen = total, [w for some in words[i : j + 1] for w in some]
    return chosen


@pytest.mark.parametrize("seed", range(40))
def test_region_is_the_best_of_all(seed):
    r = random.Random(seed)
    pieces = ["<p>", "</p>", "<td>", "</td>", "<div>", "</div>", "<a href=x>", "</a>", "<br>", "<b>", "</b>", "<section>", "</section>", "<tr>", "<li>"]
    page = "".join(r.choice(pieces) if r.random() < 0.6 else " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(1, 7))) + " " for _ in range(60))
    # Blocks that reach into the region are taken whole, so the region's words are among the text's, in order.
    got = iter(html_extract.main_text(page).split())
    assert all(w in got for w in brute_force(page))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{WORDS}</p><section class='social history'><p>{MORE}</p></section></article>", f"{WORDS}\n{MORE}"),
        (f"<article><p>{WORDS}</p><div class='share-price'><p>{MORE}</p></div></article>", f"{WORDS}\n{MORE}"),
        (f"<article><p>{WORDS}</p><div class='share'><a>Post</a> <a>Send</a></div><p>{MORE}</p></article>", f"{WORDS}\n{MORE}"),
        (f"<article><p>{WORDS}</p><section id=discussion><p>{MORE}</p></section></article>", f"{WORDS}\n{MORE}"),
        (f"<div><p>{WORDS}</p><p>{WORDS}</p></div><section id=discussion><p>{MORE}</p></section>", f"{WORDS}\n{WORDS}"),
        (f"<article><p>{WORDS}</p><div class=comments><p>{MORE}</p></div></article>", WORDS),
        (f"<article><p>{WORDS}</p><p>{WORDS}</p><div class='sponsored-post'><p>{MORE} for sale</p></div></article>", f"{WORDS}\n{WORDS}"),
        (f"<article><p>{WORDS} <label>named</label></p></article>", f"{WORDS} named"),
        ("<div>just a line</div><p>two</p>", "just a line\ntwo"),
    ],
)
def test_classes_are_weighed_with_what_they_hold(page, text):
    assert html_extract.main_text(page) == text
