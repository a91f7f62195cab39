"""Pages by a generator of its own: boxes of other things stand among the paragraphs of an article. And nesting of any depth."""

import random
import time

import pytest

from ledgerloom.llm import html_extract

WORDS = "the of and river market people small winter council said after before road house plan water school city between many old years report station local bridge".split()
BOXES = ("article", 'div class="content"', "main", 'section class="story"', 'div class="post"')
CLASSES = ("ad", "advert", "sponsored", "related", "newsletter", "share", "cookie-notice", "comments", "sidebar", "menu", "promo-box", "subscribe-form", "notice", "disclaimer", "widget")


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 16))).capitalize() + "."


def paragraphs(rng):
    return [" ".join(sentence(rng) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]


def page(rng, box, name, tag, shape):
    before, after, own, head = paragraphs(rng), paragraphs(rng), sentence(rng), " ".join(rng.choice(WORDS) for _ in range(5))
    inner = {"bare": own, "p": f"<p>{own}</p>", "pp": f"<p>{own}</p><p>{sentence(rng)}</p>", "h": f"<h4>More</h4><p>{own}</p>"}[shape]
    body = "".join(f"<p>{t}</p>" for t in before) + f'<{tag} class="{name}">{inner}</{tag}>' + "".join(f"<p>{t}</p>" for t in after)
    source = f'<html><body><nav><a href="/">Home</a> <a href="/n">News</a></nav><{box}><h1>{head}</h1>{body}</{box.split()[0]}><footer>&copy; 2020</footer></body></html>'
    return source, " ".join([head, *before, *after])


def test_boxes_inside_articles_are_left_out(model):
    rng, good, pages = random.Random(5), 0, 0
    for box in BOXES:
        for name in CLASSES:
            for shape in ("bare", "p", "pp", "h"):
                for tag in ("div", "aside", "section"):
                    source, want = page(rng, box, name, tag, shape)
                    good, pages = good + (html_extract.extract([source], model) == [want]), pages + 1
    assert good >= 0.95 * pages


def test_boxes_of_the_article_stay(model):
    """Names that say nothing, or that are the article's own."""
    rng, good, pages = random.Random(6), 0, 0
    for box in BOXES:
        for name in ("lead", "text", "intro", "quote", "row", "x1", "highlight", "abstract"):
            for shape in ("bare", "p", "pp"):
                source, without = page(rng, box, name, "div", shape)
                got = html_extract.extract([source], model)[0]
                good, pages = good + (len(got) > len(without)), pages + 1
    assert good >= 0.9 * pages


def test_deep_nesting_takes_time_in_proportion(model):
    n = 100_000
    for source in ("<div>" * n + "<li>x" * n, "<div>" * n + "</b>x" * n, "<b>" * n + "<div>x" * n, "<ul><li><p>x" * n, "<table><tr><td>x" * n, "<a>x<p>" * n):
        began = time.perf_counter()
        html_extract.Page(source)
        assert time.perf_counter() - began < 20
    began = time.perf_counter()
    html_extract.extract(["<div>" * n + "<li>x" * n], model)
    assert time.perf_counter() - began < 60
