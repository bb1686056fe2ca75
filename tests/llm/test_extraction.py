"""Main text: pages that the model has not seen, parsing in linear time, no text lost."""

import random
import time
from collections import Counter

from tidewatch.llm import extraction

WORDS = "harbour ferry winter market council teacher garden engine violin lantern valley copper bakery orchard captain glacier mirror pepper saddle thunder".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def held_out(rng):
    """A page of a make that no training page has, and its main text as blocks."""
    p = lambda lo, hi: sentence(rng, rng.randint(lo, hi))
    blocks, body = [], []
    title = p(4, 9)
    for k in range(rng.randint(2, 7)):
        t = p(3, 40)
        form = rng.choice(["<p>{}</p>", "<p class='lead'>{}</p>", "<p style='margin:1em'>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<p><em>{}</em></p>", "<p><span class='x1'>{}</span></p>"])
        blocks.append(t)
        body.append(form.format(t))
    wrap = rng.choice(["<article class='node node-{k}'>{b}</article>", "<div class='entry'>{b}</div>", "<main id='primary'><div>{b}</div></main>", "<div id='page'><div class='article'>{b}</div></div>", "<section><article>{b}</article></section>", "<div><div>{b}</div></div>", "<div class='post-text'>{b}</div>"])
    before = rng.sample([
        f"<nav class='top-nav'><a href='/a'>{p(1, 2)}</a><a href='/b'>{p(1, 2)}</a></nav>", f"<header class='page-header'><a href='/'>{p(2, 3)}</a><p>{p(3, 6)}</p></header>",
        f"<div class='cookie-banner'>{p(6, 12)} <button>{p(1, 2)}</button></div>", f"<div class='ad-slot'>{p(5, 12)}</div>", f"<ul id='main-menu' class='menu'><li><a href='/x'>{p(1, 2)}</a></li><li><a href='/y'>{p(1, 2)}</a></li></ul>",
    ], rng.randint(0, 3))
    after = rng.sample([
        f"<footer><p>{p(4, 10)}</p></footer>", f"<div class='footer-links'><a href='/t'>{p(1, 2)}</a> <a href='/p'>{p(1, 2)}</a></div>", f"<aside><h4>{p(1, 3)}</h4><ul><li><a href='/1'>{p(3, 6)}</a></li></ul></aside>",
        f"<section class='comments-section'><h3>{p(1, 2)}</h3><div class='comment-body'><p>{p(8, 20)}</p></div></section>", f"<form action='/s'><label>{p(1, 2)}</label><input></form>", f"<div class='sidebar-widget'><p>{p(5, 12)}</p></div>",
    ], rng.randint(0, 3))
    page = f"<html><head><title>{title}</title></head><body>{''.join(before)}{wrap.replace('{k}', '7').replace('{b}', ''.join(body))}{''.join(after)}</body></html>"
    return page, "\n\n".join(blocks)


def test_held_out_pages():
    rng, model = random.Random(5), extraction.trained()
    got = want = both = whole = 0
    for _ in range(400):
        page, text = held_out(rng)
        a, b = Counter(extraction.extract(page, model).split()), Counter(text.split())
        got, want, both = got + a.total(), want + b.total(), both + (a & b).total()
        whole += extraction.extract(page, model) == text
    precision, recall = both / got, both / want
    assert 2 * precision * recall / (precision + recall) > 0.95, (precision, recall)
    assert whole > 300


def test_no_text_is_lost():
    model = extraction.trained()
    run = lambda page: extraction.extract(page, model)
    story = "Some text of the story that is long enough to be an article."
    assert run(f"<div><div><p>{story}</p></div></div>") == story
    assert run(f"<article><p>{story}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold <svg><text>here</text></svg> now.</p><noscript>{story}</noscript></article>") == f"{story}\n\nLet x=2 hold here now.\n\n{story}"
    assert run(f"<article><p>{story}</p><textarea>a<p>{story}</p></article>").endswith(story)
    assert run(f"<article><p>{story}</p><p>{story} <select><p>{story}</p></article>").count(story) == 3
    assert run(f"<article><p>{story}</p><select><option>No</option></select><p>a &lt; b, 1 < 2 and <3</p></article>") == f"{story}\n\na < b, 1 < 2 and <3"
    assert run(f"<article><p>{story}</p><p title=\"x>{story}</p></article>").count(story) == 2  # a quote that never ends
    assert run(f"<p>{story}<!-- never ends <p>x</p>") == story
    assert run(f"<p>{story}<b never ends") .startswith(story)
    assert run("just text") == "just text" and run("") == ""


def test_parsing_is_linear():
    for page in ("<a " * 300_000, "<b>" * 100_000 + "x" + "<p>y", "<div>" * 50_000 + "x", "<textarea>" * 50_000, "<a \"" * 200_000, "<!--" * 200_000, "<" * 500_000, "<li><ul>" * 50_000, "</b>" * 100_000, "<!-->" * 100_000, "<a '>\">" * 60_000):
        began = time.time()
        extraction.parse(page)
        assert time.time() - began < 10, page[:20]
