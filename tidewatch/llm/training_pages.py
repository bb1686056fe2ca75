"""Labelled pages from which the extraction model learns its potentials.

``data-label`` marks an element and all below it as content or boilerplate. The pages are put together from parts: a shell, content
written in common ways, and boilerplate before, inside and after it.
"""

from __future__ import annotations

import re

_PARAGRAPHS = (
    "<p>The council met on Tuesday to discuss the new bridge, which has been planned for several years and is now expected to open in spring.</p>",
    "<p>Residents said that the <a href='/old'>old crossing</a> had become unsafe, and that <em>traffic</em> had doubled since the factory moved to the valley.</p>",
    "<p>Short answer.</p>",
    "<p><b>A bold opening line<br>that goes on after a break, with words enough to fill more than one line of the page.</p>",
)
_PARTS = (
    "<h1>Bridge to open in spring</h1>", "<h2>What changes for drivers</h2>", "<h3>Dates</h3>",
    "<ul><li>The northern lane closes in March</li><li>The southern lane closes in April and opens again in May</li></ul>",
    "<ol><li>Bring the form</li><li>Wait for the letter</li></ol>",
    "<blockquote><p>We have waited long enough for this, said the mayor after the vote.</p></blockquote>",
    "<table><tbody><tr><th>Year</th><th>Cars</th></tr><tr><td>2020</td><td>11,400</td></tr></tbody></table>",
    "<figure><img src='b.jpg'><figcaption>The bridge as planned, seen from the east bank</figcaption></figure>",
    "<pre><code>cars = count(lane) * 2</code></pre>", "<dl><dt>Span</dt><dd>The distance between two supports of the bridge</dd></dl>",
    "<div><span>Plain text stands in a division of its own and reads like any other paragraph of the story.</span></div>",
    "<section><h2>Costs</h2><p>The bridge costs nine million, two more than was planned when the work began.</p></section>",
)
_WRAPS = (
    "<article data-label='content'>{}</article>", "<article class='post' data-label='content'>{}</article>", "<main><article data-label='content'>{}</article></main>",
    "<main data-label='content'>{}</main>", "<div id='content' data-label='content'>{}</div>", "<div class='container'><div class='row'><div class='article-body' data-label='content'>{}</div></div></div>",
    "<div class='wrapper'><div class='post-content entry-content' data-label='content'>{}</div></div>", "<div id='main'><div class='story text' data-label='content'>{}</div></div>",
    "<section class='main' role='main'><article itemprop='articleBody' data-label='content'>{}</article></section>", "<div class='page'><div class='main-content' data-label='content'>{}</div></div>",
)
#: Elements without any name around the content, and nothing else in the page but what stands beside them.
_BARE = (
    "<div data-label='content'>{}</div>", "<div><div data-label='content'>{}</div></div>", "<div><div><div data-label='content'>{}</div></div></div>", "<section data-label='content'>{}</section>",
    "<table><tbody><tr><td data-label='content'>{}</td></tr></tbody></table>", "<center><div data-label='content'>{}</div></center>",
)
_LOOSE = ("{}", "<div>{}</div>", "<div class='wrapper page'><div>{}</div></div>", "<div id='main' class='main container'>{}</div>", "<section>{}</section>")
_BEFORE = (
    "<nav data-label='boiler'><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About us</a></li></ul></nav>",
    "<header data-label='boiler'><a class='logo' href='/'>The Valley Post</a><p>Independent since 1911</p></header>",
    "<header data-label='boiler'><h1>The Valley Post</h1><p>All the news of the valley and of the towns around it, every day.</p></header>",
    "<header id='top' data-label='boiler'><div><h1><a href='/'>The Valley Post</a></h1><h2>News since 1911</h2></div></header>",
    "<nav data-label='boiler'><h2>Menu</h2><p>Choose a part of the site</p>News Sport</nav>",
    "<div id='header' class='header site-header masthead topbar' data-label='boiler'><div class='logo'>The Valley Post</div><div>All the news of the valley</div></div>",
    "<div class='menu navbar navigation nav' role='navigation' data-label='boiler'><a href='/a'>Sport</a> <a href='/b'>Weather</a> <span>More</span></div>",
    "<div class='ad' data-label='boiler'>Buy two lamps and get the third one free until the end of the month.</div>",
    "<div class='advert advertisement ads sponsor sponsored promo promotion banner' data-label='boiler'><p>Sponsored: the best insurance in town, call now and save a lot.</p></div>",
    "<div class='cookie cookies consent notice gdpr' data-label='boiler'><p>We use cookies to make this site better. By reading on you agree to our policy.</p><button>Accept</button></div>",
    "<div class='breadcrumb breadcrumbs' data-label='boiler'><a href='/'>Home</a> &gt; <a href='/news'>News</a> &gt; Bridge</div>",
    "<form class='search' role='search' data-label='boiler'><label>Search this site</label><input name='q'><button>Go</button></form>",
    "<div class='notice alert warning message' role='alert' data-label='boiler'>This site will be closed for maintenance on Sunday from two to four in the morning.</div>",
    "<div class='skip' data-label='boiler'><a href='#content'>Skip to content</a></div>",
)
_INSIDE = (
    "<div class='share social' data-label='boiler'><a href='#'>Share</a> <a href='#'>Tweet</a></div>",
    "<aside data-label='boiler'><h3>Read also</h3><ul><li><a href='/x'>Ten old bridges</a></li></ul></aside>",
    "<div class='ad' data-label='boiler'>New shoes, half price this week only at the corner shop.</div>",
    "<div class='related related-posts recommended' data-label='boiler'><h4>Related</h4><a href='/y'>A tunnel instead?</a></div>",
    "<header data-label='boiler'><span class='date byline'>By our reporter, 3 May</span></header>",
    "<header data-label='boiler'><h1>Bridge to open</h1><h2>Spring it is</h2><p>By our reporter in the valley</p></header>",
    "<aside data-label='boiler'><p>A short note at the side that tells of something else, in a sentence or two.</p></aside>",
    "<footer data-label='boiler'><p>Filed under bridges and roads</p></footer>",
    "<form data-label='boiler'><p>Sign up for our letter</p><input name='mail'><button>Subscribe</button></form>",
    "<div class='newsletter subscribe signup' data-label='boiler'><p>Get the best stories in your mail every morning, free of charge.</p></div>",
    "",
)
_AFTER = (
    "<footer data-label='boiler'>&copy; valley.example.com All rights reserved</footer>",
    "<footer data-label='boiler'><h2>The Valley Post</h2><p>Written and printed in the valley since 1911 by people who live there.</p><ul><li>Jobs</li><li>Contact</li></ul></footer>",
    "<section class='comments' data-label='boiler'><h2>Comments</h2><p>A reader wrote this line, and it is no part of the story.</p><div class='comment'><p>Another one wrote this.</p></div></section>",
    "<form data-label='boiler'><h3>Write to us</h3><p>Your letter may be printed in the paper.</p><div><label>Name</label></div></form>",
    "<div id='footer' class='footer site-footer' data-label='boiler'><p>Copyright The Valley Post</p><a href='/terms'>Terms</a> <a href='/privacy'>Privacy</a></div>",
    "<aside class='sidebar' data-label='boiler'><h3>Most read</h3><ol><li><a href='/1'>Storm in the north</a></li><li><a href='/2'>School opens</a></li></ol><p>The weather will be fine for the rest of the week.</p></aside>",
    "<div id='sidebar' class='sidebar widget widgets rail' data-label='boiler'><div class='widget'><h4>About the author</h4><p>Writes on roads and rivers for this paper since 2002.</p></div></div>",
    "<section id='comments' class='comments' data-label='boiler'><h3>Comments</h3><div class='comment'><p>I live next to the old bridge, and it is about time that something is done about it.</p></div><div class='comment reply'><p>So do I, and I disagree with all you say.</p></div></section>",
    "<div class='comment-list comments-area discussion responses feedback' data-label='boiler'><ol><li class='comment'><p>Great article, thank you for this long and careful report on our town.</p></li></ol></div>",
    "<ul class='comments' data-label='boiler'><li class='comment user'><span class='author'>Reader</span><p>Nobody asked the people on the east bank, as ever, and that is the truth.</p></li></ul>",
    "<div class='pagination pager' data-label='boiler'><a href='?p=1'>1</a> <a href='?p=2'>Next</a></div>",
    "<div class='tags tag-list' data-label='boiler'><a href='/t/a'>bridges</a>, <a href='/t/b'>roads</a></div>",
    "<div class='popup modal overlay' data-label='boiler'><p>You have read three of five free stories this month. Subscribe now.</p></div>",
    "<div class='login' data-label='boiler'><form action='/login'><label>Name</label><input><label>Password</label><input></form></div>",
    "<div class='disclaimer legal' data-label='boiler'>Prices may change. No advice is given on this page.</div>",
)
_SHELL = (
    "<!DOCTYPE html><html lang='en'><head data-label='boiler'><meta charset='utf-8'><title>Bridge to open - The Valley Post</title>"
    "<style>p{{margin:0}}</style><script>track(1);</script></head><body>{}</body></html>"
)


def _content(k: int, loose: bool) -> str:
    own = [_PARTS[0]] if k % 3 else []
    for j in range(1 + k % 5):
        own += [_PARAGRAPHS[(k + j) % len(_PARAGRAPHS)], _PARTS[1 + (k * 3 + j * 5) % (len(_PARTS) - 1)]]
    own.append(_PARAGRAPHS[k % 3])
    if loose:  # without an element around it
        own = [re.sub(r"^<(\w+)", r"<\1 data-label='content'", x) for x in own]
    own.insert(len(own) // 2, _INSIDE[k % len(_INSIDE)])
    return "".join(own)


def _page(k: int) -> str:
    before = "".join(_BEFORE[(k + j * 4) % len(_BEFORE)] for j in range(k % 4))
    after = "".join(_AFTER[(k + j * 5) % len(_AFTER)] for j in range(k % 3))
    if k % 5 == 4:  # a plain page
        few = k % 2
        return _SHELL.format((before if few else "") + _BARE[k // 5 % len(_BARE)].format(_content(k, False) if k % 4 else _PARAGRAPHS[k // 5 % 3]) + (after if few else ""))
    wrap = _LOOSE[k % len(_LOOSE)] if k % 3 == 0 else _WRAPS[k % len(_WRAPS)]
    return _SHELL.format(before + wrap.format(_content(k, k % 3 == 0)) + after)


PAGES = tuple(_page(k) for k in range(360))
