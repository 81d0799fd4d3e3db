"""Operator 6 on awkward markup and on hand-labelled layouts that training never saw."""

import pytest

from geotally.llm import op6_html_extraction

ARTICLE = "<article><h1>Title here</h1><p>First paragraph of the article text.<p>Second paragraph, a little longer than the first one.</article>"
WANT = "Title here\n\nFirst paragraph of the article text.\n\nSecond paragraph, a little longer than the first one."
AWKWARD = [
    "<html><head><title>t</title><body>" + ARTICLE,
    "<title>t</title><meta charset=utf-8>" + ARTICLE,
    "<html><head><title>t</title><style>p{}</style>" + ARTICLE + "</html>",
    "<body><svg width=1 />" + ARTICLE,
    "<body><svg><path d=x><title>icon</title></svg>" + ARTICLE,
    "<body><svg viewBox='0 0 1 1'><path d=x>" + ARTICLE,
    "<body><div><video src=x></div>" + ARTICLE,
    "<body><object data=x>" + ARTICLE,
    "<body><figure><video src=x></figure>" + ARTICLE + "<video src=y></video>",
    "<body><form><select><option>red<option>blue</form>" + ARTICLE,
    "<body><form><select><option>red</option><option>blue</option></select></form>" + ARTICLE,
    "<body><script>if (a<b) { x = '</p>' + \"<article>\" }</script>" + ARTICLE,
    "<body><SCRIPT>var a = '<';</SCRIPT >" + ARTICLE,
    "<body><textarea><p>typed</textarea>" + ARTICLE,
    "<body><!--> --><!-- <p>x</p> --!>" + ARTICLE,
    "<body><noscript><p>Turn scripts on.</p></noscript><template><p>card</p></template>" + ARTICLE,
    "<body>" + ARTICLE.replace("First", "<math><mi>First</mi><annotation>\\frac</annotation></math>"),
    "<body>" + ARTICLE.replace("First", "<svg/>First<svg><text>chart</text></svg>"),
    "<body>" + ARTICLE + "<script>never closed <p>text</p>",
]
#: Hand-labelled layouts: the text of a main block is in [[ ]].
LAYOUTS = [
    """<body class="home"><div id="masthead"><a href=/>The Daily</a></div><div class="main-nav"><a href=/a>World</a> <a href=/b>Sport</a></div><div class="post-content"><h2>[[Rain is expected in the north]]</h2><p>[[Heavy rain will reach the coast tonight, the weather office said on Monday.]]</p><p>[[Roads near the river may be closed.]]</p></div><div class="post-comments"><p>I hope it rains soon, my garden is dry.</p></div><div id="colophon">&copy; 2020 The Daily</div></body>""",
    """<main><header><h1>[[How to bake bread]]</h1></header><p>[[You need flour, water, salt and some patience.]]</p><ul><li>[[500 g flour]]</li><li>[[10 g salt]]</li></ul><aside class="related"><a href=x>Ten more recipes</a></aside><p>[[Bake it for forty minutes.]]</p></main><footer><ul><li><a href=x>Imprint</a></li><li><a href=y>Privacy</a></li></ul></footer>""",
    """<div class="cookie-banner"><p>We use cookies to make this site better. By going on you agree.</p><button>OK</button></div><nav role="navigation"><ol class="breadcrumb"><li><a href=/>Home</a><li>News</ol></nav><div id="content"><article class="entry"><h1>[[Bridge opens again]]</h1><div class="share"><a href=x>Share</a></div><p>[[After two years of work the old bridge is open to walkers again.]]</p><blockquote>[[We are glad that it is over, said the mayor.]]</blockquote></article></div><div class="newsletter"><form><label>Your address</label><input><button>Join</button></form></div>""",
    """<table><tr><td class="sidebar"><a href=1>Archive</a><br><a href=2>About me</a></td><td class="content"><p>[[This page is laid out with a table, as many were long ago.]]</p><p>[[It still has a text worth reading in its middle column.]]</p></td></tr></table><div class="footer">Made with a text editor. All rights reserved.</div>""",
    """<section class="story"><h1>[[A short story]]</h1><p>[[Once there was a lamp that would not go out.]]</p><div class="advert">Buy two lamps and pay for one!</div><p>[[Nobody knew who had lit it.]]</p><pre>[[on / off / on]]</pre></section><section id="comments"><h3>3 replies</h3><div class="comment"><p>What a lovely story, thank you for writing it down.</p></div></section>""",
    """<div class="page"><div class="header"><h1><a href=/>Site name</a></h1></div><div class="menu"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div class="article-body"><p>[[The museum will stay open until nine on Fridays from next month on.]]</p><h3>[[Tickets]]</h3><p>[[Tickets cost five euros &amp; are sold at the door.]]</p></div><div class="popular"><p>Most read: the ten best museums for children in the whole country</p></div></div>""",
    """<article><p>[[Only one paragraph stands here, and no heading goes before it.]]</p></article><div id="disqus"><p>First!</p><p>I disagree with the whole article, and here is why I do so.</p></div>""",
    """<div class="alert">This site will be down on Sunday from two to four.</div><div class="content-main"><h1>[[Notes on rivers]]</h1><dl><dt>[[Source]]</dt><dd>[[Where a river begins, mostly in hills.]]</dd></dl><figure><img src=x><figcaption>[[A river in spring.]]</figcaption></figure></div><div class="sponsored"><a href=x>Rent a boat today</a></div><footer>Contact: <a href=x>mail</a></footer>""",
    """<body><div><p>[[The harbour was quiet on the first morning after the storm had gone.]]</p><p>[[Two boats lay on the beach.]]</p></div></body>""",
    """<body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div class="w-100"><h1>[[A walk along the wall]]</h1><p>[[The wall is eleven kilometres long and older than the town that it was built for.]]</p><p>[[Most of it can be walked, see <a href=x>the map</a> for the gates.]]</p></div><div>&copy; 2019 Town office</div></body>""",
    """<article><h1>[[Bread prices]]</h1><p class="text-share">[[Bread has become dearer by a tenth since the spring, shops say.]]</p><p class="story-alert">[[Flour is said to follow in autumn, when the mills buy again.]]</p><div class="share"><a href=x>Share</a></div></article><footer>Imprint</footer>""",
    """<div><div><p>[[An old page without any class, of one long paragraph about the river and its mills, the weirs and the people who kept them.]]</p></div></div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>""",
    """<p>[[No element stands around this paragraph at all, as in pages written by hand in an afternoon.]]</p><p>[[It has a second one, which ends the page.]]</p>""",
]


def main_text(pages):
    """What the query's operator gives, without Spark around it."""
    import numpy as np

    from geotally.llm.crf import Chains, viterbi

    model, out = op6_html_extraction.trained(), []
    for page in pages:
        texts, x = op6_html_extraction.blocks(page)
        chains = Chains(np.array([len(texts)]))
        out.append((texts, viterbi(model.score(x, chains), model.moves, chains).tolist()))
    return out


@pytest.mark.parametrize("page", AWKWARD)
def test_awkward_markup(page):
    texts, main = main_text([page])[0]
    assert "\n\n".join(t for t, y in zip(texts, main, strict=True) if y) == WANT


def test_hand_labelled_layouts():
    right = found = wanted = 0
    for page in LAYOUTS:
        blocks, _ = op6_html_extraction.blocks(page)
        want = [t.startswith("[[") for t in blocks]
        texts, main = main_text([page.replace("[[", "").replace("]]", "")])[0]
        assert [b.strip("[]") for b in blocks] == texts
        if sorted(t for t, y in zip(texts, main, strict=True) if y) != sorted(t for t, w in zip(texts, want, strict=True) if w):
            print("differs:", page[:60], [(t[:30], int(y), int(w)) for t, y, w in zip(texts, main, want, strict=True) if y != w])
        right += sum(bool(y) and w for y, w in zip(main, want, strict=True))
        found, wanted = found + sum(main), wanted + sum(want)
    print("precision", right / found, "recall", right / wanted)
    assert right >= 0.95 * found and right >= 0.95 * wanted
