import itertools
import random
import time

import pytest

from netloom.llm import html_text, mincut


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 8)
        gain = [rng.choice([-1, 1]) * rng.random() * 3 for _ in range(n)]
        edges = {(a, b): rng.random() * 2 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(labels, gain=gain, edges=edges):
            own = sum(max(-g, 0) if side else max(g, 0) for g, side in zip(gain, labels, strict=True))
            return own + sum(c for (a, b), c in edges.items() if labels[a] != labels[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(mincut.label(gain, edges)) - best) < 1e-6


LONG = "This is a sentence of the article that goes on for quite a while, so that it looks like prose. " * 2
PAGES = {
    "plain": ("<article><h1>A title</h1><p>One &amp; two</p><p>x</p></article>", "A title\n\nOne & two\n\nx"),
    "unclosed": (f"<body><nav><a href=/>Home</a></nav><article><p><b>{LONG}<br><p>Second\n  line", f"{LONG.strip()}\n\nSecond line"),
    "parts": (f"<body><header><h1>Site</h1></header><ul class=menu><li><a>One</a><li><a>Two</a></ul><main><p>{LONG}</p><aside>See also</aside>"
              f"<p>{LONG}</p></main><div id='comments'><p>Nice article, I liked it a lot and will come back again.</p></div><footer>All rights reserved</footer>",
              f"{LONG.strip()}\n\n{LONG.strip()}"),
    "no article": (f"<body><div class='sidebar'><p>Links and more links here</p></div><div><p>{LONG}</p><p>short one</p><p>{LONG}</p></div>"
                   "<div class=cookie-notice>We use cookies</div><form><p>Your name</p><input></form>", f"{LONG.strip()}\n\nshort one\n\n{LONG.strip()}"),
    "hidden": (f"<article><p>{LONG}</p><p style='display:none'>secret</p><div class='article no-sidebar'><p>{LONG}</p></div></article>", f"{LONG.strip()}\n\n{LONG.strip()}"),
    "script": (f"<title>T</title><script>var a='</p>'; if (1<2) b();</script><style>p{{}}</style><article><p>{LONG}<!-- <p>no</p> --></p></article>", LONG.strip()),
    "not a tag": ("<article><p>1 < 2 and 3 &lt; 4 &#8364; &nbsp; x</p></article>", "1 < 2 and 3 < 4 € x"),
    "open comment": ("<article><p>kept text here</p><!-- no end <p>gone</p>", "kept text here"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert html_text.main_text(page) == text


def test_operator(spark):
    long_page = "<article>" + "<p>word</p>" * 5000 + "</article>"
    rows = [(i, "u", p, "x") for i, (p, _) in enumerate(PAGES.values())] + [(None, None, None, "x"), (0, "u", PAGES["plain"][0], "x"), (99, "u", long_page, "x")]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [*(t for _, t in PAGES.values()), "", PAGES["plain"][1], "\n\n".join(["word"] * 5000)]
    assert sorted(r["text"] for r in found) == sorted(want) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_adversarial_markup_ends_quickly():
    html_text.main_text("<a \"" * 3000)
    html_text.main_text("<div>" * 3000 + "x")
    html_text.main_text("<p>a<b>" * 3000)


FILL = "a > b <p>leaked</p> hidden " * 400  # over 10,000 characters
TAGS = {
    "long attribute": f'<article><div data-state="{FILL}"><p>{LONG}</p></div></article>',
    "long attribute in single quotes": f"<article data-state='{FILL}'><p>{LONG}</p></article>",
    "markup in an attribute of a skipped element": f'<article><p>{LONG}</p><iframe srcdoc="{FILL}</iframe>{FILL}"></iframe></article>',
    "self-closed svg": f'<svg width=1 data-x="a>b" /><article><p><svg/>{LONG}</p></article>',
    "svg": f"<article><svg><text>no</text></svg ><p>{LONG}</p></article>",
    "custom elements": f"<title-bar>x</title-bar><template-part><select-box><style-guide><article><p>{LONG}</p></article>",
    "closing tag of another element": f"<title>no</title-bar>no</title><article><p>{LONG}</p></article>",
    "apostrophe without value": f"<article><p id=o'neil it's>{LONG}</p></article>",
}


@pytest.mark.parametrize("name", TAGS)
def test_tags_are_recognised_whole(name):
    assert html_text.main_text(TAGS[name]) == LONG.strip()


def test_open_tags_end_quickly():
    assert html_text.main_text('<a b=">" ' * 100_000) == ""
    assert html_text.main_text(f"<article><p>{LONG}</p>" + "<i x='" * 50_001) == LONG.strip()


def test_lists_and_short_paragraphs_without_article():
    """No element or class word names the article; the menu's links stay out, the list in the text stays in."""
    body = f"<p>{LONG}</p><p>A sentence here.</p><ul><li>First item</li><li>Second</li></ul><p>End.</p>"
    text = f"{LONG.strip()}\n\nA sentence here.\n\nFirst item\n\nSecond\n\nEnd."
    assert html_text.main_text(body) == text
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/x>About us</a></li></ul>"
    assert html_text.main_text(f"<body>{menu}{body}<ul><li><a href=1>Next story</a></li></ul>") == text


def test_the_cut_changes_labels():
    """Here the classifier alone would drop the list's items; the cut keeps them for their neighbours' sake."""
    blocks = html_text.blocks_of(f"<p>{LONG}</p><ul><li>First item</li><li>Second</li></ul><p>{LONG}</p>")
    assert [html_text.gain_of(*b) > 0 for b in blocks] == [True, False, False, True]
    assert html_text.main_text(f"<p>{LONG}</p><ul><li>First item</li><li>Second</li></ul><p>{LONG}</p>").count("\n\n") == 3


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<div>" * 20_000 + "<dd></dd>" * 20_000, "x</i>" * 100_000])
def test_tags_take_linear_time(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 5
