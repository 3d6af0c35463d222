import itertools
import random
import time

from dataloupe.llm import html_extract
from dataloupe.llm.html_extract import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1><nav><a href=/>Home</a> | <a href=/b>About us</a></nav></header>
<div class="cookie-notice">We use cookies. Please accept them all.</div>
<div id="leftSidebar"><p>Related stories that you may like to read today.</p></div>
<!-- <p>no</p> --><script>var t = "</p>"; if (a < b) c();</script>
<main><article><header><h1>Title &amp; more</h1></header>
<p>One   two <b>three</b> four.<p>Second&nbsp;para with a <a href="x>y">link</a><br>inside.
<ul><li>item one</li><li>item two</ul><aside>Buy this now, it is cheap!</aside>
<table><tr><td>cell &#233;</td></tr></table></article>
<section class="comments"><p>Great article, I love it. It is long and nice to read.</p></section></main>
<form><label>Email</label><button>Subscribe</button></form><footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE).split("\n") == [
        "Title & more", "One two three four.", "Second para with a link inside.", "item one",
        "item two", "cell é",
    ]


def test_defined_results_of_odd_pages():
    assert main_text(None) == main_text("") == main_text("<div><div>") == main_text("<p> \n </p>") == ""
    assert main_text("<p>a < b & c &lt; d") == "a < b & c < d"
    assert main_text("<p>Text with no end tags and <b>bold") == "Text with no end tags and bold"
    assert main_text("<p>It's here.</p><script>never closed <p>gone") == "It's here."
    assert main_text('<p title="unclosed>Long text after a broken quote is kept.</p>') != ""
    deep = "<div>" * 3000 + "<p>Deep down there is a text of some length.</p>"
    assert main_text(deep) == "Deep down there is a text of some length."
    long = "".join(f"<p>Paragraph number {i} with some words.</p>" for i in range(20_000))
    assert main_text(long).count("\n") == 19_999


def test_cut_is_minimal():
    random_ = random.Random(6)
    for _ in range(300):
        n = random_.randint(1, 9)
        scores = [random_.uniform(-2, 2) for _ in range(n)]
        pairs = list(itertools.combinations(range(n), 2))
        edges = [(a, b, random_.uniform(0, 2)) for a, b in pairs if random_.random() < 0.5]

        def cost(side):
            own = sum(abs(s) for s, on in zip(scores, side) if (s > 0) != on)
            return own + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(html_extract.minimum_cut(scores, edges)) - best) < 1e-9


def test_column(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    found = html_extract.with_main_text(pages)
    assert found.columns == pages.columns
    texts = {r.page_id: r.main_text for r in found.collect()}
    assert texts[1] == main_text(PAGE) and texts[2] == "" and texts[None] == ""
    assert html_extract.with_main_text(pages.where("false")).count() == 0


def test_given_pages_give_their_articles(spark):
    """The article of these pages is one element, so that cutting it out shows the result."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        plain = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks)
        assert main_text(r.html) == "\n".join(b for b in plain if b)


def test_wrappers_with_boilerplate_names():
    """Names and forms around a page do not take its article away, and still take the rest."""
    article = "<article><h1>A title</h1><p>The first paragraph of it.</p><p>And a second one.</p></article>"
    plain = "<p>The first paragraph, longer than the rest of it all.</p><p>And a second one.</p>"
    rest = '<div class="comments"><p>Great, I love it.</p></div><nav><a href=/>Home</a></nav>'
    for wrapper in (
        '<body class="post has-sidebar">{}</body>',
        '<body><div class="page no-comments">{}</div></body>',
        '<body><form action="/">{}</form></body>',
        '<body class="has-sidebar"><form><div id="header-wrap">{}</div></form></body>',
    ):
        expected = "A title\nThe first paragraph of it.\nAnd a second one."
        assert main_text(wrapper.format(article + rest)) == expected, wrapper
        assert main_text(wrapper.format(f"<main>{article}</main>{rest}")) == expected, wrapper
        found = main_text(wrapper.format(plain + rest))
        assert found.split("\n") == [
            "The first paragraph, longer than the rest of it all.", "And a second one.",
        ], wrapper
    named = article.replace("<article>", '<article class="post comments-open">')
    assert main_text(f"<body><main>{named}</main>{rest}</body>").startswith("A title\nThe first")
    long = '<section class="comments">' + "<p>A comment of some length.</p>" * 30 + "</section>"
    assert main_text(f"<body><main>{article}{long}</main></body>").count("\n") == 2


ARTICLE = (
    "<article>{}<h1>A title of it</h1><p>The first paragraph of it is rather long, as they are.</p>"
    "{}<p>And a second one.</p></article>"
)
WRAPPERS = ("<body>{}</body>", "<body><main>{}</main></body>", "<body><div id=page>{}</div></body>")


def test_names_inside_an_article_do_not_decide_alone():
    kept = {
        '<header class="entry-header"><h1>Head of it</h1></header>': "Head of it",
        '<div class="entry-header"><h1>Head of it</h1></div>': "Head of it",
        '<section id="related-work"><p>Work like it was done.</p></section>': "Work like it was done.",
        '<div class="legal-history"><p>The law was made.</p></div>': "The law was made.",
        '<blockquote class="notice">Take notice of it</blockquote>': "Take notice of it",
        '<table><thead class="table-header"><tr><th>Year</th></tr></thead></table>': "Year",
        "<p>We have <math><mi>x</mi></math> here.</p>": "We have x here.",
        '<h2 id="comments-in-it">Comments in it</h2>': "Comments in it",
    }
    for piece, text in kept.items():
        for wrapper in WRAPPERS:
            for around in ((piece, ""), ("", piece)):
                found = main_text(wrapper.format(ARTICLE.format(*around))).split("\n")
                assert sorted(found) == sorted([*main_text(ARTICLE.format("", "")).split("\n"), text])
    dropped = (
        '<div class="ad">Buy this now, it is cheap!</div>',
        '<div class="related-posts"><ul><li><a href=x>Another post</a></li><li><a href=y>More</a></li></ul></div>',
        '<div class="share-buttons"><p>Share this with your friends.</p></div>',
        '<section class="post-comments"><p>Great, I love it.</p></section>',
        "<section><article><p>A reader says something about it.</p></article></section>",
    )
    for piece in dropped:
        for wrapper in WRAPPERS:
            assert main_text(wrapper.format(ARTICLE.format("", piece))).count("\n") == 2, piece


def test_answers_after_an_article():
    answers = (
        '<div id="responses"><article class="response"><p>This is a good one, really.</p></article>'
        "<article><p>I do not think so, not at all, my friend.</p></article></div>"
    )
    assert main_text(f"<body>{ARTICLE.format('', '')}{answers}").count("\n") == 2
    listed = "".join(f"<article><p>Story number {i} of this day.</p></article>" for i in range(5))
    assert main_text(f"<body><article>{listed}</article>").count("\n") == 4


def test_time_is_linear_in_the_page():
    for unit in (
        "<p>Text here</p><div>abc def</div>", "<a 'b ", "<a '>' ", "<button>x ", "<div>x", "<div>x</p>", "<a <!-- ",
    ):
        start = time.process_time()
        main_text(unit * (500_000 // len(unit)))
        assert time.process_time() - start < 10, unit


def test_ends_of_pages():
    assert main_text("<p>one < two and a<b 'c") == "one < two and a<b 'c"
    assert main_text("<p>One is here</p><p>and two <!-- three <p>") == "One is here\nand two"
    many = "<a \"x'>y</a>" * 20
    assert main_text(f"<p>Start of it.</p>{many}<p>The end is here.</p>").endswith("The end is here.")
