import itertools
import random

from psephos.llm import html_mincut as H

PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{}</style><script>if(a<b)"<p>no</p>"</script></head><body>
<header><a href=/>Site</a><h2>Big site header</h2></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice">We use cookies to improve your experience on this website. Please accept them all, now.</div>
<!-- <p>a comment</p> --><div id=content><h1>Head &amp; line</h1><p><b>First paragraph of the story,<br>long   enough to be
seen as text</b> and goes on for a while, as stories do.</p><p>Short.</p>
<aside>Related: other long stories that are not part of this article at all, but have many words in them to confuse.</aside>
<div class="ad">Buy <a href=x>this</a> now</div><p>Second <b>pa</b>ragraph with &lt;tags&gt; &#233; and <a href="q">a link</a>, also long enough to be text.</p></div>
<form><label>Your name</label><input><button>Send</button></form>
<section id="comments"><article class="comment"><p>I really liked this article, thanks for writing it all down for us to read!</p></article></section>
<footer>&copy; 2020 Someone. All rights reserved by the company that made this site.</footer></body></html>"""
TEXT = (
    "Head & line First paragraph of the story, long enough to be seen as text and goes on for a while, as stories do. Short. "
    "Second paragraph with <tags> é and a link, also long enough to be text."
)


def test_article_without_the_rest():
    assert H.main_text(PAGE) == TEXT


def test_one_word_in_a_class_does_not_veto_an_article():
    text = "A paragraph of the story that is long enough to be text and goes on for a while, as they do."
    for around in ('<article class="post tag-science">', '<div class="layout has-sidebar">', '<div class="no-sidebar">', '<div class="content-sidebar-wrap"><article>', '<div class="sidebar"><main>', '<article class="share">'):
        assert H.main_text(f"{around}<p>{text}</p><p>{text}</p>") == f"{text} {text}", around
    # a long paragraph in an article outweighs one hint; a list of comments or an aside still goes
    long = " ".join([text] * 3)
    assert H.main_text(f"<article><p>{text}</p><div class=share><p>{long}</p></div></article>") == f"{text} {long}"
    for around in ("<div class=related-posts><article>", "<aside><article>", "<div class=comments><article>", "<div class=sidebar>", "<div class=site-footer>"):
        assert H.main_text(f"<article><p>{text}</p></article>{around}<p>{text}</p>") == text, around


def test_quotes_open_a_value_only_after_the_sign():
    page = "<article><a title=it's href=x>go</a><p>A paragraph of the story, long enough.</p><p>B paragraph. It isn't so, as they say.</p><p>C is the last one of them.</p></article>"
    text = H.main_text(page)
    assert all(x in text for x in ("A paragraph", "B paragraph", "C is the last"))
    assert H.main_text("""<p title="a > b" x='c > d' don't>x y</p>""") == "x y"
    assert H.main_text("<p title=don't>it's</p>") == "it's"
    assert H.marks(""" title="class=ad" CLASS = 'Post one' id=x data-class=menu hidden=false aria-hidden="false" """) == ("post one x", False)
    assert [H.marks(a)[1] for a in (" hidden", ' aria-hidden="true"', ' style="color:red; Display : none"', " data-hidden=1")] == [True, True, True, False]


def test_tags_end_where_the_library_ends_them():
    """Text between tags with odd attributes, against html.parser."""
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out = []

        def handle_data(self, data):
            self.out.append(data)

    rng = random.Random(8)
    pieces = ["a", "b=c", 'd="e > f"', "g='h > i'", "j=k'l", 'm=n"o', "p = 'q'", "class=x", 'r=""', "s=''", "t==u"]
    for _ in range(400):
        page = "".join(f"<b {' '.join(rng.choices(pieces, k=rng.randrange(4)))}>word{i}</b> " for i in range(4))
        want = Texts()
        want.feed(page)
        want.close()
        assert "".join(H._TAG.sub("", page).split()) == "".join("".join(want.out).split()), page


def test_broken_markup():
    assert H.main_text("<p>unclosed <b>bold &amp; x") == "unclosed bold & x"
    assert H.main_text("<a href='x>y'>q</a> a < b & c") == "q a < b & c"
    assert H.main_text("<p>a<p>b<script>never closed <p>c") == "a b"
    assert H.main_text("plain text only") == "plain text only"
    assert H.main_text("<!-- never closed <p>x") == ""


def test_cut_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(2, 9)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        ties = H.edges([rng.randrange(3) for _ in range(n)])

        def cost(side, gain=gain, ties=ties):
            return sum(max(0, g) if not s else max(0, -g) for g, s in zip(gain, side, strict=True)) + sum(c for i, j, c in ties if side[i] != side[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(H.source_side(gain, ties)) - best) < 1e-6


def test_long_pages_are_whole_and_fast():
    page = "<div class=ad>a b c</div><p>word after word after word after word, ten of them.</p>" * 5000
    assert H.main_text(page) == " ".join(["word after word after word after word, ten of them."] * 5000)
    for bad in ("<a " * 50_000, '<a href="x' * 50_000, "<!--" * 50_000, "<div>" * 20_000):
        H.main_text(bad)


def test_rows(spark):
    rows = [(0, "u", PAGE), (1, None, None), (2, "u", ""), (None, "v", "<p>text of a page</p>"), (0, "u", PAGE)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, H.extract(df).collect()), key=repr)
    want = [(0, "u", TEXT, len(TEXT)), (0, "u", TEXT, len(TEXT)), (1, None, "", 0), (2, "u", "", 0), (None, "v", "text of a page", 14)]
    assert got == sorted(want, key=repr)
    assert H.extract(df.limit(0)).count() == 0
