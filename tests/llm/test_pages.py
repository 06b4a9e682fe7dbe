import random
import time

from tilewright.llm import pages

from . import page_set

STORY = "This is the first long paragraph of the story, with enough words to be read as prose by anyone who cares."
MORE = "A second paragraph follows here &amp; it also has quite a few words, some <b>bold</b> ones and <i>others</i> too."
WANT = STORY + " A second paragraph follows here & it also has quite a few words, some bold ones and others too."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{body}</body></html>"


def test_boilerplate_goes():
    body = f"""<header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site to make it better for you. Accept all of them now.</div>
    <article><p>{STORY}</p><div class="ad">Buy our great new product today, it is really very cheap now!</div><p>{MORE}</p><form><input value=x>Your name <button>Send</button></form></article>
    <aside class=sidebar><p>Related stories that you might like to read as well, chosen for you.</p></aside>
    <section id="comments"><p>I think this is a really great article, thanks for writing all of it down.</p></section>
    <footer>&copy; 2020 Someone. All rights reserved by the owners of this site.</footer>"""
    assert pages.main_text(page(body)) == WANT


def test_without_article():
    body = f"<div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content><p>{STORY}<p>{MORE}</div><div class=footer>Contact <a href=x>us</a></div>"
    assert pages.main_text(page(body)) == WANT


def test_broken_markup():
    assert pages.main_text(page(f"<article><h1>Title</h1><p><b>{STORY}<br><p>{MORE}</p></article><footer>f")) == "Title " + WANT
    assert pages.main_text(f"<article><p>{STORY}") == STORY
    assert pages.main_text(f"<article><p>{STORY}<foo bar='") == STORY
    for odd in ("", "<", "<>", "</", "<!--", "<script>", "a < b", "<p", "&#x41;&#0;&bogus;", "</p></div></b>", "<a href='x>"):
        pages.main_text(odd)


def test_white_space_and_references():
    assert pages.main_text("<article><p> a \n\t b&nbsp;c &#233;&eacute; &amp;lt; </p><p>d</p></article>") == "a b c éé &lt; d"


def brute_cut(n, a, b, edges):
    cost = lambda s: sum(a[k] if s >> k & 1 else b[k] for k in range(n)) + sum(w for i, j, w in edges if (s >> i & 1) != (s >> j & 1))
    return min(cost(s) for s in range(1 << n)), cost


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        a, b = [[rng.random() * 3 for _ in range(n)] for _ in range(2)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.4]
        best, cost = brute_cut(n, a, b, edges)
        got = pages.cut(n, a, b, edges)
        assert abs(cost(sum(x << k for k, x in enumerate(got))) - best) < 1e-6


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{STORY}</p></article>"), 5), (2, None, None, 5), (None, "v", "", 5), (1, "u", page(f"<article><p>{STORY}</p></article>"), 5), (3, "w", "<p>word</p>" * 3000, 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = pages.extract(df).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id == 1} == {STORY}
    assert all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id in (2, None)} == {""}
    assert pages.extract(df.limit(0)).count() == 0


def test_cut_is_right_where_the_threshold_is_not():
    """On 120 made pages the cut has the text of all of them; each block's own costs alone have it for 40."""
    found = [(html, text, pages.main_text(html), pages.main_text(html, smooth=False)) for _, html, text in page_set.pages()]
    assert len(found) == 120 and all(cut == text for _, text, cut, _ in found)
    assert sum(alone != cut for *_, cut, alone in found) == 80 and sum(alone == text for _, text, _, alone in found) == 40


def test_no_name_empties_a_page():
    assert pages.main_text(f'<article class="post social"><p>{STORY}</p></article>') == STORY
    assert pages.main_text(f'<div class="post-comment-guide"><p>{STORY}</p></div>') == STORY
    assert pages.main_text(f'<div id="main-header-image"><h1>The title</h1></div><div><p>{STORY}</p></div>') == "The title " + STORY
    assert pages.main_text(f'<div class="side"><p>{STORY}</p></div>') == STORY
    for name in sorted(pages.BOILER | pages.DOUBTFUL):
        assert pages.main_text(f'<nav><a href=1>Menu</a></nav><article class="{name}"><h1>Title</h1><p>{STORY}</p><p>No</p></article>') in (f"Title {STORY} No", "" if name in pages.REMARKS else None), name


def test_reader_comments_go():
    assert pages.main_text(f'<article><p>{STORY}</p></article><div class="comments"><article class="comment"><p>{STORY}</p></article></div>') == STORY
    assert pages.main_text(f'<article><p>{STORY}</p><section id="comments"><article><p>{STORY}</p></article></section></article>') == STORY
    assert pages.main_text(f'<div class="header-wrapper"><main><p>{STORY}</p></main></div><div class="banner"><p>{STORY}</p></div>') == STORY


def test_what_stands_in_a_line_does_not_split_it():
    for odd in ("<img src=x>", "<input>", "<picture><source><img></picture>", "<button>Go</button>", "<svg><title>t</title></svg>", "<script>x</script>", "<!-- c -->"):
        assert pages.main_text(f"<article><p>{STORY} foo{odd}bar</p></article>") == f"{STORY} foobar"


def test_deep_pages_take_time_by_their_length():
    for deep in ("<b>x" * 20_000, "<div>x" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000):
        began = time.process_time()
        pages.main_text(deep)
        assert time.process_time() - began < 10


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("a", "u", f"<article><p>{STORY}</p></article>")], "page_id string, url string, html string").selectExpr("*", "1 AS id", "2 AS text", "3 AS parent")
    assert [tuple(r) for r in pages.extract(rows).collect()] == [("a", "u", STORY, len(STORY))]
