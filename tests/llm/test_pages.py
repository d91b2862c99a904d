import time

from lodestar.llm import html_wrappers, language_id
from lodestar.llm.html_wrappers import Page, extract, joined, pattern_of

from .hard import by_id


def page(i, body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>t{i}</title><script>var x = '<p>no</p>';</script></head><body><header class='masthead'>Site</header>"
            f"<nav><ul><li><a href='/a'>Menu</a></li></ul></nav>{extra}<div id='content{i}'>{body}</div><aside>Side {i}</aside>"
            f"<form><input name=q><label>Search</label></form><section class='user-comments'><p>A reader says {i}</p></section><footer>&copy; {i}</footer></body></html>")


def paragraphs(i, n):
    return [f"Paragraph {k} of page {i} says   something &amp; more,\nwith <b>bold</b> and <a href='#'>links</a> &lt;here&gt;." for k in range(n)]


def expected(i, n):
    return "\n".join(f"Paragraph {k} of page {i} says something & more, with bold and links <here>." for k in range(n))


def test_pages_of_one_template(spark):
    rows = [(i, f"http://h.example.com/{i}", page(i, "".join(f"<p>{p}" for p in paragraphs(i, 2 + i % 3)), "<div class='ad-box'>Buy</div>" if i % 2 else ""), 1) for i in range(12)]
    got = by_id(html_wrappers.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")), "page_id")
    assert {i: r[0]["text"] for i, r in got.items()} == {i: expected(i, 2 + i % 3) for i in range(12)}


def test_article_element_and_unclosed_tags():
    source = "<html><body><div class=ad>Ad</div><article><h1>Title&nbsp;one</h1><p><b>Bold text.<br><p>Next <i>one</i></p><!-- <p>not this</p> --></article><footer>f</footer>"
    assert extract(source, None) == "Title one\nBold text.\nNext one"


def test_wrapper_of_two_pages():
    a = pattern_of(Page("<body><h1>A</h1><p>one</p><p>two</p><i>x</i></body>"))
    b = pattern_of(Page("<body><h1>A</h1><div>new</div><p>three</p></body>"))
    body = joined(a, b)[html_wrappers.CHILDREN][0]
    kinds = [(c[0], c[html_wrappers.OPTIONAL], c[html_wrappers.REPEATED], c[html_wrappers.SLOT] == "*") for c in body[html_wrappers.CHILDREN]]
    assert kinds == [("h1", False, False, False), ("div", True, False, False), ("p", False, True, True)]
    turns = pattern_of(Page("<dl>" + "<dt>k</dt><dd>v</dd>" * 5 + "</dl>"))[html_wrappers.CHILDREN][0]
    assert [(c[0], c[html_wrappers.REPEATED]) for c in turns[html_wrappers.CHILDREN]] == [("dt", True), ("dd", True)]


def test_copies_of_a_page_are_not_its_template(spark):
    def article(i, more=""):
        return f"<html><body><article><h1>T{i}</h1>{more}<div class=note>All rights reserved.</div>" + "".join(f"<p>Words {k} of {'abcdefghijklmnop'[i]}</p>" for k in range(3)) + "</article></body></html>"

    quote = "<blockquote>Said once</blockquote><pre>code</pre>"
    rows = [(i, f"http://mixed.org/{i}", article(i), 1) for i in range(1, 13)]
    rows += [(100 + i, f"http://mixed.org/0?utm={i}", article(0, quote), 1) for i in range(30)]
    rows += [(200 + i, f"http://copies.org/0?page={i}", article(0, quote), 1) for i in range(30)]
    got = by_id(html_wrappers.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")), "page_id")
    own = lambda i, *more: "\n".join([f"T{i}", *more, *(f"Words {k} of {'abcdefghijklmnop'[i]}" for k in range(3))])
    assert all(got[i][0]["text"] == own(i) for i in range(1, 13))
    assert all(got[100 + i][0]["text"] == own(0, "Said once", "code") for i in range(30))
    # where there is no other article to tell by, all stays
    assert all(got[200 + i][0]["text"] == own(0, "Said once", "code", "All rights reserved.") for i in range(30))


def test_text_beside_the_largest_element_stays(spark):
    def text(i, name, n):
        return [f"The {name} number {k} of page {i} in many words." for k in range(n)]

    tags = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
    kinds = {
        "a.org": lambda i: (f"<h1>Title {i}</h1><p class=lead>Lead {i}</p><div class=body>{tags(text(i, 'line', 6))}</div>", [f"Title {i}", f"Lead {i}", *text(i, "line", 6)]),
        "b.org": lambda i: (f"<div class=tagline>All the words</div><div class=outer>Own {i}<div class=content>{tags(text(i, 'line', 9))}</div><div class=continued>{tags(text(i, 'end', 3))}</div></div>",
                            [f"Own {i}", *text(i, "line", 9), *text(i, "end", 3)]),
        "c.org": lambda i: (f"<article class=intro>{tags(text(i, 'start', 2))}</article><div>Between</div><article class=body>{tags(text(i, 'line', 6))}</article>", [*text(i, "start", 2), *text(i, "line", 6)]),
    }
    away = "<nav>Menu</nav><div class=sidebar>Side</div>"
    rows = [(f"{h}{i}", f"http://{h}/{i}", f"<html><body>{away}{f('abcdefghijkl'[i])[0]}<footer>f</footer></body></html>", 1) for h, f in kinds.items() for i in range(12)]
    got = by_id(html_wrappers.extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string, text int")), "page_id")
    for h, f in kinds.items():
        for i in range(12):
            assert got[f"{h}{i}"][0]["text"].split("\n") == f("abcdefghijkl"[i])[1]
    # without a wrapper, too
    assert extract(rows[0][2], None).split("\n") == kinds["a.org"]("a")[1]


HARD = [
    (1, "http://a.de/de/x", None), (2, None, ""), (3, "http://a.de/x", "<p"), (4, "not a url", "plain text only"), (5, "http://b.com/en/", "<div>" * 3_000 + "deep"),
    (6, "http://a.de/x", "<article><p>same</p></article>"), (6, "http://a.de/x", "<article><p>same</p></article>"), (None, "http://a.de/x", "<p>no id</p>"), (8, "http://c.fr/", "<p>" + "many words " * 20_000),
]


def hard_pages(spark, rows=HARD):
    return spark.createDataFrame(
        [(*r, "h", 3, "x") for r in rows], "page_id bigint, url string, html string, host string, salt int, text string")


def test_hard_pages(spark):
    got = by_id(html_wrappers.extract_pages(hard_pages(spark)), "page_id")
    assert got[1][0]["text"] == "" and got[2][0]["text"] == "" and got[4][0]["text"] == "plain text only" and got[5][0]["text"] == "deep"
    assert [r["text"] for r in got[6]] == ["same", "same"] and got[None][0]["text"] == "no id"
    assert got[8][0]["text"] == ("many words " * 20_000).strip()
    assert html_wrappers.extract_pages(hard_pages(spark).limit(0)).count() == 0


def test_language_of_pages(spark):
    words = {"en": "the house and the river with that thing", "de": "das haus und der fluss mit einem ding", "fr": "la maison et le fleuve avec une chose"}
    docs = spark.createDataFrame([(i, f"{t} " * 30, k) for i, (k, t) in enumerate(words.items())] + [(9, None, "en"), (10, "x", None)], "doc_id bigint, text string, lang string")
    rows = [(i, f"http://{k}.example.org/{k}/{i}", f"<html lang='{k}'><p>{words[k]}</p></html>") for i, k in enumerate(list(words) * 10)]
    rows += [(100, "http://de.example.org/p", "<html><p></p></html>"), (101, "http://de.example.org/de/q", "<html lang='en'><p>" + words["de"] * 3)]
    got = by_id(language_id.identify(hard_pages(spark, rows), docs), "page_id")
    assert all(got[i][0]["lang"] == k for i, k in enumerate(list(words) * 10))
    assert got[100][0]["lang"] == "de" and got[101][0]["lang"] == "de" and got[101][0]["declared"] == "en"
    hard = by_id(language_id.identify(hard_pages(spark), docs), "page_id")
    assert len(hard[6]) == 2 and all(r["lang"] in words for x in hard.values() for r in x)
    assert language_id.identify(hard_pages(spark), docs.limit(0)).filter("lang is null").count() == len(HARD)
    assert language_id.identify(hard_pages(spark).limit(0), docs).count() == 0


def test_long_text_outweighs_a_host_of_any_size(spark):
    words = {"en": "the house and the river with that thing ", "de": "das haus und der fluss mit einem ding "}
    docs = spark.createDataFrame([(i, t * 30, k) for i, (k, t) in enumerate(words.items())], "doc_id bigint, text string, lang string")
    for n in (10, 10_000):
        rows = [(i, f"http://big.example.org/en/{i}", f"<html lang='en'><p>{words['en']}</p></html>") for i in range(n)]
        rows += [(-1, "http://big.example.org/en/x", f"<html lang='en'><p>{words['de'] * 50}</p></html>"), (-2, "http://big.example.org/en/y", "<html lang='en'><p>ding</p></html>")]
        got = by_id(language_id.identify(hard_pages(spark, rows), docs).filter("page_id < 1"), "page_id")
        assert (got[-1][0]["lang"], got[-2][0]["lang"], got[0][0]["lang"]) == ("de", "en", "en")


def test_host_prior_is_smoothed_over_its_parents(spark):
    counts = spark.createDataFrame([([8.0, 0.0],)], "c array<double>")
    from pyspark.sql import functions as F

    got = counts.select(language_id.smoothed(F.col("c"), F.array(F.lit(0.25), F.lit(0.75)), 2.0).alias("p")).first()["p"]
    assert [round(x, 6) for x in got] == [0.85, 0.15]


def test_markup_is_stripped_in_linear_time():
    started = time.process_time()
    for piece in ("<script>", "<!--", "<", "<style ", "</script ", "<script></script", "<a href='x'", "<!-- -- >"):
        language_id.visible(piece * (1_000_000 // len(piece)))
        language_id.visible("<p>" + piece * (1_000_000 // len(piece)) + ">")
    assert time.process_time() - started < 20
    cases = {"a<b>c</b>": "a c ", "a<!-- x": "a", "a <script>x": "a  ", "a<b>c<!-- d": "a c", "<p>a <!-- <b>": " a  ", "1 < 2": "1 < 2", "a<script>x</script >b<!--c-->d": "a b d", "": "", "a > b &amp; c": "a > b & c"}
    assert {k: language_id.visible(k) for k in cases} == cases
