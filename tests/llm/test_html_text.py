import duckdb
import numpy as np

from callsieve.llm.html_text import extract, main_text, smoothed, threshold


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


LONG = "Several words that make up a sentence of an article, long enough to look like one. " * 3


def test_boilerplate_goes_and_short_blocks_stay():
    html = page(
        "<header><a href=/>Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies " + LONG + "</div><main><article class='post'><h1>Head &amp; line</h1>"
        f"<p>{LONG}</p><div class='ad'>Buy {LONG}</div><p>Short.</p><p>{LONG}<form>Your mail<input></form><p>Two\n  <b>parts</b>"
        "<script>var a = '<p>no</p>';</script></p></article><section id='comments'><p>Me too! " + LONG + "</p></section></main>"
        "<aside><p>Related " + LONG + "</p></aside><footer>&copy; me</footer>"
    )
    line = " ".join(LONG.split())
    assert main_text(html) == "\n".join(["Head & line", line, "Short.", line, "Two parts"])


def test_without_article_element():
    html = page(
        "<div id=top><a>a</a> <a>b</a> <a>c</a></div><div id=content><h1>Head</h1><div class=text>"
        f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div><div><a>x</a> <a>y</a></div>"
    )
    line = " ".join(LONG.split())
    assert main_text(html) == "\n".join(["Head", line, "Short.", line])


def test_odd_input():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<nav>menu</nav>") == ""
    assert main_text("just text & more &lt;b&gt;") == "just text & more <b>"
    assert main_text("<p>one<p>two<br>three<p>cut off <b") .startswith("one\ntwo\nthree\ncut off")
    assert main_text("<nav><ul><li>menu<article><p>unclosed menu") == "unclosed menu"
    assert main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>a&nbsp; b c</p></article>") == "a b c"


def test_smoothing_and_threshold():
    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0)
    assert 2 < threshold(np.array([1.0, 1.0, 2.0, 50.0, 60.0])) < 50


def test_article_of_every_test_page(spark):
    """The generated pages hold their article in an element of that name."""
    from html import unescape
    import re

    path = "/root/testdata/sf0.01/pages.parquet"
    got = {r.page_id: r for r in extract(spark.read.parquet(path)).collect()}
    rows = duckdb.execute(f"SELECT page_id, url, html FROM '{path}'").fetchall()
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        body = re.search("<article>(.*?)</article>", html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body)]
        assert got[page_id].text == "\n".join(x for x in blocks if x)
        assert got[page_id].n_chars == len(got[page_id].text) and got[page_id].url == url


def test_table_with_nulls_and_clashes(spark):
    df = spark.createDataFrame(
        [(None, None, None, "x"), (1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (2, "u", "", None)],
        "page_id long, url string, html string, text string",
    )
    rows = sorted(extract(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, "a", 1), (1, "a", 1), (2, "", 0), (None, "", 0)]
    assert extract(df.limit(0)).count() == 0


def test_deep_nesting_takes_linear_time():
    assert main_text("<div>x" * 100_000).count("x") >= 1


def test_names_of_parts():
    body = "<div class='layout has-sidebar'><h1>Head</h1><p>{0}</p><p class='notice'>Note {0}</p><table><tr class=header><td>Cell</table>{1}</div>"
    for extra in ("<div id=userComments>{0}</div>", "<p class=ad>{0}</p>", "<div role=alert>{0}</div>", "<div style='display: none'>{0}</div>", "<div hidden>{0}</div>"):
        line = " ".join(LONG.split())
        assert main_text(page(body.format(LONG, extra.format(LONG)))) == f"Head\n{line}\nCell"


SHORT = "A teaser of one sentence, no more."


def paragraphs(n, words="word"):
    return [" ".join(f"{words}{i}" for _ in range(25)) for i in range(n)]


def test_sibling_articles_are_both_kept():
    first, second = paragraphs(6, "one"), paragraphs(5, "another")
    html = page("<nav><a>x</a><a>y</a></nav>" + "".join(f"<article>{''.join(f'<p>{x}</p>' for x in part)}</article>" for part in (first, second)))
    assert main_text(html) == "\n".join(first + second)


def test_teaser_article_does_not_outvote_a_long_text():
    text = paragraphs(30)
    html = page(f"<article><p>{SHORT}</p></article><div class=story>{''.join(f'<p>{x}</p>' for x in text)}</div><footer>foot</footer>")
    assert main_text(html) == "\n".join(text)


def test_names_inside_an_article_with_long_text():
    text = paragraphs(3)
    html = page(
        f"<article><p>{text[0]}</p><div class='share-price'><p>{text[1]}</p></div><p id='social'>{text[2]}</p>"
        f"<div class='share-buttons'><a>Share</a> <a>Like</a></div><p>Text <span class=ad>buy</span> goes on</p></article>"
    )
    assert main_text(html) == "\n".join([*text, "Text goes on"])


def test_parts_that_hold_nearly_everything_are_the_article():
    text = paragraphs(20)
    body = "".join(f"<p>{x}</p>" for x in text)
    for around in ("<form>{}</form>", "<div class=comments>{}</div>", "<aside>{}</aside>"):
        html = page(around.format("<nav><ul><li><a>menu</a></ul></nav>" + body) + f"<div><p>{SHORT}</p></div>")
        assert main_text(html) == "\n".join(text)


def test_long_cluster_outside_the_article_is_kept():
    first, second = paragraphs(12, "in"), paragraphs(8, "out")
    html = page(
        f"<article>{''.join(f'<p>{x}</p>' for x in first)}</article><div>{'<a>a</a><br><a>b</a><br>' * 8}</div>"
        f"<div>{''.join(f'<p>{x}</p>' for x in second)}</div>"
    )
    assert main_text(html) == "\n".join(first + second)


def test_clusters_decide_where_no_element_does(monkeypatch):
    """Pages of plain containers: the text is told from the links by ratios alone."""
    text = paragraphs(6)
    links = "".join(f"<div><a>Link number {i}</a> <a>and another one</a></div>" for i in range(60))
    html = page(f"<div>{links}</div><div>{''.join(f'<p>{x}</p>' for x in text)}</div>")
    assert main_text(html) == "\n".join(text)
    from callsieve.llm import html_text

    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)
    assert main_text(html) != "\n".join(text) and "Link number 0" in main_text(html)
