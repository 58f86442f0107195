from __future__ import annotations

from larderflow.llm import html_extract

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- c <p>no</p> --><div class="ad box">Buy</div>
<article><h1>Head&nbsp;&eacute; &lt;x&gt;</h1><p><b>One
 two<br>three<p>four<i>five</i>  six 1 < 2</p><ul><li>a<li>b</ul><aside>no</aside><div class="cookie-notice">no</div>
<form><p>no</form><section class="comments"><article class="comment"><p>no</p></article></section><p hidden>no</p>
<table><tr><td>c<td>d</table>tail<footer>no</footer></article><footer>F</footer></body></html>"""
TEXT = "Head é <x>\nOne two three\nfourfive six 1 < 2\na\nb\nc\nd\ntail"


def plain(source):
    return html_extract.main_text(source, frozenset())


def test_main_text_of_odd_markup():
    assert plain(PAGE) == TEXT
    assert plain("") == "" and plain("just text &amp; more") == "just text & more"
    assert plain("<p>a<!-- open comment <p>b") == "a"
    assert plain("<p>a<script>b") == "a" and plain("<p>a</div></b></p>b") == "a\nb"
    assert plain('<p title="a>b" class=x>c</p><p title=\'>\'>d') == "c\nd"
    assert plain("<p>a <q") == "a" and plain("<textarea><p>x</p></textarea>y") == "y"
    assert plain("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert plain("<div class=page-header>no</div><article><header class=entry-header><h1>t</h1></header>x</article>") == "t\nx"
    assert plain("<main>x<article class='comment-list'>no</article><article>y</article></main>") == "x\ny"


def test_everyday_words_in_articles():
    kept = ('<h2 id="discussion">t</h2>', '<section id="related-work"><p>t</section>', '<section id="legal-analysis">t</section>',
            '<h3 id="registration-form">t</h3>', '<h2 id="comments">t</h2>', '<div class="discussion">t</div>', "<math><mi>t</mi></math>",
            "<section class=related-work><h2 id=search>t</h2></section>", "<label>t</label>")
    cut = ('<section id="comments">t</section>', "<div class=comment-list>t</div>", "<nav id=discussion>t</nav>", "<div class=ad>t</div>", "<form>t</form>")
    for one in kept:
        assert plain(f"<article><p>a</p>{one}</article>") == "a\nt", one
    for one in cut:
        assert plain(f"<article><p>a</p>{one}</article>") == "a", one
    assert plain("<div class=related>t</div><p>a") == "a"


def test_the_tree_decides_on_everyday_words_in_articles(spark):
    rows = []
    for k in range(8):
        links = "".join(f"<li><a href=/{k}{n}>more {k}{n}</a>" for n in range(4))
        body = f"<p>Story {k}</p><div class=related><ul>{links}</ul></div><div class=notice>All alike</div><div class=discussion><p>Thought {k}</p></div>"
        rows.append((k, f"http://f.org/{k}", f"<article>{body}</article>"))
    found = {r.page_id: r.text for r in html_extract.extract(rows_of(spark, rows)).collect()}
    assert found == {k: f"Story {k}\nThought {k}" for k in range(8)}


def rows_of(spark, rows):
    schema = "page_id long, url string, html string, text string, host string, _low string"
    return spark.createDataFrame([(*r, "t", "h", "l") for r in rows], schema)


def test_rows_of_all_kinds(spark):
    rows = [(1, "http://a.com/x", PAGE), (2, None, PAGE), (3, "http://a.com/y", None), (None, "x", "<p>z"), (1, "http://a.com/x", PAGE), (4, "", "")]
    result = html_extract.extract(rows_of(spark, rows))
    assert result.columns == ["page_id", "url", "text", "n_chars"]
    wanted = [(i, u, {PAGE: TEXT, None: "", "<p>z": "z", "": ""}[h]) for i, u, h in rows]
    assert sorted(map(str, map(tuple, result.collect()))) == sorted(str((i, u, t, len(t))) for i, u, t in wanted)
    assert html_extract.extract(rows_of(spark, [])).collect() == []


def test_site_tree_drops_what_all_pages_share(spark):
    """Menus and notices without a telling name: the same on all pages, or links only."""
    rows = []
    for k in range(8):
        menu = "".join(f"<li><a href=/{k}{n}>link {k}{n}</a>" for n in range(4))
        body = f"<div id=a><ul>{menu}</ul></div><div id=b>Sign our list, it is free</div><div id=c><p>Story {k} of many words</p><p>End {k}</p></div>"
        rows.append((k, f"http://b.org/{k}", f"<body>{body}</body>"))
    rows += [(100 + k, f"http://c.org/{k}", "<body><div id=b>Sign our list</div></body>") for k in range(2)]  # too few to tell
    rows += [(200 + k, f"http://d.org/{k}", "<article><p>Same story</p></article>") for k in range(9)]  # an article is an article
    found = {r.page_id: r.text for r in html_extract.extract(rows_of(spark, rows)).collect()}
    assert [found[k] for k in range(8)] == [f"Story {k} of many words\nEnd {k}" for k in range(8)]
    assert found[100] == found[101] == "Sign our list"
    assert {found[200 + k] for k in range(9)} == {"Same story"}


def test_importance_counts_copies_once(spark):
    body = "<body><div id=x>{}</div></body>"
    rows = [(k, "http://e.org/", body.format(f"text {min(k, 5)}")) for k in range(60)]
    tree = html_extract.style_tree(rows_of(spark, rows)).collect()
    assert {r.pages for r in tree} == {6} and min(r.importance for r in tree) >= 0.75


def test_tables_of_the_corpus(spark):
    """Articles of the given pages: what stands in <article>, found with plain string work."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", "", inner))
        wanted = "\n".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())
        assert r.text == wanted and r.n_chars == len(wanted)
