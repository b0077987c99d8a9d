import html
import re

from weftline.llm.common import table
from weftline.llm.pages import Page, host_of, main_texts, template


def text(source):
    return Page(source).text()


def test_blocks_and_references():
    assert text("<article><h1>A &amp; B</h1><p>one\n  two<br>three <b>four</b>five</p><p>&lt;x&gt; caf&eacute;&nbsp;!</article>") == "A & B\none two three fourfive\n<x> café !"
    assert text("<p>a<p>b<div>c<p>d</div>e") == "a\nb\nc\nd\ne"
    assert text("") == text("<!-- x") == text("<script>var a = '<p>no</p>'") == ""
    assert text("a < b &amp c &am") == "a < b & c &am"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def test_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>N</ul></nav>
    <div class="ad">AD</div><main><article><header>by me</header><h1>Title</h1><script>x("</p>")</script><p>Body <a href="/x?a>b">link</a>.</p>
    <form><label>F</label><input></form><aside>S</aside><div class="cookie-notice">C</div><div id="comments"><article><p>reader</p></article></div>
    <blockquote class="added">Q</blockquote></article></main><div class="sidebar">S</div><footer>&copy; F</footer></body></html>"""
    assert text(page) == "Title\nBody link.\nQ"
    assert text("<body><p>x</p><div role=navigation>m</div><div hidden>h</div><p>y</p></body>") == "x\ny"
    assert text("<body><nav>n</nav><main><p>a</p></main><p>b</p>") == "a"


def test_attributes_and_words_are_read_whole():
    kept = """<article><p style="overflow:hidden">a</p><p title="a hidden gem">b</p><p data-note="hidden" data-id="ad-1">c</p><p class="notice-period">d</p>
    <section id="share-price">e</section><p>f <math><mi>x</mi></math></p></article>"""
    assert text(kept) == "a\nb\nc\nd\ne\nf x"
    assert text("<article><header><h1>Title</h1><p>by me</p></header><p>x</p><p hidden>y</p><p class='ad'>z</p></article>") == "Title\nx"


def test_shapes_recur_though_words_differ(spark):
    def page(i):
        menu = "".join(f"<li><a href=/{i}/{k}>entry {i} {k}</a>" for k in range(3 + i % 4))
        body = "".join(f"<p>own sentence {i} {k} of this page, which is long</p>" for k in range(4 + i % 3))
        return (i, "https://soup.example/", f"<body><div class=top><ul>{menu}</ul></div><div class=box>{body}</div><div class=promotext>buy {i}</div></body>")

    df = spark.createDataFrame([page(i) for i in range(20)], "page_id long, url string, html string")
    for r in main_texts(df).collect():
        assert r.text.split("\n") == [f"own sentence {r.page_id} {k} of this page, which is long" for k in range(4 + r.page_id % 3)]


def test_template_alone_finds_menus_of_given_pages(spark):
    """Without articles and without the rules by tag or class, the counted template takes the menus of all crowded hosts."""
    found = {r.host: set(r.subtrees) for r in template(table(spark, "/root/testdata/sf0.1", "pages")).collect()}
    hosts = table(spark, "/root/testdata/sf0.1", "pages").select(host_of("url").alias("host"), "html").collect()
    changed = 0
    for r in hosts[:600]:
        page = Page(r.html)
        page.boilerplate = lambda i: False
        changed += page.text(found.get(r.host, set()), articles=False) != page.text(articles=False)
    assert changed > 0.8 * 600


def test_deep_nesting_and_length():
    assert text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(text("<article><p>" + "word " * 200_000)) == 5 * 200_000 - 1


def test_template_of_a_host(spark):
    def page(i, host, body):
        return (i, f"https://{host}/p/{i}", f"<html><body><div><span>About us</span> all rights</div><p>Share this page</p>{body}<p>Imprint {host}</p></body></html>")

    rows = [page(i, "a.example", f"<p>text of {i}</p><p>common saying</p>" if i % 2 else f"<p>text of {i}</p>") for i in range(20)]
    rows += [page(100 + i, "b.example", f"<p>other {i}</p>") for i in range(3)]
    rows += [(200 + i, "https://c.example/", f"<article><p>shared passage</p><p>own {i}</p><div>Follow us</div></article>") for i in range(12)]
    rows += [(300 + i, "http://d.example/", "<body><p>one text in many copies</p></body>") for i in range(30)]
    rows += [(400, None, None), (401, "no host", ""), (None, "https://a.example/", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in main_texts(df).collect()}
    assert len(got) == len(rows)
    assert got[2].text == "text of 2" and got[3].text == "text of 3"  # the saying is on half of the pages
    assert got[100].text == "About us all rights\nShare this page\nother 0\nImprint b.example"  # too few pages
    assert got[205].text == "shared passage\nown 5"
    assert got[310].text == "one text in many copies"
    assert got[400].text == got[401].text == "" and got[400].n_chars == 0 and got[None].text == "x"
    assert main_texts(df.limit(0)).count() == 0


def test_given_pages_against_a_plain_reading(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in main_texts(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"(?s)^.*?<article>|</article>.*$", "", r.html)
        blocks = [html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
