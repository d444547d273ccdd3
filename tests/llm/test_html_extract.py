import re
from html import unescape

from maskwright.llm import html_extract


def article(html):
    """What the test pages hold: one article of headings and paragraphs, whose tags may be left open."""
    inner = re.search(r"(?s)<article[^>]*>(.*?)</article>", html)[1]
    inner = re.sub(r"(?s)<(script|style|aside|nav|form|footer|header)\b.*?</\1>", " ", inner)
    parts = re.split(r"</?(?:p|h\d|br|div|ul|li|section|table|tr|td|blockquote)\b[^>]*>", inner)
    return " ".join(x for p in parts if (x := " ".join(unescape(re.sub(r"<[^>]*>", "", p)).split())))


def test_query_keeps_the_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = html_extract.query(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_other_layouts():
    body = "".join(f"<p>Sentence number {i} of the body text, long enough to be a real paragraph &amp; more.</p>" for i in range(6))
    want = " ".join(f"Sentence number {i} of the body text, long enough to be a real paragraph & more." for i in range(6))
    junk = '<div id="cookie-notice"><p>We use cookies, a long notice that goes on and on and on for quite some words.</p></div><aside><p>A side story of many words that is not part of the article at all.</p></aside>'
    comments = '<section class="comments"><h3>Comments</h3><p>Reader one says a lot of things here, at length, with many words indeed.</p></section>'
    form = "<form><label>Name</label><input name=q><textarea>x</textarea><button>Send</button></form>"
    menu = '<div class="menu">' + "".join(f'<a href="/{i}">Link {i}</a> ' for i in range(20)) + "</div>"
    for html in (
        f"<html><body>{menu}{junk}<div class='post'><h2>The title</h2>{body}</div>{comments}{form}<div class='footer'>&copy; us</div></body></html>",
        f"<html><body><header>Site</header><main><h2>The title</h2>{body}{comments}{form}{junk}</main></body>",
        f"<article><h2>The title</h2><div class='text'>{body}</div>{comments}</article>{menu}",
    ):
        assert html_extract.extract_text(html) == "The title " + want, html
    assert html_extract.extract_text("<p>one<p>two &lt;b&gt;\n\t x<script>no</script><br>three") == "one two <b> x three"


def test_odd_pages(spark):
    rows = [(1, None, None, "a"), (2, "u", "", "b"), (3, "u", "<nav>x</nav><script>", "c"), (4, "u", "<p " * 50, "d"), (5, "u", "plain text only", "e"), (5, "u", "plain text only", "e"), (6, "u", "<article><p>" + "word " * 100_000, "f"), (7, "u", "<![if x]><!DOCTYPE <a></p></div>&#xD800;&bogus; y", "g")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = [(r.page_id, r.text) for r in html_extract.extract_pages(df).collect()]
    assert len(out) == 8 and dict(out)[1] == dict(out)[2] == dict(out)[3] == "" and dict(out)[5] == "plain text only" and len(dict(out)[6]) == 499_999
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_parts_of_one_article_stay_together():
    say = lambda name, n: (f"{name} is a part of the article. " * n)[: n * 10].strip()
    para = lambda name, n: "".join(f"<p>{say(name, 40)}</p>" for _ in range(n))
    cells = "<table>" + "".join("<tr>" + "".join(f"<td>cell{i}{j}</td>" for j in range(3)) + "</tr>" for i in range(6)) + "</table>"
    quote = "<blockquote><p>Brief.</p></blockquote><figure><img src=x><figcaption>A view</figcaption></figure><details><summary>More</summary>Few words.</details>"
    links = "<div>" + "".join(f'<a href="/{i}">Link {i}</a><br>' for i in range(20)) + "</div>"
    text = lambda html: " ".join(re.sub(r"<[^>]*>", " ", html).split())
    for tag in ("section", "div"):
        unlike = "<h1>Title</h1>" + "".join(f"<{tag}><h2>Head {n}</h2>{para(n, n)}</{tag}>" for n in (8, 3, 2)) + f"<{tag}><p>Short end.</p></{tag}>"
        for inner in (unlike, para("a", 2) + cells + para("b", 2), para("a", 2) + f"<{tag}>{cells}</{tag}>" + para("b", 2), para("a", 3) + quote + para("b", 1)):
            assert html_extract.extract_text(f"<body>{links}<article>{inner}</article>{links}") == text(inner)
            assert html_extract.extract_text(f"<body>{links}<div class='post'>{inner}</div>{links}") == text(inner)
            assert html_extract.extract_text(f"<body><div id='page'>{links}<div class='post'>{inner}</div>{links}</div>") == text(inner)
            assert html_extract.extract_text(f"<body><h1>Over</h1>{links}<div><h2>Outer</h2><div>{inner}</div></div>{links}") == "Over Outer " + text(inner)


def test_unknown_declarations_lose_nothing():
    for odd in ("<![foo]>", "<![foo[x]]>", "<![ y]>", "<![if x>"):
        assert html_extract.extract_blocks(f"a{odd}b<p>c") == ["ab", "c"]
        assert html_extract.extract_text(f"{odd}<article><p>one {odd} two<p>three</article>") == "one two three"
        assert html_extract.extract_text(f"<article><p>one{odd}</article>{odd}<p>x") == "one"


def test_inline_adverts_names_and_unreadable_marks():
    para = "<p>" + "A paragraph of the article that goes on for a while. " * 6 + "</p>"
    want = " ".join(re.sub("<[^>]*>", " ", para).split())
    for wrap in (lambda x: f"<article>{x}</article>", lambda x: f"<body><div id='content'>{x}</div></body>"):
        text = lambda inner: html_extract.extract_text(wrap(para + inner + para))  # noqa: E731, B023
        for advert in ("<span class='ad'><span>buy</span> now cheap</span>", "<span class='ad-slot'><b>buy <i>it</b> now</span>", "<a class=promo><em>x</em> y</a>", "<div class='post-comments'><p>me too</p></div>", "<ul id=related-articles><li>x</ul>"):
            assert text(f"<p>Before {advert}after</p>" if advert[1] in "sa" else advert) == (f"{want} Before after {want}" if advert[1] in "sa" else f"{want} {want}")
        for name in ("search-algorithms", "related-work", "social-science", "header-files", "widgetry", "adverbs", "notice-boards-of-rome"):
            assert text(f"<div class='{name}'><p>Told of it.</p></div>") == f"{want} Told of it. {want}"
        assert text("<p>Let <math><mi>x</mi></math> be <label>five</label>.</p>") == f"{want} Let x be five. {want}"
        assert text("<header><h1>Site</h1></header><h2>Own</h2>") == f"{want} Own {want}"
        assert text("<p>one &#" + "9" * 5000 + "; two</p>") == f"{want} one \ufffd two {want}"


def test_reading_goes_on_where_the_library_gives_up(monkeypatch):
    from html.parser import HTMLParser

    plain = HTMLParser.parse_starttag

    def fails(self, i):
        if self.rawdata.startswith("<odd", i):
            raise AssertionError
        return plain(self, i)

    monkeypatch.setattr(HTMLParser, "parse_starttag", fails)
    assert html_extract.extract_text("<article><p>one<odd x>two<p>three <odd></article>") == "one<odd x>two three <odd>"
