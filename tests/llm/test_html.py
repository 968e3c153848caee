import pytest

from lotquery.llm.html_extract import Page, extract_pages, winning_paths

BODY = "".join(f"<p>Paragraph {i} of the article, with <a href='/x'>a link</a> and\n some   words.</p>" for i in range(6))
LINES = "\n".join(f"Paragraph {i} of the article, with a link and some words." for i in range(6))
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(5)) + "</ul>"


@pytest.mark.parametrize("page", [
    f"<html><body><nav>{MENU}</nav><article>{BODY}</article><footer>foot</footer></body></html>",
    f"<body><header><h1>Site</h1>{MENU}</header><div id=main class='content post-17'>{BODY}</div><aside>side</aside></body>",
    f"<body><div class='site-header'>Site</div><div>{MENU}</div><section class=story>{BODY}</section><div class='footer'>f</div>",
    f"<main><div class='cookie-notice'>We use cookies</div>{BODY}<form><p>Mail<input name=q></form></main>",
    f"<div class=wrap>{BODY}<div class='comments'><p>{'A reader says a lot here. ' * 60}</p></div></div>",
    f"<div class=wrap>{BODY}<section id=respond-comments><ol class=commentlist><li>me too</ol></section></div>",
    f"<div class='layout with-sidebar'><div class='sidebar'><p>{'side text ' * 30}</p></div><article class=post>{BODY}</article></div>",
    f"<style>p{{}}</style><script>var t='</p><p>no';</script><article>{BODY}<div class=ad>buy</div><div class='share social'>tweet</div></article>",
    f"<body><div role=navigation>x</div><div role=banner>y</div><article>{BODY}</article><div hidden>z</div><div style='display: none'>n</div>",
    f"<article>{BODY.replace('</p>', '')}</article><noscript><p>no</noscript><!-- <p>no</p> --><template><p>no</template>",
    f"<main>{BODY}<article class=comment><p>first!</article><article class='teaser related'><p>Read this too</article></main>",
    f"<table><tr><td>{MENU}</td><td class=text>{BODY}</td></tr></table>",
])
def test_templates(page):
    assert Page(page).text(None) == LINES


def test_blocks_and_references():
    page = Page("<article><h1>T&eacute;l &#x41;&#66;&nbsp;x</h1><p>a<b>b</b>c<br>d<ul><li>one<li>two &lt;b&gt;</ul>"
                "<pre> x\n  y </pre><blockquote>q</blockquote><dl><dt>t<dd>d</dl>tail</article>")
    assert page.text(None).split("\n") == ["Tél AB x", "abc d", "one", "two <b>", "x y", "q", "t", "d", "tail"]


def test_article_headings_stay():
    page = Page(f"<div class=header>Site</div><article><header><h1>Title</h1></header><div class='post-header'>By A</div>{BODY}</article>")
    assert page.text(None) == "Title\nBy A\n" + LINES


def test_host_consensus(spark):
    """A short page whose own best container is the wrong one follows its host."""
    full = "<body><div class='top box'><p>{}</p></div><div class=text-{}>{}</div></body>"
    pages = [(i, f"https://h.example/{i}", full.format("teaser", i, BODY)) for i in range(9)]
    pages += [(99, "https://H.example/short", full.format("a long teaser that goes on and on " * 9, 99, "<p>Short text.</p>")),
              (100, "https://h.example/other", f"<body><article>{BODY}</article></body>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [tuple(r) for r in winning_paths(df).collect()] == [("h.example", "body>div.text-#", 9)]
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert got == {i: LINES for i in [*range(9), 100]} | {99: "Short text."}


def test_given_pages_hold_their_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    got = extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(got) == 250 and all(r.text.partition("\n")[2] in texts and r.n_chars == len(r.text) for r in got)


DIVS = f"<div class=text>{BODY}</div>"
COMMENTS = f"<div class=comments><article><p>{'A reader says a lot here. ' * 60}</p></article></div>"


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm><input name=q><button>Go</button><select><option>a</select><div>{MENU}</div>{DIVS}</form></body>",
    f"<body><form><nav>{MENU}</nav><article>{BODY}</article></form><footer>foot</footer></body>",
    f"<body><div class=content-sidebar-wrap><main>{BODY}</main><aside><p>side</aside></div></body>",
    f"<body><div class=sidebar-right><header>Site</header>{DIVS}<div class=sidebar><p>side</div></div><footer>foot</footer></body>",
    f"<body><div class=modal><form><article>{BODY}{COMMENTS}</article></form></div><p>Site</p></body>",
    f"<body style='display:none'><div class='nav-open'>{DIVS}</div></body>",
    f"<main><div class=promo-page><article>{BODY}</article><div class=sidebar><article><p>teaser</article></div></div></main>",
])
def test_marked_wrappers_keep_their_article(page):
    assert Page(page).text(None) == LINES


@pytest.mark.parametrize("page", [
    f"<div class=wrap>{BODY}{COMMENTS}</div>",
    f"<body><article>{BODY}</article>{COMMENTS}<aside><article><p>{'teaser ' * 20}</article></aside></body>",
    f"<body>{DIVS}<div class=sidebar><p>{'side text ' * 40}</p></div><dialog><p>{'ask ' * 200}</dialog></body>",
])
def test_marked_parts_still_go(page):
    assert Page(page).text(None) == LINES


def test_a_notice_or_footer_alone_is_no_article():
    for page in ("<div class=cookie-consent><h2>Cookies</h2><p>We use cookies here.</div>", "<footer><p>All rights reserved.</footer>"):
        assert Page(page).text(None) == ""


HALF = "".join(f"<p>Paragraph {i} of the article, with <a href='/x'>a link</a> and\n some   words.</p>" for i in range(2))
REST = BODY[len(HALF):]


@pytest.mark.parametrize("page", [
    f"<body><div class=post><div class=lead>{HALF}</div><div class=body>{REST}</div></div></body>",
    f"<body><nav>{MENU}</nav><div><div class=a><div class=lead>{HALF}</div><div class=b>{REST}</div></div></div><footer>f</footer>",
    f"<body><div class=lead>{HALF}</div><div class=body>{REST}<article class=comment><p>me too</article></div></body>",
    f"<table><tr><td>{MENU}</td><td class=text><div>{HALF}</div><div>{REST}</div></td></tr></table>",
])
def test_parts_beside_the_largest_stay(page):
    assert Page(page).text(None) == LINES


@pytest.mark.parametrize("page", [
    f"<body><div class=post><h1>Title</h1><div class=body>{BODY}</div></div></body>",
    f"<body><div class=post><div><h1><b>Title</b></h1></div><div><div class=body>{BODY}</div></div></div></body>",
])
def test_headline_beside_the_text_stays(page):
    assert Page(page).text(None) == "Title\n" + LINES


SOURCES = "<h2>Sources</h2><ol>" + "".join(f"<li><a href='/{i}'>Source number {i}</a></li>" for i in range(4)) + "</ol>"
LINKS = "<p><a href=a>One long link</a>, <a href=b>another long link</a> and <a href=c>a third long link</a></p>"


@pytest.mark.parametrize("page", [
    f"<body><nav>{MENU}</nav>{MENU}<article>{BODY}{LINKS}{SOURCES}</article>{MENU}</body>",
    f"<body><div>{MENU}</div><main><div>{BODY}{LINKS}</div><section>{SOURCES}</section></main></body>",
    f"<body><div>{MENU}</div><div class=text>{BODY}{LINKS}{SOURCES}</div>{MENU}</body>",
    f"<body><div>{MENU}</div><div class=post><div class=text>{BODY}{LINKS}</div><div class=refs>{SOURCES}</div></div></body>",
    f"<body><article>{BODY}{LINKS}{SOURCES}<nav>{MENU}</nav></article><div>{MENU}</div></body>",
])
def test_link_lists_of_an_article_stay(page):
    assert Page(page).text(None).split("\n") == [
        *LINES.split("\n"), "One long link, another long link and a third long link", "Sources", *(f"Source number {i}" for i in range(4))]


def article(inner):
    return f"<body><nav>{MENU}</nav><article>{BODY}{inner}</article><footer>foot</footer></body>"


@pytest.mark.parametrize("inner, lines", [
    ("<p>Before <span class='advert'>Buy now</span> after the advert text.</p>", ["Before after the advert text."]),
    ("<p><span class='advert'>Buy now</span> after the advert text.</p>", ["after the advert text."]),
    ("<p>Before it <button>Share this</button></p>", ["Before it"]),
    ("<p><button>Share this</button>after it</p>", ["after it"]),
    ("<p>A figure <svg><text>axis</text></svg> of it</p>", ["A figure of it"]),
    ("<p>Words <span hidden>that are hidden</span> stay</p>", ["Words that are hidden stay"]),
    ("<p>Text first. <a class='share' href=x>Share on</a></p>", ["Text first."]),
    ("<p><a class='share' href=x>Share on</a> text last.</p>", ["text last."]),
    ("<p>A&amp;<b>B</b>&lt;<i class=ad>x</i>C</p>", ["A&B<C"]),
])
def test_marks_hold_for_pieces_of_a_block(inner, lines):
    assert Page(article(inner)).text(None).split("\n") == [*LINES.split("\n"), *lines]


SECTION = "<h2>Head of it</h2><p>A section of the article that has a name of its own.</p>"


@pytest.mark.parametrize("name", ["class='discussion'", "class='related-work'", "class='legal'", "class='share-price'", "class='menu'",
                                  "class='side-effects'", "id='comments-on-method'", "class='search-results-explained'", "id=header-files",
                                  "class='feedback'", "style='display:none'", "hidden"])
def test_sections_of_an_article_stay_whatever_they_are_called(name):
    page = article(f"<section {name}>{SECTION}</section>")
    assert Page(page).text(None).split("\n")[6:] == ["Head of it", "A section of the article that has a name of its own."]


@pytest.mark.parametrize("inner", [
    "<div class='advert'><p>Buy now, it is cheap.</p></div>", "<div class='ad-box'>Buy</div>", "<div id=ad_slot_3>Buy</div>",
    f"<div class='comments'><p>{'A reader says a lot here. ' * 40}</p></div>", "<div id=comment-list><p>me too</div>",
    f"<div class='menu'>{MENU}</div>", f"<div class='related-posts'>{MENU}</div>", "<div class='share-buttons'><a href=x>One</a> <a href=y>Two</a></div>",
    "<div class='cookie-notice'>We use cookies</div>", "<div class='newsletter'><p>Read more by mail</p><input name=m></div>",
    "<div class='feedback'><p>Was this useful?</p><button>Yes</button></div>", "<form><p>Ask us</p><input></form>", "<aside><p>aside</p></aside>",
])
def test_marked_parts_of_an_article_go(inner):
    assert Page(article(inner)).text(None) == LINES


def test_a_second_template_of_a_host_keeps_its_text(spark):
    """Most pages have div.text; some have a teaser in it and the article in div.story."""
    first = "<body><div class=text>{}</div><div class=foot-line>About us all</div></body>"
    second = "<body><div class=text><p>Short teaser.</p></div><div class=story>{}</div></body>"
    pages = [(i, f"https://t.example/{i}", first.format(BODY)) for i in range(8)]
    pages += [(20 + i, f"https://t.example/{i}", second.format(BODY)) for i in range(3)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: LINES for i, _, _ in pages}


def test_pages_without_articles(spark):
    """No page has an article element; menus, adverts and footers differ from page to page."""
    page = ("<html><head><title>T {0}</title></head><body><div class=top><div class=logo>Site</div>{1}</div><div class='ad-{0}'>Buy {0}</div>"
            "<div id=c{0} class='entry entry-{0}'><h1>Title {0}</h1>{2}</div><div class=footer>Foot {0}</div></body></html>")
    pages = [(i, f"https://n.example/{i}", page.format(i, MENU, BODY)) for i in range(6)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n{LINES}" for i in range(6)}


@pytest.mark.parametrize("page", [
    "<body><div class=text><ul>" + "".join(f"<li>Item number {i} of the list" for i in range(20_000)) + "</ul></div></body>",
    "<p>text " + "<a href=x>unclosed " * 8_000, "<p>text " + "<span>unclosed " * 8_000 + "</b>" * 8_000,
    "<b>" + "<div>" + "<span>x" * 4_000 + "</b>" * 4_000, "<div><article><p>nested</p>" * 8_000,
    "<table><tr><td>" * 4_000 + "deep", "<p>a" * 20_000, "<dl>" + "<dt>t<dd>d" * 10_000,
])
def test_time_grows_with_the_page(page):
    import time
    start = time.process_time()
    parsed = Page(page)
    parsed.text(parsed.path(parsed.container()))
    parsed.places(parsed.container())
    assert time.process_time() - start < 2.5


def test_first_lines_of_given_pages(spark):
    """The first line is the page's heading, the rest a document."""
    import html
    import re
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    heads = {r.page_id: " ".join(html.unescape(re.search(r"<h1>(.*?)</h1>", r.html, re.S)[1]).split()) for r in pages.collect()}
    got = extract_pages(pages).collect()
    assert len(got) == 250 and all(r.text.partition("\n")[0] == heads[r.page_id] for r in got)
