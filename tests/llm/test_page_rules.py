"""Templates on small and odd hosts, articles that are set aside, elements with several names."""

import time

from corpusloom.llm import page_template

SCHEMA = "page_id long, url string, html string"
MORE = "<div class='more'>Read more on this site</div>"


def extracted(spark, pages):
    rows = [(i, f"https://{host}/{i}", text) for i, host, text in pages]
    return {r.page_id: r.text for r in page_template.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def article(i, extra=MORE):
    return f"<html><body><article><h1>Title {i}</h1><p>Words of page {i}</p>{extra}</article></body></html>"


def test_template_text_at_any_host_size_and_with_odd_pages(spark):
    pages = [(i, "small.example", article(i)) for i in range(8)]
    pages += [(100 + i, "odd.example", article(100 + i)) for i in range(30)]
    pages += [(130, "odd.example", None), (131, "odd.example", ""), (132, "odd.example", "<html><body>503"), (133, "odd.example", article(133)[:60])]
    pages += [(200 + i, "line.example", article(200 + i, "" if i == 4 else "<p>Follow us</p>" + "<p>x</p>" * (i % 3))) for i in range(20)]
    pages += [(300 + i, "plain.example", f"<html><body><div><p>Words of page {300 + i}</p><p>Subscribe now</p></div></body></html>") for i in range(9)]
    text = extracted(spark, pages)
    for i in [*range(8), *range(100, 130)]:
        assert text[i] == f"Title {i}\nWords of page {i}"
    assert (text[130], text[131], text[132]) == ("", "", "503")
    assert not any("Follow us" in text[200 + i] for i in range(20))
    assert all(text[300 + i] == f"Words of page {300 + i}" for i in range(9))


def test_copies_of_a_page_are_no_template(spark):
    pages = [(i, "copies.example", article(1)) for i in range(40)]
    pages += [(100 + i, "mixed.example", article(1, "")) for i in range(41)] + [(200 + i, "mixed.example", article(200 + i)) for i in range(9)]
    text = extracted(spark, pages)
    assert text[0] == "Title 1\nWords of page 1\nRead more on this site"
    assert text[100] == "Title 1\nWords of page 1"
    assert all(text[200 + i] == f"Title {200 + i}\nWords of page {200 + i}" for i in range(9))


def test_articles_that_are_set_aside_do_not_hide_the_main_text():
    teasers = "<aside><article><h2>Other story</h2></article></aside>"
    comments = "<section class='comments'><article><p>first!</p></article></section>"
    assert page_template.main_text(f"<body><main><p>The story</p></main>{teasers}{comments}</body>", {}) == "The story"
    assert page_template.main_text(f"<body><div>The story</div><article> <img src=x> </article>{comments}</body>", {}) == "The story"
    assert page_template.main_text(f"<body><p>outside</p><article>The story</article>{teasers}</body>", {}) == "The story"


def test_every_name_of_an_element_counts():
    for names in ("post ad", "col sidebar", "col-4\n\tcookie-notice", "x y related"):
        assert page_template.main_text(f"<article><p>The story</p><div class='{names}'>Buy now</div></article>", {}) == "The story"
        assert page_template.main_text(f"<div><p>The story</p><div class=\"{names}\" id=d1>Buy now</div></div>", {}) == "The story"
    assert page_template.main_text("<body class='single has-sidebar sidebar'><main class='col banner'><p>The story</p></main></body>", {}) == "The story"
    assert page_template.main_text("<article class='post category-social no-sidebar'>The story</article>", {}) == "The story"


def test_compounds_are_what_their_head_says():
    for names in ("class='ad-free-reading'", "class='notice-period'", "id='share-prices'", "class='header-bidding-explained'", "class=comment-culture"):
        assert page_template.main_text(f"<article><p>The story</p><div {names}>goes on</div></article>", {}) == "The story\ngoes on", names
    for names in ("class='ad-slot'", "class='share-buttons'", "id=related-posts", "class='cmt'", "class='comment-list-2'", "class='site-header'", "id=cookie_consent"):
        assert page_template.main_text(f"<article><p>The story</p><div {names}>Buy now</div></article>", {}) == "The story", names


def test_link_lists_are_no_text_where_there_is_no_article():
    menu = "<ul class='top-links'><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"
    story = "<p>The story by <a href=/b>B</a></p><p><a href=/x>one link</a></p><p>ends</p>"
    assert page_template.main_text(f"<body>{menu}<div>{story}</div><div class='cmt'>first!</div>{menu}</body>", {}) == "The story by B\none link\nends"
    inside = page_template.main_text(f"<body>{menu}<article>{story}{menu}</article></body>", {})
    assert inside == "The story by B\none link\nends\nHome\nNews\nSport"


def test_deep_and_unclosed_pages_take_linear_time():
    def seconds(page):
        begin = time.perf_counter()
        page_template.main_text(page, {})
        return time.perf_counter() - begin

    for unit in ("<div>", "<b>", "<b></i>", "<p><b>", "<li><b>", "<td><i><b>", "<p>x<div></p>"):
        seconds(unit * 1000)
        assert seconds(unit * 40_000 + "end") < 40 * max(seconds(unit * 4_000 + "end"), 0.01), unit
