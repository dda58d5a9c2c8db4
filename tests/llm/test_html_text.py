import random

import pytest

from weirgauge.llm.html_text import blocks_of, main_text, page_texts, stop_density

LONG = ("The report that was written by the group is to be read with the notes that are in it, and it has more than a few "
        "of the facts which were not known at the time when the first of the two books on this matter was in print.")


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"),
    ("<p>One</p><p>Two &amp; three&nbsp;&#52;&quot;&copy</p>", "One\nTwo & three 4\"©"),
    ("<article><h1>T</h1><p>a\n  b<b>c</b>\td<br>e<p>f</article>", "T\na bc d e\nf"),
    ("<article><p>x<script>var a = '</p>';</script>y</p><style>p{}</style><!-- <p>no</p> --></article>", "xy"),
    ("<nav><ul><li><a href='/'>Home</a></ul></nav><article><p>Text</p></article><footer>&copy; me</footer>", "Text"),
    ("<header>Site</header><article><header><h1>Title</h1></header><p>Body</p></article>", "Title\nBody"),
    ("<article><p>Body</p><aside>More</aside><div class='ad-box'>Buy</div><form>Mail <input></form><p>End</p></article>", "Body\nEnd"),
    ("<article><p>Body</p><section id=comments><p>First!</p></section></article>", "Body"),
    ("<article><p class='notice'>We use cookies</p><p>Body</p></article><div class='sidebar'><p>" + LONG + "</p></div>", "Body"),
    ("<article><div hidden>h</div><div style='display: none'>n</div><p>Body</p></article>", "Body"),
    ("<article><p>Body < 3 and a<b</p></article>", "Body < 3 and a"),
    ('<article><p title="a > b">Body</p><img alt="<p>">', "Body"),
    ("<script>never closed <p>x</p>", ""), ("<p>a</p><!-- never closed <p>x</p>", "a"),
    ("<article><p>cut off in an entity &am", "cut off in an entity &am"),
    ("<article><ul><li class='share'>Share<li>Item one<li>Item two</ul></article>", "Item one\nItem two"),
])
def test_pages(page, want):
    assert main_text(page) == want


def test_density_rules_without_an_article():
    links = "".join(f"<a href='/{i}'>link number {i} of the list</a> " for i in range(12))
    page = (f"<body><div>{links}</div><h2>Short head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div>{links}</div>"
            f"<p>after links</p><div>{' '.join(['keyword'] * 30)}</div></body>")
    assert main_text(page) == f"Short head\n{LONG}\nShort.\n{LONG}"


def test_nearest_neighbour_decides():
    links = "<a href='/'>" + "some linked words " * 8 + "</a>"
    far = "<p>x</p>" * 3
    assert main_text(f"<div>{links}</div>{far}<p>{LONG}</p>") == f"x\nx\n{LONG}"  # the middle one is as near to both


def test_attributes_and_broken_markup_do_not_hang():
    assert main_text("<a href=\"" * 2000) is not None
    assert main_text("<p " + "a='" * 5000) is not None
    assert main_text("<div>" * 3000 + "x") == "x"
    assert blocks_of("<article><a href=x>open link<p>text of the article</article><p>rest")[-1].link_chars == 0


def test_stop_density():
    assert stop_density("") == 0 and stop_density("The cat") == 0.5 and stop_density("THE!! der### de***") == 1


def test_articles_come_out_whole():
    """Pages put together from known paragraphs, with things around and inside them."""
    rng = random.Random(3)
    for _ in range(200):
        paragraphs = [" ".join(rng.choice("alpha the beta of gamma and x".split()) for _ in range(rng.randrange(1, 60)))
                      for _ in range(rng.randrange(1, 8))]
        parts = []
        for p in paragraphs:
            parts.append(f"<p>{p}" + rng.choice(["", "</p>"]))
            parts.append(rng.choice(["", "", "<aside><p>the aside of the page</p></aside>", "<div class='advert'>buy</div>", "<!-- c -->"]))
        page = ("<!DOCTYPE html><html><head><title>t</title></head><body><nav><a href=/>n</a></nav>"
                f"<article>{''.join(parts)}</article><div id='comments'><p>{LONG}</p></div><footer>f</footer></body></html>")
        assert main_text(page) == "\n".join(paragraphs)


def test_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<p>😀 é</p>", "x", 0), (1, "u", "<p>😀 é</p>", "x", 0), (2, None, None, "x", 0), (None, "v", "", "x", 0),
            (3, "w", "<p>" + "long " * 50_000, "x", 0)]
    pages = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, page_texts(pages).collect()), key=str)
    want = [(r[0], r[1], t, len(t)) for r in rows for t in [main_text(r[2])]]
    assert got == sorted(want, key=str)
    assert page_texts(pages).columns == ["page_id", "url", "text", "n_chars"] and page_texts(pages.limit(0)).count() == 0


def test_names_of_wrappers_leave_articles_alone():
    body = "<p>" + LONG + "</p><p>Short.</p>"
    want = LONG + "\nShort."
    for wrapper in ("content has-sidebar", "no-comments", "share-price-analysis", "sidebar", "comments-open widget"):
        assert main_text(f'<div class="{wrapper}"><article>{body}</article></div>') == want, wrapper
        assert main_text(f'<article><div class="{wrapper}">{body}</div></article>') == (
            "" if wrapper.split()[-1] in ("sidebar", "widget") else want), wrapper
    for name in ("site-footer", "main_nav", "comment-list", "social-share", "cookie-banner", "related-posts", "ad", "ad-slot top"):
        assert main_text(f'<article>{body}<div class="{name}"><p>{LONG}</p></div></article>') == want, name
    assert main_text(f'<div hidden><article>{body}</article></div><article>{body}</article>') == want
    assert main_text(f'<footer><article>{body}</article></footer>') == ""


def test_pages_in_other_languages():
    russian = "Весной река снова разлилась по лугам, и старый мост оказался под водой почти на две недели, так что деревня жила без хлеба. " * 3
    japanese = "春になると川はふたたび牧草地にあふれ、古い橋は二週間ちかく水の下に沈んでいた。村の人びとは舟でパンを運んだ。" * 6
    italian = "Quella primavera il fiume tornava a coprire i prati, mentre vecchi ponti sparivano sotto acqua fangosa per giorni interi. " * 3
    links = "".join(f'<li><a href="/{i}">Раздел {i}</a></li>' for i in range(9))
    for text in (russian, japanese, italian):
        text = text.strip()
        page = f"<html><body><ul>{links}</ul><h1>{text[:20].strip()}</h1><p>{text}</p><p>{text[:90].strip()}</p><p>{text}</p></body></html>"
        got = main_text(page)
        assert got.split("\n") == [text[:20].strip(), text, text[:90].strip(), text]
