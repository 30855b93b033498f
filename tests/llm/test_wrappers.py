"""HTML wrappers decide what is the article, without telling tags or class names, whatever the order and number of tasks."""

from __future__ import annotations

import random
import time

import pytest

from scanfuse.llm import html

SHAPE = "page_id long, url string, html string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def plain_host(n: int, seed: int = 1) -> list[tuple[int, str, str, str]]:
    """Pages of divs and spans alone: template text above, beside and below, an article of varying length, a ticker that varies too."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        title, paras = words(rng, 5), [words(rng, rng.randint(15, 60)) for _ in range(rng.randint(1, 5))]
        notes = [words(rng, 20) for _ in range(k % 3)]
        extra = "".join(f"<div><div>{x}</div></div>" for x in notes)
        page = f"<html><body><div><div>Home</div><div>About us</div><div>{words(rng, 2)}</div></div><div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + extra + "</div><div>All rights reserved. Copyright by the example company of the example town.</div></body></html>"
        out.append((k, f"http://plain.example/{k}", page, " ".join([title, *paras, *notes])))
    return out


def test_hosts_without_telling_names(spark):
    pages = plain_host(40)
    df = spark.createDataFrame([p[:3] for p in pages], SHAPE)
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {k: text for k, _, _, text in pages}


def test_template_text_beside_the_paragraphs_goes(spark):
    rng = random.Random(2)
    pages = []
    for k in range(12):
        title, paras = words(rng, 4), [words(rng, 30) for _ in range(1 + k % 3)]
        page = f"<body><div>Home</div><div>About</div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "<div>Copyright of the house</div></body>"
        pages.append((k, "http://flat.example/", page, " ".join([title, *paras])))
    df = spark.createDataFrame([p[:3] for p in pages], SHAPE)
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {k: text for k, _, _, text in pages}
    assert all("Home" in html.main_text(p[2], None) for p in pages)  # it is the wrapper that tells


@pytest.mark.parametrize("parts", [1, 7])
def test_no_result_depends_on_partitions(spark, parts):
    pages = plain_host(30) + [(k + 100, u, p, t) for k, u, p, t in plain_host(9, 5)]
    rows = [p[:3] for p in pages]
    random.Random(parts).shuffle(rows)
    one = {r["host"]: r["wrapper"] for r in html.wrappers(spark.createDataFrame(rows, SHAPE).repartition(parts)).collect()}
    two = {r["host"]: r["wrapper"] for r in html.wrappers(spark.createDataFrame([p[:3] for p in pages], SHAPE).coalesce(3)).collect()}
    assert one == two


def test_every_page_is_of_its_wrapper(spark):
    rng = random.Random(3)
    pages = []
    for k in range(60):
        body = "".join(rng.choice(["<p>{}</p>", "<div><span>{}</span></div>", "<ul><li>{}</li><li>x</li></ul>", "<section><h2>{}</h2><p>y</p></section>", "<table><tr><td>{}</td></tr></table>"]).format(words(rng, 3)) for _ in range(rng.randint(0, 9)))
        pages.append((k, "http://mixed.example/", f"<body><div>{body}</div></body>"))
    wrapper = html.Compiled(html._load(html.wrappers(spark.createDataFrame(pages, SHAPE)).first()["wrapper"]))
    assert all(wrapper.path(html.skeleton(p)[0]) is not None for _, _, p in pages)


def test_long_and_varied_pages():
    first = "<body><div>" + "".join(f'<div class="k{k}"><p>text {k}</p></div>' for k in range(1600)) + "</div></body>"
    second = first.replace('<div class="k7">', '<section class="new"><p>more</p></section><div class="k7">')
    wrapper = html.align(html.wrapper_of(first), html.wrapper_of(second))
    both = html.Compiled(wrapper)
    assert all(both.path(html.skeleton(p)[0]) for p in (first, second))
    assert "more text 7 " in html.main_text(second, both)
    # a group of many symbols is folded like a short one
    group = "".join(f'<div class="g{k}">{{}}</div>' for k in range(20))
    assert len(html.wrapper_of("<body>" + group.format(*range(20)) * 3 + "</body>")) == 2


def test_marks_that_do_not_hide():
    for page, want in {
        '<body><div class="content has-sidebar"><p>Hello world</p></div></body>': "Hello world",
        "<body><form action=x><div><p>All of the article is in a form.</p><p>As some servers do.</p></div></form></body>": "All of the article is in a form. As some servers do.",
        "<body><article><p>Text.</p><form><button>Send</button>mail</form></article></body>": "Text.",
        '<body><main><h1>T</h1><div class="post-comments"><p>c</p></div><p>b</p></main></body>': "T b",
    }.items():
        assert html.main_text(page, None) == want, page


def test_both_ways_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([p[:3] for p in plain_host(8)] + [(100, None, None), (101, "http://other.example/", "<p>x</p>")], SHAPE)
    sent = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    monkeypatch.setattr(html, "SENT_BYTES", -1)
    assert sent == {r["page_id"]: r["text"] for r in html.extract(df).collect()}


@pytest.mark.parametrize("n", [3, 4, 5, 8])
def test_text_that_all_pages_share_is_not_the_article(spark, n):
    """However long it is, and on however few pages from three on."""
    shop = "Buy our fine goods, delivered the same day to every town in the land, at prices that nobody else can offer you today or at any other time."
    news = ["The council met on Monday about the bridge.", "Rain is expected in the north by the evening.", "A new school opens its doors next week.", "The harbour was closed after the storm.", "Two teams share the first place.", "The old mill becomes a museum.", "Buses run later on Fridays now.", "The mayor spoke of the budget."]
    pages = spark.createDataFrame([(k, f"http://shop.example/{k}", f"<html><body><div>{shop}</div><div><p>{news[k]}</p></div></body></html>") for k in range(n)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == dict(enumerate(news[:n]))


def halves(n: int) -> list[tuple[int, str, str, str]]:
    """Articles in two neighbouring parts without telling names, beside a link list and a short line that vary too."""
    rng = random.Random(6)
    out = []
    for k in range(n):
        one, two, three = words(rng, 35), words(rng, 20), words(rng, 25)
        links = "".join(f"<div><a href='/{j}'>{words(rng, 6)}</a></div>" for j in range(8))
        page = f'<body><div class="top">Home</div><div class="tick">{words(rng, 1)}</div><div class="wrap"><h1>No {k}</h1>{one}</div><div class="wrap2">{two}</div><p>{three}</p><div class="more">{links}</div><div class="end">All of this is ours, and nobody else may print it again.</div></body>'
        out.append((k, "http://halves.example/", page, f"No {k} {one} {two} {three}"))
    return out


@pytest.mark.parametrize("n", [3, 12])
def test_articles_in_neighbouring_parts_are_whole(spark, n):
    pages = halves(n)
    df = spark.createDataFrame([p[:3] for p in pages], SHAPE)
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == {k: text for k, _, _, text in pages}


def test_articles_in_neighbouring_parts_of_a_single_page():
    rng = random.Random(7)
    one, two = words(rng, 35), words(rng, 20)
    assert html.main_text(f'<body><div class="wrap">{one}</div><div class="wrap2">{two}</div></body>', None) == f"{one} {two}"
    named = f'<body><div class="box">{two}</div><div class="box2"><div class="entry-content">{one}</div></div></body>'
    assert html.main_text(named, None) == one


def plain_fold(shapes: list) -> list[int]:
    """The lengths of which two neighbouring runs of whole elements are equal."""
    return [n for n in range(1, len(shapes) // 2 + 1) if any(shapes[k : k + n] == shapes[k + n : k + 2 * n] and html._whole(shapes[k : k + n]) for k in range(len(shapes) - 2 * n + 1))]


@pytest.mark.parametrize("short", [0, html.SHORT_ROW])
def test_no_repeat_is_passed_over(monkeypatch, short):
    monkeypatch.setattr(html, "SHORT_ROW", short)
    rng = random.Random(8)
    for _ in range(300):
        shapes = rng.choices(["#", "<div>", "</div>", "<p>", "<ul>", "</ul>"], k=rng.randint(0, 12)) * rng.randint(1, 4)
        found, n = [], 0
        while n := html._next_repeat(shapes, n):
            found.append(n)
        assert set(plain_fold(shapes)) <= set(found)


@pytest.mark.parametrize("part", ["<div>x", "<div>x</div>", "<p>x", "<div></section>", "<div class=k{}>x</div>"])
def test_pages_of_many_tags_are_folded_soon(part):
    start = time.process_time()
    html.wrapper_of("<body>" + "".join(part.format(k % 5_000) for k in range(15_000)))
    assert time.process_time() - start < 10
